"""System catalogues as frames made from the manifest and the security document; any SQL may be asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST_TABLE, FIRST_INDEX, FIRST_ROLE, PUBLIC = 16384, 17000, 10, 2200

#: information_schema.x is bound under this prefix, as Spark SQL would take the schema for a database.
PREFIX = "information_schema_"
# Fixed value: the object id of the first database.
FIRST_DATABASE = 13442
# Object id, name and length of the types that clients ask for (-1: of any length).
PG_TYPES = [
    (16, "bool", 1), (17, "bytea", -1), (20, "int8", 8), (21, "int2", 2), (23, "int4", 4), (25, "text", -1), (114, "json", -1), (700, "float4", 4), (701, "float8", 8),
    (1043, "varchar", -1), (1082, "date", 4), (1114, "timestamp", 8), (1184, "timestamptz", 8), (1700, "numeric", -1), (2950, "uuid", 16), (3802, "jsonb", -1),
]
# Object id of each SQL type name; a type of the user's own is text to clients.
TYPE_OID = {
    "smallint": 21, "integer": 23, "int": 23, "serial": 23, "bigint": 20, "bigserial": 20, "real": 701, "float": 701, "double precision": 701, "numeric": 1700, "decimal": 1700, "text": 25, "varchar": 1043, "char": 1043,
    "boolean": 16, "bool": 16, "date": 1082, "timestamp": 1114, "timestamptz": 1184, "uuid": 2950, "json": 114, "jsonb": 3802, "bytea": 17,
}


def _numbers(m: dict) -> dict[tuple[str, str], int]:
    """Object ids: tables, then views, then indexes, each in order of name."""
    out = {(k, n): FIRST_TABLE + i for i, (k, n) in enumerate((k, n) for k in ("tables", "views") for n in sorted(m[k]))}
    return out | {("indexes", n): FIRST_INDEX + i for i, n in enumerate(sorted(m["indexes"]))}


def _members(s: dict) -> dict[str, int]:
    return {n: FIRST_ROLE + i for i, n in enumerate([*s["users"], *s["roles"]])}


def pg_class(m, s, db):
    oid, who = _numbers(m), _members(s)
    owner = lambda k, n: who.get(m[k][n]["owner"] if k == "tables" else m["tables"][m[k][n]["table"]]["owner"] if k == "indexes" else s["databases"][db]["owner"], FIRST_ROLE)
    return "oid long, relname string, relnamespace long, relkind string, relowner long", [(i, n, PUBLIC, {"tables": "r", "views": "v", "indexes": "i"}[k], owner(k, n)) for (k, n), i in oid.items()]


def pg_attribute(m, s, db):
    oid = _numbers(m)
    return "attrelid long, attname string, atttypid long, attnum int, attnotnull boolean", [(oid["tables", t], c["name"], TYPE_OID.get(c["type"], 25), i, not c["null"]) for t in sorted(m["tables"]) for i, c in enumerate(m["tables"][t]["columns"], 1)]


def pg_index(m, s, db):
    oid, rows = _numbers(m), []
    for n, x in sorted(m["indexes"].items()):
        at = [c["name"] for c in m["tables"][x["table"]]["columns"]]
        rows.append((oid["indexes", n], oid["tables", x["table"]], " ".join(str(at.index(c) + 1) for c in x["columns"]), x["unique"]))
    return "indexrelid long, indrelid long, indkey string, indisunique boolean", rows


def pg_type(m, s, db):
    return "oid long, typname string, typlen int", PG_TYPES


def pg_namespace(m, s, db):
    return "oid long, nspname string", [(11, "pg_catalog"), (PUBLIC, "public")]


def pg_database(m, s, db):
    who = _members(s)
    return "oid long, datname string, datdba long, encoding string", [(FIRST_DATABASE + i, n, who.get(d["owner"], FIRST_ROLE), "UTF8") for i, (n, d) in enumerate(s["databases"].items())]


def pg_roles(m, s, db):
    flags = "rolname string, rolsuper boolean, rolinherit boolean, rolcreaterole boolean, rolcreatedb boolean, rolcanlogin boolean"
    return flags, [(n, u["superuser"], True, u["superuser"], u["createdb"], True) for n, u in s["users"].items()] + [(n, r["superuser"], True, r["superuser"], r["superuser"], False) for n, r in s["roles"].items()]


def pg_user(m, s, db):
    return "usename string, usesuper boolean, usecreatedb boolean", [(n, u["superuser"], u["createdb"]) for n, u in s["users"].items()]


def pg_auth_members(m, s, db):
    who = _members(s)
    return "roleid long, member long, grantor long, admin_option boolean", [(who[r], who[n], FIRST_ROLE, False) for part in ("users", "roles") for n, x in s[part].items() for r in x["roles"]]


def table_privileges(m, s, db):
    return "grantor string, grantee string, table_catalog string, table_schema string, table_name string, privilege_type string", [(t["owner"], to, db, "public", n, p) for n, t in sorted(m["tables"].items()) for to, ps in sorted(t["privileges"].items()) for p in ps]


def tables(m, s, db):
    return "table_catalog string, table_schema string, table_name string, table_type string", [(db, "public", t, "BASE TABLE") for t in sorted(m["tables"])] + [(db, "public", v, "VIEW") for v in sorted(m["views"])]


def columns(m, s, db):
    rows = [(db, "public", t, c["name"], i, "YES" if c["null"] else "NO", c["type"]) for t in sorted(m["tables"]) for i, c in enumerate(m["tables"][t]["columns"], 1)]
    return "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string", rows


CATALOGS = {f.__name__: f for f in (pg_class, pg_attribute, pg_index, pg_type, pg_namespace, pg_database, pg_roles, pg_user, pg_auth_members, table_privileges)}
INFORMATION_SCHEMA = {"tables": tables, "columns": columns, "table_privileges": table_privileges}


def frame(spark: SparkSession, make, m: dict, s: dict, db: str) -> DataFrame:
    schema, rows = make(m, s, db)
    return spark.createDataFrame(rows, schema)
