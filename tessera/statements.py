"""Registered queries that go through the SQL front end: definitions, writes, transactions, COPY, dumps, catalogues.

Each works in a folder of its own below the shared one, on copies of the tables it writes. Where the statement's effect is
a set of rows, the oracle gives the rows expected after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.errors import EngineError
from tessera.operators import compat, constraints
from tessera.queries import query, table
from tessera.sources import store

# Copies of the tables, as the front end declares them.
DDL = {
    "region": "CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT NOT NULL)",
    "nation": "CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey INTEGER NOT NULL REFERENCES region(r_regionkey))",
    "orders": "CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_orderstatus CHAR(1), o_totalprice DOUBLE PRECISION, o_orderdate TIMESTAMP, o_orderpriority VARCHAR(20))",
}
NATION = "cast(n_nationkey as bigint) as n_nationkey, n_name, cast(n_regionkey as bigint) as n_regionkey"


def database(spark: SparkSession, d: str, *names: str) -> Engine:
    db = Engine(spark, store.workspace(spark))
    for n in names:
        db.sql(DDL[n])
        db.append(n, table(spark, d, n))
    return db


@query("select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by o_custkey")
def view_nested(spark, d):
    db = database(spark, d, "orders")
    db.sql("CREATE VIEW done AS SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
    db.sql("CREATE VIEW per_customer AS SELECT o_custkey, count(*) AS n FROM done GROUP BY o_custkey")
    return db.sql("SELECT * FROM per_customer")


@query(f"select {NATION} from nation union all select 100, 'ATLANTIS', 1 union all select n_nationkey + 200, 'NEW ' || n_name, n_regionkey from nation where n_regionkey = 2")
def dml_insert(spark, d):
    db = database(spark, d, "region", "nation")
    db.sql("INSERT INTO nation (n_name, n_nationkey, n_regionkey) VALUES ('ATLANTIS', 100, 1)")
    db.sql("INSERT INTO nation SELECT n_nationkey + 200, concat('NEW ', n_name), n_regionkey FROM nation WHERE n_regionkey = 2")
    return db.table("nation")


@query("select o_orderkey, o_custkey, case when o_totalprice > 200000 then 'X' else o_orderstatus end as o_orderstatus, case when o_totalprice > 200000 then o_totalprice * 2 else o_totalprice end as o_totalprice from orders")
def dml_update(spark, d):
    db = database(spark, d, "orders")
    db.sql("UPDATE orders SET o_orderstatus = 'X', o_totalprice = o_totalprice * 2 WHERE o_totalprice > 200000")
    return db.sql("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")


@query("select o_orderkey from orders where not (o_orderstatus = 'F' and o_custkey in (select o_custkey from orders group by o_custkey having count(*) > 10))")
def dml_delete(spark, d):
    db = database(spark, d, "orders")
    db.sql("DELETE FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)")
    return db.sql("SELECT o_orderkey FROM orders")


@query("select o_orderkey from orders where o_orderstatus = 'P' or not o_orderstatus = 'O'")
def dml_null_condition(spark, d):
    db = database(spark, d, "orders")
    db.sql("UPDATE orders SET o_orderstatus = NULL WHERE o_orderstatus = 'P'")
    db.sql("DELETE FROM orders WHERE o_orderstatus = 'O'")  # a null condition deletes nothing
    return db.sql("SELECT o_orderkey FROM orders")


@query(f"select n_nationkey, n_name as title, cast(null as varchar) as note from (select {NATION} from nation) x")
def ddl_alter(spark, d):
    db = database(spark, d, "region", "nation")
    for action in ("DROP COLUMN n_regionkey", "RENAME COLUMN n_name TO title", "ADD COLUMN note TEXT", "RENAME TO nations"):
        db.sql(f"ALTER TABLE nation {action}")
    return db.table("nations")


@query("select cast(r_regionkey as bigint) as r_regionkey, r_name from region where r_regionkey <> 1 union all select 50, 'KEPT'")
def transaction(spark, d):
    db = database(spark, d, "region")
    for text in ("BEGIN", "INSERT INTO region VALUES (50, 'KEPT')", "DELETE FROM region WHERE r_regionkey = 1", "COMMIT", "BEGIN", "DELETE FROM region", "ROLLBACK", "VACUUM"):
        db.sql(text)
    return db.table("region")


@query("select l_orderkey, l_suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier where s_nationkey < 20)")
def fk_violations(spark, d):
    return constraints.orphans(table(spark, d, "lineitem"), "l_suppkey", table(spark, d, "supplier").where("s_nationkey < 20"), "s_suppkey").select("l_orderkey", "l_suppkey")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def unique_violations(spark, d):
    return constraints.repeats(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey from (select o_orderkey, nullif(o_orderpriority, '1-URGENT') as p from orders) x where p is null")
def not_null_violations(spark, d):
    return constraints.missing(table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p")), "p").select("o_orderkey")


@query("select event_id, event_type from events where event_type not in ('click', 'view')")
def enum_violations(spark, d):
    return constraints.outside(table(spark, d, "events"), "event_type", ["click", "view"]).select("event_id", "event_type")


@query("select n_name from nation where strlen(n_name) > 8")
def varchar_violations(spark, d):
    return constraints.too_long(table(spark, d, "nation"), "n_name", 8).select("n_name")


@query("select row_number() over (order by o_orderkey) as id, o_orderkey from orders")
def serial_fill(spark, d):
    """Numbers are dealt in order of arrival, which is that of the sorted partitions here."""
    db = Engine(spark, store.workspace(spark))
    db.sql("CREATE TABLE numbered (id SERIAL, o_orderkey BIGINT)")
    db.append("numbered", table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey"), ["o_orderkey"])
    return db.table("numbered")


def _copied(spark: SparkSession, d: str, options: str) -> DataFrame:
    db = database(spark, d, "orders")
    to = f"{db.path}/out"
    db.sql(f"COPY orders TO '{to}'{options}")
    db.sql("DELETE FROM orders")
    db.sql(f"COPY orders FROM '{to}'{options}")
    return db.table("orders")


@query("select * from orders")
def copy_csv_round_trip(spark, d):
    return _copied(spark, d, "")


@query("select * from orders")
def copy_binary_round_trip(spark, d):
    return _copied(spark, d, " WITH (FORMAT binary)")


def _restored(spark: SparkSession, d: str, binary: bool) -> DataFrame:
    db = database(spark, d, "region", "nation")
    db.dump(f"{db.path}/dump", binary=binary)
    db.sql("CREATE DATABASE again")
    again = Engine(spark, db.root, database="again")
    again.restore(f"{db.path}/dump")
    return again.sql("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


@query("select cast(n_nationkey as bigint) as n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def dump_sql_round_trip(spark, d):
    return _restored(spark, d, False)


@query("select cast(n_nationkey as bigint) as n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def dump_binary_round_trip(spark, d):
    return _restored(spark, d, True)


@query("select o_orderkey, o_totalprice from orders where o_custkey = 11 or o_orderpriority = '2-HIGH'")
def prepared_statement(spark, d):
    db = database(spark, d, "orders")
    db.prepare("pick", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = $1 OR o_orderpriority = $2")
    return db.execute("pick", [11, "2-HIGH"])


@query("select * from (values ('nation', 'n_nationkey', 'int4', true), ('nation', 'n_name', 'text', true), ('nation', 'n_regionkey', 'int4', true), ('region', 'r_regionkey', 'int4', true), ('region', 'r_name', 'text', true)) t(relname, attname, typname, attnotnull)")
def catalog_columns(spark, d):
    db = database(spark, d, "region", "nation")
    return db.sql("SELECT relname, attname, typname, attnotnull FROM pg_catalog.pg_attribute JOIN pg_catalog.pg_class ON attrelid = pg_class.oid JOIN pg_catalog.pg_type ON atttypid = pg_type.oid")


@query("select * from (values ('region', 'BASE TABLE'), ('names', 'VIEW')) t(table_name, table_type)")
def catalog_tables(spark, d):
    db = database(spark, d, "region")
    db.sql("CREATE VIEW names AS SELECT r_name FROM region")
    return db.sql("SELECT table_name, table_type FROM information_schema.tables")


@query("select * from (values ('clerk', 'SELECT'), ('desk', 'DELETE'), ('desk', 'INSERT')) t(grantee, privilege_type)")
def catalog_privileges(spark, d):
    db = database(spark, d, "region")
    for text in ("CREATE USER clerk WITH PASSWORD 'secret'", "CREATE ROLE desk", "GRANT desk TO clerk", "GRANT SELECT ON TABLE region TO clerk", "GRANT INSERT, UPDATE, DELETE ON TABLE region TO desk", "REVOKE UPDATE ON TABLE region FROM desk"):
        db.sql(text)
    return db.sql("SELECT grantee, privilege_type FROM table_privileges")


@query("select cast(r_regionkey as bigint) as r_regionkey, r_name from region")
def role_read(spark, d):
    """A user who reads by way of two roles."""
    db = database(spark, d, "region")
    for text in ("CREATE USER clerk WITH PASSWORD 'secret'", "CREATE ROLE low", "CREATE ROLE high", "GRANT low TO high", "GRANT high TO clerk", "GRANT SELECT ON TABLE region TO low", "GRANT CONNECT ON DATABASE postgres TO clerk"):
        db.sql(text)
    return Engine(spark, db.root, user="clerk", password="secret").sql("SELECT * FROM region")


@query("select 'VACUUM complete. Removed ' || (select count(*) from orders where o_orderstatus = 'F') || ' dead tuples.' as message")
def vacuum_report(spark, d):
    db = database(spark, d, "orders")
    db.sql("DELETE FROM orders WHERE o_orderstatus = 'F'")
    return spark.createDataFrame([(db.sql("VACUUM orders"),)], "message string")


@query("select '→ Index Scan using by_customer (hash)' as scan, '  Cost: O(1)' as cost, '  Rows: ~' || greatest(1, count(*) // 10) as estimate from orders")
def explain_report(spark, d):
    db = database(spark, d, "orders")
    db.sql("CREATE INDEX by_customer ON orders USING HASH (o_custkey)")
    lines = db.sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_custkey = 7").split("\n")
    return spark.createDataFrame([tuple(next(x for x in lines if mark in x) for mark in ("Scan", "Cost", "Rows"))], "scan string, cost string, estimate string")


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _refused(db: Engine, text: str) -> str:
    """The class of the error that a statement ends with, or ok."""
    try:
        out = db.sql(text)
        if isinstance(out, DataFrame):
            out.collect()
    except EngineError as e:
        return type(e).__name__
    return "ok"


@query("select * from (values ('by_region', 'nation', '3', false), ('by_name', 'nation', '2 1', true)) t(relname, tablename, indkey, indisunique)")
def catalog_indexes(spark, d):
    db = database(spark, d, "region", "nation")
    db.sql("CREATE INDEX by_region ON nation (n_regionkey)")
    db.sql("CREATE UNIQUE INDEX by_name ON nation USING HASH (n_name, n_nationkey)")
    return db.sql("SELECT i.relname, t.relname AS tablename, indkey, indisunique FROM pg_index JOIN pg_class i ON indexrelid = i.oid JOIN pg_class t ON indrelid = t.oid")


@query("select * from (values ('pg_catalog', 0), ('public', 3)) t(nspname, relations)")
def catalog_namespaces(spark, d):
    db = database(spark, d, "region", "nation")
    db.sql("CREATE VIEW names AS SELECT r_name FROM region")
    return db.sql("SELECT nspname, count(relname) AS relations FROM pg_namespace LEFT JOIN pg_class ON relnamespace = pg_namespace.oid GROUP BY nspname")


@query("select * from (values ('postgres', 'postgres', 'UTF8'), ('shop', 'clerk', 'UTF8')) t(datname, usename, encoding)")
def catalog_databases(spark, d):
    db = Engine(spark, store.workspace(spark))
    for text in ("CREATE USER clerk WITH PASSWORD 'secret'", "CREATE DATABASE shop WITH OWNER clerk", "CREATE DATABASE gone", "DROP DATABASE gone"):
        db.sql(text)
    # members are numbered from 10 on, users first
    return db.sql("SELECT datname, CASE datdba WHEN 10 THEN 'postgres' ELSE 'clerk' END AS usename, encoding FROM pg_database")


@query("select * from (values ('user', 'postgres', true), ('user', 'clerk', false), ('role', 'postgres', true), ('role', 'clerk', false), ('role', 'desk', false), ('role', 'boss', true), ('member', 'clerk', false)) t(kind, name, super)")
def catalog_roles(spark, d):
    db = Engine(spark, store.workspace(spark))
    for text in ("CREATE USER clerk WITH PASSWORD 'secret'", "CREATE USER gone WITH PASSWORD 'x' SUPERUSER", "CREATE ROLE desk", "CREATE ROLE boss SUPERUSER", "GRANT desk TO clerk", "DROP USER gone", "ALTER USER clerk WITH PASSWORD 'other'"):
        db.sql(text)
    return db.sql("""SELECT 'user' AS kind, usename AS name, usesuper AS super FROM pg_user UNION ALL SELECT 'role', rolname, rolsuper FROM pg_roles
        UNION ALL SELECT 'member', usename, admin_option FROM pg_auth_members JOIN pg_user ON member = CASE usename WHEN 'postgres' THEN 10 ELSE 11 END""")


@query("select * from (values ('region', 'r_regionkey', 1, 'NO', 'integer'), ('region', 'r_name', 2, 'NO', 'text'), ('region', 'note', 3, 'YES', 'varchar')) t(table_name, column_name, ordinal_position, is_nullable, data_type)")
def catalog_information_columns(spark, d):
    db = database(spark, d, "region")
    db.sql("ALTER TABLE region ADD COLUMN note VARCHAR(30)")
    return db.sql("SELECT table_name, column_name, ordinal_position, is_nullable, data_type FROM information_schema.columns")


@query("select 'postgres' as who, 'postgres' as db, 'public' as sch, 'UTF8' as enc, true as versioned, true as sized, count(*) as n from region")
def system_functions(spark, d):
    db = database(spark, d, "region")
    return db.sql("SELECT current_user AS who, current_database() AS db, current_schema() AS sch, pg_encoding_to_char(6) AS enc, version() LIKE '% on Spark %' AS versioned, pg_table_size('region') > 0 AS sized, count(*) AS n FROM region")


@query("select * from (values ('select dropped', 'TableNotFound'), ('select old name', 'TableNotFound'), ('select new name', 'ok'), ('select by path', 'TableNotFound'), ('drop again', 'TableNotFound')) t(statement, outcome)")
def drop_and_rename(spark, d):
    """Names that are gone can't be selected, though they were before."""
    db = database(spark, d, "region", "nation")
    for n in ("region", "nation"):
        db.sql(f"SELECT * FROM {n}").collect()
    part = db._manifest()["tables"]["region"]["parts"][0]["name"]
    db.sql("ALTER TABLE nation RENAME TO nations")
    db.sql("DROP TABLE region")
    asked = {"select dropped": "SELECT * FROM region", "select old name": "SELECT * FROM nation", "select new name": "SELECT * FROM nations", "select by path": f"SELECT * FROM parquet.`{db.path}/data/{part}`", "drop again": "DROP TABLE region"}
    return _listed(spark, [(k, _refused(db, v)) for k, v in asked.items()], "statement string, outcome string")


@query("""select * from (values ('select', 'PermissionDenied'), ('through a view', 'PermissionDenied'), ('in a sub-query', 'PermissionDenied'), ('in a with', 'PermissionDenied'), ('by path', 'TableNotFound'),
    ('from another database', 'TableNotFound'), ('insert', 'PermissionDenied'), ('update', 'PermissionDenied'), ('delete', 'PermissionDenied'), ('drop', 'PermissionDenied'), ('granted', 'ok'), ('granted column name', 'ok')) t(statement, outcome)""")
def permissions_refused(spark, d):
    db = database(spark, d, "region", "nation")
    for text in ("CREATE VIEW seen AS SELECT r_name FROM region", "CREATE USER clerk WITH PASSWORD 'secret'", "GRANT CONNECT ON DATABASE postgres TO clerk", "GRANT SELECT ON TABLE nation TO clerk", "CREATE DATABASE shop WITH OWNER clerk"):
        db.sql(text)
    db.sql("SELECT * FROM region").collect()  # what the administrator has read leaves nothing behind
    clerk, shop = Engine(spark, db.root, user="clerk", password="secret"), Engine(spark, db.root, user="clerk", database="shop")
    part = db._manifest()["tables"]["region"]["parts"][0]["name"]
    asked = {
        "select": "SELECT * FROM region", "through a view": "SELECT * FROM seen", "in a sub-query": "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)", "in a with": "WITH x AS (SELECT * FROM region) SELECT * FROM x",
        "by path": f"SELECT * FROM parquet.`{db.path}/data/{part}`", "insert": "INSERT INTO nation VALUES (90, 'X', 1)", "update": "UPDATE region SET r_name = 'X'", "delete": "DELETE FROM region", "drop": "DROP TABLE region",
        "granted": "SELECT * FROM nation", "granted column name": "SELECT n_name AS region FROM nation WHERE n_name <> 'region'",
    }
    return _listed(spark, [*((k, _refused(clerk, v)) for k, v in asked.items()), ("from another database", _refused(shop, "SELECT * FROM region"))], "statement string, outcome string")


@query("select cast(r_regionkey as bigint) as r_regionkey, r_name from region where r_regionkey > 1")
def owner_to(spark, d):
    db = database(spark, d, "region")
    for text in ("CREATE USER clerk WITH PASSWORD 'secret'", "GRANT CONNECT ON DATABASE postgres TO clerk", "ALTER TABLE region OWNER TO clerk"):
        db.sql(text)
    clerk = Engine(spark, db.root, user="clerk", password="secret")
    clerk.sql("DELETE FROM region WHERE r_regionkey <= 1")
    return clerk.sql("SELECT * FROM region")


@query("select * from (values (1, 'it''s', 'kept'), (2, 'a, b', 'kept'), (3, null, 'kept'), (9, 'sad', 'TypeMismatch')) t(id, m, outcome)")
def create_type(spark, d):
    """Values with quotes and commas, over a dump and its restore."""
    db = Engine(spark, store.workspace(spark))
    db.sql("CREATE TYPE mood AS ENUM ('it''s', 'a, b')")
    db.sql("CREATE TABLE t (id INTEGER, m mood)")
    db.sql("INSERT INTO t VALUES (1, 'it''s'), (2, 'a, b'), (3, NULL)")
    db.dump(f"{db.path}/dump")
    db.sql("CREATE DATABASE again")
    again = Engine(spark, db.root, database="again")
    again.restore(f"{db.path}/dump")
    bad = _refused(again, "INSERT INTO t VALUES (9, 'sad')")
    return again.sql("SELECT cast(id AS int) AS id, m, 'kept' AS outcome FROM t").union(_listed(again.spark, [(9, "sad", bad)], "id int, m string, outcome string"))


@query("""select r_name, cast(null as smallint) as a, cast(null as double) as b, cast(null as decimal(10,2)) as c, cast(null as varchar) as v, cast(null as varchar) as e, cast(null as boolean) as f, cast(null as date) as g, cast(null as timestamp) as h, cast(null as bigint) as k from region
    union all select 'NEW', 7, 2.5, 9.99, 'abc', 'xy   ', true, date '2024-01-15', timestamp '2024-01-15 14:30:00', 1""")
def alter_add_types(spark, d):
    db = database(spark, d, "region")
    for c in ("a SMALLINT", "b DOUBLE PRECISION", "c NUMERIC(10,2)", "v VARCHAR(3) UNIQUE", "e CHAR(5)", "f BOOLEAN NOT NULL", "g DATE", "h TIMESTAMP", "k INTEGER REFERENCES region(r_regionkey)"):
        db.sql(f"ALTER TABLE region ADD COLUMN {c}")
    db.sql("INSERT INTO region VALUES (90, 'NEW', 7, 2.5, 9.99, 'abc', 'xy', true, '2024-01-15', '2024-01-15 14:30:00', 1)")
    return db.sql("SELECT r_name, a, b, c, v, e, f, g, h, k FROM region")


@query("select * from (values ('too long', 'TypeMismatch'), ('repeated', 'UniqueViolation'), ('no value', 'NotNullViolation'), ('no parent', 'ForeignKeyViolation'), ('no type', 'TypeMismatch'), ('good', 'ok')) t(row, outcome)")
def alter_add_constraints(spark, d):
    db = database(spark, d, "region")
    for c in ("v VARCHAR(3)", "u INTEGER UNIQUE", "w TEXT NOT NULL", "k INTEGER REFERENCES region(r_regionkey)"):
        db.sql(f"ALTER TABLE region ADD COLUMN {c}")
    db.sql("INSERT INTO region VALUES (50, 'A', 'abc', 1, 'w', 0)")
    asked = {"too long": "(51, 'B', 'abcd', 2, 'w', 0)", "repeated": "(52, 'C', 'abc', 1, 'w', 0)", "no value": "(53, 'D', 'abc', 3, NULL, 0)", "no parent": "(54, 'E', 'abc', 4, 'w', 77)", "good": "(55, 'F', 'abc', 5, 'w', 50)"}
    return _listed(spark, [*((k, _refused(db, f"INSERT INTO region VALUES {v}")) for k, v in asked.items()), ("no type", _refused(db, "ALTER TABLE region ADD COLUMN z NOTYPE"))], "row string, outcome string")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'go where it is, or not' else o_orderpriority end as o_orderpriority from orders")
def update_with_keywords(spark, d):
    """Words of the language inside a text are text."""
    db = Engine(spark, store.workspace(spark))
    db.sql(DDL["orders"].replace("VARCHAR(20)", "TEXT"))
    db.append("orders", table(spark, d, "orders"))
    db.sql("UPDATE orders SET o_orderpriority = 'go where it is, or not' WHERE o_orderstatus = 'F' AND o_orderpriority <> 'set where = 1'")
    return db.sql("SELECT o_orderkey, o_orderpriority FROM orders")


@query("select * from (values ('nation', 'r'), ('kept', 'v')) t(relname, relkind)")
def drop_view_and_index(spark, d):
    db = Engine(spark, store.workspace(spark))
    for text in ("CREATE TABLE nation (n_name TEXT)", "CREATE INDEX by_name ON nation (n_name)", "CREATE VIEW kept AS SELECT n_name FROM nation", "CREATE VIEW gone AS SELECT n_name FROM nation", "DROP VIEW gone", "DROP INDEX by_name"):
        db.sql(text)
    return db.sql("SELECT relname, relkind FROM pg_class")


@query("select * from (values ('table', 'nation', ''), ('table', 'region', ''), ('user', 'clerk', 'no'), ('user', 'postgres', 'yes'), ('database', 'postgres', 'postgres'), ('database', 'shop', 'clerk')) t(kind, name, note)")
def show_listings(spark, d):
    db = database(spark, d, "region", "nation")
    for text in ("CREATE USER clerk WITH PASSWORD 'secret'", "CREATE DATABASE shop WITH OWNER clerk"):
        db.sql(text)
    named = lambda kind, text, name, note: db.sql(text).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), note.alias("note"))
    return named("table", "SHOW TABLES", "Tables", F.lit("")).union(named("user", "SHOW USERS", "username", F.col("superuser"))).union(named("database", "SHOW DATABASES", "name", F.col("owner")))


@query("select * from (values ('writer before commit', 6), ('reader before commit', 5), ('reader after commit', 6), ('reader after rollback', 6)) t(moment, n)")
def read_committed(spark, d):
    db = database(spark, d, "region")
    other, rows = Engine(spark, db.root), []
    count = lambda who: who.sql("SELECT count(*) AS n FROM region").first()[0]
    for text, moment, who in (("BEGIN", None, None), ("INSERT INTO region VALUES (60, 'NEW')", "writer before commit", db), (None, "reader before commit", other), ("COMMIT", "reader after commit", other), ("BEGIN", None, None), ("DELETE FROM region", None, None), ("ROLLBACK", "reader after rollback", other)):
        if text:
            db.sql(text)
        if moment:
            rows.append((moment, count(who)))
    return _listed(spark, rows, "moment string, n int")


@query("select cast(r_regionkey as bigint) as r_regionkey, r_name from region union all select 61, 'COMMITTED'")
def ddl_commits(spark, d):
    """A definition inside a transaction commits what came before it; what comes after can be rolled back."""
    db = database(spark, d, "region")
    for text in ("BEGIN", "INSERT INTO region VALUES (61, 'COMMITTED')", "CREATE TABLE other (id INTEGER)", "INSERT INTO region VALUES (62, 'ROLLED BACK')", "ROLLBACK"):
        db.sql(text)
    return Engine(spark, db.root).sql("SELECT * FROM region")


@query("select o_orderkey, o_custkey from orders where o_custkey between 40 and 60")
def index_btree_range(spark, d):
    db = database(spark, d, "orders")
    db.sql("CREATE INDEX by_customer ON orders (o_custkey, o_orderkey)")  # the parts that are there are laid out anew
    return db.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 40 AND 60")


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority = '5-LOW'")
def index_hash_equal(spark, d):
    db = database(spark, d, "orders")
    db.sql("CREATE INDEX by_priority ON orders USING HASH (o_orderpriority)")
    return db.sql("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW'")


@query("select n_nationkey as nation__n_nationkey, n_name as nation__n_name, n_regionkey as nation__n_regionkey, r_regionkey as region__r_regionkey, r_name as region__r_name from (select cast(n_nationkey as bigint) as n_nationkey, n_name, cast(n_regionkey as bigint) as n_regionkey from nation) n join (select cast(r_regionkey as bigint) as r_regionkey, r_name from region) r on n_regionkey = r_regionkey")
def compat_join_names(spark, d):
    """Under compat a join's columns are named table.column; the dots are underscores here."""
    db = database(spark, d, "region", "nation")
    out = Engine(spark, db.root, compat=True).sql("SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey")
    return out.toDF(*[c.replace(".", "__") for c in out.columns])


@query("select * from (values ('parameter', 1, '$1', 'integer'), ('parameter', 2, '$2', 'text'), ('column', 1, 'o_orderkey', 'bigint'), ('column', 2, 'o_orderpriority', 'string'), ('rows', 1, 'p', (select cast(count(*) as varchar) from orders where o_custkey > 700 and o_orderpriority = '2-HIGH'))) t(kind, position, name, type)")
def describe_statement(spark, d):
    """PARSE, DESCRIBE, BIND, EXECUTE and CLOSE."""
    db = database(spark, d, "orders")
    db.parse("pick", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey > $1 AND o_orderpriority = $2", ["INTEGER"])
    types, columns = db.describe("pick")
    db.bind("p", "pick", [700, "2-HIGH"])
    n = db.run("p").count()
    db.close("pick")
    rows = [("parameter", i, f"${i}", t) for i, t in enumerate(types, 1)] + [("column", i, *c) for i, c in enumerate(columns, 1)]
    return _listed(spark, [*rows, ("rows", 1, "p", str(n))], "kind string, position int, name string, type string")


@query("select r_name from region where r_regionkey <> 2 union all select 'semi;colon'")
def simple_query(spark, d):
    """Several statements in one text: the last one's rows."""
    return database(spark, d, "region").script("INSERT INTO region VALUES (70, 'semi;colon'); DELETE FROM region WHERE r_regionkey = 2; -- a comment; with marks\nSELECT r_name FROM region;")


@query("select * from (values (1, 'INSERT 1'), (2, 'TableNotFound: nope'), (3, 'DELETE 2')) t(line, shown)")
def prompt(spark, d):
    from tessera import __main__ as client

    shown: list[str] = []
    client.run(database(spark, d, "region"), ["INSERT INTO region", "VALUES (80, 'X');", "DROP TABLE nope;", "DELETE FROM region WHERE r_regionkey IN (80, 1);", "\\q"], shown.append)
    return _listed(spark, list(enumerate(shown, 1)), "line int, shown string")


@query("select s from (values ('a\\b_c'), ('a\\bxc')) t(s)")
def like_with_backslashes(spark, d):
    """A backslash in a pattern is a character of its own, here before a wildcard."""
    db = Engine(spark, store.workspace(spark))
    db.sql("CREATE TABLE t (s TEXT)")
    db.append("t", spark.createDataFrame([("a\\b_c",), ("a\\bxc",), ("abxc",), ("a_bxc",)], "s string"))
    return db.sql("SELECT s FROM t WHERE s LIKE 'a\\\\b_c'")


@query("select n_nationkey as k from nation except (select n_nationkey from nation where n_nationkey < 15 except select n_nationkey from nation where n_nationkey < 5)")
def compat_right_chain_rows(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    return compat.right_chain(n.toDF("k"), [("EXCEPT", n.where("n_nationkey < 15")), ("EXCEPT", n.where("n_nationkey < 5"))])
