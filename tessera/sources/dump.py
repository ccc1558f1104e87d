"""Dump and restore of a database: a folder with its definitions as SQL, and its rows as SQL or as Parquet.

Rows of each table are written by the executors, and read back by them: in SQL form, each line is one INSERT, whose
literals are taken apart where the line is read. Only definitions pass through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from tessera.errors import ParseError
from tessera.sources import store

# A literal of a dumped row: a quoted text, bytes in hexadecimal, or a word or number.
_LITERAL = re.compile(r"X'([0-9A-F]*)'|'((?:[^'\\]|''|\\.)*)'|([^,' ][^,']*)", re.S)
_ESCAPE = re.compile(r"''|\\(.)", re.S)


def statements(text: str) -> Iterator[str]:
    """Split at semicolons outside quotes; lines that start with two dashes outside quotes are comments."""
    start, quoted, i = 0, False, 0
    out: list[str] = []
    while i < len(text):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted and text.startswith("--", i):
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            out.append(text[start:i])
            start = i = end
            continue
        elif not quoted and c == ";":
            out.append(text[start:i])
            if s := "".join(out).strip():
                yield s
            out, start = [], i + 1
        i += 1
    if s := "".join([*out, text[start:]]).strip():
        yield s


def _in_order(tables: dict) -> list[str]:
    """Tables after those that they refer to."""
    done: list[str] = []

    def put(n: str, above: tuple = ()) -> None:
        for c in tables[n]["columns"]:
            if c["fk"] and c["fk"][0] in tables and c["fk"][0] not in (*above, n):
                put(c["fk"][0], (*above, n))
        if n not in done:
            done.append(n)

    for n in sorted(tables):
        put(n)
    return done


def _quoted(v: str) -> str:
    doubled = v.replace("'", "''")
    return f"'{doubled}'"


def values_of(line: str, head: str) -> list[str | None]:
    """The values of one dumped INSERT as texts; bytes as hexadecimal digits."""
    if not line.startswith(head) or not line.endswith(");"):
        raise ParseError(line[:100])
    out, at, end = [], len(head), len(line) - 2
    while at < end:
        m = _LITERAL.match(line, at, end)
        if not m:
            raise ParseError(line[:100])
        plain = m[2] is not None and _ESCAPE.sub(lambda e: "'" if e[1] is None else {"n": "\n", "r": "\r"}.get(e[1], e[1]), m[2])
        out.append(m[1] if m[1] is not None else plain if m[2] is not None else None if m[3] == "NULL" else m[3])
        at = m.end()
        if at < end:
            if not line.startswith(", ", at):
                raise ParseError(line[:100])
            at += 2
    return out


def _rows(spark, path: str, columns: list[dict]):
    """The rows of a table's dump in SQL form, by the dump's columns, and these columns' names; None for a table without rows."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        return None
    head, mark, _ = first["value"].partition(") VALUES (")
    if not mark:
        raise ParseError(first["value"][:100])
    names, head = [n.strip() for n in head.partition("(")[2].split(",")], head + mark
    kinds = {c["name"]: c["spark"] for c in columns}

    @F.pandas_udf("array<string>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([values_of(x, head) for x in s], dtype=object)

    parts = lines.select(values("value").alias("v"))
    return parts.select(*[(F.unhex(F.get("v", i)) if kinds.get(n) == "binary" else F.get("v", i)).alias(f"c{i}") for i, n in enumerate(names)]), names


def definitions(m: dict) -> Iterator[str]:
    for n, values in m["types"].items():
        yield f"CREATE TYPE {n} AS ENUM ({', '.join(_quoted(v) for v in values)})"
    for n in _in_order(m["tables"]):
        cols = []
        for c in m["tables"][n]["columns"]:
            size = f"({c['len']})" if c["len"] else c["spark"][7:] if c["spark"].startswith("decimal") else ""
            flags = "" if c["serial"] else " PRIMARY KEY" if c["pk"] else (" UNIQUE" if c["unique"] else "") + ("" if c["null"] else " NOT NULL")
            cols.append(f"{c['name']} {c['type'].upper() if c['type'] not in m['types'] else c['type']}{size}{flags}" + (f" REFERENCES {c['fk'][0]}({c['fk'][1]})" if c["fk"] else ""))
        yield f"CREATE TABLE {n} ({', '.join(cols)})"
    for n, i in sorted(m["indexes"].items()):
        yield f"CREATE {'UNIQUE ' if i['unique'] else ''}INDEX {n} ON {i['table']} USING {i['method'].upper()} ({', '.join(i['columns'])})"
    for n, body in m["views"].items():
        yield f"CREATE VIEW {n} AS {body}"


def _literal(c: dict):
    """A column's values as SQL literals. Quotes are doubled; line ends are escaped, so that a row is a line."""
    col, kind = F.col(f"`{c['name']}`"), c["spark"]
    if kind == "binary":
        text = F.concat(F.lit("X'"), F.hex(col), F.lit("'"))
    elif kind in ("string", "date") or kind.startswith("timestamp") or kind == "double":
        plain = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), [("\\", "\\\\"), ("'", "''"), ("\n", "\\n"), ("\r", "\\r")], col.cast("string"))
        text = F.concat(F.lit("'"), plain, F.lit("'"))
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def dump(engine, path: str, schema_only: bool, data_only: bool, binary: bool) -> str:
    m = engine._manifest()
    names = _in_order(m["tables"])
    if not data_only:
        store.write_text(engine.spark, f"{path}/schema.sql", "".join(f"{s};\n" for s in definitions(m)))
    if not schema_only:
        for i, n in enumerate(names):
            meta = m["tables"][n]
            df, to = engine._frame(meta), f"{path}/data/{i:04d}-{n}"
            if binary:
                df.write.parquet(f"{to}.parquet")
            else:
                head = f"INSERT INTO {n} ({', '.join(df.columns)}) VALUES ("
                df.select(F.concat(F.lit(head), F.concat_ws(", ", *map(_literal, meta["columns"])), F.lit(");")).alias("value")).write.text(f"{to}.sql")
    return f"DUMP {len(names)}"


def restore(engine, path: str, dry_run: bool) -> str:
    """Run a dump's definitions and load its rows; dry, only tell how many statements and tables there are."""
    defined = list(statements(store.read_text(engine.spark, f"{path}/schema.sql") or ""))
    data = sorted(store.names(engine.spark, f"{path}/data"))
    if dry_run:
        return f"RESTORE {len(defined)} definitions, {len(data)} tables (dry run)"
    late = [s for s in defined if s.startswith(("CREATE UNIQUE", "CREATE INDEX", "CREATE VIEW"))]
    for s in defined:
        if s not in late:
            engine.sql(s)
    for folder in data:
        name = folder.partition("-")[2].rpartition(".")[0]
        if folder.endswith(".parquet"):
            engine.append(name, engine.spark.read.parquet(f"{path}/data/{folder}"))
            continue
        if found := _rows(engine.spark, f"{path}/data/{folder}", engine._meta(engine._manifest(), name)["columns"]):
            engine.append(name, *found)
    for s in late:
        engine.sql(s)
    return f"RESTORE {len(defined)} definitions, {len(data)} tables"
