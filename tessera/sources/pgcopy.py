"""Binary COPY files: a header, rows of length-prefixed fields in network byte order, and a trailer.

Each chunk of rows becomes a file of its own that is valid alone, so both directions run on all executors. Spark's text
sink takes each chunk as a row; the trailer is its line separator. A file is decoded in one piece by one task, so
files of other writers should stay under Spark's limit for one binary value (2 GB).
"""

from __future__ import annotations

import datetime as dt
import struct
import uuid
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's signature and epoch.
SIGNATURE = b"PGCOPY\n\xff\r\n\0"
EPOCH = dt.datetime(2000, 1, 1)
HEADER = SIGNATURE + struct.pack(">ii", 0, 0)
TRAILER = b"\xff\xff"
CHUNK = 50_000
_MICRO = dt.timedelta(microseconds=1)


def numeric(d: Decimal) -> bytes:
    """Groups of four decimal digits, the first one's power of 10000, the sign, and the digits after the point."""
    sign, digits, exponent = d.as_tuple()
    scale = max(0, -exponent)
    text = "".join(map(str, digits)) + "0" * max(0, exponent)
    whole, part = (text[:-scale] or "0", text[-scale:].rjust(scale, "0")) if scale else (text, "")
    whole = whole.zfill(-(-len(whole) // 4) * 4)
    part = part.ljust(-(-len(part) // 4) * 4, "0")
    groups = [int((whole + part)[i : i + 4]) for i in range(0, len(whole + part), 4)]
    weight = len(whole) // 4 - 1
    while groups and groups[0] == 0:
        groups.pop(0)
        weight -= 1
    while groups and groups[-1] == 0:
        groups.pop()
    return struct.pack(f">hhHH{len(groups)}h", len(groups), weight if groups else 0, 0x4000 if sign and groups else 0, scale, *groups)


def from_numeric(b: bytes) -> Decimal:
    n, weight, sign, scale = struct.unpack_from(">hhHH", b)
    if sign == 0xC000:
        return Decimal("NaN")
    total = sum(g * Decimal(10000) ** (weight - i) for i, g in enumerate(struct.unpack_from(f">{n}h", b, 8)))
    return (-total if sign == 0x4000 else Decimal(total)).quantize(Decimal(1).scaleb(-scale))


def _day(v) -> dt.datetime:
    return v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)


def encode(kind: str, v) -> bytes:
    """One value's field of a Spark type, or of SQL's uuid."""
    if kind == "smallint":
        return struct.pack(">h", v)
    if kind == "bigint":
        return struct.pack(">q", v)
    if kind == "double":
        return struct.pack(">d", v)
    if kind == "boolean":
        return b"\1" if v else b"\0"
    if kind == "date":
        return struct.pack(">i", (_day(v) - EPOCH).days)
    if kind.startswith("timestamp"):
        return struct.pack(">q", (v - EPOCH) // _MICRO)
    if kind.startswith("decimal"):
        return numeric(v)
    if kind == "uuid":
        return uuid.UUID(v).bytes
    return bytes(v) if kind == "binary" else v.encode()


def decode(kind: str, b: bytes):
    if kind in ("smallint", "bigint"):
        return int.from_bytes(b, "big", signed=True)
    if kind == "double":
        return struct.unpack(">f" if len(b) == 4 else ">d", b)[0]
    if kind == "boolean":
        return b != b"\0"
    if kind == "date":
        return EPOCH.date() + dt.timedelta(days=struct.unpack(">i", b)[0])
    if kind.startswith("timestamp"):
        return EPOCH + struct.unpack(">q", b)[0] * _MICRO
    if kind.startswith("decimal"):
        return from_numeric(b)
    if kind == "uuid":
        return str(uuid.UUID(bytes=b))
    return b if kind == "binary" else b.decode()


def rows_of(data: bytes, kinds: list[str]) -> Iterator[list]:
    if data[:11] != SIGNATURE:
        raise ValueError("not a binary COPY file")
    at = 19 + struct.unpack_from(">i", data, 15)[0]
    while True:
        n = struct.unpack_from(">h", data, at)[0]
        at += 2
        if n == -1:
            return
        if n != len(kinds):
            raise ValueError(f"{n} fields, {len(kinds)} columns")
        row = []
        for kind in kinds:
            size = struct.unpack_from(">i", data, at)[0]
            at += 4
            row.append(None if size < 0 else decode(kind, data[at : at + size]))
            at += max(0, size)
        yield row


def _plain(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Timestamps as naive UTC ones, which is what the format keeps, and all names by position."""
    return df.select(*[_naive(F.col(f"`{c}`"), k).alias(f"f{i}") for i, (c, k) in enumerate(zip(df.columns, kinds))])


def _naive(col, kind: str):
    if kind == "timestamp":
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))
    return col.cast("string" if kind == "uuid" else kind)


def write(df: DataFrame, kinds: list[str], path: str) -> None:
    body = _plain(df, kinds).mapInArrow(_by_row(kinds), "value binary")
    body.select(F.expr("cast(value as string)").alias("value")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", "\u00ff\u00ff").text(path)


def _by_row(kinds: list[str]):
    count = struct.pack(">h", len(kinds))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part, out = b.slice(at, CHUNK), [HEADER]
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    out.append(count)
                    for kind, v in zip(kinds, row):
                        f = None if v is None else encode(kind, v)
                        out += [b"\xff\xff\xff\xff"] if f is None else [struct.pack(">i", len(f)), f]
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])

    return run


def read(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    shown = ["timestamp_ntz" if k.startswith("timestamp") else "string" if k == "uuid" else k for k in kinds]
    schema = ", ".join(f"f{i} {k}" for i, k in enumerate(shown))
    arrow = {"smallint": pa.int16(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string(), "binary": pa.binary()}
    types = [pa.decimal128(*map(int, k[8:-1].split(","))) if k.startswith("decimal") else arrow[k] for k in shown]

    def run(batches):
        for b in batches:
            for data in b.column(0):
                held = []
                for row in rows_of(data.as_py(), kinds):
                    held.append(row)
                    if len(held) == CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=[f"f{i}" for i in range(len(types))])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=[f"f{i}" for i in range(len(types))])

    local = lambda c: F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp")
    out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
    return out.select(*[(local(f"f{i}") if k == "timestamp" else F.col(f"f{i}")).alias(f"f{i}") for i, k in enumerate(kinds)])
