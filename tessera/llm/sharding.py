"""Sharding along a Hilbert curve.

Method: three metadata dimensions are quantised to 16 steps each (language, source, and size by powers of two, where all
sizes from 32 KB on are one step), the
4096 cells are numbered by their place on the Hilbert curve, rows are ordered by that number, and the order is cut
into runs. A run covers a compact box of the metadata space, so a file's least and greatest values of any of the
dimensions let a reader skip it: limits() gives them, and fitting() the shards that a reader has to open.

The order is total without sorting everything in one place: rows are counted by unit (a cell, or an equal part of a
cell that holds many rows, dealt by a hash of doc_id and text), the units' offsets are added up over that small table, and rows
are numbered within units. Units are sized as a fixed share of the table, so no key gathers in one task. Rows that are equal in
all that is returned are counted, numbered as one row, and dealt out again, in blocks of COPIES, after that.

Only DataFrame functions are used. Law `rows`: shard sizes in rows differ by at most one. Law `bytes`: runs are cut at
equal sums of size, so shards differ by less than the largest row.

Defined cases: null text has size 1 and CRC of the empty text; null or unseen lang and source are values like others;
null doc_id sorts first; repeated rows take slots of their own. Fewer rows than shards leave shards empty. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 4
#: A unit holds at most about this share of all rows, and never more than UNIT_ROWS.
UNIT_SHARE, UNIT_ROWS = 2048, 65536
#: Equal rows that one row is made into at a time.
COPIES = 65536


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of an integer point on the Hilbert curve (the transposed Gray-code construction)."""
    x, top = list(point), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (((v ^ t) >> b) & 1)
    return out


def curve_table(dims: int, bits: int = BITS) -> list[int]:
    """Curve index by cell code, where the first dimension has the code's highest bits."""
    side = 1 << bits
    return [hilbert_index(tuple((c >> (bits * (dims - 1 - d))) & (side - 1) for d in range(dims)), bits) for c in range(side**dims)]


def _step(value):
    """A text value's step of 16: the first hex digit of its MD5. Null has the step of the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 8, law: str = "rows") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law}")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    code = F.shiftleft(_step(F.col("lang")), 2 * BITS) + F.shiftleft(_step(F.col("source")), BITS) + F.least(F.lit(15), F.floor(F.log2(size.cast("double"))).cast("int"))
    curve = F.element_at(F.lit(curve_table(3)), code.cast("int") + 1)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    # by the text as well, so that rows of one doc_id, or of none, are dealt over units too
    salt = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), crc.cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")
    keys = ("doc_id", "size", "text_crc32", "curve", "salt")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), curve.cast("int").alias("curve"), salt.alias("salt"))
    rows = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")), "sizes")
    cells = rows.groupBy("curve").agg(F.sum("copies").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    cells = cells.select("curve", F.ceil(F.col("n") / F.least(F.lit(UNIT_ROWS), F.greatest(F.lit(1), F.floor(total / UNIT_SHARE)))).cast("long").alias("parts"))  # 4096 rows at most
    rows = rows.join(F.broadcast(cells), "curve").withColumn("part", F.pmod("salt", "parts"))
    weight = F.col("size") * F.col("copies")
    units = written(rows.groupBy("curve", "part").agg(F.sum("copies").alias("n"), F.sum(weight).alias("bytes")), "units")
    before = Window.orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)
    # the units are few (4096 cells, and one more for each UNIT_SHARE-th of the rows): one task adds them up
    units = units.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.sum("n").over(Window.partitionBy()).alias("all_rows"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    w = Window.partitionBy("curve", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("doc_id", "size", "text_crc32", "curve", "part", "copies", F.coalesce(F.sum("copies").over(w), F.lit(0)).alias("k0"), F.coalesce(F.sum(weight).over(w), F.lit(0)).alias("b0")).join(units, ["curve", "part"])
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))))
    if not rows.where(F.col("copies") > COPIES).isEmpty():
        placed = placed.repartition("curve", "part", "doc_id", "block")
    placed = placed.withColumn("i", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1)))
    placed = placed.withColumn("k", F.col("k0") + F.col("i") + 1)
    rank, first = F.col("row0") + F.col("k") - 1, F.col("byte0") + F.col("b0") + F.col("i") * F.col("size")
    s = F.lit(shards).cast("long")
    if law == "rows":
        placed = placed.withColumn("shard", F.expr(f"((row0 + k) * {shards} - 1) div all_rows").cast("int")).withColumn("rank", rank)
        return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("rank") - F.floor(F.col("shard") * F.col("all_rows") / s)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor((first + F.col("size") / 2) * s / F.col("all_bytes"))).cast("int")).withColumn("rank", rank)
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "rank", "curve"), "placed")
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("rank") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


_NAMES = ("lang_step", "source_step", "size_step")


def limits(placed: DataFrame) -> DataFrame:
    """(shard, rows, and the least and greatest step of each dimension in the shard), from what hilbert_shards() gives."""
    cell = [0] * (1 << 3 * BITS)
    for code, at in enumerate(curve_table(3)):
        cell[at] = code
    code = F.element_at(F.lit(cell), F.col("curve") + 1)
    steps = {n: F.shiftright(code, BITS * (2 - i)).bitwiseAND(F.lit((1 << BITS) - 1)) for i, n in enumerate(_NAMES)}
    few = placed.groupBy("shard", "curve").agg(F.count(F.lit(1)).alias("n")).withColumns(steps)
    return few.groupBy("shard").agg(F.sum("n").alias("rows"), *[f(n).alias(f"{n}_{m}") for n in _NAMES for m, f in (("min", F.min), ("max", F.max))])


def fitting(table: DataFrame, lang: str | None = None, source: str | None = None, size: int | None = None) -> DataFrame:
    """The rows of limits() whose shards may hold documents of a language, a source and a size; None asks for all."""
    asked = zip(_NAMES, (lang, source, size), (_step(F.lit(lang)), _step(F.lit(source)), F.lit(min(15, int(size).bit_length() - 1) if size else 0)))
    for n, value, step in asked:
        if value is not None:
            table = table.where(step.between(F.col(f"{n}_min"), F.col(f"{n}_max")))
    return table
