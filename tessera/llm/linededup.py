"""Line dedup: lines that are spread over many sites are boilerplate.

Method: distinct-site spread. For each line (by hash) a HyperLogLog sketch of the sites it occurs on is built; sketches
merge by aggregation, on the map side first. Where the estimate is clear of the threshold by BAND it decides; near
the threshold the line's distinct sites are counted exactly. A line at or over the threshold is removed wherever it
stands, but for the document with the smallest doc_id that has it, so no content is lost to the corpus.

Lines are cut at line feeds and compared without surrounding blanks. Lines of fewer than `min_words` words (five
by the oracle's rule) stay, however many sites they are on, and blank lines always do. Only DataFrame functions are used. Line hashes have 96 bits.

Defined cases: a null text stays null; a null source is no site; lines with null doc_id count, and are never the kept
ones. Repeated rows are returned as often as they come, each cleaned alike. A document of boilerplate only gets an
empty text. Empty tables give empty results. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, pieces, written

MIN_SITES, MIN_WORDS = 5, 5
#: Lines of the corpus for each file of a table of lines that repeat.
LINES = 1_000_000
#: Sketches of 2**LG_K registers; estimates this far from the threshold, as a share of it or in sites, are trusted.
LG_K, BAND, BAND_SITES = 12, 0.15, 2
_BLANKS = " \t\r\f\x0b"


def _rowkey():
    """128 bits: a row is known by its doc_id and text, so that repeated rows and null ids need no numbering."""
    key = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), F.col("text"))
    return F.struct(F.xxhash64(*key).alias("x"), F.xxhash64(F.lit("again"), *key).alias("y"))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, doc_id, source, pos, h, c): the lines that may be removed, by hash."""
    each = docs.select(_rowkey().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.withColumn("line", F.btrim("line", F.lit(_BLANKS)))
    enough = F.size(F.split("line", r"[ \t\r\f\x0b]+")) >= min_words
    return each.where(enough & (F.col("line") != "")).select("row", "doc_id", "source", "pos", F.xxhash64("line").alias("h"), F.hash("line", F.lit(3)).alias("c"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, c, first): the lines on at least min_sites sites, and the smallest doc_id that has them."""
    # a line on so many sites occurs at least as often: most lines occur once and need no sketch
    often = lines.where("source is not null").groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h", "c")
    files = pieces(lines.count(), LINES, 8)
    often = written(lines.join(written(often, "often", files), ["h", "c"]), "oftenlines", files)
    spread = written(often.groupBy("h", "c").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", LG_K)).alias("sites"), F.min("doc_id").alias("first")), "spread", files)
    band = max(BAND * min_sites, BAND_SITES)
    sure = spread.where(F.col("sites") > min_sites + band).select("h", "c", "first")
    near = spread.where(F.col("sites").between(min_sites - band, min_sites + band))
    exact = often.where("source is not null").join(near.select("h", "c"), ["h", "c"]).groupBy("h", "c").agg(F.countDistinct("source").alias("exact")).where(F.col("exact") >= min_sites)
    return sure.unionByName(near.join(exact, ["h", "c"]).select("h", "c", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with boilerplate lines cut from text; the number of lines cut is added as lines_removed (long)."""
    lines = written(_lines(docs, min_words), "lines")
    files = pieces(lines.count(), LINES, 8)
    found = written(boilerplate(lines, min_sites), "boilerplate", files)
    cut = lines.join(found, ["h", "c"]).where("doc_id is null or first is null or doc_id <> first")
    cut = written(cut.groupBy("row").agg(F.collect_set("pos").alias(f"{OWN}cut")).withColumnRenamed("row", f"{OWN}row"), "cut", files)
    # a merge join at every size: the documents that lose lines grow with the corpus, so they are never broadcast
    out = docs.withColumn(f"{OWN}key", _rowkey()).join(cut.hint("merge"), F.col(f"{OWN}key") == F.col(f"{OWN}row"), "left")
    # the positions that stay, by a hash set, and then their lines: linear in the text's lines, however many are cut
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"{OWN}cut")), lambda p: F.get(lines, p))
    left = F.array_join(F.get(F.transform(F.array(F.split("text", "\n")), stay), 0), "\n")
    columns = [c for c in docs.columns if c.lower() != "lines_removed"]
    text = F.when(F.col(f"{OWN}cut").isNull(), F.col("text")).otherwise(left)
    removed = F.coalesce(F.when(F.col(f"{OWN}cut").isNotNull(), F.size(f"{OWN}cut")), F.lit(0)).cast("long")
    return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns], removed.alias("lines_removed"))


#: DuckDB: exact counts of distinct sites, by the line itself.
SQL = f"""
with l as (
  select doc_id, source, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) as line, line as raw, pos
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents)),
b as (select line, min(doc_id) as first from l where len(regexp_split_to_array(line, '[ \\t\\r\\f\\x0b]+')) >= {MIN_WORDS} group by line having count(distinct source) >= {MIN_SITES}),
k as (select l.doc_id, l.pos, l.raw, b.first is not null and b.first <> l.doc_id as cut from l left join b using (line)),
t as (select doc_id, coalesce(string_agg(raw, chr(10) order by pos) filter (where not cut), '') as text, count(*) filter (where cut) as n from k group by doc_id)
select d.doc_id, t.text, coalesce(t.n, 0) as lines_removed from documents d left join t using (doc_id)
"""
