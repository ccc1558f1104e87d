"""Benchmark decontamination: short test items found inside long documents.

Method: bottom-k MinHash containment search. The MinHash sketch of an item is its k smallest shingle hashes, where k follows from its own size
n and the threshold t: k = n - ceil(t n) + 1. A document that holds at least t of the item's shingles misses at most
n - ceil(t n) of them, so it holds at least one of the sketch: the search loses nothing, however long the document is.
(With a Jaccard-tuned banding a short item in a long document needs thousands of hashes to be found with near
certainty; the containment bound gives certainty with a few.) Items are partitioned by size, by powers of four, and each
class is searched for itself: the largest hash of its sketches is its own limit, and only a document's shingles up to that
limit leave the row for that class. So a class of tiny items, whose sketches reach high, doesn't lift the limit of the
others, which for large items nears the share 1 - t of all shingles. Candidates are then verified by exact containment
over all of the item's distinct shingles. Sketches too large to broadcast meet the shingles by class and hash in a
shuffle, before which Spark's runtime Bloom filters (on by default) drop shingles that no sketch has.

Only DataFrame functions are used. Words are lower-cased runs of letters and digits; a shingle is `width` words; fewer
words are one shingle, so that such an item matches only documents that are that same sequence.

Defined cases: null or empty texts and items have no words and match nothing. Null ids are returned as null ids.
Repeated document rows give repeated result rows; repeated items (same id and text) count once. Items of one id with
several texts are several items. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, pieces, words_of, written

WIDTH, THRESHOLD = 5, 0.8
#: Sketches and items of at most so many bytes on disk are broadcast; larger ones meet the documents in a shuffle.
BROADCAST_BYTES = 32 << 20
#: Documents for each file of a table of those that are found.
ROWS = 1_000_000


def shingle_hashes(text, width: int = WIDTH):
    """Hashes of the distinct word shingles of a text, as a column."""
    words = F.transform(words_of(text), lambda w: F.xxhash64(w))
    several = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    # the words are bound once, by a lambda of their own
    return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) >= width, several(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))))


def items_of(benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item_id, n, class, hashes sorted, sketch) of every item that has words."""
    h = F.array_sort(F.array_distinct(shingle_hashes(F.col(text_col), width)))
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.xxhash64(text_col).alias("text_key"), h.alias("hashes")).distinct()
    n = F.size("hashes")
    return items.where(n > 0).select(
        F.xxhash64(F.coalesce(F.col("item_id"), F.lit(-1)), "text_key").alias("key"), "item_id", n.alias("n"),
        F.floor(F.log2(n) / 2).cast("int").alias("class"), "hashes", F.slice("hashes", 1, n - F.ceil(n * threshold - 1e-9).cast("int") + 1).alias("sketch"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for each pair at or above the threshold."""
    items = written(items_of(benchmark, threshold, width), "items", pieces(benchmark.count(), 10_000, 4))
    limits = items.select("class", F.array_max("sketch").alias("top")).groupBy("class").agg(F.max("top").alias("top")).orderBy("class").collect()  # 16 rows at most
    small = _bytes(items) <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda x: x)
    sketch = items.select("class", F.explode("sketch").alias("h"))
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    low = row.select("doc_id", F.xxhash64("text").alias("text_key"), F.length("text").alias("len"), F.inline(_below(shingle_hashes(F.col("text"), width), limits)))
    # candidates: the distinct texts that share a sketch value with some item
    hit = low.join(hint(sketch.distinct()), ["class", "h"], "left_semi").select("text_key", "len").distinct()
    files = pieces(docs.count(), ROWS, 8)
    hit = written(hit, "hits", files)
    texts = row.withColumn("text_key", F.xxhash64("text")).withColumn("len", F.length("text"))
    on_hit = F.broadcast if _bytes(hit) <= BROADCAST_BYTES else (lambda x: x)
    found = texts.join(on_hit(hit), ["text_key", "len"], "left_semi")
    parts = items.select("key", F.explode("hashes").alias("h"))
    # what all candidates hold of the items, counted for each distinct text
    once = found.groupBy("text_key", "len").agg(F.min("text").alias("text"))
    share = once.select("text_key", "len", F.explode(F.array_distinct(shingle_hashes(F.col("text"), width))).alias("h")).join(hint(parts), "h").groupBy("text_key", "len", "key").agg(F.count(F.lit(1)).alias("shared"))
    full = share.join(hint(items.select("key", "item_id", "n")), "key").where(F.col("shared") >= F.ceil(F.col("n") * threshold - 1e-9))
    ids = found.select("doc_id", "text_key", "len")
    return ids.join(full, ["text_key", "len"]).select("doc_id", "item_id", "shared", F.col("n").cast("long").alias("item_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def _below(hashes, limits):
    """The hashes that each class has to be asked for, as an array of (class, h)."""
    def of(hs, size, top):
        return F.transform(F.filter(hs, lambda h: h <= F.lit(top).cast("long")), lambda h: F.struct(F.lit(size).alias("class"), h.alias("h")))

    def probe(hs):
        none = F.array().cast("array<struct<class:int,h:bigint>>")
        return F.flatten(F.array(none, *[of(hs, r["class"], r["top"]) for r in limits]))

    return F.flatten(F.transform(F.array(hashes), probe))


def _bytes(df: DataFrame) -> int:
    """Upper bound of a written table's size: its files' bytes, times 8 for what compression may hide."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) * 8


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """docs without the rows whose text holds an item. Judged by text, so rows with null doc_id are judged too."""
    key = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), "text")
    bad = written(contaminated(key, benchmark, threshold, width).select(F.col("doc_id").alias(f"{OWN}key")).distinct(), "contaminated", pieces(docs.count(), ROWS, 8))
    hint = F.broadcast if _bytes(bad) <= BROADCAST_BYTES else (lambda x: x)
    return docs.join(hint(bad), F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad[f"{OWN}key"], "left_anti")


#: DuckDB: exact containment of five-word shingles, over all pairs that share a shingle.
SQL = """
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w, row_number() over () as k from documents),
b as (select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w, text from benchmark),
ds as (select distinct doc_id, k, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end) as s from d),
bs as (select distinct item_id, text, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end) as s from b),
n as (select item_id, text, count(*) as n from bs group by all)
select doc_id, item_id, shared, n as item_shingles, shared / n as containment
from (select ds.doc_id, ds.k, bs.item_id, bs.text, count(*) as shared from ds join bs using (s) group by all) x join n using (item_id, text)
where shared >= ceil(n * 0.8 - 1e-9)
"""
