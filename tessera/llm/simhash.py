"""SimHash near-dedup: 64-bit fingerprints, compared exactly in tiles.

Method: tiled exact comparison with numpy exclusive-or and bit counts. Distinct fingerprints are grouped into
tiles by population count (a class that is too large is cut into several tiles by a hash); two tiles are compared
only if their counts differ by at most the radius, as fingerprints further apart in count cannot be within it.
Inside a pair of tiles the same bound is applied to runs of rows, by the counts of the four 16-bit parts.

A pair of tiles gives a spanning forest of its links, never all pairs; copies of one fingerprint are one row there.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and is linked like any other.
Fewer words than the shingle's width: the whole sequence is the one shingle. Repeated rows are returned as often as
they come. A row with null doc_id keeps its fingerprint; its component is the smallest doc_id of those it links to,
null if there is none. An empty table gives an empty result. Other columns of the input, whatever their names, are not
read by fingerprints(); keep_one() returns them untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, lean_batches, pieces, written
from .components import components

SEED = 42
#: Fingerprints in a tile at most on average; two tiles are what a task holds.
TILE = 16384
#: Rows of a run; runs that one run is compared with at once; links that are held before they are made a forest. These
#: three bound a task's memory beside its two tiles, however near the fingerprints are.
_RUN, _SPAN, _HELD = 256, 16, 250_000
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _words(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, PIECE bytes at a time; a piece ends at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            m = _BLANK.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end].split()
        at = end


def fingerprint(text: str | bytes | None, width: int = 4) -> int:
    """Bit i is set if more than half of the shingles' XXH64 (seed 42) have it set. Only A-Z are lower-cased."""
    raw = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower()
    counts, n, before = np.zeros(64, np.int64), 0, []
    for words in _words(raw):
        words = before + words
        if len(words) >= width:
            n += len(words) - width + 1
            counts += _counts(words, width)
            before = words[len(words) - width + 1 :]
        else:
            before = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _counts(words: list[bytes], width: int) -> np.ndarray:
    """By bit, how many of the words' shingles have it set."""
    n, flat = len(words) - width + 1, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)
    lanes = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 600:
        return np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(lanes[:, j], minlength=256) @ _BITS for j in range(8)])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long): the fingerprint's 64 bits as a signed long."""

    lean_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def fp(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in texts:
            yield pa.array(np.array([fingerprint(t.as_py(), width) for t in s], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fp(F.col(text_col).cast("binary")).alias("fp"))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between nodes 0..n-1: (node, root) for nodes that are not their own root."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _runs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows, and the least and greatest bit counts of the 16-bit parts of each run of _RUN rows."""
    parts = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(parts.T)
    parts = parts[order]
    at = np.arange(0, len(fp), _RUN)
    return order, np.minimum.reduceat(parts, at), np.maximum.reduceat(parts, at)


def tile_links(fa: np.ndarray, fb: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within tile fa (fb None), or between fa and fb, as positions in fa followed by fb."""
    oa, lo_a, hi_a = _runs(fa)
    ob, lo_b, hi_b = (oa, lo_a, hi_a) if fb is None else _runs(fb)
    a, b = fa[oa], (fa if fb is None else fb)[ob]
    shift, n = (0, len(fa)) if fb is None else (len(fa), len(fa) + len(fb))
    node, root = np.empty(0, np.int64), np.empty(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for i in range(len(lo_a)):
        gap = np.maximum(0, np.maximum(lo_b - hi_a[i], lo_a[i] - hi_b)).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if fb is None:
            near = near[near >= i]
        if not len(near):
            continue
        rows = np.arange(i * _RUN, min(len(a), (i + 1) * _RUN))
        for at in range(0, len(near), _SPAN):
            cols = (near[at : at + _SPAN, None] * _RUN + np.arange(_RUN)).ravel()
            cols = cols[cols < len(b)]
            x, y = np.nonzero(np.bitwise_count(a[rows][:, None] ^ b[cols][None, :]) <= radius)
            if len(x):
                found.append((oa[rows[x]], ob[cols[y]] + shift))
                held += len(x)
            if held > _HELD:  # large groups: keep a forest of what has been found, not the pairs
                node, root = _forest(np.concatenate([node, *(f[0] for f in found)]), np.concatenate([root, *(f[1] for f in found)]), n)
                found, held = [], 0
    return _forest(np.concatenate([node, *(f[0] for f in found)]), np.concatenate([root, *(f[1] for f in found)]), n)


def links(reps: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """reps (fp long, node long), one row for each distinct fingerprint, n rows -> edges (a, b) that span every
    group of fingerprints linked at `radius` or fewer differing bits."""
    ones = F.bit_count("fp").cast("int")
    classes = reps.groupBy(ones.alias("ones")).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("cut"))  # 65 rows at most
    tiles = (
        reps.withColumn("ones", ones).join(F.broadcast(classes), "ones")
        .groupBy("ones", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("cut")).cast("int").alias("sub"))
        .agg(F.collect_list(F.struct("fp", "node")).alias("rows"))
        .select("ones", "sub", F.col("rows.fp").alias("fps"), F.col("rows.node").alias("nodes"))
    )
    tiles = written(tiles, "tiles", pieces(n, TILE, 12))
    # each tile of the class once for each class within the radius above it: tiles meet tiles, not rows rows
    left = tiles.select(F.col("ones").alias("a_ones"), F.col("sub").alias("a_sub"), F.explode(F.sequence(F.col("ones"), F.col("ones") + radius)).alias("meets"))
    right = tiles.select(F.col("ones").alias("meets"), F.col("sub").alias("b_sub"))
    pairs = left.join(right, "meets").where("meets > a_ones or b_sub >= a_sub")
    a = tiles.select(F.col("ones").alias("a_ones"), F.col("sub").alias("a_sub"), F.col("fps").alias("a_fps"), F.col("nodes").alias("a_nodes"))
    b = tiles.select(F.col("ones").alias("meets"), F.col("sub").alias("b_sub"), F.col("fps").alias("b_fps"), F.col("nodes").alias("b_nodes"))
    same = (F.col("meets") == F.col("a_ones")) & (F.col("b_sub") == F.col("a_sub"))
    full = pairs.join(a, ["a_ones", "a_sub"]).join(b, ["meets", "b_sub"]).select(same.alias("same"), "a_fps", "a_nodes", F.when(~same, F.col("b_fps")).alias("b_fps"), F.when(~same, F.col("b_nodes")).alias("b_nodes"))
    full = full.repartition(pieces(n, TILE // 8, 12))

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                same, fa, na, fb, nb = (c[i] for c in batch.columns)
                ids = na.values.to_numpy()
                fpa, fpb = fa.values.to_numpy().view(np.uint64), None
                if not same.as_py():
                    ids, fpb = np.concatenate([ids, nb.values.to_numpy()]), fb.values.to_numpy().view(np.uint64)
                x, y = tile_links(fpa, fpb, radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], names=["a", "b"])

    return full.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id reachable over links."""
    fps = written(fingerprints(docs, width, id_col, text_col), "fp")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "reps", pieces(fps.count(), 1_000_000, 8))
    n = reps.count()
    own = reps.select("node", F.col("node").alias("other"), "fp")
    edges = links(reps, n, radius)
    # a doc_id of several rows is one node, though its rows may have several fingerprints
    same_id = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    if not same_id.isEmpty():
        edges = edges.unionByName(fps.join(same_id.select("doc_id"), "doc_id").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    roots = components(edges)
    to = own.join(roots, "node", "left").select("fp", F.coalesce("root", "other").alias("component_id"))
    return fps.join(to, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """The rows of docs without those that have a near duplicate with a smaller doc_id in their component.

    Of several rows with one doc_id, one stays. Rows with null doc_id all stay: they can't be told apart by id. The rows that go
    are few beside those that stay, so the texts meet a small table: they aren't shuffled where Spark finds it under its threshold.
    """
    found = near_duplicates(docs, radius, width).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("root"), F.count(F.lit(1)).alias("n"))
    found = written(found.where("root <> doc_id or n > 1"), "copies")
    drop = found.where("root <> doc_id").select(F.col("doc_id").alias(f"{OWN}id"))
    out = docs.join(drop, docs["doc_id"] == F.col(f"{OWN}id"), "left_anti")
    if found.where("root = doc_id").isEmpty():
        return out
    return out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
