"""Approximate nearest neighbours by largest inner product, with a hash-prefix forest.

Method: each of TREES trees gives every vector a string of DEPTH bits, the sides of its own rotated hyperplanes. A tree is the
sorted array of its strings, cut into blocks of about BLOCK by ranges of strings. A query descends: in each tree, binary search
in the block of its own string tells how many strings share each prefix with it, down to the longest that any shares. Then it
ascends in all trees together, one bit at a time, until the strings that share the prefix, counted over all trees, are
enough. Its candidates are all vectors under these prefixes in any tree, scored exactly in double precision.

How many are enough is measured, at every size, on the whole table: for FIT_QUERIES of its vectors, drawn at random, the true
nearest are found by reading all vectors once, and the least number of candidates is taken with which TARGET of them are met,
but never fewer than `least` vectors. So the number follows the data: where neighbours are close it doesn't grow with the
table; vectors without structure need a large share of it, whatever the index. Every row is indexed; none is dropped.

Vectors are first extended by one component that makes all norms equal, so that a small angle means a large product; the mean
is taken off and each hyperplane passes through the median of a sample of at most FIT_ROWS vectors (a documented bound), which
keeps the trees balanced; the blocks' limits are the sample's quantiles, at most QUANTILES a tree.

What is shuffled: per tree, a string and the number of the row block its vector is in. Row blocks hold about ROW_BYTES of
vectors, by ranges of the first tree's strings, so that neighbours share few of them. A query is sent to the row blocks that hold
candidates of it; there the same binary search in the block's own sorted arrays gives the candidates. A vector is never
copied to trees, nor are candidates to queries. A query whose prefix spans more than its own block of a tree is sent to all row
blocks. Blocks that are too large, as of very many near-equal vectors, are split by a hash, and queries that meet in
one block are dealt in groups of at most about ASKS. Counts by block, at most TREES * QUANTILES, are what the driver holds.
Counts of a prefix that spans several blocks of a tree are estimated from the sample.

Equal vectors are one entry of the trees, with their k + 1 smallest ids: more can never be among a query's k nearest, as
ties go to smaller ids. A row block keeps, of all candidates that may tie with the last one needed, the k + 1 ids that come
first by exact score and id.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those
whose length isn't the table's most frequent one (the shorter of equally frequent ones), nor rows with null id. Fewer
candidates than k: all of them. Repeated rows of one id and vector count once. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean_batches, written

TREES, DEPTH = 8, 62
#: Strings in a block of a tree, bytes of vectors (as doubles) in a row block, queries that meet a block at a time, blocks a tree.
BLOCK, ROW_BYTES, ASKS, QUANTILES = 16384, 16 << 20, 4096, 1024
FIT_ROWS, FIT_QUERIES, TARGET = 8192, 128, 0.96
#: Vectors that a query is compared with at least.
LEAST = 1024
#: Parts of a row block's candidates from which on products with the whole block are cheaper than picking them out.
DENSE = 4


def runs(array: np.ndarray, q: np.ndarray, depth) -> tuple[np.ndarray, np.ndarray]:
    """Where, in a sorted array, the strings begin and end that share their first `depth` bits with each of q."""
    shift = DEPTH - np.asarray(depth, np.int64)
    low = q >> shift << shift
    return np.searchsorted(array, low, "left"), np.searchsorted(array, low + (np.int64(1) << shift) - 1, "right")


class Forest:
    """Hyperplanes of all trees, sorted strings of a sample, and the share of all trees' strings that a query should meet."""

    def __init__(self, sample: np.ndarray, norm: float, k: int, n: int, seed: int = 11, fit: bool = True) -> None:
        self.norm, self.n = norm, n
        x = self._extended(sample)
        self.mean = x.mean(axis=0)
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.planes = np.stack([self._planes(rng, d) for _ in range(TREES)])
        self.middle = np.median(np.einsum("nd,tdb->tnb", x - self.mean, self.planes), axis=1)
        strings = self.strings(sample)
        self.sample = self.counted(strings)
        blocks = min(QUANTILES, -(-n // BLOCK))
        self.edges = [np.unique(a[[len(a) * i // blocks for i in range(1, blocks)]]) for a in self.sample]
        rows = min(QUANTILES, -(-n * 8 * (d - 1) // ROW_BYTES))
        self.row_edges = np.unique(self.sample[0][[len(sample) * i // rows for i in range(1, rows)]])
        self.share = 1.0
        if fit:
            self._fit(sample, strings, k)

    @staticmethod
    def _planes(rng: np.random.Generator, d: int) -> np.ndarray:
        return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-DEPTH // d))], axis=1)[:, :DEPTH]

    def _extended(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm**2 - (v * v).sum(axis=1)))
        return np.concatenate([v, rest[:, None]], axis=1) / self.norm

    def strings(self, v: np.ndarray) -> np.ndarray:
        """(trees, rows): DEPTH bits as a number; equal prefixes are equal numbers after a shift."""
        x = self._extended(v) - self.mean
        weights = np.int64(1) << np.arange(DEPTH - 1, -1, -1, dtype=np.int64)
        return np.stack([(x @ self.planes[t] > self.middle[t]) @ weights for t in range(TREES)])

    @staticmethod
    def counted(strings: np.ndarray) -> np.ndarray:
        """Each tree's sorted array, in which runs are counted."""
        return np.sort(strings, axis=1)

    def ascend(self, strings: np.ndarray, arrays: np.ndarray, n: int) -> np.ndarray:
        """For each query the depth at which the trees' matches together are enough."""
        total = sum(self.descend(a, q) for a, q in zip(arrays, strings))
        return deepest(total, self.share * TREES * n)

    @staticmethod
    def descend(array: np.ndarray, q: np.ndarray) -> np.ndarray:
        """(queries, depths): how many strings of a sorted array share that many bits with each of q."""
        out = np.empty((len(q), DEPTH + 1))
        for d in range(DEPTH + 1):
            a, b = runs(array, q, d)
            out[:, d] = b - a
        return out

    def within(self, t: int, q: np.ndarray, depth) -> np.ndarray:
        """Whether the strings that share `depth` bits with each of q are all in the block of its own."""
        shift = DEPTH - np.asarray(depth, np.int64)
        low = q >> shift << shift
        high = low + (np.int64(1) << shift) - 1
        return np.searchsorted(self.edges[t], low, "right") == np.searchsorted(self.edges[t], high, "right")

    def enough(self, total: np.ndarray, shared: list[np.ndarray], least: int) -> float:
        """The least number of strings with which TARGET of the true nearest are met. total: (queries, depths) strings that
        share a prefix; shared: for each query, the longest prefix that any tree shares with each of its nearest."""
        floor = float(TREES * least)
        known = [i for i, s in enumerate(shared) if len(s)]
        grid = [floor * 1.3**i for i in range(200) if floor * 1.3**i < TREES * self.n]
        for want in grid:
            depth = deepest(total[known], want)
            if known and np.mean([(shared[i] >= d).mean() for i, d in zip(known, depth)]) >= TARGET:
                return want
        return float("inf")

    def _fit(self, sample: np.ndarray, strings: np.ndarray, k: int) -> None:
        # a sorted sample's first rows may all be of one cluster, so the queries are drawn from all of it
        q = np.random.default_rng(len(sample)).permutation(len(sample))[:FIT_QUERIES]
        products = sample[q] @ sample.T
        products[np.arange(len(q)), q] = -np.inf
        top = np.argsort(-products, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        total = sum(self.descend(a, s[q]) for a, s in zip(self.sample, strings))
        want = self.enough(total, [common(strings[:, i], strings[:, near]) for i, near in zip(q, top)], 1)
        self.share = min(1.0, want / (TREES * len(sample)))


def deepest(total: np.ndarray, want: float) -> np.ndarray:
    """The greatest depth at which a total is at least `want`; 0 if there is none. Totals fall with depth."""
    return np.maximum((total >= want * (1 - 1e-9)).sum(axis=1) - 1, 0)


def common(q: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For strings (trees,) and (trees, others): the longest prefix that any tree shares with each of the others."""
    differ = q[:, None] ^ others
    high = differ >> 31  # in two halves, which doubles hold exactly: the exponent is the highest bit's place
    place = np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp((differ & (1 << 31) - 1).astype(np.float64))[1])
    return (DEPTH - place).max(axis=0)


def _entries(vectors: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(v, ids): the distinct valid vectors, each with its k + 1 smallest ids."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), _vector(vectors, vec_col).alias("v")).where("id is not null and v is not null")
    rows = rows.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0.0))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))
    # the group limit drops all but the k + 1 smallest ids before the shuffle, so a hot vector gathers nowhere
    w = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _vector(vectors: DataFrame, vec_col: str):
    """The vector as it is, if it is of floats: half the bytes of doubles, and the same values."""
    kept = vectors.select(vec_col).dtypes[0][1]
    return F.col(vec_col).cast("array<float>" if kept == "array<float>" else "array<double>")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def _true_nearest(hashed: DataFrame, asks: pd.DataFrame, k: int) -> DataFrame:
    """(i, score, s): the strings of the k nearest entries of each of a few queries, by reading all entries once."""
    shipped = hashed.sparkSession.sparkContext.broadcast(_matrix(asks["v"]))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shipped.value
        best: list[pd.DataFrame] = []
        for b in batches:
            for at in range(0, len(b), 8192):
                part = b.iloc[at : at + 8192]
                v = _matrix(part["v"])
                p = w @ v.T
                for i in range(len(w)):
                    p[i, (v == w[i]).all(axis=1)] = -np.inf
                    near = np.argpartition(-p[i], min(k, len(v)) - 1)[:k]
                    best.append(pd.DataFrame({"i": i, "score": p[i, near], "s": part["s"].to_numpy()[near]}))
            kept = pd.concat(best)
            best = [kept[kept["score"] > -np.inf].sort_values("score", ascending=False).groupby("i").head(k)]
        yield from best

    found = hashed.select("v", "s").mapInPandas(scan, "i int, score double, s array<long>")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score")))).where(F.col("r") <= k).drop("r")


def _dealt(df: DataFrame, keys: list[str], size: int, value, name: str, few: bool = True) -> DataFrame:
    """df with `name`: which part of its key a row goes to, by a hash of `value`; a key has a part for each `size` of its rows.
    few: there are TREES * QUANTILES keys at most, whose counts may be broadcast."""
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("parts")).where("parts > 1")
    out = df.join(F.broadcast(counts) if few else counts, keys, "left")
    return out.withColumn(name, F.pmod(F.xxhash64(value, F.lit("part")), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each query: the rows whose id `every` divides."""
    spark = vectors.sparkSession
    lean_batches(spark)
    entries = written(_entries(vectors, k, id_col, vec_col), "entries")
    n, norm = entries.agg(F.count(F.lit(1)), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    luck = F.pmod(F.xxhash64("v", F.lit("fit")), F.lit(1 << 30))
    rows = [r["v"] for r in entries.where(luck <= int((1 << 30) * min(1.0, 0.9 * FIT_ROWS / n))).select("v").limit(FIT_ROWS).toLocalIterator()]
    rows = rows or [r["v"] for r in entries.select("v").limit(FIT_ROWS).toLocalIterator()]
    fitted = Forest(np.array(sorted(rows)), norm * (1 + 1e-12), k, n, fit=False)
    forest = spark.sparkContext.broadcast(fitted)

    @F.pandas_udf("s array<long>, tb array<int>, rq int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = forest.value
        for v in batches:
            s = f.strings(_matrix(v)) if len(v) else np.empty((TREES, 0), np.int64)
            tb = np.stack([np.searchsorted(e, x, "right") for e, x in zip(f.edges, s)])
            yield pd.DataFrame({"s": list(s.T), "tb": list(tb.T.astype(np.int32)), "rq": np.searchsorted(f.row_edges, s[0], "right").astype(np.int32)})

    hashed = written(entries.select("v", "ids", place("v").alias("h")).select("v", "ids", "h.*"), "strings")
    d = len(rows[0])
    # row blocks
    hashed = _dealt(hashed, ["rq"], max(1, 2 * ROW_BYTES // (8 * d)), F.col("v"), "cut").withColumn("rb", F.col("rq") * 65536 + F.col("cut"))
    packs = written(hashed.groupBy("rb").agg(F.collect_list(F.struct("v", "ids", "s")).alias("x")).select("rb", F.col("x.v").alias("v"), F.col("x.ids").alias("ids"), F.col("x.s").alias("s")), "packs")
    # trees: sorted arrays of strings, each with the row block of its vector
    tree = lambda df, *cols: df.select(*cols, F.posexplode(F.arrays_zip("s", "tb")).alias("t", "x")).select(*cols, "t", "x.s", "x.tb")
    strings = tree(hashed, "rb")
    arrays = _dealt(strings, ["t", "tb"], 2 * BLOCK, F.col("s") + F.col("rb"), "sub").groupBy("t", "tb", "sub").agg(F.sort_array(F.collect_list(F.struct("s", "rb"))).alias("x"))
    arrays = written(arrays.select("t", "tb", "sub", F.col("x.s").alias("array"), F.col("x.rb").alias("rbs")), "trees")
    # a vector may have more ids than its smallest: which of them ask is told by the rows themselves
    wanted = vectors.where(F.col(id_col).cast("long") % every == 0).select(F.col(id_col).cast("long").alias("query_id"), _vector(vectors, vec_col).alias("v")).distinct()
    trial = hashed.orderBy(F.xxhash64("v", F.lit("trial")), "ids").limit(FIT_QUERIES)
    asks = hashed.join(wanted.select("v").distinct(), "v", "left_semi").select("v", "s", "tb", F.lit(False).alias("trial")).unionByName(trial.select("v", "s", "tb", F.lit(True).alias("trial")))
    asks = written(asks.withColumn("a", F.monotonically_increasing_id()), "asks")

    def met(rows_: DataFrame, *cols: str) -> DataFrame:
        """A row for each block of a tree and at most about ASKS of the asks whose own block it is, all in arrays."""
        each = tree(rows_, "a", *cols)
        packed = _dealt(each, ["t", "tb"], ASKS, F.col("a"), "chunk").groupBy("t", "tb", "chunk").agg(F.collect_list(F.struct("a", "s", *cols)).alias("x"))
        return packed.select("t", "tb", *[F.col(f"x.{c}").alias(c) for c in ("a", "s", *cols)]).join(arrays, ["t", "tb"])

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = forest.value
        for b in batches:
            for t, sub_, a, q, array in zip(b["t"], b["sub"], b["a"], b["s"], b["array"]):
                c = f.descend(array, q)
                guess = f.descend(f.sample[t], q) * (f.n / f.sample.shape[1]) if sub_ == 0 else np.zeros(c.shape)
                inside = np.stack([f.within(t, q, depth) for depth in range(DEPTH + 1)], axis=1)
                yield pd.DataFrame({"a": a, "c": list(np.where(inside, c, guess))})

    sums = met(asks).mapInPandas(descend, "a long, c array<double>").groupBy("a").agg(F.array(*[F.sum(F.get("c", i)) for i in range(DEPTH + 1)]).alias("total"))
    totals = written(sums, "totals")
    tried = asks.where("trial").join(totals, "a").select("a", "v", "s", "total").toPandas()  # FIT_QUERIES rows
    near: dict[int, list] = {}
    for r in _true_nearest(hashed, tried, k).collect():  # k rows for each of them
        near.setdefault(r["i"], []).append(r["s"])
    shared = [common(np.array(s, np.int64), np.array(near[i], np.int64).T) if i in near else np.empty(0) for i, s in enumerate(tried["s"])]
    want = fitted.enough(np.array(tried["total"].tolist()), shared, least)
    depth = F.greatest(F.lit(0), F.size(F.filter("total", lambda x: x >= F.lit(want * (1 - 1e-9)))) - 1)
    asks = asks.where("not trial").join(totals, "a").select("a", "v", "s", "tb", depth.alias("d"))

    @F.pandas_udf("boolean")
    def wide(s: pd.Series, d_: pd.Series) -> pd.Series:
        q, at = np.array(s.tolist(), np.int64).reshape(-1, TREES).T, d_.to_numpy()
        return pd.Series(~np.all([forest.value.within(t, q[t], at) for t in range(TREES)], axis=0))

    asks = written(asks.withColumn("wide", wide("s", "d")), "depths")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a, q, at, array, rbs in zip(b["a"], b["s"], b["d"], b["array"], b["rbs"]):
                lo, hi = runs(array, q, at)
                hit = [np.unique(rbs[x:y]) for x, y in zip(lo, hi)]
                yield pd.DataFrame({"a": np.repeat(a, [len(h) for h in hit]), "rb": np.concatenate(hit)})

    blocks = [r["rb"] for r in packs.select("rb").collect()]
    to = met(asks.where("not wide"), "d").mapInPandas(route, "a long, rb int").distinct()
    to = written(to.unionByName(asks.where("wide").select("a", F.explode(F.from_json(F.lit(str(blocks)), "array<int>")).alias("rb"))), "routes")
    sent = _dealt(to, ["rb"], ASKS, F.col("a"), "chunk", few=False).join(asks.select("a", "d", F.col("s").alias("qs"), F.col("v").alias("qv")), "a")
    sent = sent.groupBy("rb", "chunk").agg(F.collect_list(F.struct("a", "d", "qs", "qv")).alias("x")).select("rb", *[F.col(f"x.{c}").alias(c) for c in ("a", "d", "qs", "qv")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = {name: b.column(name)[i].values for name in ("a", "d", "qs", "qv", "v", "ids", "s")}
                flat = lambda c, width, kind: x[c].flatten().to_numpy().reshape(-1, width).astype(kind, copy=False)
                counts = np.diff(x["ids"].offsets.to_numpy())
                found = best_of(x["a"].to_numpy(), x["d"].to_numpy(), flat("qs", TREES, np.int64).T, flat("qv", d, np.float64), flat("v", d, np.float64), flat("s", TREES, np.int64).T, x["ids"].flatten().to_numpy(), counts, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "vec_id", "score"])

    found = sent.join(packs, "rb").mapInArrow(search, "a long, vec_id long, score double")
    best = found.groupBy("a", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    # each query gets what its vector has found, less itself
    out = wanted.join(asks.select("v", "a"), "v").select("query_id", "a").join(best, "a").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of(a, depth, qs, w, v, s, ids, counts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, id, score): for each ask the k + 1 best ids among its candidates in a row block. qs and s: (trees, ...) strings of asks
    and rows; ids: those of the rows one after the other, as many for each row as counts tells."""
    first = np.cumsum(counts) - counts
    order = np.argsort(s, axis=1, kind="stable")
    ends = [runs(s[t][order[t]], qs[t], depth) for t in range(TREES)]
    many = sum(hi - lo for lo, hi in ends)
    # a product's last digits depend on its shape: what may be equal to the last one needed is scored again
    slack = 8 * v.shape[1] * np.finfo(float).eps * np.sqrt((v * v).sum(axis=1).max()) * np.sqrt((w * w).sum(axis=1))
    out: list[tuple] = []
    step = max(1, (4 << 20) // len(v))

    def keep(j: int, at: np.ndarray, p: np.ndarray) -> None:
        """The best of the rows `at`, whose products with ask j are p."""
        need = min(len(p), k + 1)
        least = np.partition(p, len(p) - need)[len(p) - need] - slack[j]
        while True:
            i = at[p >= least]
            score, n = (w[j] * v[i]).sum(axis=1), counts[i]
            own = ids[np.repeat(first[i] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            score = np.repeat(score, n)
            rank = np.lexsort((own, -score))
            # an id of several vectors counts once, with its best
            best = np.sort(np.unique(own[rank], return_index=True)[1])
            if len(best) > k or len(i) == len(at):
                break
            more = min(len(at), 2 * len(i))
            least = min(least, np.partition(p, len(p) - more)[len(p) - more])
        best = rank[best[: k + 1]]
        out.append((np.full(len(best), a[j]), own[best], score[best]))

    for at in range(0, len(a), step):
        some = np.arange(at, min(len(a), at + step))
        dense = some[many[some] * DENSE >= len(v)]
        products = w[dense] @ v.T
        for row, j in zip(products, dense):
            mask = np.zeros(len(v), bool)
            for t in range(TREES):
                mask[order[t][ends[t][0][j] : ends[t][1][j]]] = True
            hit = np.flatnonzero(mask)
            keep(j, hit, row[hit])
        for j in some[(many[some] * DENSE < len(v)) & (many[some] > 0)]:
            hit = np.unique(np.concatenate([order[t][ends[t][0][j] : ends[t][1][j]] for t in range(TREES)]))
            keep(j, hit, v[hit] @ w[j])
    return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
