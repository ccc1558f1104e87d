"""Language ID with error-correcting output codes.

Method: each language has a codeword of bits; for each bit a binary classifier over hashed character n-grams (one to
three letters) tells the languages with the bit from those without it. A text's margins are decoded to the language
whose codeword has the smallest loss, each bit's loss being weighted by how well that bit's classifier does on that
language's training rows (loss-weighted decoding). Texts whose two nearest codewords are about as near are flagged.

The classifiers are log-odds of n-gram shares, with all languages of a side weighing alike, so a frequent language
doesn't drown others. They are fitted on SAMPLE rows per language in expectation, chosen by a hash of doc_id; SAMPLE
is the documented bound of the fit. Only rows with crc32(doc_id as text) mod 3 other than 1 and non-null lang are
learned from. Predictions use the text alone, the whole of it, piece by piece.

Defined cases: null texts and texts without any letter are `und` with score 0; so is every text if no language has been
learned. A single learned language is predicted for every text with letters. Null doc_id counts as the empty text for
the split. Ties in loss go to the language that sorts first. Repeated rows give repeated results; empty tables give
empty results. Other columns, whatever their names, pass through identify().
"""

from __future__ import annotations

import itertools
import random
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches

#: Rows for each language that the classifiers are fitted on, in expectation.
SAMPLE = 5000
#: Languages that a model may have: 1 MB of the driver's memory each. A column with more is refused, not cut.
MAX_LANGS = 200
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
PIECE = 1 << 18
#: A text is ambiguous if the second language's probability is at least this share of the first's.
AMBIGUOUS = 0.9
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """By code point: the lower-case letter, or the blank for what is no letter."""
    if not _FOLD:
        t = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in map(chr, range(sys.maxunicode + 1)):
            if c.isalpha():
                low = c.lower()
                t[ord(c)] = ord(low) if len(low) == 1 else ord(c)
        _FOLD.append(t)
    return _FOLD[0]


def pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, buckets of the n-grams that end in this piece), PIECE characters at a time."""
    fold = _fold()
    for i, text in enumerate(texts):
        before = np.array([32, 32], np.uint32)
        for at in range(0, len(text), PIECE):
            c = fold[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
            c = np.concatenate([before, c])
            before = c[-2:]
            a, b, e = c[:-2], c[1:-1], c[2:]
            keep = (b != 32) | (e != 32)
            a, b, e = a[keep], b[keep], e[keep]
            two = b * np.uint32(0x9E3779B1) + e * np.uint32(0x85EBCA77)
            grams = np.concatenate([e * np.uint32(0xC2B2AE3D), two + np.uint32(0x27D4EB2F), two * np.uint32(0x165667B1) + a * np.uint32(0x85EBCA6B)])
            yield i, (grams ^ grams >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKET_BITS)


def codewords(n: int, seed: int = 9) -> np.ndarray:
    """(languages, bits) of +1 and -1: all splits for up to five languages, else the random code with the widest gap."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        return np.array([[1, *s] for s in itertools.product((1, -1), repeat=n - 1) if -1 in s], np.int8).T
    rng, bits, best = random.Random(seed), 4 + 10 * (n - 1).bit_length(), (-1, None)
    for _ in range(200):
        code = np.array([[rng.choice((1, -1)) for _ in range(bits)] for _ in range(n)], np.int8)
        code = code[:, abs(code.sum(axis=0)) < n]
        same = code.astype(np.int32) @ code.T.astype(np.int32)
        gap = (code.shape[1] - int((same - 2 * code.shape[1] * np.eye(n, dtype=np.int32)).max())) // 2
        best = max(best, (gap, code), key=lambda x: x[0])
    return best[1]


class Model:
    """langs sorted; code (langs, bits); w (buckets, bits); trust (langs, bits), rows adding up to 1."""

    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, trust: np.ndarray) -> None:
        self.langs, self.code, self.w, self.trust = langs, code, w, trust

    def margins(self, texts: list[str]) -> np.ndarray:
        """(texts, bits): each classifier's mean log-odds, at about 1 or -1 for a typical text."""
        total, n = np.zeros((len(texts), self.w.shape[1])), np.zeros((len(texts), 1))
        step = max(1, (1 << 21) // max(1, self.w.shape[1]))
        for i, h in pieces(texts):
            for at in range(0, len(h), step):
                total[i] += self.w.take(h[at : at + step], axis=0).sum(axis=0, dtype=np.float64)
            n[i] += len(h)
        return total / np.maximum(n, 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, whether it is ambiguous)"""
        if not self.langs:
            return [(UND, 0.0, False)] * len(texts)
        known = [t is not None and _LETTER.search(t) is not None for t in texts]
        loss = np.logaddexp(0, -4 * self.margins([t if k else "" for t, k in zip(texts, known)])[:, None, :] * self.code) / 4
        d = (loss * self.trust).sum(axis=2)
        p = np.exp(-8 * (d - d.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        out = []
        for k, row in zip(known, p):
            first = int(row.argmax())
            second = np.delete(row, first).max(initial=0.0)
            out.append((self.langs[first], float(row[first]), bool(second >= AMBIGUOUS * row[first])) if k else (UND, 0.0, False))
        return out


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, sample: int = SAMPLE, max_langs: int = MAX_LANGS) -> Model:
    """Counts of n-grams by language are added up by Spark; the driver gets at most BUCKETS numbers a language, of at
    most max_langs languages. More are a ValueError: the column doesn't hold languages then."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"lang has more than {max_langs} values (max_langs)")
    langs = sorted(counts)
    code = codewords(len(langs))
    lean_batches(docs.sparkSession)
    if len(langs) < 2:
        return Model(langs, code, np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape))
    share = F.element_at(F.create_map(*[F.lit(y) for x in langs for y in (x, min(1.0, sample / counts[x]))]), F.col("lang").cast("string"))
    luck = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    part = rows.where(luck < share).select(F.col("lang").cast("string").alias("lang"), "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            names = b["lang"].tolist()
            for i, h in pieces(b["text"].tolist()):
                held[names[i]] = held.get(names[i], 0) + np.bincount(h, minlength=BUCKETS)
        for x, c in held.items():
            at = np.flatnonzero(c)
            if len(at):
                yield pd.DataFrame({"lang": x, "bucket": at, "n": c[at]})

    share_of = np.full((len(langs), BUCKETS), 0.05)
    for r in part.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        share_of[langs.index(r["lang"]), r["bucket"]] += r["n"]
    share_of /= share_of.sum(axis=1, keepdims=True)
    plus, minus = ((code == s).T.astype(float) for s in (1, -1))
    w = np.log(plus @ share_of / plus.sum(axis=1, keepdims=True)) - np.log(minus @ share_of / minus.sum(axis=1, keepdims=True))
    w /= np.abs(share_of @ w.T).mean(axis=0)[:, None]
    model = Model(langs, code, np.ascontiguousarray(w.T, np.float32), np.full(code.shape, 1.0 / code.shape[1]))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for b in batches:
            lang = np.array([langs.index(x) for x in b["lang"]])
            right = (m.margins(b["text"].tolist()) * m.code[lang]) > 0
            for i in np.unique(lang):
                yield pd.DataFrame({"lang": i, "bit": np.arange(right.shape[1]), "right": right[lang == i].sum(axis=0), "n": int((lang == i).sum())})

    good = np.ones(code.shape)
    for r in part.mapInPandas(hits, "lang long, bit long, right long, n long").groupBy("lang", "bit").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).toLocalIterator():
        good[r["lang"], r["bit"]] = (r["right"] + 1) / (r["n"] + 2)
    model.trust = good / good.sum(axis=1, keepdims=True)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and ambiguous; columns of these names are replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    lean_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(shipped.value.predict(s.tolist()), columns=["lang_pred", "score", "ambiguous"])

    new = ("lang_pred", "score", "ambiguous")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return docs.select(*kept, tell(F.col("text")).alias("__tsr_l")).select(*kept, *[F.col(f"__tsr_l.{c}") for c in new])


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), learned from docs' own labelled rows."""
    model = train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text")
    return identify(rows, model).drop("text")
