"""BPE encoding and decoding of whole texts with a byte-level vocabulary file.

Method: speculate and verify. A text is cut into words by the vocabulary's pattern; for words not met before, greedy
longest match proposes tokens. A proposal is the merges' own result exactly if every adjacent pair of tokens is
compatible, that is, if merging the two tokens' bytes alone gives these two tokens back. All adjacent pairs of a batch's
new words are gathered in arrays and looked up at once in a table of pairs already judged; pairs met for the first time
are judged once. Only words with a pair that fails undergo exact merging, by rank, with a heap.

A word longer than LONG bytes is not merged as a whole: it is cut at compatible pairs, only the stretches that hold a
pair that fails are merged, and a stretch grows until its ends are compatible too, which makes the result the same.

Texts are split at the file's added tokens first, as its own library does. The vocabulary file (of a known size, checked)
is read by the driver and broadcast, so executors need no file of their own. Files whose settings ask for another way of
cutting or normalising texts are refused.

Memory: a batch is worked through in slices of about SLICE bytes, the cache of words holds at most CACHE_BYTES and goes
when a partition ends, the table of judged pairs holds JUDGED entries; words over LONG bytes are never cached. What is left grows with the longest single text.

Defined cases: a null text is encoded as the empty text, which has no tokens. Texts of any length are encoded whole.
Repeated rows and null ids are encoded like others; an empty table gives an empty result. Other columns pass through, but
for n_tokens, ids and decoded, in any case of letters, which are replaced.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches, slices

# Fixed value: the pattern by which byte-level vocabularies of this family cut text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of cached words, by estimate; pairs that are remembered; bytes of a batch that are worked on at a time.
CACHE_BYTES, JUDGED, SLICE = 96 << 20, 1 << 21, 1 << 20
#: Bytes beyond which a word is merged by stretches, and tokens in a stretch at first.
LONG, STRETCH = 1024, 32
#: Bytes up to which merging scans a list; beyond, it keeps a heap. A rank larger than any.
SHORT, NONE = 48, 1 << 40
#: Words of one text that are held at a time, and characters of a text that is cut into words at once.
STEP = 100_000
MAX_FILE = 64 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, blob: bytes | str) -> None:
        file = json.loads(blob)
        _check(file)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.ids = {b: i for i, b in self.bytes_of.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        # all tokens' bytes one after the other, and where each begins and how long it is
        known = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.flat, self.size = np.frombuffer(b"".join(known), np.uint8), np.fromiter(map(len, known), np.int64, len(known))
        self.start = np.cumsum(self.size) - self.size
        self.longest: dict[bytes, int] = {}  # by a token's first four bytes, the longest token that begins so
        for b in self.ids:
            if len(b) >= 4:
                self.longest[b[:4]] = max(self.longest.get(b[:4], 0), len(b))
        self.pair_rank = {p: m[0] for p, m in self.merges.items()}
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # two generations of words: those met since the last change, and those met in the one before
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached = 0  # bytes of the first, by estimate
        self.judged, self.verdict = np.empty(0, np.int64), np.empty(0, bool)
        self.merged = 0

    def merge(self, word: bytes) -> list[int]:
        """The merges themselves: the pair of lowest rank first, leftmost first."""
        if len(word) > SHORT:
            return self._merge_long(word)
        rank, merges, first = self.pair_rank.get, self.merges, self.first
        ids = [first[b] for b in word]
        ranks = [rank(p, NONE) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < NONE:
            i = ranks.index(low)
            ids[i] = merges[ids[i], ids.pop(i + 1)][1]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NONE)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap, whose cost grows with n log n."""
        ids: list[int | None] = [self.first[b] for b in word]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [i for i in ids if i is not None]

    def greedy(self, word: bytes) -> Iterator[int]:
        at, n, ids, longest = 0, len(word), self.ids.get, self.longest.get
        while at < n:
            for k in range(min(longest(word[at : at + 4], 3), n - at), 0, -1):
                if (i := ids(word[at : at + k])) is not None:
                    break
            yield i
            at += k

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def stretches(self, word: bytes) -> np.ndarray:
        """A long word's ids: only stretches around pairs that fail are merged, and grow until their ends hold."""
        t = np.fromiter(self.greedy(word), np.int64)
        pairs = t[:-1] << 32 | t[1:] + 1
        held = np.concatenate([np.empty(0, bool), *(self.compatible(pairs[a : a + STEP]) for a in range(0, len(pairs), STEP))])
        if held.all():
            return t
        self.merged += 1
        good = np.flatnonzero(held) + 1
        cuts = good[np.unique(good // STRETCH, return_index=True)[1]]
        parts: list[np.ndarray] = np.split(t, cuts)
        for i in np.unique(np.searchsorted(cuts, np.flatnonzero(~held) + 1, side="right")).tolist():
            parts[i] = np.array(self.merge(self.spell(parts[i].tolist())), np.int64)
        while len(parts) > 1:
            ends = np.array([p[-1] for p in parts[:-1]]) << 32 | np.array([p[0] for p in parts[1:]]) + 1
            held = self.compatible(ends)
            if held.all():
                break
            out, i = [], 0
            while i < len(parts):
                j = i + 1
                if i < len(held) and not held[i]:
                    size, j = len(parts[i]) + len(parts[i + 1]), i + 2
                    while j < len(parts) and (size < 2 * len(parts[i]) or not held[j - 1]):
                        size += len(parts[j])
                        j += 1
                    out.append(np.array(self.merge(self.spell(np.concatenate(parts[i:j]).tolist())), np.int64))
                else:
                    out.append(parts[i])
                i = j
            parts = out
        return np.concatenate(parts)

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For codes left << 32 | right + 1 (right + 1 is 0 for a token that is a word alone): whether they hold."""
        codes, where = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.judged, codes), max(0, len(self.judged) - 1))
        new = codes if not len(self.judged) else codes[self.judged[at] != codes]
        if len(self.judged) and len(self.judged) + len(new) > JUDGED:
            self.judged, self.verdict, new = np.empty(0, np.int64), np.empty(0, bool), codes
        if len(new):
            held = []
            for c in new.tolist():
                a, b = c >> 32, (c & 0xFFFFFFFF) - 1
                held.append(self.merge(self.bytes_of[a] + (self.bytes_of[b] if b >= 0 else b"")) == ([a, b] if b >= 0 else [a]))
            judged, verdict = np.concatenate([self.judged, new]), np.concatenate([self.verdict, np.array(held, bool)])
            order = np.argsort(judged, kind="stable")
            self.judged, self.verdict = judged[order], verdict[order]
        return self.verdict[np.searchsorted(self.judged, codes)][where]

    def learn(self, words: list[str]) -> None:
        """Put these distinct words' ids, as little-endian 32-bit bytes, into the cache."""
        raw = [w.encode("utf-8", "replace") for w in words]
        for w, r in zip(words, raw):
            if len(r) > LONG:
                self.cache[w] = self.stretches(r).astype("<u4").tobytes()
        words, raw = [w for w, r in zip(words, raw) if len(r) <= LONG], [r for r in raw if len(r) <= LONG]
        if not words:
            return
        tokens = [list(self.greedy(w)) for w in raw]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        right = np.zeros(len(flat), np.int64)
        right[:-1] = flat[1:] + 1
        last = ends - 1
        right[last] = 0
        alone = sizes == 1
        check = np.ones(len(flat), bool)
        check[last[~alone]] = False
        bad = np.zeros(len(flat), bool)
        bad[check] = ~self.compatible((flat << 32 | right)[check])
        failed = np.logical_or.reduceat(bad, ends - sizes)
        for w, r, t, f in zip(words, raw, tokens, failed.tolist()):
            if f:
                t = self.merge(r)
                self.merged += 1
            self.cache[w] = np.array(t, "<u4").tobytes()
            self.cached += 160 + len(r) + 4 * len(t)

    def _parts(self, texts: list[str]) -> Iterator[tuple[int, list[str] | int]]:
        """(number of the text, up to STEP of its words, or an added token's id), in order."""
        for i, text in enumerate(texts):
            whole = not self.cut or not any(a in text for a in self.added)
            for part in [text] if whole else self.cut.split(text):
                if part in self.added:
                    yield i, self.added[part]
                elif len(part) <= STEP:
                    yield i, self.words.findall(part)
                else:
                    found = (m.group() for m in self.words.finditer(part))
                    while some := list(itertools.islice(found, STEP)):
                        yield i, some

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str] | int]] = []
        for part in itertools.chain(self._parts(texts), [None]):
            if part:
                held.append(part)
            if part is None or sum(len(w) for _, w in held[-1:] if isinstance(w, list)) >= STEP or len(held) >= 256:
                new = dict.fromkeys(w for _, ws in held if isinstance(ws, list) for w in ws if w not in self.cache)
                for w in list(new):
                    if (known := self.older.pop(w, None)) is not None:
                        self.cache[w] = known
                        self.cached += 160 + len(w) + len(known)
                        del new[w]
                if new:
                    self.learn(list(new))
                for i, ws in held:
                    out[i].append(ws.to_bytes(4, "little") if isinstance(ws, int) else b"".join(map(self.cache.__getitem__, ws)))
                held = []
                for w in new:
                    if len(w) > LONG // 4 and len(w.encode("utf-8", "replace")) > LONG:
                        del self.cache[w]
                if 2 * self.cached > CACHE_BYTES:
                    self.cache, self.older, self.cached = {}, self.cache, 0
        return [b"".join(o) for o in out]

    def decode(self, ids: bytes) -> str:
        t, out = np.frombuffer(ids, "<u4"), []
        for at in range(0, len(t), STEP):
            some = t[at : at + STEP]
            size = self.size[some]
            end = np.cumsum(size)
            out.append(self.flat[np.repeat(self.start[some] - end + size, size) + np.arange(end[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")

    def forget(self) -> None:
        """Give the cached words' memory back."""
        self.cache, self.older, self.cached = {}, {}, 0


def _check(file: dict) -> None:
    """Refuse a file that asks for what this module doesn't do."""
    pre, model = file.get("pre_tokenizer") or {}, file["model"]
    if file.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level files without a normalizer and with the family's own pattern are read")
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("the file's model has settings that plain merging doesn't follow")
    if any(t.get(k) for t in file.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take blanks or word ends into account are not read")


_MADE: dict[int, Bpe] = {}


def tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens (long), ids (binary: little-endian 32-bit numbers) and decoded (the text that they give)."""
    with open(path, "rb") as f:  # the driver's own copy of the vocabulary, not a table
        blob = f.read(MAX_FILE + 1)
    if len(blob) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    shipped = docs.sparkSession.sparkContext.broadcast(blob)

    lean_batches(docs.sparkSession)

    @F.arrow_udf("n_tokens long, ids binary, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = hash(shipped.value)
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = Bpe(shipped.value)
        bpe = _MADE[key]
        for part in slices(batches, SLICE):
            ids = bpe.encode_batch([t or "" for t in part.to_pylist()])
            yield pa.StructArray.from_arrays([pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["n_tokens", "ids", "decoded"])
        bpe.forget()

    new = ("n_tokens", "ids", "decoded")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return docs.select(*kept, both(F.col(text_col)).alias("__tsr_b")).select(*kept, *[F.col(f"__tsr_b.{c}") for c in new])
