"""run() of the corpus pipeline against a second implementation of all five stages in plain Python."""

import hashlib
import math
import zlib

import corpus_pipeline
import regex
import xxhash
from tessera.llm import queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
MASK = (1 << 32) - 1


def grams(text):
    """Buckets of the one- to three-letter groups that end in or right after a letter."""
    folded = "  " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        if b == c == " ":
            continue
        a, b, c = ord(a), ord(b), ord(c)
        two = (b * 0x9E3779B1 + c * 0x85EBCA77) & MASK
        for g in (c * 0xC2B2AE3D, two + 0x27D4EB2F, two * 0x165667B1 + a * 0x85EBCA6B):
            g &= MASK
            yield ((g ^ g >> 15) * 0x2C1B3C6D & MASK) >> 16


def language_id(docs):
    learn = [d for d in docs if d["lang"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1]
    langs = sorted({d["lang"] for d in learn})
    assert 2 <= len(langs) <= 5
    n = len(langs)
    # a bit for each way to part the languages, the first one on the positive side
    bits = [[1] + [1 if not s >> (n - 2 - i) & 1 else -1 for i in range(n - 1)] for s in range(1, 1 << (n - 1))]
    share = []
    for x in langs:
        count = [0.05] * (1 << 16)
        for d in learn:
            if d["lang"] == x:
                for g in grams(d["text"]):
                    count[g] += 1
        total = sum(count)
        share.append([c / total for c in count])
    weights = []
    for bit in bits:
        plus, minus = [i for i in range(n) if bit[i] == 1], [i for i in range(n) if bit[i] == -1]
        w = [math.log(sum(share[i][g] for i in plus) / len(plus)) - math.log(sum(share[i][g] for i in minus) / len(minus)) for g in range(1 << 16)]
        scale = sum(abs(sum(p * x for p, x in zip(share[i], w))) for i in range(n)) / n
        weights.append([x / scale for x in w])

    def margins(text):
        held = list(grams(text))
        return [sum(w[g] for g in held) / max(1, len(held)) for w in weights]

    good = [[0] * len(bits) for _ in langs]
    for d in learn:
        i = langs.index(d["lang"])
        for b, m in enumerate(margins(d["text"])):
            good[i][b] += m * bits[b][i] > 0
    trust = [[(g + 1) / (sum(d["lang"] == langs[i] for d in learn) + 2) for g in good[i]] for i in range(n)]
    trust = [[t / sum(row) for t in row] for row in trust]
    kept = []
    for d in docs:
        if not d["text"] or not regex.search(r"\p{L}", d["text"]):
            continue
        m = margins(d["text"])
        loss = [sum(t * math.log1p(math.exp(-4 * x * bits[b][i])) / 4 for b, (x, t) in enumerate(zip(m, trust[i]))) for i in range(n)]
        first, second = sorted(math.exp(-8 * (x - min(loss))) for x in loss)[::-1][:2]
        if second < 0.9 * first:
            kept.append(d)
    return kept


def line_dedup(docs):
    sites, first = {}, {}
    for d in docs:
        for line in d["text"].split("\n"):
            line = line.strip(" \t\r\f\x0b")
            if len(regex.split(r"[ \t\r\f\x0b]+", line)) >= 5:
                sites.setdefault(line, set()).update(() if d["source"] is None else (d["source"],))
                first[line] = min(first.get(line, d["doc_id"]), d["doc_id"])
    out = []
    for d in docs:
        cut = [x for x in d["text"].split("\n") if not (len(sites.get(y := x.strip(" \t\r\f\x0b"), ())) >= 5 and first[y] != d["doc_id"])]
        text = "\n".join(cut)
        out.append(d if text == d["text"] else d | {"text": text, "n_chars": len(text)})
    return out


def fingerprint(text):
    words = regex.findall(r"[^\x20\x09-\x0d]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def near_dedup(docs):
    fps = [(d["doc_id"], fingerprint(d["text"])) for d in docs]
    root = {i: i for i, _ in fps}
    moved = True
    while moved:
        moved = False
        for a, x in fps:
            for b, y in fps:
                if root[b] < root[a] and (x ^ y).bit_count() <= 4:
                    root[a], moved = root[b], True
    return [d for d in docs if root[d["doc_id"]] == d["doc_id"]]


def shingles(text):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def decontaminate(docs, items):
    items = [s for s in map(shingles, items) if s]
    return [d for d in docs if not any(5 * len(i & s) >= 4 * len(i) for s in [shingles(d["text"])] for i in items)]


def test_run(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = near_dedup(line_dedup(language_id(docs)))
    kept = decontaminate(kept, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    tokenizer, want = Tokenizer.from_file(queries.vocabulary_path()), {}
    for d in kept:
        ids = tokenizer.encode(d["text"], add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        plain = tokenizer.decode(ids, skip_special_tokens=False)
        want[d["doc_id"]] = d | {"n_tokens": len(ids), "ids": raw, "ids_sha256": hashlib.sha256(raw).hexdigest(), "decoded_sha256": hashlib.sha256(plain.encode()).hexdigest()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) < len(docs)
    for r in got:
        assert {k: bytes(v) if k == "ids" else v for k, v in r.asDict().items()} == want[r["doc_id"]]
