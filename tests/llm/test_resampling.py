"""Importance resampling against a plain version, with longer features, and the composition of CRCs."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from recoflow.llm import importance_resampling as ir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(5)
VOCABULARY = ["the", "Of", "größe", "naïve", "x1", "日本", "CAFÉ", "a", "zz", "benchmark", "what", "ÀÉ"]
SCHEMA = "doc_id long, text string, n_words long, ord string, tk string, buckets string"


def texts():
    made = [" ".join(RNG.choice(VOCABULARY) + RNG.choice(["", ",", ".\n", "--", "  "]) for _ in range(RNG.randint(1, 60))) for _ in range(60)]
    return made + [None, "", "  ", "...", "one", "A" * 5000, " ".join(["long"] * 30_000), "x" * 60 + " word " * 25, made[0], made[1], "\u0085 a b", "don't e.g. 3.14" * 9]


def plain(rows, items, lo, hi, buckets, percent):
    def feats(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]

    own = [(d, *feats(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in items for b in feats(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for d, n, f in own:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v or 0) for v in r))


@pytest.mark.parametrize("lo, hi, buckets, percent", [(1, 1, 10_000, 10), (1, 3, 500, 35), (2, 2, 97, 100)])
def test_resampling(spark, lo, hi, buckets, percent):
    rows = [(None if i == 4 else i - 20, t) for i, t in enumerate(texts())]
    rows += [rows[7], rows[7], (None, rows[9][1])]
    items = ["The benchmark of what?", "what benchmark " * 12, None, "..."]
    docs = spark.createDataFrame([(d, t, 1, "x", "y", "z") for d, t in rows], SCHEMA).repartition(3)
    got = ir.resample(docs, spark.createDataFrame([(t,) for t in items], "text string"), min_n=lo, max_n=hi, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(map(tuple, got.collect())) == order(plain(rows, items, lo, hi, buckets, percent))


def test_drawn_documents(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(d, t, 7, "x", "y", "z") for d, t in rows], SCHEMA)
    target = spark.createDataFrame([("what benchmark",)], "text string")
    want = {r[0] for r in plain(rows, ["what benchmark"], 1, 1, 10_000, 50) if r[4]}
    got = ir.drawn_documents(docs, target, percent=50)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want and want


def test_nothing_to_draw(spark):
    empty, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert ir.resample(empty, target).collect() == []
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in ir.resample(one, target).collect()] == [(1, 0, 0)]


def test_crc_composition_and_scan():
    for _ in range(200):
        a, b = (RNG.randbytes(RNG.randint(0, 70)) for _ in range(2))
        got = ir.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b)
    text = b" the cat  the the x cat the "
    starts, ends = (np.array([m.span()[k] for m in re.finditer(rb"\S+", text)]) for k in (0, 1))
    for words in ([], [b"the"], [b"the", b"cat", b"he"]):
        crc, length = ir.Payloads(words).scan(text, starts, ends)
        assert crc.tolist() == [zlib.crc32(w) for w in text.split()] and length.tolist() == [len(w) for w in text.split()]
