"""Fingerprints against a plain vote, edited texts across partitions, the block tables against all pairs."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recoflow.llm import simhash
from recoflow.llm import textkit as tk

RNG = random.Random(3)
WORDS = ["alpha", "Beta", "größe", "x1", "日本", "the", "of", "it's", "...", "zz"]
SCHEMA = "doc_id long, text string, ord long, tk long, kind string, part string, f0 string, n string"


def prose(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", "", "\n", " "]) for _ in range(n))


def plain_fingerprint(text):
    """The vote over a dictionary of terms, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    sums = [0] * simhash.BITS
    for n, weight in enumerate(simhash.WEIGHTS, 1):
        for term, times in Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1)).items():
            joined = pa.array([" ".join(term)])
            buf, off = tk.utf8(joined)
            h = tk.span_hashes(buf, *tk.word_spans(buf, off, tk.byte_class("space"))[:2])
            h = h if n == 1 else tk.shingles(h, n)
            octets = b"".join(tk.mix(h ^ s).tobytes() for s in simhash._SALT)
            for bit in range(simhash.BITS):
                sign = 1 if octets[bit // 8] >> (7 - bit % 8) & 1 else -1
                sums[bit] += sign * weight * (1 + int(math.log2(times)))
    return bytes(sum((sums[8 * k + b] > 0) << (7 - b) for b in range(8)) for k in range(simhash.BITS // 8))


def texts():
    made = [prose(RNG.randint(1, 80)) for _ in range(30)]
    return made + made[:5] + [None, "", "  \n", "one", "two words", "x" * 5000, prose(4000), "🙂🙂🙂🙂", made[3] + " end"]


def rows():
    out = [(5 * i - 100, t) for i, t in enumerate(texts())]
    return out + [(None, "no id"), (None, "none either"), (None, "no id"), out[4], (out[4][0], "same id"), (out[6][0], None)]


def like(a, b):
    if a == b:
        return 1.0
    if not any(a) or not any(b):
        return 0.0
    differing = sum(bin(x ^ y).count("1") for x, y in zip(a, b))
    return max(0.0, math.cos(math.pi * differing / simhash.BITS))


def test_fingerprints_are_votes():
    some = [t or "" for t in texts()]
    got = simhash.fingerprints(pa.array(some))
    assert [r.tobytes() for r in got] == [plain_fingerprint(t) for t in some]


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_texts(spark, parts):
    have = rows()
    docs = spark.createDataFrame([(d, t, 1, 2, "x", "y", "z", "w") for d, t in have], SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = simhash.fingerprint_documents(docs, every=7).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    keyed = spark.createDataFrame(have, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()
    line = sorted(((r.doc_id, r.text, r.h) for r in keyed), key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = []
    prints = [plain_fingerprint(t) for _, t, _ in line]
    for k, (d, t, _) in enumerate(line):
        u, n = line[(k + 1) % len(line)][1], len(t) // 3
        e = t[:len(t) - n] + u[:n]
        near = sum(1 for p in prints if sum(bin(x ^ y).count("1") for x, y in zip(p, prints[k])) <= simhash.RADIUS) - 1
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[k].hex(), plain_fingerprint(e).hex(), round(like(prints[k], plain_fingerprint(e)), 9),
                     round(like(prints[k], prints[(k + 1) % len(line)]), 9), near if d is not None and d % 7 == 0 else None))
    have = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.n_near) for r in got]
    order = lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r)
    assert sorted(have, key=order) == sorted(want, key=order)


def test_no_rows_and_one(spark):
    assert simhash.fingerprint_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    r = simhash.fingerprint_documents(spark.createDataFrame([(0, "abcdef")], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.n_chars, x.near_next, x.n_near, x.edited_sha256) for x in r] == [(0, 6, 1.0, 0, hashlib.sha256(b"abcdab").hexdigest())]


@pytest.mark.parametrize("radius, blocks, tile", [(6, 8, 1 << 21), (3, 4, 5), (0, 8, 100), (7, 8, 100), (14, 16, 1000)])
def test_block_tables_find_all(monkeypatch, radius, blocks, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, (20, 2)).astype(np.uint64)
    prints = np.repeat(centres, 15, axis=0)
    for p in prints:
        for bit in rng.choice(simhash.BITS, rng.integers(0, 12), replace=False):
            p[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    own, others = prints[::3], np.ascontiguousarray(prints)
    tables = simhash.BlockTables(np.ascontiguousarray(own), radius, blocks)
    got = sorted(p for a, b in tables.near(others) for p in zip(a.tolist(), b.tolist()))
    distance = np.bitwise_count(own[:, None] ^ others[None]).sum(axis=2)
    assert got == sorted(zip(*(x.tolist() for x in np.nonzero(distance <= radius))))


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(simhash, "QUERY_BLOCK", 4)
    docs = spark.createDataFrame([(i, prose(40) if i % 3 else "the same words again") for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.n_near for r in simhash.fingerprint_documents(docs, every=2).collect()}
    assert all(got[i] == 13 for i in range(0, 40, 6)) and all(got[i] is None for i in range(1, 40, 2))
