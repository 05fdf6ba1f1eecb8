"""Target-distribution importance resampling: documents drawn by the likelihood ratio of hashed n-gram buckets.

Words are the runs of letters, digits and non-ASCII characters (A-Z lower-cased); features all runs of ``min_n`` to ``max_n``
consecutive words, joined by one space; a feature's bucket is its CRC-32 modulo the number of buckets. A bucket's gain
compares its share in the target with that in the documents; a document's weight is the sum of the gains of its features. Gumbel
noise of the document's id makes the highest scores a sample without replacement in proportion to the likelihood ratio.

Method: an Aho-Corasick automaton over a dictionary of distinct words, each bounded by delimiters (`` word ``), carries every word's CRC and
length. One scan over a piece of normalised text emits the payloads of its words in order; the CRC of a longer feature is composed of
adjacent payloads (a CRC moved past the bytes that follow, xor the next one), so no feature is ever built as a string. The dictionary
holds the frequent words of a sample (at most DICTIONARY words of at most WORD_BYTES bytes); it changes the speed only: words
that it lacks get their payload from their bytes. All counts cover all rows.

Scale: one pass over the texts writes each row's buckets; counting makes one vector a task; ranks come from range partitions with
their offsets. The driver gets vectors of the number of buckets, the dictionary, and a row a partition.

Cases: null, empty and wordless texts have no features and weight 0; very long texts are processed whole; repeated rows are ranked one
by one (in any order, their results are the same); a null id is the smallest and its noise is that of the empty string; equal
scores go to the smaller id; empty tables give an empty result or zero counts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import textkit as tk
from recoflow.llm.shared import NULL_ID, key_columns, numbered, written

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
DICTIONARY = 65_536
WORD_BYTES = 48
FIT_DOCS = 20_000
_WORD = tk.byte_class("alnum")
#: Word bytes lower-cased, all others a space.
_NORMAL = np.where(_WORD, tk.LOWER, 0x20).astype(np.uint8)


# ---- composition of CRCs ---------------------------------------------------------------

@cache
def _shift_tables() -> np.ndarray:
    """tables[k, byte, value]: what a CRC register becomes, byte by byte of it, after 2**k zero bytes (it is linear)."""
    def after_zero(x: np.ndarray) -> np.ndarray:
        for _ in range(8):
            x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        return x

    value = np.arange(256, dtype=np.uint32)
    step = np.stack([after_zero(value << np.uint32(8 * b)) for b in range(4)])
    out = []
    for _ in range(32):
        out.append(step)
        step = np.stack([_apply(step, step[b]) for b in range(4)])
    return np.stack(out)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of crc(A + B) that A has: crc(A) moved past len(B) = n bytes; xor crc(B) is the whole."""
    crc, n = crc.astype(np.uint32), n.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        bit = (n >> k) & 1 == 1
        crc[bit] = _apply(_shift_tables()[k], crc[bit])
    return crc


def joined(crc_a: np.ndarray, crc_b: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """CRCs of A + B."""
    return moved(crc_a, len_b) ^ crc_b.astype(np.uint32)


# ---- the dictionary and the scan -------------------------------------------------------

class Payloads:
    """The automaton: CRC and length of every word of a text."""

    def __init__(self, words: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)  # its numbers have 32 bits: the place of the payload
        for k, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        if words:
            self.automaton.make_automaton()

    def scan(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of each word of a normalised text, which begins and ends with a space."""
        crc, length = np.zeros(len(starts), np.uint32), ends - starts
        known = np.zeros(len(starts), bool)
        if len(self.crc):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(ends, found[:, 0])  # a match ends at the space after its word
            crc[at], length[at], known[at] = self.crc[found[:, 1]], self.length[found[:, 1]], True
        rest = np.flatnonzero(~known)
        crc[rest] = [zlib.crc32(text[a:b]) for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        return crc, length


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a piece one after another, lower-cased, a space before each and after the last, delimiters as spaces; starts and ends of
    the words, and each text's offsets among them."""
    text = np.full(len(buf) + len(off), 0x20, np.uint8)
    inner = np.ones(len(text), bool)
    begin = off + np.arange(len(off))
    inner[begin] = False
    text[inner] = _NORMAL[buf]
    edge = np.diff((text != 0x20).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    return text, starts, ends, np.searchsorted(starts, begin)


def features(payloads: Payloads, buf: np.ndarray, off: np.ndarray, min_n: int, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a piece: numbers of words, buckets of all features, and each text's offsets among these."""
    text, starts, ends, word_off = normalised(buf, off)
    crc, length = payloads.scan(text.tobytes(), starts, ends)
    n_words = np.diff(word_off)
    row = np.repeat(np.arange(len(n_words)), n_words)
    made, rows = [], []
    run = crc
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    for n in range(1, max_n + 1):
        if n > 1:  # the run of n - 1 words from here, a space, the word after it
            last = len(crc) - n + 1
            if last <= 0:
                break
            run = joined(joined(run[:last], space[:last], np.ones(last, np.int64)), crc[n - 1:], length[n - 1:])
        if n >= min_n:
            whole = row[: len(run)] == row[n - 1:]
            made.append(run[whole] % np.uint32(buckets))
            rows.append(row[: len(run)][whole])
    bucket, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (made, rows))
    order = np.argsort(of, kind="stable")
    return n_words, bucket[order].astype(np.int32), np.searchsorted(of[order], np.arange(len(off)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for _, _, buf, off in tk.pieces(*tk.utf8(b.column(0))):
            text, *_ = normalised(buf, off)
            seen.update(w for w in text.tobytes().split() if len(w) <= WORD_BYTES)
            if len(seen) > 8 * DICTIONARY:
                seen = Counter(dict(seen.most_common(2 * DICTIONARY)))
    top = seen.most_common(DICTIONARY)
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])


def dictionary(docs: DataFrame, text_col: str) -> list[bytes]:
    """The frequent words of about FIT_DOCS rows, at most DICTIONARY."""
    texts = docs.select(text_col)
    rows = docs.count()
    sample = texts.sample(min(1.0, FIT_DOCS / rows), seed=1) if rows else texts
    counts = sample.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()]


_BUILT: dict[str, Payloads] = {}


def _payloads(key: str, words) -> Payloads:
    """One automaton a worker process."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Payloads(words.value)
    return _BUILT[key]


def _feature_rows(key: str, words, min_n: int, max_n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = _payloads(key, words)
        for b in batches:
            buf, off = tk.utf8(b.column("text"))
            for i, j, piece, o in tk.pieces(buf, off):
                n_words, bucket, at = features(payloads, piece, o, min_n, max_n, buckets)
                yield pa.RecordBatch.from_arrays([b.column("ord").slice(i, j - i), b.column("tk").slice(i, j - i), pa.array(n_words.astype(np.int64)),
                                                  pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bucket))], names=["ord", "tk", "n_words", "buckets"])
    return run


def feature_table(docs: DataFrame, id_col: str, text_col: str, words, key: str, min_n: int, max_n: int, buckets: int) -> DataFrame:
    """A written table (ord, tk, n_words, buckets) of each row."""
    src = docs.select(*key_columns(id_col, text_col), F.col(text_col).alias("text"))
    return written(src.mapInArrow(_feature_rows(key, words, min_n, max_n, buckets), "ord long, tk long, n_words long, buckets array<int>"), "features")


# ---- counts, gains, scores -------------------------------------------------------------

def _bucket_vectors(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])
    return run


def bucket_counts(table: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows fall into each bucket."""
    out = np.zeros(buckets, np.int64)
    for r in table.select("buckets").mapInArrow(_bucket_vectors(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    buckets = len(source)
    s_all, t_all = float(int(source.sum()) + buckets), float(int(target.sum()) + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """floor(1000 * Gumbel noise) of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score_rows(gain, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("buckets")
            off = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(gain.value[lists.flatten().to_numpy(zero_copy_only=False)])))
            weight = total[off[1:]] - total[off[:-1]]
            luck = np.array([noise(seed, None if i == NULL_ID else i) for i in b.column("ord").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("ord"), b.column("tk"), b.column("n_words"), pa.array(np.diff(off)), pa.array(weight), pa.array(weight + luck)],
                                             names=["ord", "tk", "n_words", "n_features", "weight", "score"])
    return run


def ranked(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", min_n: int = 1, max_n: int = 1,
           buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(ord, tk, n_words, n_features, weight, score, rank) of each row; rank is null where the row is not drawn."""
    spark = docs.sparkSession
    known = dictionary(docs, text_col)
    words, key = spark.sparkContext.broadcast(known), hashlib.sha256(b" ".join(known)).hexdigest()
    table = feature_table(docs, id_col, text_col, words, key, min_n, max_n, buckets)
    wanted = feature_table(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "id", "text", words, key, min_n, max_n, buckets)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(table, buckets), bucket_counts(wanted, buckets)))
    scored = written(table.mapInArrow(_score_rows(gain, seed), "ord long, tk long, n_words long, n_features long, weight long, score long"), "scored")
    long_enough = F.col("n_words") >= least_words
    draws = scored.where(long_enough).count() * percent // 100
    placed = numbered(scored, "nth", long_enough.desc(), F.col("score").desc(), F.col("ord"))  # long enough texts come first
    return placed.select("ord", "tk", "n_words", "n_features", "weight", "score", F.when(F.col("nth") <= draws, F.col("nth")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row."""
    return ranked(docs, target, id_col, text_col, **options).select(F.when(F.col("ord") != NULL_ID, F.col("ord")).alias(id_col), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn; repeated rows, whose scores are the same, all come if one of them is drawn."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_id, own_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    plain = docs.toDF(*names)
    drawn = ranked(plain, target, own_id, own_text, **options).where("rank is not null").select("ord", "tk").distinct()
    return plain.select("*", *key_columns(own_id, own_text)).join(drawn, ["ord", "tk"], "left_semi").select(*names).toDF(*docs.columns)
