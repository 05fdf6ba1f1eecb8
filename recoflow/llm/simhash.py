"""Document fingerprints: SimHash, and permuted block tables that find all fingerprints within a Hamming radius.

Terms of a text are its words (no white space, A-Z lower-cased) and its pairs of neighbouring words. A term's weight is that of its length
(WEIGHTS) times 1 + floor(log2 of its number of occurrences): whole numbers, so equal texts have equal fingerprints everywhere. Each term
votes with its weight on the sign of BITS bits of its hash; a fingerprint has the bits with a positive sum. Likeness is the
cosine that the share of differing bits stands for, between 0 (at a right angle or beyond) and 1.

Method of the search: a fingerprint is cut into BLOCKS blocks. Of two fingerprints within RADIUS bits, at least BLOCKS - RADIUS blocks are
equal, so one of the tables, each sorted by a permutation that brings BLOCKS - RADIUS chosen blocks to the front, holds both under one key.
Tables are made of a block of queries (at most about QUERY_BLOCK fingerprints, broadcast); all fingerprints pass by them map-side. A pair is counted
in the table of its first equal blocks only, so once. Nothing is shuffled but a count for each query and task; a crowded key
costs time, in tiles, not memory.

Edited texts need the next document in the order of descending id (null last; then by the text's hash): range partitions are sorted, and
only the first and last text of each partition meet across partitions.

Scale: texts are shuffled once, into ranges; equal rows are spread over ranges by their row number. Fingerprints of equal texts act as one in the
search, with their number.

Cases: null text is empty; texts without a word have the fingerprint of no bits, like each other (1) and no other text (0); very long texts
are processed whole; an only row is its own next document; repeated rows are next documents of each other; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm import textkit as tk
from recoflow.llm.shared import NULL_ID, in_order, key_columns, written

#: Weights of words and pairs of words.
WEIGHTS = (1, 3)
BITS = 128
RADIUS = 6
BLOCKS = 8
QUERY_BLOCK = 1 << 17
#: Candidate pairs looked at together.
TILE = 1 << 21
_WORD = tk.byte_class("space")
_SALT = [tk.times(k + 1, 0x632BE59BD9B4E019) for k in range(BITS // 64)]
#: Sign of each bit of a byte, highest first.
_SIGNS = 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) - 1


# ---- fingerprints ----------------------------------------------------------------------

def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of each distinct term of the texts of a piece."""
    buf = tk.LOWER[buf]
    starts, ends, word_off = tk.word_spans(buf, off, _WORD)
    words = tk.span_hashes(buf, starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(word_off))
    rows, hashes, weights = [], [], []
    for n, weight in enumerate(WEIGHTS, 1):
        if len(words) < n:
            break
        runs = words if n == 1 else tk.shingles(words, n)
        whole = row[: len(runs)] == row[n - 1:]
        of, h = row[: len(runs)][whole], runs[whole]
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        if not len(h):
            continue
        head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1]))))
        times = np.diff(np.append(head, len(h)))
        rows.append(of[head])
        hashes.append(h[head])
        weights.append(weight * (1 + np.log2(times).astype(np.int64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(weights)


def _votes(row: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints, as BITS // 8 bytes a row."""
    out = np.zeros((n, BITS // 8), np.uint8)
    size = 2048  # rows together: the sums by byte value stay small
    order = np.argsort(row, kind="stable")
    row, hashes, weights = row[order], hashes[order], weights[order].astype(np.float64)  # sums of whole numbers, exact below 2**53
    for a in range(0, n, size):
        i, j = np.searchsorted(row, (a, a + size))
        if i == j:
            continue
        m, of = min(size, n - a), (row[i:j] - a) * 256
        for k, salt in enumerate(_SALT):
            octets = tk.mix(hashes[i:j] ^ salt).view(np.uint8).reshape(-1, 8)
            for b in range(8):
                by_value = np.bincount(of + octets[:, b], weights[i:j], minlength=m * 256).reshape(m, 256)
                out[a: a + m, 8 * k + b] = np.packbits(by_value @ _SIGNS > 0, axis=1)[:, 0]
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text, as rows of BITS // 64 numbers of 64 bits."""
    buf_all, off_all = tk.utf8(column)
    parts = [_votes(*_terms(buf, off), j - i) for i, j, buf, off in tk.pieces(buf_all, off_all)]
    return np.concatenate(parts).view(np.uint64) if parts else np.zeros((0, BITS // 64), np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between 0 and 1, of rows of fingerprints."""
    differing = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)
    empty = (a == 0).all(axis=1) ^ (b == 0).all(axis=1)
    return np.where(empty, 0.0, np.maximum(0.0, np.cos(np.pi * differing / BITS)))


def _hex(prints: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in prints]


# ---- edited texts ----------------------------------------------------------------------

def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many first characters of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


#: Rows between partitions: 0 a whole result, 1 the last text of a partition, which waits for its next one, 2 the first text of a partition.
DONE, OPEN, HEAD = 0, 1, 2
_PARTS = [f"f{k}" for k in range(BITS // 64)]
_JUDGED = "kind int, part long, ord long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string, " \
    + ", ".join(f"{c} long" for c in _PARTS)
_NAMES = [f.split()[0] for f in _JUDGED.split(", ")]


def _judged(ords: list[int], texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> pa.RecordBatch:
    """Whole results of texts with their next ones."""
    made = [edited(t, u) for t, u in zip(texts, following)]
    edited_prints = fingerprints(pa.array(made, pa.string()))
    n = len(made)
    return pa.RecordBatch.from_arrays([
        pa.array([DONE] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(ords, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in made], pa.string()), pa.array(_hex(prints), pa.string()), pa.array(_hex(edited_prints), pa.string()),
        pa.array(likeness(prints, edited_prints)), pa.array(likeness(prints, next_prints)), pa.nulls(n, pa.string()),
        *(pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(len(_PARTS)))], names=_NAMES)


def _between(kind: int, part: int, ord_: int, text: str) -> pa.RecordBatch:
    values = dict(kind=kind, part=part, ord=ord_, text=text)
    types = {"kind": pa.int32(), "part": pa.int64(), "ord": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()} | dict.fromkeys(_PARTS, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([values.get(c)], types.get(c, pa.string())) for c in _NAMES], names=_NAMES)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ord, text) of a sorted partition: results of all but the last, which is left open; the first text for the partition before."""
    part = TaskContext.get().partitionId()
    held: tuple[list[int], list[str], np.ndarray] | None = None
    for b in batches:
        buf, off = tk.utf8(b.column(1))
        for i, j, _, _ in tk.pieces(buf, off):
            texts = [t or "" for t in b.column(1).slice(i, j - i).to_pylist()]
            ords, prints = b.column(0).slice(i, j - i).to_pylist(), fingerprints(pa.array(texts, pa.string()))
            if held is None:
                yield _between(HEAD, part, ords[0], texts[0])
            else:
                ords, texts, prints = held[0] + ords, held[1] + texts, np.concatenate((held[2], prints))
            if len(ords) > 1:
                yield _judged(ords[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
            held = ords[-1:], texts[-1:], prints[-1:]
    if held is not None:
        yield _between(OPEN, part, held[0][0], held[1][0])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ord, text, following)."""
    for b in batches:
        texts, following = b.column(1).to_pylist(), b.column(2).to_pylist()
        if texts:
            yield _judged(b.column(0).to_pylist(), texts, fingerprints(pa.array(texts, pa.string())), following, fingerprints(pa.array(following, pa.string())))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of the columns of _JUDGED, a row for each row of ``docs``."""
    spark = docs.sparkSession
    src = docs.select(*key_columns(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = written(in_order(src, F.col("ord").desc(), F.col("tk")).select("ord", "text").mapInArrow(_with_next, _JUDGED), "with-next")
    parts = sorted(r.part for r in table.where(F.col("kind") == OPEN).select("part").collect())  # a row a partition
    after = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part long, next long")
    heads = table.where(F.col("kind") == HEAD).select(F.col("part").alias("next"), F.col("text").alias("following"))
    last = table.where(F.col("kind") == OPEN).join(F.broadcast(after), "part").select("next", "ord", "text").join(heads, "next")
    return table.where(F.col("kind") == DONE).unionByName(last.select("ord", "text", "following").mapInArrow(_closed, _JUDGED))


# ---- search by permuted block tables -----------------------------------------------------

class BlockTables:
    """The tables of some fingerprints: each is sorted by the blocks that its permutation brings to the front."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        if not 0 <= radius < blocks or BITS % (8 * blocks):
            raise ValueError("more blocks than the radius, of whole bytes")
        self.prints, self.radius, self.blocks = prints, radius, blocks
        self.width = BITS // 8 // blocks
        self.chosen = list(itertools.combinations(range(blocks), blocks - radius))
        self.tables = []
        for c in self.chosen:
            keys = self._keys(prints, c)
            order = np.argsort(keys, kind="stable").astype(np.int32)
            self.tables.append((keys[order], order))

    def _keys(self, prints: np.ndarray, chosen: tuple[int, ...]) -> np.ndarray:
        octets = prints.view(np.uint8).reshape(len(prints), self.blocks, self.width)[:, chosen].reshape(len(prints), len(chosen) * self.width)
        if octets.shape[1] <= 8:
            wide = np.zeros((len(prints), 8), np.uint8)
            wide[:, : octets.shape[1]] = octets
            return wide.view(np.uint64).ravel()
        code = np.zeros(len(prints), np.uint64)  # longer keys meet by their hash; the distance decides
        for k in range(octets.shape[1]):
            code = tk.mix(code * tk.BASE + octets[:, k].astype(np.uint64))
        return code

    def near(self, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of an own, index of an other) of all pairs within the radius, each once, in tiles."""
        for chosen, (keys, order) in zip(self.chosen, self.tables):
            theirs = self._keys(others, chosen)
            lo, hi = np.searchsorted(keys, theirs, "left"), np.searchsorted(keys, theirs, "right")
            some = np.flatnonzero(hi > lo)
            lo, n = lo[some], (hi - lo)[some]
            end = np.cumsum(n)
            total = int(end[-1]) if len(end) else 0
            for a in range(0, total, TILE):
                nth = np.arange(a, min(a + TILE, total))
                at = np.searchsorted(end, nth, "right")
                own, other = order[lo[at] + nth - (end[at] - n[at])], some[at]
                differ = self.prints[own] ^ others[other]
                ok = np.bitwise_count(differ).sum(axis=1) <= self.radius
                own, other, differ = own[ok], other[ok], differ[ok]
                equal = (differ.view(np.uint8).reshape(len(differ), self.blocks, self.width) == 0).all(axis=2)
                # the table of the first equal blocks
                first = equal & (np.cumsum(equal, axis=1) <= self.blocks - self.radius)
                mine = first[:, chosen].all(axis=1)
                yield own[mine], other[mine]


def _count_near(queries, radius: int, blocks: int):
    """For each query of the block the rows (of ``n``) within the radius: one row a query and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = queries.value
        tables, n = BlockTables(prints, radius, blocks), np.zeros(len(prints), np.int64)
        for b in batches:
            others = np.stack([b.column(f"f{k}").to_numpy() for k in range(BITS // 64)], axis=1).view(np.uint64)
            weight = b.column("n").to_numpy()
            for own, other in tables.near(np.ascontiguousarray(others)):
                np.add.at(n, own, weight[other])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(prints[some, k]).view(np.int64)) for k in range(BITS // 64)), pa.array(n[some])], names=[*_PARTS, "n"])
    return run


def near_counts(rows: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(f0, f1, n): for each distinct fingerprint (f0, f1) of ``queries`` the number of rows of ``rows`` within the radius."""
    spark = rows.sparkSession
    base = written(rows.groupBy(*_PARTS).agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    asked = written(queries.select(*_PARTS).distinct(), "asked")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    part = F.pmod(F.xxhash64(*_PARTS), F.lit(n_blocks))
    out = None
    for k in range(n_blocks):
        prints = asked.where(part == k).toPandas().to_numpy(np.int64).reshape(-1, len(_PARTS)).view(np.uint64)  # about QUERY_BLOCK rows
        found = base.mapInArrow(_count_near(spark.sparkContext.broadcast(np.ascontiguousarray(prints)), radius, blocks), ", ".join(f"{c} long" for c in [*_PARTS, "n"]))
        found = written(found.groupBy(*_PARTS).agg(F.sum("n").alias("n")), "near")
        out = found if out is None else out.unionByName(found)
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 100) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) of each row; n_near is the number of other rows
    with a fingerprint within RADIUS bits, for the queries of the search: rows whose id is divisible by ``every`` (else null)."""
    table = written(with_next(docs, id_col, text_col).drop("kind", "part", "text"), "fingerprinted")
    asked = (F.col("ord") != NULL_ID) & (F.col("ord") % every == 0)
    found = near_counts(table, table.where(asked)).withColumnRenamed("n", "rows_near")
    both = table.select("*", asked.alias("asked"))
    out = both.where("asked").join(found, _PARTS).withColumn("n_near", F.col("rows_near") - 1).drop("rows_near") \
        .unionByName(both.where("not asked").withColumn("n_near", F.lit(None).cast("long")))
    return out.select(F.when(F.col("ord") != NULL_ID, F.col("ord")).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                      "near_next", "n_near")
