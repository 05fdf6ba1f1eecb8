"""Alignment of two tokenizers: groups of tokens between common cuts, linked id pairs and their document counts.

A text is encoded by a byte-level vocabulary (A, of space + text) and by a piece vocabulary (B, which adds the space
itself), without special tokens. Byte offsets where tokens of both end cut the tokens into groups; every A-B pair of
occurrences in a group is a link. An id pair counts the documents (rows) that hold it linked.

Method: identity-map fast path. ``identity[a]`` is the B id with the same bytes as A id a (-1: none). Pairs (a, identity[a]),
which is what an exact one-to-one group gives, are counted in vectors of the length of the vocabulary, one a task; only the other
pairs, of irregular groups, are counted by a shuffle, a row for each pair and document, combined map-side. In the
second step the pairs that most documents hold (at most HOT_PAIRS, whatever the corpus holds) and the vectors are broadcast;
links to other pairs, each of which few documents hold, meet their counts in a join and are added up per row.

Segments. Both vocabularies cut before a single space between two visible characters: the pattern of A starts a
pre-token there, and no piece of B holds a space after another character (checked when the vocabulary is loaded; otherwise texts stay
whole). So each segment is aligned by itself; workers keep the results of up to CACHE segments that repeat. New Latin segments go through A
joined, in one call on the same vocabulary's ranks; all others through the tokenizers file one by one.

Scale: one pass over the texts. Memory is bounded by the cache, the piece and the longest text; a group of very many tokens is
counted by its distinct ids, not by its occurrences. The driver gets vectors of the vocabulary's length and HOT_PAIRS pairs at most.

Cases: null or empty text, and texts that B does not give back (such as those with U+2581), have no tokens: zeros and an
empty ``groups_sha256``; very long texts are processed whole; repeated rows are documents of their own and give repeated
results; ties for an id's highest count all count as best; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import textkit as tk
from recoflow.llm.bpe import byte_symbols, tokenizer_path
from recoflow.llm.shared import written
from recoflow.llm.token_counts import PATTERN

CACHE = 200_000
CACHE_BYTES = 128
HOT_PAIRS = 1 << 18
#: Groups with more links are counted by distinct ids.
WIDE = 4096
SHIFT = 20  # a pair is (a << SHIFT) | b
SPACE_MARK = "▁"
#: Last lead byte of the letters up to U+024F.
LATIN = 0xC9
#: One aligned segment: numbers of A tokens, B tokens, groups, links (-1: B does not give it back), its groups in text, pairs, links of each (None: one each).
Segment = tuple[int, int, int, int, bytes, bytes, bytes | None]
#: Many: rows of the four numbers, texts, numbers of pairs, pairs and links of all.
Segments = tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]


def _visible() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that may stand before a cut (the last of a character), and after one: no white space among their characters."""
    before, after = np.zeros(256, bool), np.zeros(256, bool)
    before[0x21:0x7F] = after[0x21:0x7F] = True
    after[0xC3:0xE0] = True  # two-byte letters; the character before a cut is looked at in ``cuts``
    return before, after


_BEFORE, _AFTER = _visible()


def _ends_visibly(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the characters before these positions are visible."""
    left, lead = text[ends - 1], text[np.maximum(ends - 2, 0)]
    return _BEFORE[left] | ((left >= 0x80) & (lead >= 0xC3) & (lead < 0xE0))


def cuts(text: np.ndarray) -> np.ndarray:
    """Positions of single spaces between two visible characters."""
    at = np.flatnonzero(text[1:-1] == 0x20) + 1
    return at[_ends_visibly(text, at) & _AFTER[text[at + 1]]]


class Aligner:
    """Both vocabularies, and the segments aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        bytes_a = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in symbols for c in t)}
        self.n_a = 1 + max([*bytes_a, *(t["id"] for t in spec["added_tokens"])])
        self.bytes_a = [bytes_a.get(i, b"") for i in range(self.n_a)]
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={x: i for i, x in bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.cuttable = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # each token's text before a comma and before the mark that ends its side of a group: A, A last, B, B last
        self.texts = [f"{i}{end}".encode() for size, marks in ((self.n_a, ",|"), (len(pieces), ",;")) for end in marks for i in range(size)]
        self.cache: dict[bytes, Segment] = {}

    @cached_property
    def identity(self) -> np.ndarray:
        """For each A id the B id of the same bytes, -1 where there is none; a real piece goes before a byte of the fallback."""
        by_bytes = {}
        for i in sorted(range(len(self.bytes_b)), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                by_bytes.setdefault(self.bytes_b[i], i)
        return np.array([by_bytes.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)

    def _learn(self, segments: list[bytes], joinable: int) -> Segments:
        """The first ``joinable`` segments may stand after one another in a text with certain cuts between, and are of Latin letters."""
        ends = np.cumsum([len(s) for s in segments])
        x = np.array(self.ranks.encode_ordinary(b"".join(segments[:joinable]).decode()), np.int64)
        off_a = np.searchsorted(np.cumsum(self.len_a[x]), ends[:joinable], "right")
        texts = [s.decode("utf-8") for s in segments]
        others = [e.ids for e in self.a.encode_batch_fast(texts[joinable:], add_special_tokens=False)]
        off_a = np.concatenate(([0], off_a, len(x) + np.cumsum([len(i) for i in others]))).astype(np.int64)
        x = np.concatenate((x, np.fromiter(chain.from_iterable(others), np.int64)))
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        y = np.fromiter(chain.from_iterable(ids_b), np.int64)
        off_b = np.concatenate(([0], np.cumsum([len(i) for i in ids_b])))
        # given back: the same bytes, cut at the same places
        raw = b"".join(segments)
        sizes = [np.concatenate(([0], np.cumsum(n[ids])))[off[1:]] for n, ids, off in ((self.len_a, x, off_a), (self.len_b, y, off_b))]
        if all((z == ends).all() for z in sizes) and raw == b"".join([self.bytes_a[i] for i in x.tolist()]) and raw == b"".join([self.bytes_b[i] for i in y.tolist()]):
            return self.align(x, y, off_a, off_b)
        good = np.array([all(b"".join([own[i] for i in ids[off[k]: off[k + 1]].tolist()]) == s for own, ids, off in ((self.bytes_a, x, off_a), (self.bytes_b, y, off_b)))
                         for k, s in enumerate(segments)])
        numbers, in_text, n_pairs = np.zeros((len(segments), 4), np.int64), [b""] * len(segments), np.zeros(len(segments), np.int64)
        numbers[:, 3] = -1
        pairs = links = _NONE
        if good.any():
            lengths_a, lengths_b = np.diff(off_a), np.diff(off_b)
            keep_a, keep_b = np.repeat(good, lengths_a), np.repeat(good, lengths_b)
            made, made_text, made_n, pairs, links = self.align(x[keep_a], y[keep_b], *(np.concatenate(([0], np.cumsum(n[good]))) for n in (lengths_a, lengths_b)))
            numbers[good], n_pairs[good] = made, made_n
            for k, t in zip(np.flatnonzero(good).tolist(), made_text):
                in_text[k] = t
        return numbers, in_text, n_pairs, pairs, links

    def align(self, x: np.ndarray, y: np.ndarray, off_a: np.ndarray, off_b: np.ndarray) -> Segments:
        """Groups, links and pairs of segments, of the same bytes in A and B; all are worked on together, as every segment's end is a common cut."""
        n = len(off_a) - 1
        ends_a, ends_b = np.cumsum(self.len_a[x]), np.cumsum(self.len_b[y])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        # the tokens' texts, group after group, A before B
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        code = np.empty(len(x) + len(y), np.int64)
        code[np.arange(len(x)) + first_b[group_a]] = x + last_a * self.n_a
        code[np.arange(len(y)) + (first_a + in_a)[group_b]] = 2 * self.n_a + y + last_b * len(self.bytes_b)
        parts, off = [self.texts[c] for c in code.tolist()], (off_a + off_b).tolist()
        # links: every A with every B token of a group
        links = in_a * in_b
        of_group = np.searchsorted(off_a, first_a, "right") - 1  # the group's segment
        small = np.flatnonzero(links <= WIDE)
        each = np.repeat(small, links[small])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        pairs = x[first_a[each] + nth // in_b[each]] << SHIFT | y[first_b[each] + nth % in_b[each]]
        seg, times = of_group[each], np.ones(len(each), np.int64)
        wide = np.flatnonzero(links > WIDE)
        for g in wide:
            ua, ca = np.unique(x[first_a[g]: first_a[g] + in_a[g]], return_counts=True)
            ub, cb = np.unique(y[first_b[g]: first_b[g] + in_b[g]], return_counts=True)
            pairs = np.append(pairs, ((ua[:, None] << SHIFT) | ub[None]).ravel())
            times = np.append(times, (ca[:, None] * cb[None]).ravel())
            seg = np.append(seg, np.full(len(ua) * len(ub), of_group[g]))
        if len(wide):
            order = np.argsort(seg, kind="stable")
            pairs, times = pairs[order], times[order]
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, of_group, links)
        numbers = np.stack((np.diff(off_a), np.diff(off_b), np.bincount(of_group, minlength=n), n_links), axis=1)
        return numbers, [b"".join(parts[p:q]) for p, q in zip(off[:-1], off[1:])], np.bincount(seg, minlength=n), pairs, times

    def _known(self, segments: list[bytes], joinable: np.ndarray, times: np.ndarray):
        """The four numbers, texts, numbers of pairs and places of the pairs of distinct segments; those that occur again are kept."""
        got = list(map(self.cache.get, segments))
        old, new = [k for k, g in enumerate(got) if g is not None], [k for k, g in enumerate(got) if g is None]
        numbers, in_text, n_pairs = np.zeros((len(got), 4), np.int64), [b""] * len(got), np.zeros(len(got), np.int64)
        numbers[old] = np.array([got[k][:4] for k in old], np.int64).reshape(-1, 4)
        n_pairs[old] = [len(got[k][5]) // 8 for k in old]
        pairs, links = [np.frombuffer(b"".join([got[k][5] for k in old]), np.int64)], [np.ones(int(n_pairs[old].sum()), np.int64)]
        at = np.cumsum(n_pairs[old]) - n_pairs[old]
        for k, a in zip(old, at.tolist()):
            in_text[k] = got[k][4]
            if got[k][6] is not None:
                links[0][a: a + n_pairs[k]] = np.frombuffer(got[k][6], np.int64)
        for i in range(0, len(new), 20_000):
            part = sorted(new[i: i + 20_000], key=lambda k: not joinable[k])
            new[i: i + 20_000] = part
            made, texts, n, p, w = self._learn([segments[k] for k in part], int(joinable[part].sum()))
            numbers[part], n_pairs[part] = made, n
            pairs.append(p)
            links.append(w)
            off = np.concatenate(([0], np.cumsum(n))).tolist()
            if len(self.cache) + len(part) > CACHE:
                self.cache.clear()
            for j, k in enumerate(part):
                in_text[k] = texts[j]
                if times[k] > 1 and len(segments[k]) <= CACHE_BYTES:
                    own = w[off[j]: off[j + 1]]
                    self.cache[segments[k]] = (*made[j].tolist(), texts[j], p[off[j]: off[j + 1]].tobytes(), None if (own == 1).all() else own.tobytes())
        place = np.empty(len(got), np.int64)
        order = np.array(old + new, np.int64)
        place[order] = np.cumsum(n_pairs[order]) - n_pairs[order]
        return numbers, in_text, n_pairs, place, np.concatenate(pairs), np.concatenate(links)

    def piece(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts of a piece: a row of numbers (A tokens, B tokens, groups, links), the groups in text, and their distinct pairs with
        the text that holds them (row, pair, links), sorted."""
        lengths = np.diff(off)
        numbers, texts = np.zeros((len(lengths), 4), np.int64), [b""] * len(lengths)
        rows = np.flatnonzero(lengths)
        if not len(rows):
            return numbers, texts, _NONE, _NONE, _NONE
        # a space before each text that is not empty
        begin = off[:-1][rows] + np.arange(len(rows))
        text = np.full(len(buf) + len(rows), 0x20, np.uint8)
        inner = np.ones(len(text), bool)
        inner[begin] = False
        text[inner] = buf
        spots = cuts(text) if self.cuttable else _NONE
        starts = np.union1d(spots, begin).astype(np.int64)
        ends = np.append(starts[1:], len(text))
        _, first, kind = np.unique(tk.span_hashes(text, starts, ends), return_index=True, return_inverse=True)
        raw = text.tobytes()
        segments = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        joinable = (np.maximum.reduceat(text, starts) <= LATIN) & (ends - starts > 1) & _ends_visibly(text, ends) & _AFTER[text[np.minimum(starts + 1, len(text) - 1)]]
        of_kind, in_text, n_pairs, pair_off, all_pairs, all_links = self._known(segments, joinable[first], np.bincount(kind))
        place = np.searchsorted(starts, begin)
        row = np.repeat(rows, np.diff(np.append(place, len(starts))))
        lost = np.zeros(len(lengths), bool)
        lost[row[of_kind[kind, 3] < 0]] = True
        numbers[rows] = np.add.reduceat(of_kind[kind], place, axis=0)
        numbers[lost] = 0
        for r, a, b in zip(rows.tolist(), place.tolist(), [*place[1:].tolist(), len(starts)]):
            if not lost[r]:
                texts[r] = b"".join([in_text[k] for k in kind[a:b].tolist()])
        # each text's segments once, with their number
        mine = row[~lost[row]] * len(segments) + kind[~lost[row]]
        mine, times = np.unique(mine, return_counts=True)
        row, kind = np.divmod(mine, len(segments))
        n = n_pairs[kind]
        spot = np.arange(n.sum()) + np.repeat(pair_off[kind] - (np.cumsum(n) - n), n)
        return numbers, texts, *_summed(np.repeat(row, n), all_pairs[spot], all_links[spot] * np.repeat(times, n))


@cache
def shared_aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner a worker process: it outlives the task, and so do the segments it knows."""
    return Aligner(path_a, path_b)


_NONE = np.zeros(0, np.int64)


def _summed(rows: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key), sorted, and the sum of their values."""
    if not len(keys):
        return rows, keys, values
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    head = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]))))
    return rows[head], keys[head], np.add.reduceat(values[order], head)


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_links", "pairs", "links"]
_TABLE_SQL = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_links array<long>, pairs array<long>, links array<long>"


def _align_rows(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared_aligner(path_a, path_b)
        identity = aligner.identity
        for b in batches:
            buf, off = tk.utf8(b.column("text"))
            for i, j, piece, o in tk.pieces(buf, off):
                numbers, texts, row, pairs, links = aligner.piece(piece, o)
                a = pairs >> SHIFT
                same = identity[a] == pairs - (a << SHIFT)

                def lists(values, which, kind):
                    at = np.searchsorted(row[which], np.arange(j - i + 1)).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(at), pa.array(values[which]).cast(kind))

                digests = [hashlib.sha256(t[:-1]).hexdigest() if t else "" for t in texts]
                made = [*(pa.array(numbers[:, c]) for c in range(4)), pa.array(digests, pa.string()), lists(a, same, pa.int32()), lists(links, same, pa.int64()),
                        lists(pairs, ~same, pa.int64()), lists(links, ~same, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, j - i), b.column("id").slice(i, j - i), *made], names=["row", "id", *_COLUMNS])
    return run


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_a: str = "byte_bpe_50k.json",
               tokenizer_b: str = "piece_bpe_32k.model") -> DataFrame:
    """A written table with a row for each row of ``docs``: row (a number of its own), id, the numbers of tokens, groups and links, the groups'
    digest, and its distinct pairs with their links: ``same`` (A ids of identity pairs) and ``pairs`` (the others)."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(src.mapInArrow(_align_rows(tokenizer_path(tokenizer_a), tokenizer_path(tokenizer_b)), f"row long, id long, {_TABLE_SQL}"), "alignments")


def _identity_vectors(size: int):
    """One vector a task: documents of each A id's identity pair (a document holds it once)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        a = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n[a])], names=["a", "n"])
    return run


def pair_counts(aligned: DataFrame, vocabulary: int) -> tuple[np.ndarray, DataFrame]:
    """Documents of each A id's identity pair (a vector), and a written table (pair, n) of the other pairs."""
    counted = aligned.select("same").mapInArrow(_identity_vectors(vocabulary), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    same = np.zeros(vocabulary, np.int64)
    for r in counted.collect():  # at most one row an A id
        same[r.a] = r.n
    pairs = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return same, written(pairs, "pair-counts")


def _highest(same: np.ndarray, pairs: DataFrame) -> np.ndarray:
    """The highest count of each A id over all its pairs."""
    best = same.copy()
    for r in pairs.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("n")).collect():  # at most one row an A id
        best[r.a] = max(best[r.a], r.n)
    return best


def _hot_bound(pairs: DataFrame, limit: int) -> tuple[int, bool]:
    """The least count such that at most ``limit`` pairs reach it (a power of two), and whether other pairs are left."""
    sizes = {r.e: r.n for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 64 rows
    bound, held = max(sizes, default=0) + 1, 0
    while bound and held + sizes.get(bound - 1, 0) <= limit:
        bound -= 1
        held += sizes.get(bound, 0)
    return 1 << bound, bound > 0


def _scored(same, best, hot_pairs, hot_n):
    """Links to broadcast pairs are added up; the others go on as lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_same, n_best = same.value, best.value
        keys, counts = hot_pairs.value, hot_n.value

        def per_row(values, off):
            total = np.concatenate(([0], np.cumsum(values)))
            return total[off[1:]] - total[off[:-1]]

        for b in batches:
            def column(name):
                c = b.column(name)
                return c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)

            a, off = column("same")
            links, _ = column("same_links")
            total = per_row(n_same[a] * links, off)
            top = per_row(np.where(n_same[a] == n_best[a], links, 0), off)
            pairs, off = column("pairs")
            links, _ = column("links")
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n = np.where(known, counts[at] if len(keys) else 0, 0)
            total += per_row(n * links, off)
            top += per_row(np.where(known & (n == n_best[pairs >> SHIFT]), links, 0), off)
            rest = np.concatenate(([0], np.cumsum(~known)))[off].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "n_a", "n_b", "n_groups", "n_links")), pa.array(top), pa.array(total), b.column("groups_sha256"),
                                              pa.ListArray.from_arrays(pa.array(rest), pa.array(pairs[~known])), pa.ListArray.from_arrays(pa.array(rest), pa.array(links[~known]))],
                                             names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pairs", "links"])
    return run


_SCORED = "row long, id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, pairs array<long>, links array<long>"


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_a: str = "byte_bpe_50k.json",
                    tokenizer_b: str = "piece_bpe_32k.model", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    spark = docs.sparkSession
    aligned = alignments(docs, id_col, text_col, tokenizer_a, tokenizer_b)
    size = shared_aligner(tokenizer_path(tokenizer_a), tokenizer_path(tokenizer_b)).n_a
    same, pairs = pair_counts(aligned, size)
    best = _highest(same, pairs)
    bound, more = _hot_bound(pairs, hot_pairs)
    hot = pairs.where(F.col("n") >= bound).toPandas().sort_values("pair")  # at most hot_pairs rows
    send = spark.sparkContext.broadcast
    scored = aligned.mapInArrow(_scored(send(same), send(best), send(hot["pair"].to_numpy(np.int64)), send(hot["n"].to_numpy(np.int64))), _SCORED)
    own = ["n_a", "n_b", "n_groups", "n_links"]
    if not more:
        return scored.select(F.col("id").alias(id_col), *own, "n_best", "count_sum", "groups_sha256")
    # a pair of the rest is held by fewer documents than any broadcast one: no hot key is left
    scored = written(scored, "scored")
    tops = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a long, best long")  # at most one row an A id
    rare = pairs.where(F.col("n") < bound).withColumn("a", F.shiftright("pair", SHIFT)).join(F.broadcast(tops), "a") \
        .select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    links = scored.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    added = links.join(rare, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("links")).alias("more_sum"),
                                                        F.sum(F.when(F.col("top"), F.col("links")).otherwise(0)).alias("more_best"))
    return scored.join(added, "row", "left").select(
        F.col("id").alias(id_col), *own, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
