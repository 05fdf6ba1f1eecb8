"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Normalisation: A-Z lower-cased, words are runs of digits, letters and non-ASCII characters. A window is WINDOW consecutive
words of an item; an item of fewer words is one window. The automaton over item words accepts every run of words of
every item; streaming a document's words through it gives at each word the longest run ending there that is also a
run of an item. A window occurs where that length reaches the window's. Words in any occurrence are hit.

Most text shares no three words in a row with any item: a vectorised test of word trigrams (one- and two-word items: of the
whole item) finds the stretches that can hold a window, and only these are streamed, word by word as they
are, through the automaton. The test has no false negatives; the automaton decides on the words themselves.

Scale: documents are not shuffled. Items are dealt into shards of about SHARD_BYTES / 2 of text; each shard's automaton (bounded by
that) is built in a task, written as one row and broadcast; the driver passes on one packed automaton at a time and sees no item. A worker holds one
unpacked automaton: with one shard for the whole task, with more one after another over each CHUNK_BYTES of documents, and
the shards' spans are merged by document.

Cases: null or empty texts have no words; items without words never occur; repeated item rows count once; a null item_id
is written ``null``; null or repeated doc_ids are results of their own row; empty tables give empty or all-clean results;
extra columns are ignored by ``contamination`` and kept by ``clean_documents``, whatever their names; a text of any length is streamed whole; items with
the same windows are all named.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import textkit as tk
from recoflow.llm.shared import spent, written

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Text of documents that is held while several shards are streamed.
CHUNK_BYTES = 64 << 20
MAX_COVERAGE = 0.5
_WORD = tk.byte_class("alnum")
_BITS = 20


class SuffixAutomaton:
    """Of several word sequences. ``step`` keeps the state and length of the longest run that ends at the last word."""

    def __init__(self, items: dict[str, list[bytes]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], {}
        self._edges: list[dict[int, int]] = [{}]
        for words in items.values():
            last = 0
            for w in words:
                last = self._extend(last, self.words.setdefault(w, len(self.words)))
        self.size = len(self.words)
        for state, edges in enumerate(self._edges):
            for w, to in edges.items():
                self.next[state * self.size + w] = to
        del self._edges
        self.items: dict[tuple[int, int], list[str]] = {}  # (state, words of the window) -> items
        self.short: dict[int, list[int]] = {}
        for name, words in items.items():
            n = min(window, len(words))
            state = length = 0
            for w in words:
                state, length = self.step(state, length, w)
                if length >= n:
                    at = self.state_of(state, n)
                    names = self.items.setdefault((at, n), [])
                    if not names or names[-1] != name:
                        names.append(name)
                    if n < window:
                        lengths = self.short.setdefault(at, [])
                        if n not in lengths:
                            lengths.append(n)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self._edges.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the run of p followed by w: q itself, or a copy of q that holds only runs up to that length."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self._edges[q]))
        self.link[q] = copy
        while p != -1 and self._edges[p].get(w) == q:
            self._edges[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self._edges[last]:
            return self._split(last, w, self._edges[last][w])
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and w not in self._edges[p]:
            self._edges[p][w] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, w, self._edges[p][w])
        return new

    def step(self, state: int, length: int, word: bytes) -> tuple[int, int]:
        w = self.words.get(word)
        if w is None:
            return 0, 0
        while state:
            to = self.next.get(state * self.size + w)
            if to is not None:
                return to, length + 1
            state = self.link[state]
            length = self.length[state]
        to = self.next.get(w)
        return (0, 0) if to is None else (to, 1)

    def state_of(self, state: int, n: int) -> int:
        """The state that holds the last n words of a run that ends in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words in occurrences of windows, and the items that these windows belong to."""
        spans, found = [], set()
        state = length = 0
        for i, word in enumerate(words):
            state, length = self.step(state, length, word)
            if length >= self.window:
                names = self.items.get((self.state_of(state, self.window), self.window))
                if names:
                    spans.append((i + 1 - self.window, i + 1))
                    found.update(names)
            at = state
            while at and self.short:
                for n in self.short.get(at, ()):
                    if n <= length:
                        spans.append((i + 1 - n, i + 1))
                        found.update(self.items[at, n])
                at = self.link[at]
        return spans, found


class Filter:
    """The vectorised test: which stretches of words can hold a window."""

    def __init__(self, items: dict[str, list[bytes]], window: int):
        grams: dict[int, list[np.ndarray]] = {1: [], 2: [], 3: []}
        shortest = window
        for words in items.values():
            joined = np.frombuffer(b" ".join(words), np.uint8)
            starts, ends, _ = tk.word_spans(joined, np.array([0, len(joined)]), _WORD)
            h = tk.span_hashes(joined, starts, ends)
            q = min(3, len(words))
            grams[q].append(tk.shingles(h, q))
            if q == 3:
                shortest = min(shortest, len(words))
        self.grams = {q: np.unique(np.concatenate(x)) for q, x in grams.items() if x}
        self.least = shortest - 2
        self.bits = {}
        for q, g in self.grams.items():
            self.bits[q] = np.zeros(1 << _BITS, bool)
            self.bits[q][(g >> tk.U(64 - _BITS)).astype(np.int64)] = True

    def stretches(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends among the words; none crosses a row."""
        mark = np.zeros(len(hashes), bool)
        for q, known in self.grams.items():
            g = tk.shingles(hashes, q)
            hit = self.bits[q][(g >> tk.U(64 - _BITS)).astype(np.int64)]
            at = np.flatnonzero(hit)
            at = at[known[np.minimum(np.searchsorted(known, g[at]), len(known) - 1)] == g[at]]
            at = at[offsets[np.searchsorted(offsets, at, "right")] >= at + q]
            hit[:] = False
            hit[at] = True
            starts, ends = tk.runs(hit)
            if q == 3:
                long = ends - starts >= self.least
                starts, ends = starts[long], ends[long]
            if len(starts):
                mark |= tk.cover(len(hashes), starts, ends + q - 1)
        starts, ends = tk.runs(mark)
        # stretches of neighbouring rows touch: cut at the rows' ends
        cuts = np.unique(np.concatenate((starts, offsets[1:-1][mark[np.minimum(offsets[1:-1], max(len(mark) - 1, 0))]] if len(mark) else starts)))
        cuts = cuts[cuts < len(mark)]
        stops = ends[np.searchsorted(ends, cuts, "right")] if len(cuts) else cuts
        nexts = np.append(cuts[1:], len(mark)) if len(cuts) else cuts
        return cuts, np.minimum(stops, nexts)


def item_words(text: str | None) -> list[bytes]:
    buf = tk.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = tk.word_spans(buf, np.array([0, len(buf)]), _WORD)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends)]


def scan_texts(column: pa.Array, automaton: SuffixAutomaton, test: Filter):
    """(row, word spans hit, items) of the rows with hits; and n_words, with byte spans of the words by ``spans``."""
    buf_all, off_all = tk.utf8(column)
    n_words = np.zeros(len(off_all) - 1, np.int64)
    found = []
    for i, j, buf, off in tk.pieces(buf_all, off_all):
        buf = tk.LOWER[buf]
        starts, ends, wo = tk.word_spans(buf, off, _WORD)
        n_words[i:j] = np.diff(wo)
        if not len(starts) or not test.grams:
            continue
        begin, stop = test.stretches(tk.span_hashes(buf, starts, ends), wo)
        row_of = np.searchsorted(wo, begin, "right") - 1
        hits: dict[int, tuple[list, set]] = {}
        for row, a, b in zip(row_of.tolist(), begin.tolist(), stop.tolist()):
            spans, items = automaton.stream([buf[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b])])
            if spans:
                own = hits.setdefault(row, ([], set()))
                own[0].extend((x + a - int(wo[row]), y + a - int(wo[row])) for x, y in spans)
                own[1].update(items)
        for row, (spans, items) in hits.items():
            mask = tk.cover(int(n_words[i + row]), np.array([x for x, _ in spans]), np.array([y for _, y in spans]))
            words = slice(int(wo[row]), int(wo[row + 1]))
            found.append((i + row, list(zip(*(x.tolist() for x in tk.runs(mask)))), items,
                          starts[words] - off[row], ends[words] - off[row]))
    return n_words, found


def _automaton_row(shard: pa.Table) -> pa.Table:
    """The packed (automaton, test) of the items of one shard."""
    part: dict[str, list[bytes]] = {}
    rows = shard.sort_by([("item", "ascending"), ("text", "ascending")])
    for k, (item, text) in enumerate(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist())):
        words = item_words(text)
        if words:
            part[f"{item}\0{k}"] = words  # rows that share an id are items with one name
    return pa.table({"shard": rows.column("shard").slice(0, 1), "made": pa.array([_pack(part)], pa.binary())})


def _pack(part: dict[str, list[bytes]]) -> bytes:
    return zlib.compress(pickle.dumps((SuffixAutomaton(part, WINDOW), Filter(part, WINDOW))), 1)


def _unpack(made: bytes) -> tuple[SuffixAutomaton, Filter]:
    return pickle.loads(zlib.decompress(made))


def _shards(benchmark: DataFrame, id_col: str, text_col: str) -> list:
    """Broadcasts of packed (automaton, test), each of about SHARD_BYTES / 2 of items or of a single item."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")) \
        .where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(2 * total / SHARD_BYTES))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    made = written(dealt.groupBy("shard").applyInArrow(_automaton_row, "shard long, made binary"), "automata")
    out = []
    for shard in range(count):
        row = made.where(F.col("shard") == shard).first()
        if row is not None:
            out.append(spark.sparkContext.broadcast(bytes(row.made)))
    spent(made)
    return out or [spark.sparkContext.broadcast(_pack({}))]


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches in lists of about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scanned(batches: Iterator[pa.RecordBatch], column: int, shards: list) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    """Each batch with n_words and the rows found (see ``scan_texts``) of all shards; one unpacked shard at a time."""
    only = _unpack(shards[0].value) if len(shards) == 1 else None
    for chunk in _chunks(batches, CHUNK_BYTES if only is None else 1):
        found: list[list] = [[] for _ in chunk]
        n_words = [np.zeros(b.num_rows, np.int64) for b in chunk]
        for x in shards:
            made = only or _unpack(x.value)
            for k, b in enumerate(chunk):
                n_words[k], got = scan_texts(b.column(column), *made)
                found[k].extend(got)
            del made
        yield from zip(chunk, n_words, found)


def _names(items: set[str]) -> list[str]:
    return sorted({x.split("\0")[0] for x in items})


def _scan(names: list[str], text_col: str, shards: list):
    """Columns of the rows, n_words, hit word spans and items; every shard in turn over each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, n_words, found in _scanned(batches, names.index(text_col), shards):
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            for row, s, got, _, _ in found:
                spans.setdefault(row, []).extend(s)
                items.setdefault(row, set()).update(got)
            n_hit = np.zeros(b.num_rows, np.int64)
            ids = [[] for _ in range(b.num_rows)]
            for row, s in spans.items():
                n_hit[row] = tk.cover(int(n_words[row]), np.array([x for x, _ in s]), np.array([y for _, y in s])).sum()
                ids[row] = _names(items[row])
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
            keep = [c for c in names if c != text_col]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(names.index(c)) for c in keep), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(digests), pa.array(n_hit > 0), pa.array(ids, pa.list_(pa.string()))],
                names=[*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids) of each row."""
    src = docs.select(F.col(id_col), F.col(text_col).alias("text") if text_col != id_col else F.col(text_col))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(_scan(src.columns, "text", _shards(benchmark, item_col, item_text_col)),
                          f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>")


def _clean(names: list[str], text_col: str, shards: list, max_coverage: float):
    """Rows without the bytes from the first to the last word of each hit span; rows hit beyond max_coverage go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b, n_words, found in _scanned(batches, at, shards):
            hit: dict[int, list] = {}
            for row, s, _, starts, ends in found:
                hit.setdefault(row, []).append((s, starts, ends))
            if not hit:
                yield b
                continue
            buf, off = tk.utf8(b.column(at))
            texts = b.column(at).to_pylist()
            keep = np.ones(b.num_rows, bool)
            for row, parts in hit.items():
                starts, ends = parts[0][1:]
                mask = tk.cover(int(n_words[row]), *(np.array([x[k] for s, _, _ in parts for x in s]) for k in (0, 1)))
                if mask.mean() > max_coverage:
                    keep[row] = False
                    continue
                first, last = tk.runs(mask)
                gone = tk.cover(int(off[row + 1] - off[row]), starts[first], ends[last - 1])
                texts[row] = buf[off[row]: off[row + 1]][~gone].tobytes().decode("utf-8", "ignore")
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))
    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The rows of ``docs`` with hit spans removed from the text; rows with more than max_coverage of their words hit are dropped."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    out = plain.mapInArrow(_clean(names, names[docs.columns.index(text_col)], _shards(benchmark, item_col, item_text_col), max_coverage), plain.schema)
    return out.toDF(*docs.columns)
