"""Suffix-array deduplication: bytes covered by a long string that also starts earlier are removed.

A byte goes when it lies in a SIZE-byte string that also starts earlier: in a document before this one, or earlier in
this one. Strings never cross documents and are judged on the input.

Method: two-stage suffix sorting (``two_stage_order``): only suffixes smaller than their successors are sorted
directly, all others are induced from them by one scan over the first-byte buckets; the common prefixes of neighbours in that order
(``neighbour_prefixes``) tell which SIZE-byte strings are equal.

One suffix array over a whole corpus fits no task, so the strings that can be equal are first brought together:

1. Anchors. Of the GRAM-byte hashes inside a string the smallest (leftmost of ties) is its anchor; equal strings have equal
   anchors. Consecutive strings with one anchor form a stretch: (anchor, hash of the stretch's text, document, start).
2. Stretches meet by anchor. Equal stretches are copies: all but the first are covered. Different stretches of an anchor go on.
3. The bytes of the first of each such stretch are fetched and dealt by anchor; each task sorts their suffixes in blocks of
   whole anchors, and strings with a common prefix of SIZE bytes form a class, whose first member stays.
4. The covered strings of a document meet its text by a join.

Skew. A task keeps only the first of equal stretches (per FLUSH) before the shuffle, so copies cost one row a flush.
An anchor with very many *different* stretches (the edges of a passage that very many documents share) would make
a large group: anchors with more than HEAVY_SHARE of all stretches, found by an exact bounded count, go round string by string
instead, under the hash of each string, which spreads them.

Cases: null or empty text has no bytes; documents are ordered by doc_id, null first; rows that share doc_id and text are one
document and get the same result; rows that share only doc_id are ordered by a hash of their text; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import textkit as tk
from recoflow.llm.shared import NULL_ID, key_columns, keyed, shuffle_partitions, small_batches, written

SIZE = 100
GRAM = 24
#: Stretches that a task holds before it passes them on: its memory is some 200 bytes each.
FLUSH = 1 << 17
#: Texts in an Arrow batch.
BATCH = 1000
#: Share of all stretches above which an anchor's go round string by string; at most 1 / HEAVY_SHARE anchors do.
HEAVY_SHARE = 1e-4
HEAVY_LEAST = 2_000
BLOCK_BYTES = 1 << 20
U = np.uint64


# --- the suffix sort -----------------------------------------------------------------------------------------

def two_stage_order(text: np.ndarray, depth: int, upto: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Positions of the suffixes of ``text`` in order of their first ``depth`` symbols.

    ``upto`` (starts, lasts) restricts the order to the suffixes of these ranges, each as far as the next directly sorted one,
    which is all that induction needs.

    ``text`` holds symbols 1..255; 0 ends a string, and nothing is compared beyond it. A suffix smaller than its successor is sorted
    directly; a larger one follows from the order of its successor when the buckets are scanned upwards.
    """
    n = len(text)
    smaller = _smaller_than_next(text)
    keep = np.ones(n, bool)
    if upto is not None:
        seeds = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
        keep = tk.cover(n, upto[0], seeds[upto[1]] + 1)
    larger = ~smaller & keep
    direct = _sort_directly(text, np.flatnonzero(smaller & keep), depth)
    firsts = text[direct]
    bounds = np.searchsorted(firsts, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        ready = np.concatenate(induced[c]) if induced[c] else direct[:0]
        layer = ready
        while len(layer):  # larger suffixes of this very bucket, in the order of the scan
            before = layer[layer > 0] - 1
            layer = before[(text[before] == c) & larger[before]]
            if len(layer):
                ready = np.concatenate((ready, layer))
        bucket = np.concatenate((ready, direct[bounds[c]: bounds[c + 1]]))
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        if len(before):
            symbol = text[before]
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            cuts = np.flatnonzero(np.diff(symbol)) + 1
            for part in np.split(before, cuts):
                induced[text[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(n, np.int64)


def _smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a symbol later (ends of strings count as smaller)."""
    n = len(text)
    out = np.ones(n, bool)
    if n < 2:
        return out
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    # the next position whose successor differs decides for a run of equal symbols
    at = np.where(differs, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    rises = np.ones(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    out = rises[at]
    out[text == 0] = True
    return out


def _words(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight symbols from each position as one number, zeros beyond the end of its string."""
    n = len(text)
    x = np.zeros(n + 8, np.uint64)
    x[:n] = text
    for width in (1, 2, 4):
        x[:-width] = (x[:-width] << U(8 * width)) | x[width:]
    w = x[:n]
    short = (left < 8) & (left > 0)
    w[short] &= ~((U(1) << (U(64) - U(8) * left[short].astype(np.uint64))) - U(1))
    w[left == 0] = 0
    return w


def _left(text: np.ndarray) -> np.ndarray:
    """Symbols from each position to the end of its string."""
    n = len(text)
    at = np.where(text == 0, np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(n)


def _sort_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` in order of their first ``depth`` symbols: eight at a time, only ties go on."""
    left = _left(text)
    words = _words(text, left)
    order = at[np.argsort(words[at], kind="stable")]
    key = words[order]
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) if len(key) else key
    for done in range(8, depth, 8):
        if not len(order):
            break
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        tied &= left[order] > done
        places = np.flatnonzero(tied)
        if not len(places):
            break
        # ended strings of a tied group are its smallest and already stand first only if sorted so: take whole groups
        whole = np.isin(group, np.unique(group[places]))
        places = np.flatnonzero(whole)
        pos = order[places]
        key = np.where(left[pos] > done, words[np.minimum(pos + done, len(text) - 1)], U(0))
        by = np.lexsort((key, group[places]))
        order[places] = pos[by]
        key, g = key[by], group[places][by]
        fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])))
        heads = np.zeros(len(order), bool)
        heads[0] = True
        heads[1:] = group[1:] != group[:-1]
        heads[places[fresh]] = True
        group = np.cumsum(heads) - 1
    return order


def neighbour_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``order``, up to ``depth`` symbols."""
    left = _left(text)
    words = _words(text, left)
    lcp = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for done in range(0, depth, 8):
        a, b = order[at - 1] + done, order[at] + done
        open_ = (left[order[at - 1]] > done) & (left[order[at]] > done)
        at, a, b = at[open_], a[open_], b[open_]
        if not len(at):
            break
        differs = words[a] ^ words[b]
        same = differs == 0
        ends = np.minimum(np.minimum(left[a], left[b]), 8)
        # leading equal bytes of the two words
        bits = np.zeros(len(at), np.int64)
        bad = ~same
        if bad.any():
            bits[bad] = 64 - np.frexp(differs[bad].astype(np.float64))[1]
            bits[bad] = np.where((differs[bad] >> (U(64) - bits[bad].clip(1).astype(np.uint64))) > 0, bits[bad] - 1, bits[bad])
        lcp[at] = done + np.where(same, ends, np.minimum(bits // 8, ends))
        at = at[same & (ends == 8)]
    return np.minimum(lcp, depth)


# --- anchors and stretches -----------------------------------------------------------------------------------

def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (= 8 + 16) bytes from each position."""
    x = tk.BYTE_CODE[buf]
    base, width = 0x9E3779B97F4A7C15, 1
    eight = None
    while width < 16:
        x = x[:-width] * U(pow(base, width, 2**64)) + x[width:]
        width *= 2
        if width == 8:
            eight = x
    n = len(buf) - GRAM + 1
    return tk.mix(x[:n] * U(pow(base, 8, 2**64)) + eight[16: 16 + n])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have, y = 1, x
    while have * 2 <= width:
        y = np.minimum(y[:-have], y[have:])
        have *= 2
    n = len(x) - width + 1
    return np.minimum(y[:n], y[width - have: width - have + n])


def stretches(text: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, hash of the text, first string start and number of strings of each stretch of one text."""
    none = np.zeros(0, np.uint64)
    if len(text) < size:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    h = _gram_hashes(text)
    width = size - GRAM + 1
    low = _window_min(h, width)  # of each string
    n = len(low)
    # a position is an anchor if it has the minimum of some string around it
    padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    highest = ~_window_min(~padded, width)  # largest minimum of the strings that hold the position
    spots = np.flatnonzero(h == highest)
    value = h[spots]
    begin = np.empty(len(spots), np.int64)
    begin[0] = 0
    begin[1:] = np.where(value[1:] < value[:-1], spots[1:] - width + 1, spots[:-1] + 1)
    begin = np.minimum.accumulate(begin[::-1])[::-1].clip(0)
    end = np.minimum(np.concatenate((begin[1:], [n])), n)
    some = end > begin
    begin, end, value = begin[some], end[some], value[some]
    # hash of the stretch's text from the hashes that cover it
    last = end - 1 + size - GRAM
    code = np.full(len(begin), U(size), np.uint64)
    for step in range(0, size + width, GRAM):
        code = tk.mix(code * tk.BASE + h[np.minimum(begin + step, last)])
    return value, tk.mix(code + (end - begin).astype(np.uint64)), begin, end - begin


def _single_strings(text: np.ndarray, begin: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the start of each string of some stretches."""
    starts = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, count)])
    h = _gram_hashes(text)
    code = np.full(len(starts), U(size), np.uint64)
    for step in (*range(0, size - GRAM, GRAM), size - GRAM):
        code = tk.mix(code * tk.BASE + h[starts + step])
    return code, tk.mix(code ^ U(0x2545F4914F6CDD1D)), starts


_STRETCH = "h long, c long, ord long, tk long, start int, n int, copy boolean"
_STRETCH_FIELDS = [("h", pa.int64()), ("c", pa.int64()), ("ord", pa.int64()), ("tk", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("copy", pa.bool_())]


def _first_of_copies(h, c, ord_, tk_, start):
    """Order of the rows, each place once (repeated rows are one document), and which of them are not the first of their (h, c)."""
    order = np.lexsort((start, tk_, ord_, c, h))
    same = [x[order][1:] == x[order][:-1] for x in (h, c, ord_, tk_, start)]
    copy, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    copy[1:] = same[0] & same[1]
    again[1:] = np.logical_and.reduce(same)
    return order[~again], copy[~again]


def _stretch_rows(size: int, heavy: np.ndarray, counting: bool):
    """Rows of _STRETCH for each flush, copies marked; or, counting, (h, number of different stretches) of anchors with several, and the number of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush():
            h, c, o, t, s, n = (np.concatenate(x) for x in zip(*held))
            order, copy = _first_of_copies(h, c, o, t, s)
            if counting:
                own, times = np.unique(h[order][~copy], return_counts=True)
                many = times > 1
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((own[many].view(np.int64), [0]))), pa.array(np.concatenate((times[many], [0]))),
                                                  pa.array(np.concatenate((np.zeros(int(many.sum()), np.int64), [len(h)])))], names=["h", "n", "all"])
                return
            for a in range(0, len(order), 50_000):
                o_ = order[a: a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(h[o_].view(np.int64)), pa.array(c[o_].view(np.int64)), pa.array(o[o_]), pa.array(t[o_]),
                                                  pa.array(s[o_].astype(np.int32)), pa.array(n[o_].astype(np.int32)), pa.array(copy[a: a + 50_000])],
                                                 names=[x for x, _ in _STRETCH_FIELDS])

        for b in batches:
            ords, tks = b.column(0).to_numpy(), b.column(1).to_numpy()
            buf, off = tk.utf8(b.column(2))
            for i in range(len(ords)):
                text = buf[off[i]: off[i + 1]]
                if len(text) < size:
                    continue
                h, c, start, n = stretches(text, size)
                if len(heavy):
                    hot = np.isin(h, heavy)
                    if hot.any():
                        h2, c2, s2 = _single_strings(text, start[hot], n[hot], size)
                        h, c, start, n = (np.concatenate((x[~hot], y)) for x, y in ((h, h2), (c, c2), (start, s2), (n, np.ones(len(s2), np.int64))))
                held.append((h, c, np.full(len(h), ords[i]), np.full(len(h), tks[i]), start, n))
                count += len(h)
                if count >= FLUSH:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()
    return run


def _at_first(head: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which rows have the place of the head of their run."""
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    return np.logical_and.reduce([x == x[first] for x in place])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Firsts of flushes sorted by (h, c, ord, tk, start): all but the first of a (h, c) are copies; firsts of anchors
    with several different stretches are marked ``several`` and go on. Copies found in a flush only pass through."""
    carry: pa.Table | None = None

    def judged(t: pa.Table):
        h, c = t.column("h").to_numpy(), t.column("c").to_numpy()
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new_c = new_h | np.concatenate(([True], c[1:] != c[:-1]))
        group = np.cumsum(new_h) - 1
        several = np.bincount(group, weights=new_c)[group] > 1
        # the first of a class again, from a repeated row in another flush, is no copy
        keep = np.where(new_c, several, ~_at_first(new_c, *(t.column(x).to_numpy() for x in ("ord", "tk", "start"))))
        out = t.append_column("several", pa.array(new_c)).filter(pa.array(keep))
        return out.to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        copies = t.filter(t.column("copy"))
        yield from copies.append_column("several", pa.array(np.zeros(copies.num_rows, bool))).to_batches()
        t = t.filter(pc.invert(t.column("copy")))
        if not t.num_rows:
            continue
        carry = t if carry is None else pa.concat_tables([carry, t])
        h = carry.column("h").to_numpy()
        other = np.flatnonzero(h != h[-1])
        if len(other):
            cut = int(other[-1]) + 1
            yield from judged(carry.slice(0, cut).combine_chunks())
            carry = carry.slice(cut)
    if carry is not None and carry.num_rows:
        yield from judged(carry.combine_chunks())


def _cut_out(size: int):
    """The bytes of the wanted stretches of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = tk.utf8(b.column("text"))
            rows = {k: [] for k in ("h", "ord", "tk", "start", "n", "body")}
            for i, wanted in enumerate(b.column("wanted").to_pylist()):
                text = buf[off[i]: off[i + 1]]
                for w in wanted:
                    rows["h"].append(w["h"])
                    rows["start"].append(w["start"])
                    rows["n"].append(w["n"])
                    rows["body"].append(text[w["start"]: w["start"] + w["n"] + size - 1].tobytes())
                rows["ord"] += [b.column("ord")[i].as_py()] * len(wanted)
                rows["tk"] += [b.column("tk")[i].as_py()] * len(wanted)
            yield pa.RecordBatch.from_arrays([pa.array(rows["h"], pa.int64()), pa.array(rows["ord"], pa.int64()), pa.array(rows["tk"], pa.int64()),
                                              pa.array(rows["start"], pa.int32()), pa.array(rows["n"], pa.int32()), pa.array(rows["body"], pa.binary())], names=list(rows))
    return run


def covered_strings(ord_: np.ndarray, tk_: np.ndarray, start: np.ndarray, n: np.ndarray, bodies: list[bytes], size: int):
    """Of stretches: the strings (row, start) equal to one that starts earlier, by the suffix array of the bodies."""
    lengths = np.array([len(x) for x in bodies]) + 1
    begin = np.cumsum(lengths) - lengths
    text = np.zeros(int(lengths.sum()), np.uint8)
    joined = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)
    np.add(joined, 1, out=text, casting="unsafe")  # UTF-8 never holds 0xFF: ends of strings become 0
    order = two_stage_order(text, size, (begin, begin + n - 1))
    lcp = neighbour_prefixes(text, order, size)
    cls = np.cumsum(lcp < size)
    row = np.searchsorted(begin, order, "right") - 1
    inside = order - begin[row]
    real = inside < n[row]
    row, inside, cls = row[real], inside[real], cls[real]
    at = start[row] + inside
    by = np.lexsort((at, tk_[row], ord_[row], cls))
    row, at, cls = row[by], at[by], cls[by]
    head = np.ones(len(row), bool)
    head[1:] = cls[1:] != cls[:-1]
    # bodies of repeated rows have one place: only what starts later is covered
    again = ~_at_first(head, ord_[row], tk_[row], at)
    return row[again], at[again]


def _sort_suffixes(size: int):
    """Rows (h, ord, tk, start, n, body) sorted by h: the covered strings, as runs (ord, tk, start, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_bytes = 0

        def block(t: pa.Table):
            o, k, s, n = (t.column(x).to_numpy() for x in ("ord", "tk", "start", "n"))
            row, at = covered_strings(o, k, s.astype(np.int64), n.astype(np.int64), t.column("body").to_pylist(), size)
            by = np.lexsort((at, row))
            row, at = row[by], at[by]
            if not len(row):
                return
            head = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))
            first = np.flatnonzero(head)
            count = np.diff(np.concatenate((first, [len(row)])))
            yield pa.RecordBatch.from_arrays([pa.array(o[row[first]]), pa.array(k[row[first]]), pa.array(at[first].astype(np.int32)),
                                              pa.array(count.astype(np.int32))], names=["ord", "tk", "start", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            held_bytes += b.column("body").nbytes
            if held_bytes >= BLOCK_BYTES:
                t = pa.Table.from_batches(held).combine_chunks()
                h = t.column("h").to_numpy()
                other = np.flatnonzero(h != h[-1])
                if len(other):
                    cut = int(other[-1]) + 1
                    yield from block(t.slice(0, cut).combine_chunks())
                    rest = t.slice(cut).combine_chunks()
                    held, held_bytes = rest.to_batches(), rest.column("body").nbytes
        if held:
            yield from block(pa.Table.from_batches(held).combine_chunks())
    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most BATCH: the last step runs with the caller's number."""
    for b in batches:
        for a in range(0, b.num_rows, BATCH):
            yield b.slice(a, BATCH)


def _gone(batch: pa.RecordBatch, size: int, text_col: str) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The bytes of each text and the mask of its covered bytes (None: none)."""
    buf, off = tk.utf8(batch.column(text_col))
    spans = batch.column("spans")
    values = spans.flatten()
    starts, counts = values.field(0).to_numpy(zero_copy_only=False), values.field(1).to_numpy(zero_copy_only=False)
    done = 0
    for i, length in enumerate(np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)):
        text = buf[off[i]: off[i + 1]]
        s, n = starts[done: done + length].astype(np.int64), counts[done: done + length].astype(np.int64)
        done += length
        yield text, tk.cover(len(text), s, s + n + size - 1) if length else None


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            n_bytes, n_removed, n_spans, digest = [], [], [], []
            for text, gone in _gone(b, size, "text"):
                n_bytes.append(len(text))
                n_removed.append(0 if gone is None else int(gone.sum()))
                n_spans.append(0 if gone is None else len(tk.runs(gone)[0]))
                digest.append(hashlib.sha256(text.tobytes() if gone is None else text[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("ord"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                                              pa.array(digest, pa.string())], names=["ord", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def _shortened(size: int, names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            at = names.index(text_col)
            texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            for i, (text, gone) in enumerate(_gone(b, size, text_col)):
                if gone is not None:
                    texts[i] = text[~gone].tobytes().decode("utf-8", "ignore")
                    keep[i] = not gone.all()
            cols = [b.column(c) for c in names]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))
    return run


def heavy_anchors(texts: DataFrame, size: int) -> np.ndarray:
    """Anchors with more than HEAVY_SHARE of all stretches. A flush leaves out anchors that it sees once: they lose fewer counts
    than there are flushes, far below the threshold."""
    counts = written(texts.mapInArrow(_stretch_rows(size, np.zeros(0, np.uint64), True), "h long, n long, all long")
                     .groupBy("h").agg(F.sum("n").alias("n"), F.sum("all").alias("all")), "anchor-counts")
    total = counts.agg(F.sum("all")).first()[0] or 0
    least = max(HEAVY_LEAST, int(total * HEAVY_SHARE))
    # fewer than 1 / HEAVY_SHARE rows
    return np.sort(np.array([r.h for r in counts.where(F.col("n") >= least).select("h").collect()], dtype=np.int64).view(np.uint64))


def repeated_spans(texts: DataFrame, size: int) -> DataFrame:
    """(ord, tk, spans) of the documents with covered strings; spans: (start, n) runs of starts of covered strings. Written."""
    with small_batches(texts.sparkSession, BATCH):  # every Python step writes its table in here
        return written(_spans(texts, size), "spans")


def _spans(texts: DataFrame, size: int) -> DataFrame:
    parts = shuffle_partitions(texts.sparkSession)
    rows = texts.mapInArrow(_stretch_rows(size, heavy_anchors(texts, size), False), _STRETCH)
    # firsts meet by anchor; copies, of which a hot stretch has many, are only spread
    place = F.when(F.col("copy"), F.xxhash64("ord", "start")).otherwise(F.col("h"))
    dealt = rows.repartition(parts, place).sortWithinPartitions("h", "c", "ord", "tk", "start")
    found = written(dealt.mapInArrow(_resolve, _STRETCH + ", several boolean").drop("c", "copy"), "stretches")
    wanted = found.where("several").groupBy("ord", "tk").agg(F.collect_list(F.struct("h", "start", "n")).alias("wanted"))
    bodies = texts.join(wanted, ["ord", "tk"]).select("ord", "tk", "text", "wanted") \
        .mapInArrow(_cut_out(size), "h long, ord long, tk long, start int, n int, body binary")
    sorted_out = bodies.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_sort_suffixes(size), "ord long, tk long, start int, n int")
    covered = found.where("not several").select("ord", "tk", "start", "n").unionByName(sorted_out)
    return covered.groupBy("ord", "tk").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    texts = keyed(docs, id_col, text_col)
    out = texts.join(repeated_spans(texts, size), ["ord", "tk"], "left").select("ord", "tk", "text", "spans") \
        .mapInArrow(_digests(size), "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("ord") != NULL_ID, F.col("ord")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` without covered bytes; a character that a cut splits goes too, and so do rows of which nothing is left."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own_id, own_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    spans = repeated_spans(keyed(plain, own_id, own_text), size)
    rows = plain.select("*", *key_columns(own_id, own_text)).join(spans, ["ord", "tk"], "left").select(*names, "spans")
    return rows.mapInArrow(_shortened(size, names, own_text), plain.schema).toDF(*docs.columns)
