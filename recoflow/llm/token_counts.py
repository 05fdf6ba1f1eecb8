"""Token counts by a map-side two-tier lookup of pre-token lengths.

Method: a text is split into pre-tokens by the pattern of the byte-level vocabulary; its count is the sum of their token
counts. The first tier is a broadcast hash table of frequent pre-tokens (at most TABLE entries), the second a cache in each worker,
and what neither holds is encoded there with the public library. No pre-token is shuffled for counting.

The table is fitted on a sample of about FIT_DOCS documents; it changes the speed only, never a count: every
document is counted in full. Special tokens inside texts are taken as the library does by default; the rare text with an
unassigned code point is counted by the library as a whole.

Cases: null text has no bytes and no tokens; repeated rows give repeated results; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import textkit as tk
from recoflow.llm.bpe import tokenizer_path

LIMIT = 1024
TABLE = 65_536
FIT_DOCS = 20_000
CACHE = 500_000
CACHE_CHARS = 128
#: Fixed: how byte-level vocabularies of this family split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _unassigned() -> re.Pattern:
    """Code points that were unassigned when the library's tables were made: their class may differ from today's."""
    out, start = [], None
    for cp in range(0x100, 0x110001):
        gap = cp < 0x110000 and unicodedata.category(chr(cp)) == "Cn"
        if gap and start is None:
            start = cp
        elif not gap and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return re.compile(f"[{''.join(out)}]")


_GAPS: list[re.Pattern] = []


def _plain(text: str) -> bool:
    """No unassigned code point, so the pattern splits as the library does."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        if not _GAPS:
            _GAPS.append(_unassigned())
        return not _GAPS[0].search(text)


class Lengths(dict):
    """Pre-token -> number of tokens: the broadcast table and the worker's own cache."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table = table
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pre_tokens = regex.compile(PATTERN).findall

    def _learn(self, pre_tokens: list[str]) -> None:
        if len(self) + len(pre_tokens) > len(self.table) + CACHE:
            self.clear()
            self.update(self.table)
        self.update(zip(pre_tokens, (len(e.ids) for e in self.tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False))))

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special tokens."""
        if self.special is None or not self.special.search(text):
            return self.pre_tokens(text), 0
        parts = self.special.split(text)
        return [p for x in parts for p in self.pre_tokens(x)], len(parts) - 1

    def counts(self, texts: list[str]) -> Iterator[int]:
        """Token counts of some texts; what is not known yet is encoded together."""
        known = [_plain(t) for t in texts]
        parts = [self.split(t) if plain else ([], 0) for t, plain in zip(texts, known)]
        new = set().union(*(p for p, _ in parts)).difference(self)
        short = [p for p in new if len(p) <= CACHE_CHARS]
        if len(self) + len(short) > len(self.table) + CACHE:  # room first, so that what these texts need stays
            self.clear()
            self.update(self.table)
            short = [p for p in set().union(*(p for p, _ in parts)).difference(self) if len(p) <= CACHE_CHARS]
        if short:
            self._learn(short)
        long = {p: len(self.tokenizer.encode(p, add_special_tokens=False).ids) for p in new if len(p) > CACHE_CHARS}
        for text, plain, (pre, special) in zip(texts, known, parts):
            if not plain:
                yield len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            elif long:
                yield sum(long[p] if p in long else self[p] for p in pre) + special
            else:
                yield sum(map(self.__getitem__, pre)) + special


def _count_pre_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, seen = Lengths(path, {}), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(p for p in lengths.split(text or "")[0] if len(p) <= CACHE_CHARS)
            if len(seen) > 4 * TABLE:
                seen = Counter(dict(seen.most_common(TABLE)))
        top = seen.most_common(TABLE)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["p", "n"])
    return run


def frequent_lengths(docs: DataFrame, text_col: str, path: str) -> dict[str, int]:
    """The first tier: token counts of the most frequent pre-tokens of a sample (at most TABLE; no count depends on it)."""
    rows = docs.count()
    sample = docs.select(text_col).sample(min(1.0, FIT_DOCS / rows), seed=1) if rows else docs.select(text_col)
    top = sample.mapInArrow(_count_pre_tokens(path), "p string, n long").groupBy("p").agg(F.sum("n").alias("n")) \
        .where("n > 1").orderBy(F.desc("n"), "p").limit(TABLE)
    words = [r.p for r in top.collect()]
    lengths = Lengths(path, {})
    return dict(zip(words, lengths.counts(words)))


def _count_rows(names: list[str], text_col: str, path: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path, table.value)
        for b in batches:
            column = b.column(names.index(text_col))
            buf, off = tk.utf8(column)
            n = np.zeros(b.num_rows, np.int64)
            for i, j, piece, o in tk.pieces(buf, off):
                raw = piece.tobytes()
                n[i:j] = np.fromiter(lengths.counts([raw[x:y].decode() for x, y in zip(o[:-1], o[1:])]), np.int64, j - i)
            keep = [c for c in names if c != text_col]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in keep), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)],
                                             names=[*keep, "n_bytes", "n_tokens", "over_limit"])
    return run


def count_tokens(docs: DataFrame, columns: list[str], text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """``columns`` of each row with n_bytes, n_tokens and over_limit."""
    path = tokenizer_path(tokenizer)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text_col, path))
    inner = "__text"
    src = docs.select(*(F.col(c) for c in columns), F.col(text_col).alias(inner))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != inner)
    return src.mapInArrow(_count_rows(src.columns, inner, path, table, limit), fields + ", n_bytes long, n_tokens long, over_limit boolean")
