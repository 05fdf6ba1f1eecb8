"""Byte-level BPE encoding and decoding with forced boundaries.

Method: two bytes that stand next to each other in no vocabulary token can never end up in one token, so the text may be
cut between them and the fragments encoded independently; ids and bytes of the fragments are concatenated. A cut
is only taken where the split into pre-tokens cannot see across it: after a visible ASCII character or a two-byte
letter (never after white space, whose runs look ahead), before the start of a character, and not before an apostrophe that
follows something else than an ASCII letter or digit. Special tokens count as tokens of the table, so none is cut.

Fragments repeat, so each worker keeps the results of up to CACHE fragments and encodes only new ones, with the public
library. No shuffle; memory is bounded by the cache, the piece and the longest text.

Cases: null text is empty: no tokens, the digests of the empty string; repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import textkit as tk

CACHE = 500_000
#: Fragments beyond this many bytes are not kept.
CACHE_BYTES = 256
Encoded = tuple[int, bytes, bytes]


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + k)] = b
    return out


class ForcedBpe:
    """Encodes and decodes with the vocabulary of a byte-level tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in symbols for c in t)}
        self.token_bytes.update({i: s for s, i in self.special.items()})
        inside = np.zeros((256, 256), bool)
        for t in self.token_bytes.values():
            for a, b in zip(t, t[1:]):
                inside[a, b] = True
        cut = ~inside
        cut[:, 0x80:0xC0] = False  # within a character
        cut[:0x21] = cut[0x7F] = False  # after white space or control characters
        cut[0xC0:] = False
        alnum = [*range(48, 58), *range(65, 91), *range(97, 123)]
        cut[[a for a in range(256) if a not in alnum], 0x27] = False
        self.cut = cut.ravel()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[bytes, Encoded] = {}

    def boundaries(self, text: np.ndarray) -> np.ndarray:
        """Positions where the text is cut."""
        if len(text) < 2:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.cut[text[:-1].astype(np.int32) * 256 + text[1:]])
        last = text[at]
        wide = last >= 0x80  # the last byte of a character: only two-byte characters from U+00C0 on
        if wide.any():
            before = text[np.maximum(at - 1, 0)]
            at = at[~wide | ((before >= 0xC3) & (before <= 0xDF))]
        return at + 1

    def _learn(self, fragments: list[bytes]) -> list[Encoded]:
        made = self.tokenizer.encode_batch_fast([f.decode("utf-8") for f in fragments], add_special_tokens=False)
        out = [(len(e.ids), "".join(f"{i}," for i in e.ids).encode(), b"".join([self.token_bytes[i] for i in e.ids])) for e in made]
        if len(self.cache) + len(fragments) > CACHE:
            self.cache.clear()
        self.cache.update((f, x) for f, x in zip(fragments, out) if len(f) <= CACHE_BYTES)
        return out

    def encode_piece(self, buf: np.ndarray, off: np.ndarray) -> Iterator[Encoded]:
        """(number of ids, ids in decimal with a comma after each, bytes that they decode to) of each text of a piece."""
        inner = off[1:-1]
        starts = np.unique(np.concatenate((self.boundaries(buf), inner[inner < len(buf)], np.zeros(min(len(buf), 1), np.int64))))
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        _, first, kind = np.unique(tk.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        fragments = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        got = list(map(self.cache.get, fragments))
        missing = [k for k, g in enumerate(got) if g is None]
        for a in range(0, len(missing), 20_000):
            part = missing[a: a + 20_000]
            for k, made in zip(part, self._learn([fragments[k] for k in part])):
                got[k] = made
        count = np.array([n for n, _, _ in got], np.int64)[kind]
        ids, ids_off = _laid_out([x for _, x, _ in got], kind)
        decoded = [x for _, _, x in got]
        text, text_off = (raw, np.append(starts, len(raw))) if decoded == fragments else _laid_out(decoded, kind)
        at = np.searchsorted(starts, off)  # of each text among the fragments
        total = np.concatenate(([0], np.cumsum(count)))
        for a, b in zip(at[:-1], at[1:]):
            yield int(total[b] - total[a]), ids[ids_off[a]: ids_off[b]], text[text_off[a]: text_off[b]]

    def encode(self, text: bytes) -> Encoded:
        return next(self.encode_piece(np.frombuffer(text, np.uint8), np.array([0, len(text)])))


def _laid_out(parts: list[bytes], kind: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The parts one after another in the order of ``kind``, and the offset of each."""
    lengths = np.array([len(x) for x in parts], np.int64)
    begin = (np.cumsum(lengths) - lengths)[kind]
    lengths = lengths[kind]
    off = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(off[-1]) + np.repeat(begin - off[:-1], lengths)
    return np.frombuffer(b"".join(parts), np.uint8)[at].tobytes(), off


def _encode_rows(names: list[str], text_col: str, path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBpe(path)
        for b in batches:
            buf, off = tk.utf8(b.column(names.index(text_col)))
            keep = [c for c in names if c != text_col]
            for i, j, piece, o in tk.pieces(buf, off):
                n, ids_digest, text_digest, all_ids = [], [], [], []
                for count, ids, decoded in bpe.encode_piece(piece, o):
                    n.append(count)
                    ids_digest.append(hashlib.sha256(ids[:-1]).hexdigest())
                    text_digest.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.fromstring(ids[:-1], np.int32, sep=",") if ids else np.zeros(0, np.int32))
                made = [pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
                if with_ids:
                    made.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)).slice(i, j - i) for c in keep), *made],
                                                 names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
    return run


def encode_documents(docs: DataFrame, columns: list[str], text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """``columns`` of each row with n_tokens, ids_sha256, decoded_sha256 (of encoding and decoding again) and, if wanted, the ids."""
    inner = "__text"
    src = docs.select(*(F.col(c) for c in columns), F.col(text_col).alias(inner))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != inner)
    return src.mapInArrow(_encode_rows(src.columns, inner, tokenizer_path(tokenizer), with_ids),
                          fields + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(ids: list[int], tokenizer: str = "byte_bpe_50k.json") -> str:
    """The text of a list of ids; bytes that are no UTF-8 become U+FFFD."""
    bpe = ForcedBpe(tokenizer_path(tokenizer))
    return b"".join(bpe.token_bytes[i] for i in ids).decode("utf-8", "replace")
