"""Language identification as multilingual mixture inference.

Model: hashed GRAM-byte counts of the words of all labelled training texts, one distribution a language, smoothed. A text is
a mixture of languages: each word comes from one language with the text's proportions. Expectation-maximisation
over the word likelihoods estimates the proportions; among the nested sets of the most likely languages the one with the
best penalised likelihood is selected (sets of any size up to all languages), and the prediction is the largest proportion in it.

Scale: a task sums its counts in one array and sends the non-zero cells once; the model has at most BUCKETS cells a
language, which bounds what is collected and broadcast. Prediction is map-side, without a shuffle.

Cases: null text or text without a letter: ``und``, score 0; null or unlabelled rows do not train; a null id counts
as the empty string in the held-out rule; no trained language: ``und``; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import textkit as tk

GRAM = 4
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.2
ROUNDS = 12
#: Log-likelihood that a further language must gain, in units of the logarithm of the number of words.
PENALTY = 2.0
UNKNOWN = "und"

_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)
_LETTER = _NORMAL != 32


def _grams(buf: np.ndarray, off: np.ndarray):
    """Words (start, end, offsets of rows) of a spaced-out copy of the texts, and the bucket from each position."""
    inner = off[1:-1]
    text = np.concatenate((np.full(1, 32, np.uint8), np.insert(_NORMAL[buf], inner, 32), np.full(GRAM, 32, np.uint8)))
    begin = off + np.arange(len(off)) + 1
    begin[-1] = len(text)
    starts, ends, wo = tk.word_spans(text, begin, _LETTER)
    x = text[:-3].astype(np.uint32) << np.uint32(24)
    x |= text[1:-2].astype(np.uint32) << np.uint32(16)
    x |= text[2:-1].astype(np.uint32) << np.uint32(8)
    x |= text[3:]
    x ^= x >> np.uint32(15)
    return starts, ends, wo, (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(1).to_pylist()
        for i, j, buf, off in tk.pieces(*tk.utf8(b.column(0))):
            starts, ends, wo, bucket = _grams(buf, off)
            names = sorted(set(langs[i:j]))
            own = np.array([names.index(x) for x in langs[i:j]])
            which = np.repeat(own, np.diff(wo))  # of each word
            first, last = starts - 1, np.maximum(starts, ends - GRAM + 2)  # one gram before each word to its last full one
            n = last - first
            at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            got = np.bincount(np.repeat(which, n) * BUCKETS + bucket[at], minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for k, name in enumerate(names):
                counts[name] = counts.get(name, 0) + got[k]
    for name, c in counts.items():
        cells = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(c[cells])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (BUCKETS x languages) from all rows with text and label."""
    src = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = src.mapInArrow(_training_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most BUCKETS rows a language
    names = sorted(set(table.column("lang").to_pylist()))
    c = np.zeros((BUCKETS, len(names)))
    at = {x: k for k, x in enumerate(names)}
    lang = table.column("lang").combine_chunks().dictionary_encode() if names else None
    if names:
        lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
        column = np.array([at[x] for x in lang.dictionary.to_pylist()])[lang.indices.to_numpy()]
        c[table.column("bucket").to_numpy(), column] = table.column("n").to_numpy()
    return names, np.log((c + SMOOTHING) / (c.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)


def _steps(share: np.ndarray, like: np.ndarray, row: np.ndarray, begin: np.ndarray, rounds: int):
    """EM rounds: proportions of each row from the word likelihoods; and the log-likelihood under the last proportions."""
    n = np.diff(np.append(begin, len(row)))[:, None]
    for _ in range(rounds):
        part = share[row] * like
        total = part.sum(axis=1, keepdims=True)
        np.maximum(total, 1e-30, out=total)
        part /= total
        share = np.add.reduceat(part, begin, axis=0) / n
    part = np.maximum((share[row] * like).sum(axis=1), 1e-30)
    return share, np.add.reduceat(np.log(part), begin)


def mixtures(buf: np.ndarray, off: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) in the selected language set, and its size; rows without words: zeros."""
    rows, langs = len(off) - 1, model.shape[1]
    out, size = np.zeros((rows, langs)), np.zeros(rows, np.int64)
    starts, ends, wo, bucket = _grams(buf, off)
    if not len(starts) or not langs:
        return out, size
    first, n = starts - 1, np.maximum(starts, ends - GRAM + 2) - (starts - 1)
    cut = np.cumsum(n) - n
    at = np.repeat(first - cut, n) + np.arange(int(n.sum()))
    ll = np.add.reduceat(model[bucket[at]], cut, axis=0)
    like = np.exp(ll - ll.max(axis=1, keepdims=True))
    full = np.flatnonzero(np.diff(wo))
    begin = wo[full]
    row = np.repeat(np.arange(len(full)), np.diff(wo)[full])
    share, _ = _steps(np.full((len(full), langs), 1 / langs), like, row, begin, ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, best_value = None, None
    words = np.log(np.diff(wo)[full] + 1.0)
    for k in range(1, langs + 1):
        # a word's likelihood is 1 at most: a set of k or more languages gets no better value than its penalty
        if best is not None and (best_value >= -PENALTY * k * words).all():
            break
        kept = np.where(rank < k, np.maximum(share, 1e-9), 0)
        kept /= kept.sum(axis=1, keepdims=True)
        kept, value = _steps(kept, like, row, begin, 0 if k == 1 else 2)
        value = value - PENALTY * k * words
        if best is None:
            best, best_value, chosen = kept, value, np.ones(len(full), np.int64)
        else:
            better = value > best_value
            best[better], best_value[better], chosen[better] = kept[better], value[better], k
    out[full], size[full] = best, chosen
    return out, size


def _has_letter(text: bytes, plain: bool) -> bool:
    return plain or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _predict_rows(names: list[str], langs: list[str], sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            keep = names[:-1]
            for i, j, buf, off in tk.pieces(*tk.utf8(b.column(len(names) - 1))):
                share, _ = mixtures(buf, off, model)
                letters = np.concatenate(([0], np.cumsum(_ASCII_LETTER[buf])))
                plain = letters[off[1:]] > letters[off[:-1]]
                raw = buf.tobytes()
                top = share.argmax(axis=1) if langs else np.zeros(j - i, int)
                known = [bool(langs) and share[k, top[k]] > 0 and _has_letter(raw[off[k]: off[k + 1]], bool(plain[k])) for k in range(j - i)]
                pred = [langs[top[k]] if known[k] else UNKNOWN for k in range(j - i)]
                score = [float(min(share[k, top[k]], 1.0)) if known[k] else 0.0 for k in range(j - i)]
                sets = [[{"lang": langs[m], "share": float(share[k, m])} for m in np.argsort(-share[k], kind="stable") if share[k, m] > 0] if known[k] else [] for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(names.index(c)).slice(i, j - i) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                     pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    names=[*keep, "lang_pred", "score", "mixture"])
    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of each row with lang_pred, score and the mixture (selected languages with their proportions)."""
    langs, table = model
    src = docs.select(*(F.col(c) for c in columns), F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    sent = docs.sparkSession.sparkContext.broadcast(table)
    return src.mapInArrow(_predict_rows(src.columns, langs, sent), fields + ", lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def held_out(id_col: str = "doc_id"):
    """The quarter of the ids that never trains."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, mixture) of each row, trained on the rows that are not held out."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    flagged = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    return predict(flagged, model, [id_col, "held_out"], text_col)
