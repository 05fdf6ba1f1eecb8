"""Quality rules: base counts of a text and robust multivariate outliers per (lang, source).

Method: minimum covariance determinant. Every text gives a vector of transformed statistics; every
(lang, source) group gets a centre and scatter from concentration steps over *all* its rows (keep the share
H of rows closest by Mahalanobis distance, estimate anew, repeat), started from several robust scalings; the
start with the smallest determinant wins. The centre and scatter of all rows near the winner (within NEAR) are the group's estimate.
A text is rejected when its distance exceeds the chi-square cut. With H at one half, up to nearly half of a group may be junk.

The steps are grouped aggregations: each iteration joins the small table of estimates, finds each group's
H-quantile of the distance from a histogram of logarithmic bins, and sums vectors and products of the rows
below it. Statistics are whole multiples of 1/GRAIN, so sums are exact and the result does not depend on how
rows were dealt. Groups below MIN_GROUP rows take the estimate of their language, then that of all rows.

Cases: null or empty text has no words and fails the base rules; null lang or source form a group of their own;
repeated rows give repeated results; an empty table gives an empty result. Extra columns are ignored by
``base_stats``/``verdicts`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoflow.llm import textkit as tk
from recoflow.llm.shared import written

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PCT, REPEAT_SIZE = 20, 30, 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_len", "symbols", "upper", "marks", "repeats", "dup_lines", "richness"]
#: Standard deviation that each statistic is granted at least: the noise of a short clean text.
FLOOR = [0.05, 0.05, 0.06, 0.05, 0.10, 0.10, 0.03]
#: Statistics are rounded to multiples of 1 / GRAIN.
GRAIN = 1024
H_SHARE = 0.5
C_STEPS = 6
#: Ten times the number of statistics.
MIN_GROUP = 70
BINS_PER_OCTAVE = 16
#: Cut on the squared distance: the chi-square quantile with len(FEATURES) degrees of freedom at 1 - 1e-7
#: (a text of clean prose passes; junk lies far beyond).
CUT = 46.0
#: Factor that makes the covariance of the closest H rows consistent for normal data with 7 dimensions.
CONSISTENCY = 1.694
#: The last estimate is taken from all rows within the chi-square quantile at 0.975; its factor.
NEAR, NEAR_CONSISTENCY = 16.01, 1.045

_WORD = tk.byte_class("space")
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[33:48] = _IS_MARK[58:65] = _IS_MARK[91:97] = _IS_MARK[123:127] = True
_IS_MARK &= ~_IS_SYMBOL
_LEAD = np.ones(256, bool)
_LEAD[128:192] = False


def _repeat_words(words: np.ndarray) -> int:
    """Words inside windows of REPEAT_SIZE words that occur twice or more."""
    g = tk.shingles(words, REPEAT_SIZE)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    return int(tk.cover(len(words), at, at + REPEAT_SIZE).sum())


def _dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and the raw sums behind FEATURES for each text of a column."""
    buf_all, off_all = tk.utf8(column)
    n = len(off_all) - 1
    out = {k: np.zeros(n, np.int64) for k in [*COUNTS, "n_lines", "n_distinct", "n_upper", "n_letters", "n_marks"]}
    for i, j, buf, off in tk.pieces(buf_all, off_all):
        starts, ends, wo = tk.word_spans(buf, off, _WORD)
        words = tk.span_hashes(buf, starts, ends)
        out["n_words"][i:j] = np.diff(wo)
        out["word_chars"][i:j] = _sums(_WORD[buf] & _LEAD[buf], off)
        for name, mask in (("n_symbols", _IS_SYMBOL), ("n_upper", _IS_UPPER), ("n_letters", _IS_LETTER), ("n_marks", _IS_MARK)):
            out[name][i:j] = _sums(mask[buf], off)
        raw = buf.tobytes()
        for k in range(j - i):
            w = words[wo[k]: wo[k + 1]]
            if not len(w):
                continue
            text = raw[off[k]: off[k + 1]]
            out["n_distinct"][i + k] = len(np.unique(w))
            out["n_repeat_words"][i + k] = _repeat_words(w)
            out["n_lines"][i + k] = text.count(b"\n") + 1
            out["n_dup_lines"][i + k] = _dup_lines(text) if out["n_lines"][i + k] > 1 else 0
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The transformed statistics (rows x FEATURES) as whole multiples of 1/GRAIN; zeros where there is no word."""
    w = np.maximum(s["n_words"], 1).astype(float)
    chars = np.maximum(s["word_chars"], 1).astype(float)
    x = np.stack([
        np.log(chars / w),
        np.sqrt(s["n_symbols"] / chars),
        np.sqrt(s["n_upper"] / np.maximum(s["n_letters"], 1)),
        np.sqrt(s["n_marks"] / chars),
        np.sqrt(s["n_repeat_words"] / w),
        np.sqrt(s["n_dup_lines"] / np.maximum(s["n_lines"], 1)),
        np.log(np.maximum(s["n_distinct"], 1)) / np.log(w + 1),
    ], axis=1)
    x[s["n_words"] == 0] = 0
    return np.round(x * GRAIN).astype(np.int64)


_ADDED = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()),
                       *(T.StructField(f"x_{c}", T.LongType()) for c in FEATURES)])


def _with_stats(schema: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = text_stats(b.column(schema.index(text_col)))
            x = features(s)
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PCT * s["n_words"])
            keep = [b.column(i) for i, c in enumerate(schema)]
            yield pa.RecordBatch.from_arrays(
                [*keep, *(pa.array(s[c]) for c in COUNTS), pa.array(failed), *(pa.array(x[:, k]) for k in range(x.shape[1]))],
                names=[*schema, *(f.name for f in _ADDED)])
    return run


def base_stats(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of each row, followed by COUNTS, base_failed and the transformed statistics x_*."""
    wanted = list(dict.fromkeys([*columns, text_col]))
    src = docs.select(*(F.col(c) for c in wanted))
    out = T.StructType([*src.schema.fields, *_ADDED.fields])
    return src.mapInArrow(_with_stats(wanted, text_col), out).drop(*([] if text_col in columns else [text_col]))


def _vector(prefix: str = "x_") -> list:
    return [F.col(f"{prefix}{c}").cast("double") for c in FEATURES]


_EST = "level int, g_lang string, g_source string, start int, n long, centre array<double>, precision array<double>, logdet double"


def _estimate(scale: float):
    """Centre, inverse scatter and log-determinant from moments; one row a group in and out."""
    d = len(FEATURES)
    upper = np.triu_indices(d)
    floor = np.diag((np.array(FLOOR) * GRAIN) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                mean = np.array(r["s1"]) / r["n"]
                cov = np.zeros((d, d))
                cov[upper] = np.array(r["s2"]) / r["n"]
                cov = cov + cov.T - np.diag(np.diag(cov)) - np.outer(mean, mean)
                cov = scale * cov + floor
                rows.append({"level": r["level"], "g_lang": r["g_lang"], "g_source": r["g_source"], "start": r["start"], "n": r["n"],
                             "centre": mean.tolist(), "precision": np.linalg.inv(cov).ravel().tolist(),
                             "logdet": float(np.linalg.slogdet(cov)[1])})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("level", pa.int32()), ("g_lang", pa.string()), ("g_source", pa.string()), ("start", pa.int32()), ("n", pa.int64()),
                ("centre", pa.list_(pa.float64())), ("precision", pa.list_(pa.float64())), ("logdet", pa.float64())]))
    return run


def _distance(x: list, centre: str = "centre", precision: str = "precision"):
    """Squared Mahalanobis distance as a column."""
    d = len(x)
    dev = [x[i] - F.col(centre)[i] for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        inner = F.lit(0.0)
        for j in range(d):
            inner = inner + F.col(precision)[i * d + j] * dev[j]
        total = total + dev[i] * inner
    return total


def _levels(stats: DataFrame) -> DataFrame:
    """Each row as a member of its (lang, source) group, of its language, and of all rows."""
    return stats.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "level", F.when(F.col("level") < 2, F.col("g_lang")).otherwise("").alias("g_lang"),
        F.when(F.col("level") < 1, F.col("g_source")).otherwise("").alias("g_source"),
        *(F.col(f"x_{c}") for c in FEATURES))


def _starts(rows: DataFrame) -> DataFrame:
    """Two robust scalings of each group: around the median with the MAD, and around the middle half of each statistic."""
    keys = ["level", "g_lang", "g_source"]
    quart = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(
        F.percentile(F.col(f"x_{c}"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{c}") for c in FEATURES))
    parts = []
    for start in (0, 1):
        centre = F.array(*((F.col(f"q_{c}")[1] if start == 0 else (F.col(f"q_{c}")[0] + F.col(f"q_{c}")[2]) / 2) for c in FEATURES))
        d = len(FEATURES)
        diag = [1.0 / (F.pow((F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]) / 1.349, F.lit(2.0)) + float((FLOOR[i] * GRAIN) ** 2)) for i, c in enumerate(FEATURES)]
        precision = F.array(*(diag[i] if i == j else F.lit(0.0) for i in range(d) for j in range(d)))
        parts.append(quart.select(*keys, F.lit(start).alias("start"), "n", centre.alias("centre"), precision.alias("precision"),
                                  F.lit(float("inf")).alias("logdet")))
    return parts[0].unionByName(parts[1])


def mcd_estimates(stats: DataFrame) -> DataFrame:
    """(level, g_lang, g_source, n, centre, precision): the estimate of each group, language and of all rows.

    ``stats`` holds g_lang, g_source and x_*; rows with base_failed should have been left out.
    The number of groups is that of distinct (lang, source) pairs; nothing is collected.
    """
    keys = ["level", "g_lang", "g_source", "start"]
    rows = _levels(stats)
    est = written(_starts(rows), "mcd-start")
    for _ in range(C_STEPS):
        near = rows.join(est.select(*keys, "centre", "precision"), ["level", "g_lang", "g_source"])
        # bins of the distance: log2 with BINS_PER_OCTAVE steps, so few a group and independent of row order
        near = near.withColumn("bin", F.floor(F.log2(_distance(_vector()) + 1e-6) * BINS_PER_OCTAVE).cast("int")).drop("centre", "precision")
        counts = near.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"), *_moment_sums())
        merged = _closest(counts, keys)
        est = written(merged.mapInArrow(_estimate(CONSISTENCY), _EST), "mcd-step")
    group = ["level", "g_lang", "g_source"]
    best = est.groupBy(*group).agg(F.min_by(F.struct("start", "centre", "precision"), F.struct("logdet", "start")).alias("e")).select(*group, "e.*")
    near = rows.join(best, group).where(_distance(_vector()) <= NEAR).drop("centre", "precision")
    last = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_moment_sums()).select(*keys, "n", *_moments())
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))
    return last.mapInArrow(_estimate(NEAR_CONSISTENCY), _EST).join(sizes, group).select(*group, "rows", "centre", "precision")


def _moment_sums() -> list:
    v = _vector()
    d = len(v)
    return [*(F.sum(a).alias(f"s1_{i}") for i, a in enumerate(v)),
            *(F.sum(v[i] * v[j]).alias(f"s2_{i}_{j}") for i in range(d) for j in range(i, d))]


def _moments(total=F.col) -> list:
    """The sums of a group as arrays s1 and s2."""
    d = len(FEATURES)
    return [F.array(*(total(f"s1_{i}") for i in range(d))).alias("s1"), F.array(*(total(f"s2_{i}_{j}") for i in range(d) for j in range(i, d))).alias("s2")]


def _closest(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the bins up to the one that holds a group's H-quantile (a few hundred bins a group)."""
    from pyspark.sql import Window

    ordered = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    kept = counts.withColumn("before", F.coalesce(F.sum("c").over(ordered), F.lit(0))).withColumn("all", F.sum("c").over(whole)) \
        .where(F.col("before") < H_SHARE * F.col("all"))
    return kept.groupBy(*keys).agg(F.sum("c").alias("n"), *_moments(F.sum))


def _grouped(stats: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    return stats.withColumn("g_lang", F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("null"))) \
        .withColumn("g_source", F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")))


def _judge(stats: DataFrame, est: DataFrame) -> DataFrame:
    """Adds distance and kept: the group's estimate if it has MIN_GROUP rows, else the language's, else that of all."""
    group = est.where((F.col("level") == 0) & (F.col("rows") >= MIN_GROUP)).select(
        "g_lang", "g_source", F.struct("centre", "precision").alias("e0"))
    lang = est.where((F.col("level") == 1) & (F.col("rows") >= MIN_GROUP)).select("g_lang", F.struct("centre", "precision").alias("e1"))
    every = est.where(F.col("level") == 2).select(F.lit(1).alias("one"), F.struct("centre", "precision").alias("e2"))
    out = stats.join(group, ["g_lang", "g_source"], "left").join(lang, "g_lang", "left") \
        .withColumn("one", F.lit(1)).join(F.broadcast(every), "one", "left")  # one row
    out = out.withColumn("e", F.coalesce("e0", "e1", "e2")).withColumn("centre", F.col("e.centre")).withColumn("precision", F.col("e.precision"))
    far = F.coalesce(_distance(_vector()), F.lit(0.0))
    return out.withColumn("distance", far).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUT)) \
        .drop("e0", "e1", "e2", "e", "one", "centre", "precision", "g_lang", "g_source")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, COUNTS, base_failed, kept, distance) for each row."""
    stats = written(_grouped(base_stats(docs, [id_col, lang_col, source_col], text_col), lang_col, source_col).drop(lang_col, source_col), "quality-stats")
    est = written(mcd_estimates(stats.where(~F.col("base_failed"))), "mcd-estimates")
    return _judge(stats, est).select(id_col, *COUNTS, "base_failed", "kept", "distance")


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns, whatever these are called."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text, lang, source = (f"c{names.index(c)}" for c in (text_col, lang_col, source_col))
    only = written(_grouped(base_stats(plain, [lang, source], text), lang, source).drop(lang, source, *COUNTS), "quality-stats")
    est = written(mcd_estimates(only.where(~F.col("base_failed"))), "mcd-estimates")
    judged = _judge(_grouped(base_stats(plain, plain.columns, text), lang, source), est)
    return judged.where("kept").select(*plain.columns).toDF(*names)
