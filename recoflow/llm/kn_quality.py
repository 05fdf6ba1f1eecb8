"""Quality classifier: interpolated modified Kneser-Ney n-grams of trusted text, thresholded by language-specific quantiles.

Tokens are code points, in n-grams of up to ORDER; a text starts after white space. Trusted are the documents labelled with quality 1
only; every trusted text is counted in full. Discounts come from counts of counts, lower orders from continuation counts; below the
first order all code points are equally likely. N-grams are counted in two folds by a hash of the text and a document is scored with
the fold that its text is not in, so trusted documents do not score on their own text.

A document's perplexity (a code point) is compared with the LOW and HIGH quantiles of its language's trusted documents; languages with fewer
than LEAST_TRUSTED of them use the quantiles of all.

Scale: the tables of n-grams and contexts grow with the trusted text, are sharded by the n-gram (three bytes a code point, no hash) and summed
in the tasks before each shuffle; an n-gram has at most as many continuations as there are code points, so no key is hot. Texts are
read twice (counting, scoring) and copied nowhere. If the whole model has at most NODES rows, it is broadcast and every document is
scored in its task. Beyond, the most frequent n-grams of ORDER (at most NODES) are broadcast, and each document's other n-grams, once a document
with their number, meet the tables by joins; both ways give the same sums. Quantiles come from bins of the log-perplexity.

Cases: null or empty text: perplexity null, not kept; null lang forms a language of its own; a document with contradicting labels is not
trusted; without trusted documents all n-grams are equally likely and every document with text is kept; a text of any length is
streamed in whole texts or pieces of a few MB; repeated rows give repeated results; a perplexity equal to a bound counts as at
or above it; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.llm import textkit as tk
from recoflow.llm.shared import few, spent, written

ORDER = 5
WIDTH = 3
CODE_POINTS = 0x110000
#: Rows of the model that are sent to the tasks (some 100 MB there).
NODES = 1 << 21
#: Distinct n-grams of pieces held before they are summed and sent on.
FLUSH = 2_000_000
LOW, HIGH = 0.003, 0.99
LEAST_TRUSTED = 50
BINS = 2000

U = np.uint64
_FACTOR = np.random.default_rng(4).integers(1, 2**63, ORDER, dtype=np.uint64) * U(2) + U(1)
_SIZE = U(0x9E3779B97F4A7C15)
_BLANK = 32
_FOLDS = (0, 1)


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts and each text's offsets in them."""
    if not (buf & 0x80).any():
        return buf.astype(np.uint32), off
    first = (buf & 0xC0) != 0x80
    first[off[:-1][np.diff(off) > 0]] = True
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(buf)))
    lead = buf[at].astype(np.uint32)
    out = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, lead & 0x1F, lead & 0x0F], lead & 0x07)
    for k in range(1, 4):
        more = size > k
        out[more] = (out[more] << 6) | (buf[at[more] + k] & 0x3F)
    return out, np.concatenate(([0], np.cumsum(first)))[off]


def _spaced(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with blanks before each, and where their code points are."""
    lead = ORDER - 1
    at = np.arange(len(cp)) + np.repeat(np.arange(1, len(off)), np.diff(off)) * lead
    return np.insert(cp, np.repeat(off[:-1], lead), _BLANK).astype(np.uint64), at


def _keys(spaced: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the n code points that end at each place."""
    acc = np.full(len(at), U(n) * _SIZE)
    for j in range(n):
        acc += spaced[at - j] * _FACTOR[j]
    return tk.mix(acc)


def _packed(spaced: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The n-grams of ORDER that end at the places, WIDTH bytes a code point, big end first."""
    grams = spaced[at[:, None] - np.arange(ORDER - 1, -1, -1)].astype(">u4")
    return grams.view(np.uint8).reshape(len(at), ORDER, 4)[:, :, 4 - WIDTH:].reshape(len(at), ORDER * WIDTH)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the place of one of each, and each key's number among them."""
    coded = pa.array(keys).dictionary_encode()
    which = coded.indices.to_numpy()
    one = np.zeros(len(coded.dictionary), np.int64)
    one[which] = np.arange(len(keys))
    return coded.dictionary.to_numpy(), one, which


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, fold): distinct n-grams of ORDER with their counts in both folds."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush():
        keys, grams, counts = (np.concatenate(x) for x in zip(*held))
        _, one, which = _distinct(keys)
        sums = [np.bincount(which, counts[:, f], len(one)).astype(np.int64) for f in _FOLDS]
        for a in range(0, len(one), 100_000):
            own = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([_binary(grams[one[own]]), *(pa.array(s[own]) for s in sums)], names=["g", "c0", "c1"])

    for b in batches:
        folds = b.column(1).to_numpy()
        for i, j, buf, off in tk.pieces(*tk.utf8(b.column(0))):
            cp, off = code_points(buf, off)
            if not len(cp):
                continue
            spaced, at = _spaced(cp, off)
            keys, one, which = _distinct(_keys(spaced, at, ORDER))
            fold = np.repeat(folds[i:j].astype(np.int64), np.diff(off))
            held.append((keys, _packed(spaced, at[one]), np.bincount(which * 2 + fold, minlength=2 * len(one)).reshape(-1, 2)))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from flush()
                held = []
    if held:
        yield from flush()


def gram_counts(texts: DataFrame) -> DataFrame:
    """(g, c0, c1) of the texts of (text, fold): how often each n-gram of ORDER occurs in each fold."""
    rows = texts.mapInArrow(_count_rows, "g binary, c0 long, c1 long")
    return rows.groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _discounts(counts: DataFrame) -> list[list[float]]:
    """Of each fold, the modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from one row of counts of counts."""
    row = counts.agg(*(F.count_if(F.col(f"c{f}") == k) for f in _FOLDS for k in (1, 2, 3, 4))).first()
    return [discounts_of(row[4 * f: 4 * f + 4]) for f in _FOLDS]


def discounts_of(n: tuple[int, int, int, int]) -> list[float]:
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), float(k)) for k in (1, 2, 3)]


def _by_count(d: list[float], c: Column) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).when(c >= 3, d[2]).otherwise(0.0)


def _head(n: int) -> Column:
    """The first n code points of an n-gram."""
    return F.substring("g", 1, WIDTH * n)


def model(counts: DataFrame) -> DataFrame:
    """A written table of (g, n, p0, p1, b0, b1): of each n-gram its occurrences and log-probability in each fold's model (null: no n-gram there),
    and as a context the logarithm of what is left to the lower order (null: no context)."""
    tables = {ORDER: written(counts.withColumn("n", F.col("c0") + F.col("c1")), "kn-counts")}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many contexts a shorter n-gram goes on
        tables[n] = written(tables[n + 1].groupBy(F.substring("g", WIDTH + 1, WIDTH * n).alias("g")).agg(
            *(F.count_if(F.col(f"c{f}") > 0).alias(f"c{f}") for f in _FOLDS), F.sum("n").alias("n")), "kn-counts")
    parts, levels = [], []
    for n in range(1, ORDER + 1):
        own = tables[n]
        d = _discounts(own)
        contexts = own.groupBy(_head(n - 1).alias("h")).agg(
            *(F.sum(f"c{f}").alias(f"t{f}") for f in _FOLDS), *(F.sum(_by_count(d[f], F.col(f"c{f}"))).alias(f"f{f}") for f in _FOLDS), F.sum("n").alias("m"))
        rows = own.withColumn("h", _head(n - 1)).join(contexts.drop("m"), "h")
        if n == 1:
            rows = rows.withColumns({f"l{f}": F.lit(1.0 / CODE_POINTS) for f in _FOLDS})
        else:
            lower = levels[-1].select(F.col("g").alias("s"), *(F.col(f"p{f}").alias(f"l{f}") for f in _FOLDS))
            rows = rows.withColumn("s", F.substring("g", WIDTH + 1, WIDTH * (n - 1))).join(lower, "s")
        p = [F.when(F.col(f"t{f}") > 0, (F.col(f"c{f}") - _by_count(d[f], F.col(f"c{f}")) + F.col(f"f{f}") * F.col(f"l{f}")) / F.col(f"t{f}"))
             .otherwise(F.col(f"l{f}")).alias(f"p{f}") for f in _FOLDS]
        levels.append(written(rows.select("g", "n", *p), "kn-p"))
        none = [F.lit(None).cast("double").alias(x) for x in ("b0", "b1")]
        parts.append(levels[-1].select("g", "n", *(F.log(f"p{f}").alias(f"p{f}") for f in _FOLDS), *none))
        left = [F.when(F.col(f"t{f}") > 0, F.log(F.col(f"f{f}") / F.col(f"t{f}"))).otherwise(0.0).alias(f"b{f}") for f in _FOLDS]
        parts.append(contexts.select(F.col("h").alias("g"), F.col("m").alias("n"), *(F.lit(None).cast("double").alias(x) for x in ("p0", "p1")), *left))
    nodes = reduce(DataFrame.unionByName, parts).groupBy("g").agg(*(F.max(x).alias(x) for x in ("n", "p0", "p1", "b0", "b1")))
    out = written(nodes, "kn-model")
    spent(*tables.values(), *levels)
    return out


class _Lookup:
    """Rows of the model by n-gram: an open hash table over 64-bit keys."""

    def __init__(self, rows: pa.Table):
        grams = rows.column("g").combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        off = np.frombuffer(grams.buffers()[1], np.int32, len(grams) + 1, 4 * grams.offset).astype(np.int64) if len(grams) else np.zeros(1, np.int64)
        raw = np.frombuffer(grams.buffers()[2], np.uint8) if len(grams) and grams.buffers()[2] else np.zeros(0, np.uint8)
        size = np.diff(off) // WIDTH
        keys = np.zeros(len(grams), np.uint64)
        for n in range(ORDER + 1):
            own = np.flatnonzero(size == n)
            cells = raw[off[own][:, None] + np.arange(WIDTH * n)].reshape(-1, WIDTH).astype(np.uint64)
            ends = np.arange(1, len(own) + 1) * n - 1
            keys[own] = _keys(cells[:, 0] << U(16) | cells[:, 1] << U(8) | cells[:, 2], ends, n)
        self.p, self.b = (np.stack([rows.column(f"{x}{f}").to_numpy().astype(np.float32) for f in _FOLDS], 1).reshape(-1, 2) for x in "pb")
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.key, self.row = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(todo):
            free = self.row[slot] < 0
            self.row[slot[free]] = todo[free]
            left = self.row[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask
        used = self.row >= 0
        self.key[used] = keys[self.row[used]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        slot = (keys >> self.shift).astype(np.int64)
        out = self.row[slot]
        todo = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = self.row[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.key[slot[todo]] != keys[todo])]
        return out

    def values(self, table: np.ndarray, keys: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """p or b of the keys in the model of the fold; not a number where there is none."""
        at = self.find(keys)
        out = np.full(len(keys), np.nan, np.float32)
        hit = np.flatnonzero(at >= 0)
        out[hit] = table[at[hit], fold[hit]]
        return out


def _log_probabilities(known: _Lookup, spaced: np.ndarray, at: np.ndarray, fold: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the code point at each place; and the places that the lookup leaves open (none with a whole model)."""
    out = known.values(known.p, _keys(spaced, at, ORDER), fold).astype(np.float64)
    todo = np.flatnonzero(np.isnan(out))
    if not whole:
        return out, todo
    left = np.zeros(len(todo))
    for n in range(ORDER, 0, -1):
        left += np.nan_to_num(known.values(known.b, _keys(spaced, at[todo] - 1, n - 1), fold[todo]))
        p = known.values(known.p, _keys(spaced, at[todo], n - 1), fold[todo]) if n > 1 else np.full(len(todo), -np.log(CODE_POINTS))
        out[todo] = left + p
        open_ = np.isnan(p)
        todo, left = todo[open_], left[open_]
    return out, todo


def _score_rows(sent, whole: bool):
    """A row (g null) of each of (r, key, lang, text, fold): n_symbols and the sum of the log-probabilities; then a row of each open n-gram, m times in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Lookup(pa.ipc.open_stream(sent.value).read_all())
        for b in batches:
            folds = 1 - b.column("fold").to_numpy().astype(np.int64)
            for i, j, buf, off in tk.pieces(*tk.utf8(b.column("text"))):
                cp, off = code_points(buf, off)
                n = np.diff(off)
                spaced, at = _spaced(cp, off)
                row = np.repeat(np.arange(i, j), n)
                logp, todo = _log_probabilities(known, spaced, at, folds[row], whole)
                total = np.concatenate(([0.0], np.cumsum(np.nan_to_num(logp))))
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [own.column("r"), own.column("key"), own.column("lang"), pa.array(n.astype(np.int64)), pa.array(folds[i:j].astype(np.int32)),
                     pa.array(total[off[1:]] - total[off[:-1]]), pa.nulls(j - i, pa.binary()), pa.nulls(j - i, pa.int64())], names=_SCORED)
                if len(todo):
                    keys = tk.mix(_keys(spaced, at[todo], ORDER) + row[todo].astype(np.uint64) * _SIZE)
                    _, one, which = _distinct(keys)
                    times = np.bincount(which, minlength=len(one))
                    for a in range(0, len(one), 100_000):
                        some = todo[one[a: a + 100_000]]
                        of, none = pa.array(row[some]), len(some)
                        yield pa.RecordBatch.from_arrays(
                            [b.column("r").take(of), pa.nulls(none, b.column("key").type), pa.nulls(none, b.column("lang").type), pa.nulls(none, pa.int64()),
                             pa.array(folds[row[some]].astype(np.int32)), pa.nulls(none, pa.float64()), _binary(_packed(spaced, at[some])),
                             pa.array(times[a: a + 100_000])], names=_SCORED)
    return run


_SCORED = ["r", "key", "lang", "n_symbols", "fold", "total", "g", "m"]


def _of_fold(x: str) -> Column:
    return F.when(F.col("fold") == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1")).cast("float").cast("double")


def _joined(grams: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, fold, logp) of distinct (g, fold): joins with the tables of each order and context."""
    out = grams
    for n in range(ORDER, 0, -1):
        start = WIDTH * (ORDER - n) + 1
        own = nodes.select(F.col("g").alias("x"), "p0", "p1")
        context = nodes.where("b0 is not null").select(F.col("g").alias("y"), "b0", "b1")
        out = out.join(own, F.substring("g", start, WIDTH * n) == F.col("x"), "left").withColumn(f"own{n}", _of_fold("p")).drop("x", "p0", "p1")
        out = out.join(context, F.substring("g", start, WIDTH * (n - 1)) == F.col("y"), "left").withColumn(f"left{n}", _of_fold("b")).drop("y", "b0", "b1")
    logp = F.lit(-float(np.log(CODE_POINTS)))
    for n in range(1, ORDER + 1):
        logp = F.coalesce(F.col(f"own{n}"), F.coalesce(F.col(f"left{n}"), F.lit(0.0)) + logp)
    return out.select("g", "fold", logp.alias("logp"))


def _sent(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """At most NODES rows of the model, and whether these are all: else the most frequent n-grams of ORDER."""
    if nodes.count() <= NODES:
        return nodes, True
    longest = nodes.where(F.octet_length("g") == ORDER * WIDTH)
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    bins = longest.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))  # at most 16 a doubling
    least = bins.withColumn("upto", F.sum("rows").over(w)).where(F.col("upto") <= NODES).agg(F.min("bin")).first()[0]
    return longest.where(F.floor(F.log2("n") * 16) >= least) if least is not None else longest.limit(0), False


def perplexities(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """(key, lang, n_symbols, perplexity) of each row of (key, lang, text, fold); ``trusted``: (text, fold)."""
    spark = rows.sparkSession
    nodes = model(gram_counts(trusted))
    some, whole = _sent(nodes)
    table = some.select("g", "p0", "p1", "b0", "b1").toArrow()  # at most NODES rows
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.select(F.monotonically_increasing_id().alias("r"), "key", "lang", "text", "fold").mapInArrow(
        _score_rows(sent, whole), f"r long, key {kind}, lang string, n_symbols long, fold int, total double, g binary, m long")
    total = F.col("total")
    if not whole:
        scored = written(scored, "kn-scored")
        open_ = scored.where("g is not null")
        logp = _joined(open_.select("g", "fold").distinct(), nodes)
        rest = open_.select("r", "g", "fold", "m").join(logp, ["g", "fold"]).groupBy("r").agg(F.sum(F.col("m") * F.col("logp")).alias("rest"))
        scored = scored.where("g is null").join(rest, "r", "left")
        total = total + F.coalesce("rest", F.lit(0.0))
    mean = F.round(-total / F.col("n_symbols"), 9)
    return scored.select("key", "lang", "n_symbols", F.when(F.col("n_symbols") > 0, F.exp(mean)).alias("perplexity"))


def quantile_bins(rows: DataFrame, keys: list[str], column: str = "perplexity") -> DataFrame:
    """(keys, rows, low, high): bounds of the column at the LOW and HIGH quantiles, to 1 / BINS of its logarithm."""
    bins = rows.groupBy(*keys, F.floor(F.log(column) * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = bins.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return run.groupBy(*keys).agg(
        F.max("all").alias("rows"),
        F.exp(F.min(F.when(F.col("upto") >= LOW * F.col("all"), F.col("bin"))) / BINS).alias("low"),
        F.exp((F.min(F.when(F.col("upto") >= HIGH * F.col("all"), F.col("bin"))) + 1) / BINS).alias("high"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          label_id: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """(id, lang, n_symbols, perplexity, low, high, kept) of each row."""
    trusted = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("key")).agg(F.min(quality_col).alias("q")).where("q = 1").select("key")
    trusted = written(trusted, "kn-trusted")
    trusted = few(trusted, trusted.count())
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit("null")).alias("lang"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    scored = written(perplexities(rows, rows.join(trusted, "key", "left_semi").select("text", "fold")), "perplexity")
    good = written(scored.where("perplexity is not null").join(trusted, "key", "left_semi").withColumn("one", F.lit(1)), "trusted-perplexity")
    by_lang = quantile_bins(good, ["lang"]).where(F.col("rows") >= LEAST_TRUSTED).select("lang", F.col("low").alias("l1"), F.col("high").alias("h1"))
    every = quantile_bins(good, ["one"]).select("one", F.col("low").alias("l2"), F.col("high").alias("h2"))
    out = scored.withColumn("one", F.lit(1)).join(by_lang, "lang", "left").join(F.broadcast(every), "one", "left")  # one row
    low, high = F.coalesce("l1", "l2", F.lit(0.0)), F.coalesce("h1", "h2", F.lit(float("inf")))
    kept = (F.col("perplexity") >= low) & (F.col("perplexity") < high)
    return out.select(F.col("key").alias(id_col), F.when(F.col("lang") != "null", F.substr(F.col("lang"), F.lit(2))).alias("lang"), "n_symbols", "perplexity",
                      low.alias("low"), high.alias("high"), F.coalesce(kept, F.lit(False)).alias("kept"))
