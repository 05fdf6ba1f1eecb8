"""Scoring against factor tables (P8 P12 M4 and the all-items scans behind T1 T3 M6).

A factor table is ``DataFrame<id int, features array<double>>``.

Scoring a user against *every* item never materialises (user, item) rows.
Query rows (one per user, or per labelled pair) are scanned with Arrow-batched
``mapInPandas``; each task multiplies a tile of query vectors by a tile of
item vectors with numpy and emits only what the caller asked for:

* ``topk``  – the best ``k_fetch`` items per query row (ties: item id asc/desc)
* ``stats`` – min and max score per row, plus a count of items that beat the
  row's threshold (used for exact held-out ranks)

Item side, two physical strategies:

* **broadcast** when ``n_items × dim × 8`` bytes is under ``max_broadcast_bytes``
  (checked with one aggregate before choosing): no shuffle of the query side.
* **block pairs** otherwise: items grouped into blocks of ``item_block_rows``,
  query rows into blocks of ``query_block_rows``, each item block shuffled to
  every query block by an equi-join on the query-block number; partial results
  are merged with an aggregate (stats) or a bounded top-k (topk).

Scores come from a matrix product; every score that is emitted or lies near a
cut is accumulated dimension by dimension in index order, exactly as
``functions.columns.dot`` does in SQL, so a score computed either way is the
same double and comparisons against a held-out score never flip.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


MAX_BROADCAST_BYTES = 256 << 20
QUERY_TILE = 256
ITEM_TILE = 8192
MAX_TILE_CANDIDATES = 1 << 21  # candidates that the rows of one tile keep together (one row may keep more)
CELLS_PER_TASK = 1 << 26      # query rows × items scored by one scan task
MAX_SCAN_TASKS = 1 << 17
EXACT_PAIRS = 2048            # pairs whose products are held at once


# ---- pairs ---------------------------------------------------------------------

def score_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame, max_broadcast_bytes: int | None = None) -> DataFrame:
    """M4: (user_id, item_id, …) → + score; pairs whose user or item has no factors drop.

    Where both factor tables pass the broadcast check, pairs are scored where they lie; else in buckets of the user, the items chunk by chunk.
    """
    from recoflow.operators import gridscan
    limit = gridscan.CHUNK_BYTES if max_broadcast_bytes is None else max_broadcast_bytes
    n_users, dim = _item_size(users)
    chunks = gridscan.ItemChunks(items, limit)
    if not (n_users and chunks.chunks):
        return pairs.withColumn("score", F.lit(0.0)).limit(0)
    if n_users * dim * 8 <= limit and not chunks.several:
        return gridscan.score_pairs(pairs, gridscan.ItemChunks(users, limit), chunks)
    return gridscan.score_pairs_chunks(pairs, users, chunks)


# ---- numpy kernels -----------------------------------------------------------------

def _exact(U: np.ndarray, V: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Scores of the pairs (U[rows], V[cols]), accumulated dimension by dimension like ``functions.columns.dot``."""
    out = np.zeros(len(rows))
    for a in range(0, len(rows), EXACT_PAIRS):  # whole vectors are fetched, as many as the cache holds
        part, x = U[rows[a: a + EXACT_PAIRS]], out[a: a + EXACT_PAIRS]
        part *= V[cols[a: a + EXACT_PAIRS]]
        for d in range(U.shape[1]):
            x += part[:, d]
    return out


def _scaled(S, lo, hi):
    rng = hi - lo
    with np.errstate(invalid="ignore", divide="ignore"):
        out = (S - lo[:, None]) / rng[:, None]
    out[rng == 0, :] = 0.0
    return out


def _stack(col) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


class _Spec:
    def __init__(self, op: str, keys: list[str], tie: str = "asc", scaled: bool = False,
                 count: str | None = None):
        self.op, self.keys, self.tie, self.scaled, self.count = op, keys, tie, scaled, count


def _tiles(k: np.ndarray | None, n: int):
    """Row ranges of one matrix product; with ``k`` (ascending) rows of a range keep numbers of items within a factor of two."""
    a = 0
    while a < n:
        b = min(a + QUERY_TILE, n)
        if k is not None:
            b = min(b, max(a + 1, int(np.searchsorted(k, 2 * max(int(k[a]), 1), "right"))))
            b = min(b, a + max(1, MAX_TILE_CANDIDATES // max(int(k[b - 1]), 1)))
        yield a, b
        a = b


def _run_kernel(q: pd.DataFrame, ids: np.ndarray, V: np.ndarray, spec: _Spec) -> pd.DataFrame:
    """q: query rows (keys…, features, [k_fetch], [lo, hi], [t, h]) against items (ids, V).

    A matrix product gives all scores up to rounding; those within its error bound of a cut
    (threshold, k-th best, range end) are computed again in the fixed order, so results are exact.
    """
    import pandas as pd  # not by the module: the workers of the Arrow scans do without it

    out = []
    if len(q) == 0:
        return None
    if spec.op == "topk":
        q = q.sort_values("k_fetch", kind="stable").reset_index(drop=True)
    U = _stack(q["features"].values)
    n = len(ids)
    longest = np.sqrt((V * V).sum(axis=1)).max(initial=0.0)
    for a, b in _tiles(np.minimum(q["k_fetch"].to_numpy(np.int64), n) if spec.op == "topk" else None, len(q)):
        part = q.iloc[a:b]
        Uq = U[a:b]
        slack = 8 * np.finfo(np.float64).eps * max(U.shape[1], 1) * np.sqrt((Uq * Uq).sum(axis=1)) * longest
        if spec.scaled:
            lo, hi = part["lo"].to_numpy(np.float64), part["hi"].to_numpy(np.float64)
            rng = hi - lo
            slack = np.divide(slack, rng, out=np.zeros_like(rng), where=rng != 0) + 8 * np.finfo(np.float64).eps

        def exact(rows, cols, base):
            x = _exact(Uq, V, rows, cols + base)
            if spec.scaled:
                x = np.divide(x - lo[rows], rng[rows], out=np.zeros_like(x), where=rng[rows] != 0)
            return x

        if spec.op == "stats":
            mn = np.full(b - a, np.inf)
            mx = np.full(b - a, -np.inf)
            cnt = np.zeros(b - a, dtype=np.int64)
            t = part["t"].to_numpy(np.float64) if spec.count else None
            h = part["h"].to_numpy(np.int64) if spec.count else None
        else:
            kf = np.minimum(part["k_fetch"].to_numpy(np.int64), n)
            c_rows, c_ids, c_sc = [], [], []
        for c in range(0, n, ITEM_TILE):
            e = min(c + ITEM_TILE, n)
            tid = ids[c:e]
            S = Uq @ V[c:e].T
            if spec.scaled:
                S = _scaled(S, lo, hi)
            if spec.op == "stats" and spec.count:
                other = tid[None, :] != h[:, None]
                cnt += ((S > (t + slack)[:, None]) & other).sum(axis=1)
                rr, cc = np.nonzero((np.abs(S - t[:, None]) <= slack[:, None]) & other)
                x = exact(rr, cc, c)
                if spec.count == "geq":
                    beats = x >= t[rr]
                else:  # "gt_tie_desc": strictly higher, or equal with a higher item id
                    beats = (x > t[rr]) | ((x == t[rr]) & (tid[cc] > h[rr]))
                cnt += np.bincount(rr[beats], minlength=b - a)
            if spec.op == "stats":
                rr, cc = np.nonzero(S <= (S.min(axis=1) + 2 * slack)[:, None])
                np.minimum.at(mn, rr, exact(rr, cc, c))
                rr, cc = np.nonzero(S >= (S.max(axis=1) - 2 * slack)[:, None])
                np.maximum.at(mx, rr, exact(rr, cc, c))
            else:
                # every row keeps its best kmax of this tile (ties at the cut all kept), vectorised
                kmax = int(min(kf.max(initial=0), e - c))
                if kmax <= 0:
                    continue
                if kmax < e - c:
                    thr = np.partition(S, (e - c) - kmax, axis=1)[:, (e - c) - kmax]
                    rr, cc = np.nonzero(S >= (thr - 2 * slack)[:, None])
                else:
                    rr, cc = np.nonzero(np.ones_like(S, dtype=bool))
                c_rows.append(rr)
                c_ids.append(tid[cc])
                c_sc.append(exact(rr, cc, c))
        if spec.op == "stats":
            res = part[spec.keys].copy()
            res["lo"] = np.where(np.isfinite(mn), mn, np.nan)
            res["hi"] = np.where(np.isfinite(mx), mx, np.nan)
            res["cnt"] = cnt
            out.append(res)
        elif c_rows:
            rr, ci, cs = np.concatenate(c_rows), np.concatenate(c_ids), np.concatenate(c_sc)
            sec = ci if spec.tie == "asc" else -ci.astype(np.int64)
            order = np.lexsort((sec, -cs, rr))
            rr, ci, cs = rr[order], ci[order], cs[order]
            starts = np.searchsorted(rr, np.arange(b - a))
            pos = np.arange(len(rr)) - starts[rr]
            keep = pos < kf[rr]
            rr, ci, cs = rr[keep], ci[keep], cs[keep]
            res = part[spec.keys].iloc[rr].reset_index(drop=True)
            res["item_id"] = ci.astype(np.int32)
            res["score"] = cs
            out.append(res)
    if not out:
        return None
    return pd.concat(out, ignore_index=True)


# ---- strategies ------------------------------------------------------------------

def _item_size(items: DataFrame) -> tuple[int, int]:
    row = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    return int(row["n"] or 0), int(row["d"] or 0)


def _out_schema(queries: DataFrame, spec: _Spec) -> T.StructType:
    fields = [queries.schema[k] for k in spec.keys]
    if spec.op == "stats":
        fields += [T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
                   T.StructField("cnt", T.LongType())]
    else:
        fields += [T.StructField("item_id", T.IntegerType()), T.StructField("score", T.DoubleType())]
    return T.StructType(fields)


class ItemMatrix:
    """The item side of a scan, prepared once: size-checked and, when it fits, broadcast.

    Reusable across scans (every micro-batch of a stream answers from the same
    model); ``destroy`` releases the broadcast when the model is replaced.
    """

    def __init__(self, items: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES):
        self.df = items
        self.n_items, self.dim = _item_size(items)
        self.bc = None
        if self.n_items and self.n_items * max(self.dim, 1) * 8 <= max_broadcast_bytes:
            # bounded by the check above: the item matrix is shipped once per executor
            pdf = items.select("id", "features").toPandas()
            order = np.argsort(pdf["id"].to_numpy(), kind="stable")
            ids = pdf["id"].to_numpy()[order].astype(np.int64)
            self.bc = items.sparkSession.sparkContext.broadcast((ids, _stack(pdf["features"].values[order])))

    def destroy(self):
        if self.bc is not None:
            self.bc.destroy()
            self.bc = None


def item_frame(items) -> DataFrame:
    return items.df if isinstance(items, ItemMatrix) else items


def _scan(queries: DataFrame, items, spec: _Spec, max_broadcast_bytes: int,
          query_block_rows: int, item_block_rows: int) -> DataFrame:
    schema = _out_schema(queries, spec)
    spark = queries.sparkSession
    matrix = items if isinstance(items, ItemMatrix) else ItemMatrix(items, max_broadcast_bytes)
    items, n_items = matrix.df, matrix.n_items
    if n_items == 0:
        return spark.createDataFrame([], schema)
    if matrix.bc is not None:
        bc = matrix.bc
        # the scan's cost is rows × items, which input bytes do not show: AQE would coalesce a
        # small factor table into one task, so the partition count is set from the work instead
        n_q = queries.count()
        parts = max(1, min(MAX_SCAN_TASKS, math.ceil(n_q * n_items / CELLS_PER_TASK)),
                    min(spark.sparkContext.defaultParallelism, n_q))
        queries = queries.repartition(parts, *spec.keys)

        def scan_batches(batches):
            b_ids, b_V = bc.value
            for q in batches:
                res = _run_kernel(q, b_ids, b_V, spec)
                if res is not None:
                    yield res
        return queries.mapInPandas(scan_batches, schema)

    # block pairs: every item block meets every query block, results merged afterwards
    n_q = queries.count()
    n_qb = max(1, math.ceil(n_q / query_block_rows))
    n_ib = max(1, math.ceil(n_items / item_block_rows))
    qcols = list(queries.columns)
    qblocks = (queries.withColumn("_qb", F.pmod(F.xxhash64(*spec.keys), F.lit(n_qb)))
               .groupBy("_qb").agg(F.collect_list(F.struct(*qcols)).alias("_q")))
    iblocks = (items.withColumn("_ib", F.pmod(F.xxhash64("id"), F.lit(n_ib)))
               .groupBy("_ib").agg(F.collect_list(F.struct("id", "features")).alias("_i"))
               .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1)))))
    # one block pair per task (hash on both block numbers): an Arrow batch then holds one or two
    # pairs whatever the session's batch settings, and the scan's parallelism follows the work
    n_pairs = max(1, min(MAX_SCAN_TASKS, n_qb * n_ib))
    pairs = qblocks.join(iblocks, "_qb").repartition(n_pairs, "_qb", "_ib").select("_q", "_i")

    def scan_pairs(batches):
        import pandas as pd

        for pdf in batches:
            for qrows, irows in zip(pdf["_q"].values, pdf["_i"].values):
                q = pd.DataFrame(list(qrows))
                it = pd.DataFrame(list(irows))
                order = np.argsort(it["id"].to_numpy(), kind="stable")
                res = _run_kernel(q, it["id"].to_numpy()[order].astype(np.int64),
                                  _stack(it["features"].values[order]), spec)
                if res is not None:
                    yield res
    partial = pairs.mapInPandas(scan_pairs, schema)
    if spec.op == "stats":
        return partial.groupBy(*spec.keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                               F.sum("cnt").cast("long").alias("cnt"))
    return partial  # top-k merge is done by the caller's bounded row_number


def topk_candidates(queries: DataFrame, items: DataFrame, keys: list[str], tie: str = "asc",
                    scaled: bool = False, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                    query_block_rows: int = 2048, item_block_rows: int = 8192) -> DataFrame:
    """Per query row, its best ``k_fetch`` items: (keys…, item_id, score).

    ``queries`` has keys, ``features``, ``k_fetch`` and, when ``scaled``, ``lo``/``hi``
    (then score = per-row min-max scaled score). With block pairs the result
    holds up to ``k_fetch`` rows per item block; callers finish with a
    ``row_number`` top-k, which Spark runs as a partial + final group limit.
    """
    spec = _Spec("topk", keys, tie=tie, scaled=scaled)
    return _scan(queries, items, spec, max_broadcast_bytes, query_block_rows, item_block_rows)


def score_stats(queries: DataFrame, items: DataFrame, keys: list[str], count: str | None = None,
                scaled: bool = False, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                query_block_rows: int = 2048, item_block_rows: int = 8192) -> DataFrame:
    """Per query row: (keys…, lo, hi, cnt) over all items.

    ``count="geq"``: items other than ``h`` scoring ≥ ``t``.
    ``count="gt_tie_desc"``: items other than ``h`` scoring > ``t``, or = ``t`` with a larger id.
    """
    spec = _Spec("stats", keys, scaled=scaled, count=count)
    return _scan(queries, items, spec, max_broadcast_bytes, query_block_rows, item_block_rows)


def user_score_range(users: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """P8 fit: (user_id, lo, hi) of each user's scores over all items."""
    q = users.select(F.col("id").alias("user_id"), "features")
    return score_stats(q, items, ["user_id"], **kw).select("user_id", "lo", "hi")


def top_k_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per key by ``order`` (planned as a partial + final WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
