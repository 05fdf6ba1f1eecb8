"""The masked grid scan against plain numpy: chunks, ties, seen items, pruning."""

import numpy as np
import pytest

from recoflow.operators import gridscan as G


def factors(spark, V):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(V)], "id int, features array<double>")


def dot(u, v):
    x = 0.0
    for a, b in zip(u, v):
        x += a * b
    return x


def plain(U, V, seen, k):
    out = {}
    for u in range(len(U)):
        rows = sorted(((-dot(U[u], V[i]), i) for i in range(len(V)) if (u, i) not in seen))[: k if np.isscalar(k) else k[u]]
        out.update({(u, n): (i, -s) for n, (s, i) in enumerate(rows, 1)})
    return out


def data(kind):
    rng = np.random.default_rng(4)
    U, V = rng.normal(size=(70, 6)), rng.normal(size=(300, 6))
    if kind == "equal":  # equal lengths and scores: nothing can be cut by length
        V = np.repeat(np.eye(6), 50, axis=0)
    if kind == "long":
        V *= np.geomspace(1, 1e-4, len(V))[rng.permutation(len(V)), None]
    if kind == "zero":
        U[:5] = 0
    seen = {(int(u), int(i)) for u, i in zip(rng.integers(0, 70, 3000), rng.integers(0, 310, 3000))} | {(3, i) for i in range(300)} | {(4, i) for i in range(298)}
    return U, V, seen


@pytest.mark.parametrize("kind", ["plain", "equal", "long", "zero"])
@pytest.mark.parametrize("rows", [10_000, 40])
def test_recommend(spark, monkeypatch, kind, rows):
    U, V, seen = data(kind)
    monkeypatch.setattr(G, "ITEM_TILE", 32)
    monkeypatch.setattr(G, "LEAST_ROWS", 1)
    s = spark.createDataFrame(sorted(seen) + sorted(seen)[:50], "user_id int, item_id int")
    tiles = [spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)]
    chunks = G.ItemChunks(factors(spark, V), rows * 6 * 8)
    assert len(chunks.chunks) == 1 if rows > 300 else len(chunks.chunks) >= 8
    assert all(chunks.rows(c).count() <= 2 * rows for c in chunks.chunks)
    got = {(r.user_id, r["rank"]): (r.item_id, r.score) for r in G.recommend(factors(spark, U), chunks, s, 7, tiles=tiles).collect()}
    assert got == plain(U, V, seen, 7)
    assert tiles[0].value > 0


def test_wanted_and_unseen(spark, monkeypatch):
    monkeypatch.setattr(G, "LEAST_ROWS", 1)
    U, V, _ = data("plain")
    users = factors(spark, U).selectExpr("id", "features", "id % 4 as k_wanted")
    got = {(r.user_id, r["rank"]): (r.item_id, r.score) for r in G.recommend(users, factors(spark, V), None, 3, max_bytes=2000).collect()}
    assert got == plain(U, V, set(), [min(u % 4, 3) for u in range(len(U))])


@pytest.mark.parametrize("kind", ["plain", "equal", "long", "zero"])
def test_kernels(monkeypatch, kind):
    monkeypatch.setattr(G, "ITEM_TILE", 32)
    monkeypatch.setattr(G, "QUERY_TILE", 9)
    U, V, seen = data(kind)
    ids = np.arange(len(V)) * 3 + 1
    length = np.sqrt((V * V).sum(axis=1))
    order = np.lexsort((ids, -length))
    side = ids[order], np.ascontiguousarray(V[order]), length[order]
    pairs = sorted(seen)
    rows, sids = np.array([u for u, _ in pairs]), np.array([3 * i + 1 for _, i in pairs])
    S = np.array([[dot(u, v) for v in V] for u in U])
    lo, hi = S.min(axis=1), S.max(axis=1)
    M = np.array([[0.0 if (u, i) in seen or hi[u] == lo[u] else (S[u, i] - lo[u]) / (hi[u] - lo[u]) for i in range(len(V))] for u in range(len(U))])
    held = np.random.default_rng(1).integers(0, len(V), len(U))
    raw = [1 + sum(S[u, i] >= S[u, h] for i in range(len(V)) if i != h and (u, i) not in seen) for u, h in enumerate(held)]
    assert G.label_ranks(U, side, 3 * held + 1, rows, sids, False).tolist() == raw
    t = [0.0 if hi[u] == lo[u] else (S[u, h] - lo[u]) / (hi[u] - lo[u]) for u, h in enumerate(held)]
    masked = [1 + sum(M[u, i] > t[u] or (M[u, i] == t[u] and i > h) for i in range(len(V)) if i != h) for u, h in enumerate(held)]
    assert G.label_ranks(U, side, 3 * held + 1, rows, sids, True).tolist() == masked
    assert (G.label_ranks(U, side, 3 * held + 2, rows, sids, True) == -1).all()
    r, i, s = G.masked_top_k(U, side, 5, rows, sids)
    want = [(u, 3 * i + 1, M[u, i]) for u in range(len(U)) for i in sorted(range(len(V)), key=lambda i: (-M[u, i], -i))[:5]]
    assert list(zip(r.tolist(), i.tolist(), s.tolist())) == want


def test_pruning_skips_tiles(monkeypatch):
    monkeypatch.setattr(G, "ITEM_TILE", 16)
    rng = np.random.default_rng(2)
    U, V = rng.normal(size=(20, 4)), rng.normal(size=(800, 4)) * np.geomspace(1, 1e-3, 800)[:, None]
    length = np.sqrt((V * V).sum(axis=1))
    order = np.argsort(-length)
    (rows, ids, _), done, skipped = G.top_k(U, (order, V[order], length[order]), np.full(20, 3), np.full(20, -np.inf), *[np.zeros(0, np.int64)] * 2)
    assert skipped > done and {(int(a), int(b)) for a, b in zip(rows, ids)} == {(u, i) for (u, _), (i, _) in plain(U, V, set(), 3).items()}


def masked(U, V, seen):
    S = np.array([[dot(u, v) for v in V] for u in U])
    lo, hi = S.min(axis=1), S.max(axis=1)
    return S, [[0.0 if hi[u] == lo[u] else (S[u, i] - lo[u]) / (hi[u] - lo[u]) for i in range(len(V))] for u in range(len(U))]


@pytest.mark.parametrize("kind", ["plain", "equal", "long", "zero"])
def test_several_chunks_give_what_one_gives(spark, monkeypatch, kind):
    """Ranges, masked lists and ranks of a catalogue of several chunks, without block pairs: as plain loops give them."""
    from recoflow.operators import recommend as R
    from recoflow.operators import scoring

    monkeypatch.setattr(G, "ITEM_TILE", 32)
    monkeypatch.setattr(G, "LEAST_ROWS", 1)
    monkeypatch.setattr(scoring, "_scan", None)  # the scan of block pairs held all blocks of a query block at once
    U, V, seen = data(kind)
    seen |= {(0, i) for i in range(296)} | {(1, 299)}
    users, s = factors(spark, U), spark.createDataFrame(sorted(seen) + sorted(seen)[:50], "user_id int, item_id int")
    held = np.random.default_rng(1).integers(0, len(V), len(U))
    labels = spark.createDataFrame([(u, int(h)) for u, h in enumerate(held)] + [(2, 999), (999, 2)], "user_id int, item_id int")
    chunks = G.ItemChunks(factors(spark, V), 40 * 6 * 8)
    assert len(chunks.chunks) >= 8
    S, scaled = masked(U, V, seen)
    M = [[0.0 if (u, i) in seen else x for i, x in enumerate(row)] for u, row in enumerate(scaled)]
    got = sorted((r.user_id, r["rank"], r.item_id, r.score) for r in R.recommend_masked(users, chunks, s, 5).collect())
    assert got == [(u, n, i, M[u][i]) for u in range(len(U)) for n, i in enumerate(sorted(range(len(V)), key=lambda i: (-M[u][i], -i))[:5], 1)]
    places = {(r.user_id, r.item_id): r["rank"] for r in R.masked_label_ranks(users, chunks, labels, s).collect()}
    for u, h in enumerate(held):
        t = scaled[u][h]
        assert places.pop((u, h)) == 1 + sum(M[u][i] > t or (M[u][i] == t and i > h) for i in range(len(V)) if i != h)
    assert places == {(2, 999): None, (999, 2): None}
    for known in (None, s):
        ranks = {(r.user_id, r.item_id): r.heldout_rank for r in R.heldout_ranks(users, chunks, labels, known).collect()}
        skip = seen if known is not None else set()
        for u, h in enumerate(held):
            assert ranks[u, h] == 1 + sum(S[u, i] >= S[u, h] for i in range(len(V)) if i != h and (u, i) not in skip)


def test_chunk_kernels_keep_scores_that_scale_to_one(monkeypatch):
    """Raw scores that differ in the last bit may scale to the same value: then the larger id comes first."""
    V = np.array([[0.0], [1.0], [np.nextafter(0.5, 0)], [0.5], [np.nextafter(0.5, 1)], [-1e9]])
    ids = np.arange(len(V))
    side = ids, V, np.sqrt((V * V).sum(axis=1))
    order = np.lexsort((ids, -side[2]))
    side = ids[order], V[order], side[2][order]
    none = np.zeros(0, np.int64)
    lo, hi, (rows, found, x), _ = G.chunk_best(np.ones((1, 1)), side, 2, none, none, 1e9)
    assert (lo[0], hi[0]) == (-1e9, 1.0) and {1, 2, 3, 4} <= set(found.tolist())
    *_, count, _, near = G.chunk_counts(np.ones((1, 1)), np.array([0.5]), np.array([3]), side, none, none, True, 1e9)
    assert count[0] + len(near[0]) >= 3 and {2, 4} <= set(near[2].tolist())


def test_later_chunks_are_not_sent_when_no_user_can_reach_them(spark, monkeypatch):
    monkeypatch.setattr(G, "LEAST_ROWS", 1)
    rng = np.random.default_rng(5)
    U, V = rng.normal(size=(20, 4)), rng.normal(size=(400, 4)) * np.geomspace(1, 1e-6, 400)[:, None]
    chunks = G.ItemChunks(factors(spark, V), 40 * 4 * 8)
    got = {(r.user_id, r["rank"]): (r.item_id, r.score) for r in G.recommend(factors(spark, U), chunks, None, 3).collect()}
    assert got == plain(U, V, set(), 3)
    assert 0 < len(chunks._kept) < len(chunks.chunks) / 2


def test_score_pairs_in_chunks_moves_no_vector_with_a_pair(spark, monkeypatch):
    from recoflow.operators import scoring

    monkeypatch.setattr(G, "LEAST_ROWS", 1)
    U, V, seen = data("plain")
    pairs = spark.createDataFrame([(u, i, 1.5) for u, i in sorted(seen)] + [(900, 1, 0.0), (None, 1, 0.0), (1, None, 0.0)], "user_id int, item_id int, label double")
    scored = scoring.score_pairs(pairs, factors(spark, U), factors(spark, V), max_broadcast_bytes=40 * 6 * 8)
    assert "hashpartitioning" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {(r.user_id, r.item_id): (r.label, r.score) for r in scored.collect()}
    assert got == {(u, i): (1.5, dot(U[u], V[i])) for u, i in seen if i < len(V)}


def test_few_tiles_are_scored_where_boxes_tell_the_rest(monkeypatch):
    """Vectors of one length: their length cuts nothing; boxes do, for lists, ranges and counts, with the results of plain loops."""
    monkeypatch.setattr(G, "ITEM_TILE", 32)
    rng = np.random.default_rng(8)
    V = rng.normal(size=(4000, 3))
    V /= np.sqrt((V * V).sum(axis=1))[:, None]
    U, ids, length = rng.normal(size=(30, 3)), np.arange(len(V)) * 2, np.sqrt((V * V).sum(axis=1))
    order = G._laid(ids, V, length)
    side = ids[order], V[order], length[order]
    cells, scores = [0], G._Rows.scores

    def counted(self, r, i):
        out = scores(self, r, i)
        cells[0] += out[0].size
        return out

    monkeypatch.setattr(G._Rows, "scores", counted)
    S = np.array([[dot(u, v) for v in V] for u in U])
    seen = np.divmod(rng.choice(30 * 4000, 500, replace=False), 4000)
    left = S.copy()
    left[seen] = -np.inf
    none = np.full(len(U), -np.inf)
    (rows, found, _), _, _ = G.top_k(U, side, np.full(len(U), 5), none, seen[0], 2 * seen[1])
    assert found.tolist() == [2 * i for s in left for i in sorted(range(len(V)), key=lambda i: (-s[i], i))[:5]]
    held = rng.integers(0, 4000, 30)
    want = [1 + sum(left[u] >= S[u, h]) - (left[u, h] >= S[u, h]) for u, h in enumerate(held)]
    assert G.label_ranks(U, side, 2 * held, seen[0], 2 * seen[1], False).tolist() == want
    lo, hi, *_ = G.chunk_best(U, side, 5, seen[0], 2 * seen[1], 1.0)
    assert lo.tolist() == S.min(axis=1).tolist() and hi.tolist() == S.max(axis=1).tolist()
    assert cells[0] < S.size  # three scans of all cells before


@pytest.mark.parametrize("kind", ["plain", "equal", "long", "zero"])
def test_a_tile_is_scored_once_for_range_list_and_count(monkeypatch, kind):
    monkeypatch.setattr(G, "ITEM_TILE", 32)
    monkeypatch.setattr(G, "BOX_DIMS", 0)  # no boxes: as with vectors of many dimensions
    U, V, seen = data(kind)
    length = np.sqrt((V * V).sum(axis=1))
    order = np.lexsort((np.arange(len(V)), -length))
    side = order, np.ascontiguousarray(V[order]), length[order]
    rows, sids = (np.array(x) for x in zip(*sorted(seen)))
    scored, scores = [], G._Rows.scores
    monkeypatch.setattr(G._Rows, "scores", lambda q, r, i: scored.extend(zip(r.tolist(), i.tolist())) or scores(q, r, i))
    held = np.arange(len(U))
    t = np.array([dot(u, V[h]) for u, h in zip(U, held)])
    for run in (lambda: G.chunk_best(U, side, 5, rows, sids, length.max()), lambda: G.chunk_counts(U, t, held, side, rows, sids, True, length.max())):
        scored.clear()
        run()
        assert scored and len(scored) == len(set(scored))


def test_exact_scores_are_those_of_a_plain_loop(monkeypatch):
    from recoflow.operators import scoring
    rng = np.random.default_rng(6)
    U, V = rng.normal(size=(9, 5)), rng.normal(size=(11, 5))
    U[0] = V[0] = -0.0
    rows, cols = rng.integers(0, 9, 50), rng.integers(0, 11, 50)
    monkeypatch.setattr(scoring, "EXACT_PAIRS", 7)
    assert scoring._exact(U, V, rows, cols).tolist() == [dot(U[r], V[c]) for r, c in zip(rows, cols)]
    assert scoring._exact(U[:, :0], V[:, :0], rows, cols).tolist() == [0.0] * 50


def test_pairs_are_listed_a_few_tiles_at_a_time(monkeypatch):
    monkeypatch.setattr(G, "ITEM_TILE", 8)
    U, V, seen = data("plain")
    length = np.sqrt((V * V).sum(axis=1))
    order = G._laid(np.arange(len(V)), V, length)
    side = order, np.ascontiguousarray(V[order]), length[order]
    rows, sids = (np.array(x) for x in zip(*sorted(seen)))
    held = np.arange(len(U))
    t = np.array([dot(u, V[h]) for u, h in zip(U, held)])
    none = np.full(len(U), -np.inf)
    runs = (lambda: G.masked_top_k(U, side, 3, rows, sids), lambda: G.label_ranks(U, side, held, rows, sids, True),
            lambda: G.label_ranks(U, side, held, rows, sids, False), lambda: G.top_k(U, side, np.full(len(U), 3), none, rows, sids)[0])
    want = [run() for run in runs]
    listed, groups = [], G._Tiles.groups
    monkeypatch.setattr(G._Tiles, "groups", lambda tiles, tile, row: listed.append(len(tile)) or groups(tiles, tile, row))
    monkeypatch.setattr(G, "OPEN_PAIRS", 3 * len(U))
    monkeypatch.setattr(G, "KEPT_ROWS", 5)
    for run, before in zip(runs, want):
        assert np.array_equal(np.concatenate(run(), axis=None), np.concatenate(before, axis=None))
    assert 0 < max(listed) <= 3 * len(U)


def test_scan_workers_do_without_pandas():
    import subprocess
    import sys
    from pathlib import Path
    code = "import sys, recoflow.operators.gridscan; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent).returncode == 0


def test_driver_holds_one_copy_while_a_chunk_is_sent(spark, monkeypatch):
    import pyarrow as pa
    chunks = G.ItemChunks(spark.range(4000).selectExpr("cast(id as int) id", "transform(sequence(1, 64), x -> double(x * id)) features"))
    context, before, held = type(spark.sparkContext), pa.total_allocated_bytes(), []
    broadcast = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, x: held.append(pa.total_allocated_bytes() - before) or broadcast(self, x))
    ids, V, length = chunks.send(0).value
    assert V.shape == (4000, 64) and len(held) == 1 and held[0] < V.nbytes // 4
