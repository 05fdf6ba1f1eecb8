"""All-items scans that mask what a user has seen inside the kernel.

The item side is cut into chunks of at most ``CHUNK_BYTES``, in order of falling vector length; a chunk is broadcast by itself, and a worker holds
one chunk at a time, whatever the catalogue's size. A query row carries the ids that its user has seen in the chunk (at most the chunk's
rows), so nothing is fetched beyond k and no pair is listed. Lists of raw scores go chunk by chunk: after each the k best of a user are kept,
and only users whose bound still reaches the next chunk are scanned again. Ranges, masked lists and ranks need every item: the chunks' parts
(range, k best, count) come from one job and are put together per query row.

Exact pruning: a chunk is cut into tiles of items, by falling length of their vectors or, with few dimensions, of items near each other. A tile's
scores lie within ±|u| times its greatest length and within what the box around its vectors allows. A row looks at a tile only where these bounds
leave open whether it holds one of the k best, an end of the range or, for a count, scores on both sides of the held one; a tile that lies above the
held score as a whole is counted by its size. Chunks come by falling length, so a row that no later chunk can reach is not scanned again.

Scores come from a matrix product, in single precision where the lengths allow it; those that are emitted or lie within its rounding bound of a
cut are accumulated dimension by dimension in index order, as ``functions.columns.dot`` does, so results are those of SQL, ties included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoflow.functions.columns import minmax_scaled
from recoflow.operators.scoring import MAX_SCAN_TASKS, _exact, _item_size
from recoflow.session import materialize, materialize_bucketed

QUERY_TILE = 512
ITEM_TILE = 1024
BOX_DIMS = 16  # boxes around vectors of more dimensions are too wide to tell anything
BOX_ITEM_TILE = 512  # items of a box
DENSE_ROWS = 24  # a tile that fewer rows look at is scored pair by pair
PAIRS = 1024  # (row, tile) pairs scored at once
MAX_KEPT = 1 << 22  # rows of the best lists that one query tile keeps
LEAST_ROWS = 256  # of a chunk, whatever the limit
CHUNK_BYTES = 48 << 20
OPEN_PAIRS = 1 << 18  # (row, tile) pairs listed at once
KEPT_ROWS = 1 << 17  # candidates of a query tile before they are cut to those that can still lead
CELLS_PER_TASK = 1 << 31  # query rows × items of a chunk scored by one task: some seconds
SAFE_LENGTH = 1e15  # single precision holds products of vectors up to this length


# ---- the item side ---------------------------------------------------------------------

class ItemChunks:
    """Items in chunks of at most ``max_bytes``, longest vectors first. ``send(c)`` broadcasts a chunk: ids, vectors and lengths."""

    def __init__(self, items: DataFrame, max_bytes: int = CHUNK_BYTES):
        self.spark = items.sparkSession
        self.n_items, self.dim = _item_size(items)
        rows = max(LEAST_ROWS, max_bytes // (8 * max(self.dim, 1)))
        wanted = max(1, math.ceil(self.n_items / rows))
        length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
        self.several = wanted > 1
        self._kept = {}
        if not self.several:
            self.table, self.chunks = items.select("id", "features"), [0][: self.n_items]
            return
        items = materialize(items.select("id", "features", length.alias("length")))
        cuts = items.agg(F.percentile_approx("length", [k / wanted for k in range(wanted - 1, 0, -1)], 10_000)).first()[0]  # one a chunk
        band = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: F.col("length") < c))
        sizes = {r.band: r["n"] for r in items.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}
        # equal lengths cannot be told apart by a cut: a band that is still too long is split by id
        parts = {b: math.ceil(n / rows) for b, n in sizes.items()}
        spread = F.create_map(*[F.lit(x) for p in parts.items() for x in p])[F.col("band")]
        most = max(parts.values())
        placed = items.withColumn("band", band).withColumn("chunk", F.col("band") * most + F.pmod(F.xxhash64("id"), spread).cast("int"))
        self.table = materialize(placed.select("id", "features", "length", "chunk"))
        found = self.table.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()  # a row a chunk
        self.longest = {r.chunk: r.longest for r in found}
        self.most = max(r.n for r in found)
        self.chunks = sorted(self.longest)

    def rows(self, chunk: int) -> DataFrame:
        return self.table.where(F.col("chunk") == chunk).select("id", "features") if self.several else self.table

    def send(self, chunk: int):
        """A broadcast of (ids, vectors, lengths), laid out in tiles; its size was checked. It is kept for later scans of the same items."""
        if chunk not in self._kept:
            t = self.rows(chunk).toArrow()
            ids, V = t.column("id").to_numpy().astype(np.int64), _matrix(t.column("features"), self.dim)
            length = np.sqrt(np.einsum("ij,ij->i", V, V))
            order = _laid(ids, V, length)
            side = ids[order], V[order], length[order]
            del t, V  # of the chunk the driver holds one copy while it is sent
            self._kept[chunk] = self.spark.sparkContext.broadcast(side)
        return self._kept[chunk]

    def places(self) -> DataFrame:
        """(item_id, chunk), each id once: the chunk of its longest vector."""
        return self.table.groupBy(F.col("id").alias("item_id")).agg(F.min("chunk").alias("chunk"))

    def destroy(self):
        for sent in self._kept.values():
            sent.destroy()
        self._kept = {}


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


# ---- kernels ---------------------------------------------------------------------------

def _kind(U: np.ndarray, longest: float):
    """The precision of a product: single where lengths are far from its range."""
    most = max(float(np.abs(U).max(initial=0.0)) * max(U.shape[1], 1), longest)
    return np.float32 if most < SAFE_LENGTH else np.float64


def _bound(norm: np.ndarray, length: float, dim: int, kind) -> np.ndarray:
    """Rounding bound of products with vectors of at most this length, their operands rounded to ``kind`` too."""
    return norm * (length * (dim + 4) * (np.finfo(kind).eps + 8 * np.finfo(np.float64).eps)) + dim * float(np.finfo(np.float32).tiny) * (1 + norm + length)


def _down(x: np.ndarray, kind) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(kind), kind(-np.inf))[:, None]


def _up(x: np.ndarray, kind) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(kind), kind(np.inf))[:, None]


def _counted(mask: np.ndarray) -> np.ndarray:
    """True cells of each row."""
    if mask.shape[1] % 8 == 0 and mask.shape[1] < 8 * 256 and mask.flags.c_contiguous:  # eight cells at once, sums of a byte each
        return mask.view(np.uint64).sum(axis=1).view(np.uint8).reshape(len(mask), 8).sum(axis=1, dtype=np.int64)
    return np.bitwise_count(np.packbits(mask, axis=1)).sum(axis=1, dtype=np.int64)


def _tile_sizes(dim: int) -> tuple[int, int]:
    """Query rows and items of a tile."""
    return (4 * QUERY_TILE, min(BOX_ITEM_TILE, ITEM_TILE)) if 0 < dim <= BOX_DIMS else (QUERY_TILE, ITEM_TILE)


def _laid(ids, V, length) -> np.ndarray:
    """The order of a chunk's items: by falling length or, with few dimensions, halved along the widest one until the parts are tiles."""
    order = np.lexsort((ids, -length))
    if not 0 < V.shape[1] <= BOX_DIMS:
        return order
    step = _tile_sizes(V.shape[1])[1]
    parts = [(0, len(order))]
    while parts:
        a, b = parts.pop()
        if b - a <= step:
            continue
        X = V[order[a:b]]
        half = max(1, (b - a) // (2 * step)) * step
        order[a:b] = order[a:b][np.argpartition(X[:, np.ptp(X, axis=0).argmax()], half)]
        parts += [(a, a + half), (a + half, b)]
    return order


class _Tiles:
    """Item tiles of a chunk: first places, greatest lengths and the boxes around their vectors."""

    def __init__(self, item_side, dim: int, kind):
        self.ids, self.V, length = item_side
        self.kind, self.V1, self.step = kind, self.V.astype(kind), _tile_sizes(dim)[1]
        n = len(self.V)
        self.starts = np.arange(0, n, self.step)
        self.longest = np.maximum.reduceat(length, self.starts) if n else np.zeros(0)
        self.full = n // self.step
        self.by_tile = self.V1[: self.full * self.step].reshape(self.full, self.step, dim) if dim else None
        self.box = None
        if n and 0 < dim <= BOX_DIMS:
            self.box = np.minimum.reduceat(self.V1, self.starts), np.maximum.reduceat(self.V1, self.starts)

    def open_groups(self, asked, n_rows: int):
        """The groups of the pairs for which ``asked`` (of a slice of tiles) holds; the pairs of a few tiles are listed at a time."""
        step = max(1, OPEN_PAIRS // max(n_rows, 1))
        for a in range(0, len(self.starts), step):
            tile, row = np.nonzero(asked(slice(a, a + step)))
            yield from self.groups(tile + a, row)

    def groups(self, tile, row):
        """The pairs (tile, row) in groups that are scored at once: of one tile, or of single pairs of many."""
        order = np.argsort(tile, kind="stable")
        tile, row = tile[order], row[order]
        alone = (np.bincount(tile, minlength=1)[tile] >= DENSE_ROWS) | (tile >= self.full)
        some = tile[alone]
        cuts = np.flatnonzero(some[1:] != some[:-1]) + 1
        if len(some):
            yield from zip(np.split(row[alone], cuts), np.split(some, cuts))
        tile, row = tile[~alone], row[~alone]
        for x in range(0, len(tile), PAIRS):
            yield row[x: x + PAIRS], tile[x: x + PAIRS]


class _Rows:
    """Query rows of one tile against the item tiles."""

    def __init__(self, Uq, tiles: _Tiles, mrow, mplace):
        self.Uq, self.tiles = Uq, tiles
        self.U1, self.norm = Uq.astype(tiles.kind), np.sqrt((Uq * Uq).sum(axis=1))
        key = mrow * len(tiles.starts) + mplace // tiles.step
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], mplace[order]
        # (tile, row): the greatest and the least score that a tile may hold, up to ``wide``
        longest = tiles.longest.astype(tiles.kind)
        self.upper = longest[:, None] * self.norm.astype(tiles.kind)[None, :]
        self.lower = -self.upper
        if tiles.box is not None:
            least, most = tiles.box
            up, down = np.maximum(self.U1, 0).T, np.minimum(self.U1, 0).T
            for bound, a, b, nearer in ((self.upper, most, least, np.minimum), (self.lower, least, most, np.maximum)):
                of_box = a @ up
                of_box += b @ down
                nearer(bound, of_box, out=bound)
                del of_box
        self.upper[np.isnan(self.upper)] = np.inf
        self.lower[np.isnan(self.lower)] = -np.inf
        self.wide = 8 * _bound(self.norm, tiles.longest.max(initial=0.0), Uq.shape[1], tiles.kind)
        self.looked = np.zeros(self.upper.shape, bool)  # pairs (tile, row) that the ranges know

    def scores(self, r, i):
        """Products of the pairs (row, tile) and their rounding bounds."""
        t = self.tiles
        if i[0] == i[-1]:
            S = self.U1[r] @ t.V1[t.starts[i[0]]: t.starts[i[0]] + t.step].T
        else:
            S = np.matmul(t.by_tile[i], self.U1[r][:, :, None])[:, :, 0]
        return S, _bound(self.norm[r], t.longest[i], self.Uq.shape[1], t.kind)

    def exact(self, r, i, pair, cc):
        """Places and exact scores of some cells."""
        at = cc + self.tiles.starts[i[pair]]
        return at, _exact(self.Uq, self.tiles.V, r[pair], at)

    def mask(self, S, r, i):
        """Leaves out what the rows have seen."""
        key = r * len(self.tiles.starts) + i
        first, many = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        n = many - first
        pair = np.repeat(np.arange(len(r)), n)
        spot = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + first[pair]
        S[pair, self.place[spot] - self.tiles.starts[i[pair]]] = -np.inf

    def widen(self, lo, hi, S, bound, r, i):
        """Takes the exact least and largest scores into the rows' ranges; returns the pairs' largest products."""
        self.looked[i, r] = True
        least, most = S.min(axis=1), S.max(axis=1)
        p = np.flatnonzero(least - bound <= lo[r])
        if len(p):
            pp, cc = np.nonzero(S[p] <= _up(least[p] + 2 * bound[p], self.tiles.kind))
            np.minimum.at(lo, r[p[pp]], self.exact(r, i, p[pp], cc)[1])
        p = np.flatnonzero(most + bound >= hi[r])
        if len(p):
            pp, cc = np.nonzero(S[p] >= _down(most[p] - 2 * bound[p], self.tiles.kind))
            np.maximum.at(hi, r[p[pp]], self.exact(r, i, p[pp], cc)[1])
        return most

    def ends(self, lo, hi):
        """The rows' ranges over all tiles: of those that were not looked at, as far as they can matter."""
        all_rows = np.arange(len(self.Uq))
        for best in (self.upper.argmax(axis=0), self.lower.argmin(axis=0)):
            new = ~self.looked[best, all_rows]
            for r, i in self.tiles.groups(best[new], all_rows[new]):
                self.widen(lo, hi, *self.scores(r, i), r, i)

        def asked(s):
            over, under = _reached(hi - self.wide, self.tiles.kind), -_reached(-lo - self.wide, self.tiles.kind)
            return ((self.upper[s] >= over) | (self.lower[s] <= under)) & ~self.looked[s]

        for r, i in self.tiles.open_groups(asked, len(self.Uq)):
            live = (hi[r] <= self.upper[i, r] + self.wide[r]) | (lo[r] >= self.lower[i, r] - self.wide[r])
            r, i = r[live], i[live]
            if len(r):
                self.widen(lo, hi, *self.scores(r, i), r, i)


def _reached(x, kind):
    """Rounded down to ``kind``, one value for each row."""
    return _down(x, kind)[:, 0]


def chunk_counts(U, t, held, item_side, seen_rows, seen_ids, masked: bool, longest: float):
    """One chunk's part in the ranks of held items that score ``t``: range (lo, hi) of all scores, others that come before, seen ids behind
    which a held item at 0 comes, and (row, score, id) of those whose order only the range of all chunks tells (scaled scores may round to one).

    Plain: others not seen that score as much or more. Masked: by (scaled score desc, id desc), seen ones left out.
    """
    ids, V, length = item_side
    n, dim = len(ids), U.shape[1]
    kind = _kind(U, longest)
    by_id = _by_id(ids)
    at = np.minimum(np.searchsorted(ids, held, sorter=by_id), max(n - 1, 0))
    place = np.where(ids[by_id[at]] == held, by_id[at], -1)
    srow, splace = _positions(ids, seen_rows, seen_ids)
    lo, hi, count, after = np.full(len(U), np.inf), np.full(len(U), -np.inf), np.zeros(len(U), np.int64), np.zeros(len(U), np.int64)
    near = []
    rows_of_tile, step = _tile_sizes(dim)
    tiles = _Tiles(item_side, dim, kind)
    sizes = np.diff(np.append(tiles.starts, n))
    for a in range(0, len(U), rows_of_tile):
        b = min(a + rows_of_tile, len(U))
        tq, h, hid = t[a:b], place[a:b], held[a:b]
        mine = (srow >= a) & (srow < b)
        mrow, mplace = srow[mine] - a, splace[mine]
        other = mplace != h[mrow]
        after[a:b] = np.bincount(mrow[(ids[mplace] > hid[mrow]) & other], minlength=b - a)
        has = np.flatnonzero(h >= 0)
        # left out: seen ones and the held one
        mrow, mplace = np.concatenate((mrow[other], has)), np.concatenate((mplace[other], h[has]))
        q = _Rows(U[a:b], tiles, mrow, mplace)
        alike = 32 * np.finfo(np.float64).eps * q.norm * longest  # scaled scores of raw ones this close may be equal
        whole = q.lower > _up(tq + (q.wide + alike), kind)[:, 0]  # tiles above the held score
        least_upper = _reached(tq - (q.wide + alike), kind)
        count[a:b] += step * whole.sum(axis=0) - (step - sizes[-1:].sum()) * whole[-1:].sum(axis=0) - np.bincount(mrow[whole[mplace // step, mrow]], minlength=b - a)
        for r, i in tiles.open_groups(lambda s: (q.upper[s] >= least_upper) & ~whole[s], b - a):
            S, bound = q.scores(r, i)
            if masked:
                q.widen(lo[a:b], hi[a:b], S, bound, r, i)
            q.mask(S, r, i)
            margin = bound + alike[r]
            above, least = S > _up(tq[r] + margin, kind), S >= _down(tq[r] - margin, kind)
            sure, maybe = _counted(above), _counted(least)
            np.add.at(count, a + r, sure)
            open_ = np.flatnonzero(maybe != sure)
            if not len(open_):
                continue
            pair, cc = np.nonzero(least[open_] & ~above[open_])
            pair = open_[pair]
            ok = S[pair, cc] > -np.inf
            at, x = q.exact(r, i, pair[ok], cc[ok])
            rr = r[pair[ok]]
            if not masked:
                count[a:b] += np.bincount(rr[x >= tq[rr]], minlength=b - a)
                continue
            equal = x == tq[rr]
            unclear = ~equal & (np.abs(x - tq[rr]) <= alike[rr])
            before = (equal & (ids[at] > hid[rr])) | (~equal & ~unclear & (x > tq[rr]))
            count[a:b] += np.bincount(rr[before], minlength=b - a)
            near.append((rr[unclear] + a, x[unclear], ids[at][unclear]))
        if masked:
            q.ends(lo[a:b], hi[a:b])
    near = [np.concatenate(v) for v in zip(*near)] if near else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
    return lo, hi, count, after, near


def _leading(rows, ids, scores, k: int, alike):
    """Of each row all that can be among its k best when scores this close may be equal and larger ids come first; and the rows' k-th best score."""
    order = np.lexsort((-ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    floor = np.full(len(alike), -np.inf)
    floor[rows[nth == k - 1]] = scores[nth == k - 1]
    new = np.append(True, (rows[1:] != rows[:-1]) | (scores[1:] != scores[:-1]))[: len(rows)]
    run = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    keep = (run < k) & (scores >= floor[rows] - alike[rows])
    return rows[keep], ids[keep], scores[keep], floor


def chunk_best(U, item_side, k: int, seen_rows, seen_ids, longest: float):
    """One chunk's part in the masked lists: range (lo, hi) of all scores, (row, id, score) of the unseen items that can be among the k best by
    (scaled score desc, id desc), and (row, id) of the k largest seen ids where those, at 0, can be among them."""
    ids, V, length = item_side
    dim = U.shape[1]
    kind = _kind(U, longest)
    srow, splace = _positions(ids, seen_rows, seen_ids)
    lo, hi = np.full(len(U), np.inf), np.full(len(U), -np.inf)
    out, zeros = [], []
    rows_of_tile = max(1, min(_tile_sizes(dim)[0], MAX_KEPT // max(k, 1)))
    tiles = _Tiles(item_side, dim, kind)
    for a in range(0, len(U), rows_of_tile if len(ids) else max(len(U), 1)):
        b = min(a + rows_of_tile, len(U))
        mine = (srow >= a) & (srow < b)
        mrow, mplace = srow[mine] - a, splace[mine]
        q = _Rows(U[a:b], tiles, mrow, mplace)
        alike = 32 * np.finfo(np.float64).eps * q.norm * longest
        floor = np.full(b - a, -np.inf)
        top = np.full((b - a, k), -np.inf)  # the k best scores so far
        kept, n_kept, limit = [], 0, max(4 * k * (b - a), KEPT_ROWS)
        first, places = q.upper.argmax(axis=0), np.arange(len(tiles.starts))[:, None]

        def pairs():
            yield from tiles.groups(first, np.arange(b - a))
            yield from tiles.open_groups(lambda s: (q.upper[s] >= _reached(floor - (q.wide + alike), kind)) & (first != places[s]), b - a)

        for r, i in pairs():
            live = q.upper[i, r] + (q.wide + alike)[r] >= floor[r]
            r, i = r[live], i[live]
            if not len(r):
                continue
            S, bound = q.scores(r, i)
            best = q.widen(lo[a:b], hi[a:b], S, bound, r, i)
            q.mask(S, r, i)
            cut = floor[r]
            short = np.flatnonzero(np.isneginf(cut))
            if len(short) and k < S.shape[1]:
                # rows without k so far: the k-th best of the tile
                cut[short] = np.partition(S[short], S.shape[1] - k, axis=1)[:, S.shape[1] - k] - bound[short]
            least = _down(cut - bound - alike[r], kind)
            some = np.flatnonzero(best >= least[:, 0])
            pair, cc = np.nonzero(S[some] >= least[some])
            pair = some[pair]
            ok = S[pair, cc] > -np.inf
            if not ok.any():
                continue
            at, x = q.exact(r, i, pair[ok], cc[ok])
            rr = r[pair[ok]]
            kept.append((rr, ids[at], x))
            n_kept += len(rr)
            order = np.lexsort((-x, rr))
            rr, x = rr[order], x[order]
            nth = np.arange(len(rr)) - np.searchsorted(rr, rr)
            rr, x, nth = rr[nth < k], x[nth < k], nth[nth < k]
            some, of = np.unique(rr, return_inverse=True)
            fresh = np.full((len(some), k), -np.inf)
            fresh[of, nth] = x
            top[some] = -np.sort(-np.concatenate((top[some], fresh), axis=1), axis=1)[:, :k]
            floor[some] = top[some, k - 1]
            if n_kept > limit:
                kept = [_leading(*(np.concatenate(v) for v in zip(*kept)), k, alike)[:3]]
                n_kept = len(kept[0][0]) // 2
        q.ends(lo[a:b], hi[a:b])
        none = np.zeros(0, np.int64)
        rows, found, scores, _ = _leading(*(np.concatenate(v) for v in zip(*kept)), k, alike) if kept else (none, none, np.zeros(0), None)
        out.append((rows + a, found, scores))
        # seen items score 0: they matter where fewer than k unseen ones of the chunk lie above the range's end
        sure = np.bincount(rows[scores > (lo[a:b] + alike)[rows]], minlength=b - a) >= k
        r, i, _ = _best(mrow, ids[mplace], np.zeros(len(mrow)), np.full(b - a, k), True)
        zeros.append((r[~sure[r]] + a, i[~sure[r]]))
    join = lambda parts, m: [np.concatenate(v) for v in zip(*parts)] if parts else [np.zeros(0, np.int64)] * m
    return lo, hi, join(out, 3), join(zeros, 2)


_LAST_SORTED: list = [None, None]


def _by_id(ids: np.ndarray) -> np.ndarray:
    """The order of a chunk's ids; that of the last chunk is kept, as a worker's batches ask for it again."""
    if _LAST_SORTED[0] is not ids:
        _LAST_SORTED[:] = ids, np.argsort(ids, kind="stable")
    return _LAST_SORTED[1]


def _positions(ids: np.ndarray, rows: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ids) of the seen ids that are there, sorted by place."""
    by_id = _by_id(ids)
    at = np.minimum(np.searchsorted(ids, seen, sorter=by_id), max(len(ids) - 1, 0))
    place = by_id[at] if len(ids) else at
    known = ids[place] == seen if len(ids) else np.zeros(len(seen), bool)
    rows, place = rows[known], place[known]
    order = np.argsort(place, kind="stable")
    return rows[order], place[order]


def _best(rows, ids, scores, k, largest_id_first=False):
    """The k[row] best of each row: (score desc, id)."""
    order = np.lexsort((-ids if largest_id_first else ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = nth < k[rows]
    return rows[keep], ids[keep], scores[keep]


def top_k(U, item_side, k, floor, seen_rows, seen_ids):
    """Of each row of U the k best unseen items whose score is at least its floor: (rows, ids, scores), and tiles looked at and skipped."""
    ids, V, length = item_side
    done, skipped = 0, 0
    out = []
    kind = _kind(U, length.max(initial=0.0))
    srow, splace = _positions(ids, seen_rows, seen_ids)
    most = int(k.max(initial=0))
    rows_of_tile = max(1, min(_tile_sizes(U.shape[1])[0], MAX_KEPT // max(most, 1)))
    tiles = _Tiles(item_side, U.shape[1], kind)
    for a in range(0, len(U) if len(ids) else 0, rows_of_tile):
        b = min(a + rows_of_tile, len(U))
        kq, fq = k[a:b], floor[a:b].copy()
        mine = (srow >= a) & (srow < b)
        q = _Rows(U[a:b], tiles, srow[mine] - a, splace[mine])
        best_ids, best_scores, have = np.zeros((b - a, most), np.int64), np.zeros((b - a, most)), np.zeros(b - a, np.int64)
        first, places = q.upper.argmax(axis=0), np.arange(len(tiles.starts))[:, None]
        looked = np.zeros(len(tiles.starts), bool)

        def pairs():
            yield from tiles.groups(first, np.arange(b - a))
            yield from tiles.open_groups(lambda s: (q.upper[s] >= _reached(fq - q.wide, kind)) & (first != places[s]), b - a)

        for r, i in pairs():
            live = (q.upper[i, r] + q.wide[r] >= fq[r]) & (kq[r] > 0)
            r, i = r[live], i[live]
            if not len(r):
                continue
            looked[i] = True
            S, bound = q.scores(r, i)
            q.mask(S, r, i)
            cut = fq[r]
            short = np.flatnonzero(np.isneginf(cut))
            many, width = int(kq[r][short].max(initial=0)), S.shape[1]
            if 0 < many < width:
                # rows without k so far: their own k-th best of the tile
                tile = np.partition(S[short], width - many, axis=1)[:, width - many] - bound[short]
                cut[short] = np.where(kq[r][short] == many, tile, cut[short])
            least = _down(cut - bound, kind)
            some = np.flatnonzero(S.max(axis=1) >= least[:, 0])
            pair, cc = np.nonzero(S[some] >= least[some])
            pair = some[pair]
            ok = S[pair, cc] > -np.inf
            if not ok.any():
                continue
            at, x = q.exact(r, i, pair[ok], cc[ok])
            rr = r[pair[ok]]
            some = np.unique(rr)
            old = np.repeat(some, have[some])
            nth = np.arange(len(old)) - np.searchsorted(old, old)
            rows, found, scores = _best(np.concatenate((old, rr)), np.concatenate((best_ids[old, nth], ids[at])), np.concatenate((best_scores[old, nth], x)), kq)
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            best_ids[rows, nth], best_scores[rows, nth] = found, scores
            have[some] = np.bincount(rows, minlength=b - a)[some]
            # rows that have k: their last score is the floor
            enough = some[have[some] >= kq[some]]
            fq[enough] = np.maximum(fq[enough], best_scores[enough, kq[enough] - 1])
        done, skipped = done + int(looked.sum()), skipped + int((~looked).sum())
        rows = np.repeat(np.arange(b - a), have)
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        out.append((rows + a, best_ids[rows, nth], best_scores[rows, nth]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], done, skipped


def _scaled(x, lo, hi):
    return np.divide(x - lo, hi - lo, out=np.zeros_like(x), where=hi != lo)


def label_ranks(U, item_side, held, seen_rows, seen_ids, masked: bool):
    """The rank of each row's held item among all items (-1: no such item). Plain: 1 + unseen others that score as much or more.
    Masked: scores scaled to the row's range, seen ones 0; 1 + others that come before (score desc, id desc)."""
    ids, V, length = item_side
    if not len(ids):
        return np.full(len(U), -1, np.int64)
    by_id = _by_id(ids)
    place = by_id[np.minimum(np.searchsorted(ids, held, sorter=by_id), len(ids) - 1)]
    known = np.flatnonzero(ids[place] == held)
    t = np.full(len(U), np.inf)
    t[known] = _exact(U, V, known, place[known])
    lo, hi, count, after, (r, x, i) = chunk_counts(U, t, held, item_side, seen_rows, seen_ids, masked, length.max())
    rank = np.full(len(U), -1, np.int64)
    if masked:
        s = np.zeros(len(U))
        s[known] = _scaled(t[known], lo[known], hi[known])
        x = _scaled(x, lo[r], hi[r])
        count += np.bincount(r[(x > s[r]) | ((x == s[r]) & (i > held[r]))], minlength=len(U)) + np.where(s == 0, after, 0)
    rank[known] = 1 + count[known]
    return rank


def masked_top_k(U, item_side, k: int, seen_rows, seen_ids):
    """The k best items of each row by (scaled score desc, id desc), seen items at 0: (rows, ids, scores)."""
    lo, hi, (rows, found, x), (zero_rows, zero_ids) = chunk_best(U, item_side, k, seen_rows, seen_ids, item_side[2].max(initial=0.0))
    scores = np.concatenate((_scaled(x, lo[rows], hi[rows]), np.zeros(len(zero_rows))))
    return list(_best(np.concatenate((rows, zero_rows)), np.concatenate((found, zero_ids)), scores, np.full(len(U), k), True))


# ---- scans -----------------------------------------------------------------------------

def _seen_lists(seen: DataFrame) -> DataFrame:
    """(user_id, seen): distinct ids, combined map-side; at most the catalogue."""
    return seen.groupBy("user_id").agg(F.collect_set("item_id").alias("seen"))


def _parts(spark, n_items: int, n_queries: int) -> int:
    """Partitions by the work, rows times items, which the input's bytes do not show."""
    least = min(spark.sparkContext.defaultParallelism, n_queries)
    return max(1, min(MAX_SCAN_TASKS, math.ceil(n_queries * n_items / CELLS_PER_TASK)), least)


def _spread(queries: DataFrame, n_items: int, n_queries: int) -> DataFrame:
    return queries.repartition(_parts(queries.sparkSession, n_items, n_queries), "user_id")


def _seen_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = b.column("seen")
    n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(b.num_rows), n), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def recommend(users: DataFrame, items: DataFrame | ItemChunks, seen: DataFrame | None, k: int, max_bytes: int = CHUNK_BYTES, tiles: list | None = None) -> DataFrame:
    """(user_id, rank, item_id, score), the k best unseen items of each user by (score desc, id asc).

    A column ``k_wanted`` of ``users`` lowers k for a user. ``tiles``: two Spark accumulators, for item tiles looked at and skipped.
    """
    spark = users.sparkSession
    chunks = items if isinstance(items, ItemChunks) else ItemChunks(items, max_bytes)
    schema = "user_id int, rank int, item_id int, score double"
    wanted = F.least(F.col("k_wanted"), F.lit(k)) if "k_wanted" in users.columns else F.lit(k)
    queries = users.select(F.col("id").alias("user_id"), "features", wanted.cast("int").alias("k"))
    if not chunks.chunks:
        return spark.createDataFrame([], schema)
    if not chunks.several:
        q = queries.withColumn("floor", F.lit(float("-inf")))
        q = q.withColumn("seen", F.array().cast("array<int>")) if seen is None else q.join(_seen_lists(seen), "user_id", "left")
        return _spread(q, chunks.n_items, queries.count()).mapInArrow(_top_k_rows(chunks.send(chunks.chunks[0]), chunks.dim, tiles), schema)
    length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
    queries = materialize(queries.where("user_id is not null").withColumn("length", length * (1 + 1e-9)))
    repeated = queries.count() - queries.select("user_id").distinct().count()
    seen = None if seen is None else materialize(seen.select("user_id", "item_id"))
    best = spark.createDataFrame([], schema)
    for n, c in enumerate(chunks.chunks):
        # users whose k-th best the chunk's longest vector can still reach; chunks come by falling length
        last = best.groupBy("user_id").agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("n"))
        q = queries.join(last, "user_id", "left") if n else queries.withColumns({"last": F.lit(None).cast("double"), "n": F.lit(0)})
        q = q.withColumn("floor", F.when(F.col("n") >= F.col("k"), F.col("last")).otherwise(F.lit(float("-inf"))))
        q = q.where(F.col("floor") <= F.col("length") * F.lit(chunks.longest[c] * (1 + 1e-9))).select("user_id", "features", "k", "floor")
        q = materialize(q) if n else q.select("user_id", "features", "k", "floor")
        live = q.count()
        if not live:
            for _ in chunks.chunks[n:] if repeated else []:  # rows of one user share its list, as if each chunk had been scanned
                best = materialize(_k_best(best, queries))
            break
        if seen is None:
            q = q.withColumn("seen", F.array().cast("array<int>"))
        else:  # a user's seen ids of a chunk: at most the chunk's rows
            here = chunks.rows(c).select(F.col("id").alias("item_id")).distinct()
            q = q.join(_seen_lists(seen.join(here, "item_id", "left_semi")), "user_id", "left")
        found = _spread(q, chunks.most, live).mapInArrow(_top_k_rows(chunks.send(c), chunks.dim, tiles), schema)
        best = materialize(_k_best(best.unionByName(found), queries) if n else found)
    return best


def _k_best(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Exactly the k best of each user: of at most k rows so far and k of the new chunk."""
    nth = F.expr("row_number() over (partition by user_id order by score desc, item_id asc)")
    return rows.join(queries.select("user_id", "k"), "user_id").withColumn("rank", nth).where("rank <= k").select("user_id", "rank", "item_id", "score")


def _top_k_rows(sent, dim: int, tiles: list | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            user = b.column("user_id").to_numpy()
            (rows, ids, scores), done, skipped = top_k(_matrix(b.column("features"), dim), sent.value, b.column("k").to_numpy().astype(np.int64),
                                                       b.column("floor").to_numpy(zero_copy_only=False).astype(np.float64), *_seen_of(b))
            if tiles is not None:
                tiles[0].add(done)
                tiles[1].add(skipped)
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
            yield pa.RecordBatch.from_arrays([pa.array(user[rows]), pa.array(nth.astype(np.int32)), pa.array(ids.astype(np.int32)), pa.array(scores)],
                                             names=["user_id", "rank", "item_id", "score"])
    return run


def score_pairs(pairs: DataFrame, users: ItemChunks, items: ItemChunks) -> DataFrame:
    """(user_id, item_id, …) → + score where both sides passed the size check: nothing is shuffled, no vector travels with a pair."""
    sides = [x.send(x.chunks[0]) for x in (users, items)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = []
        for s in sides:
            ids, V, _ = s.value
            order = np.argsort(ids, kind="stable")
            known.append((ids[order], V[order]))
        for b in batches:
            keep, at = np.ones(b.num_rows, bool), []
            for name, (ids, _) in zip(("user_id", "item_id"), known):
                c = b.column(name)
                asked = c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
                keep &= (ids[place] == asked) & c.is_valid().to_numpy(zero_copy_only=False)
                at.append(place)
            score = _exact(known[0][1], known[1][1], at[0][keep], at[1][keep])
            part = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])
    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())]))


def report_scan(users: DataFrame, chunks: ItemChunks, labels: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """R1 from one scan, one chunk only: (user_id, rank, item_id, score, label_rank) — the masked lists (T3), and for each label a row without rank
    that holds the label's place in the whole masked order (A12)."""
    held = labels.groupBy("user_id").agg(F.collect_set("item_id").alias("held"))  # a user's held-out items: at most the catalogue
    q = users.select(F.col("id").alias("user_id"), "features").join(_seen_lists(seen), "user_id", "left").join(held, "user_id", "left")
    sent, dim = chunks.send(chunks.chunks[0]), chunks.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            U, (srow, sids) = _matrix(b.column("features"), dim), _seen_of(b)
            user = b.column("user_id").to_numpy()
            rows, ids, scores = masked_top_k(U, sent.value, k, srow, sids)
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
            lists = b.column("held")
            n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            of, item = np.repeat(np.arange(b.num_rows), n), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            # the seen ids once for each label of a user
            first, many = np.searchsorted(srow, of), np.searchsorted(srow, of, "right")
            each = np.repeat(np.arange(len(of)), many - first)
            spot = np.arange(len(each)) - np.repeat(np.cumsum(many - first) - (many - first), many - first) + first[each]
            place = label_ranks(U[of], sent.value, item, each, sids[spot], True)
            ok = place > 0
            none = pa.nulls(int(ok.sum()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((user[rows], user[of[ok]]))), pa.concat_arrays([pa.array(nth.astype(np.int32)), none]),
                                              pa.array(np.concatenate((ids, item[ok])).astype(np.int32)), pa.array(np.concatenate((scores, np.full(int(ok.sum()), np.nan)))),
                                              pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(place[ok])])], names=["user_id", "rank", "item_id", "score", "label_rank"])
    return _spread(q, chunks.n_items, users.count()).mapInArrow(run, "user_id int, rank int, item_id int, score double, label_rank long")


def rank_labels(users: DataFrame, chunks: ItemChunks, labels: DataFrame, seen: DataFrame | None, masked: bool) -> DataFrame:
    """(user_id, item_id, rank) of the labels whose user and item have factors; one chunk only. No vector leaves its row: the kernel knows all items."""
    q = labels.select("user_id", "item_id").distinct().join(users.select(F.col("id").alias("user_id"), "features"), "user_id")
    q = q.withColumn("seen", F.array().cast("array<int>")) if seen is None else q.join(_seen_lists(seen), "user_id", "left")
    sent, dim = chunks.send(chunks.chunks[0]), chunks.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("item_id").to_numpy().astype(np.int64)
            rank = label_ranks(_matrix(b.column("features"), dim), sent.value, held, *_seen_of(b), masked)
            out = pa.RecordBatch.from_arrays([b.column("user_id"), b.column("item_id"), pa.array(rank)], names=["user_id", "item_id", "rank"])
            yield out.filter(pa.array(rank > 0))
    return _spread(q, chunks.n_items, labels.count()).mapInArrow(run, "user_id int, item_id int, rank long")


def recommend_masked(users: DataFrame, chunks: ItemChunks, seen: DataFrame, k: int) -> DataFrame:
    """T3 + P8 + P9: (user_id, rank, item_id, score) by (masked scaled score desc, id desc), ranges and lists from one scan; one chunk only."""
    q = users.select(F.col("id").alias("user_id"), "features").join(_seen_lists(seen), "user_id", "left")
    sent, dim = chunks.send(chunks.chunks[0]), chunks.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, scores = masked_top_k(_matrix(b.column("features"), dim), sent.value, k, *_seen_of(b))
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
            yield pa.RecordBatch.from_arrays([pa.array(b.column("user_id").to_numpy()[rows]), pa.array(nth.astype(np.int32)), pa.array(ids.astype(np.int32)), pa.array(scores)],
                                             names=["user_id", "rank", "item_id", "score"])
    return _spread(q, chunks.n_items, users.count()).mapInArrow(run, "user_id int, rank int, item_id int, score double")


# ---- scans of several chunks -------------------------------------------------------------

def _dealt(queries: DataFrame, chunks: ItemChunks, seen: DataFrame | None):
    """For each chunk the query rows with the ids that their users have seen of it: (chunk, rows). Both tables are written once in buckets of the
    user, so that no chunk shuffles them again. ``queries`` is a written table."""
    parts = _parts(queries.sparkSession, chunks.most, queries.count())
    rows = materialize_bucketed(queries.repartition(parts, "user_id"), ["user_id"], parts)
    if seen is not None:
        at = chunks.table.select(F.col("id").alias("item_id"), "chunk").distinct()
        placed = seen.select("user_id", "item_id").where("user_id is not null").join(at, "item_id")
        seen = materialize_bucketed(placed.repartition(parts, "user_id"), ["user_id"], parts)
    for c in chunks.chunks:
        yield c, rows.withColumn("seen", F.array().cast("array<int>")) if seen is None else rows.join(_seen_lists(seen.where(F.col("chunk") == c)), "user_id", "left")


def _united(parts: list[DataFrame]) -> DataFrame:
    """A union of halves, so that its plan is as deep as the logarithm of their number."""
    while len(parts) > 1:
        parts = [a[0].unionByName(a[1]) if len(a) > 1 else a[0] for a in (parts[k: k + 2] for k in range(0, len(parts), 2))]
    return parts[0]


def _numbered(queries: DataFrame) -> DataFrame:
    """Written, with a number for each row: rows of one user stay apart."""
    return materialize(queries.withColumn("row", F.monotonically_increasing_id()))


def recommend_masked_chunks(users: DataFrame, chunks: ItemChunks, seen: DataFrame, k: int) -> DataFrame:
    """As ``recommend_masked``, of any number of chunks: each gives its range and what can be among the k best, a window over these ends it."""
    queries = _numbered(users.select(F.col("id").alias("user_id"), "features"))
    longest, dim = max(chunks.longest.values()), chunks.dim

    def scan(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, user = b.column("row").to_numpy(), b.column("user_id").to_numpy(zero_copy_only=False)
                lo, hi, (r, i, x), (zr, zi) = chunk_best(_matrix(b.column("features"), dim), sent.value, k, *_seen_of(b), longest)
                at, x = np.concatenate((r, zr)).astype(np.int64), np.concatenate((x, np.zeros(len(zr))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[at]), b.column("user_id").take(pa.array(at)), pa.array(np.concatenate((i, zi)).astype(np.int32)), pa.array(x),
                     pa.array(np.arange(len(at)) >= len(r)), pa.array(lo[at]), pa.array(hi[at])], names=["row", "user_id", "item_id", "x", "seen", "lo", "hi"])
        return run

    found = _united([q.mapInArrow(scan(chunks.send(c)), "row long, user_id int, item_id int, x double, seen boolean, lo double, hi double")
                     for c, q in _dealt(queries, chunks, seen)])
    found = found.withColumns({"lo": F.expr("min(lo) over (partition by row)"), "hi": F.expr("max(hi) over (partition by row)")})
    found = found.withColumn("score", F.when(F.col("seen"), F.lit(0.0)).otherwise(minmax_scaled("x", "lo", "hi")))
    nth = F.expr("row_number() over (partition by row order by score desc, item_id desc)")
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("user_id", "rank", "item_id", "score")


def rank_labels_chunks(users: DataFrame, chunks: ItemChunks, labels: DataFrame, seen: DataFrame | None, masked: bool) -> DataFrame:
    """As ``rank_labels``, of any number of chunks: the held items' scores from their own chunks, then counts of all chunks added up."""
    dim, longest = chunks.dim, max(chunks.longest.values())
    known = labels.select("user_id", "item_id").distinct().join(chunks.places(), "item_id")
    queries = _numbered(known.join(users.select(F.col("id").alias("user_id"), "features"), "user_id"))

    def held_scores(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, V, _ = sent.value
                by_id = np.argsort(ids, kind="stable")
                place = by_id[np.searchsorted(ids, b.column("item_id").to_numpy().astype(np.int64), sorter=by_id)]
                t = _exact(_matrix(b.column("features"), dim), V, np.arange(b.num_rows), place)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t)], names=[*b.schema.names, "t"])
        return run

    plain = T.StructType([*queries.schema.fields, T.StructField("t", T.DoubleType())])
    queries = materialize(_united([queries.where(F.col("chunk") == c).mapInArrow(held_scores(chunks.send(c)), plain) for c in chunks.chunks])).drop("chunk")

    def scan(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                U, t, held = _matrix(b.column("features"), dim), b.column("t").to_numpy(), b.column("item_id").to_numpy().astype(np.int64)
                lo, hi, count, after, (r, x, i) = chunk_counts(U, t, held, sent.value, *_seen_of(b), masked, longest)
                order = np.argsort(r, kind="stable")
                ends = pa.array(np.searchsorted(r[order], np.arange(b.num_rows + 1)).astype(np.int32))
                near = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x[order]), pa.array(i[order].astype(np.int32))], names=["x", "i"]))
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(lo), pa.array(hi), pa.array(count), pa.array(after), near],
                                                 names=["row", "lo", "hi", "n", "after", "near"])
        return run

    found = _united([q.mapInArrow(scan(chunks.send(c)), "row long, lo double, hi double, n long, after long, near array<struct<x: double, i: int>>")
                     for c, q in _dealt(queries, chunks, seen)])
    sums = found.groupBy("row").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("after").alias("after"),
                                    F.flatten(F.collect_list("near")).alias("near"))
    out = queries.select("row", "user_id", "item_id", "t").join(sums, "row")
    if not masked:
        return out.select("user_id", "item_id", (F.col("n") + 1).cast("long").alias("rank"))
    out = out.withColumn("s", minmax_scaled("t", "lo", "hi"))
    closer = F.size(F.filter("near", lambda v: (minmax_scaled(v["x"], F.col("lo"), F.col("hi")) > F.col("s"))
                             | ((minmax_scaled(v["x"], F.col("lo"), F.col("hi")) == F.col("s")) & (v["i"] > F.col("item_id")))))
    zeros = F.when(F.col("s") == 0, F.col("after")).otherwise(F.lit(0))
    return out.select("user_id", "item_id", (F.col("n") + closer + zeros + 1).cast("long").alias("rank"))


def score_pairs_chunks(pairs: DataFrame, users: DataFrame, chunks: ItemChunks) -> DataFrame:
    """As ``score_pairs``, of any number of users and chunks: pairs and user vectors meet in buckets of the user, the items come chunk by chunk, so no
    vector travels with a pair and what is shuffled grows with pairs and users."""
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    vectors = materialize_bucketed(users.select(F.col("id").alias("user_id"), "features").repartition(parts, "user_id"), ["user_id"], parts)
    at = chunks.places() if chunks.several else chunks.table.select(F.col("id").alias("item_id"), F.lit(chunks.chunks[0]).alias("chunk")).distinct()
    placed = pairs.join(at, "item_id").select(*pairs.columns, "chunk")
    placed = materialize_bucketed(placed.where("user_id is not null").repartition(parts, "user_id"), ["user_id"], parts)
    names, dim = pairs.columns, chunks.dim

    def scan(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, V, _ = sent.value
            by_id = np.argsort(ids, kind="stable")
            for b in batches:
                place = by_id[np.searchsorted(ids, b.column("item_id").to_numpy().astype(np.int64), sorter=by_id)]
                score = _exact(_matrix(b.column("features"), dim), V, np.arange(b.num_rows), place)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(score)], names=[*names, "score"])
        return run

    schema = T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())])
    return _united([placed.where(F.col("chunk") == c).drop("chunk").join(vectors, "user_id").mapInArrow(scan(chunks.send(c)), schema) for c in chunks.chunks])
