"""Recommendation and exact held-out ranking on factor tables.

Lists and ranks come from scans of the items (``operators.gridscan``): a query row carries the ids that its user has seen, the kernel
masks them, and exactly k rows (or one rank) of a user leave it. Where the items are one chunk, the score range, the held-out
item's own score and the count of items before it are all found in one scan; larger catalogues are scanned chunk by chunk, and the
chunks' ranges, counts and candidates are put together by row. No vector travels with a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow import constants as C
from recoflow.functions.columns import hit_at, ndcg_at
from recoflow.operators import gridscan
from recoflow.operators.gridscan import CHUNK_BYTES, ItemChunks


def _chunks(items, kw: dict) -> ItemChunks:
    return items if isinstance(items, ItemChunks) else ItemChunks(items, kw.get("max_broadcast_bytes", CHUNK_BYTES))


def recommend_unseen(users: DataFrame, items: DataFrame | ItemChunks, seen: DataFrame | None, k: int, **kw) -> DataFrame:
    """(user_id, rank, item_id, score) — top k by raw score desc, item id asc, seen excluded.

    A column ``k_wanted`` of ``users`` lowers k for a user.
    """
    return gridscan.recommend(users, _chunks(items, kw), seen, k)


def recommend_masked(users: DataFrame, items: DataFrame | ItemChunks, seen: DataFrame, k: int, **kw) -> DataFrame:
    """T3 + P8 + P9: per user, scores min-max scaled over all items, seen items forced to 0,
    top k by (masked desc, item id desc). Seen items can appear when fewer than k
    unseen items score above 0 — the masking semantics, kept exactly.
    """
    chunks = _chunks(items, kw)
    if chunks.chunks and not chunks.several:
        return gridscan.recommend_masked(users, chunks, seen, k)
    return gridscan.recommend_masked_chunks(users, chunks, seen, k) if chunks.chunks else users.sparkSession.createDataFrame([], "user_id int, rank int, item_id int, score double")


def _placed(users: DataFrame, chunks: ItemChunks, labels: DataFrame, seen: DataFrame | None, masked: bool) -> DataFrame:
    """(user_id, item_id, rank) of every label, rank NULL where its user or item has no factors."""
    scan = gridscan.rank_labels_chunks if chunks.several else gridscan.rank_labels
    if not chunks.chunks:
        return labels.select("user_id", "item_id", F.lit(None).cast("long").alias("rank"))
    return labels.select("user_id", "item_id").join(scan(users, chunks, labels, seen, masked=masked), ["user_id", "item_id"], "left")


def heldout_ranks(users: DataFrame, items: DataFrame, labels: DataFrame, seen: DataFrame | None = None,
                  k: int = C.HELDOUT_TOP_K, **kw) -> DataFrame:
    """M6 / T4: rank of each held-out item among all items, held-out last on ties.

    rank = 1 + #{items j ≠ h : score_j ≥ score_h}; with ``seen`` (the "unseen"
    negatives mode) the user's seen items are not candidates. Never builds the
    candidate list: the scan counts. A label whose user or item has no factors is a miss: rank NULL, hit and NDCG 0.
    """
    out = _placed(users, _chunks(items, kw), labels, seen, masked=False).withColumnRenamed("rank", "heldout_rank")
    return out.select("user_id", "item_id", "heldout_rank", hit_at("heldout_rank", k).alias("hit"), ndcg_at("heldout_rank", k).alias("ndcg"))


def masked_label_ranks(users: DataFrame, items: DataFrame, labels: DataFrame, seen: DataFrame, **kw) -> DataFrame:
    """Rank of each label in the T3 ordering (masked min-max score desc, item id desc).

    (user_id, item_id, rank), one row per label; rank NULL (a miss) where the user or item has no
    factors. Used to evaluate every k of a sweep from one scan.
    """
    return _placed(users, _chunks(items, kw), labels, seen, masked=True)
