"""Query catalogue: each entry is (spark, sf_dir) → DataFrame over the driver tables.

Names and output columns match ``recoflow.plans.oracle`` one to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow import constants as C
from recoflow.functions.columns import dot
from recoflow.operators import dims, ingest, interactions, models, negatives, report, split
from recoflow.operators import metrics as M
from recoflow.operators import recommend as R
from recoflow.operators import scoring as S
from recoflow.session import materialize, materialize_bucketed, scratch_path
from recoflow.sources import files
from recoflow.sources import tables as T
from recoflow.streaming import envelope, model_store, sessions, stream

ROUND = 6
PAIR = ["user_id", "item_id"]


# ---- ETL over raw subscriber lines ------------------------------------------------

def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.standardize_subscribers(T.raw_lines(spark, sf_dir))


def _etl(spark: SparkSession, sf_dir: str):
    # purchase counts are the ETL's hand-off table: written once, read three times (no row of a repeated purchase, both dimensions' keys)
    counts = materialize(interactions.purchase_counts(subscriptions(spark, sf_dir)))
    return counts, dims.user_dimension(counts), dims.item_dimension(counts)


def q_raw_standardize(spark, sf_dir):
    return subscriptions(spark, sf_dir)


def q_user_dim(spark, sf_dir):
    return dims.user_dimension(subscriptions(spark, sf_dir))


def q_item_dim(spark, sf_dir):
    return dims.item_dimension(subscriptions(spark, sf_dir))


def q_item_offer_info(spark, sf_dir):
    items = dims.item_dimension(subscriptions(spark, sf_dir))
    return dims.items_with_offer_info(items, T.offer_attributes(spark, sf_dir))


def q_rating_triples(spark, sf_dir):
    subs, users, items = _etl(spark, sf_dir)
    return interactions.rating_triples(subs, users, items)


def q_price_weighted_ratings(spark, sf_dir):
    subs, users, items = _etl(spark, sf_dir)
    triples = interactions.rating_triples(subs, users, items)
    info = dims.items_with_offer_info(items, T.offer_attributes(spark, sf_dir))
    out = interactions.price_weighted_ratings(triples, info)
    return out.select("user_id", "item_id", F.round("rating", ROUND).alias("rating"))


# ---- interaction statistics and split ---------------------------------------------

def _inter(spark, sf_dir):
    """Interaction triples as a written hand-off table, for flows that read them several times.

    Bucketed by the pair: joins on (user, item) shuffle the other side only, and a user with very many rows is spread over all buckets.
    """
    return materialize_bucketed(T.interactions(spark, sf_dir), PAIR)


def q_dataset_counts(spark, sf_dir):
    return interactions.dataset_counts(T.interactions(spark, sf_dir))


def q_split_test(spark, sf_dir):
    return split.test_pairs(T.interactions_by_quarter(spark, sf_dir))


def q_split_train(spark, sf_dir):
    train, _ = split.leave_one_out(materialize_bucketed(T.interactions_by_quarter(spark, sf_dir), PAIR))
    return train


def q_split_test_full(spark, sf_dir):
    return split.test_pairs(T.interactions(spark, sf_dir))


def q_split_train_full(spark, sf_dir):
    train, _ = split.leave_one_out(_inter(spark, sf_dir))
    return train


def q_split_test_hashed(spark, sf_dir):
    return split.test_pairs(T.interactions(spark, sf_dir), first="hashed", seed=7)


def q_item_popularity(spark, sf_dir):
    return M.item_popularity(T.interactions(spark, sf_dir), T.item_names(spark, sf_dir))


def q_top_rated_item(spark, sf_dir):
    return M.top_rated_item(T.interactions(spark, sf_dir))


def q_popularity_baseline(spark, sf_dir):
    train, test = split.leave_one_out(_inter(spark, sf_dir))
    return M.popularity_baseline(train, test)


# ---- files written and read again ----------------------------------------------------

def _rating_file(spark, sf_dir):
    """A rating file of the interactions; every item that ends in 3 has an unreadable rating, in 7 no user, in 9 a field too few."""
    path = scratch_path(spark, "ratings-csv")
    last = F.pmod("item_id", F.lit(10))
    line = F.concat_ws(",", F.when(last == 7, F.lit("")).otherwise(F.col("user_id").cast("string")), F.col("item_id").cast("string"),
                       F.when(last == 9, F.lit(None)).when(last == 3, F.lit("x")).otherwise(F.col("rating").cast("string")))
    T.interactions(spark, sf_dir).select(line.alias("value")).write.text(path)
    return path


def q_files_ratings(spark, sf_dir):
    """SC4 + SC5: good rows of a rating file with their bucket (the files have no header line of their own)."""
    good, _ = files.read_checked(spark, _rating_file(spark, sf_dir), files.RATING_SCHEMA, files.RATING_SCHEMA.names, header=False)
    return files.with_bucket(good.select("user_id", "item_id", F.col("rating").cast("int").alias("rating")))


def q_files_bad_records(spark, sf_dir):
    """Bad rows of the rating file by reason, none lost."""
    _, bad = files.read_checked(spark, _rating_file(spark, sf_dir), files.RATING_SCHEMA, files.RATING_SCHEMA.names, header=False)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q_files_offers(spark, sf_dir):
    """SC2 + SC3 + SK1: the offer sheet written as headed CSV and read again."""
    path = files.write_table(T.offer_attributes(spark, sf_dir), scratch_path(spark, "offers-csv"), fmt="csv")
    return files.read_offers(spark, path)


def q_files_labels(spark, sf_dir):
    """SC5 + SC6 + SK1: the test split written as headed CSV and read again as labels."""
    test = split.test_pairs(T.interactions(spark, sf_dir)).withColumn("rating", F.when(F.pmod("item_id", F.lit(4)) == 0, 0).otherwise(F.col("rating")))
    path = files.write_table(test.toDF("User", "package", "ratings"), scratch_path(spark, "test-csv"), fmt="csv")
    labels = files.read_test_labels(spark, path)
    positive = files.read_binary_ratings(spark, path).select("user_id", "item_id", F.col("rating").cast("double").alias("binary"))
    return labels.join(positive, ["user_id", "item_id"], "left")


def q_files_raw_lines(spark, sf_dir):
    """SC1 + L1 from a text file."""
    path = scratch_path(spark, "raw-lines")
    T.raw_lines(spark, sf_dir).write.text(path)
    return ingest.standardize_subscribers(files.read_raw_lines(spark, path))


def q_files_negatives(spark, sf_dir):
    """SC7 + SK2: sampled negatives written as wide lines and read again."""
    _, negs = _train_negatives(spark, sf_dir)
    pairs = negs.select("user_id", F.col("item_id").alias("heldout"), F.col("neg_item").alias("item_id"))
    return files.read_wide_negatives(spark, files.write_wide_negatives(pairs, scratch_path(spark, "negatives-txt")))


def q_matrix_shape(spark, sf_dir):
    """SC8: cells of single purchases add up; shape of the matrix."""
    orders, lines = T.table(spark, sf_dir, "orders"), T.table(spark, sf_dir, "lineitem")
    single = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.col("o_custkey").cast("int").alias("user_id"), F.col("l_partkey").cast("int").alias("item_id"), F.lit(1).alias("rating"))
    return interactions.matrix_shape(interactions.rating_matrix_cells(single))


# ---- scoring on fixed factor tables ----------------------------------------------

def _factors(spark, sf_dir):
    return T.user_factors(spark, sf_dir), T.item_factors(spark, sf_dir)


def _r(c: str):
    return F.round(c, ROUND).alias(c)


def q_score_pairs(spark, sf_dir):
    uf, itf = _factors(spark, sf_dir)
    scored = S.score_pairs(T.interactions(spark, sf_dir).select("user_id", "item_id"), uf, itf)
    return scored.select("user_id", "item_id", _r("score"))


def q_recommend_unseen_top5(spark, sf_dir):
    uf, itf = _factors(spark, sf_dir)
    recs = R.recommend_unseen(uf, itf, _inter(spark, sf_dir), 5)
    return recs.select("user_id", "rank", "item_id", _r("score"))


def q_recommend_grid(spark, sf_dir):
    """The same lists from many item chunks (at least eight, whatever the table's size), each broadcast and scanned by the users it can still matter to."""
    uf, itf = _factors(spark, sf_dir)
    itf = materialize(itf)
    limit = max(1, itf.count() // 8) * 8 * (itf.agg(F.max(F.size("features"))).first()[0] or 1)
    recs = R.recommend_unseen(uf, itf, _inter(spark, sf_dir), 5, max_broadcast_bytes=limit)
    return recs.select("user_id", "rank", "item_id", _r("score"))


def _masked_top5(spark, sf_dir):
    uf, itf = _factors(spark, sf_dir)
    return R.recommend_masked(uf, itf, _inter(spark, sf_dir), C.TOP_ITEMS_REPORTED)


def q_minmax_masked_top5(spark, sf_dir):
    return _masked_top5(spark, sf_dir).select("user_id", "rank", "item_id", _r("score"))


def q_heldout_rank(spark, sf_dir):
    uf, itf = _factors(spark, sf_dir)
    _, test = split.leave_one_out(_inter(spark, sf_dir))
    return R.heldout_ranks(uf, itf, test).select("user_id", "item_id", "heldout_rank", "hit", _r("ndcg"))


def q_heldout_rank_unseen(spark, sf_dir):
    uf, itf = _factors(spark, sf_dir)
    train, test = split.leave_one_out(_inter(spark, sf_dir))
    return R.heldout_ranks(uf, itf, test, seen=train).select("user_id", "item_id", "heldout_rank", "hit", _r("ndcg"))


def q_metrics_by_k(spark, sf_dir):
    uf, itf = _factors(spark, sf_dir)
    train, test = split.leave_one_out(_inter(spark, sf_dir))
    ranks = R.masked_label_ranks(uf, itf, test, train)
    return M.metrics_from_ranks(ranks).select("k", "n_labels", _r("hit_rate"), _r("ndcg"))


def q_rmse_pairs(spark, sf_dir):
    uf, itf = _factors(spark, sf_dir)
    _, test = split.leave_one_out(_inter(spark, sf_dir))
    return M.rmse(S.score_pairs(test, uf, itf)).select("n", _r("rmse"))


def q_coverage_frequency(spark, sf_dir):
    return report.item_frequency(_masked_top5(spark, sf_dir), T.item_names(spark, sf_dir))


def q_coverage_share(spark, sf_dir):
    freq = report.item_frequency(_masked_top5(spark, sf_dir))
    out = report.coverage_share(freq, T.item_factors(spark, sf_dir).count())
    return out.select(*[_r(c) if c.startswith("item_coverage") else c for c in out.columns])


def q_top5_items(spark, sf_dir):
    freq = report.item_frequency(_masked_top5(spark, sf_dir), T.item_names(spark, sf_dir))
    return report.top_items(freq).select("rank", "item_id", "package", "freq")


def q_seen_lists(spark, sf_dir):
    return report.chunked_lists(T.interactions(spark, sf_dir), T.item_names(spark, sf_dir))


def request_keys(spark, sf_dir):
    """Lookup requests from the event log: purchases name the user by msisdn, views by id."""
    ev = T.table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view"))
    key = F.when(F.col("event_type") == "purchase", F.lit(T.MSISDN_BASE) + F.col("user_id")).otherwise(F.col("user_id"))
    return ev.select(key.cast("bigint").alias("request_key")).distinct()


def _paired(spark, sf_dir):
    uf, itf = _factors(spark, sf_dir)
    inter = _inter(spark, sf_dir)
    names, users = T.item_names(spark, sf_dir), T.user_names(spark, sf_dir)
    req = report.resolve_user_keys(request_keys(spark, sf_dir), users)
    wanted = uf.join(req.select(F.col("user_id").alias("id")).where(F.col("id").isNotNull()).distinct(), "id", "left_semi")
    return report.paired_lists(req, R.recommend_unseen(wanted, itf, inter, 5), inter, users, names)


def q_recommend_lookup(spark, sf_dir):
    """R2 + J14 + P14: both lists and the msisdn for every requested key."""
    return _paired(spark, sf_dir)


def q_recommend_report(spark, sf_dir):
    """R3 + P18 + P23: the lists as JSON."""
    return report.report_json(_paired(spark, sf_dir))


def q_performance_report(spark, sf_dir):
    """R1 + P23: every part of the payload from one scan."""
    uf, itf = _factors(spark, sf_dir)
    inter = _inter(spark, sf_dir)
    train, test = split.leave_one_out(inter)
    out = models.factor_report(uf, itf, inter, materialize(train), materialize(test), T.item_names(spark, sf_dir))
    return out.select("section", "key", _r("value"))


def q_distinct_sketches(spark, sf_dir):
    """A3: distinct users of each event type by exact count and merged from daily sketches; whether the estimate lies within its bound (four standard errors, or one)."""
    ev = T.table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    daily = materialize(interactions.distinct_sketches(ev, ["event_type", "day"], "user_id"))
    exact = ev.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"))
    error = F.greatest(F.lit(1.0), F.lit(4 * 1.04 / 64) * F.col("n_users"))
    return exact.join(interactions.merged_counts(daily, ["event_type"]), "event_type").select(
        "event_type", "n_users", (F.abs(F.col("n") - F.col("n_users")) <= error).alias("within_bound"))


def q_popularity_with_test(spark, sf_dir):
    """A15 with the most rated item of train and test."""
    train, test = split.leave_one_out(_inter(spark, sf_dir))
    return M.popularity_baseline(train, test, include_test=True)


# ---- negatives -------------------------------------------------------------------------

def _negatives_summary(spark, sf_dir, mode):
    inter = _inter(spark, sf_dir)
    train, test = split.leave_one_out(inter)
    return negatives.test_negative_summary(test, train, inter.select("item_id").distinct(), mode)


def q_test_negatives_all(spark, sf_dir):
    return _negatives_summary(spark, sf_dir, "all_others")


def q_test_negatives_unseen(spark, sf_dir):
    return _negatives_summary(spark, sf_dir, "unseen")


def _train_negatives(spark, sf_dir):
    train, _ = split.leave_one_out(_inter(spark, sf_dir))
    return train, negatives.sample_train_negatives(train, n=C.POINTWISE_NEGATIVES, seed=7)


def q_train_negatives(spark, sf_dir):
    return _train_negatives(spark, sf_dir)[1]


def q_log_loss(spark, sf_dir):
    uf, itf = _factors(spark, sf_dir)
    train, negs = _train_negatives(spark, sf_dir)
    rows = (train.select("user_id", "item_id", F.lit(1).alias("label"))
            .unionByName(negs.select("user_id", F.col("neg_item").alias("item_id"), F.lit(0).alias("label"))))
    scored = S.score_pairs(rows, uf, itf).withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score"))))
    return M.log_loss(scored).select("n", _r("log_loss"))


# ---- models (rows-only: fitted factors have no SQL equivalent) ------------------------

def _als_split(spark, sf_dir):
    inter = _inter(spark, sf_dir)
    train, test = split.leave_one_out(inter)
    return inter, train, test


def q_als_recommend(spark, sf_dir):
    inter, train, _ = _als_split(spark, sf_dir)
    model = models.fit_als(train)
    return models.als_recommend(model, inter, 5).select("user_id", "rank", "item_id", _r("score"))


def q_als_grid(spark, sf_dir):
    _, train, test = _als_split(spark, sf_dir)
    _, grid = models.als_grid(train, test, k=5)
    return grid


def q_als_report(spark, sf_dir):
    """R3 with a fitted model: per requested key and chunk, {package_subscribed, package_recommended} as JSON."""
    inter, train, _ = _als_split(spark, sf_dir)
    model = models.fit_als(train)
    users, names = T.user_names(spark, sf_dir), T.item_names(spark, sf_dir)
    req = report.resolve_user_keys(request_keys(spark, sf_dir), users)
    wanted = req.select(F.col("user_id").alias("id")).where(F.col("id").isNotNull()).distinct()
    return report.report_json(report.paired_lists(req, models.als_recommend(model, inter, 5, users=wanted), inter, users, names))


def q_als_metrics_by_k(spark, sf_dir):
    """R4 + A12 with the confidence-weighted ALS at the sweep's 20 iterations: all k from one fit."""
    _, train, test = _als_split(spark, sf_dir)
    model = models.fit_confidence_als(train, iterations=C.RDD_ALS_ITERATIONS)
    uf, itf = models.als_factors(model)
    ranks = R.masked_label_ranks(uf, itf, test, train)
    return M.metrics_from_ranks(ranks)


def q_als_coverage(spark, sf_dir):
    """Coverage of the confidence-weighted ALS's top-5 lists over all users."""
    _, train, _ = _als_split(spark, sf_dir)
    model = models.fit_confidence_als(train)
    uf, itf = models.als_factors(model)
    recs = R.recommend_masked(uf, itf, train, C.TOP_ITEMS_REPORTED)
    return report.coverage_share(report.item_frequency(recs), itf.count())


def q_pointwise_fm(spark, sf_dir):
    """M10 + A16: FM on positives + 2 hashed negatives; test pairs scored, log loss on the training rows."""
    _, train, test = _als_split(spark, sf_dir)
    negs = negatives.sample_train_negatives(train, n=C.POINTWISE_NEGATIVES, seed=7)
    rows = materialize(models.pointwise_training_set(train, negs))
    model = models.fit_pointwise(rows)
    loss = M.log_loss(models.pointwise_scores(model, rows)).first()["log_loss"]
    scored = models.pointwise_scores(model, test.select("user_id", "item_id", F.lit(1.0).alias("label")))
    return scored.select("user_id", "item_id", "label", _r("prob"), F.lit(loss).alias("train_log_loss"))


def q_pointwise_heldout(spark, sf_dir):
    """M6 with the FM: held-out rank among all items (augmented factors), HR/NDCG@10."""
    _, train, test = _als_split(spark, sf_dir)
    negs = negatives.sample_train_negatives(train, n=C.POINTWISE_NEGATIVES, seed=7)
    rows = materialize(models.pointwise_training_set(train, negs))
    model = models.fit_pointwise(rows)
    uf, itf = models.pointwise_factors(model)
    return R.heldout_ranks(uf, itf, test).select("user_id", "item_id", "heldout_rank", "hit", _r("ndcg"))


# ---- streaming ------------------------------------------------------------------------

def q_stream_requests(spark, sf_dir):
    """ST1 + F10 + P16 + P17 on the request topic's records (the stream's per-batch logic)."""
    decoded = envelope.decode(T.request_records(spark, sf_dir), keep=("key",)).withColumn(
        "session_id", F.coalesce("session_id", F.col("key").cast("string")))
    routed = stream.route(decoded)
    return routed.select("session_id", "process_id", "handler", F.col("msisdns")[0].alias("request_key"), "num_items")


def _model(spark, sf_dir):
    """Factors and interactions of a stream's model, written once: every micro-batch reads them."""
    return *(materialize(x) for x in _factors(spark, sf_dir)), _inter(spark, sf_dir)


def run_request_stream(spark, sf_dir, files: int = 3):
    """Write the request records as files, run the stream over them to completion; returns the output folder."""
    src, out, ckpt = scratch_path(spark, "requests"), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    T.request_records(spark, sf_dir).repartition(files).write.parquet(src)
    rec = stream.FactorRecommender(*_model(spark, sf_dir), T.user_names(spark, sf_dir), T.item_names(spark, sf_dir))
    q = stream.start_request_stream(spark, src, out, ckpt, rec, files_per_batch=1)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out


def q_stream_status(spark, sf_dir):
    out = run_request_stream(spark, sf_dir)
    return spark.read.parquet(f"{out}/status").select("session_id", "status", "seq")


def q_stream_response(spark, sf_dir):
    out = run_request_stream(spark, sf_dir)
    return spark.read.parquet(f"{out}/response").select("session_id", "request_key", "user_id", "package_recommend")


def q_stream_response_envelopes(spark, sf_dir):
    """ST6 + ST7 + P18: response envelopes as they stand in the outbox, decoded again."""
    out = run_request_stream(spark, sf_dir)
    d = envelope.decode(spark.read.parquet(f"{out}/response_records").select("value"))
    return d.select("session_id", "message_type", "message_number", "is_finished", F.col("content")[C.CONTENT_KEY_RESULT].alias("result"))


def q_stream_requests_once(spark, sf_dir):
    """Requests that come again (every fifth, later) or late within the watermark are answered once: (session_id, n_answers) of the answered sessions."""
    src, out, ckpt = scratch_path(spark, "requests"), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    records = T.request_records(spark, sf_dir)
    again = records.where(F.pmod(F.xxhash64("key"), F.lit(5)) == 0)
    records.write.parquet(f"{src}/0")     # the batches of the stream, in this order
    again.write.parquet(f"{src}/1")
    rec = stream.FactorRecommender(*_model(spark, sf_dir), T.user_names(spark, sf_dir))
    q = stream.start_request_stream(spark, f"{src}/*", out, ckpt, rec, files_per_batch=1_000, delay="60 days")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    answers = spark.read.parquet(f"{out}/response").select("session_id", "request_key", "batch_id")
    return answers.groupBy("session_id", "request_key").agg(F.count(F.lit(1)).alias("n_answers"))


STATUS_DELAY_DAYS, STATUS_KEEP_DAYS = 2, 5


def q_stream_latest_status(spark, sf_dir):
    """Latest status of every session and whether its life ended before it finished, from keyed state under a watermark."""
    src, out, ckpt = scratch_path(spark, "statuses"), scratch_path(spark, "latest"), scratch_path(spark, "latest-ckpt")
    records = T.status_records(spark, sf_dir)
    lo, hi = records.agg(F.min("sent_ms"), F.max("sent_ms")).first()
    for k in range(3):  # three batches by time, rows of a batch in any order
        part = F.floor((F.col("sent_ms") - lo) * 3 / (hi - lo + 1)) == k
        records.where(part).select("key", "value").write.parquet(f"{src}/{k}")
    q = sessions.start_latest_status(spark, f"{src}/*", out, ckpt, f"{STATUS_DELAY_DAYS} days", STATUS_KEEP_DAYS * 86_400_000, files_per_batch=1_000)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return sessions.read_latest_status(spark, out)


def q_stored_factors(spark, sf_dir):
    """SK3 + SC10: item factors of the newest committed version of a model store; a newer version without a commit is not read."""
    store = model_store.ModelStore(spark, scratch_path(spark, "model-store"))
    uf, itf = _factors(spark, sf_dir)
    store.save("old", uf.limit(0), itf.limit(0))
    version = store.save("first", uf, itf)
    itf.limit(1).write.parquet(f"{store.root}/versions/{version + 1}/items")  # what a lost driver leaves
    _, items = store.load(store.latest())
    return items.select(F.lit(version).alias("version"), "id", F.size("features").alias("dim"), F.round(F.sqrt(dot("features", "features")), ROUND).alias("norm"))


def catalogue() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "raw_standardize": q_raw_standardize,
        "user_dim": q_user_dim,
        "item_dim": q_item_dim,
        "item_offer_info": q_item_offer_info,
        "rating_triples": q_rating_triples,
        "price_weighted_ratings": q_price_weighted_ratings,
        "dataset_counts": q_dataset_counts,
        "split_test": q_split_test,
        "split_train": q_split_train,
        "split_test_full": q_split_test_full,
        "split_train_full": q_split_train_full,
        "split_test_hashed": q_split_test_hashed,
        "item_popularity": q_item_popularity,
        "top_rated_item": q_top_rated_item,
        "popularity_baseline_ndcg": q_popularity_baseline,
        "files_raw_lines": q_files_raw_lines,
        "files_offers": q_files_offers,
        "files_ratings": q_files_ratings,
        "files_bad_records": q_files_bad_records,
        "files_labels": q_files_labels,
        "files_negatives": q_files_negatives,
        "matrix_shape": q_matrix_shape,
        "score_pairs": q_score_pairs,
        "recommend_unseen_top5": q_recommend_unseen_top5,
        "recommend_grid_top5": q_recommend_grid,
        "minmax_masked_top5": q_minmax_masked_top5,
        "heldout_rank_hr_ndcg": q_heldout_rank,
        "heldout_rank_unseen": q_heldout_rank_unseen,
        "metrics_by_k": q_metrics_by_k,
        "rmse_pairs": q_rmse_pairs,
        "coverage_frequency": q_coverage_frequency,
        "coverage_share": q_coverage_share,
        "top5_items": q_top5_items,
        "seen_lists": q_seen_lists,
        "recommend_lookup": q_recommend_lookup,
        "recommend_report": q_recommend_report,
        "performance_report": q_performance_report,
        "distinct_sketches": q_distinct_sketches,
        "popularity_with_test": q_popularity_with_test,
        "test_negatives_all": q_test_negatives_all,
        "test_negatives_unseen": q_test_negatives_unseen,
        "train_negatives": q_train_negatives,
        "log_loss": q_log_loss,
        "als_recommend": q_als_recommend,
        "als_grid": q_als_grid,
        "als_report": q_als_report,
        "als_metrics_by_k": q_als_metrics_by_k,
        "als_coverage": q_als_coverage,
        "pointwise_fm": q_pointwise_fm,
        "pointwise_heldout": q_pointwise_heldout,
        "stream_requests": q_stream_requests,
        "stream_status": q_stream_status,
        "stream_response": q_stream_response,
        "stream_response_envelopes": q_stream_response_envelopes,
        "stream_requests_once": q_stream_requests_once,
        "stream_latest_status": q_stream_latest_status,
        "stored_factors": q_stored_factors,
    }
