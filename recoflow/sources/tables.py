"""Inputs derived, by Spark, from the driver's parquet tables.

The system's own inputs (raw subscriber lines, offer attributes, rating files,
factor matrices, request envelopes) are re-created here from the TPC-H-like
tables so that every query's work grows with the data:

* interactions: ``orders ⋈ lineitem``; user = ``o_custkey``, item = ``l_partkey``,
  rating = number of purchases of the pair.
* raw subscriber lines: one ragged text line per order, ``msisdn,offer,offer,…``;
  the msisdn and offer spellings are derived from the keys by the rule in
  ``raw_msisdn`` / ``raw_offer`` so that every cleaning rule has work to do.
* offer attributes: one row per part.
* factor tables: one row per customer and per part; a vector of ``embeddings``
  chosen by the id, scaled by a factor of the id so that equal scores stay rare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture-derivation parameters (ours, not the original system's).
ITEM_VECTOR_SHIFT = 100     # item i takes vector (i + shift) mod n, user u vector u mod n
USER_SCALES, ITEM_SCALES = 101, 103   # vector of id x is scaled by 1 + (x mod this) / 128
MSISDN_BASE = 84300000000   # standardized msisdn of customer c is MSISDN_BASE + c
QUARTERS = 1000             # ids of customers and parts times this, plus the quarter of the order (counted from 1900)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- interactions -------------------------------------------------------------

def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id int, item_id int, rating int): purchase counts per (customer, part)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (orders.join(lines, orders.o_orderkey == lines.l_orderkey)
            .groupBy(F.col("o_custkey").cast("int").alias("user_id"),
                     F.col("l_partkey").cast("int").alias("item_id"))
            .agg(F.count(F.lit(1)).cast("int").alias("rating")))


def interactions_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id long, item_id long, rating int) of all orders, a customer and a part being another one each quarter: sparse enough that every
    split rule removes rows."""
    day = F.col("o_orderdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", ((F.year(day) - 1900) * 4 + F.quarter(day)).alias("q"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (orders.join(lines, orders.o_orderkey == lines.l_orderkey)
            .groupBy((F.col("o_custkey") * QUARTERS + F.col("q")).alias("user_id"), (F.col("l_partkey") * QUARTERS + F.col("q")).alias("item_id"))
            .agg(F.count(F.lit(1)).cast("int").alias("rating")))


# ---- raw subscriber lines ------------------------------------------------------

def raw_msisdn(custkey: Column, orderkey: Column) -> Column:
    """Even orders spell the customer's msisdn with the old 8416 prefix."""
    digits = F.lpad(custkey.cast("string"), 8, "0")
    return F.when(F.pmod(orderkey, 2) == 0, F.concat(F.lit("8416"), digits)) \
        .otherwise(F.concat(F.lit("843"), digits))


def raw_offer(partkey: Column) -> Column:
    """Offer spelling chosen by the last digit of the part key."""
    p = partkey.cast("string")
    d = F.pmod(partkey, 10)
    return (F.when(d == 0, F.concat(F.lit("PCRF_"), p))
            .when(d == 1, F.concat(F.lit("MOBILE-PKG"), p))
            .when(d == 2, F.concat(F.lit("MOBILE_PKG"), p))
            .when(d == 3, F.concat(F.lit("MOBILE- PKG"), p))
            .when(d == 4, F.concat(F.lit("HOME"), p))
            .when(d == 5, F.concat(F.lit("MOBILE_MONG"), p))
            .when(d == 6, F.concat(F.lit("VIPMOBILE-"), p))
            .when(d == 7, F.concat(F.lit("MUONG"), p))
            .otherwise(F.concat(F.lit("PKG"), p)))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DataFrame<value string>: one ragged line per order; every 13th order has a trailing comma."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    per_order = (orders.join(lines, orders.o_orderkey == lines.l_orderkey)
                 .groupBy("o_orderkey", "o_custkey")
                 .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", raw_offer(F.col("l_partkey")).alias("o"))))
                      .alias("offers")))
    body = F.concat_ws(",", raw_msisdn(F.col("o_custkey"), F.col("o_orderkey")),
                       F.array_join(F.transform("offers", lambda s: s["o"]), ","))
    trailing = F.when(F.pmod(F.col("o_orderkey"), 13) == 0, F.lit(",")).otherwise(F.lit(""))
    return per_order.select(F.concat(body, trailing).alias("value"))


# ---- offer attributes -----------------------------------------------------------

def offer_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offer table in the shape ``package,cycle,Price,Voice,Data,SMS,volumnData,numSMS,numMinutes``.

    Oversized parts (``p_size > 45``) have no offer sheet, so their price stays NULL.
    """
    part = table(spark, sf_dir, "part")
    return (part.where(F.col("p_size") <= 45)
            .select(F.concat(F.lit("PKG"), F.col("p_partkey").cast("string")).alias("package"),
                    F.lit(30).alias("cycle"),
                    F.col("p_retailprice").alias("Price"),
                    (F.col("p_type") == "ECONOMY").cast("int").alias("Voice"),
                    (F.col("p_type") != "ECONOMY").cast("int").alias("Data"),
                    (F.col("p_type") == "PROMO").cast("int").alias("SMS"),
                    (F.col("p_size") * 1024).alias("volumnData"),
                    F.lit(0).alias("numSMS"),
                    F.lit(0).alias("numMinutes")))


# ---- names ------------------------------------------------------------------------

def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id int, package string) for interaction item ids."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("item_id"),
                                               F.col("p_name").alias("package"))


def user_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id int, msisdn bigint) for interaction user ids."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("user_id"),
        (F.lit(MSISDN_BASE) + F.col("c_custkey")).cast("bigint").alias("msisdn"))


# ---- factor tables -----------------------------------------------------------------

def _factors(spark: SparkSession, sf_dir: str, ids: DataFrame, shift: int, scales: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    n = max(vectors.count(), 1)  # from the file footers
    e = vectors.select(F.col("vec_id").cast("bigint").alias("_vec"), F.col("embedding").cast("array<double>").alias("_v"))
    scale = F.lit(1.0) + F.pmod(F.col("id"), F.lit(scales)) / F.lit(128.0)
    return (ids.withColumn("_vec", F.pmod(F.col("id").cast("bigint") + F.lit(shift), F.lit(n)))
            .join(e, "_vec").select("id", F.transform("_v", lambda x: x * scale).alias("features")))


def user_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id int, features array<double>) for every customer."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("id"))
    return _factors(spark, sf_dir, ids, 0, USER_SCALES)


def item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id int, features array<double>) for every part."""
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("id"))
    return _factors(spark, sf_dir, ids, ITEM_VECTOR_SHIFT, ITEM_SCALES)


# ---- request envelopes ---------------------------------------------------------------

def request_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request envelope per event (ST8 vocabulary).

    purchase → predict request for the customer's msisdn; signup → training
    request; view → another process (ignored); click → predict request whose
    content lacks the msisdn list (quarantined); error → payload truncated
    after encoding (undecodable, quarantined).
    """
    from recoflow import constants as C
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    msisdn = (F.lit(MSISDN_BASE) + F.col("user_id")).cast("string")
    k = F.lit("5")
    content = (F.when(et == "purchase", F.create_map(F.lit(C.CONTENT_KEY_MSISDN_LIST), F.concat(F.lit("["), msisdn, F.lit("]")),
                                                     F.lit(C.CONTENT_KEY_NUM_ITEMS), k))
               .when(et == "click", F.create_map(F.lit("user"), msisdn, F.lit(C.CONTENT_KEY_NUM_ITEMS), k))
               .when(et == "signup", F.create_map(F.lit(C.CONTENT_KEY_NUM_ITEMS), k, F.lit("evaluation_metric"), F.lit("ndcg")))
               .otherwise(F.create_map().cast("map<string,string>")))
    process = (F.when(et == "signup", F.lit(C.PROCESS_ID_RECOMMENDER_TRAINING))
               .when(et == "view", F.lit(C.PROCESS_ID_RECOMMENDER_EVALUATE))
               .otherwise(F.lit(C.PROCESS_ID_RECOMMENDER_PREDICT)))
    return ev.select(
        F.lit(C.MESSAGE_TYPE_OFFLINE_REQUEST).alias("message_type"), F.lit(C.GROUP_ID_RECOMMENDER).alias("group_id"),
        process.alias("process_id"), F.col("event_id").cast("string").alias("session_id"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("created_time"),
        F.lit(0).cast("int").alias("message_number"), F.lit(False).alias("is_finished"),
        F.concat(F.lit("event:"), et).alias("description"), content.alias("content"), et.alias("event_type"))


#: The status that an event of the log stands for, when it is read as a customer's session.
STATUS_OF_EVENT = {"click": "ACCEPTED", "view": "RUNNING", "purchase": "FINISHED"}


def status_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value, sent_ms) status records: sessions are customers, events their statuses; every seventh event is sent twice."""
    from recoflow import constants as C
    from recoflow.streaming.envelope import encode
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin(*STATUS_OF_EVENT))
    status = F.create_map(*[F.lit(x) for p in STATUS_OF_EVENT.items() for x in p])[F.col("event_type")]
    env = ev.select(
        F.lit(C.MESSAGE_TYPE_OFFLINE_STATUS).alias("message_type"), F.lit(C.GROUP_ID_RECOMMENDER).alias("group_id"),
        F.lit(C.PROCESS_ID_RECOMMENDER_PREDICT).alias("process_id"), F.col("user_id").cast("string").alias("session_id"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("created_time"),
        F.create_map(F.lit("status"), status).alias("content"),
        F.explode(F.when(F.pmod("event_id", F.lit(7)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return encode(env.withColumn("sent_ms", F.col("created_time")), keep=("sent_ms",))


def request_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value) request records as they would sit on the request topic."""
    from recoflow.streaming.envelope import encode
    env = request_envelopes(spark, sf_dir)
    rec = encode(env, keep=("event_type",))
    value = F.when(F.col("event_type") == "error", F.substring("value", 1, 3)).otherwise(F.col("value"))
    return rec.select("key", value.alias("value"))
