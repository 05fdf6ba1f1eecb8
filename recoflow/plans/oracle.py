"""DuckDB SQL equivalents of the catalogue, over the driver's views.

Built from shared CTE fragments so each rule is written once per dialect.
"""

from __future__ import annotations

ROUND = 6

INTER = """inter AS (
  SELECT CAST(o_custkey AS INTEGER) AS user_id, CAST(l_partkey AS INTEGER) AS item_id,
         CAST(COUNT(*) AS INTEGER) AS rating
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  GROUP BY 1, 2)"""

INTER_QUARTERS = """inter AS (
  SELECT o_custkey * 1000 + (year(o_orderdate) - 1900) * 4 + quarter(o_orderdate) AS user_id,
         l_partkey * 1000 + (year(o_orderdate) - 1900) * 4 + quarter(o_orderdate) AS item_id,
         CAST(COUNT(*) AS INTEGER) AS rating
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  GROUP BY 1, 2)"""

RAW_OFFER = """CASE l_partkey % 10
    WHEN 0 THEN 'PCRF_' || CAST(l_partkey AS VARCHAR)
    WHEN 1 THEN 'MOBILE-PKG' || CAST(l_partkey AS VARCHAR)
    WHEN 2 THEN 'MOBILE_PKG' || CAST(l_partkey AS VARCHAR)
    WHEN 3 THEN 'MOBILE- PKG' || CAST(l_partkey AS VARCHAR)
    WHEN 4 THEN 'HOME' || CAST(l_partkey AS VARCHAR)
    WHEN 5 THEN 'MOBILE_MONG' || CAST(l_partkey AS VARCHAR)
    WHEN 6 THEN 'VIPMOBILE-' || CAST(l_partkey AS VARCHAR)
    WHEN 7 THEN 'MUONG' || CAST(l_partkey AS VARCHAR)
    ELSE 'PKG' || CAST(l_partkey AS VARCHAR) END"""

SUBS = f"""raw AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN '8416' ELSE '843' END || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS msisdn_raw,
         {RAW_OFFER} AS offer
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
cleaned AS (
  SELECT CASE WHEN starts_with(msisdn_raw, '8416') THEN '843' || substr(msisdn_raw, 5) ELSE msisdn_raw END AS msisdn,
         replace(replace(replace(offer, 'MOBILE-', ''), 'MOBILE- ', ''), 'MOBILE_', '') AS package
  FROM raw),
subs AS (
  SELECT TRY_CAST(msisdn AS BIGINT) AS msisdn, package FROM cleaned
  WHERE length(package) > 0 AND NOT (starts_with(package, 'PCRF') OR starts_with(package, 'HOME')
        OR starts_with(package, 'MONG') OR starts_with(package, 'MUONG')))"""

USERS = """users AS (
  SELECT CAST(row_number() OVER (ORDER BY msisdn) - 1 AS INTEGER) AS user_id, msisdn
  FROM (SELECT DISTINCT msisdn FROM subs WHERE msisdn IS NOT NULL))"""

ITEMS = """items AS (
  SELECT CAST(row_number() OVER (ORDER BY package) - 1 AS INTEGER) AS item_id, package
  FROM (SELECT DISTINCT package FROM subs WHERE package IS NOT NULL))"""

OFFERS = """offers AS (
  SELECT 'PKG' || CAST(p_partkey AS VARCHAR) AS package, CAST(30 AS INTEGER) AS cycle, p_retailprice AS Price,
         CAST(p_type = 'ECONOMY' AS INTEGER) AS Voice, CAST(p_type <> 'ECONOMY' AS INTEGER) AS Data,
         CAST(p_type = 'PROMO' AS INTEGER) AS SMS, CAST(p_size * 1024 AS INTEGER) AS volumnData,
         CAST(0 AS INTEGER) AS numSMS, CAST(0 AS INTEGER) AS numMinutes
  FROM part WHERE p_size <= 45)"""

ITEM_INFO = """item_info AS (
  SELECT i.item_id, i.package, o.cycle, o.Price, o.Voice, o.Data, o.SMS, o.volumnData, o.numSMS, o.numMinutes
  FROM items i LEFT JOIN offers o ON i.package = o.package)"""

TRIPLES = """triples AS (
  SELECT u.user_id, i.item_id, c.rating
  FROM (SELECT msisdn, package, CAST(COUNT(*) AS INTEGER) AS rating FROM subs
        WHERE msisdn IS NOT NULL AND package IS NOT NULL GROUP BY 1, 2) c
  LEFT JOIN users u ON c.msisdn = u.msisdn LEFT JOIN items i ON c.package = i.package)"""

SPLIT = """busy AS (SELECT user_id FROM inter GROUP BY 1 HAVING COUNT(*) > 3),
shared AS (SELECT item_id FROM inter GROUP BY 1 HAVING COUNT(*) > 1),
firsts AS (SELECT user_id, MIN(item_id) AS item_id FROM inter WHERE user_id IN (SELECT user_id FROM busy) GROUP BY 1),
test AS (
  SELECT t.user_id, t.item_id, t.rating FROM inter t JOIN firsts f ON t.user_id = f.user_id AND t.item_id = f.item_id
  WHERE t.item_id IN (SELECT item_id FROM shared)),
train AS (
  SELECT t.* FROM inter t WHERE NOT EXISTS (
    SELECT 1 FROM test s WHERE s.user_id = t.user_id AND s.item_id = t.item_id))"""


def DOT(a: str, b: str) -> str:
    """Sequential double dot product (left fold), the same order as the Spark side."""
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda x, y: x + y)"


FACTORS = """vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, COUNT(*) OVER () AS n FROM embeddings),
nvec AS (SELECT COUNT(*) AS n FROM embeddings),
uf AS (SELECT k.id, list_transform(vecs.v, lambda x: x * k.m) AS f
  FROM (SELECT CAST(c_custkey AS INTEGER) AS id, 1.0::DOUBLE + (c_custkey % 101) / 128.0::DOUBLE AS m, c_custkey % n AS vec FROM customer, nvec) k
  JOIN vecs ON vecs.vec_id = k.vec),
itf AS (SELECT k.id, list_transform(vecs.v, lambda x: x * k.m) AS f
  FROM (SELECT CAST(p_partkey AS INTEGER) AS id, 1.0::DOUBLE + (p_partkey % 103) / 128.0::DOUBLE AS m, (p_partkey + 100) % n AS vec FROM part, nvec) k
  JOIN vecs ON vecs.vec_id = k.vec)"""

ALLSCORES = f"""allscores AS (
  SELECT u.id AS user_id, i.id AS item_id, {DOT('u.f', 'i.f')} AS s FROM uf u, itf i)"""

NAMES = """names AS (SELECT CAST(p_partkey AS INTEGER) AS item_id, p_name AS package FROM part)"""

MASKED_TOP5 = """ranges AS (SELECT user_id, MIN(s) AS lo, MAX(s) AS hi FROM allscores GROUP BY 1),
masked AS (
  SELECT a.user_id, a.item_id,
         CASE WHEN EXISTS (SELECT 1 FROM inter t WHERE t.user_id = a.user_id AND t.item_id = a.item_id) THEN 0.0
              WHEN r.hi = r.lo THEN 0.0 ELSE (a.s - r.lo) / (r.hi - r.lo) END AS m
  FROM allscores a JOIN ranges r USING (user_id)),
masked_top5 AS (
  SELECT * FROM (SELECT user_id, item_id, m AS score,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY m DESC, item_id DESC) AS INTEGER) AS rank FROM masked)
  WHERE rank <= 5)"""

HELDOUT = f"""hq AS (
  SELECT t.user_id, t.item_id AS h, {DOT('u.f', 'i.f')} AS t FROM test t JOIN uf u ON t.user_id = u.id JOIN itf i ON t.item_id = i.id)"""

TRAIN_NEG = """pos AS (SELECT DISTINCT user_id, item_id FROM train),
cat AS (SELECT DISTINCT item_id FROM pos),
free AS (
  SELECT u.user_id, c.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY c.item_id) - 1 AS r,
         COUNT(*) OVER (PARTITION BY u.user_id) AS n_free
  FROM (SELECT DISTINCT user_id FROM pos) u, cat c
  WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.user_id = u.user_id AND p.item_id = c.item_id)),
nfree AS (SELECT user_id, COUNT(*) AS n FROM free GROUP BY 1),
draws AS (
  SELECT p.user_id, p.item_id, d.t,
         CAST(('0x' || substr(md5(CAST(p.user_id AS VARCHAR) || '-' || CAST(p.item_id AS VARCHAR) || '-'
              || CAST(d.t AS VARCHAR) || '-7'), 1, 8)) AS BIGINT) % f.n AS r
  FROM pos p JOIN nfree f USING (user_id), range(1, 3) d(t)),
negs AS (
  SELECT d.user_id, d.item_id, f.item_id AS neg_item, CAST(d.t AS INTEGER) AS draw
  FROM draws d JOIN free f ON f.user_id = d.user_id AND f.r = d.r)"""


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def sql() -> dict[str, str]:
    q = {}
    q["raw_standardize"] = w(SUBS) + "SELECT msisdn, package FROM subs"
    q["user_dim"] = w(SUBS, USERS) + "SELECT user_id, msisdn FROM users"
    q["item_dim"] = w(SUBS, ITEMS) + "SELECT item_id, package FROM items"
    q["item_offer_info"] = w(SUBS, ITEMS, OFFERS, ITEM_INFO) + "SELECT * FROM item_info"
    q["rating_triples"] = w(SUBS, USERS, ITEMS, TRIPLES) + "SELECT user_id, item_id, rating FROM triples"
    q["price_weighted_ratings"] = w(SUBS, USERS, ITEMS, OFFERS, ITEM_INFO, TRIPLES, """weighted AS (
  SELECT t.user_id, t.item_id, CAST(t.rating * p.Price AS DOUBLE) AS rating
  FROM triples t LEFT JOIN item_info p ON t.item_id = p.item_id)""", """bounds AS (
  SELECT MIN(rating) AS lo, MAX(rating) AS hi FROM weighted)""") + f"""SELECT user_id, item_id,
  ROUND(CASE WHEN rating IS NULL THEN NULL WHEN hi = lo THEN 0.0 ELSE (rating - lo) / (hi - lo) END, {ROUND}) AS rating
FROM weighted, bounds"""
    q["dataset_counts"] = w(INTER) + """SELECT COUNT(*) AS n_ratings, COUNT(DISTINCT user_id) AS n_users,
  COUNT(DISTINCT item_id) AS n_items FROM inter"""
    q["split_test"] = w(INTER_QUARTERS, SPLIT) + "SELECT user_id, item_id, rating FROM test"
    q["split_train"] = w(INTER_QUARTERS, SPLIT) + "SELECT user_id, item_id, rating FROM train"
    q["split_test_full"] = w(INTER, SPLIT) + "SELECT user_id, item_id, rating FROM test"
    q["split_train_full"] = w(INTER, SPLIT) + "SELECT user_id, item_id, rating FROM train"
    q["split_test_hashed"] = w(INTER, """busy AS (SELECT user_id FROM inter GROUP BY 1 HAVING COUNT(*) > 3)""",
                               """shared AS (SELECT item_id FROM inter GROUP BY 1 HAVING COUNT(*) > 1)""", """keyed AS (
  SELECT user_id, item_id, rating,
         CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR) || '-' || CAST(item_id AS VARCHAR) || '-7'), 1, 15)) AS BIGINT) AS k
  FROM inter WHERE user_id IN (SELECT user_id FROM busy))""", """firsts AS (
  SELECT user_id, arg_min(item_id, k) AS item_id, arg_min(rating, k) AS rating FROM keyed GROUP BY 1)""") + """SELECT
  user_id, item_id, rating FROM firsts WHERE item_id IN (SELECT item_id FROM shared)"""
    q["item_popularity"] = w(INTER) + """SELECT i.item_id, p.p_name AS package, i.n_cells
FROM (SELECT item_id, COUNT(*) AS n_cells FROM inter WHERE rating <> 0 GROUP BY 1) i
LEFT JOIN part p ON i.item_id = CAST(p.p_partkey AS INTEGER)"""
    q["top_rated_item"] = w(INTER) + """SELECT item_id, CAST(SUM(rating) AS BIGINT) AS total_rating
FROM inter GROUP BY 1 ORDER BY total_rating DESC, item_id ASC LIMIT 1"""
    q["popularity_baseline_ndcg"] = w(INTER, SPLIT, """pop AS (
  SELECT item_id FROM train GROUP BY 1 ORDER BY SUM(rating) DESC, item_id ASC LIMIT 1)""") + """SELECT
  (SELECT item_id FROM pop) AS pop_item, COUNT(*) AS n_test,
  COALESCE(AVG(CASE WHEN item_id = (SELECT item_id FROM pop) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0) AS ndcg,
  COALESCE(AVG(CASE WHEN item_id = (SELECT item_id FROM pop) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0) AS hit_rate
FROM test"""
    q["score_pairs"] = w(INTER, FACTORS) + f"""SELECT t.user_id, t.item_id, ROUND({DOT('u.f', 'i.f')}, {ROUND}) AS score
FROM inter t JOIN uf u ON t.user_id = u.id JOIN itf i ON t.item_id = i.id"""
    q["recommend_unseen_top5"] = w(INTER, FACTORS, ALLSCORES) + f"""SELECT user_id, rank, item_id, ROUND(s, {ROUND}) AS score
FROM (SELECT a.*, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id ASC) AS INTEGER) AS rank
      FROM allscores a WHERE NOT EXISTS (SELECT 1 FROM inter t WHERE t.user_id = a.user_id AND t.item_id = a.item_id))
WHERE rank <= 5"""
    q["recommend_grid_top5"] = q["recommend_unseen_top5"]
    q["minmax_masked_top5"] = w(INTER, FACTORS, ALLSCORES, MASKED_TOP5) + f"""SELECT user_id, rank, item_id,
  ROUND(score, {ROUND}) AS score FROM masked_top5"""
    q["heldout_rank_hr_ndcg"] = w(INTER, SPLIT, FACTORS, ALLSCORES, HELDOUT, """ranked AS (
  SELECT q.user_id, q.h AS item_id, 1 + (SELECT COUNT(*) FROM allscores a WHERE a.user_id = q.user_id AND a.item_id <> q.h
                                         AND a.s >= q.t) AS heldout_rank FROM hq q)""") + f"""SELECT user_id, item_id,
  CAST(heldout_rank AS BIGINT) AS heldout_rank, CASE WHEN heldout_rank <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit,
  ROUND(CASE WHEN heldout_rank <= 10 THEN ln(2) / ln(heldout_rank + 1) ELSE 0.0 END, {ROUND}) AS ndcg FROM ranked"""
    q["heldout_rank_unseen"] = w(INTER, SPLIT, FACTORS, ALLSCORES, HELDOUT, """ranked AS (
  SELECT q.user_id, q.h AS item_id, 1 + (SELECT COUNT(*) FROM allscores a WHERE a.user_id = q.user_id AND a.item_id <> q.h
      AND a.s >= q.t AND NOT EXISTS (SELECT 1 FROM train r WHERE r.user_id = a.user_id AND r.item_id = a.item_id))
      AS heldout_rank FROM hq q)""") + f"""SELECT user_id, item_id,
  CAST(heldout_rank AS BIGINT) AS heldout_rank, CASE WHEN heldout_rank <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit,
  ROUND(CASE WHEN heldout_rank <= 10 THEN ln(2) / ln(heldout_rank + 1) ELSE 0.0 END, {ROUND}) AS ndcg FROM ranked"""
    q["metrics_by_k"] = w(INTER, SPLIT, FACTORS, ALLSCORES, HELDOUT, """tr AS (
  SELECT a.user_id, MIN(a.s) AS lo, MAX(a.s) AS hi FROM allscores a WHERE a.user_id IN (SELECT user_id FROM test) GROUP BY 1)""",
                              """mq AS (
  SELECT q.user_id, q.h, CASE WHEN r.hi = r.lo THEN 0.0 ELSE (q.t - r.lo) / (r.hi - r.lo) END AS mt, r.lo, r.hi
  FROM hq q JOIN tr r USING (user_id))""", """mall AS (
  SELECT a.user_id, a.item_id,
         CASE WHEN EXISTS (SELECT 1 FROM train r WHERE r.user_id = a.user_id AND r.item_id = a.item_id) THEN 0.0
              WHEN r.hi = r.lo THEN 0.0 ELSE (a.s - r.lo) / (r.hi - r.lo) END AS m
  FROM allscores a JOIN tr r USING (user_id))""", """ranks AS (
  SELECT q.user_id, q.h, 1 + (SELECT COUNT(*) FROM mall a WHERE a.user_id = q.user_id AND a.item_id <> q.h
      AND (a.m > q.mt OR (a.m = q.mt AND a.item_id > q.h))) AS rank FROM mq q)""", """ks AS (
  SELECT CAST(unnest([3, 5, 7, 9, 11, 13]) AS INTEGER) AS k)""") + f"""SELECT k, COUNT(*) AS n_labels,
  ROUND(AVG(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END::DOUBLE), {ROUND}) AS hit_rate,
  ROUND(AVG(CASE WHEN rank <= k THEN ln(2) / ln(rank + 1) ELSE 0.0 END), {ROUND}) AS ndcg
FROM ranks, ks GROUP BY k"""
    q["rmse_pairs"] = w(INTER, SPLIT, FACTORS) + f"""SELECT COUNT(*) AS n,
  ROUND(SQRT(AVG(POW({DOT('u.f', 'i.f')} - t.rating, 2))), {ROUND}) AS rmse
FROM test t JOIN uf u ON t.user_id = u.id JOIN itf i ON t.item_id = i.id"""
    q["coverage_frequency"] = w(INTER, FACTORS, ALLSCORES, MASKED_TOP5, NAMES) + """SELECT f.item_id, n.package, f.freq
FROM (SELECT item_id, COUNT(*) AS freq FROM masked_top5 GROUP BY 1) f LEFT JOIN names n USING (item_id)"""
    q["coverage_share"] = w(INTER, FACTORS, ALLSCORES, MASKED_TOP5, """freq AS (
  SELECT item_id, COUNT(*) AS freq FROM masked_top5 GROUP BY 1)""", """ranked AS (
  SELECT freq, row_number() OVER (ORDER BY freq DESC, item_id DESC) AS r FROM freq)""", """tot AS (
  SELECT COUNT(*) AS n, SUM(freq) AS total FROM freq)""") + f"""SELECT (SELECT COUNT(*) FROM itf) AS item_count,
  CAST(n AS BIGINT) AS n_recommended_items, CAST(total AS BIGINT) AS n_recommendations,
  ROUND(COALESCE((SELECT SUM(freq) FROM ranked WHERE r <= floor(n * CAST(0.05 AS DOUBLE))), 0) / total, {ROUND}) AS item_coverage_5,
  ROUND(COALESCE((SELECT SUM(freq) FROM ranked WHERE r <= floor(n * CAST(0.2 AS DOUBLE))), 0) / total, {ROUND}) AS item_coverage_20,
  ROUND(COALESCE((SELECT SUM(freq) FROM ranked WHERE r <= floor(n * CAST(0.5 AS DOUBLE))), 0) / total, {ROUND}) AS item_coverage_50
FROM tot"""
    q["top5_items"] = w(INTER, FACTORS, ALLSCORES, MASKED_TOP5, NAMES) + """SELECT
  CAST(row_number() OVER (ORDER BY freq DESC, item_id DESC) AS INTEGER) AS rank, item_id, package, freq
FROM (SELECT f.item_id, n.package, f.freq FROM (SELECT item_id, COUNT(*) AS freq FROM masked_top5 GROUP BY 1) f
      LEFT JOIN names n USING (item_id)) ORDER BY freq DESC, item_id DESC LIMIT 5"""
    q["seen_lists"] = w(INTER, NAMES) + """SELECT user_id, CAST(item_id // 1000 AS INTEGER) AS chunk, COUNT(*) AS n,
  string_agg(COALESCE(n.package, CAST(item_id AS VARCHAR)), ',' ORDER BY item_id, COALESCE(n.package, CAST(item_id AS VARCHAR))) AS items
FROM (SELECT DISTINCT user_id, item_id FROM inter) t LEFT JOIN names n USING (item_id) GROUP BY 1, 2"""
    paired = (INTER, FACTORS, ALLSCORES, NAMES, """req AS (
  SELECT DISTINCT CAST(CASE WHEN event_type = 'purchase' THEN 84300000000 + user_id ELSE user_id END AS BIGINT) AS request_key
  FROM events WHERE event_type IN ('purchase', 'view'))""", """customers AS (
  SELECT CAST(c_custkey AS INTEGER) AS user_id, CAST(84300000000 + c_custkey AS BIGINT) AS msisdn FROM customer)""", """resolved AS (
  SELECT r.request_key, CASE WHEN r.request_key > 100000000 THEN c.user_id ELSE CAST(r.request_key AS INTEGER) END AS user_id
  FROM req r LEFT JOIN customers c ON r.request_key = c.msisdn)""", """top AS (
  SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id ASC) AS rank
      FROM allscores a WHERE a.user_id IN (SELECT user_id FROM resolved)
        AND NOT EXISTS (SELECT 1 FROM inter t WHERE t.user_id = a.user_id AND t.item_id = a.item_id)) WHERE rank <= 5)""",
              """lists AS (
  SELECT t.user_id, string_agg(COALESCE(n.package, CAST(t.item_id AS VARCHAR)), ',' ORDER BY t.rank) AS package_recommend
  FROM top t LEFT JOIN names n USING (item_id) GROUP BY 1)""", """owned AS (
  SELECT user_id, CAST(item_id // 1000 AS INTEGER) AS chunk,
    string_agg(COALESCE(n.package, CAST(item_id AS VARCHAR)), ',' ORDER BY item_id, COALESCE(n.package, CAST(item_id AS VARCHAR))) AS items
  FROM (SELECT DISTINCT user_id, item_id FROM inter) t LEFT JOIN names n USING (item_id) GROUP BY 1, 2)""", """paired AS (
  SELECT r.request_key, r.user_id, c.msisdn, COALESCE(o.chunk, 0) AS chunk, COALESCE(l.package_recommend, '') AS package_recommend,
    COALESCE(o.items, '') AS package_subscribed
  FROM resolved r LEFT JOIN customers c USING (user_id) LEFT JOIN lists l USING (user_id) LEFT JOIN owned o USING (user_id))""")
    q["recommend_lookup"] = w(*paired) + "SELECT request_key, user_id, msisdn, chunk, package_recommend, package_subscribed FROM paired"
    q["recommend_report"] = w(*paired) + """SELECT request_key, chunk, CAST(to_json(struct_pack(
  package_subscribed := CASE WHEN package_subscribed = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(package_subscribed, ',') END,
  package_recommended := CASE WHEN package_recommend = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(package_recommend, ',') END)) AS VARCHAR) AS result
FROM paired"""
    q["distinct_sketches"] = "SELECT event_type, COUNT(DISTINCT user_id) AS n_users, TRUE AS within_bound FROM events GROUP BY 1"
    q["popularity_with_test"] = w(INTER, SPLIT, """pop AS (
  SELECT item_id FROM inter GROUP BY 1 ORDER BY SUM(rating) DESC, item_id ASC LIMIT 1)""") + """SELECT
  (SELECT item_id FROM pop) AS pop_item, COUNT(*) AS n_test,
  COALESCE(AVG(CASE WHEN item_id = (SELECT item_id FROM pop) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0) AS ndcg,
  COALESCE(AVG(CASE WHEN item_id = (SELECT item_id FROM pop) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0) AS hit_rate
FROM test"""
    report_ctes = w(INTER, SPLIT, FACTORS, ALLSCORES, NAMES, """ranges AS (SELECT user_id, MIN(s) AS lo, MAX(s) AS hi FROM allscores GROUP BY 1)""", """masked AS (
  SELECT a.user_id, a.item_id,
         CASE WHEN EXISTS (SELECT 1 FROM train t WHERE t.user_id = a.user_id AND t.item_id = a.item_id) THEN 0.0
              WHEN r.hi = r.lo THEN 0.0 ELSE (a.s - r.lo) / (r.hi - r.lo) END AS m
  FROM allscores a JOIN ranges r USING (user_id))""", """ordered AS (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, item_id DESC) AS rank FROM masked)""", """freq AS (
  SELECT item_id, COUNT(*) AS freq FROM ordered WHERE rank <= 5 GROUP BY 1)""", """places AS (
  SELECT o.rank FROM test t JOIN ordered o ON t.user_id = o.user_id AND t.item_id = o.item_id)""", """nl AS (
  SELECT COUNT(*) AS n FROM test)""", """ks AS (SELECT CAST(unnest([3, 5, 7, 9, 11, 13]) AS INTEGER) AS k)""", """fr AS (
  SELECT freq, row_number() OVER (ORDER BY freq DESC, item_id DESC) AS r FROM freq)""", """tot AS (SELECT COUNT(*) AS n, SUM(freq) AS total FROM freq)""",
                    """t5 AS (SELECT f.item_id, f.freq, n.package, row_number() OVER (ORDER BY f.freq DESC, f.item_id DESC) AS r
  FROM freq f LEFT JOIN names n USING (item_id))""")
    share = "COALESCE((SELECT SUM(freq) FROM fr WHERE r <= floor(n * CAST({p} AS DOUBLE))), 0) / total"
    parts = ["SELECT 'list_product_freq' AS section, CAST(item_id AS VARCHAR) AS key, CAST(freq AS DOUBLE) AS value FROM freq",
             "SELECT 'top_5_items', CAST(r AS VARCHAR) || ':' || COALESCE(package, CAST(item_id AS VARCHAR)), CAST(freq AS DOUBLE) FROM t5 WHERE r <= 5",
             "SELECT 'item_coverage', 'item_count', CAST(COUNT(*) AS DOUBLE) FROM itf",
             "SELECT 'item_coverage', 'n_recommended_items', CAST(n AS DOUBLE) FROM tot",
             "SELECT 'item_coverage', 'n_recommendations', CAST(total AS DOUBLE) FROM tot",
             *(f"SELECT 'item_coverage', 'item_coverage_{name}', CAST({share.format(p=p)} AS DOUBLE) FROM tot" for name, p in ((5, 0.05), (20, 0.2), (50, 0.5))),
             "SELECT 'all_subscribed_package_freq', CAST(item_id AS VARCHAR), CAST(COUNT(*) AS DOUBLE) FROM inter WHERE rating <> 0 GROUP BY item_id",
             "SELECT 'hit_rate', CAST(k AS VARCHAR), SUM(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / (SELECT n FROM nl) FROM ks LEFT JOIN places ON TRUE GROUP BY k",
             "SELECT 'ndcg', CAST(k AS VARCHAR), SUM(CASE WHEN rank <= k THEN ln(2) / ln(rank + 1) ELSE 0.0::DOUBLE END) / (SELECT n FROM nl) FROM ks LEFT JOIN places ON TRUE GROUP BY k"]
    q["performance_report"] = report_ctes + "SELECT section, key, ROUND(value, 6) AS value FROM (" + "\nUNION ALL ".join(parts) + ")"
    negs = """cat AS (SELECT DISTINCT item_id FROM inter),
negpairs AS (SELECT t.user_id, t.item_id AS h, c.item_id AS j FROM test t, cat c WHERE c.item_id <> t.item_id {extra})"""
    tail = """SELECT t.user_id, t.item_id, CAST(COUNT(n.j) AS BIGINT) AS n_neg, MIN(n.j) AS min_neg, MAX(n.j) AS max_neg,
  CAST(COALESCE(SUM(n.j), 0) AS BIGINT) AS sum_neg
FROM test t LEFT JOIN negpairs n ON t.user_id = n.user_id AND t.item_id = n.h GROUP BY 1, 2"""
    q["test_negatives_all"] = w(INTER, SPLIT, negs.format(extra="")) + tail
    q["test_negatives_unseen"] = w(INTER, SPLIT, negs.format(
        extra="AND NOT EXISTS (SELECT 1 FROM train r WHERE r.user_id = t.user_id AND r.item_id = c.item_id)")) + tail
    q["train_negatives"] = w(INTER, SPLIT, TRAIN_NEG) + "SELECT user_id, item_id, draw, neg_item FROM negs"
    q["log_loss"] = w(INTER, SPLIT, TRAIN_NEG, FACTORS, """rows_ AS (
  SELECT user_id, item_id, 1 AS label FROM train UNION ALL SELECT user_id, neg_item, 0 FROM negs)""", f"""scored AS (
  SELECT r.label, 1.0 / (1.0 + exp(-{DOT('u.f', 'i.f')})) AS p
  FROM rows_ r JOIN uf u ON r.user_id = u.id JOIN itf i ON r.item_id = i.id)""") + f"""SELECT COUNT(*) AS n,
  ROUND(AVG(-(label * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - label) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))),
        {ROUND}) AS log_loss
FROM scored"""
    q["stream_requests"] = """SELECT CAST(event_id AS VARCHAR) AS session_id,
  CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 'recommender_training'
       WHEN 'view' THEN 'recommender_evaluate' ELSE 'recommender_predict' END AS process_id,
  CASE event_type WHEN 'error' THEN 'quarantine' WHEN 'signup' THEN 'train' WHEN 'view' THEN 'ignore'
       WHEN 'click' THEN 'quarantine' ELSE 'predict' END AS handler,
  CASE WHEN event_type = 'purchase' THEN CAST(84300000000 + user_id AS BIGINT) END AS request_key,
  CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN 5 END AS num_items
FROM events"""
    q["stream_status"] = """SELECT CAST(e.event_id AS VARCHAR) AS session_id, s.status, s.seq
FROM events e, (VALUES ('ACCEPTED', 1), ('RUNNING', 2), ('FINISHED', 3)) s(status, seq)
WHERE e.event_type = 'purchase'"""
    q["stream_response"] = w(INTER, FACTORS, ALLSCORES, NAMES, """req AS (
  SELECT CAST(event_id AS VARCHAR) AS session_id, CAST(84300000000 + user_id AS BIGINT) AS request_key,
         CAST(user_id AS INTEGER) AS user_id FROM events WHERE event_type = 'purchase')""", """top AS (
  SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id ASC) AS rank
      FROM allscores a WHERE a.user_id IN (SELECT user_id FROM req)
        AND NOT EXISTS (SELECT 1 FROM inter t WHERE t.user_id = a.user_id AND t.item_id = a.item_id)) WHERE rank <= 5)""",
                                 """lists AS (
  SELECT t.user_id, string_agg(COALESCE(n.package, CAST(t.item_id AS VARCHAR)), ',' ORDER BY t.rank) AS package_recommend
  FROM top t LEFT JOIN names n USING (item_id) GROUP BY 1)""") + """SELECT r.session_id, r.request_key, r.user_id,
  COALESCE(l.package_recommend, '') AS package_recommend FROM req r LEFT JOIN lists l USING (user_id)"""
    q["stream_response_envelopes"] = q["stream_response"].replace("""SELECT r.session_id, r.request_key, r.user_id,
  COALESCE(l.package_recommend, '') AS package_recommend FROM req r""", """SELECT r.session_id, '1002' AS message_type, CAST(0 AS INTEGER) AS message_number,
  TRUE AS is_finished, '{"' || r.request_key || '":"' || COALESCE(l.package_recommend, '') || '"}' AS result FROM req r""")
    q["files_raw_lines"] = q["raw_standardize"]
    q["files_offers"] = w(OFFERS) + "SELECT * FROM offers"
    q["files_ratings"] = w(INTER) + "SELECT user_id, item_id, rating, CAST(item_id % 10 AS INTEGER) AS bucket FROM inter WHERE item_id % 10 NOT IN (3, 7, 9)"
    q["files_bad_records"] = w(INTER) + """SELECT CASE item_id % 10 WHEN 7 THEN 'missing user_id' ELSE 'malformed' END AS reason, COUNT(*) AS n
FROM inter WHERE item_id % 10 IN (3, 7, 9) GROUP BY 1"""
    q["files_labels"] = w(INTER, SPLIT) + """SELECT user_id, item_id, CAST(item_id % 4 <> 0 AS INTEGER) AS label,
  CASE WHEN item_id % 4 <> 0 THEN 1.0::DOUBLE END AS binary FROM test"""
    q["files_negatives"] = w(INTER, SPLIT, TRAIN_NEG) + "SELECT DISTINCT user_id, item_id AS heldout, neg_item AS item_id FROM negs"
    q["matrix_shape"] = w(INTER) + "SELECT COUNT(DISTINCT user_id) AS n_rows, COUNT(DISTINCT item_id) AS n_columns, COUNT(*) AS n_cells FROM inter"
    q["stream_requests_once"] = """SELECT CAST(event_id AS VARCHAR) AS session_id, CAST(84300000000 + user_id AS BIGINT) AS request_key,
  CAST(1 AS BIGINT) AS n_answers FROM events WHERE event_type = 'purchase'"""
    q["stream_latest_status"] = """WITH s AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 AS event_ms,
         CASE event_type WHEN 'click' THEN 'ACCEPTED' WHEN 'view' THEN 'RUNNING' ELSE 'FINISHED' END AS status,
         CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS seq
  FROM events WHERE event_type IN ('click', 'view', 'purchase')),
l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ms DESC, seq DESC) AS r,
             MAX(event_ms) OVER () - 2 * 86400000 AS watermark FROM s)
SELECT session_id, status, CAST(seq AS INTEGER) AS seq, CAST(event_ms AS BIGINT) AS event_ms,
  (status <> 'FINISHED' AND event_ms + 5 * 86400000 < watermark) AS expired FROM l WHERE r = 1"""
    q["stored_factors"] = w(FACTORS) + f"""SELECT CAST(2 AS INTEGER) AS version, id, CAST(len(f) AS INTEGER) AS dim,
  ROUND(SQRT({DOT('f', 'f')}), {ROUND}) AS norm FROM itf"""
    return q
