"""URL filter: host and path rules, and a character language-model ratio for the rest. DataFrame and SQL functions only.

Rules fit their host and all its subdomains where the path starts with the rule's; the longest rule wins. The URLs that rules
accept and reject train two variable-order Markov models of characters (contexts of 0 to 2 symbols, longer ones
blended with shorter ones by Witten-Bell weights). A URL without a rule gets the length-normalised
difference of its log-likelihoods; the cut is calibrated on the ruled URLs, where accepted and rejected shares that fall on
the wrong side are smallest.

Scale: characters are folded to SYMBOLS classes, so the models have SYMBOLS ** 3 cells whatever the input, which bounds
the broadcast table that the runs of three symbols of a URL are joined with. Equal rows are scored once, after one shuffle
by row; their runs stay in the task. Counting is a partial aggregation.

Cases: null URL or one without ``://``: empty host and path, no rule, score 0; no accepted or no rejected URL: the
model that is missing is uniform; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.llm.shared import written

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits count as one symbol; what is not listed is symbol 0.
ALPHABET = _LOWER + "0/.-_~%=+,:@"
SYMBOLS = len(ALPHABET) + 2
EDGE = SYMBOLS - 1
SCALE = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and ruled (allow, block or null) from host and path."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in reversed(longest_first):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def _symbols(host: Column, path: Column) -> Column:
    """Symbol numbers of host and path, with two edges before and one behind."""
    text = F.translate(F.concat(host, F.translate(path, _UPPER, _LOWER)), "123456789", "000000000")
    own = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))
    return F.concat(F.array(F.lit(EDGE), F.lit(EDGE)), own, F.array(F.lit(EDGE)))


def _with_grams(rows: DataFrame) -> DataFrame:
    """Adds grams: the numbers of the runs of three symbols."""
    symbols = F.col("symbols")
    grams = F.transform(F.sequence(F.lit(0), F.size(symbols) - 3), lambda i: (F.get(symbols, i) * SYMBOLS + F.get(symbols, i + 1)) * SYMBOLS + F.get(symbols, i + 2))
    return rows.withColumn("grams", grams).drop("symbols")


def log_ratio(ruled: DataFrame) -> DataFrame:
    """(g, w): log P(accepted) - log P(rejected) of each run of three symbols. ``ruled``: rows with ruled and grams."""
    spark = ruled.sparkSession
    counts = written(ruled.select((F.col("ruled") == "allow").alias("good"), F.explode("grams").alias("g")).groupBy("g").agg(
        F.count_if("good").alias("c1"), F.count_if(~F.col("good")).alias("c0")), "url-grams")
    cells = spark.range(SYMBOLS ** 3).select(F.col("id").cast("int").alias("g")).join(counts, "g", "left") \
        .select("g", F.coalesce("c1", F.lit(0)).alias("c1"), F.coalesce("c0", F.lit(0)).alias("c0")) \
        .withColumn("c", F.col("g") % SYMBOLS).withColumn("bc", F.col("g") % (SYMBOLS * SYMBOLS)) \
        .withColumn("b", F.floor(F.col("bc") / SYMBOLS)).withColumn("ab", F.floor(F.col("g") / SYMBOLS))
    one = cells.groupBy("c").agg(*(F.sum(k).alias(f"u_{k}") for k in ("c1", "c0")))
    all_ = one.agg(*(F.sum(f"u_{k}").alias(f"n_{k}") for k in ("c1", "c0")))
    two = cells.groupBy("bc", "b").agg(*(F.sum(k).alias(f"d_{k}") for k in ("c1", "c0")))
    two_of = two.groupBy("b").agg(*(x for k in ("c1", "c0") for x in (F.sum(f"d_{k}").alias(f"dn_{k}"), F.count_if(F.col(f"d_{k}") > 0).alias(f"dt_{k}"))))
    three_of = cells.groupBy("ab").agg(*(x for k in ("c1", "c0") for x in (F.sum(k).alias(f"tn_{k}"), F.count_if(F.col(k) > 0).alias(f"tt_{k}"))))
    # every table here has at most SYMBOLS ** 3 rows
    whole = cells.join(F.broadcast(one), "c").join(F.broadcast(two.drop("b")), "bc").join(F.broadcast(two_of), "b").join(F.broadcast(three_of), "ab") \
        .withColumn("one", F.lit(1)).join(F.broadcast(all_.withColumn("one", F.lit(1))), "one")

    def p(k: str) -> Column:
        p1 = (F.col(f"u_{k}") + 0.5) / (F.col(f"n_{k}") + 0.5 * SYMBOLS)
        p2 = F.when(F.col(f"dn_{k}") > 0, (F.col(f"d_{k}") + F.col(f"dt_{k}") * p1) / (F.col(f"dn_{k}") + F.col(f"dt_{k}"))).otherwise(p1)
        return F.when(F.col(f"tn_{k}") > 0, (F.col(k) + F.col(f"tt_{k}") * p2) / (F.col(f"tn_{k}") + F.col(f"tt_{k}"))).otherwise(p2)

    return whole.select("g", (F.log(p("c1")) - F.log(p("c0"))).alias("w"))


def calibrated_cut(scored: DataFrame) -> DataFrame:
    """One row: the score (a multiple of 1 / SCALE) at which the shares of accepted URLs below and rejected URLs above are smallest together."""
    bins = scored.select(F.floor(F.col("score") * SCALE).alias("bin"), (F.col("ruled") == "allow").alias("good")).groupBy("bin").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # scores lie within a few units of 0, so there are a few thousand bins whatever the input
    pairs = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "good", "bad"))).alias("bins"), F.sum("good").alias("goods"), F.sum("bad").alias("bads"))
    start = F.struct(F.lit(0).cast("long").alias("below"), F.col("bads").cast("long").alias("above"), F.lit(2.0).alias("least"), F.lit(0).cast("long").alias("cut"))

    def step(acc, x):
        cost = acc["below"] / F.greatest("goods", F.lit(1)) + acc["above"] / F.greatest("bads", F.lit(1))
        better = cost < acc["least"]
        return F.struct((acc["below"] + x["good"]).alias("below"), (acc["above"] - x["bad"]).alias("above"),
                        F.when(better, cost).otherwise(acc["least"]).alias("least"), F.when(better, x["bin"]).otherwise(acc["cut"]).alias("cut"))

    return pairs.select(F.coalesce(F.aggregate("bins", start, step)["cut"] / SCALE, F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) of each row."""
    host, path = host_and_path(F.col(url_col))
    # written: else every use of host, path and symbols evaluates their expressions anew
    parsed = written(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "urls")
    base = written(with_rule(parsed, rules).withColumn("symbols", _symbols(F.col("host"), F.col("path"))), "ruled-urls")
    weights = written(log_ratio(_with_grams(base.where("ruled is not null"))), "url-weights")
    keys = ["id", "host", "path", "rule", "ruled"]
    rows = _with_grams(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.first("symbols").alias("symbols"))).withColumn("g", F.explode("grams")).drop("grams")
    mean = F.sum("w") / F.count("w")
    scored = written(rows.join(F.broadcast(weights), "g").groupBy(*keys, "copies")  # at most SYMBOLS ** 3 rows are broadcast
                     .agg(F.when(F.col("host") == "", 0.0).otherwise(mean).alias("score")), "url-scores")
    cut = calibrated_cut(scored.where("ruled is not null"))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= cut.scalar(), "allow").otherwise("block"))
    return scored.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")) \
        .select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
