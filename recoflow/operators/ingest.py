"""Subscriber line standardisation (SC1 P1 P2 F1 F2 U4 → L1).

One narrow chain: no shuffle at all. The original concatenated the offer lists
per msisdn before exploding them; exploding each line directly gives the same
multiset of (msisdn, package) rows, so that shuffle is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.functions.columns import offer_is_kept, rewrite_msisdn, strip_brand_tokens


def parse_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """SC1: ``msisdn,offer,offer,…`` → (msisdn string, offers array<string>)."""
    parts = F.split(F.col(value_col), ",")
    return lines.select(parts.getItem(0).alias("msisdn"),
                        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("offers"))


def clean_offers(parsed: DataFrame) -> DataFrame:
    """P1 + P2 + F1 + F2 on (msisdn, offers): rewritten msisdn, cleaned non-empty offer lists."""
    return (parsed
            .select(rewrite_msisdn("msisdn").alias("msisdn"),
                    F.filter(F.transform("offers", strip_brand_tokens), offer_is_kept).alias("offers"))
            .where(F.size("offers") > 0))


def standardize_subscribers(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """L1: raw lines → (msisdn bigint, package string), one row per purchased offer.

    F2 needs no filter here: exploding an emptied offer list yields no rows
    (an explicit filter would be pushed below the projection by Catalyst and
    make it clean every line twice).
    """
    parsed = parse_lines(lines, value_col)
    return parsed.select(rewrite_msisdn("msisdn").try_cast("bigint").alias("msisdn"),
                         F.explode(F.filter(F.transform("offers", strip_brand_tokens), offer_is_kept)).alias("package"))
