"""Column expressions: every scalar rule of the system as a JVM-side expression.

Nothing here runs Python per row; all of it stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from recoflow import constants as C


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- P1 / P2 / F1 -----------------------------------------------------------

def rewrite_msisdn(msisdn) -> Column:
    """A leading 8416 becomes 843; anything else is left unchanged."""
    m = col_(msisdn)
    return F.when(m.startswith(C.MSISDN_OLD_PREFIX),
                  F.concat(F.lit(C.MSISDN_NEW_PREFIX), F.substring(m, len(C.MSISDN_OLD_PREFIX) + 1, 1 << 30))
                  ).otherwise(m)


def strip_brand_tokens(offer) -> Column:
    """Remove every brand token, literally, in the fixed order."""
    o = col_(offer)
    for token in C.BRAND_TOKENS:
        o = F.replace(o, F.lit(token), F.lit(""))
    return o


def offer_is_kept(offer) -> Column:
    """F1 (+D16): keep non-empty offers that start with none of the filter prefixes."""
    o = col_(offer)
    keep = o.isNotNull() & (F.length(o) > 0)
    for prefix in C.OFFER_FILTER:
        keep = keep & ~o.startswith(prefix)
    return keep


# ---- P12: dot product --------------------------------------------------------

def dot(a, b) -> Column:
    """Sequential double dot product, sum over d in index order starting at 0.0.

    The blocked scorer (operators.scoring) accumulates in the same order, so
    the two agree bit for bit.
    """
    prod = F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


# ---- P7 / P8: min-max scaling -------------------------------------------------

def minmax_scaled(x, lo, hi) -> Column:
    """(x - lo) / (hi - lo); a zero range gives 0; NULL stays NULL."""
    x, lo, hi = col_(x), col_(lo), col_(hi)
    return F.when(x.isNull(), F.lit(None).cast("double")) \
        .when(hi == lo, F.lit(0.0)) \
        .otherwise((x - lo) / (hi - lo))


# ---- P20 / A10: log discount ---------------------------------------------------

def ndcg_at(rank, k) -> Column:
    """One relevant item at 1-based rank: ln 2 / ln(rank + 1) when rank <= k, else 0."""
    r = col_(rank)
    k = col_(k) if not isinstance(k, int) else F.lit(k)
    return F.when(r.isNotNull() & (r <= k), F.lit(math.log(2.0)) / F.log(r.cast("double") + 1.0)).otherwise(F.lit(0.0))


def hit_at(rank, k) -> Column:
    r = col_(rank)
    k = col_(k) if not isinstance(k, int) else F.lit(k)
    return F.when(r.isNotNull() & (r <= k), F.lit(1.0)).otherwise(F.lit(0.0))


# ---- L7: replayable uniform draw ---------------------------------------------------

def hashed_index(n, *parts) -> Column:
    """Uniform-ish index in [0, n): md5 of the '-'-joined parts, first 8 hex digits, mod n."""
    h = F.md5(F.concat_ws("-", *[col_(p).cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), col_(n).cast("bigint"))


# ---- P16 / P17: message content -------------------------------------------------

def parse_key_list(text) -> Column:
    """A list literal of integers, e.g. "[84300000007, 5]", as array<bigint>; NULL if malformed, empty or with a null."""
    keys = F.from_json(col_(text), "array<bigint>")
    return F.when((F.size(keys) > 0) & ~F.exists(keys, lambda x: x.isNull()), keys)


def log_loss_term(label, prob, eps: float = C.LOG_LOSS_EPS) -> Column:
    """Binary cross-entropy of one prediction, probabilities clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(col_(prob), F.lit(eps)), F.lit(1.0 - eps))
    y = col_(label).cast("double")
    return -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))
