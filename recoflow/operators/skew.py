"""Skew-proof joins on a key that one value may dominate (a user owning a third of all rows).

``salted_join(many, few, keys)`` joins a table with many rows per key to a table
with few rows per key. Rows of ``many`` get a salt from a hash of their own
columns; ``few`` is replicated once per salt value; the equi-join runs on
(keys, salt). Every ``many`` row still meets every matching ``few`` row, so the
result equals ``many.join(few, keys, how)``, but a hot key is spread over
``salts`` tasks. The price is ``few`` × ``salts`` rows, and a replicated side
that may no longer fit a broadcast.

When the session runs adaptive execution with skew-join handling (the default
in ``session.build_session`` and in Spark), the runtime already splits an
oversized partition of ``many`` and replicates the matching part of ``few``;
then a plain join is used and salting is skipped. ``force=True`` salts anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
_SALT = "_salt"


def runtime_splits_skew(spark) -> bool:
    conf = spark.conf
    return (conf.get("spark.sql.adaptive.enabled", "true").lower() == "true"
            and conf.get("spark.sql.adaptive.skewJoin.enabled", "true").lower() == "true")


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS,
                salt_on: list[str] | None = None, force: bool = False) -> DataFrame:
    """``many.join(few, keys, how)`` for how in inner / left / left_semi / left_anti, hot keys split."""
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"salted join keeps the many-rows side on the left; unsupported join type {how!r}")
    if not force and runtime_splits_skew(many.sparkSession):
        return many.join(few, keys, how)
    cols = salt_on or [c for c in many.columns if c not in keys] or keys
    salted = many.withColumn(_SALT, F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    replicated = few.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(replicated, keys + [_SALT], how).drop(_SALT)
