"""Mergeable sketches: distinct counts and quantiles kept per period and batch, merged to longer periods without reading rows again.

A HyperLogLog sketch of 2 ** lg registers errs by 1.04 / sqrt(2 ** lg) as one standard
deviation; a KLL sketch of size k by about 1.65 / k ** 0.9 * 1.2 in rank at 99 %
confidence (1.65 % at k = 200).  Both are of bounded size whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, K = 12, 200


def distinct_error(lg: int = LG) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / math.sqrt(1 << lg)


#: Error in rank of a quantile at 99 % confidence, as the sketch's authors state it for K.
RANK_ERROR = 0.0165


def sketched(rows: DataFrame, by: dict[str, Column], distinct: str, measure: str, lg: int = LG, k: int = K) -> DataFrame:
    """(by, n, distinct, quantiles): rows per group, a sketch of one column's distinct values and one of another's distribution.

    Nulls of the two columns enter neither sketch; n counts all rows.
    """
    return rows.groupBy(*[c.alias(name) for name, c in by.items()]).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(F.col(distinct), F.lit(lg)).alias("distinct"),
        F.kll_sketch_agg_double(F.col(measure).cast("double"), F.lit(k)).alias("quantiles"),
    )


def merged(sketches: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Sketches of longer periods or of several batches from those of ``sketched``, in the same columns."""
    return sketches.groupBy(*[c.alias(name) for name, c in by.items()]).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles")
    )


def estimated(sketches: DataFrame, quantiles: list[float]) -> DataFrame:
    """The sketches' groups with n, distinct_estimate and q_<percent> per quantile instead of the sketches."""
    keys = [c for c in sketches.columns if c not in ("n", "distinct", "quantiles")]
    at = [F.kll_sketch_get_quantile_double("quantiles", F.lit(q)).alias(f"q_{round(100 * q)}") for q in quantiles]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("distinct").alias("distinct_estimate"), *at)
