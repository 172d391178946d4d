"""Row sampling: a repeatable hash sample, and a small random batch without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX_DIGITS = 8


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """Keep a row when the hash of its keys falls into the first `fraction` of the hash range.

    The choice depends on the row alone, so a retried task, another partitioning or a stream makes the same one.
    """
    return df.filter(_sampled(keys, fraction))


def _sampled(keys: Sequence[str], fraction: float) -> Column:
    if fraction >= 1:
        return F.lit(True)
    bound = f"{round(fraction * 16**HEX_DIGITS):0{HEX_DIGITS}x}"
    return F.substring(F.md5(F.concat_ws("|", *keys)), 1, HEX_DIGITS) < bound


def with_resent(df: DataFrame, keys: Sequence[str], fraction: float = 0.01) -> DataFrame:
    """The rows plus a sample of them once more, as a feed that re-sends some events; one pass over the rows."""
    copies = F.when(_sampled(keys, fraction), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_copy", F.explode(copies)).drop("_copy")


def random_batch(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """About n random rows, n at most: a Bernoulli sample of three times the share, cut to n; nothing is sorted."""
    total = df.count()
    return df.sample(withReplacement=False, fraction=min(1.0, 3.0 * n / max(total, 1)), seed=seed).limit(n)
