"""Running extremes along a key's history in two levels, so that no task orders a whole history.

A history falls into spans (of time, or of offsets). Within a span the running extreme is a
window from its start; across spans it is a window over one row a span. Frames start at the
first row, so each costs one pass over sorted rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F


def running(df: DataFrame, keys: list[str], order: list[Column], span: Column, value: Column, out: str, inclusive: bool = False, after: bool = False) -> DataFrame:
    """``df`` with ``out``: the greatest ``value`` of the key's rows before each row (with ``inclusive``, up to it).

    ``order`` is ascending. With ``after``, the least value of the rows behind it instead;
    ``order`` is then descending. Null values count as absent; null keys are a key.
    """
    best = F.min if after else F.max
    pick = F.least if after else F.greatest
    spanned = df.withColumns({"_span": span, "_v": value})
    within = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    tops = spanned.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_span").alias("_s")).agg(best("_v").alias("_top"))
    across = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(F.col("_s").desc() if after else F.col("_s")).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("_carried", best("_top").over(across)).drop("_top")  # a row a span
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_span").eqNullSafe(F.col("_s"))]
    joined = spanned.withColumn("_here", best("_v").over(within)).join(carried, reduce(and_, same))
    return joined.withColumn(out, pick("_here", "_carried")).select(*[c for c in df.columns if c != out], out)
