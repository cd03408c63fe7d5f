"""Ordered scans that split hot groups: a running aggregate without one task per group.

Rows of a group are cut into blocks by their integer position.  Each block is scanned by
itself; the blocks' totals, one row each, are scanned per group and carried in.  A group
that holds a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def running(df: DataFrame, keys: list[str], pos: str, value: Column, into: str, how: str = "sum", inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """``df`` with a column ``into``: sum or max of ``value`` over the rows of the group up to this one.

    ``pos`` is an integer order, unique in its group.  Nulls are skipped; without a value
    so far the result is null.  Without ``inclusive`` the row itself is not counted.
    """
    return running_all(df, keys, pos, {into: (value, how, inclusive)}, block)


def running_all(df: DataFrame, keys: list[str], pos: str, wanted: dict[str, tuple[Column, str, bool]], block: int = BLOCK) -> DataFrame:
    """``running`` for several columns in one pass: name -> (value, how, inclusive)."""
    agg = {"sum": F.sum, "max": F.max}
    marked = df.withColumns({f"_v_{n}": v for n, (v, _, _) in wanted.items()}).withColumn("_block", F.floor(F.col(pos) / F.lit(block)))
    local = marked
    for n, (_, how, inclusive) in wanted.items():
        frame = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        local = local.withColumn(f"_l_{n}", agg[how](f"_v_{n}").over(frame))
    totals = marked.groupBy(*keys, "_block").agg(*(agg[how](f"_v_{n}").alias(f"_t_{n}") for n, (_, how, _) in wanted.items()))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), *(agg[how](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (_, how, _) in wanted.items()))
    joined = local.join(carried, F.expr(" and ".join([f"`{k}` <=> `_k_{k}`" for k in keys] + ["_block <=> _b"])))

    def merged(n: str, how: str) -> Column:
        here, carry = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        both = here + carry if how == "sum" else F.greatest(here, carry)
        return F.when(here.isNull(), carry).when(carry.isNull(), here).otherwise(both)

    out = joined.withColumns({n: merged(n, how) for n, (_, how, _) in wanted.items()})
    return out.drop("_block", "_b", *(f"_{c}_{n}" for c in "vlc" for n in wanted), *[f"_k_{k}" for k in keys])
