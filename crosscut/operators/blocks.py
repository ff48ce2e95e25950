"""Long histories in blocks: one key's rows over many tasks, for kernels whose order runs through all of them.

`numbered` gives each row its place within its key without bringing the key together. Kernels that look back a bounded number
of rows get a block's rows with those before (`halo`); kernels that run through all rows get what the blocks before hold,
from one row of state a block (`earlier`). A key's states meet in one task: BLOCK times fewer than its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared

#: Rows of a key that one task may hold.
BLOCK = 1 << 16


def is_long(df: DataFrame, key: Sequence[str], size: int = BLOCK) -> bool:
    """Whether some key has more than `size` rows."""
    return df.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > size).limit(1).count() > 0


def numbered(df: DataFrame, key: Sequence[str], date: str) -> DataFrame:
    """df with _i, the place of a row within its key from 0.

    The rows are dealt into ranges of key and date and written; ranges are numbered apart from each other and shifted by
    what the ranges before hold of the key.
    """
    key = list(key)
    held = shared(df, "rows").repartitionByRange(*key, date).sortWithinPartitions(*key, date)
    at = shared(held.withColumn("_range", F.spark_partition_id()), "ordered")
    counts = at.groupBy(*key, "_range").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(date))
    t = null_safe_join(at.withColumn("_place", place), shift, [*key, "_range"])
    return t.withColumn("_i", F.col("_before") + F.col("_place") - 1).drop("_range", "_place", "_before")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal columns, where two NULLs are equal; the columns of left, then the others of right."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    both = left.join(right, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on], how)
    return both.drop(*[f"_r_{c}" for c in on])


def block_of(size: int) -> Column:
    return F.floor(F.col("_i") / size)


def halo(t: DataFrame, before: int, size: int = BLOCK) -> DataFrame:
    """Rows with _i, dealt to their block and to those that look back on them: _block, and _own in their own block.

    Within (key, _block), windows of up to `before` rows back are whole for the rows that are _own.
    """
    blocks = F.sequence(F.floor(F.col("_i") / size), F.floor((F.col("_i") + before) / size))
    return t.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == block_of(size))


def earlier(states: DataFrame, key: Sequence[str]):
    """The window over a key's blocks before a block, for states with key and _block."""
    return Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def inside(key: Sequence[str]):
    """The window over a block's rows."""
    return Window.partitionBy(*key, "_block").orderBy("_i")


def running_count(df: DataFrame, value: str, out: str, key: Sequence[str], date: str, size: int = BLOCK) -> DataFrame:
    """df with the number of values of its key so far."""
    t = (df if "_i" in df.columns else numbered(df, key, date)).withColumn("_block", block_of(size))
    states = t.groupBy(*key, "_block").agg(F.count(value).alias("_n"))
    states = states.withColumn("_before", F.coalesce(F.sum("_n").over(earlier(states, key)), F.lit(0))).drop("_n")
    t = null_safe_join(t, states, [*key, "_block"])
    so_far = F.count(value).over(inside(key).rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn(out, F.col("_before") + so_far).drop("_before", "_block")


def places(df: DataFrame, label: str, key: Sequence[str], date: str, size: int = BLOCK) -> DataFrame:
    """Rows with a label, with the number of their run of equal labels, their place in it, _i, _block and _first, the key's first label.

    A block's state is its first and last label, the changes inside and where the last of them is; whether its first row
    begins a run hangs on the last label of the block before.
    """
    key = list(key)
    t = numbered(df.filter(F.col(label).isNotNull()), key, date).withColumn("_block", block_of(size))
    t = t.withColumn("_change", F.col(label) != F.lag(label).over(inside(key)))  # NULL in a block's first row
    changed = F.when(F.col("_change"), F.col("_i"))
    s = t.groupBy(*key, "_block").agg(
        F.min_by(label, "_i").alias("_head"), F.max_by(label, "_i").alias("_tail"), F.min("_i").alias("_from"), F.count(changed).alias("_changes"), F.max(changed).alias("_last")
    )
    order = Window.partitionBy(*key).orderBy("_block")
    s = s.withColumn("_opens", ~F.col("_head").eqNullSafe(F.lag("_tail").over(order)))
    start = F.coalesce("_last", F.when(F.col("_opens"), F.col("_from")))
    s = s.withColumns(
        {
            "_runs": F.coalesce(F.sum(F.col("_changes") + F.col("_opens").cast("int")).over(earlier(s, key)), F.lit(0)),
            "_start": F.last(start, ignorenulls=True).over(earlier(s, key)),
            "_first": F.first("_head").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    t = null_safe_join(t, s.select(*key, "_block", "_opens", "_runs", "_start", "_first"), [*key, "_block"])
    so_far = inside(key).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_change", F.coalesce("_change", "_opens"))
    t = t.withColumn("run", F.col("_runs") + F.sum(F.col("_change").cast("int")).over(so_far))
    begun = F.coalesce(F.last(F.when(F.col("_change"), F.col("_i")), ignorenulls=True).over(so_far), F.col("_start"))
    return t.withColumn("place", F.col("_i") - begun + 1).drop("_change", "_opens", "_runs", "_start")


def last_so_far(t: DataFrame, value: Column, out: str, key: Sequence[str], inclusive: bool = True) -> DataFrame:
    """t (with _i and _block) with the last value of its key that isn't NULL, up to the row or before it."""
    held = t.withColumn("_v", value)
    s = held.groupBy(*key, "_block").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_i", "_v"))).alias("_s"))
    s = s.select(*key, "_block", F.last("_s", ignorenulls=True).over(earlier(s, key))["_v"].alias("_before"))
    t = null_safe_join(held, s, [*key, "_block"])
    frame = inside(key).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return t.withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(frame), F.col("_before"))).drop("_v", "_before")


def first_of_key(t: DataFrame, value: str, out: str, key: Sequence[str]) -> DataFrame:
    """t (with _i) with the first value of its key that isn't NULL."""
    s = t.groupBy(*key).agg(F.min(F.when(F.col(value).isNotNull(), F.struct("_i", value)))[value].alias(out), F.max("_i").alias("_end"))
    return null_safe_join(t, s, list(key))
