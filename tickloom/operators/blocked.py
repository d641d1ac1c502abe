"""Window results that stay correct and parallel when one key holds most rows.

A plain window puts a whole key into one task. Here a key is cut into ordered
blocks (``block`` is a deterministic expression that never decreases along the
order). Each block is windowed on its own and gets a carry from the blocks
before it; the carries come from a pre-aggregated table with one row per
(key, block). Blocks must be short enough for a task: pick the block width so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.binding import micros
from tickloom.session import cut_lineage

_BLOCK = "__block"


def time_block(ts: Column, seconds: int) -> Column:
    """Number of the ``seconds``-wide time slice a timestamp falls into."""
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``__at``: blocks of about equal numbers of rows along (keys, order), cut by measure.

    Rows are range-partitioned, and the partition is the block, fixed by writing it. So a key with a busy hour has many
    blocks there, and a quiet one shares its block; adaptive execution puts small ones together up to its advisory size.
    Rows of one key and order stay together.
    """
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("__at", F.spark_partition_id()))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal keys where NULL equals NULL; right columns named like the keys are dropped."""
    r = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[f"__r_{k}"])
    return left.join(r, cond, "left").drop(*[f"__r_{k}" for k in keys])


def with_carries(df: DataFrame, keys: Sequence[str], block: Column, values: dict[str, Column]) -> DataFrame:
    """``df`` with its block, and per entry of ``values`` the value ``__v_`` and the sum ``__c_`` over earlier blocks."""
    d = df.withColumn(_BLOCK, block).withColumns({f"__v_{n}": v for n, v in values.items()})
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        d.groupBy(*keys, _BLOCK)
        .agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
        .select(
            *keys, _BLOCK, *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in values]
        )
    )
    return _null_safe_join(d, carries, [*keys, _BLOCK])


def running_sums(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], values: dict[str, Column]
) -> DataFrame:
    """Add one column per entry of ``values``: its sum over the key's rows up to and including this one."""
    inside = (
        Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return with_carries(df, keys, block, values).select(
        *df.columns, *[(F.col(f"__c_{n}") + F.sum(f"__v_{n}").over(inside)).alias(n) for n in values]
    )


def running_sums_upto(
    df: DataFrame, keys: Sequence[str], block: Column, order: Column, values: dict[str, tuple[Column, int]]
) -> DataFrame:
    """Like ``running_sums`` along an integer ``order``, ties included: each value is summed up to ``order + offset``.

    Offset 0 takes in every row of the same order, -1 only strictly earlier ones.
    """
    d = with_carries(df, keys, block, {n: v for n, (v, _) in values.items()})
    w = Window.partitionBy(*keys, _BLOCK).orderBy(order)

    def upto(n: str, offset: int) -> Column:
        inside = F.sum(f"__v_{n}").over(w.rangeBetween(Window.unboundedPreceding, offset))
        return (F.col(f"__c_{n}") + F.coalesce(inside, F.lit(0))).alias(n)

    return d.select(*df.columns, *[upto(n, offset) for n, (_, offset) in values.items()])


def running_sums_and_last(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], sums: dict[str, Column], last: tuple[str, Column]
) -> DataFrame:
    """``running_sums``, and under the name in ``last`` the largest value so far of its column, NULLs aside."""
    name, value = last
    d = df.withColumn(_BLOCK, block).withColumns({f"__v_{n}": v for n, v in sums.items()} | {"__v": value})
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    per_block = d.groupBy(*keys, _BLOCK).agg(F.max("__v").alias("__m"), *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
    carries = per_block.select(
        *keys, _BLOCK, F.max("__m").over(before).alias("__c"),
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _null_safe_join(d, carries, [*keys, _BLOCK]).select(
        *df.columns, F.greatest("__c", F.max("__v").over(inside)).alias(name),
        *[(F.col(f"__c_{n}") + F.sum(f"__v_{n}").over(inside)).alias(n) for n in sums],
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, keys, block, order, {name: value})


def row_number(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: position of the row within its key, from 1."""
    return running_sum(df, keys, block, order, F.lit(1).cast("bigint"), name)


def previous(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], values: dict[str, Column]
) -> DataFrame:
    """Add one column per entry of ``values``: its value in the row just before this one within the key.

    ``order`` are column names whose combined value is unique within a key.
    A single plain order column keeps the carries in a hash aggregate.
    """
    d = df.withColumn(_BLOCK, block).withColumns({f"__v_{n}": v for n, v in values.items()})
    along = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    blocks = Window.partitionBy(*keys).orderBy(_BLOCK)
    last_of_block = (
        d.groupBy(*keys, _BLOCK)
        .agg(*[F.max_by(f"__v_{n}", along).alias(f"__l_{n}") for n in values])
        .select(*keys, _BLOCK, *[F.lag(f"__l_{n}").over(blocks).alias(f"__c_{n}") for n in values])
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    first = F.row_number().over(inside) == 1
    return _null_safe_join(d, last_of_block, [*keys, _BLOCK]).select(
        *df.columns,
        *[F.when(first, F.col(f"__c_{n}")).otherwise(F.lag(f"__v_{n}").over(inside)).alias(n) for n in values],
    )


def global_running_sum(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Running sum over the whole table in ``order``, without pulling it into one task.

    Rows are range-partitioned; the partition number is fixed by cutting the
    lineage there, so a lost executor cannot shift the borders. The only
    unpartitioned window sees one row per partition.
    """
    placed = cut_lineage(
        df.withColumn("__v", value)
        .repartitionByRange(*order)
        .withColumn("__p", F.spark_partition_id())
    )
    offsets = (
        placed.groupBy("__p")
        .agg(F.sum("__v").alias("__s"))
        .withColumn(
            "__carry",
            F.coalesce(
                F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("__s")
    )
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per partition: the broadcast side is bounded by the partition count.
    return (
        placed.join(F.broadcast(offsets), "__p")
        .withColumn(name, F.col("__carry") + F.sum("__v").over(inside))
        .drop("__p", "__v", "__carry")
    )


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Dense numbers 1..n in ``order``; ``order`` must be a total order to be repeatable."""
    return global_running_sum(df, order, F.lit(1).cast("bigint"), name)
