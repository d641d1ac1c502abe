"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows lie in blocks (by a seeded hash of their id). Under a uniform shuffle the
number of rows that block b sends to shard s is multivariate hypergeometric.
That matrix is drawn once from the blocks' counts; its rows sum to the blocks'
sizes and its columns to the shards', whose sizes differ by one at most. Each
block then permutes its rows by a seeded hash and deals them out by its row of
the matrix; each shard permutes what it gets by a second hash. A shard's order
is found in cells, so a shard is never one task's work.

Only block counts (at most ``MOST_BLOCKS``) reach the driver. Null text has
size 1 and CRC 0. Rows with a null or repeated id are ordinary rows, but lie in
one block. Texts of any length are measured whole; rows that tie in every hash go by
size and CRC. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import small, whole_text, written

SHARDS, SEED = 8, 20_231
BLOCK_ROWS, MOST_BLOCKS = 16_384, 16_384


def hypergeometric(good: int, bad: int, draws: int, uniform: float) -> int:
    """Good ones among ``draws`` without return, by inverting the distribution at ``uniform``.

    The terms come from their ratios to a neighbour, over twelve deviations around the mean (beyond lie less than 1e-30).
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mean = draws * good / total
    spread = 12 * math.sqrt(mean * (bad / total) * (total - draws) / max(1, total - 1)) + 12
    k = np.arange(max(low, math.floor(mean - spread)), min(high, math.ceil(mean + spread)) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - draws + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(mass, uniform * mass[-1], side="right"), len(k) - 1)])


def communication_matrix(rows: Sequence[int], columns: Sequence[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums, as a uniform shuffle would give them."""
    draw, left, matrix = random.Random(seed), list(columns), []
    for n in rows:
        line, rest, todo = [], sum(left), n
        for s, have in enumerate(left):
            x = hypergeometric(have, rest - have, todo, draw.random()) if todo else 0
            line.append(x)
            left[s] -= x
            rest -= have
            todo -= x
        matrix.append(line)
    return matrix


def uniform_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (with a doc_id) plus shard and slot, the row's place in its shard counted from 0."""
    given = rows.columns
    total = rows.count()
    blocks = max(1, min(MOST_BLOCKS, math.ceil(total / block_rows)))
    mark = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(seed + salt)), F.lit(n)).cast("int")
    order = lambda salt: [F.xxhash64("doc_id", F.lit(seed + salt)), *[F.col(c) for c in given]]
    in_blocks = rows.withColumn("__block", mark(0, blocks))
    counts = {r["__block"]: r["count"] for r in in_blocks.groupBy("__block").count().collect()}
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    ends = json.dumps([np.cumsum(line)[:-1].tolist() for line in matrix])
    ends = F.from_json(F.lit(ends), "array<array<bigint>>")
    place = F.row_number().over(Window.partitionBy("__block").orderBy(*order(1)))
    dealt = (
        in_blocks.withColumn("__place", place)
        .withColumn("shard", F.size(F.filter(F.get(ends, F.col("__block")), lambda e: F.col("__place") > e)))
        .withColumn("__cell", mark(2, blocks)).drop("__block", "__place")
    )
    dealt = written(dealt, "dealt")
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "__cell").count().select(
        "shard", "__cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy(*order(3)))
    return dealt.withColumn("__in", inside).join(small(offsets), ["shard", "__cell"]).select(
        *given, "shard", (F.col("__offset") + F.col("__in") - 1).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document: doc_id, size (bytes plus 1), text_crc32, shard, slot. Counts of shards differ by one at most."""
    sized = docs.select(
        "doc_id", (F.octet_length(whole_text()) + 1).cast("long").alias("size"), F.crc32(whole_text()).alias("text_crc32")
    )
    return uniform_shards(written(sized, "sized"), shards, seed, block_rows)
