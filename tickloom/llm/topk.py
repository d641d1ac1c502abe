"""Exact top-k search by inner product, a block at a time.

Vectors are cut into blocks by ranges of their ids. A block's forward index
holds its ids and its vectors, and per dimension (term) the largest and the
smallest component. For a query, the sum over terms of the larger of q x max
and q x min bounds every score in the block. Per query, blocks are taken in the
order of that bound; scoring stops when the next bound falls below the k-th best
score. Equal bounds are still scored, as ties go to smaller ids.

Packs of queries meet shards of blocks: a task holds one pack and one shard,
both of bounded size. Each task gives its best k per query, and these are merged.

Vectors that are null or hold null or non-finite components take no part; a
shorter vector counts as padded with zeros. A candidate with the query's id is
the query itself. Repeated query rows are asked once; two different vectors under one
id in the queries share that id's list. Other columns are ignored. Empty tables give no rows.
Components are whole numbers once quantised; sums beyond 2^63 are not supported.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written
from tickloom.session import ship_by_value

K, QUERY_EVERY, SCALE = 20, 20, 64
#: Ids in a block's range; blocks in a shard; queries in a pack.
BLOCK_IDS, SHARD_BLOCKS, PACK_QUERIES = 256, 32, 1_024
_INDEX = "block bigint, ids binary, width int, cells binary, high binary, low binary"
_FOUND = "query_id bigint, vec_id bigint, score bigint"
_MOST_EXACT = 1 << 52


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the usable vectors with components floor(scale * x)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")).alias("v"),
    )


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _index_block(key, rows):
    rows = rows.sort_values("vec_id", kind="stable")
    cells = _matrix(rows["v"], max(map(len, rows["v"]), default=0))
    return pd.DataFrame([{
        "block": key[0], "ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "width": cells.shape[1],
        "cells": cells.tobytes(), "high": cells.max(axis=0).tobytes(), "low": cells.min(axis=0).tobytes(),
    }])


def block_index(vectors: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per block: the forward index and the term maxima and minima."""
    ship_by_value(__name__)
    blocks = vectors.withColumn("block", F.floor(F.col("vec_id") / block_ids).cast("bigint"))
    return blocks.groupBy("block").applyInPandas(_index_block, _INDEX)


def _wide(data: bytes, width: int, to: int) -> np.ndarray:
    cells = np.frombuffer(data, np.int64).reshape(-1, width) if width else np.zeros((1, 0), np.int64)
    return np.pad(cells, ((0, 0), (0, to - width)))


def best_in_blocks(query_ids: np.ndarray, queries: np.ndarray, blocks: list[dict], k: int) -> tuple[pd.DataFrame, int]:
    """The best ``k`` of the blocks per query, and how many (query, block) pairs were scored."""
    width = max([queries.shape[1], *(b["width"] for b in blocks)])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    high = np.concatenate([_wide(b["high"], b["width"], width) for b in blocks])
    low = np.concatenate([_wide(b["low"], b["width"], width) for b in blocks])
    reach = float(np.abs(queries).max(initial=0)) * float(max(np.abs(high).max(initial=0), np.abs(low).max(initial=0)))
    kind = np.float64 if reach * max(1, width) < _MOST_EXACT else np.int64  # floats up to 2^52 are exact, and faster
    q = queries.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bounds = up @ high.T.astype(kind) + down @ low.T.astype(kind)
    order = np.argsort(-bounds, axis=1, kind="stable")
    ids = [np.frombuffer(b["ids"], np.int64) for b in blocks]
    cells = [None] * len(blocks)
    kth = np.full(len(q), -np.inf)
    found_q, found_id, found_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    scored = 0
    for turn in range(len(blocks)):
        block = order[:, turn]
        live = bounds[np.arange(len(q)), block] >= kth
        if not live.any():
            break  # every later bound is lower still
        for b in np.unique(block[live]):
            who = np.flatnonzero(live & (block == b))
            if cells[b] is None:
                cells[b] = np.pad(
                    np.frombuffer(blocks[b]["cells"], np.int64).reshape(len(ids[b]), -1), ((0, 0), (0, width - blocks[b]["width"]))
                ).T.astype(kind)
            scores = q[who] @ cells[b]
            scored += len(who)
            good = (scores >= kth[who][:, None]) & (ids[b][None, :] != query_ids[who][:, None])
            at, col = np.nonzero(good)
            found_q = np.concatenate([found_q, who[at]])
            found_id = np.concatenate([found_id, ids[b][col]])
            found_s = np.concatenate([found_s, scores[at, col].astype(np.int64)])
        best = np.lexsort((found_id, -found_s, found_q))
        found_q, found_id, found_s = found_q[best], found_id[best], found_s[best]
        rank = np.arange(len(found_q)) - np.searchsorted(found_q, found_q)
        found_q, found_id, found_s, rank = (x[rank < k] for x in (found_q, found_id, found_s, rank))
        kth[found_q[rank == k - 1]] = found_s[rank == k - 1]
    return pd.DataFrame({"query_id": query_ids[found_q], "vec_id": found_id, "score": found_s}), scored


def _search(k: int):
    def run(_, packs, blocks):
        if not len(packs) or not len(blocks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        queries = _matrix(packs["v"], max(map(len, packs["v"])))
        return best_in_blocks(packs["vec_id"].to_numpy(np.int64), queries, blocks.to_dict("records"), k)[0]

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K,
    block_ids: int = BLOCK_IDS, shard_blocks: int = SHARD_BLOCKS, pack_queries: int = PACK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of ``vectors`` for each of ``queries``, both (vec_id, v)."""
    index = written(block_index(vectors, block_ids), "block-index")
    asked = written(queries.dropDuplicates(["vec_id", "v"]), "queries")
    shards = max(1, math.ceil(index.count() / shard_blocks))
    packs = max(1, math.ceil(asked.count() / pack_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.withColumn("pack", one("vec_id", packs)).withColumn("shard", every(shards))
    right = index.withColumn("shard", one("block", shards)).withColumn("pack", every(packs))
    ship_by_value(__name__)
    found = left.groupBy("pack", "shard").cogroup(right.groupBy("pack", "shard")).applyInPandas(_search(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
