"""SimHash near-dedup by vantage-point trees over Hamming distance.

Two fingerprints that differ in at most 3 bits differ in at most 1 bit of their
upper or of their lower 32 bits. So there are two trees, one per half, and each
looks for halves within distance 1. A level of a tree has a vantage point v and
a radius m (the mean distance from v): halves at distance m or less go left,
the others right. By the triangle inequality a half within 1 of one on the
right is at distance m at least, so halves at exactly m, the boundary, visit
the right shard too. A pair therefore meets in at least one leaf of one tree.
Leaves are compared exactly over all 64 bits. The number of levels follows the
number of distinct fingerprints, so that a leaf stays small; a leaf that is
crowded all the same is compared in pairs of slices, by as many tasks.

Equal fingerprints are folded before. A leaf gives, instead of all its pairs, a
star for each connected set in it. Components come from alternating star
contractions, written to the shared folder each round.

Null, empty or blank text has fingerprint zero and is linked like any other.
Repeated rows share a fingerprint. A null id is never a component's smallest
unless all ids are null. Texts of any length are read whole, slice by slice. A bit
set in exactly half the hashes is 0. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import id_back, id_text, small, written
from tickloom.session import ship_by_value

SHINGLE, SEED, LINK_BITS = 3, 42, 3
#: What two linked fingerprints differ by at most in one half.
HALF_BITS = LINK_BITS // 2
#: Fingerprints in a leaf, about; leaves beyond ``LEAF_MOST`` are compared in slices of that many.
LEAF, LEAF_MOST = 2_000, 16_384
_CHUNK, _COMPARE = 65_536, 1 << 22


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE) -> int:
    """The text's SimHash: a bit is set if more than half of the shingles' XXH64 have it."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends, n = ends.tolist(), max(1, len(words) - words_in_shingle + 1)
    last, digest = min(words_in_shingle, len(words)) - 1, xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        h = np.array([digest(joined[starts[i] : ends[i + last]], SEED) for i in range(k, min(n, k + _CHUNK))], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words_in_shingle: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks = np.array([fingerprint(t, words_in_shingle) for t in frame["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": marks.view(np.int64)})

    return run


def fingerprints(docs: DataFrame, words_in_shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed number."""
    ship_by_value(__name__)
    rows = docs.select(id_text(), "text")
    return rows.mapInPandas(_fingerprints(words_in_shingle), "doc_id string, fp bigint").select(id_back(), "fp")


def levels_for(n: int, leaf: int) -> int:
    """Levels that bring a leaf to ``leaf`` halves; about one half in seven also visits the other side."""
    return max(0, math.ceil(math.log(max(1.0, n / leaf)) / math.log(2 / 1.14)))


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fps.view(np.uint64)
    return bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)


def vantage_points(fps: DataFrame, levels: int, seed: int = SEED) -> list[list[tuple[int, int]]]:
    """Per tree and level: the seeded vantage point, and the mean distance of all halves from it, rounded down."""
    draw = np.random.default_rng(seed)
    points = draw.integers(0, 1 << 32, (2, levels)).tolist()
    if not levels:
        return [[], []]
    half = (F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    means = fps.agg(*[
        F.avg(F.bit_count(half[t].bitwiseXOR(F.lit(v)))).alias(f"m{t}_{k}") for t in (0, 1) for k, v in enumerate(points[t])
    ]).first()
    return [[(v, int(means[f"m{t}_{k}"] or 0)) for k, v in enumerate(points[t])] for t in (0, 1)]


def leaves_of(fps: np.ndarray, trees: list[list[tuple[int, int]]]) -> pd.DataFrame:
    """Every leaf that each fingerprint lies in or visits."""
    parts = []
    for t, (levels, half) in enumerate(zip(trees, _halves(fps), strict=True)):
        at, leaf = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for point, radius in levels:
            far = np.bitwise_count(half[at] ^ np.uint64(point)).astype(np.int64)
            visits = (far <= radius) & (far > radius - HALF_BITS)
            leaf = np.concatenate([leaf * 2 + (far > radius), leaf[visits] * 2 + 1])
            at = np.concatenate([at, at[visits]])
        parts.append(pd.DataFrame({"tree": np.int32(t), "leaf": leaf, "fp": fps[at]}))
    return pd.concat(parts, ignore_index=True)


def _placer(trees: list[list[tuple[int, int]]]):
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield leaves_of(frame["fp"].to_numpy(np.int64), trees)

    return place


def stars(fps: np.ndarray) -> pd.DataFrame:
    """Edges to a common member, for each set of fingerprints connected by links within ``fps``."""
    bits, label = fps.view(np.uint64), np.arange(len(fps))
    step = max(1, _COMPARE // max(1, len(fps)))
    for k in range(0, len(fps), step):
        near = np.bitwise_count(bits[k : k + step, None] ^ bits[None, :]) <= LINK_BITS
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            met = np.unique(label[near[i]])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    linked = label != np.arange(len(fps))
    return pd.DataFrame({"a": fps[linked], "b": fps[label[linked]]})


def _leaf_stars(frame: pd.DataFrame) -> pd.DataFrame:
    return stars(np.unique(frame["fp"].to_numpy(np.int64)))


def near_links(fps: DataFrame, leaf: int = LEAF, leaf_most: int = LEAF_MOST) -> DataFrame:
    """(a, b): edges that connect exactly the distinct fingerprints that chains of links connect."""
    ship_by_value(__name__)
    trees = vantage_points(fps, levels_for(fps.count(), leaf))
    placed = fps.select("fp").mapInPandas(_placer(trees), "tree int, leaf bigint, fp bigint")
    return sliced(placed, leaf_most).groupBy("tree", "leaf", "task").applyInPandas(_leaf_stars, "a bigint, b bigint")


def sliced(placed: DataFrame, leaf_most: int) -> DataFrame:
    """(tree, leaf, fp, task): each pair of a leaf meets in a task; one task does unless the leaf is beyond ``leaf_most``."""
    crowded = placed.groupBy("tree", "leaf").count().where(F.col("count") > leaf_most).select(
        "tree", "leaf", F.ceil(F.col("count") / leaf_most).cast("int").alias("slices")
    )
    # A fingerprint of slice i takes part in the tasks (i, j) and (j, i) for every j: each pair of slices meets.
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.least(j, F.col("own")) * F.col("slices") + F.greatest(j, F.col("own")))
    tasks = placed.join(small(crowded), ["tree", "leaf"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    return tasks.withColumn("own", own).select("tree", "leaf", "fp", F.explode(other).alias("task"))


def _settled(edges: DataFrame) -> bool:
    """Whether no node is both a root and a member, and no member has two roots."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("member"), F.lit(0).alias("root")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("member"), F.lit(1).alias("root")),
    )).alias("end")).select("end.*")
    seen = ends.groupBy("node").agg(F.sum("member").alias("member"), F.max("root").alias("root"))
    return seen.where("member > 1 OR member = 1 AND root = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: root is its component's smallest node.

    Large and small stars take turns until every edge leads to a root.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _settled(now):
        # Large star: whatever is larger than a node hangs on the smallest of the node and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and what is smaller hang on the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small_star = large.join(low, F.col("u") == F.col("n"))
        after = small_star.select("u", F.col("m").alias("v")).unionByName(
            small_star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        now = written(after, "edges")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(table: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``table`` (doc_id, fp) with component_id, by the edges that ``links`` finds between distinct fingerprints."""
    distinct = written(table.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = written(components(links(distinct)), "roots")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked, single = named.where("root IS NOT NULL"), named.where("root IS NULL")
    # A root may have most rows: its ids meet them by a broadcast if their measured size allows it.
    ids = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = linked.join(small(ids), "root").select("fp", "component_id").unionByName(
        single.select("fp", F.col("first_id").alias("component_id"))
    )
    return table.join(label, "fp").select("doc_id", "fp", "component_id")


def near_groups(docs: DataFrame, words_in_shingle: int = SHINGLE, leaf: int = LEAF, leaf_most: int = LEAF_MOST) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest id of all it is linked to)."""
    table = written(fingerprints(docs, words_in_shingle), "fingerprints")
    return grouped(table, lambda distinct: near_links(distinct, leaf, leaf_most)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
