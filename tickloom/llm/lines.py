"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

A store keeps, per line key, which documents refer to it:

* ``refs``    exact references (key, h, doc_id), one per document and key;
* ``counts``  exact reference counts (key, h, n_docs, keep_doc);
* ``filters`` per shard of the hash h, one or more cuckoo filters of the keys in ``counts``.

``insert`` asks the filters first. Keys that they don't know are new for sure
and go into ``counts`` without meeting it; only the others are merged with it.
``delete`` takes documents out again, recounts the keys that they referred to,
and removes from the filters the marks of keys without references. Inserting
and then deleting a document leaves refs and counts as they were. The number of
shards follows the number of keys: a store that has outgrown its shards builds
its filters anew, over more of them.

A key is a line without surrounding ASCII white space, A-Z in lower case, and
is kept if it has ``min_chars`` code points. Every table is written to a new
place in the shared folder, so a lost executor costs a recomputation and no
state. Identity of keys is their SHA-256.

Null or empty text is one empty line. Rows that repeat a doc_id are one
document for the counts. A document with a null id neither counts nor loses
lines. Texts of any length are split whole. Of documents that tie for the largest id
all keep their lines. An empty table leaves an empty store. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import DOCUMENT, LOWER, SPACES, UPPER, small, whole_text, written
from tickloom.llm.cuckoo import Cuckoo
from tickloom.session import ship_by_value

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard, about, and of one filter; a shard takes as many filters as its keys need.
SHARD_KEYS, FILTER_KEYS = 32_768, 32_768

REF = "key binary, h bigint, doc_id bigint"
COUNT = "key binary, h bigint, n_docs bigint, keep_doc bigint"
FILTER = "shard int, part int, filter binary"
_STEP = "key binary, h bigint, n_docs bigint, keep_doc bigint, shard int, known boolean, part int, filter binary"


def text_lines() -> Column:
    return F.split(whole_text(), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def digest(key: Column) -> Column:
    return F.unhex(F.sha2(key, 256))


def line_refs(docs: DataFrame, min_chars: int) -> DataFrame:
    keys = F.array_distinct(F.filter(F.transform(text_lines(), line_key), lambda k: F.char_length(k) >= min_chars))
    each = docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(keys).alias("k"))
    return each.select(
        digest(F.col("k")).alias("key"), F.xxhash64("k").alias("h"), F.col("doc_id").cast("bigint").alias("doc_id")
    ).distinct()


def _filters_of(rows: pd.DataFrame) -> list[Cuckoo]:
    return [Cuckoo.loads(f) for f in rows.sort_values("part")["filter"]]


def _step_rows(shard: int, keys: pd.DataFrame, known: np.ndarray, filters: list[Cuckoo]) -> pd.DataFrame:
    kept = pd.DataFrame({"shard": shard, "part": range(len(filters)), "filter": [f.dumps() for f in filters]})
    # Nullable integers from the start: a 64-bit hash must not pass through a float.
    keys = keys.assign(known=known).astype({c: "Int64" for c in ("h", "n_docs", "keep_doc")})
    out = pd.concat([keys, kept], ignore_index=True)
    out = out.reindex(columns=[c.split()[0] for c in _STEP.split(", ")])
    for c in ("h", "n_docs", "keep_doc", "part"):
        out[c] = out[c].astype("Int64")
    return out


def _probe_and_add(key, keys, filters):
    """Which keys the shard's filters may know; the others are added to them."""
    own = _filters_of(filters)
    hashes = keys["h"].to_numpy(np.int64)
    known = np.zeros(len(hashes), bool)
    for f in own:
        known |= f.contains(hashes)
    todo = hashes[~known]
    while len(todo):
        if not own or own[-1].room <= 0:
            own.append(Cuckoo.sized(FILTER_KEYS))
        now, todo = todo[: own[-1].room], todo[own[-1].room :]
        refused = own[-1].add(now)
        if len(refused):
            own.append(Cuckoo.sized(FILTER_KEYS))
            todo = np.concatenate([refused, todo])
    return _step_rows(key[0], keys, known, own)


def _remove(key, keys, filters):
    own, todo = _filters_of(filters), keys["h"].to_numpy(np.int64)
    for f in own:
        todo = f.discard(todo)
    return _step_rows(key[0], keys.iloc[:0], np.zeros(0, bool), own)


class LineStore:
    """References, counts and filters of lines; each change gives a new store."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, shards: int = 0, tables=None):
        self.spark, self.min_chars, self.shards = spark, min_chars, shards
        self.refs, self.counts, self.filters = tables or (spark.createDataFrame([], kind) for kind in (REF, COUNT, FILTER))

    def _next(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int) -> LineStore:
        return LineStore(self.spark, self.min_chars, shards, (refs, counts, filters))

    def _step(self, keys: DataFrame, filters: DataFrame, shards: int, work) -> DataFrame:
        """Run ``work`` on each shard's keys and filters; its rows are keys (key set) and filters (key NULL)."""
        for module in (__name__, Cuckoo.__module__):
            ship_by_value(module)
        shard = F.pmod(F.shiftright("h", 16), F.lit(shards)).cast("int")
        grouped = keys.withColumn("shard", shard).groupBy("shard").cogroup(filters.groupBy("shard"))
        return written(grouped.applyInPandas(work, _STEP), "line-step")

    def _room_for(self, n: int) -> tuple[DataFrame, int]:
        """Filters and shards for ``n`` keys more: those there are, or new ones over four times the shards that ``n`` needs."""
        total = n + (self.counts.count() if self.shards else 0)
        if self.shards and total <= self.shards * SHARD_KEYS * 4:
            return self.filters, self.shards
        shards, none = max(1, math.ceil(total / SHARD_KEYS)), self.spark.createDataFrame([], FILTER)
        if not self.shards:
            return none, shards
        return self._step(self.counts, none, shards, _probe_and_add).where("key IS NULL").select("shard", "part", "filter"), shards

    def insert(self, docs: DataFrame) -> LineStore:
        """Add documents; references that the store has already are not counted again."""
        new = line_refs(docs, self.min_chars)
        if self.shards:
            new = new.join(self.refs.select("key", "doc_id"), ["key", "doc_id"], "left_anti").select("key", "h", "doc_id")
        new = written(new, "line-refs")
        touched = new.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_doc"))
        filters, shards = self._room_for(new.count())
        step = self._step(touched, filters, shards, _probe_and_add)
        columns = self.counts.columns
        found = step.where("key IS NOT NULL")
        filters = step.where("key IS NULL").select("shard", "part", "filter")
        if not self.shards:
            return self._next(new, found.select(*columns), filters, shards)
        # A filter may know a key by mistake; the exact table decides, as a key without a partner stays as it is.
        again = found.where("known").select(*columns)
        old = self.counts.join(again.select("key"), "key", "left_semi").select(*columns)
        merged = again.unionByName(old).groupBy("key", "h").agg(
            F.sum("n_docs").alias("n_docs"), F.max("keep_doc").alias("keep_doc")
        )
        rest = self.counts.join(again.select("key"), "key", "left_anti").select(*columns)
        counts = written(found.where("NOT known").select(*columns).unionByName(merged).unionByName(rest), "line-counts")
        return self._next(written(self.refs.unionByName(new), "line-refs"), counts, filters, shards)

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """Take documents out again: their references, and what only they referred to."""
        if not self.shards:
            return self
        ids = doc_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
        refs = written(self.refs.join(ids, "doc_id", "left_anti").select(*self.refs.columns), "line-refs")
        lost = written(self.refs.join(ids, "doc_id", "left_semi").select("key", "h").distinct(), "line-lost")
        recount = refs.join(lost.select("key"), "key", "left_semi").groupBy("key", "h").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_doc")
        )
        rest = self.counts.join(lost.select("key"), "key", "left_anti").select(*self.counts.columns)
        counts = written(rest.unionByName(recount), "line-counts")
        none = F.lit(None).cast("bigint")
        gone = lost.join(counts.select("key"), "key", "left_anti").select("key", "h", none.alias("n_docs"), none.alias("keep_doc"))
        filters = self._step(gone, self.filters, self.shards, _remove).select("shard", "part", "filter")
        return self._next(refs, counts, filters, self.shards)

    def dropped_keys(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, drops): the keys each document loses, being in ``min_docs`` documents and not kept by this one."""
        heavy = self.counts.where(F.col("n_docs") >= min_docs).select("key", "keep_doc")
        lost = self.refs.select("key", "doc_id").join(small(heavy), "key").where("doc_id < keep_doc")
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("drops"))

    def rewrite(self, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``; lines that stay keep their own text."""
        drops = self.dropped_keys(min_docs).withColumnRenamed("doc_id", "__doc")
        lost = lambda line: (F.char_length(line_key(line)) >= self.min_chars) & F.array_contains(
            F.col("drops"), digest(line_key(line)))
        kept = F.when(F.col("drops").isNull(), text_lines()).otherwise(F.filter(text_lines(), lambda x: ~lost(x)))
        joined = docs.join(drops, F.col("doc_id") == F.col("__doc"), "left")
        return joined.select(*[docs[c] for c in docs.columns], F.size(text_lines()).cast("long").alias("n_lines"), kept.alias("__kept")).select(
            *docs.columns, "n_lines", (F.col("n_lines") - F.size("__kept")).cast("long").alias("n_dropped"),
            F.array_join("__kept", "\n").alias("kept_text"),
        )


def line_digests(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    out = LineStore(docs.sparkSession).insert(rows).rewrite(rows)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def deduped_documents(docs: DataFrame) -> DataFrame:
    """Documents without the lines that they lose; one that loses all of them stays, with empty text."""
    rows = docs.select(*DOCUMENT)
    out = LineStore(docs.sparkSession).insert(rows).rewrite(rows)
    return out.withColumn("text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))).withColumn(
        "n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("text"))
    ).select(*DOCUMENT)
