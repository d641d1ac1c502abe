"""Token counts through a cache keyed by content digest and tokenizer digest.

A text's digest (null counts as empty) and the digest of the tokenizer's file
are joined to counts stored before. Only distinct texts that the cache lacks
are encoded; their counts are appended to it. A new tokenizer file has a new
digest, so old counts are never taken for it.

The cache is a Parquet table of (content, tokenizer, n_tokens) partitioned by
tokenizer. Spark commits an append as a whole; two jobs that append the same
text at once store one count twice, which reading folds.

The tokenizer is asked once for a stretch of text that a task still remembers, where its settings say that a text's
tokens are those of its stretches; else, and for texts with special strings, it is given whole texts.

Equal texts are encoded once, however many there are. An empty table appends
nothing. Repeated rows each get their count. Texts of any length are encoded whole,
a very long one by itself. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import whole_text
from tickloom.session import ship_by_value, work_dir

LIMIT = 512
CACHE = "content binary, n_tokens bigint, tokenizer string"
#: Characters given to the tokenizer at once: what bounds a worker's memory.
BATCH_CHARS = 1_000_000
#: Stretches, which together are the whole text: white space as Unicode has it, with what follows up to the next.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRETCH = rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"
#: Beyond so many bytes a task forgets its stretches before the next batch; one takes about this and its characters.
REMEMBERED_BYTES, _ENTRY_BYTES = 32_000_000, 100


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _encoder(path: str):
    """Function from a list of texts to their numbers of tokens."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(path)
    words.no_truncation()
    words.no_padding()

    def whole(texts):
        return [len(x) for x in words.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, "rb") as f:
        settings = json.load(f)
    return _by_stretch(whole, [x["content"] for x in settings["added_tokens"]]) if _parts_at_space(settings) else whole


def _parts_at_space(settings: dict) -> bool:
    """Whether a text's tokens are those of its stretches (see ``STRETCH``), one after the other.

    So it is for the split pattern of ``ByteLevel``: no match goes from other characters on to white space, the
    pattern never looks back, and it looks ahead from white space only. Nothing else may change or join what it splits.
    """
    split = settings["pre_tokenizer"] or {}
    return (
        settings["normalizer"] is None and settings["post_processor"] is None and settings["model"]["type"] == "BPE"
        and split.get("type") == "ByteLevel" and split.get("use_regex") is True and split.get("add_prefix_space") is False
        and settings["model"].get("dropout") is None
    )


def _by_stretch(whole, special: list[str]):
    """``whole``, a function from texts to numbers of tokens, asked only for stretches that are not remembered.

    Texts with a special string, which the tokenizer cuts out first, are given to it whole.
    """
    cut, known, held = re.compile(STRETCH).findall, {}, 0

    def count(texts):
        nonlocal held
        if held > REMEMBERED_BYTES:
            known.clear()
            held = 0
        uncut = [any(x and x in t for x in special) for t in texts]
        cuts = [[] if u else cut(t) for t, u in zip(texts, uncut, strict=True)]
        new = list(set().union(*cuts) - known.keys())
        held += sum(map(len, new)) + _ENTRY_BYTES * len(new)
        known.update(zip(new, whole(new), strict=True))
        others = iter(whole([t for t, u in zip(texts, uncut, strict=True) if u]))
        return [next(others) if u else sum(map(known.__getitem__, found)) for u, found in zip(uncut, cuts, strict=True)]

    return count


def _batches(texts: pa.Array) -> Iterator[list[str]]:
    batch, size = [], 0
    for value in texts:
        t = value.as_py()
        batch.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            n_tokens = [n for b in _batches(batch.column("text")) for n in encode(b)]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(n_tokens, pa.int64())], names=["content", "n_tokens"])

    return count


def read_cache(spark, path: str, version: str) -> DataFrame | None:
    """Stored counts of one tokenizer; None where nothing has been stored for it."""
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/tokenizer={version}")
    if not store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        return None
    rows = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. ``cache`` is a folder; without one, a new folder is taken."""
    ship_by_value(__name__)
    spark = docs.sparkSession
    cache, version = cache or work_dir(spark, "token-cache"), file_digest(tokenizer)
    content = F.unhex(F.sha2(whole_text(), 256))
    rows = docs.select("doc_id", whole_text().alias("text"), content.alias("content"))
    stored = read_cache(spark, cache, version)
    lacking = rows.select("content", "text")
    if stored is not None:
        lacking = lacking.join(stored.select("content"), "content", "left_anti").select("content", "text")
    misses = lacking.groupBy("content").agg(F.first("text").alias("text"))
    counted = misses.mapInArrow(_counter(tokenizer), "content binary, n_tokens bigint")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    stored = read_cache(spark, cache, version)
    if stored is None:
        stored = spark.createDataFrame([], "content binary, n_tokens bigint")
    known = stored.withColumnRenamed("content", "__content")
    return rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")).join(
        known, F.col("content") == F.col("__content")
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
