"""Quality classifier: an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

An n-gram is ``ORDER`` bytes in one 64-bit number, so a count is an exact
integer join, in any script. Trusted documents are labelled quality 1 and
toxic 0; four fifths of them train, the rest sets the thresholds.

1. Each task counts the n-grams of its documents, and how many of them stand in
   training text. Sums by n-gram follow (combined before the shuffle).
2. Counts of lower orders are continuation counts; discounts come from counts of
   counts. Every n-gram of the table, seen in training or not, gets its log
   probability by joins with the counts of its order, its context's totals and
   its suffix's probability.
3. The probabilities are cut into shards of ``SHARD_ROWS`` at most. Each shard,
   being of proven size, is broadcast and joined to the documents' n-grams where
   they lie; sums per document add up over the shards. No text moves.
4. A document's entropy (nats per byte, drawn towards the trusted mean by
   ``PRIOR_BYTES`` bytes, so that short texts aren't judged by chance) is held
   against its language's limit: the ``QUANTILE`` of the trusted documents kept
   for that, to which those of all languages are added with the weight of
   ``POOLED`` documents. That weight is small beside a large language and decides
   for a small one, which no single document of its own sets. Perplexity is exp(entropy).

Null or empty text has no perplexity and is rejected. With nothing to train on
everything else is kept. A null language is a language of its own. Rows that
repeat a doc_id and text give one row. Byte zero in a text counts as padding. Texts
of any length are scored whole; an entropy equal to the limit is kept. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import DOCUMENT, id_back, id_text, release_memory, returning, small, whole_text, written
from tickloom.session import ship_by_value

ORDER, TRAIN_OF = 5, 5
QUANTILE, PRIOR_BYTES = 0.995, 100
#: So many documents that two of them lie beyond the quantile.
POOLED = 400
#: Entropies are binned at this many bins per nat for the quantiles.
BINS = 1000
SHARD_ROWS = 1_000_000
_PIECE_BYTES, _MERGE_ROWS = 1_000_000, 2_000_000


def trusted(labels: DataFrame) -> DataFrame:
    """doc_ids that every label of theirs calls good and not toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0").select(
        F.col("doc_id").alias("__trusted")
    )


def with_role(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, text, role): role is 'train', 'calibrate' or NULL."""
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % TRAIN_OF != 0
    role = F.when(F.col("__trusted").isNotNull(), F.when(train, F.lit("train")).otherwise(F.lit("calibrate")))
    joined = docs.select("doc_id", "lang", "text").join(small(trusted(labels)), F.col("doc_id") == F.col("__trusted"), "left")
    return joined.select(docs["doc_id"].cast("bigint").alias("doc_id"), "lang", "text", role.alias("role"))


def pieces(texts, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, number of the text) for runs of about ``_PIECE_BYTES`` bytes: one n-gram per byte, zeros before a text."""
    data, owner, size = [], [], 0

    def ready():
        grams = np.concatenate(data)
        return grams, np.repeat([o for o, _ in owner], [n for _, n in owner])

    for i, text in enumerate(texts):
        raw = np.frombuffer(b"\0" * (order - 1) + (text or "").encode(), np.uint8)
        for k in range(0, len(raw) - order + 1, _PIECE_BYTES):
            part = raw[k : k + _PIECE_BYTES + order - 1].astype(np.int64)
            n = len(part) - order + 1
            grams = np.zeros(n, np.int64)
            for j in range(order):
                grams = (grams << 8) | part[j : j + n]
            data.append(grams)
            owner.append((i, n))
            size += n
            if size >= _PIECE_BYTES:
                yield ready()
                data, owner, size = [], [], 0
    if size:
        yield ready()


def _merged(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate(parts), np.concatenate(counts)
    parts.clear()
    counts.clear()
    by = np.argsort(keys)
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _grams(order: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, counts, size = [], [], 0
        for frame in frames:
            for train, texts in ((t, frame["text"][(frame["role"] == "train") == t]) for t in (True, False)):
                for grams, _ in pieces(texts, order):
                    keys, n = np.unique(grams, return_counts=True)
                    parts.append(keys)
                    counts.append(n if train else np.zeros_like(n))
                    size += len(keys)
                    if size >= 2 * _MERGE_ROWS:
                        keys, n = _merged(parts, counts)
                        parts, counts, size = [keys], [n], len(keys)
                        if size >= _MERGE_ROWS:
                            yield pd.DataFrame({"g": keys, "c": n})
                            parts, counts, size = [], [], 0
        if parts:
            keys, n = _merged(parts, counts)
            yield pd.DataFrame({"g": keys, "c": n})

    return run


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): every n-gram of ``rows`` (text, role), and how often training text has it."""
    ship_by_value(__name__)
    return rows.select("text", "role").mapInPandas(returning(_grams(order)), "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def _suffix(order: int) -> Column:
    """The n-gram without its first byte."""
    return F.col("g").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams counted 1, 2, 3 and 4 times."""
    n = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    y = n["n1"] / (n["n1"] + 2 * n["n2"]) if n["n1"] else 0.0
    found = [k - (k + 1) * y * n[f"n{k + 1}"] / n[f"n{k}"] if n[f"n{k}"] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True)]


def log_probabilities(table: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, lp) for every n-gram of ``table`` (g, c), by interpolation of all orders.

    Each order's counts and probabilities are written, so that no plan holds more than one order: the driver
    keeps, and after each stage renews, what a plan says of itself.
    """
    counts = {order: table}
    for k in range(order - 1, 0, -1):
        # An n-gram that only stands outside training text has count zero.
        continued = counts[k + 1].groupBy(_suffix(k + 1).alias("g")).agg(F.count_if(F.col("c") > 0).alias("c"))
        counts[k] = written(continued, "continuations")
    below = None
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(counts[k])
        context = F.shiftright("g", 8)
        held = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        totals = counts[k].where("c > 0").groupBy(context.alias("h")).agg(
            F.sum("c").alias("total"),
            (F.count_if(F.col("c") == 1) * d1 + F.count_if(F.col("c") == 2) * d2 + F.count_if(F.col("c") > 2) * d3).alias("freed"),
        )
        rows = counts[k].withColumn("h", context).join(totals, "h", "left")
        if below is None:
            rows = rows.withColumn("rest", F.lit(1 / 256))
        else:
            rows = rows.withColumn("s", _suffix(k)).join(below.select(F.col("g").alias("s"), F.col("p").alias("rest")), "s")
        own = F.when(F.col("c") > 0, F.col("c") - held).otherwise(F.lit(0.0))
        p = (own + F.col("freed") * F.col("rest")) / F.col("total")
        below = rows.select("g", F.coalesce(p, F.col("rest")).alias("p"))
        if k < order:
            below = written(below, "probabilities")
    return below.select("g", F.log("p").cast("float").alias("lp"))


def _scorer(shared, order: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, lps = (np.frombuffer(x, kind) for x, kind in zip(shared.value, (np.int64, np.float32), strict=True))
        for frame in frames:
            total = np.zeros(len(frame))
            for grams, owner in pieces(frame["text"], order):
                by = np.argsort(grams)
                at = np.minimum(np.searchsorted(keys, grams[by]), len(keys) - 1)
                hit = keys[at] == grams[by]
                total += np.bincount(owner[by], weights=np.where(hit, lps[at], 0.0), minlength=len(frame))
            yield frame[["doc_id", "text_hash", "lang", "role", "n_bytes"]].assign(lp=total)

    return run


def _sorted_shard(part: DataFrame) -> tuple[bytes, bytes]:
    """The n-grams in order, and their log probabilities; at least one n-gram."""
    table = part.toArrow()
    g, lp = table["g"].to_numpy(), table["lp"].to_numpy()
    if not len(g):
        g, lp = np.array([-1]), np.array([0.0])
    by = np.argsort(g)
    return g[by].astype(np.int64).tobytes(), lp[by].astype(np.float32).tobytes()


def scores(rows: DataFrame, model: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, text_hash, lang, role, n_bytes, lp): the summed log probability of each text's bytes."""
    ship_by_value(__name__)
    spark = rows.sparkSession
    # Shards by hash hold equal parts but for chance; a tenth more than needed keeps each below its bound.
    n = max(1, -(-model.count() * 11 // (10 * shard_rows)))
    shard = F.pmod(F.xxhash64("g"), F.lit(n))
    texts = rows.select(
        id_text(), F.xxhash64("text").alias("text_hash"), "lang", "role", F.octet_length(whole_text()).cast("long").alias("n_bytes"), "text"
    )
    kinds = "doc_id string, text_hash bigint, lang string, role string, n_bytes bigint, lp double"
    parts, shards = [], []
    for k in range(n):
        shards.append(spark.sparkContext.broadcast(_sorted_shard(model.where(shard == k))))
        parts.append(texts.mapInPandas(returning(_scorer(shards[-1], order)), kinds).dropDuplicates(["doc_id", "text_hash", "lang"]))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    scored = written(every.groupBy(id_back(), "text_hash", "lang", "role", "n_bytes").agg(F.sum("lp").alias("lp")), "scores")
    # Nothing reads the model after this: its memory goes back on the executors and on the driver.
    for shared in shards:
        shared.destroy()
    release_memory()
    return scored


def limits(scored: DataFrame, quantile: float = QUANTILE, pooled: float = POOLED) -> DataFrame:
    """(any, of_lang, limit): the entropy beyond which a language's documents are rejected; ``any`` is for languages without trusted ones."""
    bins = scored.where("role = 'calibrate' AND entropy IS NOT NULL").groupBy(
        "lang", F.ceil(F.col("entropy") * BINS).alias("bin")
    ).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    # One row per language and bin; an entropy over bytes lies below log 256 / e^-..., so bins are some thousands at most.
    gathered = (F.sum("weight").alias("n"), F.sort_array(F.collect_list(F.struct("bin", "weight"))).alias("bins"))
    each = bins.groupBy("lang").agg(*gathered).select(F.lit(False).alias("any"), F.col("lang").alias("of_lang"), "n", "bins")
    every = written(bins.groupBy("bin").agg(F.sum("weight").alias("weight")).agg(*gathered).select("n", "bins"), "pooled-bins")
    alone = every.select(
        F.lit(True).alias("any"), F.lit(None).cast("string").alias("of_lang"), F.lit(0.0).alias("n"), F.slice("bins", 1, 0).alias("bins")
    )
    both = each.unionByName(alone).crossJoin(F.broadcast(every.select(F.col("n").alias("all_n"), F.col("bins").alias("all_bins"))))
    shared = F.transform("all_bins", lambda b: F.struct(b["bin"].alias("bin"), (b["weight"] * pooled / F.col("all_n")).alias("weight")))
    # The last term takes up what rounding leaves of sums of weights.
    enough = (F.col("n") + pooled) * quantile - 1e-6
    reach = F.aggregate(
        F.sort_array(F.concat("bins", shared)), F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("long").alias("bin")),
        lambda s, b: F.when(s["bin"].isNotNull(), s).otherwise(F.struct(
            (s["seen"] + b["weight"]).alias("seen"),
            F.when(s["seen"] + b["weight"] >= enough, b["bin"]).alias("bin"),
        )),
    )["bin"]
    return both.select("any", "of_lang", (reach / BINS).alias("limit"))


def classify(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, pooled: float = POOLED,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Per document: doc_id, text_hash, lang, n_bytes, perplexity, limit (a perplexity), kept."""
    rows = with_role(docs, labels)
    table = written(gram_counts(rows, order), "gram-counts")
    model = written(log_probabilities(table, order), "gram-probabilities")
    scored = scores(rows, model, order, shard_rows)
    mean = scored.where("role = 'calibrate' AND n_bytes > 0").agg((-F.sum("lp") / F.sum("n_bytes")).alias("m")).first()["m"]
    drawn = (-F.col("lp") + PRIOR_BYTES * (mean or 0.0)) / (F.col("n_bytes") + (PRIOR_BYTES if mean else 0))
    scored = scored.withColumn("entropy", F.when(F.col("n_bytes") > 0, drawn))
    found = small(limits(scored, quantile, pooled))
    own, every = found.where("NOT any").select("of_lang", F.col("limit").alias("own_limit")), found.where("any").select("limit").first()
    fallback = F.lit(every["limit"] if every else None).cast("double")
    limit = F.coalesce("own_limit", fallback)
    return scored.join(own, F.expr("lang <=> of_lang"), "left").select(
        "doc_id", "text_hash", "lang", "n_bytes", F.exp("entropy").alias("perplexity"), F.exp(limit).alias("limit"),
        ((F.col("n_bytes") > 0) & F.coalesce(F.col("entropy") <= limit, F.lit(True))).alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps."""
    rows = docs.select(*DOCUMENT)
    kept = classify(rows, labels).where("kept").select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("lang").alias("__lang")
    )
    return rows.join(
        small(kept), F.expr("doc_id <=> __doc AND xxhash64(text) = __hash AND lang <=> __lang"), "left_semi"
    )
