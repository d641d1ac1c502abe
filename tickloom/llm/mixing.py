"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents stand in a seeded order and form one stream of words,
cut into blocks of ``block_words`` (the last may be shorter). The mix has a
number of blocks, spread evenly over shards. Blocks go to sources by highest
quotients target / (2k + 1). As that rule is monotone in the number of blocks,
a source's quota in a shard is the difference of its quotas for the blocks up
to and before the shard. A source serves its quotas from the front of its
seeded stream, and from the front again once the stream has been used up.

Sources are a catalogue: their table (not the documents) is ordered in one
task. Documents meet it only through a join; their own order is found per
(source, slice of the seeded order), so a source with most rows is split.

Null text has size 0; a null source is a source of its own, the last one. Empty
tables give no rows. Repeated rows are documents of their own. Texts of any length
are counted whole. Sources of equal quotients go by code point, documents of equal
seeded order by id and size. Columns other than the named ones are left out unless
asked for, and may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import DOCUMENT, SPACE, WORD, small, whole_text
from tickloom.operators.blocked import running_sums

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_WORDS, SHARDS, SEED = 16, 8, "mix-1"
#: Rows of one source in a slice of the seeded order, about.
SLICE_ROWS = 4096


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD + "+")).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, pos, source_size, target): weighted shares of ``SHARE`` times all words, none above ``MOST`` times its source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    catalogue = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("pos", F.row_number().over(catalogue) - 1).withColumn(
        "w", F.element_at(F.lit(list(WEIGHTS)), (F.col("pos") % len(WEIGHTS) + 1).cast("int")).cast("double")
    ).withColumn("cap", F.col("source_size").cast("double") * MOST)
    # Sources fill up in the order of cap / weight; the first that doesn't gives the level of the rest.
    fill = Window.orderBy(F.col("cap") / F.col("w"), "pos")
    everything = Window.partitionBy()
    filled = ranked.withColumns({
        "want": F.sum(F.col("source_size").cast("double")).over(everything) * SHARE,
        "before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "w_from": F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    filled = filled.withColumn("full", F.col("cap") * F.col("w_from") <= F.col("w") * (F.col("want") - F.col("before")))
    level = F.min(F.when(~F.col("full"), F.struct("before", "w_from"))).over(everything)
    open_target = F.col("w") * (F.col("want") - F.col("level.before")) / F.col("level.w_from")
    return filled.withColumn("level", level).select(
        "source", "pos", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(open_target).alias("target")
    )


def block_quotas(targets: DataFrame, block_words: int, shards: int) -> DataFrame:
    """(source, quotas): per shard, how many blocks the source has got up to and with it.

    Shares give every source a number of blocks that it is sure of; only the
    quotients next to that number, at most about half as many as there are
    sources, compete for the rest.
    """
    everything = Window.partitionBy()
    houses = (
        targets.where("target > 0")
        .withColumns({"all_target": F.sum("target").over(everything), "n_sources": F.count(F.lit(1)).over(everything)})
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("house", F.floor(F.round(F.col("all_target") / block_words) * (F.col("shard") + 1) / shards))
        .withColumn("part", F.col("target") / F.col("all_target"))
        .withColumn("near", F.ceil(F.col("part") * F.col("n_sources") / 2) + 2)
        .withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("house") * F.col("part") + 0.5) - F.col("near")))
        .withColumn("left", F.col("house") - F.sum("sure").over(Window.partitionBy("shard")))
    )
    rivals = houses.withColumn("k", F.explode(F.sequence(F.col("sure"), F.col("sure") + 2 * F.col("near"))))
    best = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "pos", "k")
    won = rivals.withColumn("won", F.row_number().over(best) <= F.col("left"))
    quota = won.groupBy("source", "shard").agg((F.max("sure") + F.count_if("won")).alias("quota"))
    return quota.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("q")).select(
        "source", F.transform("q", lambda x: x["quota"]).alias("quotas")
    )


def mix_plan(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: str = SEED, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per document: size, source_size, target, the offset ``first`` of its words in its source's stream, and ``ends``.

    ``ends`` holds, per shard, the word of the twice repeated stream at which the source's part of that shard ends.
    ``docs`` needs doc_id, source and size; the columns of ``carry`` go along.
    """
    rows = docs.select("doc_id", "source", "size", *carry)
    n = rows.select("doc_id").count()
    digits = max(1, min(8, math.ceil(math.log(max(n, 1) / SLICE_ROWS + 1, 16))))
    targets = source_targets(rows.select("source", "size"))
    quotas = block_quotas(targets, block_words, shards)
    t, q = targets.alias("t"), quotas.alias("q")
    plan = t.join(q, F.expr("t.source <=> q.source"), "left").select("t.*", "q.quotas")
    blocks = F.ceil(F.col("source_size") / block_words)
    ends = F.transform(
        F.coalesce("quotas", F.lit([0] * shards)),
        lambda c: F.when(c >= MOST * blocks, F.col("source_size") * MOST).otherwise(
            F.floor(c / blocks) * F.col("source_size") + c % blocks * block_words
        ).cast("long"),
    )
    plan = plan.select(F.col("source").alias("of"), "source_size", "target", ends.alias("ends"))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = running_sums(
        rows.withColumn("order", order), ["source"], F.substring("order", 1, digits),
        [F.col("order"), F.col("doc_id"), F.col("size")], {"upto": F.col("size")},
    )
    return placed.join(small(plan), F.expr("source <=> of")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("upto") - F.col("size")).alias("first"), "ends", *carry
    )


def _overlap(lo: Column, hi: Column, a: Column, b: Column) -> Column:
    return F.greatest(F.least(hi, b) - F.greatest(lo, a), F.lit(0)).cast("long")


def taken_words() -> Column:
    """How many words of a planned document the mix takes, repeats counted."""
    whole = F.element_at("ends", -1)
    start = F.col("first")
    return sum(
        (_overlap(F.lit(0), whole, start + p * F.col("source_size"), start + p * F.col("source_size") + F.col("size"))
         for p in range(1, MOST)),
        _overlap(F.lit(0), whole, start, start + F.col("size")),
    )


def mix_spans(plan: DataFrame) -> DataFrame:
    """One row per document, pass and shard that takes words of it: ``from_word`` (from 0) and ``n_words``."""
    carried = [c for c in plan.columns if c not in ("first", "ends", "source_size", "target")]
    passes = F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))
    spans = plan.select("*", passes.alias("round")).select("*", F.posexplode("ends").alias("shard", "end")).withColumns({
        "at": F.col("first") + F.col("round") * F.col("source_size"),
        "begin": F.when(F.col("shard") == 0, F.lit(0)).otherwise(F.element_at("ends", F.greatest("shard", F.lit(1)))),
    })
    n = _overlap(F.col("begin"), F.col("end"), F.col("at"), F.col("at") + F.col("size"))
    return spans.select(
        *carried, "round", "shard", F.greatest(F.col("begin") - F.col("at"), F.lit(0)).alias("from_word"), n.alias("n_words")
    ).where("n_words > 0")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of documents: a row per document and pass with the words taken in it.

    A document taken whole keeps its text; one that the end of its source's quota cuts keeps the words before the cut.
    Documents without words take no part.
    """
    columns = [c for c in DOCUMENT if c != "source"]
    rows = docs.select(*DOCUMENT).withColumn("size", word_count())
    plan = mix_plan(rows, block_words, shards, seed, carry=tuple(c for c in columns if c != "doc_id"))
    pieces = F.regexp_extract_all("text", F.lit(f"{SPACE}*{WORD}+"), F.lit(0))
    start = F.col("first")
    rounds = F.array(*[
        _overlap(F.lit(0), F.element_at("ends", -1), start + p * F.col("source_size"),
                 start + p * F.col("source_size") + F.col("size")) for p in range(MOST)
    ])
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("n").cast("int")), "")
    return (
        plan.withColumn("n", F.explode(rounds)).where("n > 0")
        .withColumn("text", F.when(F.col("n") == F.col("size"), F.col("text")).otherwise(cut))
        .withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)
    )
