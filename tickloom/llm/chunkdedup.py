"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is read as pieces (a run of up to 255 other characters with the space or
line feed that ends it, or 256 characters without one). A chunk ends after each
piece whose hash is divisible by ``1 / CUT_EVERY``, so an insertion moves only
the cuts beside it. A recipe is the list of a text's chunk hashes, in order.

Hashes become identifiers by verification over all chunks of the table: the
distinct chunks are gathered once (combined before the shuffle), and a hash
that two different chunks share is put on a list. Chunks with such a hash stand
in the recipe as themselves. Equal recipes are then equal texts, with no
assumption about the hash. Only distinct chunks and short recipes move; no text
moves as a whole.

Null text counts as empty; all empty texts form one group. Repeated rows are in
one group and share their fate. Where all ids of a group are null, so is
``keep_id``, and its rows are kept. Rows that share the largest id of a group all
stay. Texts of any length are cut whole. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bound_once, whole_text, written

PIECE = r"[^ \n]{0,255}+[ \n]|[^ \n]{1,256}"
CUT_EVERY = 64
#: More shared hashes than this mean that the hash is unfit (64 good bits share about 30 in 10^12 chunks).
MOST_SHARED = 100_000


def _hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunks(text: Column, cut_every: int = CUT_EVERY) -> Column:
    """The text's chunks in order; joined they are the text."""

    def cut(pieces: Column) -> Column:
        last = F.size(pieces)
        marks = F.filter(
            F.transform(pieces, lambda p, i: F.when(
                (F.pmod(F.xxhash64(p), F.lit(cut_every)) == 0) | (i + 1 == last), i + 1).otherwise(0)),
            lambda x: x > 0,
        )

        def build(ends: Column) -> Column:
            def one(end: Column, i: Column) -> Column:
                start = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
                return F.array_join(F.slice(pieces, start + 1, end - start), "")

            return F.transform(ends, one)

        return bound_once(marks, build)

    return bound_once(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), cut)


def shared_hashes(docs: DataFrame, hashed: Callable[[Column], Column] = _hash, cut_every: int = CUT_EVERY) -> list[int]:
    """Hashes that different chunks of the table share: nearly always none."""
    each = docs.select(F.explode(chunks(whole_text(), cut_every)).alias("chunk"))
    distinct = each.select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    found = [r["h"] for r in shared.limit(MOST_SHARED + 1).collect()]
    if len(found) > MOST_SHARED:
        raise ValueError(f"more than {MOST_SHARED} chunk hashes are shared by different chunks: use a better hash")
    return sorted(found)


def recipes(docs: DataFrame, hashed: Callable[[Column], Column] = _hash, cut_every: int = CUT_EVERY) -> DataFrame:
    """(doc_id, text_sha256, ids, spelled): verified identifiers, and the chunks that need their own text as one."""
    shared = shared_hashes(docs, hashed, cut_every)

    def spelled(parts: Column) -> Column:
        if not shared:
            return F.array().cast("array<string>")
        return F.filter(parts, lambda c: F.array_contains(F.lit(shared), hashed(c)))

    return docs.select(
        "doc_id", F.sha2(whole_text(), 256).alias("text_sha256"),
        bound_once(
            chunks(whole_text(), cut_every),
            lambda c: F.struct(F.transform(c, hashed).alias("ids"), spelled(c).alias("spelled")),
        ).alias("r"),
    ).select("doc_id", "text_sha256", "r.ids", "r.spelled")


def exact_groups(
    docs: DataFrame, hashed: Callable[[Column], Column] = _hash, cut_every: int = CUT_EVERY
) -> DataFrame:
    """Per document: doc_id, keep_id (largest id of its group), group_size, kept, text_sha256."""
    table = written(recipes(docs, hashed, cut_every), "recipes")
    groups = table.groupBy("ids", "spelled").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return table.join(groups, ["ids", "spelled"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
