"""Spelling variant grouping by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced character makes one into
the other. Of two near words, the shorter (of equal ones, each in turn)
contributes two disjoint chunks, its first and its last half; the other
contributes its positional grams of that length. One edit leaves at least one of
the two chunks whole, at its place or shifted by one, so near words meet in a
join on (length, position, gram) within shift one. A gram at any other position
can meet no chunk, so those grams are not made.

A half that very many words share would bring all of them together. So each
chunk comes with one of the two pieces of the rest, in turn: the edit touches at
most one of them, so near words still meet, and words that meet agree in about
three quarters of their characters. What meets is verified by its edit distance.

A word's form is the near word that occurs most, if it occurs at least ``RATIO``
times as often. Counts grow along forms, so following them ends; a root is found
by doubling the steps, in rounds that grow with the logarithm of the longest way.

Words are counted where the texts lie, before the shuffle, so a word that makes
up a third of all text is one row per task. Null and empty texts have no words,
and equal rows count each. Runs of any length are words like others. Ties
between forms go to the smallest in code-point order. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import LOWER, UPPER, written
from tickloom.session import ship_by_value

LETTERS = r"[A-Za-zÀ-ÿ]"
#: One of ``SLIPS`` occurrences loses a letter; words have ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences at least.
SLIPS, LEAST_LENGTH, LEAST_COUNT, RATIO = 31, 7, 2, 10


def slipped(doc_id: Column, run: Column, slips: int = SLIPS) -> Column:
    """The run, without one of its letters where a checksum of the document's id and the run says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % slips == 0, without).otherwise(run)


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all documents that occur often enough."""
    # A maximal run that is too short gives no word, with or without a slip.
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = rows.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _meeting_keys(length: Column, shift: Column) -> Column:
    """Keys of ``word`` for a partner of ``length`` characters whose chunks lie in it, after an edit, ``shift`` further on.

    With shift 0 and the word's own length these are its chunks, each with a piece of the rest.
    """
    half = F.floor(length / 2).cast("int")
    rest = (length - half).cast("int")
    before, behind = F.floor(rest / 2).cast("int"), half + F.floor(rest / 2).cast("int")

    def head(n: Column) -> Column:
        return F.substring("word", F.lit(1), n)

    def tail(start: Column) -> Column:
        return F.substring(F.col("word"), start + shift + 1, F.char_length("word"))

    pieces = (head(behind), F.concat(head(half), tail(behind)), F.concat(head(before), tail(rest)), tail(before))
    return F.array(*[F.xxhash64(F.lit(kind), length, piece) for kind, piece in enumerate(pieces)])


def one_edit_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes ``a`` into ``b``, which is as long or one longer."""
    at = len(os.path.commonprefix([a, b]))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :] and a != b


def _verified(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([one_edit_apart(a, b) for a, b in zip(left, right)], dtype=bool)


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words at edit distance one."""
    length, none = F.char_length("word"), F.lit(0)
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_meeting_keys(length, none)).alias("key"))
    grams = words.select(
        F.col("word").alias("b"), F.col("n").alias("b_n"),
        F.explode(
            F.concat(
                _meeting_keys(length, none),
                F.when(length > least_length, _meeting_keys(length - 1, F.lit(1))).otherwise(F.array().cast("array<bigint>")),
            )
        ).alias("key"),
    )
    # The time of Spark's own edit distance grows with the square of a word's length; this one's does not.
    ship_by_value(__name__)
    verified = F.pandas_udf(_verified, "boolean")
    pairs = chunks.join(grams, "key").where(F.col("a") != F.col("b")).where(verified("a", "b"))
    longer = F.char_length("b") > F.char_length("a")
    there, back = (F.struct(F.col(w).alias("word"), F.col(o).alias("near"), F.col(f"{o}_n").alias("near_n")) for w, o in ("ab", "ba"))
    # Of two words of equal length each contributes chunks, so that pair comes both ways.
    both = pairs.select(F.explode(F.when(longer, F.array(there, back)).otherwise(F.array(there))).alias("p")).select("p.*")
    return both.distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    order = F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(order).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: where following forms ends."""
    links = written(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(onward.select("root"), "root", "left_semi").isEmpty():
            return links
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-links")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = written(counted_words(docs.select("doc_id", "text")), "spelling-words")
    formed = written(forms(words, near_pairs(words)), "spelling-forms")
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
