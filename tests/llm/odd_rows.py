"""A small table with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, shard int, slot int, fp bigint, h bigint, role string"
LETTERS = {"en": "the and of with ring stone", "fr": "le la de été forêt cœur", "de": "der und grün straße haus baum"}


def make_text(draw, lang, n):
    return " ".join(draw.choice(LETTERS[lang].split()) + draw.choice(["", "s", "en", "x"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    draw, rows = random.Random(5), []
    shared = "A line that many of these documents share, long enough to count.  "
    for i in range(120):
        lang = draw.choice(list(LETTERS))
        lines = [make_text(draw, lang, draw.randint(1, 30)) for _ in range(draw.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(draw.randint(0, len(lines)), shared if i % 8 else shared.upper() + "\t")
        rows.append((i, "\n".join(lines), lang, f"s{i % 7}" if i % 3 else "s0"))
    rows += [(200 + i, rows[3][1], "en", "s0") for i in range(40)]  # a group of copies
    rows += [(250 + i, rows[4][1] + f" {i}", "en", None) for i in range(9)]  # near copies
    rows += [(300, None, None, None), (301, "", "en", "empty"), (302, " \n\t ", "fr", "s1"), (303, "word", "en", "s1")]
    rows += [(304, "two words", "en", "s2"), (305, "12345 -- 67", None, "s2"), (306, shared, "en", "s3"), (307, "x" * 5000, "de", "s3")]
    rows += [(308, make_text(draw, "fr", 20_000), "fr", "s4"), (None, "no id here", "en", "s4"), (None, None, None, "s4")]
    rows += [rows[10], rows[10]]  # repeated rows
    rows += [(309, "日本語のテキスト 🙂 naïve\x00 <|endoftext|> don't  stop", "en", "s5"), (9_007_199_254_740_993, "big id", "en", "s5")]
    return [(i, t, lang, s, len(t or ""), 1, 2, 3, 4, 5, "x") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, KINDS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)
