"""URL filter, spelling groups and vector codes against brute force, over odd rows and empty tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows
from odd_rows import edge, edge_rows, empty  # noqa: F401
from pyspark.sql import functions as F

from tickloom.llm import queries, spelling, urlfilter, vectorcodes

# 11: URL filter

URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/1?x=1", "https://www.example.com/en", "http://x.www.example.com/en/", "http://com/",
    "http://com", "HTTP://WWW.Example.NET/es/q#f", "ftp://net/fr/", "http://b.net/de/1", "http://notcom/x", "http://x.COM?/en/", "http://x.com#/",
    "no scheme", "", None, "://", "http://", "a://b://c/d", "http://cheap-pills.example.org/en/1", "http://news.example.org/en/1", "http://é.example.com/En/",
    "http://example.com/EN/1", "http://user@example.com:80/en/", "mailto:x", "http://news.example.org/en/1", "http://x.org/" + "ab/" * 70_000, "http://x\n.com/en/\n",
]


@pytest.fixture(scope="module")
def pages(spark):
    data = [(i, u, "<p>", "h", "p", "r", "v", 0.5) for i, u in enumerate(URLS)] + [(None, URLS[0], None, "h", "p", "r", "v", 0.5), (3, URLS[3], None, "h", "p", "r", "v", 0.5)]
    return spark.createDataFrame(data, "page_id bigint, url string, html string, host string, path string, rule string, verdict string, score double").repartition(3)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(urlfilter.LABELLED, "url string, verdict string")


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def plain_rule(host, path):
    fits = [r for r in urlfilter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def plain_buckets(host, path):
    """The hash of each gram, one gram at a time."""
    text, most = f"\x01{host}\x02{path}\x03", (1 << 64) - 1
    start, prime, other = len(host) + 1, 0x100000001B3, 0x9E3779B97F4A7C15
    for size in urlfilter.SIZES:
        for i in range(len(text) - size + 1):
            h = 0
            for c in text[i : i + size]:
                h = (h * prime + ord(c)) & most
            h = (h ^ (other if i >= start else 0) ^ size) * other & most
            h ^= h >> 29
            yield (h * prime & most) >> 64 - urlfilter.BUCKETS_LOG2


def test_urls_equal_brute_force(pages, labelled):
    model = urlfilter.train(urlfilter.labelled_rows(labelled))
    want = []
    for page, url in [*enumerate(URLS), (None, URLS[0]), (3, URLS[3])]:
        host, path = plain_parts(url)
        grams = list(plain_buckets(host, path))
        logit = model.bias + sum(model.weights[g] for g in grams) / math.sqrt(max(1, len(grams)))
        rule = plain_rule(host, path)
        want.append((page, host, path, rule and rule[0] + rule[1], rule[2] if rule else "block" if logit >= 0 else "allow"))
    out = urlfilter.judged(pages, labelled)
    assert rows(out, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert out.where("score < 0 or score > 1").isEmpty()
    verdicts = {r.page_id: r.verdict for r in out.collect()}
    assert verdicts[URLS.index("http://cheap-pills.example.org/en/1")] == "block" and verdicts[19] == "allow"


def test_url_windows_do_not_change_scores(monkeypatch):
    """A URL in many windows has the grams of one window."""
    hosts, paths = ["a.org", "", "x" * 50, "b.net"], ["/" + "abc" * 40, "", "/en/", "/é🙂/"]
    whole = [Counter(zip(*map(list, w))) for w in urlfilter._gram_windows(hosts, paths)]
    monkeypatch.setattr(urlfilter, "WINDOW", 7)
    cut = [Counter(zip(*map(list, w))) for w in urlfilter._gram_windows(hosts, paths)]
    assert sum(whole, Counter()) == sum(cut, Counter()) == Counter((i, b) for i in range(4) for b in plain_buckets(hosts[i], paths[i]))


def test_url_model_leaves_out_hosts_it_never_saw(labelled):
    """Each fifth labelled host, held out, is judged by a model of the others."""
    table = urlfilter.labelled_rows(labelled)
    names = sorted({h.rsplit(".", 2)[-2] for h, _, _ in table})
    right = []
    for fold in range(5):
        held = set(names[fold::5])
        model = urlfilter.train([r for r in table if r[0].rsplit(".", 2)[-2] not in held])
        tests = [r for r in table if r[0].rsplit(".", 2)[-2] in held]
        scores = model.scores([r[0] for r in tests], [r[1] for r in tests])
        right += [((s >= 0.5) == (r[2] == "block"), r[2]) for s, r in zip(scores, tests)]
    allowed = [ok for ok, v in right if v == "allow"]
    assert sum(allowed) / len(allowed) >= 0.85
    assert sum(ok for ok, _ in right) / len(right) > 0.7


def test_url_model_on_pages_it_never_saw(spark, labelled):
    """Advertising and spam hosts are blocked but for a few URLs, and all others stay."""
    out = urlfilter.judged(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), labelled, rules=[])
    bad = F.col("host").rlike(r"spam|pills|casino|bets|ads-|adult")
    assert out.where(~bad & (F.col("verdict") == "block")).count() == 0
    assert out.where(bad & (F.col("verdict") == "allow")).count() < 0.1 * out.where(bad).count()


def test_urls_without_model_or_rows(spark, pages, labelled):
    none = spark.createDataFrame([("http://x.test/", "allow"), (None, None), ("http://y.test/", "other")], "url string, verdict string")
    out = urlfilter.judged(pages, none, rules=[])
    assert out.where("verdict <> 'allow' or rule is not null").isEmpty() and out.count() == len(URLS) + 2
    assert urlfilter.judged(pages.limit(0), labelled).count() == 0


# 12: spelling

def plain_words(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[i + 1 :] == long[i + 1 :] if len(a) == len(b) else short[i:] == long[i + 1 :]


def plain_groups(count):
    form = {}
    near = {w: [v for v in count if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in count}
    for w, ns in near.items():
        best = min(ns, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out, key=repr)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_of_odd_rows(edge, edge_rows):
    got = rows(spelling.spelling_groups(edge), *COLUMNS)
    assert got == plain_groups(plain_words([(r[0], r[1]) for r in edge_rows]))
    assert any(r[4] for r in got)


def test_spelling_of_many_variants(spark):
    """A word with every kind of one-letter slip, chains of forms, halves that many words share, a very long run."""
    base, letters = "grünstrasse", "aenrüß"
    docs = [(1, f"{base} " * 40_000)]
    variants = {base[:i] + c + base[i:] for i in range(12) for c in letters} | {base[:i] + base[i + 1 :] for i in range(11)}
    variants |= {base[:i] + c + base[i + 1 :] for i in range(11) for c in letters}
    docs += [(2 + i, f"{v} " * (2 + i % 9)) for i, v in enumerate(sorted(variants - {base}))]
    docs += [(500, "grünstrassen " * 400), (501, "grünstrassens " * 40), (502, "grünstrassenss " * 3), (503, "aaaaaaa aaaaaaaa " * 30 + "aaaaaaaaa " * 2)]
    docs += [(600 + i, f"gemeinsam{a}{b} " * 2) for i, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "klmnopqrst")]
    docs += [(800, "z" * 300_000 + " " + "z" * 300_001), (801, "z" * 300_000 + " " + "z" * 300_001 + " " + "z" * 299_999)]
    docs += [(900, "aé×aéaéa aéaéaéa aeaéaéa " * 3), (901, None), (902, ""), (None, "nameless nameless")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS n", "'x' AS word", "'y' AS key").repartition(4)
    got = rows(spelling.spelling_groups(frame), *COLUMNS)
    want = plain_groups(plain_words(docs))
    assert got == want
    way = {r[0]: r for r in got}
    assert way["grünstrassenss"][1] == "grünstrassens" and way["grünstrassenss"][2] == base


def test_spelling_of_no_rows(empty):
    assert spelling.spelling_groups(empty).count() == 0


# 13: vector codes

def plain_codes(table):
    """The rounds one vector at a time, in Python integers."""
    kept = []
    for vec_id, v, label in table:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, label, [max(-(1 << 25), min(1 << 25, math.floor(4096 * x))) for x in v]))
    width = max(1, -(-max((len(v) for _, _, v in kept), default=0) // 8))
    kept = [(i, lab, v + [0] * (8 * width - len(v))) for i, lab, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:16]
    parts = lambda v: [v[p * width : (p + 1) * width] for p in range(8)]
    books = [[parts(v)[p] for _, _, v in first] for p in range(8)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            taken = defaultdict(list)
            for _, _, v in kept:
                taken[best(p, parts(v)[p])[1]].append(parts(v)[p])
            books[p] = [[sum(c) // len(taken[e]) for c in zip(*taken[e])] if e in taken else c for e, c in enumerate(books[p])]
    coded = []
    for vec_id, label, v in kept:
        found = [best(p, x) for p, x in enumerate(parts(v))]
        coded.append((vec_id, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total = Counter()
    for _, _, error, label in coded:
        total[label] += error
    return sorted(((i, c, e, total[lab]) for i, c, e, lab in coded), key=repr), np.array(books)


CODED = "vec_id bigint, embedding array<float>, label int, code string, error bigint, v string, x int"


def with_clashes(spark, table):
    return spark.createDataFrame([(i, v, lab, "c", 1, "v", 2) for i, v, lab in table], CODED).repartition(3)


def test_codes_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    table = [(int(i), [float(np.float32(x)) for x in draw.normal(0, 0.2, 16)], int(i % 3) if i % 7 else None) for i in range(300)]
    table += [(5, table[9][1], 1), (9, table[9][1], 9), (None, [0.25] * 16, None), (400, None, 1), (401, [float("nan")] * 16, 1), (402, [None] + [0.0] * 15, 2)]
    table += [(403, [float("-inf")] * 16, 1), (404, [0.5] * 13, 4), (405, [], 4), (406, [1e30] * 8 + [-1e30] * 8, 5), (-1, [0.0] * 16, 0), (-2, [0.0] * 16, 0)]
    out = vectorcodes.compressed(with_clashes(spark, table))
    want, books = plain_codes(table)
    assert rows(out, "vec_id", "code", "error", "label_error") == want
    assert {r[0] for r in out.select("codebooks_sha256").collect()} == {vectorcodes.books_digest(books)}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_codes_of_few_vectors(spark, n):
    table = [(i, [float(i * x) for x in range(8)], None) for i in range(n)] + [(90, None, None)]
    out = vectorcodes.compressed(with_clashes(spark, table))
    assert rows(out, "vec_id", "code", "error", "label_error") == plain_codes(table)[0]


@pytest.mark.parametrize("bits", [0, 3, 9, 14])
def test_cells_give_the_nearest_entry(bits):
    """Memo or not, wide cells or narrow, ties included; and the memo spares evaluations."""
    draw = np.random.default_rng(bits)
    points, book = draw.integers(-2000, 2000, (3000, 4)), draw.integers(-2000, 2000, (16, 4))
    book[7], points[:200] = book[2], points[0]
    points[200:220] = (book[3] + book[4]) // 2
    distance = ((points[:, None] - book[None]) ** 2).sum(2)
    memo = {}
    for _ in range(2):
        index, best = vectorcodes.nearest(points, book, memo, bits)
        assert (index == distance.argmin(1)).all() and (best == distance.min(1)).all()
    assert len(memo) == len({tuple(p) for p in (points >> bits).tolist()})
    if bits <= 9:
        assert np.mean([m.bit_count() for m in memo.values()]) < 8


def test_registered_queries_read_whole_tables(spark, sf_dir):
    assert {n for n in queries.QUERIES if n.startswith(("op11", "op12", "op13"))} == {"op11_url_filter", "op12_spelling", "op13_vector_codes"}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = queries.QUERIES["op11_url_filter"](spark, sf_dir)
    want = []
    model = urlfilter.train(urlfilter.labelled_rows(spark.createDataFrame(urlfilter.LABELLED, "url string, verdict string")))
    for r in pages.select("page_id", "url").collect():
        host, path = plain_parts(r.url)
        rule = plain_rule(host, path)
        grams = list(plain_buckets(host, path))
        says = "block" if model.bias + sum(model.weights[g] for g in grams) / math.sqrt(max(1, len(grams))) >= 0 else "allow"
        want.append((r.page_id, host, path, rule and rule[0] + rule[1], rule[2] if rule else says))
    assert rows(out, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    bad = out.where(F.col("host").rlike("spam|pills|casino|bets|ads-|adult") & F.col("rule").isNull())
    assert bad.where("verdict = 'allow'").isEmpty()
