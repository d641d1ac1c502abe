"""Each operator against brute force, over a table of odd rows and over an empty one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.core.broadcast import Broadcast
import tiktoken
import xxhash
from conftest import rows
from odd_rows import edge, edge_rows, empty  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import bpe, chunkdedup, common, kneserney, langid, lines, mixing, sharding, similar, simhash, tokencounts, topk
from tickloom.llm.cuckoo import Cuckoo

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    vectors = topk.quantised(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    for out in (
        mixing.mix_plan(empty), mixing.mixed_documents(empty), simhash.near_groups(empty), similar.deduped_documents(empty),
        chunkdedup.exact_groups(empty), kneserney.classify(empty, labels), kneserney.kept_documents(empty, labels),
        topk.top_k(vectors, vectors), tokencounts.token_counts(empty, P.path("byte_bpe_50k.json")), langid.identify(empty),
        bpe.round_trip(empty, RANKS, P.PATTERN), sharding.shard_documents(empty), lines.line_digests(empty), lines.deduped_documents(empty),
    ):
        assert out.count() == 0


# 1: mixing

def test_mix_meets_targets(edge, edge_rows):
    sized = edge.withColumn("size", mixing.word_count())
    got = mixing.mix_plan(sized, block_words=4).withColumn("taken", mixing.taken_words()).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in edge_rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    size = {s: sum(r.size for r in rs) for s, rs in by.items()}
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    # Shares are dealt again until none is above twice its source.
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        open_weight = sum(weight[s] for s in size if s not in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / open_weight for s in size}
        over = {s for s in size if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s, rs in by.items():
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in rs)
        assert abs(sum(r.taken for r in rs) - target[s]) <= 8


def test_quotas_go_by_highest_quotients(spark):
    sizes = [("a", 500), ("b", 333), ("c", 90), ("d", 1), ("e", 0), ("f", 77)]
    t = spark.createDataFrame([(s, i, n, float(n)) for i, (s, n) in enumerate(sizes)], "source string, pos int, source_size long, target double")
    got = {r.source: r.quotas for r in mixing.block_quotas(t, 3, 5).collect()}
    house = round(sum(n for _, n in sizes) / 3)
    best = sorted((-(n / (2 * k + 1)), i, k) for i, (_, n) in enumerate(sizes) for k in range(house + 1) if n)
    for shard in range(5):
        won = Counter(sizes[i][0] for _, i, _ in best[: house * (shard + 1) // 5])
        assert {s: q[shard] for s, q in got.items() if q[shard]} == dict(won)


def test_mix_spans_and_documents_hold_the_taken_words(edge):
    plan = mixing.mix_plan(edge.withColumn("size", mixing.word_count()), block_words=4)
    taken = {}
    for r in plan.withColumn("taken", mixing.taken_words()).where("doc_id <> 10").collect():
        taken[r.doc_id] = r.taken
    spans = Counter()
    for r in mixing.mix_spans(plan).where("doc_id <> 10").collect():
        assert r.from_word >= 0 and r.n_words > 0
        spans[r.doc_id] += r.n_words
    assert dict(spans) == {d: n for d, n in taken.items() if n}
    mixed = Counter()
    for r in mixing.mixed_documents(edge, block_words=4).where("doc_id <> 10").collect():
        mixed[r.doc_id] += len(words(r.text))
    assert dict(mixed) == {d: n for d, n in taken.items() if n}
    assert mixing.mixed_documents(edge).columns == ["doc_id", "text", "lang", "source", "n_chars"]


# 2: SimHash

def plain_fingerprint(text, k=3):
    w = "".join(c.lower() if c in mixing_upper else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


mixing_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_components(fps):
    """fps: distinct fingerprints; the set that each belongs to."""
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[top(a)] = top(b)
    return {f: top(f) for f in fps}


def test_near_groups_equal_brute_force(edge, edge_rows):
    want, first = [(r[0], plain_fingerprint(r[1])) for r in edge_rows], {}
    root = plain_components({f for _, f in want})
    for d, f in want:
        if d is not None:
            first[root[f]] = min(d, first.get(root[f], d))
    got = rows(simhash.near_groups(edge, leaf=8, leaf_most=5), "doc_id", "fingerprint", "component_id")
    assert got == sorted(((d, f"{f:016x}", first.get(root[f])) for d, f in want), key=repr)


@pytest.mark.parametrize("leaf, most", [(30, 1000), (30, 20), (4, 7), (10_000, 10_000)])
def test_links_of_crowded_and_chained_fingerprints(spark, leaf, most):
    draw = random.Random(leaf)
    fps = [draw.getrandbits(64) for _ in range(400)]
    for f in fps[:60]:  # chains of links, and clusters
        for _ in range(draw.randint(1, 12)):
            f ^= sum(1 << b for b in draw.sample(range(64), draw.randint(1, 4)))
            fps.append(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp bigint")
    got = {r.node: r.root for r in simhash.components(simhash.near_links(df, leaf, most)).collect()}
    mine, want = defaultdict(set), defaultdict(set)
    for f, r in plain_components(set(fps)).items():
        want[r].add(signed(f))
        mine[got.get(signed(f), signed(f))].add(signed(f))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_near_dedup_keeps_one_of_each_group(edge):
    kept = similar.deduped_documents(edge).where("doc_id IS NOT NULL")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and 5 in ids and not set(range(200, 240)) & set(ids)


def wide_components(fps):
    """Components of links over all 256 bits, by comparing all pairs."""
    fps, numbers = sorted(fps), [int.from_bytes(f, "big") for f in sorted(fps)]
    root = {f: f for f in fps}
    for i, a in enumerate(fps):
        for j in range(i):
            if (numbers[i] ^ numbers[j]).bit_count() <= similar.LINK_BITS and root[a] != root[fps[j]]:
                old, new = max(root[a], root[fps[j]]), min(root[a], root[fps[j]])
                root = {f: new if r == old else r for f, r in root.items()}
    return root


@pytest.mark.parametrize("leaf, most", [(10_000, 10_000), (40, 10_000), (40, 30)])
def test_similar_groups_equal_all_pairs(spark, leaf, most):
    draw, texts = random.Random(leaf + most), []
    for i in range(60):
        base = [f"{draw.choice('abcdefgh')}{draw.randint(0, 400)}" for _ in range(draw.randint(150, 300))]
        texts.append(" ".join(base))
        for _ in range(draw.randint(0, 4)):  # two changes in 150 words or more: a similarity of 0.87 or more
            copy = list(base)
            for k in draw.sample(range(len(copy)), 2):
                copy[k] = "other"
            texts.append(" ".join(copy))
    texts += ["", "", " \n", "one two", "ONE two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got, want, first = {r.doc_id: r.component_id for r in similar.similar_groups(df, leaf, most).collect()}, {}, {}
    root = wide_components({similar.fingerprint(t) for t in texts})
    for i, t in enumerate(texts):
        want[i] = first.setdefault(root[similar.fingerprint(t)], i)
    assert got == want
    assert len(set(got.values())) == 60 + 2


@pytest.mark.parametrize("block", [10_000, 7])
def test_similar_groups_equal_shingle_sets(spark, block):
    draw, texts = random.Random(11), []
    for _ in range(40):
        base = [f"w{draw.randint(0, 9999)}" for _ in range(200)]
        texts.append(" ".join(base))
        for n in draw.sample((2, 3, 4, 5, 6, 8, 10), 4):  # similarities of about 0.6 to 0.9
            copy = list(base)
            for k in range(n):
                copy[10 + k * 190 // n] = f"x{draw.randint(0, 9999)}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    root, seen = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i - i % 5, i):
            seen.append(len(sets[i] & sets[j]) / len(sets[i] | sets[j]))
            if seen[-1] >= 0.8 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert sum(0.6 < x < 0.8 for x in seen) > 50 and sum(0.8 <= x < 0.9 for x in seen) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_groups(df, block=block).collect()}
    assert got == dict(enumerate(root))


def test_wide_fingerprints_follow_similarity():
    draw = random.Random(3)
    for n_changes, low, high in ((0, 0, 0), (2, 5, 40), (60, 90, 166)):
        base = [f"w{draw.randint(0, 9999)}" for _ in range(200)]
        copy = list(base)
        for k in draw.sample(range(200), n_changes):
            copy[k] = "x"
        a, b = (np.frombuffer(similar.fingerprint(" ".join(t)), np.uint64) for t in (base, copy))
        assert low <= np.bitwise_count(a ^ b).sum() <= high
    assert similar.fingerprint(None) == similar.fingerprint(" \t") == bytes(32)


# 3: exact dedup

@pytest.mark.parametrize("hashed", [chunkdedup._hash, lambda c: F.length(c) % 7])
def test_exact_groups(edge, edge_rows, hashed):
    groups = defaultdict(list)
    for r in edge_rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for r in edge_rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, sha(r[1] or "")))
    assert rows(chunkdedup.exact_groups(edge, hashed, 4), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_chunks_join_to_the_text_and_move_little(edge, spark):
    parts = edge.select(F.coalesce("text", F.lit("")).alias("t"), chunkdedup.chunks(F.coalesce("text", F.lit("")), 8).alias("c")).collect()
    assert all("".join(r.c) == r.t and all(r.c) for r in parts)
    text = next(r.t for r in parts if len(r.t) > 50_000)
    pair = spark.createDataFrame([(text,), ("inserted " + text,)], "t string").select(chunkdedup.chunks(F.col("t")).alias("c")).collect()
    assert len(set(pair[0].c) - set(pair[1].c)) <= 1


# 4: quality classifier

def plain_model(train, order):
    counts = {order: Counter()}
    for t in train:
        raw = b"\0" * (order - 1) + t.encode()
        counts[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    held, totals = {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        held[k] = [min(max(j - (j + 1) * y * n[j + 1] / n[j] if n[j] else 0.5 * j, 0.05), j - 0.05) for j in (1, 2, 3)]
        totals[k] = defaultdict(lambda: [0, 0.0])
        for g, x in c.items():
            totals[k][g[:-1]][0] += x
            totals[k][g[:-1]][1] += held[k][min(x, 3) - 1]

    def p(g):
        k, rest = len(g), (p(g[1:]) if len(g) > 1 else 1 / 256)
        if g[:-1] not in totals[k]:
            return rest
        total, freed = totals[k][g[:-1]]
        x = counts[k].get(g, 0)
        return ((x - held[k][min(x, 3) - 1] if x else 0) + freed * rest) / total

    return p


@pytest.mark.parametrize("shard_rows", [10**6, 500])
def test_perplexity_equals_brute_force(edge, edge_rows, spark, shard_rows):
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(120)] + [(5, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    train = {i for i in range(120) if i % 9 and zlib.crc32(str(i).encode()) % 5}
    order = 3
    p = plain_model([r[1] for r in edge_rows if r[0] in train], order)
    scored = kneserney.with_role(edge, labels)
    model = kneserney.log_probabilities(kneserney.gram_counts(scored, order), order)
    got = {(r.doc_id, r.n_bytes): r.lp for r in kneserney.scores(scored, model, order, shard_rows).where("doc_id <> 10").collect()}
    for r in edge_rows:
        if r[0] in (None, 10):
            continue
        raw = b"\0" * (order - 1) + (r[1] or "").encode()
        want = sum(math.log(p(raw[i : i + order])) for i in range(len(raw) - order + 1))
        assert got[r[0], len(raw) - order + 1] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_probabilities_of_a_context_sum_to_one(edge):
    rows_ = edge.where("doc_id < 40").select("text", F.lit("train").alias("role"))
    g = kneserney.gram_counts(rows_, 2)
    context = g.where("c > 0").first()["g"] >> 8
    every = g.unionByName(g.sparkSession.range(256).selectExpr(f"id + {context << 8} AS g", "0L AS c")).groupBy("g").agg(F.sum("c").alias("c"))
    mass = kneserney.log_probabilities(every, 2).where(F.shiftright("g", 8) == context).agg(F.sum(F.exp("lp"))).first()[0]
    assert mass == pytest.approx(1, rel=1e-3)


def test_no_plan_of_the_model_holds_more_than_one_order(edge, monkeypatch):
    plans, write = [], kneserney.written
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    monkeypatch.setattr(kneserney, "written", lambda df, label: plans.append(exchanges(df)) or write(df, label))
    table = write(kneserney.gram_counts(edge.select("text", F.expr("IF(doc_id % 2 = 0, 'train', NULL)").alias("role"))), "grams")
    plans.append(exchanges(kneserney.log_probabilities(table)))
    assert max(plans) <= 4


def test_quality_keeps_clean_text_and_rejects_junk(spark):
    spark_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{spark_dir}/{t}.parquet") for t in ("documents", "labels"))
    seen = kneserney.classify(docs, labels).join(labels, "doc_id").where("toxic = 0").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r.quality: r.k for r in seen.collect()}
    assert share[1] == 1 and share[0] < 0.1


def test_quality_shares_of_clean_junk_and_toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kind = F.when(F.col("toxic") == 1, F.concat(F.lit("toxic "), F.col("quality"))).when(F.col("quality") == 1, "clean").otherwise("junk")
    seen = kneserney.classify(docs, labels).join(labels, "doc_id").groupBy(kind.alias("kind")).agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r.kind: r.k for r in seen.collect()}
    assert share["clean"] > 0.995 and share["junk"] < 0.07 and share["toxic 0"] < 0.07 and share["toxic 1"] < 0.95


def test_limits_are_quantiles_of_own_and_pooled_documents(spark):
    draw = random.Random(5)
    entropy = {None: [0.001 * draw.randint(1500, 1700) for _ in range(900)], "b": [0.001 * draw.randint(1400, 1500) for _ in range(30)], "c": [2.5]}
    data = [(lang, "calibrate", e) for lang, es in entropy.items() for e in es] + [("b", "train", 9.0), ("d", None, 9.0), ("b", "calibrate", None)]
    for quantile, pooled in ((0.995, kneserney.POOLED), (0.9, 10), (0.5, 1)):
        got = kneserney.limits(spark.createDataFrame(data, "lang string, role string, entropy double"), quantile, pooled).collect()
        every = sorted(e for es in entropy.values() for e in es)

        def limit(own):
            least = (len(own) + pooled) * quantile - 1e-6
            return next(x for x in every if sum(e <= x for e in own) + pooled / len(every) * sum(e <= x for e in every) >= least)

        want = {(False, lang): limit(es) for lang, es in entropy.items()} | {(True, None): limit([])}
        assert {(r["any"], r.of_lang) for r in got} == set(want)
        assert all(abs(r.limit - want[r["any"], r.of_lang]) < 0.0011 for r in got)
        assert quantile != 0.995 or want[False, "c"] < 2


# 5: top-k

def test_top_k_equals_brute_force(spark):
    draw = np.random.default_rng(3)
    data = {int(i): [float(x) for x in draw.integers(-3, 4, 6) / 64] for i in draw.choice(4000, 700, replace=False) - 300}
    table = [(i, v) for i, v in data.items()] + [(20_000, None), (20_020, [1.0, None]), (20_040, [float("nan")] * 6), (20_060, [float("inf")] * 6)]
    table += [(20_080, [0.5, 0.25]), (20_100, [])]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>")
    vectors = topk.quantised(df)
    got = rows(topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, 64, 4, 16), "query_id", "rank", "vec_id", "score")
    whole = {i: ([math.floor(64 * x) for x in v] + [0] * 6)[:6] for i, v in [*data.items(), (20_080, [0.5, 0.25]), (20_100, [])]}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want, key=repr)


def test_blocks_below_the_bound_are_not_scored():
    blocks = []
    for b in range(10):
        cells = np.full((8, 4), 10 - b, np.int64)
        blocks.append({"ids": np.arange(b * 8, b * 8 + 8).tobytes(), "width": 4, "cells": cells.tobytes(), "high": cells.max(0).tobytes(), "low": cells.min(0).tobytes()})
    found, scored = topk.best_in_blocks(np.array([-1]), np.ones((1, 4), np.int64), blocks, 8)
    assert scored == 1 and sorted(found["vec_id"]) == list(range(8))


# 6: token counts

def test_counts_come_from_the_cache_once_known(edge, edge_rows, spark, tmp_path):
    path, cache = P.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    tokens = Tokenizer.from_file(path)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(tokens.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in edge_rows), key=repr)
    half = tokencounts.token_counts(edge.where("doc_id < 60"), path, cache)
    assert half.count() == 62
    stored = lambda: spark.read.parquet(cache).count()
    some = stored()
    assert rows(tokencounts.token_counts(edge, path, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    all_ = stored()
    assert all_ == len({r[1] or "" for r in edge_rows}) > some
    assert rows(tokencounts.token_counts(edge, path, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert stored() == all_
    other = tokencounts.token_counts(edge.where("doc_id < 9"), P.path("piece_bpe_32k.model"), cache)
    assert other.count() == 9 and stored() == all_ + 9


def test_stretches_are_asked_for_once_and_count_as_the_library_has_it(monkeypatch):
    monkeypatch.setattr(tokencounts, "REMEMBERED_BYTES", 20_000)
    path, chance = P.path("byte_bpe_50k.json"), random.Random(3)
    tokens, counts = Tokenizer.from_file(path), tokencounts._encoder(path)
    some = [*" \t\n\r\x0b\x1c\x1f\x85\xa0\u1680\u2003\u200b\u2028\u3000\ufeff", *"ab'sdtm!?.019\u00e9\u4e2d\u0627\u0301\u0663\U0001f600", "<|endoftext|>", "'ll", " the"]
    texts = ["".join(chance.choice(some) for _ in range(chance.randrange(30))) for _ in range(5000)]
    want = [len(tokens.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [n for k in range(0, len(texts), 61) for n in counts(texts[k : k + 61])] == want
    asked = []
    by = tokencounts._by_stretch(lambda given: asked.extend(given) or [len(t) for t in given], ["<x>"])
    assert by(["one two one two", "a<x> two", "", " two one"]) + by(["one two"]) == [15, 8, 0, 8, 7]
    assert sorted(asked) == [" one", " two", "a<x> two", "one"]


# 7: language id

def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97


def plain_language(text, model):
    """The prediction in plain numpy: each n-gram hashed by itself, embeddings averaged in order."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, False
    data, total, n_all = b" " + text.lower().encode() + b" ", np.zeros(langid.WIDTH), 0
    for n in langid.NGRAMS:
        for i in range(len(data) - n + 1):
            h = n
            for byte in data[i : i + n]:
                h = (h ^ byte) * 16_777_619 & 0xFFFFFFFF
            total += model["embed"][(h ^ h >> 15) & (langid.BUCKETS - 1)]
            n_all += 1
    logits = total / max(1, n_all) @ model["out"]
    top = np.sort(logits)[::-1]
    lead = top[0] - top[1] if len(top) > 1 else 0.0
    return model["langs"][int(logits.argmax())], float(np.exp(logits - logits.max()).max() / np.exp(logits - logits.max()).sum()), lead - model["least"]


def test_predictions_equal_plain_numpy(edge, edge_rows):
    model = langid.learn(edge)
    got = sorted(((r.doc_id, r.lang_pred, r.score, r.accepted) for r in langid.predict(edge, model).collect()), key=repr)
    want = sorted(((r[0], *plain_language(r[1], model)) for r in edge_rows), key=repr)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-4
        if abs(w[3]) > 1e-4:
            assert g[3] == (w[1] != "und" and w[3] > 0)


@pytest.mark.parametrize("sf,slack", [("0.01", 0.02), ("0.1", 0.01)])
def test_rejection_is_calibrated(spark, sf, slack):
    """Of right predictions of held-out documents, about the promised share is accepted."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred = lang")
    accepted = got.agg(F.avg(F.col("accepted").cast("int"))).first()[0]
    assert abs(accepted - (1 - langid.REJECT_SHARE)) <= slack


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than the sample has room for: each still has a document in it."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 10)
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 20) * 3} word", f"l{i % 20}") for i in range(400)], "doc_id bigint, text string, lang string")
    assert langid.learn(docs)["langs"] == sorted(f"l{i}" for i in range(20))


def test_text_without_letters_is_undetermined(edge):
    got = {r.doc_id: r for r in langid.identify(edge).collect() if r.doc_id is not None}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 and not got[d].accepted for d in (300, 301, 302, 305))
    assert got[308].lang_pred in ("en", "fr", "de") and 0 <= got[308].score <= 1 and 9_007_199_254_740_993 in got
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())


# 8: BPE

@pytest.mark.parametrize("cached", [0, 40, 100_000])
def test_ids_are_those_of_the_library(edge, edge_rows, cached):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    coded = bpe.encode(edge, RANKS, P.PATTERN, cached)
    got = sorted(((r.doc_id, tuple(r.ids), bytes(r.ids_le)) for r in coded.collect()), key=repr)
    ids = [(r[0], own.encode_ordinary(r[1] or "")) for r in edge_rows]
    assert got == sorted(((d, tuple(i), np.array(i, "<u4").tobytes()) for d, i in ids), key=repr)
    texts = rows(coded.select("doc_id", bpe.decoded(F.col("ids"), RANKS).cast("string").alias("t")), "doc_id", "t")
    assert texts == sorted(((r[0], r[1] or "") for r in edge_rows), key=repr)


def test_native_fold_equals_the_library(edge, spark):
    ranks = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words_ = bpe.frequent_words(edge, P.PATTERN).select("word", bpe.folded_ids(F.col("word"), ranks).alias("ids")).collect()
    assert len(words_) > 50 and all(r.ids == own.encode_ordinary(r.word) for r in words_)


def test_plans_do_not_spell_out_the_ranks(spark):
    # Spark keeps each plan's text; the driver's memory was used up by that.
    df = spark.createDataFrame([(1, "a word")], "doc_id bigint, text string")
    plans = bpe.folded_words(df.select(F.col("text").alias("word")), bpe.read_ranks(RANKS)), bpe.round_trip(df, RANKS, P.PATTERN)
    for got in plans:
        text = got._jdf.queryExecution().optimizedPlan().toString()
        # The Project that uses the table has it as a constant: no row carries it.
        assert len(text) < 20_000 and "scalar-subquery" in text.split("\n")[0], text


# 9: sharding

def test_shards_are_even_and_slots_without_gaps(edge, edge_rows):
    got = sharding.shard_documents(edge, block_rows=16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(8)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sorted(got, key=repr) == sorted(sharding.shard_documents(edge, block_rows=16).collect(), key=repr)


def test_matrix_counts_follow_the_distribution():
    good, bad, draws = 9, 13, 8
    n = 40_000
    draw = random.Random(1)
    seen = Counter(sharding.hypergeometric(good, bad, draws, draw.random()) for _ in range(n))
    for k in range(9):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(seen[k] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1
    matrix = np.array(sharding.communication_matrix([10**9, 5, 0, 77], [250_000_021, 250_000_021, 250_000_020, 250_000_020], 4))
    assert matrix.sum(1).tolist() == [10**9, 5, 0, 77] and matrix.sum(0).tolist() == [250_000_021, 250_000_021, 250_000_020, 250_000_020]


def test_places_are_uniform(spark):
    """Each id lands in each shard equally often over seeds."""
    ids = spark.range(40).select(F.col("id").alias("doc_id")).cache()
    seen = Counter()
    for seed in range(12):
        for r in sharding.uniform_shards(ids, 4, seed, block_rows=10).collect():
            seen[r.shard, r.doc_id < 20] += 1
    assert all(abs(n - 60) <= 30 for n in seen.values())


# 10: line dedup

def plain_lines(edge_rows, ids=None):
    key = lambda x: "".join(c.lower() if c in mixing_upper else c for c in x.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for d, t, *_ in edge_rows:
        if d is not None and (ids is None or d in ids):
            for x in (t or "").split("\n"):
                if len(key(x)) >= 40:
                    holders[key(x)].add(d)
    out = []
    for d, t, *_ in edge_rows:
        all_ = (t or "").split("\n")
        keep = [x for x in all_ if d is None or len(holders[key(x)]) < 5 or d >= max(holders[key(x)])]
        out.append((d, len(all_), len(all_) - len(keep), sha("\n".join(keep))))
    return sorted(out, key=repr)


def test_line_digests_equal_brute_force(edge, edge_rows):
    assert rows(lines.line_digests(edge), "doc_id", "n_lines", "n_dropped", "kept_sha256") == plain_lines(edge_rows)


def test_insertions_and_deletions_undo_each_other(edge, edge_rows, spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 40)
    monkeypatch.setattr(lines, "FILTER_KEYS", 24)
    state = lambda s: (rows(s.refs, "key", "h", "doc_id"), rows(s.counts, "key", "h", "n_docs", "keep_doc"))
    a, b = edge.where("doc_id < 80"), edge.where("doc_id >= 80")
    both = lines.LineStore(spark).insert(a).insert(b)
    assert state(both) == state(lines.LineStore(spark).insert(edge)) == state(both.insert(a))
    assert both.shards > 1
    less = both.delete(a)
    assert state(less) == state(lines.LineStore(spark).insert(b))
    again = less.insert(a)
    assert state(again) == state(both)
    digests = lambda s: rows(s.rewrite(edge.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("k")), "doc_id", "n_lines", "n_dropped", "k")
    assert digests(again) == plain_lines(edge_rows)
    for store in (both, less, again):  # filters know every key that has references
        shards = defaultdict(list)
        for r in store.filters.collect():
            shards[r.shard].append(Cuckoo.loads(r.filter))
        for r in store.counts.collect():
            own = shards[(r.h >> 16) % store.shards]
            assert any(f.contains([r.h])[0] for f in own)


def test_cuckoo_filter_holds_and_forgets():
    hashes = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 30_000)
    f = Cuckoo.sized(20_000)
    refused = f.add(hashes[:20_000])
    assert not len(refused) and f.contains(hashes[:20_000]).all() and f.contains(hashes[20_000:]).mean() < 0.01
    assert not len(f.discard(hashes[:10_000])) and f.count == 10_000 and f.contains(hashes[10_000:20_000]).all()
    full = Cuckoo.sized(100)
    left = full.add(hashes[:2_000])
    assert len(left) and full.contains(np.setdiff1d(hashes[:2_000], left)).all()


def test_merges_fold_as_encode_word():
    draw, ranks = random.Random(8), {bytes([b]): b for b in range(256)}
    parts = [b"a", b"b", b"c"]
    while len(ranks) < 330:  # ranks in no order of making
        piece = draw.choice(parts) + draw.choice(parts)
        if piece not in ranks:
            parts.append(piece)
            ranks[piece] = 256 + 1000 * draw.randint(0, 50) + len(ranks)
    words = [bytes(draw.choices(b"abc\x00\xff", (9, 9, 9, 1, 1), k=draw.randint(1, 150))) for _ in range(600)] + [b"", *parts]
    want = [np.array(bpe.encode_word(w, ranks), "<u4").tobytes() for w in words]
    assert bpe.Merges(ranks).fold(words) == want
    assert bpe.Merges(ranks).fold([]) == []


def test_segments_within_one_bit_meet_in_trees_of_their_own_vantage_points(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 256, (400, 32), np.uint8)
    near = base.copy()
    near[:, 7] ^= np.uint8(16)
    fps = sorted({x.tobytes() for x in np.concatenate([base, near])})
    trees = similar.vantage_trees(spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary"), 3, sample=300)
    assert all(len(points) == len(radii) == 7 and len(set(points.tolist())) > 3 for points, radii in trees)
    placed = pd.concat(similar._placer(trees)(iter([pd.DataFrame({"fp": fps})])))
    assert placed["leaf"].between(0, 7).all() and placed["leaf"].nunique() > 4
    wide = np.frombuffer(b"".join(fps), np.uint8).reshape(-1, 32)
    for t, own in enumerate(similar.segments(wide)):
        leaves = defaultdict(set)
        for r in placed[placed["tree"] == t].itertuples():
            leaves[r.fp].add(r.leaf)
        i, j = np.nonzero(np.bitwise_count(own[:, None] ^ own) <= 1)
        assert all(leaves[fps[a]] & leaves[fps[b]] for a, b in zip(i, j, strict=True))


def test_buckets_of_a_leaf_find_every_pair_within_one_bit():
    for values in (np.arange(3000), np.random.default_rng(1).choice(1 << 18, 4000, False), np.zeros(0, np.int64), 1 << np.arange(18)):
        i, j = similar._close(values)
        a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values) == 1)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < y)
    assert max(map(len, similar._buckets(np.random.default_rng(2).choice(1 << 18, 4000, False)))) <= similar.BUCKET


def test_workers_and_driver_return_memory(spark, monkeypatch):
    returned, gone = [], []
    monkeypatch.setattr(common, "release_memory", lambda: returned.append(1))
    assert [len(x) for x in common.returning(lambda frames: frames)(iter([[1], [1, 2]]))] == [1, 2] and returned == [1]
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: gone.append(self))
    docs = spark.createDataFrame([(1, "abcab", "en", "train")], "doc_id long, text string, lang string, role string")
    model = kneserney.log_probabilities(kneserney.gram_counts(docs, 2), 2)
    assert kneserney.scores(docs, model, 2, 3).count() == 1 and len(gone) > 1
