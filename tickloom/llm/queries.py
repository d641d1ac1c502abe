"""Registered queries of this subpackage, and DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import (
    bpe, chunkdedup, kneserney, langid, lines, mixing, sharding, simhash, spelling, tokencounts, topk, urlfilter, vectorcodes,
)
from tickloom.llm.common import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


_MIX_ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][pos % 3 + 1]::DOUBLE AS w, source_size::DOUBLE * 2 AS cap FROM s
), f AS (
  SELECT *, sum(source_size::DOUBLE) OVER () * 1.5 AS want,
         coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
  FROM w
), g AS (SELECT *, cap * w_from <= w * (want - before) AS is_full FROM f
), l AS (SELECT arg_min(before, cap / w) AS b0, arg_min(w_from, cap / w) AS w0 FROM g WHERE NOT is_full
), t AS (
  SELECT source, pos, source_size, CASE WHEN is_full THEN cap ELSE w * (want - b0) / w0 END AS target FROM g LEFT JOIN l ON true
), n AS (SELECT round(sum(target) / {mixing.BLOCK_WORDS})::BIGINT AS n, sum(target) AS whole FROM t
), k AS (
  SELECT pos, source_size, target, unnest(range(CASE WHEN target > 0 THEN ceil(n * target / whole)::BIGINT + 2 ELSE 0 END)) AS k FROM t, n
), r AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, pos, k) AS r FROM k
), q AS (SELECT pos, count(*) AS q FROM r, n WHERE r <= n GROUP BY pos
), e AS (
  SELECT t.*, ceil(source_size / {mixing.BLOCK_WORDS})::BIGINT AS blocks, coalesce(q, 0) AS q FROM t LEFT JOIN q USING (pos)
), u AS (
  SELECT *, CASE WHEN q >= 2 * blocks THEN 2 * source_size ELSE q // blocks * source_size + q % blocks * {mixing.BLOCK_WORDS} END AS upto FROM e
), o AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS first FROM d
)
SELECT doc_id, o.size, source_size, target,
       (greatest(0, least(o.size, upto - first)) + greatest(0, least(o.size, upto - source_size - first)))::BIGINT AS taken
FROM o JOIN u ON o.source IS NOT DISTINCT FROM u.source
"""


@_query("op1_mixing", _MIX_ORACLE)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a weighted mix of the sources takes of each document."""
    docs = _table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.word_count().alias("size")), "sized")
    return mixing.mix_plan(sized).select(
        "doc_id", "size", "source_size", "target", mixing.taken_words().alias("taken")
    )


@_query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the documents, and the component each belongs to."""
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


@_query("op3_chunk_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, by recipes of verified chunks."""
    return chunkdedup.exact_groups(_table(spark, sf_dir, "documents"))


@_query("op4_kneser_ney")
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each document under a model of trusted text, and whether its language's limit keeps it."""
    return kneserney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_hash")


@_query("op5_top_k", """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors for every twentieth vector."""
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(f"vec_id % {topk.QUERY_EVERY} = 0"))


@_query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted through a cache that starts empty."""
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by a model of those that are not held out."""
    return langid.identify(_table(spark, sf_dir, "documents"))


@_query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of each document, and back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of the documents into eight shards, counts at most one apart."""
    from pyspark.sql import functions as F

    return sharding.shard_documents(_table(spark, sf_dir, "documents")).withColumns(
        {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    )


@_query("op10_line_dedup", r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos, rn
  FROM (SELECT *, row_number() OVER () AS rn FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keep_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (SELECT k.*, c.key IS NOT NULL AND doc_id < keep_doc AS lost FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY rn, doc_id
""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the long lines that later documents share."""
    return lines.line_digests(_table(spark, sf_dir, "documents"))


@_query("op11_url_filter")
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's URL, by the rules or by the model."""
    labelled = spark.createDataFrame(urlfilter.LABELLED, "url string, verdict string")
    return urlfilter.judged(_table(spark, sf_dir, "pages"), labelled).drop("score")


@_query("op12_spelling", """
WITH RECURSIVE r AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
), b AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM r
), c AS MATERIALIZED (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten([[(('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT >> k) & 1 for k in range(8)] for i in range(length(bytes) // 2)])),
    lambda s, bit: xor(s >> 1, 3988292384 * (xor(s, bit) & 1)))) AS h FROM b
), w AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word FROM c
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), d AS MATERIALIZED (
  SELECT word, n, pos, word[:pos - 1] || word[pos + 1:] AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS pos FROM w)
), near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.pos = b.pos AND a.less = b.less AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.less = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS best FROM near GROUP BY word
), f AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 10 * n THEN best.near END AS form,
         CASE WHEN -best.less >= 10 * n THEN -best.less END::BIGINT AS form_n FROM w LEFT JOIN best USING (word)
), way AS (
  SELECT word, form AS root FROM f WHERE form IS NOT NULL
  UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL
), ends AS (SELECT way.word, root FROM way JOIN f ON f.word = way.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)
""")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, the far more frequent word each is a variant of, and where following those ends."""
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


def _codes_oracle(rounds: int = vectorcodes.ROUNDS) -> str:
    """The codebook rounds written out one after the other."""
    distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)])"
    steps = ["""v AS MATERIALIZED (
  SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
)""", """p AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM v, range(8) t(part)
)""", """b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, label, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS best
  FROM (SELECT p.*, entry, {distance} AS d FROM p JOIN b{i} USING (part)) GROUP BY vec_id, label, part
)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c FROM b{i} LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS m FROM (
      SELECT part, entry, place, sum(y)::BIGINT AS s, count(*) AS n
      FROM (SELECT part, best.entry AS entry, unnest(x) AS y, unnest(range(len(x))) AS place FROM a{i}) GROUP BY part, entry, place
    ) GROUP BY part, entry
  ) USING (part, entry)
)""")
    last = f"b{rounds}", f"a{rounds}"
    return "WITH " + ",\n".join(steps) + f""",
k AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM {last[1]} GROUP BY vec_id, label
), h AS (
  SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(c) AS y, unnest(range(len(c))) AS place FROM {last[0]})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k, h
"""


@_query("op13_vector_codes", _codes_oracle())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code of eight codebook indexes per vector."""
    return vectorcodes.compressed(_table(spark, sf_dir, "embeddings"))
