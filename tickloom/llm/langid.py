"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte n-grams (2 to 4) of its lower-cased text, hashed
to ``BUCKETS`` buckets. The average of their embeddings goes through a linear
layer and a softmax. Both are trained by stochastic gradient descent in numpy,
on a sample of ``PER_LANGUAGE`` documents of each language at most, by a hash of
the id; fewer if there are so many languages that all would come to more than
``SAMPLE_ROWS``. A fifth of the sample is left out of training and calibrates: the
softmax's temperature, at least 1, and the lead in logits over the next language
below which a prediction is rejected (``accepted`` false). The lead is the one that
all but ``REJECT_SHARE`` of the right calibration predictions have.

Only hashed features of the sample reach the one training task. Prediction
reads every whole text where it lies, and needs the embeddings of the buckets and
an output layer of ``WIDTH`` x languages.

Null text, or text without a letter, is ``und`` with score 0, not accepted. With
nothing to learn from, so is every text. Rows without lang teach nothing. Repeated
rows are predicted alike, and texts of any length are read whole; of equal leads the
language first in order is taken. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import id_back, id_text
from tickloom.session import ship_by_value

NGRAMS, BUCKETS, WIDTH = (2, 3, 4), 1 << 15, 16
PER_LANGUAGE, SAMPLE_ROWS = 800, 400_000
RATE, LEAST_STEPS, EPOCHS, SEED = 40.0, 12_000, 3, 7
#: Share of right calibration predictions that the rejection may cost.
REJECT_SHARE = 0.01
_FEATURES = "lang string, calibrate boolean, buckets array<int>, weights array<float>"


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def bucket_counts(text: str) -> np.ndarray:
    """How often the text's subwords fall into each bucket."""
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for n in NGRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint32)
        for j in range(n):
            h = (h ^ data[j : len(data) - n + 1 + j]) * np.uint32(16_777_619)
        counts += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return counts


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        buckets, weights = [], []
        for text in frame["text"]:
            counts = bucket_counts(text)
            at = np.flatnonzero(counts)
            buckets.append(at.astype(np.int32))
            weights.append((counts[at] / max(1, counts.sum())).astype(np.float32))
        yield pd.DataFrame({"lang": frame["lang"], "calibrate": frame["calibrate"], "buckets": buckets, "weights": weights})


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: pd.DataFrame) -> dict:
    """Languages, embeddings, the output layer (temperature applied) and the least accepted margin."""
    langs = sorted(sample["lang"].unique())
    want = sample["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy()
    held = sample["calibrate"].to_numpy(bool)
    if held.all():
        held = np.zeros(len(sample), bool)
    draw, fit = np.random.default_rng(SEED), np.flatnonzero(~held)
    embed = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(langs)), np.float32)
    # A language counts the same, however many documents it has in the sample.
    share = np.bincount(want[fit], minlength=len(langs)).astype(np.float64)
    each = (len(fit) / np.maximum(share, 1) / max(1, (share > 0).sum()))[want]
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(fit))))
    total, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in draw.permutation(fit):
            at, w = sample["buckets"].iat[i], sample["weights"].iat[i]
            # Texts with few subwords have large weights; their steps are bounded, or they would overshoot.
            rate, step = min(RATE * min(each[i], 3.0), 0.1 / float(w @ w)) * (1 - step / total), step + 1
            hidden = w @ embed[at]
            error = _softmax(hidden @ out)
            error[want[i]] -= 1
            back = out @ error
            out -= min(rate * 0.1, 0.5 / (float(hidden @ hidden) + 1e-6)) * np.outer(hidden, error)
            embed[at] -= rate * w[:, None] * back[None, :]
    by = np.flatnonzero(held) if held.any() else fit
    logits = np.stack([(sample["weights"].iat[i] @ embed[sample["buckets"].iat[i]]) @ out for i in by])
    # Below 1 the scores would all become 1 where every calibration document is right.
    heats = np.geomspace(1, 32, 41)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(by)), want[by]] + 1e-12).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    margins = np.array([_margin(x / heat) for x in logits])
    right = logits.argmax(axis=1) == want[by]
    least = float(np.quantile(margins[right], REJECT_SHARE)) if right.any() else 0.0
    return {"langs": langs, "embed": embed, "out": (out / heat).astype(np.float32), "least": least}


def _margin(logits: np.ndarray) -> float:
    """By how much the best language leads the next one."""
    if len(logits) < 2:
        return 0.0
    second, first = np.partition(logits, -2)[-2:]
    return float(first - second)


def _train_task(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.assign(first=[bytes(np.asarray(b)) for b in rows["buckets"]]).sort_values(["lang", "calibrate", "first"])
    return pd.DataFrame({"model": [pickle.dumps(train(rows.reset_index(drop=True)))]})


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """The model of the documents that are not held out; None if they have no language."""
    ship_by_value(__name__)
    usable = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = usable.groupBy("lang").count().orderBy("lang").collect()
    if not known:
        return None
    n = {r["lang"]: r["count"] for r in known}
    per_language = max(1, min(per_language, SAMPLE_ROWS // len(n)))
    order = F.xxhash64("doc_id", F.lit(SEED))
    # A share of each language that holds its sample, with room to spare, is cut to size by rank.
    grid = 1 << 20
    share = F.create_map(*[x for lang, c in n.items() for x in (F.lit(lang), F.lit(int(min(1.0, (2 * per_language + 20) / c) * grid)))])
    near = usable.where(F.pmod(order, F.lit(grid)) < share[F.col("lang")])
    pick = Window.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text"))
    sample = near.withColumn("at", F.row_number().over(pick)).where(F.col("at") <= per_language).select(
        "lang", (F.col("at") % 5 == 0).alias("calibrate"), "text"
    )
    features = sample.mapInPandas(_featured, _FEATURES)
    rows = features.groupBy().applyInPandas(_train_task, "model binary").collect()
    return pickle.loads(bytes(rows[0]["model"]))


def _predictor(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            preds, scores, accepted = [], [], []
            for text in frame["text"]:
                if model is None or text is None or not any(c.isalpha() for c in text):
                    preds.append("und")
                    scores.append(0.0)
                    accepted.append(False)
                    continue
                counts = bucket_counts(text)
                at = np.flatnonzero(counts)
                logits = ((counts[at] / max(1, counts.sum())) @ model["embed"][at]) @ model["out"]
                preds.append(model["langs"][int(logits.argmax())])
                scores.append(float(_softmax(logits).max()))
                accepted.append(_margin(logits) >= model["least"])
            yield frame[["doc_id", "held_out"]].assign(lang_pred=preds, score=scores, accepted=accepted)

    return run


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, accepted."""
    ship_by_value(__name__)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(id_text(), "text", held_out().alias("held_out"))
    found = rows.mapInPandas(_predictor(shared), "doc_id string, held_out boolean, lang_pred string, score double, accepted boolean")
    return found.select(id_back(), "held_out", "lang_pred", "score", "accepted")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
