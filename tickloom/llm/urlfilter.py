"""URL filters: rules on host and path, and a logistic regression on hashed character n-grams for the rest.

The host and the path are cut out of the URL as text. A rule names a host, with
all its subdomains, and the start of a path; the longest rule that fits decides.
URLs that no rule fits are judged by the model: a logistic regression on the
n-grams of ``SIZES`` characters of the framed host and path, hashed into
``BUCKETS`` weights. Grams of host and path hash apart, and the frame makes
beginnings and ends grams of their own. It is trained in numpy from a small
labelled table of URLs, ``LABELLED_MOST`` at most, by gradient descent over all
of them, classes weighing alike, so equal tables give equal weights. A batch of
URLs is hashed at once, windows of ``WINDOW`` characters bounding the memory.

A null URL, or one without ``://``, has an empty host and path, which the model
judges like others. URLs of any length are read whole. Repeated rows are judged
alike. An empty table gives no rows. Rules of equal length that fit go in the
order given. Without labelled URLs of both verdicts there is no model, and what
no rule fits is allowed. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import LOWER, UPPER, id_back
from tickloom.session import ship_by_value

SIZES, BUCKETS_LOG2, WINDOW = (3, 4, 5), 16, 2_000_000
BUCKETS = 1 << BUCKETS_LOG2
#: Labelled URLs that training reads, at most: those of least hash. Rules there may be, at most.
LABELLED_MOST, RULES_MOST = 20_000, 1_000
STEPS, RATE, SHRINK = 600, 4.0, 1e-5
#: The intercept is not learned but a prior of URLs to block, so a URL unlike any labelled one stays.
PRIOR = 0.2
_PRIME, _PATH = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_HOST_START, _PATH_START, _END = "\x01", "\x02", "\x03"

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)

_BLOCKED = """
cheap-meds cheap-watches-outlet buy-cheap-viagra best-pills-online diet-pills pills-24h sleeping-pills casino-bonus free-casino-spins
online-casino poker-win-cash win-big-jackpot link-farm content-farm click-farm seo-farm-links spam spam-blog spam-links mail-spam
free-xxx-video hot-xxx adult-cams payday-loans quick-payday-cash replica-watches fake-bags free-iphone-winner work-from-home-cash
sports-bets free-betting-tips ads-banner popup-ads ad-track-pixel track-clicks free-crypto-coins get-rich-fast miracle-weight-loss
""".split()
_ALLOWED = """
library harbour gardening weather university museum recipes travel-notes software city-council hospital school football astronomy trains
theatre cycling mathematics history farmers-union rivers thesaurus stations nations translation edition chess orchestra bakery bridges
sailing forest winter-sports freedom-press tracks-and-trails farmhouse-bread the-other-side then-and-there mountain northern-lights
""".split()
_FORMS = ("http://{}.test/en/12", "https://www.{}.test/fr/904?page=2", "https://blog.{}.test/de/7/", "http://m.{}.test/es/3381.html#top")
#: The labelled table of the registered query: invented hosts under a reserved top-level domain, each with the same pages.
LABELLED = tuple(
    (form.format(host), verdict) for hosts, verdict in ((_BLOCKED, "block"), (_ALLOWED, "allow")) for host in hosts for form in _FORMS
)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty without ``://``."""
    address = F.col(url)
    at = F.coalesce(F.instr(address, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(address, at + 3, F.char_length(address))).otherwise(F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both NULL where none does."""
    if len(rules) > RULES_MOST:
        raise ValueError(f"more than {RULES_MOST} rules")
    rule = verdict = F.lit(None).cast("string")
    # Built from the shortest, so the longest is asked first.
    for where, start, says in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True)[::-1]:
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(where + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _gram_windows(hosts: Sequence[str], paths: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of all rows, window by window."""
    texts = [f"{_HOST_START}{h}{_PATH_START}{p}{_END}" for h, p in zip(hosts, paths)]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) for t in texts])
    path_starts = ends - np.array([len(p) + 2 for p in paths])
    for first in range(0, len(points), WINDOW):
        part = points[first : first + WINDOW + max(SIZES) - 1].astype(np.uint64)
        place = np.arange(first, first + len(part))
        row = np.searchsorted(ends, place, side="right")
        section = np.where(place >= path_starts[row], _PATH, np.uint64(0))
        grams = part.copy()
        for size in range(2, max(SIZES) + 1):
            grams = grams[:-1] * _PRIME + part[size - 1 :]
            if size in SIZES:
                n = min(len(grams), WINDOW)
                whole = row[:n] == row[size - 1 : size - 1 + n]
                mixed = (grams[:n] ^ section[:n] ^ np.uint64(size)) * _PATH
                mixed ^= mixed >> np.uint64(29)
                buckets = (mixed * _PRIME >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
                yield row[:n][whole], buckets[whole]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        total, count = np.zeros(len(hosts)), np.zeros(len(hosts))
        for row, bucket in _gram_windows(hosts, paths):
            total += np.bincount(row, self.weights[bucket], len(hosts))
            count += np.bincount(row, minlength=len(hosts))
        return 1 / (1 + np.exp(-(self.bias + total / np.sqrt(np.maximum(count, 1)))))


def labelled_rows(labelled: DataFrame, most: int = LABELLED_MOST) -> list[tuple[str, str, str]]:
    """At most ``most`` distinct labelled URLs (url, verdict) as host, path, verdict, in a fixed order."""
    host, path = host_and_path()
    rows = labelled.where(F.col("verdict").isin("allow", "block")).select(host.alias("host"), path.alias("path"), "verdict").distinct()
    order = [F.xxhash64("host", "path", "verdict"), "host", "path", "verdict"]
    return [tuple(r) for r in rows.orderBy(*order).limit(most).collect()]


def train(rows: Sequence[tuple[str, str, str]], steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK) -> Model | None:
    """Weights by gradient descent on the mean log loss, either verdict weighing one half; None unless both are there."""
    blocked = np.array([v == "block" for _, _, v in rows], float)
    if not 0 < blocked.sum() < len(rows):
        return None
    windows = list(_gram_windows([r[0] for r in rows], [r[1] for r in rows]))
    row, bucket = (np.concatenate([w[i] for w in windows]) for i in (0, 1))
    size = np.sqrt(np.bincount(row, minlength=len(rows)))
    share = np.where(blocked > 0, 0.5 / blocked.sum(), 0.5 / (len(rows) - blocked.sum()))
    model = Model(np.zeros(BUCKETS), float(np.log(PRIOR / (1 - PRIOR))))
    for _ in range(steps):
        logits = model.bias + np.bincount(row, model.weights[bucket], len(rows)) / size
        slope = share * (1 / (1 + np.exp(-logits)) - blocked)
        model.weights -= rate * (np.bincount(bucket, (slope / size)[row], BUCKETS) + shrink * model.weights)
    return model


def _slices(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows with about ``WINDOW`` characters each."""
    upto = (frame["host"].str.len() + frame["path"].str.len()).cumsum()
    for _, part in frame.groupby((upto // WINDOW).to_numpy(), sort=True):
        yield part


def _judge(model: Model | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _slices(frame):
                score = np.zeros(len(part))
                if model:
                    score = model.scores(part["host"].tolist(), part["path"].tolist())
                yield part.assign(score=score)

    return run


def judged(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the model's score (the probability that it would block)."""
    ship_by_value(__name__)
    model = train(labelled_rows(labelled))
    host, path = host_and_path()
    rows = pages.select(F.col("page_id").cast("bigint").cast("string").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = rows.mapInPandas(_judge(model), "page_id string, host string, path string, score double")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        id_back("page_id"), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score"
    )
