"""Byte-level BPE: ranked merges over distinct words, and decoding from binary pieces.

Words are the matches of the split pattern. Spark counts them, and folds the
merges of the most frequent ``CACHED_WORDS`` with higher-order functions: a word
starts as an array of bytes, and each step joins the leftmost pair with the
lowest rank in a constant map, until no pair has a rank. The map is an array of
small maps, chosen by a hash of the pair, as a lookup in one map of all ranks
would read through half of it. It is a scalar subquery's value: Spark keeps the
text of each plan, and would keep every rank with it if they were written there.

The folded words are a table of proven size (``CACHED_WORDS`` rows of at most
``CACHED_BYTES`` bytes), so they are broadcast: all words that occur at least so
often that no more have. Tasks take them from there and fold by the same rule
what is rarer or longer, all such words of a slice of texts at once (``Merges``);
a worker remembers up to twice ``REMEMBERED_WORDS`` of
these, from one task to the next. Words of over ``SCANNED_BYTES`` go through a
heap, so they take time near their length.
Ids thus never depend on what is in the cache, and no text moves.

Decoding looks up each id's piece in a constant array and concatenates the pieces.

Null text counts as empty and gives no ids. Repeated rows are encoded alike. An
empty table gives no rows. Special strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import struct
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import bound_once, id_back, id_text, release_memory, returning, whole_text, written
from tickloom.session import ship_by_value

CACHED_WORDS, CACHED_BYTES, REMEMBERED_WORDS = 100_000, 32, 100_000
#: Words up to this length are folded by scanning their pairs. Characters encoded at once: what bounds a task's memory.
SCANNED_BYTES, SLICE_CHARS = 128, 2_000_000
BUCKETS = 16_384
RANK_BUCKETS, PIECES = "array<map<string,int>>", "array<string>"
#: Bytes of the words that are folded at once; a rank beyond all others.
_CELLS, _NO_RANK = 500_000, (1 << 31) - 1
ENCODED = "doc_id string, ids array<int>, ids_le binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 piece and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def with_constant(df: DataFrame, name: str, value: list, kind: str) -> DataFrame:
    """``df`` with ``value`` as a column of type ``kind``, by a subquery that runs once.

    Use the column once: then it is a constant of the expression that uses it, and no row carries it.
    """
    row = df.sparkSession.createDataFrame([(json.dumps(value),)], "value string")
    return df.withColumn(name, row.select(F.from_json("value", kind)).scalar())


def rank_buckets(ranks: dict[bytes, int]) -> list[dict[str, int]]:
    """All ranks in ``BUCKETS`` small maps."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[xxhash.xxh64_intdigest(key.encode(), 42) % BUCKETS][key] = rank
    return buckets


def rank_lookup(table: Column):
    """Function from a binary column to its rank in a column of ``rank_buckets``, or NULL."""

    def rank(piece: Column) -> Column:
        def of(key: Column) -> Column:
            # The low bits of a hash are the same signed or unsigned, as BUCKETS is a power of two.
            return F.element_at(F.get(table, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), key)

        return bound_once(F.hex(piece), of)

    return rank


def folded_ids(word: Column, ranks: dict[bytes, int] | Column) -> Column:
    """The word's ids, by merging bytes in the order of rank. ``ranks`` may be a column of ``rank_buckets``."""
    table = ranks if isinstance(ranks, Column) else F.from_json(F.lit(json.dumps(rank_buckets(ranks))), RANK_BUCKETS)
    return bound_once(table, lambda t: _folded(word, rank_lookup(t)))


def folded_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, ids) by ``folded_ids``."""
    known = with_constant(words.select("word"), "ranks", rank_buckets(ranks), RANK_BUCKETS)
    return known.select("word", folded_ids(F.col("word"), F.col("ranks")).alias("ids"))


def _folded(word: Column, rank: Callable[[Column], Column]) -> Column:
    raw = word.cast("binary")
    single = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.substring(raw, i, F.lit(1)))
    start = F.struct(single.alias("parts"), (F.octet_length(raw) > 1).alias("going"))

    def merge(state: Column, _: Column) -> Column:
        parts = state["parts"]

        def join_best(pairs: Column) -> Column:
            def at(p: Column) -> Column:
                merged = F.concat(
                    F.slice(parts, F.lit(1), p - 1),
                    F.array(F.concat(F.get(parts, p - 1), F.get(parts, p))),
                    F.slice(parts, p + 2, F.size(parts)),
                )
                return F.struct(
                    F.when(p > 0, merged).otherwise(parts).alias("parts"), ((p > 0) & (F.size(parts) > 2)).alias("going")
                )

            return bound_once(F.coalesce(F.array_position(pairs, F.array_min(pairs)), F.lit(0)).cast("int"), at)

        ranked = F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank(F.concat(F.get(parts, i - 1), F.get(parts, i)))
        )
        return F.when(state["going"], bound_once(ranked, join_best)).otherwise(state)

    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1)))
    folded = F.aggregate(steps, start, merge, lambda s: F.transform(s["parts"], rank))
    return bound_once(rank(raw), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(folded))


def frequent_words(docs: DataFrame, pattern: str, most: int = CACHED_WORDS) -> DataFrame:
    """The words short enough to fold here that occur at least so often that at most ``most`` do."""
    words = docs.select(F.explode(F.regexp_extract_all(whole_text(), F.lit("(?U)" + pattern), F.lit(0))).alias("word"))
    counted = written(words.where(F.octet_length("word") <= CACHED_BYTES).groupBy("word").count(), "word-counts")
    often = counted.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    upto = often.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("count").desc())))
    least = upto.where(F.col("upto") <= most).agg(F.min("count")).first()[0]
    return counted.where(F.col("count") >= least if least else F.lit(False)).select("word")


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for one word: always the leftmost pair of lowest rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    if n <= SCANNED_BYTES:
        none = len(ranks) + (1 << 30)
        parts = [word[i : i + 1] for i in range(n)]
        pairs = [ranks.get(word[i : i + 2], none) for i in range(n - 1)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, i, to = heapq.heappop(pairs)
        j = after[i]
        if not alive[i] or j >= n or end[j] != to:
            continue  # one of the two has been merged since
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(pairs, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p : end[i]])) is not None:
            heapq.heappush(pairs, (r, p, end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Merges:
    """The fold of ``encode_word`` for many words at once: a matrix row per word, and a merge per row and step."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        joined = [
            (left << 32 | right, rank) for piece, rank in ranks.items() for k in range(1, len(piece))
            if (left := ranks.get(piece[:k])) is not None and (right := ranks.get(piece[k:])) is not None
        ]
        table = np.array(sorted(joined), np.int64).reshape(-1, 2)
        self.pairs, self.whole = np.append(table[:, 0], -1), np.append(table[:, 1], _NO_RANK).astype(np.int32)
        self.byte = np.array([ranks.get(bytes([b]), _NO_RANK) for b in range(256)], np.int32)
        every = np.arange(256)
        self.bytes = self._joined(np.repeat(self.byte[every], 256), np.tile(self.byte[every], 256))
        # A rank stands for its piece, and every byte is one.
        self.plain = len(set(ranks.values())) == len(ranks) and self.byte.max() < _NO_RANK

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what two neighbours make, or ``_NO_RANK``."""
        pair = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs[:-1], pair)
        return np.where(self.pairs[at] == pair, self.whole[at], np.int32(_NO_RANK))

    def _rows(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words])
        n, width = len(words), int(size.max())
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width).astype(np.int32)
        inside = np.arange(width) < size[:, None]
        parts = np.where(inside, self.byte[raw], _NO_RANK).ravel()
        pairs = np.full((n, width), _NO_RANK, np.int32)
        pairs[:, :-1] = np.where(inside[:, 1:], self.bytes[raw[:, :-1] * 256 + raw[:, 1:]], _NO_RANK)
        flat, rows = pairs.ravel(), np.arange(n)
        # Where the next and the former part of a row begin; a row's end is beyond its last part.
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        end, start = np.arange(n) * width + size, np.arange(n) * width
        while len(rows):
            now = pairs[rows]
            best = now.argmin(axis=1)
            going = now[np.arange(len(rows)), best] < _NO_RANK
            rows = rows[going]
            at = rows * width + best[going]
            gone = after[at]
            parts[at], parts[gone], flat[gone] = flat[at], _NO_RANK, _NO_RANK
            follows = after[at] = after[gone]
            more = follows < end[rows]
            before[follows[more]] = at[more]
            flat[at] = _NO_RANK
            flat[at[more]] = self._joined(parts[at[more]], parts[follows[more]])
            less = at > start[rows]
            former, here = before[at[less]], at[less]
            flat[former] = self._joined(parts[former], parts[here])
        held = parts != _NO_RANK
        ids, ends = parts[held].astype("<u4").tobytes(), (np.cumsum(held.reshape(n, width).sum(axis=1)) * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *ends], ends)]

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        scanned = []
        for k, word in enumerate(words):
            if word in self.ranks or len(word) > SCANNED_BYTES or not self.plain:
                out[k] = _packed(encode_word(word, self.ranks))
            else:
                scanned.append(k)
        scanned.sort(key=lambda k: len(words[k]), reverse=True)
        begin = 0
        while begin < len(scanned):
            part = scanned[begin : begin + max(1, _CELLS // max(1, len(words[scanned[begin]])))]
            for k, ids in zip(part, self._rows([words[k] for k in part]), strict=True):
                out[k] = ids
            begin += len(part)
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _slices(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows with about ``SLICE_CHARS`` characters each."""
    upto = frame["text"].str.len().fillna(0).cumsum()
    for _, part in frame.groupby((upto // SLICE_CHARS).to_numpy(), sort=True):
        yield part


class _Remembered:
    """Words folded in a worker, in two generations of at most ``REMEMBERED_WORDS``: the older one goes when the newer is full."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        found = self.new.get(word)
        if found is None and (found := self.old.get(word)) is not None:
            self.keep(word, found)
        return found

    def keep(self, word: str, ids: bytes) -> None:
        if len(self.new) >= REMEMBERED_WORDS:
            self.old, self.new = self.new, {}
        self.new[word] = ids


def _of_worker(path: str) -> tuple[_Remembered, Merges]:
    """What this worker keeps for a rank file from one task to the next: words folded before, and the merges."""
    # This module comes anew with each task, so both are kept under a name of their own.
    kept = sys.modules.setdefault("_tickloom_folded_words", types.ModuleType("_tickloom_folded_words")).__dict__
    version = f"{path} {os.stat(path).st_mtime_ns}"
    if version not in kept:
        kept[version] = _Remembered(), Merges(read_ranks(path))
    return kept[version]


def _encoder(pattern: str, path: str, shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, known, (own, merges) = regex.compile(pattern), shared.value, _of_worker(path)

        def folded(words: set[str]) -> dict[str, bytes]:
            """The ids of those of ``words`` that are not shared, by one fold of those not remembered."""
            rare = {w: own.get(w) for w in words if w not in known}
            new = [w for w, ids in rare.items() if ids is None]
            for word, ids in zip(new, merges.fold([w.encode() for w in new]), strict=True):
                rare[word] = ids
                if len(word) <= SCANNED_BYTES:
                    own.keep(word, ids)
            return rare

        def long(text: str) -> bytes:
            # No list of all words is made of a long text.
            found = (m[0] for m in split.finditer(text))
            return b"".join([known.get(w) or folded({w})[w] for w in found])

        def encoded(texts: list[str]) -> list[bytes]:
            words = [split.findall(t) if len(t) < SLICE_CHARS else None for t in texts]
            rare = folded(set().union(*[x for x in words if x]))
            return [long(t) if x is None else b"".join([known.get(w) or rare[w] for w in x]) for t, x in zip(texts, words, strict=True)]

        for frame in frames:
            for part in _slices(frame):
                out = encoded([t or "" for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [np.frombuffer(x, "<i4") for x in out], "ids_le": out})

    return returning(run)


def encode(docs: DataFrame, ranks_path: str, pattern: str, cached: int = CACHED_WORDS) -> DataFrame:
    """(doc_id, ids, ids_le): the ids as an array and as little-endian 32-bit integers."""
    ship_by_value(__name__)
    words = frequent_words(docs, pattern, cached)
    folded: dict[str, bytes] = {}
    for batch in folded_words(words, read_ranks(ranks_path)).toArrow().to_batches():
        ids = batch["ids"]
        flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), np.cumsum(ids.value_lengths().to_numpy()) * 4
        starts = np.concatenate([[0], ends[:-1]])
        folded.update((w, flat[i:j]) for w, i, j in zip(batch["word"].to_pylist(), starts.tolist(), ends.tolist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(folded)
    # The driver keeps nothing of the table: its memory goes back before the documents are read.
    del folded
    release_memory()
    rows = docs.select(id_text(), "text").mapInPandas(_encoder(pattern, ranks_path, shared), ENCODED)
    return rows.select(id_back(), "ids", "ids_le")


def id_pieces(ranks_path: str) -> list[str]:
    """Each id's piece in hex."""
    ranks = read_ranks(ranks_path)
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    return pieces


def decoded(ids: Column, ranks_path: str | Column) -> Column:
    """The bytes that ``ids`` stand for. Instead of a rank file, a column of ``id_pieces`` will do."""
    table = ranks_path if isinstance(ranks_path, Column) else F.from_json(F.lit(json.dumps(id_pieces(ranks_path))), PIECES)
    return bound_once(table, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = with_constant(encode(docs, ranks_path, pattern), "pieces", id_pieces(ranks_path), PIECES)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), F.col("pieces")), 256).alias("decoded_sha256"),
    )
