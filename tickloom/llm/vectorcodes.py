"""Vector code compression: a code of eight codebook indexes per vector, found through memoised grid cells.

A component x becomes the integer floor(4096 * x), so that sums are exact and no
order of rows changes a result. Vectors are cut into equal parts; each part
position has a codebook, which starts as that part of the smallest ids' vectors
and is replaced round by round by the floored means of the parts nearest to its
entries.

The nearest entry is looked for by grid cells. A part's components, without
their low ``CELL_BITS`` bits, name the cell it lies in. An entry is dominated in
a cell if another one is nearer in all of its box: the difference of two squared
distances is linear in each component, so its largest value across the box is
the sum of the larger of its values at each component's ends. The entries that
no other dominates are kept in a memo under the cell, and only those are
evaluated for the parts in it. Ties go to the lower index, in boxes and exactly.

A round is one pass over the written vectors: tasks add up parts by entry, Spark
sums their sums, and the driver gets one row per part, entry and component,
however many vectors there are. A memo lives for one task and one round.

Vectors that are null or hold null or non-finite components take no part; with
fewer vectors than entries there are fewer entries. Null ids come last. Equal
ids are ordered by their vectors, and each row gets its own code. Lengths that
are no multiple of eight, or differ, are filled up with zeros. Components beyond
+-8,192 count as that, which keeps distances within 64 bits. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import small, written
from tickloom.session import ship_by_value

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Width of a cell, as a power of two. Cells that a memo holds at most before it starts again.
CELL_BITS, CELLS_MOST = 9, 200_000
LARGEST = 1 << 25


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integer_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the usable vectors, all of one length, and that length."""
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).where(usable(F.col("x")))
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    length = max(parts, -(-longest // parts) * parts)

    def whole(x: Column) -> Column:
        return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * scale))).cast("bigint")

    filled = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("x")))
    rows = kept.select("vec_id", "label", F.transform(filled, whole).alias("v"))
    return written(rows, "vectors"), length


def _undominated(cells: np.ndarray, book: np.ndarray, bits: int) -> np.ndarray:
    """Per cell, one bit for each entry that no other one is nearer than in all of the cell's box."""
    # Twice the cells' centres, and twice their half widths, keep all in integers.
    centre, width = (cells << bits) * 2 + (1 << bits) - 1, (1 << bits) - 1
    norm = (book * book).sum(1)
    slope = 2 * (book[:, None] - book[None])
    # Twice the most by which f is farther than e anywhere in the box: e by f along the last two axes.
    fixed = width * np.abs(slope).sum(2) + 2 * (norm[None] - norm[:, None])
    size = int(np.abs(centre).max(initial=0)) * int(np.abs(slope).max(initial=0)) * cells.shape[1] + int(np.abs(fixed).max(initial=0))
    kind = np.float64 if size < 1 << 53 else np.int64  # exact either way; the product of floats is far quicker
    e_f = slope.reshape(-1, cells.shape[1]).T.astype(kind)
    most = (centre.astype(kind) @ e_f).reshape(len(cells), len(book), len(book)) + fixed.astype(kind)
    index = np.arange(len(book))
    nearer = (most < 0) | ((most == 0) & (index[None] < index[:, None]))
    nearer[:, index, index] = False
    return ((~nearer.any(2)).astype(np.int64) << index).sum(1)


def nearest(points: np.ndarray, book: np.ndarray, memo: dict[bytes, int], bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry, and the squared distance, by the entries its cell's memo names."""
    cells = np.ascontiguousarray(points >> bits)
    keys = cells.view(np.dtype((np.void, cells.shape[1] * cells.itemsize))).ravel()
    distinct, first, cell_of = np.unique(keys, return_index=True, return_inverse=True)
    names = [k.tobytes() for k in distinct]
    if len(memo) > CELLS_MOST:
        memo.clear()
    new = [i for i, name in enumerate(names) if name not in memo]
    if new:
        found = _undominated(cells[first[new]], book, bits)
        memo.update(zip((names[i] for i in new), found.tolist()))
    mask = np.array([memo[name] for name in names], np.int64)[cell_of.ravel()]
    index, best = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
    for e in range(len(book)):
        rows = np.flatnonzero(mask >> e & 1)
        away = points[rows] - book[e]
        distance = (away * away).sum(1)
        nearer = distance < best[rows]
        index[rows[nearer]], best[rows[nearer]] = e, distance[nearer]
    return index, best


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)


def _part_sums(books: np.ndarray, length: int):
    """Per part and entry: how many parts are nearest to it (position -1), and the sum of each component."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict[bytes, int]] = [{} for _ in range(parts)]
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            rows = _matrix(batch, length)
            for p in range(parts):
                points = rows[:, p * width : (p + 1) * width]
                index, _ = nearest(points, books[p], memos[p])
                sums[p, :, 0] += np.bincount(index, minlength=entries)
                np.add.at(sums[p, :, 1:], index, points)
        p, e, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(at - 1, pa.int32()), pa.array(sums[p, e, at])],
            names=["part", "entry", "at", "total"],
        )

    return run


def _coder(books: np.ndarray, length: int):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict[bytes, int]] = [{} for _ in range(parts)]
        for batch in batches:
            rows = _matrix(batch, length)
            code, error = np.empty((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                index, distance = nearest(rows[:, p * width : (p + 1) * width], books[p], memos[p])
                code[:, p] = index
                error += distance
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def fit(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of the written integer ``vectors``, after all rounds."""
    ship_by_value(__name__)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    width = length // parts
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        sums = vectors.select("v").mapInArrow(_part_sums(books, length), "part int, entry int, at int, total bigint")
        total = np.zeros((parts, len(first), width + 1), np.int64)
        # One row per part, entry and component.
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect():
            total[r["part"], r["entry"], r["at"] + 1] = r["total"]
        used = total[:, :, 0] > 0
        books[used] = total[:, :, 1:][used] // total[:, :, :1][used]
    return books


def encode(vectors: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """(vec_id, label, code, error) of the integer ``vectors``: two hex digits per part, and the squared distance."""
    ship_by_value(__name__)
    kind = vectors.schema["label"].dataType.simpleString()
    if not books.size:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    return vectors.mapInArrow(_coder(books, length), f"vec_id bigint, label {kind}, code string, error bigint")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """Per usable vector: vec_id, code, error, label_error (the error of all vectors of its label), codebooks_sha256."""
    rows, length = integer_vectors(vectors.select(F.col("vec_id").cast("bigint"), "embedding", "label"))
    books = fit(rows, length)
    coded = written(encode(rows, books, length), "codes")
    by_label = small(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
