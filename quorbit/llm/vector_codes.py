"""Product codes of vectors.

Vectors are cut into equal parts, and each part is replaced by the number of its
nearest entry in a small codebook of that part, which a few Lloyd rounds fit. All
arithmetic is on integers, so results do not depend on how rows are dealt.

The nearest entry is found by annular norm pruning: entries are sorted by norm; an
entry at distance d from x has a norm within d of x's, so binary search gives the
annulus of entries that can still be as near as the best one known, and entries
are taken from the middle of the annulus outwards, which narrows it as the best
distance falls. What lies in it, its ends included, is evaluated exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorbit.llm.arrow import arrow_schema
from quorbit.llm.columns import pick
from quorbit.llm.skew import spread_join
from quorbit.session import cut

#: Entries of a codebook, parts of a vector, rounds of fitting, and what a component is multiplied by before it is floored.
ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Entries looked at on each side before the annulus is narrowed again, and how many components of entries are held at once.
STEP, HELD = 16, 1 << 19
#: Whole norms are rounded down, and roots of machine numbers may be one off: so much is added to the annulus on both sides.
ROUNDING = 3
#: Sums leave a task in digits of so many bits, so that Spark's longs hold the sums of 2^31 tasks.
DIGIT = 32
LONGEST = (1 << 63) - 1


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) for finite machine numbers: as int64 where that holds them, else as Python's numbers."""
    scaled = np.floor(values.astype(np.float64) * scale) if values.size and np.abs(values).max() < 2.0**52 / scale else None
    if scaled is None and values.size:
        return np.array([math.floor(v * scale) if abs(v) < 2.0**52 else int(v) * scale for v in values.ravel().tolist()], object).reshape(values.shape)
    return values.astype(np.int64) if scaled is None else scaled.astype(np.int64)


def _narrowest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the kind of number that holds squared distances times the number of entries: doubles, which are whole and exact up to 2^53, int64, or Python's."""
    most = max((int(abs(x).max()) for x in (parts, book) if x.size), default=0)
    greatest = 4 * most * most * max(1, book.shape[1]) * (len(book) + 1)
    kind = np.float64 if greatest < 1 << 52 else np.int64 if greatest < 1 << 62 else object
    return parts.astype(kind), book.astype(kind)


def _norms(rows: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(axis=1)
    return np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64) if rows.dtype != object else np.array([math.isqrt(int(s)) for s in squares], object)


def _reach(squared: np.ndarray) -> np.ndarray:
    if squared.dtype != object:
        return np.floor(np.sqrt(squared.astype(np.float64))).astype(np.int64) + ROUNDING
    return np.array([math.isqrt(int(s)) + ROUNDING for s in squared], object)


class Codebook:
    """One part's entries, sorted by norm for ``nearest``."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = _norms(entries.astype(object))
        self.order = np.array(sorted(range(len(entries)), key=lambda e: (norms[e], e)), np.int64)
        self.norms = norms[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each part's nearest entry, the lower one of equals, and the squared distance."""
        rows = max(1, HELD // (2 * STEP * max(1, parts.shape[1])))
        found = [self._nearest(parts[i : i + rows]) for i in range(0, len(parts), rows)]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, entries = _narrowest(parts, self.entries[self.order])
        size, norms, sorted_norms = len(entries), _norms(parts), self.norms.astype(parts.dtype)
        right = np.minimum(np.searchsorted(sorted_norms, norms), size - 1)  # the first entry looked at, of about the same norm
        left = right.copy()  # looked at: from left up to, not including, right
        best = self._keys(parts, entries, right[:, None])[:, 0]
        right = right + 1
        open_rows = np.arange(len(parts))
        while len(open_rows):
            reach = _reach(best[open_rows] // size)
            low = np.searchsorted(sorted_norms, norms[open_rows] - reach, "left")
            high = np.searchsorted(sorted_norms, norms[open_rows] + reach, "right")
            more = (low < left[open_rows]) | (high > right[open_rows])
            open_rows, low, high = open_rows[more], low[more], high[more]
            if not len(open_rows):
                break
            step = np.arange(STEP)
            places = np.concatenate([left[open_rows, None] - 1 - step, right[open_rows, None] + step], axis=1)
            within = (places >= low[:, None]) & (places < high[:, None])
            keys = self._keys(parts[open_rows], entries, np.clip(places, 0, size - 1))
            best[open_rows] = np.minimum(best[open_rows], np.where(within, keys, best[open_rows, None]).min(axis=1))
            left[open_rows], right[open_rows] = left[open_rows] - STEP, right[open_rows] + STEP
        return (best % size).astype(np.int64), best // size if best.dtype == object else (best // size).astype(np.int64)

    def _keys(self, parts: np.ndarray, entries: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Squared distance, then the entry's number, as one number."""
        apart = entries[places] - parts[:, None, :]
        squared = np.einsum("ijk,ijk->ij", apart, apart) if apart.dtype != object else (apart * apart).sum(axis=2)
        return squared * len(entries) + self.order[places]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def _first(kept: DataFrame, n: int) -> list[tuple]:
    """The n rows of the least (vec_id, vector), nulls last: of each cell of tasks first, so that no task gets n rows from every task."""
    order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    some = kept.withColumn("cell", F.pmod(F.spark_partition_id(), F.lit(n)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(*order))).filter(F.col("place") <= n)
    return [tuple(r) for r in some.orderBy(*order).limit(n).select("vec_id", "vector").collect()]  # n rows


def fit_codebooks(kept: DataFrame, width: int, start: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Lloyd rounds from ``start``. A task sends a sum for each entry; the driver gets one for each entry's component."""
    span = width // parts
    books = [start[:, p * span : (p + 1) * span] for p in range(parts)]
    for _ in range(rounds):
        sums = kept.mapInArrow(_summing(books, width), "part int, entry int, power int, sums array<long>")
        totals = sums.select("part", "entry", "power", F.posexplode("sums").alias("place", "value")).groupBy("part", "entry", "power", "place").agg(F.sum("value").alias("value"))
        held: dict[tuple[int, int], list[int]] = {}
        for part, entry, power, place, value in totals.collect():  # parts x entries x (span + 1) rows of each power
            held.setdefault((part, entry), [0] * (span + 1))[place] += value << (DIGIT * power)
        books = [b.astype(object) for b in books]
        for (part, entry), (count, *values) in held.items():
            books[part][entry] = [v // count for v in values]
    return books


def _summing(books: list[np.ndarray], width: int):
    span, schema = width // len(books), arrow_schema("part int, entry int, power int, sums array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, totals = [Codebook(b) for b in books], [np.zeros((len(b), span + 1), object) for b in books]
        for batch in batches:
            vectors = whole(_matrix(batch.column(0), width))
            for p, book in enumerate(coded):
                part = vectors[:, p * span : (p + 1) * span]
                with_count = np.concatenate([np.ones((len(part), 1), part.dtype), part], axis=1)
                sums = np.zeros((len(book.entries), span + 1), part.dtype)
                np.add.at(sums, book.nearest(part)[0], with_count)
                totals[p] += sums.astype(object)
        out = []
        for p, of_part in enumerate(totals):
            for entry, sums in enumerate(of_part):
                power, left = 0, [int(s) for s in sums]
                while sums[0] and any(left):
                    digits = [int(math.copysign(1, s)) * (abs(s) & ((1 << DIGIT) - 1)) for s in left]
                    out.append((p, entry, power, digits))
                    left, power = [(s - d) >> DIGIT for s, d in zip(left, digits, strict=True)], power + 1
        columns = list(zip(*out, strict=True)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _coding(books: list[np.ndarray], width: int, schema: pa.Schema):
    span = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [Codebook(b) for b in books]
        for batch in batches:
            fits = pa.compute.equal(pa.compute.list_value_length(batch.column(1)), width)
            held = batch.filter(fits)
            vectors = whole(_matrix(held.column(1), width))
            found = [book.nearest(vectors[:, p * span : (p + 1) * span]) for p, book in enumerate(coded)]
            codes = ["".join(f"{e:02x}" for e in entries) for entries in zip(*(f[0].tolist() for f in found), strict=True)]
            errors = [min(LONGEST, sum(map(int, e))) for e in zip(*(f[1].tolist() for f in found), strict=True)]
            where = np.cumsum(fits.to_numpy(zero_copy_only=False)) - 1
            took = pa.array([w if f else None for w, f in zip(where.tolist(), fits.to_pylist(), strict=True)], pa.int64())
            columns = [batch.column(0), batch.column(2), pa.array(codes, pa.string()).take(took), pa.array(errors, pa.int64()).take(took)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, joined by commas, in order of part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for entry in b for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) for each vector kept, and the codebooks, an array of entries for each part.

    Null vectors and those with a null or non-finite component go. Codebooks start
    as the vectors of the ``ENTRIES`` least ids; null ids come last, and rows of one
    id are ordered by their components and start an entry each. Of fewer vectors,
    codebooks are smaller; of none, empty. Vectors are as long as the first of
    these, a multiple of ``PARTS`` (else ValueError); vectors of another length,
    also empty ones, are returned with null code and error, and codebooks do not
    learn from them. Repeated rows count as often as they are there. Components may
    be of any size: beyond what int64 holds they are Python's whole numbers, and an
    error over the greatest long is that. Other columns are not looked at.
    """
    rows = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col)
    kept = rows.filter(_finite(F.col("vector")))
    first = _first(kept, ENTRIES)
    width = len(first[0][1]) if first else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    fits = [v for _, v in first if len(v) == width]
    start = whole(np.array(fits, float).reshape(len(fits), width))
    books = [start[:, :0]] * PARTS
    if width:
        books = fit_codebooks(kept.filter(F.size("vector") == width).select("vector"), width, start)
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = f"vec_id {id_type}, label {label_type}, code string, error long"
    if not width:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), books
    return kept.select("vec_id", "vector", "label").mapInArrow(_coding(books, width, arrow_schema(schema)), schema), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of the same label, nulls being one; a label of many rows is split over tasks."""
    keyed = cut(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = keyed.groupBy("key").agg(F.when(total.isNotNull(), F.least(total, F.lit(LONGEST).cast("decimal(38,0)"))).cast("long").alias("label_error"), F.count("*").alias("n"))
    return spread_join(keyed, sums, ["key"], "n").drop("key", "n")


def op13(embeddings: DataFrame) -> DataFrame:
    coded, books = compress(embeddings)
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
