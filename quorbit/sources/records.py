"""Record files of wavefunctions, as a data source that reads ranges of records and writes many files.

All numbers are little-endian and take 8 bytes. A file of the general form has the
number of states and of words a state, the states' words, least significant
first, and the coefficients. One of the product form has the numbers of alpha
halves, of beta halves and of words, the words of both, and the coefficients of
all pairs, alpha-major. A complex coefficient is its real and its imaginary
part. Files are named by the prefix and a number of six digits, with ``.bin`` in
the general form; each is complete by itself.

A file is read by many tasks, a range of coefficients each, so no task holds a
file. Written files are of ``MOST_IN_FILE`` coefficients at most. They are renamed once all
tasks are done, so attempts that fail leave none behind.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quorbit.functions import bits as B
from quorbit.functions import complex as X
from quorbit.operators.apply import normalized
from quorbit.operators.edges import match_checkpoint
from quorbit.operators.select import ranked
from quorbit.sources.files import product_on_basis

#: Coefficients of a written file, of a task that reads, and of a batch that it makes.
MOST_IN_FILE, IN_TASK, IN_BATCH = 1 << 20, 1 << 22, 1 << 16
#: Bits of a record's word, where nothing else is said.
RECORD_BITS = 20


# -- words ---------------------------------------------------------------------


def reworded(words: np.ndarray, width: int, old: int, new: int) -> np.ndarray:
    """Rows of words of ``old`` bits, 64 at most, as words of ``new`` bits, least significant first."""
    out = np.zeros((len(words), -(-width // new)), np.uint64)
    for k in range(out.shape[1]):
        for j in range(words.shape[1]):
            shift = j * old - k * new
            if -old < shift < new:
                out[:, k] |= words[:, j] << np.uint64(shift) if shift >= 0 else words[:, j] >> np.uint64(-shift)
        out[:, k] &= np.uint64((1 << min(new, width - k * new)) - 1)
    return out


def states_from(words: np.ndarray, width: int) -> pa.Array:
    """Keys of words of ``WORD_BITS``: whole numbers, or arrays of the words beyond that width."""
    if width <= B.WORD_BITS:
        return pa.array(words[:, 0].astype(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.reshape(-1).astype(np.int64)))


def words_of(states: pa.Array, width: int) -> np.ndarray:
    """The words of keys, as rows of uint64."""
    if states.null_count:
        raise ValueError("a null is no state")
    flat = states if width <= B.WORD_BITS else states.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.uint64).reshape(len(states), -(-width // B.WORD_BITS))


def coefficients(values: pa.Array) -> np.ndarray:
    if values.null_count:
        raise ValueError("a null is no coefficient")
    if pa.types.is_struct(values.type):
        re, im = (values.field(n).to_numpy(zero_copy_only=False) for n in ("re", "im"))
        return re.astype("<f8") + 1j * im.astype("<f8")
    return values.to_numpy(zero_copy_only=False).astype("<f8")


def coefficient_column(values: np.ndarray) -> pa.Array:
    if values.dtype.kind == "c":
        return pa.StructArray.from_arrays([pa.array(values.real.copy()), pa.array(values.imag.copy())], ["re", "im"])
    return pa.array(values)


# -- files ---------------------------------------------------------------------


@dataclass
class Form:
    """What a file's bytes mean, and where they are; made of the source's options."""

    prefix: str
    width: int
    word_bits: int
    product: bool
    is_complex: bool
    in_file: int
    in_task: int
    in_batch: int

    @classmethod
    def of(cls, options: dict[str, str]) -> Form:
        prefix = re.sub("^file:/(?!/)", "file:///", options["path"])
        word_bits = int(options.get("word_bits", RECORD_BITS))
        if not 1 <= word_bits <= 64:
            raise ValueError(f"words of {word_bits} bits")
        sizes = [int(options.get(n, size)) for n, size in (("in_file", MOST_IN_FILE), ("in_task", IN_TASK), ("in_batch", IN_BATCH))]
        return cls(prefix, int(options["width"]), word_bits, options.get("product") == "true", options.get("complex") == "true", *sizes)

    @property
    def words(self) -> int:
        return -(-self.width // self.word_bits)

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<c16" if self.is_complex else "<f8")

    @property
    def schema(self) -> str:
        state = "bigint" if self.width <= B.WORD_BITS else "array<bigint>"
        halves = f"adet {state}, bdet {state}" if self.product else f"det {state}"
        return f"{halves}, c {'struct<re: double, im: double>' if self.is_complex else 'double'}"

    def place(self) -> tuple[fs.FileSystem, str, str]:
        """The store, its folder and the names' beginning."""
        store, inner = fs.FileSystem.from_uri(self.prefix)
        folder, _, base = inner.rpartition("/")
        return store, folder, base

    def name(self, number: int) -> str:
        _, folder, base = self.place()
        return f"{folder}/{base}{number:06d}{'' if self.product else '.bin'}"

    def found(self) -> list[str]:
        """The files that are there, in order of their numbers."""
        store, folder, base = self.place()
        named = re.compile(re.escape(base) + r"(\d{6,})" + ("" if self.product else r"\.bin"))
        held = [(int(m[1]), f.path) for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if (m := named.fullmatch(f.base_name))]
        return [path for _, path in sorted(held)]

    def head(self, file: pa.NativeFile, path: str) -> tuple[int, ...]:
        """A file's counts, of states or of halves, once its size is that of what they say."""
        size = 24 if self.product else 16
        told = file.read(size)
        counts = tuple(int(x) for x in np.frombuffer(told, "<u8")) if len(told) == size else ()
        if not counts or counts[-1] != self.words and sum(counts[:-1]):
            raise ValueError(f"{path}: not records of {self.words} words a state")
        counts = counts[:-1]
        if file.size() != size + 8 * self.words * sum(counts) + self.kind.itemsize * int(np.prod(counts, dtype=object)):
            raise ValueError(f"{path}: its size is not that of {counts} states")
        return counts

    def read_states(self, file: pa.NativeFile, at: int, n: int) -> pa.Array:
        """``n`` states from the one numbered ``at`` on."""
        raw = file.read_at(8 * self.words * n, (24 if self.product else 16) + 8 * self.words * at)
        return states_from(reworded(np.frombuffer(raw, "<u8").reshape(n, self.words), self.width, self.word_bits, B.WORD_BITS), self.width)

    def read_range(self, file: pa.NativeFile, counts: tuple[int, ...], start: int, end: int) -> pa.RecordBatch:
        """Rows of the coefficients ``start`` to ``end``; of the product form, states are read once for each half."""
        at = (24 if self.product else 16) + 8 * self.words * sum(counts) + self.kind.itemsize * start
        c = coefficient_column(np.frombuffer(file.read_at(self.kind.itemsize * (end - start), at), self.kind))
        if not self.product:
            return pa.RecordBatch.from_arrays([self.read_states(file, start, end - start), c], ["det", "c"])
        n_alpha, n_beta = counts
        top, bottom = start // n_beta, (end - 1) // n_beta + 1
        left, right = (start % n_beta, (end - 1) % n_beta + 1) if bottom - top == 1 else (0, n_beta)
        cells = np.arange(start, end)
        alpha = self.read_states(file, top, bottom - top).take(pa.array(cells // n_beta - top))
        beta = self.read_states(file, n_alpha + left, right - left).take(pa.array(cells % n_beta - left))
        return pa.RecordBatch.from_arrays([alpha, beta, c], ["adet", "bdet", "c"])


class RecordReader(DataSourceReader):
    def __init__(self, form: Form) -> None:
        self.form = form

    def partitions(self) -> list[InputPartition]:
        """Ranges of coefficients; of a file only its header comes to the driver."""
        store, parts, paths = self.form.place()[0], [], self.form.found()
        if not paths:
            raise FileNotFoundError(f"no record files at {self.form.prefix}")
        for path in paths:
            with store.open_input_file(path) as file:
                counts = self.form.head(file, path)
            total = int(np.prod(counts, dtype=object))
            parts += [InputPartition((path, counts, at, min(at + self.form.in_task, total))) for at in range(0, total, self.form.in_task)]
        return parts or [InputPartition((paths[0], (), 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, counts, start, end = partition.value
        with self.form.place()[0].open_input_file(path) as file:
            while start < end:
                to = min(start + self.form.in_batch, end)
                if self.form.product and counts[1] > self.form.in_batch:  # within one alpha half, so only a range of betas is read
                    to = min(to, (start // counts[1] + 1) * counts[1])
                yield self.form.read_range(file, counts, start, to)
                start = to


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class RecordWriter(DataSourceArrowWriter):
    """Rows of the general form as they come; of the product form sorted by ``tile``, each of which becomes a file."""

    def __init__(self, form: Form, overwrite: bool) -> None:
        self.form, self.overwrite, self.token = form, overwrite, uuid.uuid4().hex

    def _aside(self) -> str:
        _, folder, base = self.form.place()
        return f"{folder}/_{base}-{self.token}"

    def _file(self, head: list[int], states: list[np.ndarray], c: np.ndarray) -> str:
        store, path = self.form.place()[0], f"{self._aside()}/{uuid.uuid4().hex}"
        store.create_dir(self._aside(), recursive=True)
        with store.open_output_stream(path) as file:
            file.write(np.array([*head, self.form.words], "<u8").tobytes())
            for held in states:
                file.write(reworded(held, self.form.width, B.WORD_BITS, self.form.word_bits).astype("<u8").tobytes())
            file.write(c.astype(self.form.kind).tobytes())
        return path

    def _plain(self, batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        held, n, most = [], 0, self.form.in_file
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                if held and n + piece.num_rows > most:
                    yield self._flush(held)
                    held, n = [], 0
                held.append((words_of(piece.column("det"), self.form.width), coefficients(piece.column("c"))))
                n += piece.num_rows
        if held:
            yield self._flush(held)

    def _flush(self, held: list[tuple[np.ndarray, np.ndarray]]) -> str:
        states, c = np.concatenate([s for s, _ in held]), np.concatenate([v for _, v in held])
        return self._file([len(states)], [states], c)

    def _tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        held, now = [], None
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if held and tiles[start] != now:
                    yield self._tile(held)
                    held = []
                now, piece = tiles[start], batch.slice(start, end - start)
                held.append((words_of(piece.column("adet"), self.form.width), words_of(piece.column("bdet"), self.form.width), coefficients(piece.column("c"))))
        if held:
            yield self._tile(held)

    def _tile(self, held: list[tuple[np.ndarray, ...]]) -> str:
        """All pairs of a tile's halves; pairs without a row are zero, and repeated ones add up."""
        alpha, beta, c = (np.concatenate(x) for x in zip(*held, strict=True))
        (alphas, a), (betas, b) = (np.unique(x[:, ::-1], axis=0, return_inverse=True) for x in (alpha, beta))
        cells = np.zeros((len(alphas), len(betas)), self.form.kind)
        np.add.at(cells, (a.reshape(-1), b.reshape(-1)), c)
        return self._file([len(alphas), len(betas)], [alphas[:, ::-1], betas[:, ::-1]], cells.reshape(-1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(list(self._tiles(iterator) if self.form.product else self._plain(iterator)))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Names the files in order of the tasks, after those that are there, or in their place; without a row, one file of none."""
        store, there = self.form.place()[0], self.form.found()
        made = [path for m in messages if m for path in m.paths]
        none = [np.zeros((0, -(-self.form.width // B.WORD_BITS)), np.uint64)]
        if not made and (self.overwrite or not there):
            made = [self._file([0, 0], none * 2, np.zeros(0)) if self.form.product else self._file([0], none, np.zeros(0))]
        first = 0
        if self.overwrite:
            for path in there:
                store.delete_file(path)
        elif there:
            first = int(re.search(r"(\d+)(\.bin)?$", there[-1])[1]) + 1
        for number, path in enumerate(made, first):
            store.move(path, self.form.name(number))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store = self.form.place()[0]
        if store.get_file_info(self._aside()).type == fs.FileType.Directory:
            store.delete_dir(self._aside())


class WaveRecords(DataSource):
    """Options: path (the names' beginning), width, word_bits, product, complex; in_file, in_task, in_batch (numbers of coefficients)."""

    @classmethod
    def name(cls) -> str:
        return "wave_records"

    def schema(self) -> str:
        return Form.of(self.options).schema

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(Form.of(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(Form.of(self.options), overwrite)


# -- tables --------------------------------------------------------------------


def _options(path: str, width: int, word_bits: int, product: bool, is_complex: bool) -> dict[str, str]:
    return {"path": path, "width": str(width), "word_bits": str(word_bits), "product": str(product).lower(), "complex": str(is_complex).lower(), "in_file": str(MOST_IN_FILE), "in_task": str(IN_TASK), "in_batch": str(IN_BATCH)}


def read_wave_records(spark: SparkSession, path: str, width: int, word_bits: int = RECORD_BITS, product: bool = False, is_complex: bool = False) -> DataFrame:
    """(det, c), or (adet, bdet, c) of the product form, whose ``width`` is a half's, of all files with that prefix."""
    spark.dataSource.register(WaveRecords)
    return spark.read.format("wave_records").options(**_options(path, width, word_bits, product, is_complex)).load()


def save_wave_records(wave: DataFrame, path: str, width: int, word_bits: int = RECORD_BITS, mode: str = "overwrite") -> None:
    """(det, c) rows, ordered by state from file to file; ``c`` is real or complex. ``append`` numbers on from the files that are there."""
    wave.sparkSession.dataSource.register(WaveRecords)
    rows = wave.select("det", "c").orderBy(B.word_order("det") if width > B.WORD_BITS else F.col("det"))
    rows.write.format("wave_records").options(**_options(path, width, word_bits, False, X.is_complex(wave, "c"))).mode(mode).save()


def save_product_records(wave: DataFrame, path: str, width: int, word_bits: int = RECORD_BITS, mode: str = "overwrite") -> None:
    """(adet, bdet, c) rows in tiles of halves, ``MOST_IN_FILE`` pairs each at most; pairs without a row are written as zero, and repeated ones added up."""
    wave.sparkSession.dataSource.register(WaveRecords)
    is_complex = X.is_complex(wave, "c")
    once = wave.groupBy("adet", "bdet").agg(X.total("c", is_complex).alias("c"))
    place = lambda half: ranked(wave.select(half).distinct().withColumn("same", F.lit(0)), "same", half).select(half, F.col("position").alias(f"{half}_at"))
    alphas, betas = place("adet"), place("bdet")
    columns = max(1, min(betas.count(), MOST_IN_FILE))
    lines, across = max(1, MOST_IN_FILE // columns), F.lit(betas.count() // columns + 1)
    tile = F.floor(F.col("adet_at") / lines) * across + F.floor(F.col("bdet_at") / columns)
    rows = once.join(alphas, "adet").join(betas, "bdet").select(tile.cast("long").alias("tile"), "adet", "bdet", "c")
    rows.repartition("tile").sortWithinPartitions("tile").write.format("wave_records").options(**_options(path, width, word_bits, True, is_complex)).mode(mode).save()


def load_wave_records(spark: SparkSession, path: str, basis: DataFrame, width: int, word_bits: int = RECORD_BITS, is_complex: bool = False) -> DataFrame:
    """On the basis, normalized: missing states are zero, others' coefficients go."""
    return normalized(match_checkpoint(basis, read_wave_records(spark, path, width, word_bits, False, is_complex)))


def load_product_records(spark: SparkSession, path: str, basis: DataFrame, width: int, word_bits: int = RECORD_BITS) -> DataFrame:
    """As above for real coefficients of (adet, bdet)."""
    return product_on_basis(read_wave_records(spark, path, width, word_bits, True), basis)
