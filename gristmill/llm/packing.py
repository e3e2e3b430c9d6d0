"""Best-fit packing: pieces of at most ``capacity`` tokens into sequences, bounded space, online.

Tokens are counted without a shuffle. Only (document, piece, length, checksum) rows are shuffled, by a hash of the
piece; each partition packs its stream in windows of ``WINDOW`` pieces, the longest of a window first, and bins that a
window leaves open go on into the next: memory and tightness don't hang on a partition's size. A bitset keyed by free
space has a bit for every free space that some open bin has: the best fit is the lowest set bit at or above the length.
No more than ``open_bins`` bins are open; beyond that the fullest closes, whose bit is the lowest. A partition's last bins
stay part full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import Function, by_task, map_batches, text_of
from gristmill.llm.tokens import ChunkEncoder, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: On 25,291 pieces of check_s that need 12,069 sequences at least: 12,071 with these figures halved, 12,167 without
#: windows, at any number of bins from 256 on.
WINDOW, OPEN_BINS = 8192, 4096


class BestFit:
    """Bins by free space: ``stacks[s]`` has the open bins (id, used) with ``s`` free, and bit ``s`` is set where it has any."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most, self.open, self.next, self.bits = capacity, open_bins, 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _put(self, free: int, bin_id: int) -> None:
        self.stacks[free].append(bin_id)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        bin_id = self.stacks[free].pop()
        if not self.stacks[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """The piece's bin and offset. ``length`` is from 1 to the capacity."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id, self.next = self.capacity, self.next, self.next + 1
            if length < free and self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        if free > length:
            self._put(free - length, bin_id)
        return bin_id, self.capacity - free


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_column: str = "doc_id") -> DataFrame:
    """A row for each piece of each document's ids and the closing ``end_id``: id, piece, start, length, ids_crc32.

    Null and empty texts are the closing id alone. Repeated rows each give their pieces. Texts are encoded whole. Ids of any
    type; other columns are left out; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_column]

    def start() -> Function:
        coder, end = ChunkEncoder(path), np.array([end_id], np.uint32)

        def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, own in enumerate(coder.encode_batch(batch.column(1).to_pylist())):
                ids = np.concatenate((own, end))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for column, value in zip(out, (row, k, at, len(part), zlib.crc32(part.astype("<u4").tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0])), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=[id_column, "piece", "start", "length", "ids_crc32"]
            )

        return cut

    return by_task(docs.select(id_column, text_of().alias("text")), start, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, window: int = WINDOW) -> DataFrame:
    """``pieces`` (with a length from 1 to ``capacity``) with sequence_id and offset added; other columns stay, those of
    the added names give way. Rows alike have a place each; an empty table gives an empty result.

    Sequence ids are unique, not dense. A task that runs again sorts and packs alike.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*columns)
    dealt = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bins, held, rows = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins), [], 0

        def give() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            lengths = table.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            placed = [bins.place(n) for n in lengths[order].tolist()]
            added = [pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            (batch,) = table.take(pa.array(order)).combine_chunks().to_batches()
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, "sequence_id", "offset"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, window - rows))
                rows, at = rows + held[-1].num_rows, at + held[-1].num_rows
                if rows == window:
                    yield from give()
                    held, rows = [], 0
        if rows:
            yield from give()

    return map_batches(pieces.repartition(dealt).sortWithinPartitions(dealt, *(F.col(f"`{c}`") for c in columns)), run, schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` packed into sequences of 2,048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, vocabulary_path(VOCABULARY)))
