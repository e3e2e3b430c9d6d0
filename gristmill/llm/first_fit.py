"""First-fit decreasing packing with a tournament tree, in randomised groups of documents.

A document's ids are cut into full sequences and one rest, without a shuffle; rests alone have to be packed. They are
dealt at random into groups of about ``GROUP``, and each group is packed by itself: longest first, into the first bin with
room, which a tournament tree over the bins' free space finds in a step a level. As documents may be cut anywhere, the bins
that stay part full are closed from the fullest on by what the emptiest hold, and the one that is left goes into sequences
of a power of two each, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import Function, by_task, map_batches, text_of, written
from gristmill.llm.tokens import ByteEncoder, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
#: Rests of a group, about; a group has a bin a rest at most.
GROUP = 2048
#: Columns of the result besides the id; those of the input that have these names are left out.
ADDED = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Tournament:
    """Free space of ``bins`` bins; each node has the most that is below it, so that the first bin with room is found
    from the top."""

    def __init__(self, bins: int, capacity: int):
        self.base = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.base)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin that has room for ``length``, and its free space before."""
        most, base, node = self.most, self.base, 1
        while node < base:
            node *= 2
            if most[node] < length:
                node += 1
        bin_, free = node - base, most[node]
        most[node] = left = free - length
        while node > 1:
            other = most[node ^ 1]
            node //= 2
            left = left if left > other else other
            if most[node] == left:
                break
            most[node] = left
        return bin_, free


Part = tuple[int, int, int]  # row, first id, length


def first_fit(lengths: list[int], capacity: int) -> list[list[Part]]:
    """Bins of whole rows; ``lengths`` fall, each from 1 to ``capacity``."""
    tree, bins = Tournament(len(lengths), capacity), []
    for row, length in enumerate(lengths):
        at, _ = tree.place(length)
        if at == len(bins):
            bins.append([])
        bins[at].append((row, 0, length))
    return bins


def topped_up(bins: list[list[Part]], capacity: int) -> list[list[Part]]:
    """``bins`` with every one full but those of the last bin's ids, which have a power of two each. The bins that have
    room take, the fullest first, from the end of the emptiest."""
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted((k for k, n in enumerate(used) if n < capacity), key=lambda k: (-used[k], k))
    first, last = 0, len(order) - 1
    while first < last:
        taker, giver = bins[order[first]], bins[order[last]]
        row, start, length = giver.pop()
        take = min(length, capacity - used[order[first]])
        if take < length:
            giver.append((row, start, length - take))
        taker.append((row, start + length - take, take))
        used[order[first]] += take
        used[order[last]] -= take
        first += used[order[first]] == capacity
        last -= not used[order[last]]
    if first == last and (left := used[order[first]]) & (left - 1):
        parts, bins[order[first]] = bins[order[first]][::-1], []
        for size in (1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1):
            own: list[Part] = []
            while size:
                row, start, length = parts.pop()
                take = min(length, size)
                own.append((row, start, take))
                size -= take
                if take < length:
                    parts.append((row, start + take, length - take))
            bins.append(own)
    return [b for b in bins if b]


def rests(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_column: str = "doc_id") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, ids): each document's pieces of ``capacity`` ids, and its rest with the
    ids themselves, in two bytes each where they fit, else in four. Null and empty texts are the closing id alone."""

    def start() -> Function:
        coder, end = ByteEncoder(path), np.array([end_id], np.uint32)

        def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for k, own in enumerate(coder.encode_batch(batch.column(1).to_pylist())):
                ids = np.concatenate((own, end))
                n = len(ids)
                whole = n - n % capacity
                rows += [(k, at, capacity, zlib.crc32(ids[at : at + capacity].astype("<u4").tobytes()), n, None) for at in range(0, whole, capacity)]
                if whole < n:
                    rest = ids[whole:]
                    rows.append((k, whole, n - whole, None, n, rest.astype("<u2" if rest.max() < 1 << 16 else "<u4").tobytes()))
            which, *columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_column, "start", "length", "ids_crc32", "doc_tokens", "ids"]
            )

        return cut

    kind = dict(docs.dtypes)[id_column]
    return by_task(docs.select(id_column, text_of().alias("text")), start, f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack_first_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_column: str = "doc_id", group: int = GROUP, seed: int = 11) -> DataFrame:
    """A row for each piece of each document's ids and the closing ``end_id``: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Sequences have ``capacity`` ids or, a few of a group, a power of two.

    Null and empty texts are the closing id alone; rows alike, or that repeat an id, are packed each; a text of any
    length is encoded whole; other columns are left out, clashing names among them; an empty table gives an empty result.
    Groups are random by the row's place in the written pieces, not by its values, so that rows alike spread, and a task
    that runs again packs alike. Sequence ids are unique, not dense.
    """
    table = written(rests(docs, path, capacity, end_id, id_column), "rests").withColumn("at", F.monotonically_increasing_id())
    full = table.where("ids IS NULL").select(id_column, "start", "length", "ids_crc32", "doc_tokens", (F.col("at") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    some = table.where("ids IS NOT NULL")
    groups = max(1, -(-some.count() // group))
    dealt = some.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(groups)))
    kind = dict(docs.dtypes)[id_column]

    def packed(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        starts, lengths, tokens = (rows.column(k).to_numpy() for k in (1, 2, 4))
        ids = [np.frombuffer(x.as_buffer(), "<u2" if len(x.as_buffer()) == 2 * n else "<u4").astype("<u4") for x, n in zip(rows.column(3), lengths.tolist(), strict=True)]
        out: list[tuple[int, ...]] = []
        for k, parts in enumerate(topped_up(first_fit(lengths.tolist(), capacity), capacity)):
            offset = 0
            for row, first, length in parts:
                out.append((row, first, length, zlib.crc32(ids[row][first : first + length].tobytes()), 2 * (number << 24 | k), offset))
                offset += length
        which, first, *rest = (np.array(c, np.int64) for c in zip(*out, strict=True))
        columns = [starts[which] + first, rest[0], rest[1], tokens[which], rest[2], rest[3]]
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(which)), *map(pa.array, columns)], names=[id_column, *ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(5).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and numbers[a] != now:
                    yield from packed(held, now)
                    held = []
                now = int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from packed(held, now)

    rows = dealt.select(id_column, "start", "length", "ids", "doc_tokens", "group", "at").repartition("group").sortWithinPartitions("group", F.col("length").desc(), "at").drop("at")
    schema = f"`{id_column}` {kind}, " + ", ".join(f"`{c}` long" for c in ADDED)
    return full.unionByName(map_batches(rows, run, schema))


def op11_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` packed into sequences of 1,024 tokens."""
    return pack_first_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(VOCABULARY))
