"""Media columns: ISO base media files in binary columns, written, walked and described without decoding payloads.

``write_track`` stores a payload as one track of 8-bit samples; ``describe`` walks nested boxes, decodes the sample
tables (stts, stsc, stsz, stco or co64, stss) and those of movie fragments (tfhd, trun) and gives codec, duration and the
byte ranges of samples and keyframes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.common import by_batch, text_of

UNIT = 64
GROUP = 16
CHUNK = 256
RATE = 8000
#: Bytes of files that a task holds at once, or one file.
AT_ONCE = 8 << 20
#: Boxes that hold boxes; fixed by ISO/IEC 14496-12.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"})
DEEPEST = 32
#: A sample's flag that says it is no sync sample; fixed by the same.
NOT_SYNC = 0x10000
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_track(payload: bytes, unit: int = UNIT, group: int = GROUP, chunk: int = CHUNK, rate: int = RATE, codec: bytes = b"raw ") -> bytes:
    """An ISO media file with ``payload`` (a multiple of ``unit``) as unsigned 8-bit mono samples: access units of ``unit``
    bytes, the first of each ``group`` marked as a sync sample, ``chunk`` units to a chunk."""
    units = len(payload) // unit
    if not units or len(payload) % unit:
        raise ValueError(f"the payload must be a positive multiple of {unit} bytes")
    chunks = -(-units // chunk)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    keys = range(1, units + 1, group)
    runs = [(1, chunk)] if units % chunk == 0 else [(1, chunk)] * (chunks > 1) + [(chunks, units - (chunks - 1) * chunk)]
    wide = len(payload) + (16 << 20) + units >= 1 << 32

    def moov(first: int) -> bytes:
        places = [first + k * chunk * unit for k in range(chunks)]
        entry = box(codec, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, unit)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, n, 1) for a, n in runs)),
            full(b"stsz", struct.pack(">II", unit, units)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *places)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        length = struct.pack(">Q", len(payload))
        mdia = box(b"mdia", full(b"mdhd", bytes(16), struct.pack(">I", rate), length, struct.pack(">HH", 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", bytes(16), struct.pack(">II", 1, 0), length, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", bytes(16), struct.pack(">I", rate), length, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + box(b"mdat", payload)


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, start, body start, body end) of every box, nested ones after their container, with a stack. A size beyond
    the end is cut there; less than a box header, or a size below the header's, ends the walk of that level. No file nests
    containers ``DEEPEST`` deep: what lies deeper isn't walked."""
    work: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while work:
        start, end, path = work.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        to = end if size == 0 else min(end, start + size)
        if to < body:
            continue
        yield (*path, kind), start, body, to
        work.append((to, end, path))
        if kind in CONTAINERS and len(path) < DEEPEST:
            work.append((body, to, (*path, kind)))


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)  # from 0

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def ranges(self, samples: list[int] | range) -> list[tuple[int, int]]:
        """(start, end) of each sample in the file, end exclusive."""
        return [(self.offsets[k], self.offsets[k] + self.sizes[k]) for k in samples if k < len(self.offsets)]


def _table(data: memoryview, at: int, end: int, form: str) -> list[tuple]:
    """A counted table's rows; a count beyond the box is cut to what is there."""
    width, count = struct.calcsize(f">{form}"), struct.unpack_from(">I", data, at)[0]
    count = min(count, (end - at - 4) // width)
    return list(struct.iter_unpack(f">{form}", data[at + 4 : at + 4 + count * width]))


@dataclass
class Fragment:
    """What a track fragment's header says: its track's number, where its data are counted from and have come to, and
    its samples' defaults."""

    number: int = 0
    base: int = 0
    at: int = 0
    length: int = 0
    size: int = 0
    flags: int = 0


def _fields(data: memoryview, at: int, flags: int, known: tuple[tuple[int, str, str], ...]) -> tuple[dict[str, int], int]:
    """The optional fields that ``flags`` has, in order, and the place behind them."""
    out = {}
    for bit, name, form in known:
        if flags & bit:
            (out[name],) = struct.unpack_from(f">{form}", data, at)
            at += struct.calcsize(form)
    return out, at


def _run(data: memoryview, at: int, end: int, fragment: Fragment) -> list[tuple[int, int, int, bool]]:
    """(place, size, length, key) of a run's samples (trun). A count beyond the box, or beyond the file, is cut."""
    head, count = struct.unpack_from(">II", data, at)
    flags = head & 0xFFFFFF
    own, at = _fields(data, at + 8, flags, ((0x1, "offset", "i"), (0x4, "first", "I")))
    place = fragment.base + own["offset"] if "offset" in own else fragment.at
    columns = [name for bit, name in ((0x100, "length"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if columns:
        count = min(count, (end - at) // (4 * len(columns)))
        rows = [dict(zip(columns, row, strict=True)) for row in struct.iter_unpack(f">{len(columns)}I", data[at : at + count * 4 * len(columns)])]
    else:
        rows = [{}] * min(count, (len(data) - place) // fragment.size if fragment.size and place >= 0 else 0)
    out = []
    for k, row in enumerate(rows):
        size = row.get("size", fragment.size)
        said = own["first"] if k == 0 and "first" in own else row.get("flags", fragment.flags)
        out.append((place, size, row.get("length", fragment.length), not said & NOT_SYNC))
        place += size
    fragment.at = place
    return out


def describe(data: bytes) -> list[Track]:
    """The tracks of an ISO media file, from its boxes alone; fragments go on with the track of their number, wherever
    they stand. Bytes that are no such file, or end early, give fewer."""
    view, tracks = memoryview(data), []
    tables: dict[bytes, list[tuple]] = {}
    defaults: dict[int, tuple[int, int, int]] = {}  # a track's (length, size, flags) of samples in fragments
    samples: dict[int, list[tuple[int, int, int, bool]]] = defaultdict(list)  # a track's in fragments
    fixed = units = moof = 0
    fragment = Fragment()

    def close() -> None:
        track, runs = tracks[-1], tables.get(b"stsc", [])
        track.sizes = [fixed] * min(units, len(data) // fixed) if fixed else [n for (n,) in tables.get(b"sizes", [])]
        track.duration = track.duration or sum(n * d for n, d in tables.get(b"stts", []))
        k = run = 0
        for number, (place,) in enumerate(tables.get(b"chunks", []), 1):
            while run + 1 < len(runs) and runs[run + 1][0] <= number:
                run += 1
            for _ in range(min(runs[run][1] if runs else 0, len(track.sizes) - k)):
                track.offsets.append(place)
                place, k = place + track.sizes[k], k + 1
        track.keys = [s - 1 for (s,) in tables[b"stss"] if 0 < s <= len(track.sizes)] if b"stss" in tables else list(range(len(track.sizes)))

    try:
        for path, start, at, end in walk(view):
            kind = path[-1]
            if kind == b"trak":
                if tracks:
                    close()
                tracks.append(Track())
                tables, fixed, units = {}, 0, 0
            elif kind == b"trex":
                number, _, *rest = struct.unpack_from(">5I", view, at + 4)
                defaults[number] = tuple(rest)
            elif kind == b"moof":
                moof, fragment = start, Fragment(at=start)
            elif kind == b"tfhd" and b"traf" in path:
                head, number = struct.unpack_from(">II", view, at)
                own, _ = _fields(view, at + 8, head, ((0x1, "base", "Q"), (0x2, "entry", "I"), (0x8, "length", "I"), (0x10, "size", "I"), (0x20, "flags", "I")))
                base = own.get("base", moof if head & 0x20000 else fragment.at)  # else behind the data of the fragment before
                length, size, flags = defaults.get(number, (0, 0, 0))
                fragment = Fragment(number, base, base, own.get("length", length), own.get("size", size), own.get("flags", flags))
            elif kind == b"trun" and b"traf" in path:
                samples[fragment.number] += _run(view, at, end, fragment)
            elif b"trak" not in path:
                continue
            elif kind == b"tkhd":
                (tracks[-1].number,) = struct.unpack_from(">I", view, at + (20 if view[at] == 1 else 12))
            elif kind == b"mdhd":
                wide = view[at] == 1
                tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ" if wide else ">II", view, at + (20 if wide else 12))
            elif kind == b"stsd":
                tracks[-1].codec = bytes(view[at + 12 : at + 16]).decode("latin-1").strip()
            elif kind == b"stsz":
                fixed, units = struct.unpack_from(">II", view, at + 4)
                if not fixed:
                    tables[b"sizes"] = _table(view, at + 8, end, "I")
            elif kind in (b"stco", b"co64"):
                tables[b"chunks"] = _table(view, at + 4, end, "I" if kind == b"stco" else "Q")
            elif kind in (b"stts", b"stsc", b"stss"):
                tables[kind] = _table(view, at + 4, end, {b"stts": "II", b"stsc": "III", b"stss": "I"}[kind])
    except (struct.error, IndexError):  # a box that ends early
        pass
    if tracks:
        close()
    for track in tracks:
        more = samples.pop(track.number, [])
        whole = len(track.sizes)
        track.duration = track.duration or sum(length for _, _, length, _ in more)
        track.keys += [whole + k for k, sample in enumerate(more) if sample[3]]
        track.offsets += [sample[0] for sample in more]
        track.sizes += [sample[1] for sample in more]
    return tracks


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch, as one."""
    out: list[tuple[int, int]] = []
    for start, end in ranges:
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def read_payload(data: bytes, track: Track) -> bytes:
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in joined(track.ranges(range(len(track.sizes)))))


def media_columns(files: DataFrame, media: str = "media", id_column: str = "doc_id") -> DataFrame:
    """Per track of the files in the binary column ``media``: id, track, codec, seconds, samples, keyframes (start, end).

    Null, empty or other bytes have no tracks and give no rows; repeated rows each give theirs; other columns go.
    """
    kind = dict(files.dtypes)[id_column]
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for k, data in enumerate(batch.column(1)):
            for n, t in enumerate(describe(data.as_py() or b"")):
                rows.append((k, n, t.codec, t.seconds, len(t.sizes), [{"start": a, "end": b} for a, b in t.ranges(t.keys)]))
        if rows:
            where, *rest = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.int64(), ranges)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where)), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], names=[id_column, "track", "codec", "seconds", "samples", "keyframes"]
            )

    return by_batch(files.select(id_column, media), run, f"`{id_column}` {kind}, track int, codec string, seconds double, samples long, keyframes array<struct<start:long,end:long>>")


def store_texts(docs: DataFrame, id_column: str = "doc_id", keep_media: bool = True) -> DataFrame:
    """Per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, codec,
    seconds, samples, keyframes (start, end in the file), and with ``keep_media`` the file itself, media.

    The text's UTF-8 and bytes 0 up to a positive multiple of 64 make a track; payload figures are of what is read back
    by the sample tables, the others of the boxes. Null text counts as empty; repeated rows are stored each; a text of
    any length is one file; other columns go; an empty table gives an empty result. ``feature`` has codec, rate,
    duration, samples, keyframes, and a checksum of the keyframes' ranges.
    """
    kind = dict(docs.dtypes)[id_column]
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = {
        "n_bytes": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("long", pa.int64()),
        "media_bytes": ("long", pa.int64()), "media_sha256": ("string", pa.string()), "feature": ("string", pa.string()), "codec": ("string", pa.string()),
        "seconds": ("double", pa.float64()), "samples": ("long", pa.int64()), "keyframes": ("array<struct<start:long,end:long>>", ranges),
    } | ({"media": ("binary", pa.binary())} if keep_media else {})

    def row(text: bytes) -> tuple:
        media = write_track(text + bytes(-len(text) % UNIT or (0 if text else UNIT)))
        (track,) = describe(media)
        payload = read_payload(media, track)
        keys = track.ranges(track.keys)
        crc = zlib.crc32(struct.pack(f"<{2 * len(keys)}Q", *(x for r in keys for x in r)))
        feature = f"{track.codec}/{track.timescale} duration={track.duration} samples={len(track.sizes)} keyframes={len(keys)} ranges={crc:08x}"
        stored = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        found = (track.codec, track.seconds, len(track.sizes), [{"start": a, "end": b} for a, b in keys])
        return (*stored, *found, media) if keep_media else (*stored, *found)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < batch.num_rows:  # files of some millions of bytes at a time
            rows, size, first = [], 0, at
            while at < batch.num_rows and (not rows or size < AT_ONCE):
                rows.append(row(batch.column(1)[at].as_py().encode()))
                size, at = size + rows[-1][4], at + 1
            arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *arrays], names=[id_column, *columns])

    schema = f"`{id_column}` {kind}, " + ", ".join(f"{name} {form}" for name, (form, _) in columns.items())
    return by_batch(docs.select(id_column, text_of().alias("text")), run, schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` stored as a media file and read back."""
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False)
