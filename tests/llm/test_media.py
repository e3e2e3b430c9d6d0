"""Deep and damaged boxes, sync samples that aren't there, and fragmented files."""

import random
import struct
import time

import pytest

from gristmill.llm import media
from gristmill.llm.media import box, full


def head(*tracks, trex=()):
    """A moov of empty tracks: (number, timescale, duration), and trex rows (number, length, size, flags)."""
    out = []
    for number, scale, duration in tracks:
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
        out.append(box(b"trak", full(b"tkhd", bytes(8), struct.pack(">I", number), bytes(68), flags=7), box(b"mdia", full(b"mdhd", bytes(8), struct.pack(">II", scale, duration), bytes(4)), box(b"minf", stbl))))
    rows = [full(b"trex", struct.pack(">5I", number, 1, *rest)) for number, *rest in trex]
    return box(b"ftyp", b"iso5", bytes(4)) + box(b"moov", *out, box(b"mvex", *rows))


def fragment(at, tracks, base_is_moof=True, explicit=False):
    """moof and mdat of ``tracks``: (number, [(payload, length, key)], defaults?); data one track after the other."""
    def moof(start):
        trafs, place = [], start
        for number, samples, plain in tracks:
            flags = (0x20000 if base_is_moof else 0) | (0x1 if explicit else 0)
            tfhd = full(b"tfhd", struct.pack(">I", number), struct.pack(">Q", at) if explicit else b"", flags=flags)
            offset = struct.pack(">i", place)
            if plain:  # sizes and lengths by the defaults, the first sample a key
                trun = full(b"trun", struct.pack(">I", len(samples)), offset, struct.pack(">I", 0), flags=0x5)
            else:
                rows = b"".join(struct.pack(">4I", length, len(p), 0 if key else media.NOT_SYNC, 0) for p, length, key in samples)
                trun = full(b"trun", struct.pack(">I", len(samples)), offset, rows, flags=0xF01)
            trafs.append(box(b"traf", tfhd, trun))
            place += sum(len(p) for p, _, _ in samples)
        return box(b"moof", full(b"mfhd", bytes(4)), *trafs)

    size = len(moof(0))
    return moof(size + 8) + box(b"mdat", *(p for _, samples, _ in tracks for p, _, _ in samples))


@pytest.mark.parametrize("explicit", [False, True])
def test_fragments(explicit):
    rng = random.Random(1)
    data = head((1, 1000, 0), (2, 50, 0), trex=[(1, 40, 10, 0), (2, 5, 7, media.NOT_SYNC)])
    want = {1: [], 2: []}
    for _ in range(3):
        one = [(rng.randbytes(rng.randrange(1, 90)), rng.randrange(1, 60), rng.random() < 0.4) for _ in range(rng.randrange(1, 9))]
        two = [(rng.randbytes(7), 5, k == 0) for k in range(4)]
        data += fragment(len(data), [(1, one, False), (2, two, True)], explicit=explicit, base_is_moof=not explicit)
        want[1] += one
        want[2] += two
    tracks = media.describe(data)
    assert [t.number for t in tracks] == [1, 2] and {t.codec for t in tracks} == {"avc1"}
    for t in tracks:
        own = want[t.number]
        assert media.read_payload(data, t) == b"".join(p for p, _, _ in own) and t.keys == [k for k, x in enumerate(own) if x[2]]
        assert [data[a:b] for a, b in t.ranges(t.keys)] == [p for p, _, key in own if key]
        assert t.seconds == sum(x[1] for x in own) / t.timescale
    for cut in range(0, len(data), 11):
        media.describe(data[:cut])


def test_fragments_without_a_base_follow_one_another():
    data = head((1, 10, 7), (2, 10, 7), trex=[(1, 1, 4, 0), (2, 1, 4, 0)])
    start = len(data)
    run = lambda offset: full(b"trun", struct.pack(">I", 2), *([struct.pack(">i", offset)] if offset else []), flags=bool(offset))
    make = lambda offset: box(b"moof", *(box(b"traf", full(b"tfhd", struct.pack(">I", n)), run(offset if n == 1 else 0), run(0)) for n in (1, 2)))
    moof = make(1)
    data += make(len(moof) + 8) + box(b"mdat", bytes(range(32)))
    one, two = media.describe(data)
    first = start + len(moof) + 8
    assert one.offsets == [first + 4 * k for k in range(4)] and two.offsets == [first + 16 + 4 * k for k in range(4)] and one.duration == 7
    huge = data.replace(struct.pack(">II", 1, 2), struct.pack(">II", 1, 0xFFFFFFFF))
    assert sum(len(t.sizes) for t in media.describe(huge)) < 200


def test_deep_boxes(spark):
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    wide = bytes.fromhex("00000008") + b"moov"
    assert media.describe(deep) == []
    began = time.process_time()
    level = b"".join(struct.pack(">I4s", 8 * (200_000 - k), b"moov") for k in range(200_000))
    assert media.describe(level) == media.describe(wide * 200_000) == [] and time.process_time() - began < 5
    rows = [(1, bytearray(deep)), (2, bytearray(media.write_track(bytes(640))))]
    assert [r.doc_id for r in media.media_columns(spark.createDataFrame(rows, "doc_id long, media binary")).collect()] == [2]


def test_sync_numbers_that_are_no_samples():
    data = media.write_track(bytes(64 * 40))
    stss = full(b"stss", struct.pack(">4I", 3, 1, 17, 33))
    assert stss in data
    (track,) = media.describe(data.replace(stss, full(b"stss", struct.pack(">4I", 3, 0, 17, 41))))
    assert track.keys == [16] and len(track.ranges(track.keys)) == 1
