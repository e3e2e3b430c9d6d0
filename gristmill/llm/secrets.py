"""Secret scans with a recursive decoding worklist.

A text is scanned by fixed patterns; then its encoded runs (percent, Unicode, octal and character escapes, base64, hex, and
UTF-16 or compressed bytes in these, raw deflate among them) are unwrapped into layers, each scanned and unwrapped in turn until no layer gives a new one.
Digests of the layers seen end cycles; escapes of escapes are read as one, so that deep ones cost no more than their
length. Each layer maps its code points to spans of the text, so that a find in any layer has a span in the text: exact
for escapes, the encoded run for base64, hex and compressed layers. Runs that meet over line ends are one run as well.
Within a run every alignment is read, so that an encoded piece is found whatever it is glued to; its span is then the
piece.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import by_batch, text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 and over are the runs that don't fail
LEAST = {"assign": 8, "access": 16}

#: Escapes, each its own code point, or a byte of one. Where an escape's first character is itself escaped, and that
#: again, in the same way, the chain is one escape: ``%252541`` is ``A``.
PERCENT, WIDE_U, SHORT_X = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})"), re.compile(r"\\(?:u005[cC])*u([0-9A-Fa-f]{4})"), re.compile(r"\\(?:x5[cC])*x([0-9A-Fa-f]{2})")
BRACED = re.compile(r"\\(?:u\{0{0,4}5[cC]\})*u\{([0-9A-Fa-f]{1,6})\}")
LONG_U, OCTAL = re.compile(r"\\(?:U0000005[cC])*U([0-9A-Fa-f]{8})"), re.compile(r"\\(?:134)*([0-3][0-7]{2})")
NAMED = re.compile(r"&(?:amp;|#0{0,5}38;|#[xX]0{0,4}26;)*(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,31});")
ESCAPE = re.compile("|".join([f"(?:{PERCENT.pattern})+", BRACED.pattern, f"(?:{WIDE_U.pattern})+", f"(?:{SHORT_X.pattern})+", LONG_U.pattern, f"(?:{OCTAL.pattern})+", NAMED.pattern]))
#: Steps by which a text's escapes are resolved one by one, each a layer; what is left then is resolved in one pass. And
#: the code points that such a pass sees of an escape at once, a longer one being a chain.
STEPS, WINDOW = 16, 64
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
HEXRUN = re.compile(r"(?:[0-9A-Fa-f]{2}){8,}")
#: What parts the lines of a wrapped run: white space, quotes, marks of quoted or commented lines; line ends may be escapes.
BREAK = re.compile(r"""["'\\\x20\t]*(?:\r?\n|\r|\\r\\n|\\n|\\r)["'\x20\t>#*|]*""")
WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{BREAK.pattern}[A-Za-z0-9+/_-]+)*={{0,2}}")
#: A shorter line that a wrapped run begins with.
HEAD = re.compile(rf"[A-Za-z0-9+/_-]{{1,15}}{BREAK.pattern}\Z")
HEXPIECE = re.compile(r"[0-9A-Fa-f]{16,}")
#: Text among other bytes: as long as the shortest secret, ``token=`` and 8 more.
STRETCH = re.compile(rb"(?:[\t-\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){14,}")
#: The same as UTF-16, of characters that secrets have; low bytes first, or high ones.
WIDE_STRETCH = re.compile(rb"(?:[\t-\r\x20-\x7e]\0){14,}|(?:\0[\t-\r\x20-\x7e]){14,}")
#: First bytes of gzip, bzip2, xz and zlib.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|\x78[\x01\x5e\x9c\xda]")
#: A layer beyond this many bytes is scanned in parts that overlap, as its bytes come out, so that none is held whole.
MOST_BYTES, OVERLAP, PIECE = 64 << 20, 1 << 20, 1 << 16

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping per kind, by start and then kind."""
    found: list[tuple[int, int, int]] = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


class Layer:
    """A text with, for runs of its code points, their place in the original: (at, start, end, exact); exact runs map
    code point by code point, the others as one."""

    def __init__(self, text: str, runs: list[tuple[int, int, int, bool]], steps: int = 0):
        self.text, self.runs, self.starts, self.steps = text, runs, [r[0] for r in runs], steps

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self._of(start)[0], self._of(max(start, end - 1))[1]

    def _of(self, k: int) -> tuple[int, int]:
        at, start, end, exact = self.runs[bisect_right(self.starts, k) - 1]
        return (start + k - at, start + k - at + 1) if exact else (start, end)


def readable(data: bytes) -> str | None:
    """Text, if the bytes are UTF-8 without control characters (white space aside)."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0E-\x1F\x7F]", text) else None


def engine(data: bytes):
    """A decompressor for the format that the first bytes tell, or None."""
    if not MAGIC.match(data):
        return None
    if data[:1] in (b"\x1f", b"x"):
        return zlib.decompressobj(31 if data[:1] == b"\x1f" else 15)
    return bz2.BZ2Decompressor() if data[:1] == b"B" else lzma.LZMADecompressor()


def inflate(data: bytes, chunks: Iterator[bytes], left: list[int]) -> Iterator[bytes]:
    """Bytes out of compressed ones, ``data`` and then ``chunks``, PIECE at most at a time; members that follow one
    another are one stream. ``left`` gets the number of bytes read beyond it. Raises where the first member is damaged
    or ends early; a later one that is ends the stream."""
    now, first, over = engine(data), True, 0
    while True:
        try:
            piece = now.decompress(data, PIECE)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            if first:
                raise
            break
        if piece:
            yield piece
        if now.eof:
            rest, data, first = now.unused_data, now.unused_data, False
            if isinstance(now, lzma.LZMADecompressor):
                data = data.lstrip(b"\0")  # padding of streams
            over = len(rest)
            while len(data) < 10 and (more := next(chunks, b"")):
                data, over = data + more, over + len(more)
            now = engine(data)
            if now is None:
                break
            continue
        data = getattr(now, "unconsumed_tail", b"")
        if not data and getattr(now, "needs_input", True):
            data = next(chunks, b"")
            over += len(data)
            if not data and not piece:
                if first:
                    raise EOFError
                break
    left.append(over)


def inflated(data: bytes, left: list[int]) -> Iterator[bytes]:
    """What compressed bytes hold, compressed layers in it resolved too: one part, or beyond MOST_BYTES overlapping
    ones. None where they are damaged."""
    chunks = (data[k : k + PIECE] for k in range(PIECE, len(data), PIECE))
    stream, heads = inflate(data[:PIECE], chunks, left), set()
    try:
        while True:
            head = b""
            while len(head) < PIECE and (more := next(stream, b"")):
                head += more
            digest = hashlib.sha256(head).digest()
            if not engine(head) or digest in heads:  # bytes that hold themselves end here
                break
            heads.add(digest)
            stream = inflate(head, stream, [])
        part = bytearray(head)
        for more in stream:
            part += more
            if len(part) > MOST_BYTES:
                yield bytes(part)
                del part[: -min(OVERLAP, MOST_BYTES // 2)]
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return
    left.append(sum(map(len, chunks)))
    yield bytes(part)


def texts(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of the bytes where all are text, or of the stretches that are, in UTF-8 or UTF-16."""
    if whole := readable(data):
        yield whole, 0, len(data)
    else:
        for m in STRETCH.finditer(data):
            yield m[0].decode(errors="replace"), m.start(), m.end()
        if b"\0" in data:
            for m in WIDE_STRETCH.finditer(data):
                yield m[0].replace(b"\0", b"").decode(), m.start(), m.end()


def raw_inflated(data: bytes, left: list[int]) -> Iterator[bytes]:
    """What bytes that are one whole raw deflate stream hold, in parts as ``inflated`` has them: text, or compressed
    bytes again. None where they are no such stream, which the first piece mostly tells."""
    now, part, given = zlib.decompressobj(-15), bytearray(), []
    try:
        piece = now.decompress(data, PIECE)
        if not piece or not (MAGIC.match(piece) or next(texts(piece[:1024]), None)):
            return
        while True:
            part += piece
            if len(part) > MOST_BYTES:
                given.append(bytes(part))
                del part[: -min(OVERLAP, MOST_BYTES // 2)]
            if now.eof:
                break
            piece = now.decompress(now.unconsumed_tail, PIECE)
            if not piece and not now.eof:
                return
    except zlib.error:
        return
    left.append(len(now.unused_data))
    for part in (*given, bytes(part)):
        if MAGIC.match(part):
            yield from inflated(part, [])
        else:
            yield part


def unescaped(run: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of a run of escapes of one kind; parts that aren't UTF-8 are left out."""
    if run[0] == "&":
        name = NAMED.fullmatch(run)[1]
        new = html.unescape(f"&{name};")
        return [(0, len(run), new)] if new != f"&{name};" and "\ufffd" not in new else []
    if m := BRACED.fullmatch(run) or LONG_U.fullmatch(run):
        code = int(m[1], 16)
        return [(0, len(run), chr(code))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else []
    kind = PERCENT if run[0] == "%" else next(k for k in (SHORT_X, WIDE_U, OCTAL) if k.match(run))
    found = [(m.start(), m.end(), int(m[1], 8 if kind is OCTAL else 16)) for m in kind.finditer(run)]
    codes, out, k = [c for _, _, c in found], [], 0
    if kind is WIDE_U:
        while k < len(codes):
            wide = 0xD800 <= codes[k] < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1] < 0xE000
            if wide:
                out.append((found[k][0], found[k + 1][1], chr(0x10000 + (codes[k] - 0xD800 << 10) + codes[k + 1] - 0xDC00)))
            elif not 0xD800 <= codes[k] < 0xE000:
                out.append((*found[k][:2], chr(codes[k])))
            k += 1 + wide
        return out
    data = bytes(codes)
    while k < len(data):
        n = 1 if data[k] < 0x80 else 2 if data[k] >> 5 == 6 else 3 if data[k] >> 4 == 14 else 4 if data[k] >> 3 == 30 else 0
        try:
            if n and k + n <= len(data):
                out.append((found[k][0], found[k + n - 1][1], data[k : k + n].decode()))
            else:
                n = 0
        except UnicodeDecodeError:
            n = 0
        k += n or 1
    return out


def unescape(layer: Layer) -> Layer | None:
    """The layer with all its escapes resolved once, or None where it has none."""
    text, parts, runs, at, done = layer.text, [], [], 0, 0

    def keep(start: int, end: int) -> None:
        nonlocal at
        while start < end:  # a run of the layer below at a time
            k = bisect_right(layer.starts, start) - 1
            first, a, b, exact = layer.runs[k]
            to = min(end, layer.starts[k + 1] if k + 1 < len(layer.runs) else len(text))
            runs.append((at, a + start - first, a + to - first, True) if exact else (at, a, b, False))
            parts.append(text[start:to])
            at, start = at + to - start, to

    for m in ESCAPE.finditer(text):
        for a, b, new in unescaped(m[0]):
            keep(done, m.start() + a)
            done = m.start() + b
            runs.append((at, *layer.span(m.start() + a, done), False))
            parts.append(new)
            at += len(new)
    if not parts:
        return None
    keep(done, len(text))
    return Layer("".join(parts), runs, layer.steps + 1)


def settled(layer: Layer) -> Layer | None:
    """The layer with escapes resolved until none is left, in one pass: what an escape stands for is read again with
    what is around it. None where the layer has none."""
    text, at, changed = layer.text, 0, False
    codes, starts, ends = array("I"), array("q"), array("q")
    back: list[tuple[str, int, int]] = []  # to be read before the rest of the text, the next one last
    while back or at < len(text):
        if back:
            char, a, b = back.pop()
        else:
            char, (a, b), at = text[at], layer.span(at, at + 1), at + 1
        if char in "%\\&":
            near = "".join(x[0] for x in reversed(back[-WINDOW:]))
            m = ESCAPE.match(char + near + text[at : at + WINDOW - len(near)])
            units = unescaped(m[0]) if m else []
            if units and units[0][0] == 0:
                _, size, new = units[0]
                for _ in range(size - 1):
                    if back:
                        b = back.pop()[2]
                    else:
                        b, at = layer.span(at, at + 1)[1], at + 1
                back += [(c, a, b) for c in reversed(new)]
                changed = True
                last = next((k for k in range(len(codes) - 1, max(-1, len(codes) - WINDOW), -1) if codes[k] in (0x25, 0x5C, 0x26)), None)
                if last is not None:  # may go on in what is new
                    back += [(chr(codes[k]), starts[k], ends[k]) for k in range(len(codes) - 1, last - 1, -1)]
                    del codes[last:], starts[last:], ends[last:]
                continue
        codes.append(ord(char))
        starts.append(a)
        ends.append(b)
    if not changed:
        return None
    runs: list[tuple[int, int, int, bool]] = []
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        exact = b - a == 1
        if not runs or not (exact and runs[-1][3] and a - runs[-1][1] == k - runs[-1][0] or not exact and runs[-1][1:] == (a, b, False)):
            runs.append((k, a, b, exact))
    return Layer("".join(map(chr, codes)), runs, layer.steps + 1)


def decoded(run: str) -> Iterator[bytes]:
    """Bytes that a run may stand for: base64 in either alphabet, with or without its padding; hex."""
    core = run.rstrip("=")
    if len(core) % 4 != 1 and not (set(core) & set("+/") and set(core) & set("-_")):
        try:
            yield base64.b64decode(core.replace("-", "+").replace("_", "/") + "=" * (-len(core) % 4), validate=True)
        except (binascii.Error, ValueError):
            pass
    if len(core) % 2 == 0 and HEXRUN.fullmatch(core):
        yield bytes.fromhex(core)


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers right below: the unescaped text, and each encoded run's bytes where they are text or compressed."""
    text = layer.text
    if ("%" in text or "\\" in text or "&" in text) and (new := (unescape if layer.steps < STEPS else settled)(layer)):
        yield new
    for m in ENCODED.finditer(text):
        for data in decoded(m[0]):
            whole = [(0, *layer.span(m.start(), m.end()), False)]
            if MAGIC.match(data):
                for part in inflated(data, []):
                    yield from (Layer(inner, whole) for inner, _, _ in texts(part))
            elif inner := readable(data):
                yield Layer(inner, whole)
            else:
                for part in raw_inflated(data, []):
                    yield from (Layer(inner, whole) for inner, _, _ in texts(part))
    for m in WRAPPED.finditer(text):
        for inner, start, end in pieces(text, m.start(), m.end()):
            yield Layer(inner, [(0, *layer.span(start, end), False)])


def readings(run: str) -> Iterator[tuple[bytes, int, int, int]]:
    """(bytes, at, characters, bytes) of a run at each alignment: base64 in either alphabet, 4 to 3, and hex, 2 to 1."""
    plain = run.replace("-", "+").replace("_", "/")
    for at in range(min(4, len(plain))):
        core = plain[at : len(plain) - ((len(plain) - at) % 4 == 1)]
        yield base64.b64decode(core + "=" * (-len(core) % 4)), at, 4, 3
    for m in HEXPIECE.finditer(run):
        for at in (m.start(), m.start() + 1):
            yield bytes.fromhex(run[at : m.end() - (m.end() - at) % 2]), at, 2, 1


def pieces(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of what is encoded anywhere in a run that may be wrapped over lines."""
    if head := HEAD.search(text, max(0, start - 64), start):
        start = head.start()
    lines, places, size, at = [], [], 0, start
    for stop, go in [*((b.start(), b.end()) for b in BREAK.finditer(text, start, end)), (end, end)]:
        lines.append(text[at:stop])
        places.append((size, at))
        size, at = size + stop - at, go
    run = "".join(lines).rstrip("=")
    starts = [p[0] for p in places]

    def place(k: int) -> int:
        first, there = places[bisect_right(starts, k) - 1]
        return there + k - first

    left: list[int]
    for data, at, wide, narrow in readings(run):
        there = lambda p, q: (place(at + p * wide // narrow), end if at - (-q * wide // narrow) >= len(run) else place(at - (-q * wide // narrow) - 1) + 1)  # noqa: B023, E731
        if at or len(lines) > 1 or not (readable(data) or MAGIC.match(data)):  # else the run as a whole has given it
            for inner, p, q in texts(data):
                yield inner, *there(p, q)
            left = []
            for part in raw_inflated(data, left) if at or len(lines) > 1 else ():
                yield from ((inner, *there(0, len(data) - sum(left))) for inner, _, _ in texts(part))
        for m in MAGIC.finditer(data):
            if at or len(lines) > 1 or m.start():
                left = []
                for part in inflated(data[m.start() :], left):
                    yield from ((inner, *there(m.start(), len(data) - sum(left))) for inner, _, _ in texts(part))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: those of every layer too, mapped to the text, by start, kind and end."""
    base = scan(text)
    found, seen, work = set(base), {hashlib.sha256(text.encode()).digest()}, deque([Layer(text, [(0, 0, len(text), True)])])
    while work:
        for layer in unwrap(work.popleft()):
            # the digest has the place too: equal layers at two places are two finds
            key = hashlib.sha256(f"{layer.runs[0][1]}:{layer.runs[-1][2]}:{layer.text}".encode()).digest()
            if layer.text and key not in seen:
                seen.add(key)
                found.update((kind, *layer.span(a, b)) for kind, a, b in scan(layer.text))
                work.append(layer)
    return base, sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, base (spans of the text itself), spans (of all layers), as arrays of (kind, start, end) in code
    points, end exclusive. Null text counts as empty and has none; repeated rows give a row each; other columns go; an
    empty table gives an empty result. Texts are scanned whole, whatever their length."""
    kind = dict(docs.dtypes)[id_column]
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        both = [find(value.as_py()) for value in batch.column(1)]
        lists = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[k]] for x in both] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, spans) for x in lists)], names=[id_column, "base", "spans"])

    one = "array<struct<kind:string,start:long,end:long>>"
    return by_batch(docs.select(id_column, text_of().alias("text")), run, f"`{id_column}` {kind}, base {one}, spans {one}")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``, spans that meet as one; n_chars, where it is, follows.
    All rows and columns stay, null text as null."""
    columns, at = docs.columns, docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for value in batch.column(at):
            if (text := value.as_py()) is not None:
                parts, done, last = [], 0, -1
                for _, a, b in find(text)[1]:
                    if a > last:
                        parts += [text[done:a], mark]
                    done = last = max(last, b)
                text = "".join([*parts, text[done:]]) if parts else text
            out.append(text)
        arrays = list(batch.columns)
        arrays[at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(arrays, names=columns)

    docs = docs.withColumn("text", F.col("text").cast("string"))
    new = by_batch(docs, run, docs.schema)
    return new.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in columns else new


def text_spans(column: str):
    """An array of spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: counts and digest of the base spans, and all spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text_spans("base").cast("binary"), 256).alias("base_sha256"), text_spans("spans").alias("spans"))
