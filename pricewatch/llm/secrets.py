"""Secret scans with a worklist of decoded layers.

The text is the first layer. Each layer is scanned, and what can be unwrapped in it becomes further
layers: percent escapes, Unicode escapes (``\\uXXXX``, ``\\xXX``, ``&#N;``), base64 runs (both
alphabets, any alignment, padding optional), and compressed data (gzip, zlib, bz2, xz, zstd) inside
either. The worklist ends at the fixpoint: a layer equal to one of those it was unwrapped from is a
cycle and is not taken up again (only compressed data can grow back to itself), nor is a layer that
another way already reached at the same place. Every layer knows which characters of its parent each
of its characters came from; spans found in it are mapped back to the original text.

Scanning is per row and needs neither shuffle nor a second pass. A null or empty text has no spans.
Layers stay in memory only while the way to them is followed. Compressed data that unpacks to more
than ``most`` bytes (a bomb) is scanned in overlapping windows of that size, so spans inside it are
still found: they all map to the compressed run; layers within it are unwrapped per window.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds of secrets in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_SHORTEST_VALUE = 8

#: Shortest base64 of a secret: ``token=`` and a value, 14 bytes.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{19,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
_STANDARD = str.maketrans("-_", "+/", "\r\n=")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)


def _inflating(bits: int) -> Callable:
    """Reader of a deflate stream: ``read(n)`` gives at most n bytes, none at the end; bytes left behind it."""

    def opened(data: memoryview) -> tuple[Callable[[int], bytes], Callable[[], int]]:
        machine, rest = zlib.decompressobj(bits), data

        def read(n: int) -> bytes:
            nonlocal rest
            out = machine.decompress(rest, n)
            rest = machine.unconsumed_tail
            return out

        return read, lambda: len(machine.unused_data)

    return opened


def _reading(stream: Callable) -> Callable:
    """The same for a class of streams that does not tell where its data ended."""
    return lambda data: (stream(io.BytesIO(data)).read, int)


#: First bytes of compressed data and how a reader of it is opened.
_UNPACK: dict[bytes, Callable] = {
    b"\x1f\x8b\x08": _inflating(31),
    b"x\x01": _inflating(15),
    b"x\x5e": _inflating(15),
    b"x\x9c": _inflating(15),
    b"x\xda": _inflating(15),
    b"BZh": _reading(bz2.BZ2File),
    b"\xfd7zXZ\x00": _reading(lzma.LZMAFile),
    b"\x28\xb5\x2f\xfd": _reading(lambda data: zstandard.ZstdDecompressor().stream_reader(data)),
}
_MAGIC = re.compile("|".join(re.escape(m.decode("latin-1")) for m in _UNPACK))
#: Unpacked bytes held at once, and characters two windows share.
MOST_BYTES = 1 << 24
_OVERLAP = 1 << 12

Span = tuple[str, int, int]


def found(text: str) -> Iterator[Span]:
    """Secrets of the text itself, leftmost and non-overlapping per kind."""
    for m in _ASSIGN.finditer(text):
        if m.end() - m.start(1) >= _SHORTEST_VALUE:
            yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def listed(spans: Iterable[Span]) -> str:
    ordered = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


class Layer:
    """A decoded text and, through ``up``, the characters of its parent that each of its own came from."""

    def __init__(self, text: str, parent: Layer | None = None, up: Callable[[int, int], tuple[int, int]] | None = None) -> None:
        self.text, self.parent, self.up = text, parent, up

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """Place in the first layer."""
        layer = self
        while layer.parent is not None:
            start, end = layer.up(start, end)
            layer = layer.parent
        return start, end

    def closes_a_cycle(self) -> bool:
        layer = self.parent
        while layer is not None:
            if layer.text == self.text:
                return True
            layer = layer.parent
        return False

    def name(self) -> tuple:
        """Content and place: what a layer is known by, whichever way led to it."""
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return digest, *self.origin(0, len(self.text))


def _plain(data: bytes) -> tuple[str, bool]:
    """Bytes as UTF-8 text, else with a character per byte so that nothing is lost; whether it is the latter."""
    try:
        return data.decode("utf-8"), False
    except UnicodeDecodeError:
        return data.decode("latin-1"), True


def _by_bytes(data: bytes, width: int) -> Iterator[tuple[str, int]]:
    text, single = _plain(data)
    for c in text:
        yield c, width if single else width * len(c.encode("utf-8"))


def _char(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _by_units(units: list[int]) -> Iterator[tuple[str, int]]:
    i = 0
    while i < len(units):
        high, low = units[i], units[i + 1] if i + 1 < len(units) else 0
        if 0xD800 <= high < 0xDC00 <= low < 0xE000:
            yield chr(0x10000 + ((high - 0xD800) << 10) + low - 0xDC00), 12
            i += 2
        else:
            yield _char(high), 6
            i += 1


def _resolved(run: str) -> Iterator[tuple[str, int]]:
    """(character, characters of the run it came from) of one run of escapes."""
    if run[0] == "%":
        yield from _by_bytes(bytes.fromhex(run.replace("%", "")), 3)
    elif run.startswith("\\x"):
        yield from _by_bytes(bytes.fromhex(run.replace("\\x", "")), 4)
    elif run.startswith("\\u{"):
        yield _char(int(run[3:-1], 16)), len(run)
    elif run.startswith("\\u"):
        yield from _by_units([int(unit, 16) for unit in run[2:].split("\\u")])
    elif run.startswith("\\U"):
        yield _char(int(run[2:], 16)), len(run)
    elif run[2] in "xX":
        yield _char(int(run[3:-1], 16)), len(run)
    else:
        yield _char(int(run[2:-1])), len(run)


def unescaped(layer: Layer, escape: re.Pattern) -> Layer | None:
    """The layer with all matches of the escape resolved; None without a match."""
    parts: list[str] = []
    starts: list[int] = []  # of the pieces, in the new text
    places: list[tuple[int, int]] = []  # the same in the parent; end 0: character for character
    own = there = 0

    def piece(text: str, start: int, end: int) -> None:
        nonlocal own
        parts.append(text)
        starts.append(own)
        places.append((start, end))
        own += len(text)

    for m in escape.finditer(layer.text):
        if m.start() > there:
            piece(layer.text[there : m.start()], there, 0)
        there = m.start()
        for char, width in _resolved(m.group()):
            piece(char, there, there + width)
            there += width
    if not any(end for _, end in places):
        return None
    if there < len(layer.text):
        piece(layer.text[there:], there, 0)

    def up(start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(starts, start) - 1, bisect_right(starts, max(start, end - 1)) - 1
        first = places[i][0] if places[i][1] else places[i][0] + start - starts[i]
        return first, places[j][1] or places[j][0] + end - starts[j]

    return Layer("".join(parts), layer, up)


def _unpacked(data: memoryview, most: int) -> Iterator[tuple[bytes, int]]:
    """(window, bytes of ``data`` read) of the unpacked data.

    Windows hold at most ``most`` bytes and overlap; broken data ends where it breaks.
    """
    opener = next((o for m, o in _UNPACK.items() if data[: len(m)] == m), None)
    if opener is None:
        return
    (read, left), window, new = opener(data), b"", 0
    while True:
        try:
            more = read(min(1 << 16, most - len(window)))
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            more = b""
        if not more:
            break
        window, new = window + more, new + len(more)
        if len(window) == most:
            yield window, len(data) - left()
            window, new = window[-min(_OVERLAP, most // 2) :], 0
    if new:
        yield window, len(data) - left()


def unpacked(layer: Layer, data: memoryview, start: int, end: int | None, most: int) -> Iterator[Layer]:
    """Layers from compressed data that stands at ``start:end`` of the layer, or at ``start`` with a character per byte."""
    for window, used in _unpacked(data, most):
        yield Layer(_plain(window)[0], layer, lambda a, b, to=start + used if end is None else end: (start, to))


def _decoded(layer: Layer, m: re.Match, most: int) -> Iterator[Layer]:
    """Layers from a run of base64, at each of the four alignments."""
    signs = [i for i in range(m.start(), m.end()) if layer.text[i] not in "\r\n="]
    run = m.group().translate(_STANDARD)
    for skip in range(4):
        here = signs[skip:]
        use = len(here) - (len(here) % 4 == 1)
        data = base64.b64decode(run[skip : skip + use] + "=" * (-use % 4))
        if any(data.startswith(magic) for magic in _UNPACK):
            yield from unpacked(layer, memoryview(data), here[0], m.end(), most)
            continue
        text, single = _plain(data)

        def up(start: int, end: int, here: list = here, text: str = text, single: bool = single) -> tuple[int, int]:
            if not single:
                start, end = (len(text[:i].encode("utf-8")) for i in (start, end))
            last = (8 * end - 1) // 6
            return here[8 * start // 6], here[min(last, len(here) - 1)] + 1

        yield Layer(text, layer, up)


def unwrapped(layer: Layer, most: int = MOST_BYTES) -> Iterator[Layer]:
    """All layers one step below."""
    text = layer.text
    for sign, escape in (("%", _PERCENT), ("\\", _ESCAPE), ("&#", _ESCAPE)):
        if sign in text and (escape is not _ESCAPE or sign == "\\" or "\\" not in text):
            below = unescaped(layer, escape)
            if below is not None:
                yield below
    for m in _BASE64.finditer(text):
        yield from _decoded(layer, m, most)
    if layer.parent is not None and (hits := [m.start() for m in _MAGIC.finditer(text)]):
        data = memoryview(text.encode("latin-1", "replace"))
        for at in hits:
            yield from unpacked(layer, data[at:], at, None, most)


def scan(text: str, most: int = MOST_BYTES) -> tuple[set[Span], set[Span], int]:
    """(spans of the text itself, spans of all layers in places of the text, layers scanned)."""
    base = set(found(text))
    spans = set(base)
    first = Layer(text)
    work, known, layers = [unwrapped(first, most)], set(), 1
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text or layer.closes_a_cycle():
            continue
        name = layer.name()
        if name in known:
            continue
        known.add(name)
        layers += 1
        spans.update((kind, *layer.origin(start, end)) for kind, start, end in found(layer.text))
        work.append(unwrapped(layer, most))
    return base, spans, layers


_COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"


def _scan_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[] for _ in range(6)]
                for text in part.column("text"):
                    base, spans, layers = scan(text.as_py() or "", most)
                    kinds = Counter(kind for kind, _, _ in base)
                    digest = hashlib.sha256(listed(base).encode()).hexdigest()
                    for column, value in zip(columns, (*(kinds[k] for k in KINDS), digest, listed(spans), layers)):
                        column.append(value)
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"],
                )

    return run


def scans(docs: DataFrame, most: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base secrets, their digest, all spans, layers scanned."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan_batches(most), _COLUMNS)
