"""op6: secret scan with a recursive decoding worklist.

A text is scanned as it is (the base spans), then every layer found in it is unwrapped and scanned too, until no new
layer appears. A layer is: the text with its URL escapes (%41) replaced; the text with its Unicode escapes (\\u0041,
\\x41, \\U00000041, &#65;, &#x41;) replaced; what a base64 run of 20 characters or more decodes to, if that is text;
what a base64 run, or bytes below URL or Unicode escapes, hold in gzip, zlib, bzip2 or xz form. A base64 run may be wrapped over
single line breaks, and may start behind any '/', '-' or '_' of a longer run. Layers nest in any order. A layer seen before in the same
document (by digest) is not entered again, so cycles end. Each character of a layer knows the span of the document that it
came from, through all layers; a compressed layer's characters all map to the whole run. A hit in a layer becomes a
span of its kind in the document unless a base span of that kind already covers it.

A null or empty text has no spans. Texts of any length are scanned whole. A compressed layer of more than MAX_LAYER bytes is
scanned as a stream, in windows of that size that share OVERLAP bytes; only a layer below it that is longer than these and lies across
the edge of a window is cut there.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared

KINDS = ("assign", "access", "hex")
MAX_LAYER, OVERLAP, CHUNK = 1 << 26, 1 << 20, 1 << 20
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = ("password", "passwd", "secret", "token", "api")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}(?:\\u[0-9A-Fa-f]{4})?|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_MAGIC = re.compile("\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_URL_MAGIC = re.compile("%1f%8b|(?:x|%78)(?:%01|%5e|\\^|%9c|%da)|(?:B|%42)(?:Z|%5a)(?:h|%68)|%fd", re.IGNORECASE)
_BYTES = re.compile("[\x00-\xff]+")
_TO_STANDARD = str.maketrans("-_", "+/")


def base_hits(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) by start, then kind as listed."""
    found: list[tuple[int, int, str, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


class Same(Sequence):
    """One value n times."""

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i):
        if isinstance(i, slice):
            return Same(self.value, len(range(self.n)[i]))
        if not -self.n <= i < self.n:
            raise IndexError(i)
        return self.value


@dataclass
class Layer:
    """A decoded text, and for each of its characters where its source starts and ends in the document."""

    text: str
    starts: Sequence[int]
    ends: Sequence[int]


def _replaced(layer: Layer, pattern: re.Pattern[str], decode) -> Layer | None:
    """The layer with every match decoded in place; None if nothing changes."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if not got:
            continue
        a, b = m.span()
        parts += [layer.text[at:a]] + [c for c, _, _ in got]
        starts += [*layer.starts[at:a], *(layer.starts[a + i] for _, i, _ in got)]
        ends += [*layer.ends[at:a], *(layer.ends[a + j - 1] for _, _, j in got)]
        at = b
    if not parts:
        return None
    return Layer("".join(parts) + layer.text[at:], starts + [*layer.starts[at:]], ends + [*layer.ends[at:]])


def _characters(data: bytes) -> list[tuple[str, int, int]] | None:
    """(character, first byte, end) of UTF-8 text; None if it is none."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out.append((c, at, at + n))
        at += n
    return out


def _url(run: str) -> list[tuple[str, int, int]] | None:
    got = _characters(bytes.fromhex(run.replace("%", "")))
    return got and [(c, 3 * a, 3 * b) for c, a, b in got]


def _escape(run: str) -> list[tuple[str, int, int]] | None:
    if run[0] == "&":
        c = html.unescape(run)
        return [(c, 0, len(run))] if len(c) == 1 else None
    units = [int(u, 16) for u in re.findall(r"\\[uUx]([0-9A-Fa-f]+)", run)]
    if len(units) == 2:
        if 0xD800 <= units[0] < 0xDC00 <= units[1] < 0xE000:
            return [(chr(0x10000 + ((units[0] - 0xD800) << 10) + units[1] - 0xDC00), 0, 12)]
        return [(chr(u), 6 * i, 6 * i + 6) for i, u in enumerate(units)] if not any(0xD800 <= u < 0xE000 for u in units) else None
    return [(chr(units[0]), 0, len(run))] if units[0] < 0x110000 and not 0xD800 <= units[0] < 0xE000 else None


_BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)


def _opener(data: bytes):
    """A decompressor for data that start like this; None if they are not compressed."""
    if data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] == 0x78 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def unpacked(data: bytes) -> bytes | None:
    """What gzip, zlib, bzip2 or xz data hold, the first MAX_LAYER bytes of it; None if they are none of these or broken."""
    try:
        d = _opener(data)
        out = d and d.decompress(data, MAX_LAYER)
        return out if d and (d.eof or len(out) == MAX_LAYER) else None
    except _BROKEN:
        return None


def _opens(head: bytes) -> bool:
    """Whether data that start like this are compressed; texts may begin as zlib data do."""
    try:
        d = _opener(head)
        return d is not None and d.decompress(head, CHUNK) is not None
    except _BROKEN:
        return False


def _stream(chunks: Iterator[bytes], d) -> Iterator[bytes]:
    """What d makes of chunks, by CHUNK bytes; it ends where the data break."""
    try:
        for c in chunks:
            while not d.eof:
                if got := d.decompress(c, CHUNK):
                    yield got
                c = d.unconsumed_tail if hasattr(d, "unconsumed_tail") else b""
                if not c and (len(got) < CHUNK if hasattr(d, "unconsumed_tail") else d.needs_input):
                    break
    except _BROKEN:
        return


def _windows(data: bytes) -> Iterator[str]:
    """The texts that compressed data hold, packed once or more; one unless they are large. Bytes that are no UTF-8 are replaced."""
    whole = data
    while (inner := unpacked(whole)) is not None and inner != whole and len(inner) < MAX_LAYER:
        whole = inner
    if inner is None or inner == whole:
        if whole is not data:
            yield whole.decode("utf-8", "replace")
        return
    chunks: Iterator[bytes] = iter([whole])
    head = whole
    while _opens(head):
        chunks = _stream(chunks, _opener(head))
        head = next(chunks, b"")
        chunks = itertools.chain([head], chunks)
    held = bytearray()
    for c in chunks:
        held += c
        if len(held) >= MAX_LAYER:
            yield held.decode("utf-8", "replace")
            del held[:-OVERLAP]
    yield held.decode("utf-8", "replace")


def _is_text(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.95 * len(text)


def _runs(text: str) -> Iterator[tuple[str, Sequence[int]]]:
    """Base64 runs of a text and where their characters are: unbroken ones, and those wrapped over single line breaks.

    Of a block of wrapped lines: all of it, each group of lines of one width with a shorter last one (and a shorter first one), and that without its last line."""
    for m in _BASE64.finditer(text):
        run = m[0].rstrip("=")
        yield run, range(m.start(), m.start() + len(run))
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        lines = [x.span() for x in _LINE.finditer(text, *m.span())]
        width = [b - a for a, b in lines]
        if sum(width) < 20:
            continue
        groups, i = {(0, len(lines))}, 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and width[j] == width[i]:
                j += 1
            last = j + (j < len(lines) and width[j] < width[i])
            first = i - (i > 0 and width[i - 1] < width[i])
            groups |= {(x, y) for x in (first, i) for y in (last, j)}
            i = j
        for i, j in sorted(groups):
            if j - i > 1 and sum(width[i:j]) >= 20:
                yield "".join(text[a:b] for a, b in lines[i:j]), [k for a, b in lines[i:j] for k in range(a, b)]


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    for run, at in _runs(layer.text):
        starts: list[list[int]] = [[], [], [], []]  # of the run and behind its separators, by alignment
        for i in (0, *(m.end() for m in re.finditer("[/_-]", run))):
            if len(run) - i >= 20:
                starts[i % 4].append(i)
        for align, mine in enumerate(starts):
            if not mine:
                continue
            own = run[align:]
            if len(own) % 4 == 1:
                own = own[:-1]
            try:
                data = base64.b64decode(own.translate(_TO_STANDARD) + "=" * (-len(own) % 4))
            except (binascii.Error, ValueError):
                continue
            low = data.decode("utf-8", "replace").rfind("\ufffd")
            clean = len(data) - len(data.decode("utf-8", "replace")[low + 1 :].encode())  # from here on the bytes are UTF-8
            text_found = False
            for i in mine:
                skip = (i - align) * 3 // 4
                packed = False
                if _opener(data[skip : skip + 6]):
                    for text in _windows(data[skip:]):
                        packed = True
                        yield Layer(text, Same(layer.starts[at[i]], len(text)), Same(layer.ends[at[-1]], len(text)))
                if packed or text_found or skip < clean and b"\xef\xbf\xbd" not in data:
                    continue
                got = _characters(data[skip:])
                if got and _is_text("".join(c for c, _, _ in got)):
                    text_found = True
                    yield Layer("".join(c for c, _, _ in got), [layer.starts[at[i + a * 8 // 6]] for _, a, _ in got], [layer.ends[at[i + (b * 8 - 1) // 6]] for _, _, b in got])


def _byte_layers(layer: Layer) -> Iterator[Layer]:
    """What compressed bytes hold that stand in a layer as characters below 256, or as URL escapes."""
    forms = [layer]
    if "%" in layer.text and _URL_MAGIC.search(layer.text):
        forms.append(_replaced(layer, _URL, lambda run: [(chr(c), 3 * i, 3 * i + 3) for i, c in enumerate(bytes.fromhex(run.replace("%", "")))]) or layer)
    for form in forms:
        for m in _MAGIC.finditer(form.text):
            if not _opens(_BYTES.match(form.text, m.start(), m.start() + 64)[0].encode("latin-1")):
                continue
            run = _BYTES.match(form.text, m.start())[0]
            for text in _windows(run.encode("latin-1")):
                yield Layer(text, Same(form.starts[m.start()], len(text)), Same(form.ends[m.start() + len(run) - 1], len(text)))


def _below(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text and (new := _replaced(layer, _URL, _url)):
        yield new
    if ("\\" in layer.text or "&#" in layer.text) and (new := _replaced(layer, _ESCAPE, _escape)):
        yield new
    yield from _base64_layers(layer)
    yield from _byte_layers(layer)


def layers(text: str) -> Iterator[Layer]:
    """All layers below a text, each before those below it."""
    seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    work = [_below(Layer(text, range(len(text)), range(1, len(text) + 1)))]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
        elif (mark := hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).digest()) not in seen:
            seen.add(mark)
            yield new
            work.append(_below(new))


Hits = list[tuple[int, int, str, int]]


def scan(text: str) -> tuple[Hits, Hits]:
    """Base hits of a text, and those that its layers add, each (start, end, kind, start of the secret itself)."""
    base = base_hits(text)
    added = set()
    for layer in layers(text):
        for a, b, kind, value in base_hits(layer.text):
            start, end = min(layer.starts[a:b]), max(layer.ends[a:b])
            if not any(k == kind and s <= start and end <= e for s, e, k, _ in base):
                added.add((start, end, kind, min(layer.starts[value:b])))
    return base, sorted(added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with the secrets themselves replaced; the names they are assigned to stay."""
    base, added = scan(text)
    out, at = [], 0
    for a, b in sorted((value, end) for _, end, _, value in [*base, *added]):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def written(spans: Hits) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def mask_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the secrets in its text column masked; a null text stays null. No shuffle."""

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index(text)
        texts = pa.array([None if t is None else masked(t) for t in batch.column(i).to_pylist()], batch.schema.types[i])
        return batch.set_column(i, batch.schema.field(i), texts)

    return shared.map_arrow(df, mask, df.schema)


OP6_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in shared.texts_of(batch).to_pylist():
            base, added = scan(t)
            every = sorted({*base, *added}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
            rows.append((*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [f.split()[0] for f in OP6_SCHEMA.split(", ")])

    return shared.map_arrow(shared.documents(spark, sf_dir).select("doc_id", "text"), digest, OP6_SCHEMA)
