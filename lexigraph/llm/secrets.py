"""Secret scanning with a recursive decoding worklist.

The text itself is scanned first. Then a worklist unwraps it: percent escapes, Unicode escapes and character references make a new
layer of the whole text; runs that decode from base64 (also base64url, and wrapped over lines) or hexadecimal to text (UTF-8 or
UTF-16, a few invalid bytes allowed), or to gzip, zlib, raw deflate, bzip2 or xz data, make a layer each. Every layer is scanned and
put on the worklist again until nothing new comes. A layer that has been seen (by its content and place) isn't entered again, so
texts that decode to themselves end. Each layer keeps, for every character, where it lies in the text, so a finding in the third
layer is reported at its code points in the text.

What the base rules find in the text stays as it is; a layer adds the findings that rest on at least one decoded character.

Compressed data is unfolded to its end, all members, in windows of `window` characters that overlap, so a crafted text can't fill a
worker's memory and nothing behind any length is lost. A window ends before an unfinished run if it can; a run of encoded characters
longer than a window, inside compressed data, is decoded in pieces, and data compressed again inside such a run is followed in its
first piece only. The text itself has no bound.

A null or empty text has no findings and gives a row all the same, as does a null id; repeated rows give repeated rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

# The three kinds of secret.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Runs shorter than the least needn't be matched: they'd be dropped, and matches of this kind can't overlap another run.
_HEX = re.compile(r"[0-9a-f]{24,}")
ORDER = {k: i for i, k in enumerate(KINDS)}


def findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind: leftmost matches of each kind that don't overlap, the too short ones dropped."""
    out = [(m.start(), m.end(), "assign") for m in PATTERNS["assign"].finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in PATTERNS["access"].finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]], x[1]))


_ESCAPES = re.compile(r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|(?P<uni>(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+)|(?P<ref>&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);)")
_UNI = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of one length, as wrapped base64 has them, and a shorter last one.
_NEXT_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
_HEX_TEXT = re.compile(r"(?:[0-9A-Fa-f]{2}){12,}")
_OPEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-\r\n"
_BLANKS = re.compile(r" {1025,}")


class Layer:
    """A text, and for each of its characters the span of the original it comes from, and if it was decoded."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, decoded: np.ndarray, path: str) -> None:
        self.text, self.starts, self.ends, self.decoded, self.path = text, starts, ends, decoded, path

    @classmethod
    def plain(cls, text: str) -> Layer:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1, np.zeros(len(text), bool), "")


def _utf8(raw: bytes) -> list[tuple[str, int, int]]:
    """(character, start, end) of UTF-8; a part that is none is one U+FFFD."""
    out, at, view = [], 0, memoryview(raw)
    while at < len(raw):
        try:
            text, stop, end = codecs.utf_8_decode(view[at:], "strict", True)[0], len(raw), len(raw)
        except UnicodeDecodeError as wrong:
            stop, end = at + wrong.start, at + wrong.end
            text = codecs.utf_8_decode(view[at:stop], "strict", True)[0]
        for char in text:
            n = len(char.encode())
            out.append((char, at, at + n))
            at += n
        if stop < end:
            out.append(("\ufffd", stop, end))
        at = end
    return out


def _unescaped(m: re.Match) -> list[tuple[str, int, int]]:
    """(character, start, end) of what an escape decodes to, relative to the layer; nothing if it doesn't."""
    a = m.start()
    if m["url"]:
        return [(char, a + 3 * s, a + 3 * e) for char, s, e in _utf8(bytes.fromhex(m["url"].replace("%", "")))]
    if m["uni"]:
        units = [(int(x[1] or x[2] or x[3], 16), a + x.start(), a + x.end()) for x in _UNI.finditer(m["uni"])]
        out, k = [], 0
        while k < len(units):
            code, s, e = units[k]
            k += 1
            if 0xD800 <= code < 0xDC00 and k < len(units) and 0xDC00 <= units[k][0] < 0xE000:
                low, _, e = units[k]
                k += 1
                code = 0x10000 + (code - 0xD800) * 1024 + low - 0xDC00
            out.append(("\ufffd" if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code), s, e))
        return out
    char = html.unescape(m["ref"])
    return [(char, a, m.end())] if len(char) == 1 else []


def unescape(layer: Layer) -> Layer | None:
    """One level of percent, Unicode and reference escapes undone over the whole layer."""
    text = layer.text
    if "%" not in text and "\\" not in text and "&" not in text:
        return None
    parts, starts, ends, flags, at = [], [], [], [], 0
    for m in _ESCAPES.finditer(text):
        found = _unescaped(m)
        if not found:
            continue
        a = m.start()
        parts += [text[at:a], "".join(c for c, _, _ in found)]
        starts += [layer.starts[at:a], layer.starts[[s for _, s, _ in found]]]
        ends += [layer.ends[at:a], layer.ends[[e - 1 for _, _, e in found]]]
        flags += [layer.decoded[at:a], np.ones(len(found), bool)]
        at = m.end()
    if not parts:
        return None
    parts, starts, ends, flags = [*parts, text[at:]], [*starts, layer.starts[at:]], [*ends, layer.ends[at:]], [*flags, layer.decoded[at:]]
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends), np.concatenate(flags), layer.path + ">escape")


def _printable(text: str) -> float:
    return sum(c != "\ufffd" and (c.isprintable() or c in "\n\r\t") for c in text) / max(1, len(text))


def _read(data: bytes) -> tuple[list[tuple[str, int, int]], bool] | None:
    """(character, start, end) of bytes that are text, and if they surely are: UTF-8 with a few wrong bytes, or UTF-16."""
    if not data:
        return None
    if data.isascii() and _printable(data.decode()) >= 0.95:
        return [(chr(b), i, i + 1) for i, b in enumerate(data)], True
    mark = 2 if data[:2] in (b"\xff\xfe", b"\xfe\xff") else 0
    big, little = data[::2].count(0), data[1::2].count(0)
    if mark or max(big, little) >= 0.2 * len(data):
        order = "big" if data[:2] == b"\xfe\xff" or (not mark and big > little) else "little"
        units = [(int.from_bytes(data[i : i + 2], order), i) for i in range(mark, len(data) - 1, 2)]
        out, k = [], 0
        while k < len(units):
            code, i = units[k]
            k += 1
            end = i + 2
            if 0xD800 <= code < 0xDC00 and k < len(units) and 0xDC00 <= units[k][0] < 0xE000:
                code, end = 0x10000 + (code - 0xD800) * 1024 + units[k][0] - 0xDC00, end + 2
                k += 1
            out.append(("\ufffd" if 0xD800 <= code < 0xE000 else chr(code), i, end))
        if _printable("".join(c for c, _, _ in out)) >= 0.9:
            return out, True
    share = _printable(data.decode("utf-8", "replace"))
    return (_utf8(data), share >= 0.95) if share >= 0.7 else None


def _inflater(data: bytes):
    """What unfolds this, or none if it isn't compressed."""
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 0x0F == 8 and (data[0] << 8 | data[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflated(data: bytes, step: int, raw: bool = False) -> Iterator[bytes]:
    """The unfolded data in pieces of at most `step` bytes, of all members; what comes before an error is given."""
    while data and (unfold := zlib.decompressobj(-15) if raw else _inflater(data)) is not None:
        try:
            while not unfold.eof:
                piece = unfold.decompress(data, step)
                if isinstance(unfold, bz2.BZ2Decompressor | lzma.LZMADecompressor):
                    data = b""
                    if not piece and unfold.needs_input:
                        return  # cut off
                else:
                    data = unfold.unconsumed_tail
                    if not piece and not data and not unfold.eof:
                        return
                if piece:
                    yield piece
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        data, raw = unfold.unused_data, False


def _unfolded(data: bytes, step: int) -> Iterator[bytes] | None:
    """As `_inflated`, data compressed again unfolded too; none if it isn't compressed. Without a header it must unfold to text."""
    if _inflater(data) is None:
        start = next(_inflated(data, 4096, raw=True), b"")
        return _inflated(data, step, raw=True) if len(start) >= 16 and (found := _read(start)) and found[1] else None
    pieces = _inflated(data, step)
    first = next(pieces, b"")
    if not first:
        return None
    inner = _inflater(first)
    if inner is not None and next(_inflated(first, 16), b""):
        return _again(first, pieces, step)
    return _chained(first, pieces)


def _chained(first: bytes, pieces: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from pieces


def _again(first: bytes, pieces: Iterator[bytes], step: int) -> Iterator[bytes]:
    """A stream that is compressed itself, unfolded as it comes."""
    held, unfold = first, _inflater(first)
    out = _streamed(held, unfold, pieces, step)
    start = next(out, b"")
    if start and _inflater(start) is not None and next(_inflated(start, 16), b""):
        yield from _again(start, out, step)
    elif start:
        yield from _chained(start, out)


def _streamed(held: bytes, unfold, pieces: Iterator[bytes], step: int) -> Iterator[bytes]:
    try:
        while True:
            while held and not unfold.eof:
                piece = unfold.decompress(held, step)
                held = unfold.unconsumed_tail if hasattr(unfold, "unconsumed_tail") else b""
                if piece:
                    yield piece
                while not hasattr(unfold, "unconsumed_tail") and not unfold.eof and not unfold.needs_input:
                    yield unfold.decompress(b"", step)
            if unfold.eof:
                held = unfold.unused_data + held
                while len(held) < 8 and (more := next(pieces, b"")):
                    held += more
                if (unfold := _inflater(held)) is None:
                    return
            elif not held:
                if not (held := next(pieces, b"")):
                    return
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return


def _windows(pieces: Iterator[bytes], window: int) -> Iterator[str]:
    """The text of a stream in windows of about that many characters. A window ends before the run it would cut, unless that is as long
    as the window; then the next begins within it, at a multiple of four. Long blanks, which no rule counts, are shortened. Windows
    overlap by what the run before the cut may belong to, at least 4096 characters."""
    decoder, held, wide = None, "", None
    for piece in pieces:
        if decoder is None:
            wide = piece[:2] in (b"\xff\xfe", b"\xfe\xff")
            decoder = codecs.getincrementaldecoder("utf-16" if wide else "utf-8")("replace")
        held += decoder.decode(piece)
        if len(held) > window:
            held = _BLANKS.sub(" " * 1024, held)
        while len(held) > window:
            run = len(held.rstrip(_OPEN))
            cut = run if run > len(held) - window // 2 else run + (len(held) - run) // 4 * 4
            yield held[:cut]
            held = held[max(0, cut - 4096) :]
            if len(held) <= 4096 + window // 2:
                break
    if decoder is not None and (held := held + decoder.decode(b"", True)):
        yield held


def _base64(run: str) -> bytes | None:
    if run.isalpha() and (run.islower() or run.isupper()):
        return None  # a word
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return None


def _layers_of(layer: Layer, at: np.ndarray, data: bytes, per: tuple[int, int], path: str, window: int) -> tuple[Iterator[Layer], bool]:
    """The layers that a run's bytes make, and if it surely was encoded. at: where its characters are; per: (characters, bytes)."""
    first, last = int(layer.starts[at[0]]), int(layer.ends[at[-1]])
    if (pieces := _unfolded(data, min(window, 1 << 20))) is not None:

        def windows() -> Iterator[Layer]:
            for text in _windows(pieces, window):
                yield Layer(text, np.full(len(text), first), np.full(len(text), last), np.ones(len(text), bool), layer.path + path + ">inflate")

        return windows(), True
    if (found := _read(data)) is None:
        return iter(()), False
    chars, sure = found
    starts, ends = np.array([s for _, s, _ in chars]), np.array([e for *_, e in chars])
    n, m = per
    starts, ends = layer.starts[at[starts * n // m]], layer.ends[at[np.minimum((ends * n - 1) // m, len(at) - 1)]]
    return iter([Layer("".join(c for c, _, _ in chars), starts, ends, np.ones(len(chars), bool), layer.path + path)]), sure


def _wrapped(text: str, m: re.Match) -> tuple[str, np.ndarray, int] | None:
    """A run that goes on over lines of one length, the places of its characters, and where it ends."""
    width, spans, at = m.end() - m.start(), [(m.start(), m.end())], m.end()
    if text[m.end() - 1] == "=":
        return None
    while (more := _NEXT_LINE.match(text, at)) and (n := more.end(1) - more.start(1)) <= width:
        spans.append(more.span(1))
        at = more.end()
        if n < width or text[at - 1] == "=":
            break
    return ("".join(text[a:b] for a, b in spans), np.concatenate([np.arange(a, b) for a, b in spans]), at) if len(spans) > 1 else None


def encoded(layer: Layer, window: int) -> Iterator[Layer]:
    """The layers of runs that decode from base64 or hexadecimal to text or to compressed data. A run that goes on over lines is tried
    whole, and without its last line, which may be a word; one that isn't surely encoded is tried in parts too, as `/`, `-` and `_`
    also stand between things."""
    text, done, tried = layer.text, 0, 0
    for m in _BASE64.finditer(text):
        if m.start() >= tried and (wrap := _wrapped(text, m)):
            lines, places, tried = wrap
            line = m.end() - m.start()
            for n in dict.fromkeys((len(lines), len(lines) // line * line)):
                run = lines[:n].rstrip("=")
                if (data := _base64(run)) is None:
                    continue
                found, sure = _layers_of(layer, places[: len(run)], data, (8, 6), ">base64", window)
                if sure:
                    yield from found
                    done = tried
                    break
        if m.start() < done:
            continue
        whole = m[0].rstrip("=")
        sure = False
        if (data := _base64(whole)) is not None:
            found, sure = _layers_of(layer, np.arange(m.start(), m.start() + len(whole)), data, (8, 6), ">base64", window)
            yield from found
        if not sure:
            for x in re.finditer(r"[A-Za-z0-9+]{16,}", whole):
                if x[0] != whole and (data := _base64(x[0])) is not None:
                    yield from _layers_of(layer, np.arange(m.start() + x.start(), m.start() + x.end()), data, (8, 6), ">base64", window)[0]
    for m in _HEX_TEXT.finditer(text):
        found, sure = _layers_of(layer, np.arange(m.start(), m.end()), bytes.fromhex(m[0]), (2, 1), ">hex", window)
        if sure:
            yield from found


def scan(text: str, window: int = 16 << 20) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, str]]]:
    """(base findings, findings of deeper layers with the layer's path)."""
    base = findings(text)
    if not ("%" in text or "\\" in text or "&" in text or _BASE64.search(text)):
        return base, []

    def made(layer: Layer) -> Iterator[Layer]:
        yield from encoded(layer, window)
        if (plain := unescape(layer)) is not None:
            yield plain

    more: dict[tuple[int, int, str], str] = {}
    digest = lambda x, s, e: (hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest(), s, e)
    work, seen = [made(Layer.plain(text))], {digest(text, 0, len(text))}
    while work:  # the worklist, its layers unfolded when their turn comes
        if (new := next(work[-1], None)) is None:
            work.pop()
            continue
        if not new.text or (key := digest(new.text, int(new.starts[0]), int(new.ends[-1]))) in seen:
            continue
        seen.add(key)
        work.append(made(new))
        for s, e, kind in findings(new.text):
            if new.decoded[s:e].any():
                more.setdefault((int(new.starts[s:e].min()), int(new.ends[s:e].max()), kind), new.path[1:])
    had = set(base)
    return base, sorted(((*k, p) for k, p in more.items() if k not in had), key=lambda x: (x[0], ORDER[x[2]], x[1]))


def joined(spans) -> str:
    return ",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in spans)


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers string"


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 16 << 20) -> DataFrame:
    """A row for each row: counts of base findings, the digest of their spans, all spans (kind:start:end in code points, end
    exclusive, by start, then kind), and the decoded ones again with the path of layers (`kind:start:end:path`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, more = scan(text or "", window)
                kinds = [k for _, _, k in base]
                every = sorted([*base, *(x[:3] for x in more)], key=lambda x: (x[0], ORDER[x[2]], x[1])) if more else base
                out.append((i, *(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), ",".join(f"{k}:{s}:{e}:{p}" for s, e, k, p in more)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (*[pa.int64()] * 4, *[pa.string()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in REPORT.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, REPORT)
