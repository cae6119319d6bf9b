"""Operator 6: secret scan with a recursive decoding worklist."""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from array import array
from html.entities import html5
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_batches, texts, tuned

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs; shorter ones fail, so the length is part of the pattern.
HEX = re.compile(r"[0-9a-f]{24,}")
#: A Unicode escape, a run of base64 of 16 characters or more, such runs over several lines, and a run of percent escapes.
ESCAPE_UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]+);|&#([0-9]+);|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|&([A-Za-z][A-Za-z0-9]{1,30};)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)++={0,2}")
BREAK = re.compile(r"\r?\n[ \t]*")
PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
URLSAFE = str.maketrans("-_", "+/")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0e-\x1f\x7f]")
#: Bytes of a compressed layer that are inflated at once, and characters of one window that the next begins with.
WINDOW, OVERLAP = 1 << 20, 1 << 16
#: What a run of base64 or escapes may go on with, backwards from a window's end, and the longest run that is held whole. A longer one is taken in parts of
#: that size, each a multiple of four characters: then its text is found where its parts are ASCII, and what is compressed inside is not.
UNFINISHED = re.compile(r"(?:[A-Za-z0-9+/_=%\\&#;{}-]|[ \t]*+\n\r?)*+")
RUN_MOST = 1 << 26


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns in one layer, in code points, end exclusive."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


class Layer:
    """A text unwrapped from the document; ``at[i]`` and ``to[i]`` are the span that its character i came from.

    The characters of a compressed layer all came from one ``span``, which is held once.
    """

    __slots__ = ("at", "one", "text", "to")

    def __init__(self, text: str, at: array | None, to: array | None, one: tuple[int, int] | None = None):
        self.text, self.at, self.to, self.one = text, at, to, one

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.one or (min(self.at[start:end]), max(self.to[start:end]))

    def slice(self, start: int, end: int) -> Layer:
        if self.one:
            return Layer(self.text[start:end], None, None, self.one)
        return Layer(self.text[start:end], self.at[start:end], self.to[start:end])


def part(text: str, layer: Layer | None, start: int, end: int) -> Layer:
    """A piece of a layer, or of the document itself where ``layer`` is None."""
    if layer is None:
        return Layer(text[start:end], array("q", range(start, end)), array("q", range(start + 1, end + 1)))
    return layer.slice(start, end)


def replaced(piece: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The piece with each match of ``pattern`` replaced by what ``decode`` makes of it."""
    out, at, to, done = [], array("q"), array("q"), 0
    for m in pattern.finditer(piece.text):
        got = decode(m)
        if got is None:
            continue
        out += [piece.text[done : m.start()], got]
        if not piece.one:
            first, last = piece.span(m.start(), m.end())
            at += piece.at[done : m.start()] + array("q", [first]) * len(got)
            to += piece.to[done : m.start()] + array("q", [last]) * len(got)
        done = m.end()
    if not done:
        return None
    text = "".join(out) + piece.text[done:]
    return Layer(text, None, None, piece.one) if piece.one else Layer(text, at + piece.at[done:], to + piece.to[done:])


def from_percent(m: re.Match) -> str | None:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode()
    except UnicodeDecodeError:
        return bytes.fromhex(m[0].replace("%", "")).decode("latin-1")


def from_escape(m: re.Match) -> str | None:
    if m[7]:
        return html5.get(m[7])
    code = int(m[1] or m[2] or m[3] or m[5] or m[6] or "0", 16) if m[4] is None else int(m[4])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def readable(raw: bytes) -> str | None:
    """Text if the bytes are UTF-8 without control characters other than white space."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not CONTROL.search(text) else None


def decoded(raw: bytes) -> tuple[str, str] | None:
    """(text, encoding) of bytes that are readable as UTF-8 or, where every other byte of their head is zero, UTF-16."""
    text = readable(raw)
    if text is not None:
        return text, "utf-8"
    for encoding, zeros in (("utf-16-le", raw[1:64:2]), ("utf-16-be", raw[0:64:2])):
        if len(raw) % 2 == 0 and zeros and not any(zeros):
            try:
                text = raw.decode(encoding)
            except UnicodeDecodeError:
                continue
            if text and not CONTROL.search(text):
                return text, encoding
    return None


def inflater(raw: bytes):
    """A decompressor of gzip, zlib, bzip2 or xz content; None for other bytes. Raw deflate has no mark of its own and is not unwrapped."""
    if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78":
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


DAMAGED = (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError)


def opens(raw: bytes) -> bool:
    """Whether bytes are, or begin, compressed content."""
    inside = inflater(raw)
    try:
        return inside is not None and len(inside.decompress(raw, 64)) > 0
    except DAMAGED:
        return False


def inflated(chunks, inside):
    """The content of compressed chunks, WINDOW bytes at a time; truncated content as far as it goes."""
    for chunk in chunks:
        while not inside.eof:
            out = inside.decompress(chunk, WINDOW)
            yield out
            chunk = getattr(inside, "unconsumed_tail", b"")
            if not chunk and (len(out) < WINDOW if hasattr(inside, "unconsumed_tail") else inside.needs_input):
                break


def content(raw: bytes):
    """The chunks inside compressed bytes, or inside compressed content within each other; None if they aren't compressed or never end."""
    chunks, heads = iter([raw]), set()
    while True:
        head = next((x for x in chunks if x), b"")
        chunks = chain([head], chunks)
        if not opens(head):
            return chunks if heads else None
        if head in heads:
            return None
        heads.add(head)
        chunks = inflated(chunks, inflater(head))


def text_windows(raw: bytes):
    """Texts that cover the text inside compressed bytes, each with the end of the one before: OVERLAP characters, and the whole of a run that may go on.

    So a nested run is in one text as a whole, wherever it begins, up to RUN_MOST characters: memory follows the longest run and not the
    content. DAMAGED errors say that the content is no text.
    """
    decoder, held, most = codecs.getincrementaldecoder("utf-8")(), "", WINDOW
    for chunk in content(raw) or ():
        new = decoder.decode(chunk)
        if CONTROL.search(new):
            raise ValueError("no text")
        held += new
        if len(held) > most:
            run = UNFINISHED.match(held[::-1]).end()
            if OVERLAP < run < RUN_MOST and run > len(held) - WINDOW:
                most = len(held) + WINDOW  # hardly anything else is there: wait for the run's end
                continue
            if run >= RUN_MOST:
                yield held[: len(held) - run % 4]
                held, most = held[-(OVERLAP + (run - OVERLAP) % 4) :], RUN_MOST
                continue
            yield held
            keep = max(OVERLAP, run + 256)
            blank = len(held) - len(held[: len(held) - keep].rstrip(" ")) if held[-keep : -keep + 1] == " " else 0
            held, most = held[-max(keep, min(blank + 256, RUN_MOST)) :], max(WINDOW, keep + WINDOW)
    held += decoder.decode(b"", True)
    if held:
        yield held


def from_base64(piece: Layer):
    """The layers of a base64 run: one text, or the windows of compressed content; None if it decodes to no text."""
    body = piece.text.rstrip("=").translate(URLSAFE)
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    found = decoded(raw)
    if found is None:
        if not opens(raw):
            return None
        own = piece.span(0, len(piece.text))
        try:
            some = sum(1 for _ in text_windows(raw))
        except DAMAGED:
            return None
        return (Layer(x, None, None, own) for x in text_windows(raw)) if some else None
    text, encoding = found
    if piece.one:
        return [Layer(text, None, None, piece.one)]
    at, to, byte = array("q"), array("q"), 0
    for c in text:  # byte k comes from characters 4k/3 to 4(k+1)/3 of the encoded run
        more = len(c.encode(encoding))
        first, last = byte * 4 // 3, min(len(body), -(-(byte + more) * 4 // 3))
        at.append(piece.at[first])
        to.append(piece.to[last - 1])
        byte += more
    return [Layer(text, at, to)]


def readable_until(body: str) -> int:
    """How many characters of a base64 body decode to text before the first byte that is none; all, where it is compressed."""
    done, size, raw = 0, 24, b""
    while done < len(body):
        chunk = body[done : done + size]
        chunk = chunk[: len(chunk) - (len(chunk) % 4 == 1)]
        raw += base64.b64decode(chunk + "=" * (-len(chunk) % 4))
        if not done and opens(raw):
            return len(body)
        done, size = done + size, size * 2
        try:
            text, bad = raw.decode(), len(raw)
        except UnicodeDecodeError as e:
            text, bad = raw[: e.start].decode(), e.start
            if e.reason == "unexpected end of data" and done < len(body):
                bad = len(raw)
        control = re.search(r"[^\t\n\r\f -\x7e\x80-\U0010ffff]", text)
        if control:
            bad = len(text[: control.start()].encode())
        if bad < len(raw):
            return bad * 4 // 3
    return len(body)


def between_boundaries(piece: Layer):
    """Layers of the parts of a run that begin after, or end before, a "/", "-" or "_": paths and prefixes around base64."""
    body = piece.text.rstrip("=")
    cuts = [m.start() for m in re.finditer("[/_-]", body)]
    plain, over = body.translate(URLSAFE), 0
    for start in [0] + [c + 1 for c in cuts]:
        if start < over or len(body) - start < 16:
            continue
        until = start + readable_until(plain[start : start + 24])
        if until < min(start + 16, len(body)):
            continue
        until = start + readable_until(plain[start:])
        ends = [len(piece.text)] if until >= len(body) else []
        at = bisect.bisect_right(cuts, until + 2)
        ends += [c for c in reversed(cuts[max(0, at - 2) : at]) if c - start >= 16]
        for end in ends:
            got = from_base64(piece.slice(start, end))
            if got is not None:
                yield from got
                over = end
                break


def joined_lines(piece: Layer):
    """Layers of base64 that is wrapped over lines.

    Taken together are all lines of the piece, and lines of one length with the first shorter one after them or
    without it; the first of them may be shorter too, where other text stands before it.
    """
    lines, at = [], 0
    for m in BREAK.finditer(piece.text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(piece.text)))
    size = [b - a for a, b in lines]
    groups, k = {(0, len(lines))}, 1
    while k < len(lines):
        end = k
        while end < len(lines) and size[end] == size[k]:
            end += 1
        for first in (k - 1, k):
            groups.update({(first, end), (first, min(end + 1, len(lines)))})
        k = end
    if size[0] == size[1]:
        end = next((k for k, x in enumerate(size) if x != size[0]), len(size))
        groups.update({(0, end), (0, min(end + 1, len(lines)))})
    for first, end in sorted(groups):
        if end - first > 1:
            own = [piece.slice(*x) for x in lines[first:end]]
            text = "".join(x.text for x in own)
            if piece.one:
                one = Layer(text, None, None, piece.one)
            else:
                one = Layer(text, array("q", chain.from_iterable(x.at for x in own)), array("q", chain.from_iterable(x.to for x in own)))
            yield from from_base64(one) or ()


def unwrap(text: str, layer: Layer | None):
    """The layers directly inside a text, one at a time."""
    for run, decode in ((PERCENT_RUN, from_percent), (ESCAPE_UNIT, from_escape)):
        if run.search(text) and (inner := replaced(part(text, layer, 0, len(text)), run, decode)):
            yield inner
    for m in BASE64.finditer(text):
        piece = part(text, layer, *m.span())
        got = from_base64(piece)
        yield from between_boundaries(piece) if got is None else got
    for m in WRAPPED.finditer(text):
        yield from joined_lines(part(text, layer, *m.span()))


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base spans, all spans, layers) of a document, each span as (start, end, kind) in the document's code points.

    The worklist holds the layers that are being unwrapped, the innermost last; each layer that comes of it is scanned and goes on
    the list. It ends when no layer is left; a layer whose text was already unwrapped at the same place is dropped, so
    content that decodes to itself ends too.
    """
    base = scan(text)
    found, seen, work, layers = set(base), set(), [(text, unwrap(text, None))], 0
    while work:
        here, inside = work[-1]
        inner = next(inside, None)
        if inner is None:
            work.pop()
            continue
        if not inner.text or inner.text == here:
            continue
        key = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *(inner.one or (inner.at[0], inner.to[-1])))
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        found.update((*inner.span(start, end), kind) for start, end, kind in scan(inner.text))
        work.append((inner.text, unwrap(inner.text, inner)))
    return base, sorted(found, key=lambda x: (x[0], x[2], x[1])), layers


def said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secret_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) and the number of decoded layers of every row of ``docs``.

    A null or empty text has no spans. Repeated rows each give a row, other columns are ignored, an empty table
    gives an empty result, and texts are scanned whole. Spans found inside a decoded layer are given as the span of
    the document's characters that they were decoded from; one that equals another of its kind is given once.
    """
    tuned(spark)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch):
        base, spans, layers = [], [], []
        for text in texts(batch):
            own, every, n = find_secrets(text)
            base.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted(own, key=lambda x: (x[0], x[2]))])
            spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in every])
            layers.append(n)
        return pa.table({"doc_id": batch.column("doc_id"), "base": pa.array(base, kind), "spans": pa.array(spans, kind), "n_layers": pa.array(layers, pa.int64())})

    spans = "array<struct<kind:string,start:long,end:long>>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, base {spans}, spans {spans}, n_layers long")


def secret_digest(found: DataFrame) -> DataFrame:
    """The digest columns of op6 from ``secret_spans``."""
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), "n_layers")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """A text with every span of ``find_secrets`` replaced; overlapping spans become one mark."""
    out, done = [], 0
    for a, b, _ in find_secrets(text)[1]:
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], mark]
        done = b
    return "".join(out) + text[done:]
