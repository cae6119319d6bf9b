"""Exact byte-level BPE over whole texts through a cache of pre-tokens."""

from __future__ import annotations

import os
import re
import sys

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from array import array  # noqa: E402
from functools import cache as once  # noqa: E402
from itertools import chain  # noqa: E402

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402

#: Splits a text as the tokenizer's own byte-level rule does, for texts without a character of ODD.
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters whose class Python's re and the tokenizer may see differently; such a text goes to the tokenizer whole.
ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ԯ -⁯₠-₿一-龥]")
#: Entries of a worker's cache, about 170 bytes each, which an idle worker keeps. Those not asked for lately go when it is full, which changes speed only.
CACHE_ROWS = 1 << 17
#: Rows of a worker's packed ids, 12 bytes each: up to so many ids, without the pre-token, as the ids spell it. A new one takes the row of an old one.
SPELT_ROWS, SPELT_IDS = 1 << 21, 6
#: Texts are cut together up to so many characters, about 25 bytes of memory each; a longer one is cut by itself with PIECES.
GROUP_CHARS = 1 << 20
#: Kinds of characters for PIECES; ANY_OTHER is what ODD finds.
SPACE, BLANK, LETTER, DIGIT, SIGN, ANY_OTHER = range(6)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level_text() -> dict[int, str]:
    """The character that the byte-level rule has for each byte that occurs in UTF-8, learnt from the rule itself."""
    from tokenizers.pre_tokenizers import ByteLevel

    rule, found = ByteLevel(add_prefix_space=False, use_regex=False), {}
    for c in map(chr, [*range(0x800), *range(0x800, 0x10000, 0x40), *range(0x10000, 0x110000, 0x1000)]):
        if not 0xD800 <= ord(c) < 0xE000:
            found |= dict(zip(c.encode(), "".join(x for x, _ in rule.pre_tokenize_str(c))))
    return found


@once
def kinds() -> np.ndarray:
    """The kind of each character up to U+FFFF, as Python's re has it."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    table = np.full(1 << 16, ANY_OTHER, np.uint8)
    for kind, which in [(SPACE, r"\s"), (BLANK, " "), (LETTER, r"[^\W\d_]"), (DIGIT, r"\d"), (SIGN, r"[^\s\w]|_")]:
        table[[ord(c) for c in re.findall(which, every)]] = kind
    table[[ord(c) for c in ODD.findall(every)]] = ANY_OTHER
    return table


def cut_together(texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The pieces that PIECES finds in the texts, end to end; the text_count + 1 places where each text's begin; which texts ODD finds.

    Texts that ODD finds have no pieces. Special strings are not looked for.
    """
    whole, sizes = "".join(texts), np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    data, chars = whole.encode(), np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = kinds()[np.minimum(chars, 0xFFFF)]
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(ends, np.flatnonzero(kind == ANY_OTHER), side="right")] = True
    last = np.zeros(len(chars), bool)
    last[ends[sizes > 0] - 1] = True
    run = np.maximum(kind, BLANK)  # white space of both kinds makes one run
    start = np.ones(len(chars), bool)
    start[1:] = (run[1:] != run[:-1]) | last[:-1]
    # The last character of white space before a sign, a letter or a digit is a piece of its own, or, if a blank, begins the next one's.
    before = np.zeros(len(chars), bool)
    before[:-1] = (run[:-1] == BLANK) & (run[1:] != BLANK) & ~last[:-1]
    start |= before
    start[1:] &= ~(before & (kind == BLANK))[:-1]
    # 's, 't, 'm, 'd, 're, 've and 'll where a piece begins.
    at = np.flatnonzero(start & (chars == ord("'")) & ~last)
    one = chars[at + 1]
    short = at[np.isin(one, [ord(c) for c in "stmd"])]
    at, one = at[~last[at + 1]], one[~last[at + 1]]
    two = chars[at + 2]
    long = at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
    start[short + 1] = start[long + 1] = False
    for after in (short + 2, long + 3):
        start[after[after < len(chars)]] = True
    starts = np.flatnonzero(start)
    width = 1 + (chars >= 0x80).astype(np.uint8) + (chars >= 0x800) + (chars >= 0x10000)
    offsets = np.append((np.cumsum(width, dtype=np.int64) - width)[starts], len(data)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    bounds = np.searchsorted(starts, np.append(0, ends))
    if odd.any():
        counts = np.diff(bounds)
        pieces = pieces.filter(pa.array(np.repeat(~odd, counts)))
        bounds = np.append(0, np.cumsum(np.where(odd, 0, counts)))
    return pieces, bounds, odd


class Pretokens(dict):
    """pre-token -> ``value(ids)``, filled on a miss by the tokenizer itself."""

    def __init__(self, path: str, value, rows: int = CACHE_ROWS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.value, self.rows, self.fixed = Tokenizer.from_file(path), value, rows, {}
        self.older: dict = {}
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.marks = special
        self.model, self.byte_text = self.tokenizer.model, byte_level_text()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece_ids(self, piece: str) -> list[int]:
        """The ids of one pre-token, straight from the tokenizer's BPE model."""
        if piece in self.marks:
            return self.ids(piece)
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.byte_text))]

    def __missing__(self, piece: str):
        if len(self) - len(self.fixed) >= self.rows // 2:
            self.older = dict(self)
            self.clear()
            self.update(self.fixed)
        v = self.older.get(piece)
        self[piece] = v = self.value(self.piece_ids(piece)) if v is None else v
        return v

    def preload(self, entries: dict) -> None:
        self.fixed = entries
        self.update(entries)

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens and special strings of a text in order; None if it must go to the tokenizer whole."""
        if ODD.search(text):
            return None
        if self.special is None or not any(x in text for x in self.marks):
            return PIECES.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else PIECES.findall(part)
        return out


class PackedIds(Pretokens):
    """Packed ids of whole texts, many texts at once. Each distinct pre-token of a group of texts is looked up once."""

    def __init__(self, path: str, rows: int = CACHE_ROWS, spelt_rows: int = SPELT_ROWS):
        super().__init__(path, packed, rows)
        self.spelt = np.zeros(spelt_rows, np.dtype((np.void, 2 * SPELT_IDS)))  # ids + 1, then zeros
        as_byte, spelling = {ord(c): b for b, c in self.byte_text.items()}, [b""] * 0xFFFF
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if k < 0xFFFF:
                spelling[k] = token.translate(as_byte).encode("latin-1", "replace")
        self.spelling = pa.array(spelling, pa.binary())

    def of_texts(self, texts: list[str]):
        """The packed ids of each text."""
        group: list[str] = []
        size = 0
        for text in texts:
            if group and size + len(text) > GROUP_CHARS:
                yield from self.of_group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            yield from self.of_group(group)

    def of_group(self, texts: list[str]):
        alone = [len(x) > GROUP_CHARS or any(m in x for m in self.marks) for x in texts]
        cut, bounds, odd = cut_together(["" if a else x for x, a in zip(texts, alone)])
        coded = cut.dictionary_encode()
        _, offsets, data = self.of_pieces(coded.dictionary).take(coded.indices).buffers()
        bounds = np.frombuffer(offsets, np.int32)[bounds].tolist() if len(cut) else [0] * len(bounds)
        data = memoryview(data or b"")
        for k, text in enumerate(texts):
            if alone[k]:
                pieces = self.pieces(text)
                yield packed(self.ids(text)) if pieces is None else b"".join(map(self.__getitem__, pieces))
            else:
                yield packed(self.ids(text)) if odd[k] else bytes(data[bounds[k] : bounds[k + 1]])

    def of_pieces(self, pieces: pa.StringArray) -> pa.BinaryArray:
        """The packed ids of distinct pre-tokens: the row's if they spell the pre-token, else the tokenizer's, which take the row."""
        names = pieces.to_pylist()
        slots = np.array(list(map(hash, names)), np.int64) % len(self.spelt)
        rows = self.spelt[slots].view(np.uint16).reshape(-1, SPELT_IDS)
        there = rows > 0
        ends, ids = np.append(0, np.cumsum(there.sum(1))), rows[there].astype("<u4") - 1
        spelt = self.spelling.take(pa.array(ids))
        spelt_at = np.frombuffer(spelt.buffers()[1], np.int32)[ends] if len(spelt) else ends
        known = pc.equal(binary_of(spelt_at, spelt.buffers()[2]), pieces.cast(pa.binary())).to_numpy(zero_copy_only=False)
        missed = np.flatnonzero(~known)
        made = [self.piece_ids(names[k]) for k in missed]
        sizes, new = np.array(list(map(len, made)), np.int64), np.fromiter(chain.from_iterable(made), "<u4")
        fits = (sizes > 0) & (sizes <= SPELT_IDS)
        fits[np.repeat(np.arange(len(made)), sizes)[new >= 0xFFFF]] = False
        kept = np.zeros((int(fits.sum()), SPELT_IDS), np.uint16)
        kept[np.arange(SPELT_IDS) < sizes[fits, None]] = new[np.repeat(fits, sizes)] + 1
        self.spelt[slots[missed[fits]]] = kept.view(self.spelt.dtype).ravel()
        both = pa.concat_arrays([binary_of(4 * ends, ids), binary_of(4 * np.append(0, np.cumsum(sizes)), new)])
        where = np.arange(len(names))
        where[missed] = len(names) + np.arange(len(made))
        return both.take(pa.array(where))


def binary_of(offsets: np.ndarray, data) -> pa.BinaryArray:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(b"" if data is None else data)])


LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def count_of(ids: list[int]) -> int:
    return len(ids)


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else b"".join(x.to_bytes(4, "little") for x in ids)


_WORKER: dict = {}


def worker_pretokens(path: str, kind: str) -> Pretokens:
    """One cache a Python worker and kind of value, kept from task to task."""
    key = (path, kind)
    if key not in _WORKER:
        _WORKER[key] = PackedIds(path) if kind == "packed" else Pretokens(path, count_of)
    return _WORKER[key]
