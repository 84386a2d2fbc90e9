"""Vectorised text scanning shared by the operators of this subpackage.

Everything here works on Arrow string columns, a bounded slice at a time, with
numpy passes over bytes or code points instead of a Python loop over words.
A null text counts as the empty text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_PRIME = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
# The code points with Unicode's White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    inverse = pow(_PRIME, -1, 1 << 64)
    out = []
    for base in (_PRIME, inverse):
        steps = np.full(SLICE_BYTES * 2, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of values, an uint64 array maker or array.

    Spans are in order and do not overlap. Equal sequences have equal hashes.
    """
    power, inverse = _powers()
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + len(power) - 1, side="right")))
        lo, hi = starts[at:stop] - base, ends[at:stop] - base
        length = int(hi[-1])
        if length >= len(power):
            out[at] = _long_hash(values[base : base + length])
        else:
            total = np.zeros(length + 1, dtype=np.uint64)
            np.cumsum(values[base : base + length] * power[:length], out=total[1:])
            out[at:stop] = (total[hi] - total[lo]) * inverse[lo]
        at = stop
    return mix64(out + (ends - starts).astype(np.uint64))


def _long_hash(values: np.ndarray) -> np.uint64:
    """The same polynomial for one span longer than the tables."""
    power, _ = _powers()
    total, shift, step = 0, 1, pow(_PRIME, len(power), 1 << 64)
    for at in range(0, len(values), len(power)):
        part = values[at : at + len(power)]
        total = (total + shift * int((part * power[: len(part)]).sum(dtype=np.uint64))) & _MASK
        shift = shift * step & _MASK
    return np.uint64(total)


class WordRule(NamedTuple):
    """Which bytes make words, and what each byte counts as."""

    member: np.ndarray
    value: np.ndarray


def _rule(inside, lower: bool) -> WordRule:
    member = np.array([inside(b) for b in range(256)])
    folded = np.arange(256, dtype=np.uint64)
    if lower:
        folded[65:91] += np.uint64(32)
    return WordRule(member, mix64(folded + np.uint64(0x51ED270B7A3C9D15)))


def _not_blank(b: int) -> bool:
    return b != 0x20 and not 9 <= b <= 13


def _alphanumeric(b: int) -> bool:
    return b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122


#: Runs without ASCII white space, as they are and with A-Z lower-cased.
BLANK_EXACT = _rule(_not_blank, False)
BLANK_LOWER = _rule(_not_blank, True)
#: Runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased.
ALNUM_LOWER = _rule(_alphanumeric, True)


class Words(NamedTuple):
    """The words of texts lo..hi-1 of a column: word i is buf[start[i]:end[i]];
    those of text lo+k are first[k]..first[k+1]-1."""

    lo: int
    hi: int
    buf: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def as_strings(column) -> pa.Array:
    """One array of strings, with empty ones for nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive runs of texts of at most `most` bytes, or of one longer text."""
    buf, bounds = _buffer(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, side="right")) - 1)
        yield lo, hi, buf[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def words(column, rule: WordRule, most: int = SLICE_BYTES) -> Iterator[Words]:
    for lo, hi, buf, bounds in slices(as_strings(column), most):
        member = rule.member[buf]
        before = np.zeros(len(buf) + 1, dtype=bool)
        before[1:] = member
        before[bounds] = False
        after = np.zeros(len(buf) + 1, dtype=bool)
        after[:-1] = member
        after[bounds] = False
        start = np.flatnonzero(member & ~before[:-1])
        end = np.flatnonzero(member & ~after[1:]) + 1
        value = _Lazy(rule.value, buf)
        yield Words(lo, hi, buf, bounds, start, end, span_hashes(value, start, end), np.searchsorted(start, bounds))


class _Lazy:
    """values[buf], looked up only where it is sliced."""

    def __init__(self, table: np.ndarray, index: np.ndarray):
        self.table, self.index = table, index

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.table[self.index[part]]


class _CodePoints:
    def __init__(self, points: np.ndarray):
        self.points = points

    def __getitem__(self, part: slice) -> np.ndarray:
        return (self.points[part].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the sequences of `width` consecutive elements, by doubling."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    power = hashes  # sequences of `size` elements
    size, out, done = 1, None, 0
    rest = width
    while rest:
        if rest & 1:
            if out is None:
                out, done = power, size
            else:
                n = len(hashes) - (done + size) + 1
                out = mix64(out[:n] * np.uint64(0xA0761D6478BD642F) + power[done : done + n] + np.uint64(done))
                done += size
        rest >>= 1
        if rest:
            n = len(power) - size
            power = mix64(power[:n] * np.uint64(0xE7037ED1A0B428DB) + power[size : size + n] + np.uint64(size))
            size *= 2
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start+1, ... of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    step = np.ones(total, dtype=np.int64)
    step[0] = starts[0]
    heads = np.cumsum(lengths)[:-1]
    step[heads] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


# --- code points -----------------------------------------------------------


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = SPACE
    return out


def distinct_at(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each different hash stands, and for every hash the index of its own.

    One probe of a table settles most; only hashes that lost their slot are sorted.
    """
    n = len(hashes)
    bits = 18 if n < 400_000 else 22
    slot = hashes >> np.uint64(64 - bits)
    table = np.empty(1 << bits, dtype=np.int64)
    table[slot] = np.arange(n)
    own = table[slot]
    lost = np.flatnonzero(hashes[own] != hashes)
    if len(lost):
        _, at, inverse = np.unique(hashes[lost], return_index=True, return_inverse=True)
        own[lost] = lost[at[inverse]]
    mark = np.zeros(n, dtype=bool)
    mark[own] = True
    return np.flatnonzero(mark), (np.cumsum(mark) - 1)[own]


def first_of(hashes: np.ndarray) -> np.ndarray:
    """For every hash, where the first equal one stands; as distinct_at, by one probe of a table where that settles it."""
    n = len(hashes)
    bits = 18 if n < 60_000 else 22
    slot = hashes >> np.uint64(64 - bits)
    table = np.empty(1 << bits, dtype=np.int32)
    table[slot[::-1]] = np.arange(n - 1, -1, -1, dtype=np.int32)
    own = table[slot].astype(np.int64)
    lost = np.flatnonzero(hashes[own] != hashes)
    if len(lost):
        _, at, inverse = np.unique(hashes[lost], return_index=True, return_inverse=True)
        own[lost] = lost[at[inverse]]
    return own


class Pieces(NamedTuple):
    """Spans of code points of texts lo..hi-1; span i is text[start[i]:end[i]] of
    their concatenation, those of text lo+k are first[k]..first[k+1]-1."""

    lo: int
    hi: int
    text: str
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def distinct(self) -> tuple[list[str], np.ndarray]:
        """The different spans, and for every span the index of its own."""
        at, inverse = distinct_at(self.hash)
        text = self.text
        return [text[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist())], inverse


def _decoded(column, most: int):
    for lo, hi, buf, bounds in slices(as_strings(column), most):
        text = buf.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        if len(points) == len(buf):
            at = bounds
        else:
            lead = np.zeros(len(buf) + 1, dtype=np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
            at = lead[bounds]
        yield lo, hi, text, points, at


def pretokens(column, most: int = SLICE_BYTES) -> Iterator[Pieces]:
    """Splits texts as the public byte-level pattern does:
    contractions, ` ?letters`, ` ?numbers`, ` ?others`, white space.

    The last white-space character before other text stands alone unless it is
    U+0020, which goes to the piece that follows.
    """
    table = classes()
    for lo, hi, text, points, at in _decoded(column, most):
        n = len(points)
        kind = table[points]
        head = np.zeros(n + 1, dtype=bool)  # a text begins here, or the end
        head[at] = True
        changed = np.ones(n, dtype=bool)
        changed[1:] = kind[1:] != kind[:-1]
        changed |= head[:n]
        space = kind == SPACE
        blank = np.zeros(n, dtype=bool)  # the character before is U+0020 of the same text
        blank[1:] = points[:-1] == 32
        blank &= ~head[:n]
        last = np.zeros(n, dtype=bool)  # white space with other text right behind it
        last[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
        start = (changed & ~(blank & ~space)) | last
        _contractions(points, kind, head, start)
        spans = np.flatnonzero(start)
        ends = np.append(spans[1:], n) if len(spans) else spans
        yield Pieces(lo, hi, text, spans, ends, span_hashes(_CodePoints(points), spans, ends), np.searchsorted(spans, at))


def _contractions(points: np.ndarray, kind: np.ndarray, head: np.ndarray, start: np.ndarray) -> None:
    n = len(points)
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~head[quote + 1]]
    one = points[quote + 1]
    two = np.where((quote + 2 < n) & ~head[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(pairs, 2, size)
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    after = quote + 1 + size
    inside = after < n
    after = after[inside]
    after = after[~head[after] & (kind[after] == LETTER)]
    start[after] = True


def letter_runs(column, most: int = SLICE_BYTES) -> Iterator[Pieces]:
    """Maximal runs of letters, lower-cased."""
    table = classes()
    lowered = pc.utf8_lower(as_strings(column))
    for lo, hi, text, points, at in _decoded(lowered, most):
        member = table[points] == LETTER
        before = np.zeros(len(points) + 1, dtype=bool)
        before[1:] = member
        before[at] = False
        after = np.zeros(len(points) + 1, dtype=bool)
        after[:-1] = member
        after[at] = False
        start = np.flatnonzero(member & ~before[:-1])
        end = np.flatnonzero(member & ~after[1:]) + 1
        yield Pieces(lo, hi, text, start, end, span_hashes(_CodePoints(points), start, end), np.searchsorted(start, at))
