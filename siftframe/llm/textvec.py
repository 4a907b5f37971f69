"""Vectorised text primitives: word spans, span hashes, shingles and pre-token boundaries over numpy arrays.

Used inside Spark tasks; every function takes a bounded group of texts (see groups_of) and returns flat arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

U64 = np.uint64
_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=U64)
#: Bytes of a span that are hashed in vectors; longer spans are hashed one by one.
LONG_SPAN = 64
#: A-Z to lower case, nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, and ASCII characters other than letters and digits to spaces.
LOWER_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def groups_of(texts, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of texts of about `most` characters, so that working arrays stay small."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def hash_spans(buf: bytes, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span of buf."""
    padded = buf + b"\0" * 8
    eight = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(lens.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x165667B19E3779F9))
    live = np.flatnonzero((lens > 0) & (lens <= LONG_SPAN))
    off = 0
    while len(live):
        left = lens[live] - off
        chunk = eight[starts[live] + off] & _MASKS[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ chunk) + chunk * U64(0x9E3779B97F4A7C15)
        live = live[left > 8]
        off += 8
    for k in np.flatnonzero(lens > LONG_SPAN):
        h[k] = xxhash.xxh64_intdigest(buf[starts[k] : starts[k] + lens[k]])
    return mix(h)


def words(texts, table: bytes = LOWER) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, word starts, word lengths, number of words of each text) after mapping bytes by `table`."""
    bufs = [b" ".join(t.encode("utf-8", "replace").translate(table).split()) for t in texts]
    buf = b" ".join(bufs) + b" "
    ends = np.flatnonzero(np.frombuffer(buf, dtype=np.uint8) == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lens = ends - starts
    there = lens > 0
    offsets = np.cumsum([len(b) + 1 for b in bufs])
    starts, lens = starts[there], lens[there]
    upto = np.searchsorted(starts, offsets)
    return buf, starts, lens, np.diff(np.concatenate([[0], upto]))


#: Code points that are turned into words at once; longer texts are cut at white space.
PIECE = 1 << 20
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def pieces_of(text: str, most: int) -> Iterator[str]:
    """A text in pieces of `most` code points, and as many more as there are up to the next ASCII white space."""
    start = 0
    while len(text) - start > most and (space := _SPACE.search(text, start + most)):
        yield text[start : space.start()]
        start = space.start()
    yield text[start:]


def word_hashes(texts, table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each); a long text goes through the working arrays in pieces,
    so that 8 bytes a word are all that is held of it."""

    def hashed(some):
        buf, starts, lens, counts = words(some, table)
        return hash_spans(buf, starts, lens), counts

    if max(map(len, texts), default=0) <= PIECE:
        return hashed(texts)
    parts = [[hashed([p])[0] for p in pieces_of(t, PIECE)] for t in texts]
    return np.concatenate([h for own in parts for h in own]), np.array([sum(map(len, own)) for own in parts])


def shingles_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct sorted hashes of the `size`-word shingles of one text's word hashes; the whole text if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    take = min(size, n)
    h = np.full(n - take + 1, U64(take))
    for k in range(take):
        h = mix(h * U64(0x100000001B3) + hashes[k : n - take + 1 + k])
    return np.unique(h)


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """The shingle set of each text, over words after lower-casing A-Z."""
    out = []
    for a, b in groups_of(texts):
        buf, starts, lens, counts = words(texts[a:b])
        h, at = hash_spans(buf, starts, lens), 0
        for n in counts:
            out.append(shingles_of(h[at : at + n], size))
            at += n
    return out


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point: 0 other, 1 letter, 2 number, 3 white space, 4 (beyond Unicode) the end of a text."""
    import regex

    table = np.zeros(0x110001, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    skip = lambda i: i if i < 0xD800 else i + 0x800  # noqa: E731  places to code points
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            for i in range(m.start(), m.end()):
                table[skip(i)] = kind
    table[0x110000] = 4
    return table


END = 0x110000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def pretoken_starts(cps: np.ndarray) -> np.ndarray:
    """Where the matches of public_tokenizers.PATTERN begin in code points; END marks the end of a text and is a
    match of its own.

    In words: a run of letters, of numbers or of other characters takes one space before it. White space before
    other text gives its last character away. An apostrophe that is a run of its own, without a space before it, and
    s, t, m, d, re, ve or ll after it are a match, and the rest of the letters begins anew."""
    n = len(cps)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[cps]
    first = np.ones(n, dtype=bool)
    first[1:] = kind[1:] != kind[:-1]
    first[kind == 4] = True
    begin = first.copy()
    solid = np.flatnonzero(first & (kind != 3) & (kind != 4))
    solid = solid[solid > 0]
    space = cps[solid - 1] == 32
    takes = solid[space]
    begin[takes] = False
    begin[takes - 1] = True
    other = solid[~space]
    other = other[kind[other - 1] == 3]
    begin[other - 1] = True  # white space that is no space stands alone before other text
    # Contractions.
    quote = np.flatnonzero((cps == 39) & first)
    quote = quote[quote + 1 < n]
    quote = quote[kind[quote + 1] == 1]
    before = cps[np.maximum(quote - 1, 0)]
    quote = quote[(quote == 0) | (before != 32)]
    if len(quote):
        one = cps[quote + 1]
        two = cps[np.minimum(quote + 2, n - 1)]
        two = np.where(quote + 2 < n, two, 0)
        short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for which, size in ((short, 2), (long, 3)):
            q = quote[which]
            begin[q + 1] = False
            after = q + size
            begin[after[after < n]] = True
    return np.flatnonzero(begin)
