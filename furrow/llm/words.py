"""Words and 64-bit word hashes, shared by the operators on words.

A word is a run of digits, ASCII letters (case-folded) and any non-ASCII
characters: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. All
of UTF-8's bytes from 0x80 on belong to words, so bytes can be folded and split
without decoding. A null text has no words.
"""

from __future__ import annotations

import numpy as np

#: Byte -> folded byte; what cannot stand in a word becomes a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: White space of the size and quality contracts: 0x20 and 0x09-0x0D become a space.
BLANKS = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
#: The same with A-Z lower-cased.
LOWER_BLANKS = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in BLANKS)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def utf8(text: str | None) -> bytes:
    """The text as UTF-8; a null is empty, lone surrogates are kept as they are."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def folded_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: neighbouring inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate(
            [np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64) - 1, _MULTIPLIER), dtype=np.uint64)]
        )
    return _powers


def word_hashes(text: str | None, piece: int = 1 << 20, fold: bytes = FOLD) -> np.ndarray:
    """One uint64 for each word of the text, in text order; equal words, equal hashes. ``fold`` leaves a space between words.

    Long texts are worked off in pieces cut between words, so memory stays small beside the text.
    """
    data, at, found = utf8(text).translate(fold), 0, []
    while at < len(data):
        end = data.find(b" ", at + piece) if at + piece < len(data) else -1
        end = len(data) if end < 0 else end
        found.append(_piece_hashes(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    letters = data[inside[1:-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    return mix64(np.add.reduceat(letters * _powers_to(int(lengths.max()))[place], firsts))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One uint64 for each run of k words; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return words
    k_here = min(k, len(words))
    n = len(words) - k_here + 1
    out = np.full(n, np.uint64(k_here), np.uint64)
    for j in range(k_here):
        out = out * _MULTIPLIER + words[j : j + n]
    return mix64(out)


def occurrence_labelled(shingles: np.ndarray) -> np.ndarray:
    """Tells apart the first, second, ... occurrence of an equal shingle."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if new.all():
        return shingles
    at = np.arange(len(ordered))
    nth = np.empty(len(ordered), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(nth > 0, mix64(shingles + nth * _MULTIPLIER), shingles)
