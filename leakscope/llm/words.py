"""Words and word shingles of whole texts as 64-bit hashes, computed on arrays of bytes.

A word is a run of bytes other than blank and the controls 9 to 13; A-Z count as a-z.
"""

import numpy as np

from leakscope.llm import memory

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)

# So many bytes are hashed at a time; a longer word makes its segment as long as needed.
SEGMENT = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []
memory.store(_powers.clear)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of each 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 2 * SEGMENT:  # of one giant word; not kept
            return out
        _powers[:] = out
    return _powers


def _segment(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a buffer that begins and ends between words."""
    blank = np.ones(len(buf) + 2, bool)
    blank[1:-1] = _BLANK[buf]
    change = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = change[::2], change[1::2]
    power, inverse = _tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LOWER[buf] * power[: len(buf)], out=total[1:])
    return start, mix((total[end] - total[start]) * inverse[start])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry than texts)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, hashes, at = [], [], 0
    while at < len(buf):
        to = min(at + SEGMENT, len(buf))
        if to < len(buf):
            blanks = np.flatnonzero(_BLANK[buf[at:to]])
            if len(blanks):
                to = at + int(blanks[-1]) + 1
            else:  # a word longer than a segment
                while to < len(buf) and not _BLANK[buf[to]]:
                    to += 1
        s, h = _segment(buf[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
            np.searchsorted(start, begins))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer words than a shingle has one: its whole sequence. No words: an empty set.
    """
    h, begins = word_hashes(texts)
    step = np.uint64(0x2545F4914F6CDD1D)
    n = len(h) - words + 1
    if n > 0:
        rolled = h[:n].copy()
        for i in range(1, words):
            rolled = rolled * step + h[i : n + i]
        rolled = mix(rolled)
    out = []
    for a, b in zip(begins[:-1], begins[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = np.uint64((int(whole) * int(step) + int(x)) % (1 << 64))
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
