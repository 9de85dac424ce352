"""Word shingles of whole texts as sets of 64-bit hashes, computed with numpy inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

WIDE = 5
U = np.uint64
_DICE = np.random.default_rng(20_240_229)
#: A random number for each byte, with A-Z as a-z; an odd base, its powers and their inverses modulo 2**64.
BYTE = _DICE.integers(1, 2**63, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PLACES = _DICE.integers(1, 2**63, WIDE, dtype=np.uint64) | U(1)
#: Bytes of a text that are hashed at once; a word longer than this is hashed in pieces of it.
PART = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, by doubling; kept for the next call."""
    got = _POWERS.get(str(base))
    if got is None or len(got) < n:
        got = np.ones(1, U)
        while len(got) < n:
            got = np.concatenate([got, got * U(pow(base, len(got), 2**64))])
        _POWERS[str(base)] = got
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (in bytes) of each word."""
    codes = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate([[True], SPACE[codes], [True]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begins):
        return np.zeros(0, U), begins, ends
    sizes = ends - begins
    if len(codes) <= PART:
        total = np.zeros(len(codes) + 1, U)
        np.cumsum(BYTE[codes] * powers(BASE, len(codes)), out=total[1:])
        back = powers(pow(BASE, -1, 2**64), len(codes))
        return mixed((total[ends] - total[begins]) * back[begins] + sizes.astype(U)), begins, ends
    return np.concatenate([_part(text, begins[i:j], ends[i:j]) for i, j in _parts(begins, ends)]), begins, ends


def _parts(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    cuts, i = [], 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + PART, side="right")))
        cuts.append((i, j))
        i = j
    return cuts


def _part(text: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    first, last = int(begins[0]), int(ends[-1])
    if last - first <= PART:
        return word_hashes(text[first:last])[0]
    # one very long word: fold its pieces with the same polynomial
    sum_, at = 0, 0
    for k in range(first, last, PART):
        piece = np.frombuffer(text[k : min(k + PART, last)], np.uint8)
        own = int((BYTE[piece] * powers(BASE, len(piece))).sum(dtype=U))
        sum_ = (sum_ + own * pow(BASE, at, 2**64)) % 2**64
        at += len(piece)
    return mixed(np.array([(sum_ + (last - first)) % 2**64], U))


def windows(words: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word windows in order; of fewer words, one hash of the whole sequence."""
    n = len(words) - WIDE + 1
    if len(words) == 0:
        return np.zeros(0, U)
    if n < 1:
        return mixed((words * PLACES[: len(words)]).sum(dtype=U, keepdims=True) + U(len(words)))
    total = np.zeros(n, U)
    for k in range(WIDE):
        total += words[k : k + n] * PLACES[k]
    return mixed(total + U(WIDE))


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """The text's distinct shingles, ascending; none for a null text or one without words."""
    if text is None:
        return np.zeros(0, U)
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return np.unique(windows(word_hashes(raw)[0]))


def set_digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=16).digest()


def similar(common: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray, percent: int = 75):
    return 100 * common >= percent * (a + b - common)
