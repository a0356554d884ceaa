"""Word hashes of whole texts, many texts at a time.

Words are the stretches between the bytes 0x20 and 0x09-0x0D.  A word's hash is a polynomial over its bytes modulo
2**64, taken from prefix sums, then mixed; so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Powers a worker keeps of each base; longer texts have theirs computed and forgotten.
KEPT = 1 << 21
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled on demand, up to a bound."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(n if n > KEPT else min(KEPT, max(1 << 16, 1 << int(n).bit_length())), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= KEPT:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first byte, byte after) of the words in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    gap = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    edge = np.concatenate([[0] if not gap[0] else [], edge, [len(raw)] if not gap[-1] else []]).astype(np.int64)
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * powers(_BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64)), starts, ends


def texts_words(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(number, word hashes) of each text; short texts are hashed together, up to ``most`` bytes at once."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end] or b"") < most):
            held += len(texts[end] or b"") + 1
            end += 1
        part = [t or b"" for t in texts[at:end]]
        hashes, starts, _ = word_spans(b"\n".join(part))
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))
        for i in range(len(part)):
            yield at + i, hashes[cuts[i] : cuts[i + 1]]
        at = end


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out)


def long_rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """As ``rolling`` (with other values), at a cost that does not depend on ``k``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, len(hashes)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_INVERSE, len(hashes))[:n])


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of ``k``-word shingles; fewer words make one shingle of them all."""
    if 0 < len(hashes) < k:
        return mix(rolling(hashes, len(hashes)) + _U(len(hashes)))
    return np.unique(rolling(hashes, k))
