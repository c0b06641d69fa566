"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SIZE = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_SYMBOLS = np.random.default_rng(5).integers(1, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
CHUNK_BYTES = 2_000_000
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def _chunks(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of about CHUNK_BYTES that end at white space or at the end."""
    at, whole = 0, np.frombuffer(data, np.uint8)
    while at < len(whole):
        end = at + CHUNK_BYTES
        while end < len(whole) and not (gap := np.flatnonzero(_SPACE[whole[end : end + CHUNK_BYTES]])[:1]).size:
            end += CHUNK_BYTES
        end = min(len(whole), end + int(gap[0])) if end < len(whole) else len(whole)
        yield at, whole[at:end]
        at = end


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words. A hash is a polynomial over random numbers for bytes: differences of running sums,
    brought to the same power, so that no word becomes an object of its own."""
    starts, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for at, part in _chunks(data):
        gaps = np.concatenate([[True], _SPACE[part], [True]])
        first = np.flatnonzero(gaps[:-1] & ~gaps[1:])
        last = np.flatnonzero(~gaps[:-1] & gaps[1:])
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_SYMBOLS[part] * _power("up", _MULTIPLIER, len(part)), out=sums[1:])
        value = (sums[last] - sums[first]) * _power("down", _INVERSE, len(part))[first]
        starts.append(first + at)
        hashes.append(_mixed(value + (last - first).astype(np.uint64)))
    return np.concatenate(starts), np.concatenate(hashes)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """Of each text its distinct shingles of `size` words, sorted. Words are runs of anything but ASCII white space,
    A-Z as a-z.

    A text with fewer words is one shingle, its whole sequence; one without words has none.
    """
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, flat = _words(b"\n".join(raw).lower())
    counts = np.diff(np.append(0, np.searchsorted(starts, ends))).tolist()
    n = max(0, len(flat) - size + 1)
    total = np.full(n, np.uint64(size))
    for i in range(size):
        total = total * _MULTIPLIER + flat[i : i + n]
    total = _mixed(total)
    sets, start = [], 0
    for count in counts:
        if count >= size:
            own = np.sort(total[start : start + count - size + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif count:
            value = np.array([count], np.uint64)
            for word in flat[start : start + count]:
                value = value * _MULTIPLIER + word
            own = _mixed(value)
        else:
            own = np.empty(0, np.uint64)
        sets.append(own)
        start += count
    return sets


def shingle_set(text: str, size: int = SIZE) -> np.ndarray:
    return shingle_sets([text], size)[0]


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(shingles.tobytes()), dtype=">i8")[0])
