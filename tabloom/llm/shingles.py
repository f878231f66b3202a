"""Words and five-word shingles of whole texts, as numpy arrays, many texts at once.

A word is a run of bytes other than space and the control characters tab to carriage return, with A-Z lower-cased. A
shingle id is 63 bits: 7 bits that are smaller the longer the shingle is, then 56 hash bits, so sorting ids puts long, and
therefore rare, shingles first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WIDTH = 5
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = np.array(
    [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64
)
_LOW = np.uint64((1 << 56) - 1)
_LONG = 127
#: Bytes of text that are worked on at once; a longer text is worked on alone. A byte takes some 80 bytes while it is hashed.
SLICE_BYTES = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Encoded texts in runs of bounded size; a null is empty."""
    run: list[bytes] = []
    held = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if run and held + len(data) > most:
            yield run
            run, held = [], 0
        run.append(data)
        held += len(data)
    if run:
        yield run


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of bytes from `begin` to `end`."""
    power = np.multiply.accumulate(np.full(len(data), _BASE, dtype=np.uint64))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    back = np.multiply.accumulate(np.full(len(data), _BASE_INVERSE, dtype=np.uint64))
    return mix((total[end] - total[begin]) * back[begin])


def words(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and lengths of all words of a run of texts, and where each text's words begin (one entry more than texts)."""
    sizes = np.fromiter(map(len, run), dtype=np.int64, count=len(run))
    data = _LOWER[np.frombuffer(b"\n".join(run) + b"\n", dtype=np.uint8)]
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = hash_spans(data, begin, end)
    text_ends = np.cumsum(sizes + 1)
    bounds = np.concatenate([[0], np.searchsorted(begin, text_ends)])
    return hashes, end - begin, bounds


def _ids(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    rank = (_LONG - np.minimum(lengths, _LONG)).astype(np.uint64)
    return (rank << np.uint64(56)) | (mix(hashes) & _LOW)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle ids of each text; fewer than five words make one shingle, none make an empty set."""
    for run in slices(texts):
        hashes, lengths, bounds = words(run)
        if len(hashes) >= WIDTH:
            rows = len(hashes) - WIDTH + 1
            joined = sum(hashes[j : j + rows] * _STEPS[j] for j in range(WIDTH))
            ids = _ids(joined, sum(lengths[j : j + rows] for j in range(WIDTH)))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            count = b - a
            if count == 0:
                yield np.zeros(0, dtype=np.uint64)
            elif count < WIDTH:
                own = (hashes[a:b] * _STEPS[:count]).sum(dtype=np.uint64) + np.uint64(count)
                yield _ids(np.array([own]), np.array([lengths[a:b].sum()]))
            else:
                own = np.sort(ids[a : b - WIDTH + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]


def set_id(ids: np.ndarray) -> int:
    """63-bit id of a shingle set: equal sets, equal ids."""
    return xxhash.xxh3_64_intdigest(ids.tobytes()) & ((1 << 63) - 1)
