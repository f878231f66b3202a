"""What a run of rows does to a state, as arrays over many runs at once: capped admission and a balance with renewals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Above every balance.
END = 1 << 60


def padded(lists: pa.ListArray, field: str, fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A field of lists of structs as a matrix (list, position) with `fill` behind the end of a list, and the cells that are filled."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    inside = np.arange(lengths.max(initial=0))[None, :] < lengths[:, None]
    out = np.full(inside.shape, fill, dtype=np.int64)
    out[inside] = lists.flatten().field(field).fill_null(fill).to_numpy(zero_copy_only=False)
    return out, inside


def admission_table(pages: np.ndarray, cap: int) -> np.ndarray:
    """For each run the state that it leads to from every state from 0 to `cap`."""
    state = np.tile(np.arange(cap + 1, dtype=np.int32), (len(pages), 1))
    pages = np.clip(pages, 0, cap + 1).astype(np.int32)
    for j in range(pages.shape[1]):
        after = state + pages[:, j, None]
        state = np.where(after <= cap, after, state)
    return state


def admitted(pages: np.ndarray, state: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each request is admitted, and the state after it, from the state that each run starts from."""
    fits, after = np.zeros(pages.shape, dtype=bool), np.zeros(pages.shape, dtype=np.int64)
    pages = np.maximum(pages, 0)
    for j in range(pages.shape[1]):
        fits[:, j] = state + pages[:, j] <= cap
        state = state + np.where(fits[:, j], pages[:, j], 0)
        after[:, j] = state
    return fits, after


@dataclass
class Pieces:
    """Maps of balances, piece by piece: from `lo` to the next piece's, the balance plus `value` if it moves, else `value`.

    Pieces lie by (owner, lo); every owner's first one begins at 0. Balances are whole numbers.
    """

    owner: np.ndarray
    lo: np.ndarray
    moves: np.ndarray
    value: np.ndarray

    def hi(self) -> np.ndarray:
        last = np.append(self.owner[1:] != self.owner[:-1], True)
        return np.where(last, END, np.append(self.lo[1:], END))

    def merged(self) -> "Pieces":
        """Without a border between pieces that do the same."""
        first = np.append(True, (self.owner[1:] != self.owner[:-1]) | (self.moves[1:] != self.moves[:-1]) | (self.value[1:] != self.value[:-1]))
        return self.at(first)

    def at(self, index: np.ndarray) -> "Pieces":
        return Pieces(self.owner[index], self.lo[index], self.moves[index], self.value[index])


def charge_maps(cost: np.ndarray, limit: np.ndarray, refill: np.ndarray) -> Pieces:
    """One map per charge: what is left, at least 0, and the refill if that is below the (positive) limit."""
    count = len(cost)
    owner = np.repeat(np.arange(count), 3)
    lo = np.stack([np.zeros(count, dtype=np.int64), cost, cost + limit], axis=1).ravel()
    moves = np.tile([False, True, True], count)
    value = np.stack([refill, refill - cost, -cost], axis=1).ravel()
    filled = np.append(lo[1:] > lo[:-1], True) | np.append(owner[1:] != owner[:-1], True)
    return Pieces(owner, lo, moves, value).at(filled).merged()


def _after(left: Pieces, right: Pieces) -> Pieces:
    """For each owner the left map, then the right one. Both have the same owners."""
    if not len(left.owner):
        return left
    span = int(max(right.lo.max(), 1)) + 2
    lowest = int(left.owner[0])
    most = max(1, (1 << 62) // span)
    if int(left.owner[-1]) - lowest >= most:
        cut = lowest + most
        halves = [_after(left.at(left.owner < cut), right.at(right.owner < cut)), _after(left.at(left.owner >= cut), right.at(right.owner >= cut))]
        return Pieces(*[np.concatenate([getattr(h, c) for h in halves]) for c in ("owner", "lo", "moves", "value")])

    def key(owner: np.ndarray, balance: np.ndarray) -> np.ndarray:
        return (owner - lowest) * span + np.minimum(balance, span - 1)

    borders = key(right.owner, right.lo)
    begin = np.where(left.moves, left.lo + left.value, left.value)
    end = np.where(left.moves, left.hi() + left.value, left.value + 1)
    first = np.searchsorted(borders, key(left.owner, begin), "right") - 1
    last = np.searchsorted(borders, key(left.owner, np.minimum(end, END)), "left") - 1
    counts = np.maximum(last - first + 1, 1)
    own = np.repeat(np.arange(len(first)), counts)
    hit = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    shift = left.value[own]
    lo = np.where(left.moves[own], np.maximum(left.lo[own], right.lo[hit] - shift), left.lo[own])
    value = np.where(right.moves[hit], shift + right.value[hit], right.value[hit])
    return Pieces(left.owner[own], lo, left.moves[own] & right.moves[hit], value).merged()


def chained(maps: Pieces, sizes: np.ndarray, top: np.ndarray) -> Pieces:
    """Maps in a row, `sizes` of them for each run, put one after the other: neighbours by twos, until each run has one.

    Only balances below `top` (one for each run) are asked for, and no map may lead above it.
    """
    run = np.repeat(np.arange(len(sizes)), sizes)
    maps = maps.at(maps.lo < top[run[maps.owner]]) if len(run) else maps
    place = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    while len(run) and place.max() > 0:
        pair = np.cumsum(place % 2 == 0) - 1
        right = place % 2 == 1
        paired = np.zeros(pair[-1] + 1, dtype=bool)
        paired[pair[right]] = True
        own, odd = pair[maps.owner], right[maps.owner]
        named = Pieces(own, maps.lo, maps.moves, maps.value)
        both = _after(named.at(~odd & paired[own]), named.at(odd))
        alone = named.at(~paired[own])
        joined = Pieces(*[np.concatenate([getattr(both, c), getattr(alone, c)]) for c in ("owner", "lo", "moves", "value")])
        run, place = run[~right], place[~right] // 2
        joined = joined.at(joined.lo < top[run[joined.owner]])
        maps = joined.at(np.lexsort((joined.lo, joined.owner)))
    return Pieces(run[maps.owner], maps.lo, maps.moves, maps.value) if len(run) else maps


def to_bytes(maps: Pieces, top: np.ndarray) -> list[bytes]:
    """The map of each run, with its top in front."""
    bounds = np.searchsorted(maps.owner, np.arange(len(top) + 1))
    table = np.stack([maps.lo, maps.moves.astype(np.int64), maps.value])
    return [np.append(t, table[:, a:b]).astype("<i8").tobytes() for t, a, b in zip(top, bounds[:-1], bounds[1:], strict=True)]


def _read(element: bytes) -> tuple[int, np.ndarray]:
    told = np.frombuffer(element, dtype="<i8")
    return int(told[0]), told[1:].reshape(3, -1)


def compose_pieces(elements: list[bytes]) -> bytes:
    read = [_read(e) for e in elements]
    owner = np.repeat(np.arange(len(read)), [t.shape[1] for _, t in read])
    lo, moves, value = np.concatenate([t for _, t in read], axis=1)
    top = np.array([read[0][0]])
    return to_bytes(chained(Pieces(owner, lo, moves == 1, value), np.array([len(read)]), top), top)[0]


def move_by_pieces(element: bytes, balance: int) -> int:
    _, (lo, moves, value) = _read(element)
    k = int(np.searchsorted(lo, balance, "right")) - 1
    return int(balance + value[k] if moves[k] else value[k])


def compose_tables(elements: list[bytes]) -> bytes:
    state = np.frombuffer(elements[0], dtype="<i4")
    for element in elements[1:]:
        state = np.frombuffer(element, dtype="<i4")[state]
    return state.astype("<i4").tobytes()


def move_by_table(element: bytes, state: int) -> int:
    return int(np.frombuffer(element, dtype="<i4")[state])


def charged(cost: np.ndarray, balance: np.ndarray, limit: np.ndarray, refill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Balance after each charge and whether it was renewed, from the balance that each run starts from."""
    after, again = np.zeros(cost.shape, dtype=np.int64), np.zeros(cost.shape, dtype=bool)
    for j in range(cost.shape[1]):
        balance = np.maximum(0, balance - cost[:, j])
        again[:, j] = balance < limit
        balance = balance + np.where(again[:, j], refill, 0)
        after[:, j] = balance
    return after, again
