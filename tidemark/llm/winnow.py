"""Content-defined anchors (winnowing) and rolling hashes over arrays of items."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE_BITS = np.uint64(28)  # of a packed (hash, place) for the place

LONG_WORD = 48

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(max(n, 1), base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash, never zero, of each word: of ``values`` (1 to 256, by byte) from its start to its end.

    Short words are hashed by a polynomial. Modulo 2^64 that has built-in collisions from some
    hundred symbols on, so words beyond LONG_WORD are hashed by XXH64 of their values.
    """
    out = Spans(values).hash(starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(values[starts[i] : ends[i]].astype(np.uint16).tobytes(), 7)
    return out | np.uint64(1)


class Spans:
    """Hashes of any span of an array of items (values below 2^64, none zero)."""

    def __init__(self, items: np.ndarray):
        up, self.down = powers(len(items) + 1)
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items.astype(np.uint64, copy=False) * up[:-1], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k items from each place at which k are left."""
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[: max(n, 0)]) * self.down[: max(n, 0)]) if n > 0 else np.zeros(0, np.uint64)


@dataclass
class Anchors:
    """Runs of window starts that share an anchor: place of the anchor, first start, number of starts."""

    place: np.ndarray
    first: np.ndarray
    count: np.ndarray


def anchors(grams: np.ndarray, k: int, window: int, group: np.ndarray) -> Anchors:
    """The anchor of every window of ``window`` items that lies in one group.

    It is the leftmost k-gram of smallest hash inside the window, so equal windows have their
    anchor at the same distance, wherever they occur. ``group`` numbers the items' documents in
    order. Beyond 2^PLACE_BITS items, whose places would run into the hashes, the windows are
    walked in segments of that many grams; runs that a border cuts are put together again.
    """
    segment, w = 1 << int(PLACE_BITS), window - k + 1
    if len(grams) <= segment:
        return _anchors(grams, k, window, group)
    step = segment - w + 1  # windows that begin in a segment and end in it
    found = []
    for at in range(0, len(grams) - w + 1, step):
        a = _anchors(grams[at : at + segment], k, window, group[at : at + segment + k - 1])
        found.append((a.place + at, a.first + at, a.count))
    place, first, count = (np.concatenate(c) for c in zip(*found))
    if not len(place):
        return Anchors(place, first, count)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (first[1:] != first[:-1] + count[:-1])]))
    return Anchors(place[new], first[new], np.add.reduceat(count, new))


def _anchors(grams: np.ndarray, k: int, window: int, group: np.ndarray) -> Anchors:
    w = window - k + 1
    n = len(grams) - w + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Anchors(none, none, none)
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    packed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(packed) // w) * w, np.uint64(2**64 - 1))
    padded[: len(packed)] = packed
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & mask).astype(np.int64)
    inside = group[:n] == group[window - 1 : window - 1 + n]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return Anchors(none, none, none)
    place = place[starts]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return Anchors(place[new], starts[new], np.diff(np.concatenate([new, [len(starts)]])))
