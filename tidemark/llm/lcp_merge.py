"""Front-coded sorted runs of byte strings, and their merge by a loser tree that knows prefixes.

A run stores for every string how many leading bytes it shares with the string before it, and
the rest. While merging, each contestant carries the length of the prefix that it shares with
the last string put out. Of two contestants the one that shares more comes first, without
looking at either; only at equal lengths are the bytes behind the known prefix compared, and the
loser remembers how far it agrees with the winner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def shared_lengths(padded: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For sorted rows of a zero-padded byte matrix: bytes shared with the row before (0 for the first)."""
    out = np.zeros(len(padded), np.int64)
    if len(padded) > 1:
        differ = padded[1:] != padded[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), padded.shape[1])
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def unfold(shared: list[int], tails: list[bytes]) -> list[bytes]:
    """The strings of a front-coded run."""
    out, last = [], b""
    for n, tail in zip(shared, tails):
        last = last[:n] + tail
        out.append(last)
    return out


def merge(strings: list[list[bytes]], shared: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in the run, bytes shared with the string put out before), in sorted order.

    ``strings`` are sorted runs and ``shared`` their shared lengths; equal strings may come in
    any order of runs.
    """
    runs = len(strings)
    if not runs:
        return
    size = 1 << max(0, runs - 1).bit_length()
    at = [0] * size
    head: list[bytes | None] = [s[0] if s else None for s in strings] + [None] * (size - runs)
    known = [0 if s is not None else -1 for s in head]  # -1: the run is at its end

    def loses(a: int, b: int, h: int) -> bool:
        """Whether a comes behind b; both share h bytes with the last output. The loser's length is updated."""
        x, y = head[a], head[b]
        m = min(len(x), len(y))
        d = int.from_bytes(x[h:m], "big") ^ int.from_bytes(y[h:m], "big")
        h = m - (d.bit_length() + 7) // 8
        behind = x[h] > y[h] if d else len(x) > len(y)
        known[a if behind else b] = h
        return behind

    loser = [0] * size
    winner = list(range(size)) * 2
    for node in range(size - 1, 0, -1):
        a, b = (winner[2 * node - size] if 2 * node >= size else winner[size + 2 * node],
                winner[2 * node + 1 - size] if 2 * node + 1 >= size else winner[size + 2 * node + 1])
        h = known[a]
        behind = h < known[b] or (h == known[b] and h >= 0 and loses(a, b, h))
        winner[size + node], loser[node] = (b, a) if behind else (a, b)
    top = winner[size + 1] if size > 1 else 0
    while known[top] >= 0:
        place = at[top]
        yield top, place, known[top]
        place += 1
        at[top] = place
        if place < len(strings[top]):
            head[top], h = strings[top][place], shared[top][place]
            known[top] = h
        else:
            h = known[top] = -1
        node = (top + size) >> 1
        while node:
            other = loser[node]
            g = known[other]
            if g > h or (g == h and h >= 0 and loses(top, other, h)):
                loser[node], top = top, other
                h = known[top]
            node >>= 1
