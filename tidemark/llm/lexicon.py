"""A minimal acyclic transducer over words: it maps a word to its token ids.

Words are added in sorted order; equal suffixes share states. Every arc carries how many
words sort before those behind it, so the outputs along a word's path sum up to its rank in
the lexicon, and the rank points into one array of token ids. Arcs are packed by row
displacement (slot = base of the state + label), which lets numpy walk many words at once.
"""

from __future__ import annotations

import json
import tempfile

import numpy as np

LONGEST = 64  # characters of a lexicon word
TRIES = 30  # free slots tried for a state before its arcs go behind all others


class _State:
    __slots__ = ("arcs", "final", "key")

    def __init__(self):
        self.arcs: dict[str, _State] = {}
        self.final = False
        self.key = -1


def _minimal(words: list[str]) -> tuple[_State, list[_State]]:
    """Start state, and all states with every state behind those it leads to (children first)."""
    register: dict[tuple, _State] = {}
    order: list[_State] = []
    path = [_State()]
    last = ""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            sign = (state.final, tuple((c, s.key) for c, s in state.arcs.items()))
            same = register.get(sign)
            if same is None:
                state.key = len(order)
                register[sign] = state
                order.append(state)
            else:
                path[-1].arcs[last[len(path) - 1]] = same

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        for c in word[shared:]:
            state = _State()
            path[-1].arcs[c] = state
            path.append(state)
        path[-1].final = True
        last = word
    close(0)
    path[0].key = len(order)
    order.append(path[0])
    return path[0], order


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The packed transducer of ``entries`` (word -> token ids); words over LONGEST are left out."""
    words = sorted(w for w in entries if 0 < len(w) <= LONGEST)
    start, order = _minimal(words)
    behind = [0] * len(order)
    for s in order:
        behind[s.key] = s.final + sum(behind[t.key] for t in s.arcs.values())
    alphabet = sorted({c for w in words for c in w})
    label = {c: i + 1 for i, c in enumerate(alphabet)}
    width = len(alphabet) + 1
    n = len(order)
    base = np.zeros(n + 1, np.int32)
    taken = bytearray(sum(len(s.arcs) for s in order) + 8 * width)
    owner, target, output = {}, {}, {}
    low = 1  # below it every slot is taken or was passed over
    for s in sorted(order, key=lambda s: -len(s.arcs)):
        if not s.arcs:
            continue
        labels = [label[c] for c in s.arcs]
        slot = low
        for attempt in range(TRIES + 1):
            slot = taken.find(0, slot)
            b = slot - labels[0]
            if b >= 0 and not any(map(taken.__getitem__, [b + k for k in labels])):
                break
            slot += 1
        else:
            low = taken.find(0, low + 1)
            b = taken.rfind(1) + 1
        if b + 2 * width >= len(taken) - width:
            taken.extend(bytes(len(taken) // 4 + 4 * width))
        base[s.key] = b
        rank = int(s.final)
        for k, (c, t) in zip(labels, s.arcs.items()):
            taken[b + k] = 1
            owner[b + k], target[b + k], output[b + k] = s.key, t.key, rank
            rank += behind[t.key]
    size = max(owner, default=0) + 2 * width + 2
    arrays = {
        "label": np.zeros(max(map(ord, alphabet), default=0) + 2, np.int32),
        "base": base,
        "owner": np.full(size, -1, np.int32),
        "target": np.zeros(size, np.int32),
        "output": np.zeros(size, np.int32),
        "final": np.array([*(s.final for s in order), False]),
        "first": np.cumsum([0, *(len(entries[w]) for w in words)]).astype(np.int32),
        "ids": np.array([i for w in words for i in entries[w]], np.int32),
    }
    for c, k in label.items():
        arrays["label"][ord(c)] = k
    for name, values in (("owner", owner), ("target", target), ("output", output)):
        if values:
            arrays[name][np.fromiter(values.keys(), np.int64)] = np.fromiter(values.values(), np.int64)
    head, body, at = {"start": start.key, "states": n}, [], 0
    for name, a in arrays.items():
        raw = a.tobytes() + bytes(-a.nbytes % 8)
        head[name] = [at, len(a), a.dtype.str]
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


class Lexicon:
    """The packed transducer, memory-mapped."""

    def __init__(self, packed: bytes):
        self._file = tempfile.TemporaryFile()  # noqa: SIM115  (no name: it goes when the process ends)
        self._file.write(packed)
        self._file.flush()
        size = int.from_bytes(packed[:8], "little")
        head = json.loads(packed[8 : 8 + size])
        self.start, self.sink = head.pop("start"), head.pop("states")
        for name, (at, length, kind) in head.items():
            a = np.memmap(self._file, np.dtype(kind), "r", 8 + size + at, length) if length else np.zeros(0, kind)
            setattr(self, name, np.asarray(a))

    def ranks(self, words: list[str]) -> np.ndarray:
        """Rank of each word in the lexicon, -1 for a word that it doesn't hold."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        order = np.argsort(-np.minimum(lengths, LONGEST + 1), kind="stable")
        order = order[int((lengths > LONGEST).sum()) :]
        lengths_o = lengths[order]
        at = (ends - lengths)[order]
        labels = self.label[np.minimum(text, len(self.label) - 1)]
        state = np.full(len(order), self.start, np.int64)
        rank = np.zeros(len(order), np.int64)
        live = len(order)
        for j in range(int(lengths_o[0]) if live else 0):
            live = int(np.searchsorted(-lengths_o, -j, "left"))  # words longer than j
            s, k = state[:live], labels[at[:live] + j]
            slot = self.base[s] + k
            good = (self.owner[slot] == s) & (k > 0)
            rank[:live] += np.where(good, self.output[slot], 0)
            state[:live] = np.where(good, self.target[slot], self.sink)
        found = self.final[state]
        out = np.full(len(words), -1, np.int64)
        out[order] = np.where(found, rank, -1)
        return out
