"""Words of a word-level BPE tokenizer file, and the exact merge of one word.

The tokenizer file (``tokenizers`` JSON) normalises by NFC, white space to one space and
lower case, splits by a fixed pattern and merges bytes inside each piece. For texts whose
characters are printable ASCII, tab, line ends or letters and signs of U+00A1 to U+017F these
steps are the simple ones below (such characters are stable under NFC and their lower case is
one character each, except U+0130). Every other text, and every text with the string of an
added token, is left to the library itself.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import unicodedata

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SIMPLE_END = 0x180
NO_RANK = 1 << 60


def _char_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SIMPLE_END) if unicodedata.category(chr(c))[0] == kind)


LETTERS, NUMBERS = _char_class("L"), _char_class("N")
SPACES = r"\t\n\r "
# The split pattern of the tokenizer file, with its classes spelled out for simple characters.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
NOT_SIMPLE = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u017f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    symbols = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [symbols[b] for b in range(256)]


class WordBpe:
    """A tokenizer file with its words, merges and token strings at hand."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"]
        added = [a["content"] for a in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.symbols = byte_symbols()
        size = max([*self.vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]

    def words(self, text: str) -> list[str] | None:
        """The pieces of ``text`` in order, or None if only the library can cut it."""
        if NOT_SIMPLE.search(text) or (self.added and self.added.search(text)):
            return None
        return PIECES.findall(text.lower())

    def merge(self, word: str) -> list[int]:
        """Token ids of one piece: merge the pair of lowest rank, leftmost first, until none is left."""
        parts = [self.symbols[b] for b in word.encode("utf-8")]
        if not parts:
            return []
        parts[-1] += self.suffix
        if len(parts) > 40:
            parts = self._merge_long(parts)
        rank_of = self.ranks.get
        ranks = [rank_of(p, NO_RANK) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), NO_RANK)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same merges for a long piece, with a heap of pairs over a linked list."""
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        live: list[str | None] = list(parts)
        heap = [(self.ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if live[i] != left or j < 0 or live[j] != right:
                continue
            live[i], live[j], after[i] = left + right, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (pair := (live[a], live[b])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], a, *pair))
        return [p for p in live if p is not None]

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids, skip_special_tokens=False)


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One instance per Python process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def version_digest(path: str) -> str:
    """Identifies the tokenizer file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
