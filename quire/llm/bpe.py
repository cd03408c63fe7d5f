"""Problem 7: exact byte-level BPE encoding in linear time.

Method: a backtracking encoder.  An Aho-Corasick automaton over the vocabulary gives the
longest token at each offset; a token is kept only if it is compatible with the one
before it, that is, if the merge rules could never have joined across their border.
Where it isn't, the encoder falls back to the next shorter token (the longest vocabulary
entry that is a prefix of it) or drops the last token and tries again.  Sequences whose
neighbouring pairs are all compatible are exactly what the merge rules give, so the
result is exact, and dead ends are remembered, so the time is linear.

Decoding joins the tokens' bytes through an offset table: one buffer, one cumulative
array of where each token starts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pattern that cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 300_000  # words whose ids a worker keeps, none longer than CACHED characters
CACHED = 64
PAIRS = 2_000_000  # pairs of tokens that a worker keeps


class Encoder:
    """Encoder and decoder of one vocabulary file (base64 token and rank per line)."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY) -> None:
        import ahocorasick
        import regex

        with open(vocabulary, "rb") as f:
            rows = [line.split() for line in f.read().splitlines() if line.strip()]
        self.ids: dict[bytes, int] = {base64.b64decode(t): int(r) for t, r in rows}
        self.tokens: list[bytes] = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.cut = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for token in self.ids:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.halves = self._split_table()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        lengths = np.fromiter((len(t) for t in self.tokens), dtype=np.int64, count=len(self.tokens))
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.buffer = b"".join(self.tokens)

    def _split_table(self) -> dict[int, tuple[int, int]]:
        """The two tokens that each token was merged from; single bytes have none.

        They are what merging the token's bytes gives when only lower ranks may merge.
        """
        out: dict[int, tuple[int, int]] = {}
        for token, rank in self.ids.items():
            if len(token) == 1:
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = rank, -1
                for i in range(len(parts) - 1):
                    r = self.ids.get(parts[i] + parts[i + 1], rank)
                    if r < best:
                        best, at = r, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                out[rank] = (self.ids[parts[0]], self.ids[parts[1]])
        return out

    def _next_shorter(self, i: int) -> int:
        """Longest token that is a proper prefix of token ``i``; -1 if there is none."""
        got = self.shorter.get(i)
        if got is None:
            token, got = self.tokens[i], -1
            for n in range(len(token) - 1, 0, -1):
                got = self.ids.get(token[:n], -1)
                if got >= 0:
                    break
            self.shorter[i] = got
        return got

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge ever joins across the border of tokens ``a`` and ``b``.

        Undo the merges of both, the later one first; a token across the border that
        would have been merged before the part just undone makes the pair impossible.
        Results are kept: this is the pair table.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._check_pair(a, b)
        return known

    def _check_pair(self, left: int, right: int) -> bool:
        below = len(self.tokens)  # merges from this rank on happen only after the parts at hand exist
        while True:
            if self.ids.get(self.tokens[left] + self.tokens[right], below) < below:
                return False
            undo_left = left in self.halves and (left > right or right not in self.halves)
            if undo_left:
                below, left = left, self.halves[left][1]
            elif right in self.halves:
                below, right = right + 1, self.halves[right][0]
            else:
                return True

    def _longest(self, data: bytes) -> list[int]:
        """Length of the longest token that starts at each offset."""
        best = [1] * len(data)
        for end, n in self.automaton.iter(data.decode("latin-1")):
            if n > best[end - n + 1]:
                best[end - n + 1] = n
        return best

    def _encode_piece(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n, longest = len(data), self._longest(data)
        out: list[int] = []
        dead = bytearray(n + 1)  # offsets from which no exact continuation exists
        at = 0
        token = self.ids[data[: longest[0]]]
        while True:
            end = at + len(self.tokens[token])
            if not dead[end] and (not out or self._compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = self.ids[data[at : at + longest[at]]]
                continue
            token = self._next_shorter(token)
            while token < 0:
                dead[at] = 1
                last = out.pop()
                at -= len(self.tokens[last])
                token = self._next_shorter(last)

    def encode(self, text: str) -> list[int]:
        """Token ids of ``text``; no special tokens."""
        words, out = self.words, []
        for word in self.cut(text):
            got = words.get(word)
            if got is None:
                got = self._encode_piece(word.encode("utf-8", "replace"))
                if len(words) >= CACHE:
                    words.clear()
                if len(word) <= CACHED:
                    words[word] = got
            out += got
        return out

    def count(self, text: str) -> int:
        """Number of token ids of ``text``."""
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        """Text of token ids, through the offset table."""
        at, end, buffer = self.starts, self.starts[1:], self.buffer
        return b"".join(buffer[at[i] : end[i]] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file, one a process."""
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(vocabulary)
    return Encoder(vocabulary)
