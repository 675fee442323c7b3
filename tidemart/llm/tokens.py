"""Exact ids of a public word-level BPE tokenizer, fast enough for whole corpora.

The tokenizer lower-cases, cuts a text into pre-tokens (none spans white space)
and encodes each by itself, so the ids of a text are those of its pre-tokens in
turn.  Pre-tokens repeat: a Python worker remembers the ids of recent ones, in a
bounded number.  Those that a batch lacks go to the tokenizer joined by spaces,
as one text; the ends of words then show in the ids themselves.  A chunk outside
printable Latin-1, where normalisation may change more than case, or one that
could hold a special token is given to the tokenizer as it is.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pre-tokens of one generation; a worker remembers two generations.
CACHE_WORDS = 300_000

#: The tokenizer's pre-token pattern over lower-cased printable Latin-1.
_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile("[\t-\r -~\x85\xa0-ÿ]*")
#: White space of the tokenizer; Python's also has the separators \x1c to \x1f.
_CHUNK = re.compile("(?:[^\\s]|[\x1c-\x1f])+")


class WordEncoder:
    """Little-endian ids of texts as bytes, ``width`` bytes an id."""

    def __init__(self, tokenizer_json: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values(), default=0) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.ends_word = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache_words = cache_words
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Make the ids of ``words`` known to the newer generation."""
        if len(self.new) > self.cache_words:
            self.old, self.new = self.new, {}
        missing = words.difference(self.new)
        known = missing.intersection(self.old)
        self.new.update(zip(known, map(self.old.__getitem__, known)))
        missing = list(missing - known)
        for at in range(0, len(missing), 8192):
            some = missing[at : at + 8192]
            raw = self._ids(" ".join(some))
            ends = ((np.flatnonzero(self.ends_word[np.frombuffer(raw, dtype=self.kind)]) + 1) * self.width).tolist()
            if len(ends) == len(some):
                self.new.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends))))
            else:  # one of them is cut otherwise among others than alone
                self.new.update((w, self._ids(w)) for w in some)

    def _odd(self, text: str) -> list[str | bytes]:
        """Pre-tokens, or the ids of chunks that are left to the tokenizer."""
        out: list[str | bytes] = []
        for chunk in _CHUNK.findall(text):
            if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
                out += _PRETOKEN.findall(chunk.lower())
            else:
                out.append(self._ids(chunk))
        return out

    def encode(self, texts: list[str], rows: int = 400) -> list[bytes]:
        """Ids of each whole text."""
        out = []
        for at in range(0, len(texts), rows):
            some = texts[at : at + rows]
            plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in some]
            cut = [_PRETOKEN.findall(t.lower()) if ok else self._odd(t) for t, ok in zip(some, plain)]
            self._learn(set().union(*cut) if all(plain) else {p for p in set().union(*cut) if isinstance(p, str)})
            find = self.new.__getitem__
            for parts, ok in zip(cut, plain):
                out.append(b"".join(map(find, parts)) if ok else b"".join(p if isinstance(p, bytes) else find(p) for p in parts))
        return out
