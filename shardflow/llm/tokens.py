"""Token ids of whole texts, by a public tokenizer whose words never span white space."""

from __future__ import annotations

import os
from array import array

import numpy as np
from tokenizers import Tokenizer

from shardflow.llm.common import memory

#: Words whose ids a worker remembers, and the longest of them, in bytes.
WORDS, LONGEST = 250_000, 48


#: ASCII characters that are neither letters, digits nor white space: a run of them is one piece.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: How the vocabulary writes bytes: printable ones of Latin-1 as such, the others as characters from 256 on, in order.
_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}


def _plain(word: str) -> bool:
    """Whether a word is made of small letters that normalisation leaves alone: below U+0250 no letter composes with the
    next one."""
    return word.isalpha() and word == word.lower() and (word.isascii() or max(word) < "\u0250")


class Ids:
    """ids as little-endian unsigned 32-bit bytes. The tokenizer drops white space and splits at it first, so a
    text's ids are those of its words one after another; words recur, so most are looked up."""

    def __init__(self, path: str, plain: bool = False, remember: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.known: dict[bytes, bytes] = {}
        self.remember, self.missed = remember, 0
        self.model, self.marks = self.tokenizer.model, {}

    def words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """ids of each of some words. They are encoded as one text; a token's place tells its word."""
        text = [w.decode("utf-8", "replace") for w in words]
        e = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
        data = np.array(e.ids, "<u4")
        begin = np.cumsum([0, *(len(t) + 1 for t in text[:-1])])
        at = np.fromiter((a for a, _ in e.offsets), np.int64, len(data))
        cut = np.searchsorted(at, begin[1:]).tolist()
        b = data.tobytes()
        return {w: b[4 * i : 4 * j] for w, i, j in zip(words, [0, *cut], [*cut, len(data)])}

    def letters(self, word: str) -> bytes:
        """ids of a plain word, by the model alone: what stands before the model leaves it whole."""
        t = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [x.id for x in self.model.tokenize(t)]).tobytes()

    def mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            b = marks.encode()
            self.marks[marks] = self.words([b])[b]
        return self.marks[marks]

    def missing(self, new: set[bytes]) -> dict[bytes, bytes]:
        """ids of words that aren't known. Letters and the marks behind them are pieces of their own, so such a word's ids are
        those of its letters and the marks'."""
        got: dict[bytes, bytes] = {}
        rest = []
        for w in new:
            t = w.decode("utf-8", "replace")
            stem = t.rstrip(_MARKS)
            if not _plain(stem):
                rest.append(w)
                continue
            key = w if len(stem) == len(t) else stem.encode()
            data = self.known.get(key) or got.get(key)
            if data is None:
                data = got[key] = self.letters(stem)
            if len(stem) < len(t):
                got[w] = data + self.mark(t[len(stem) :])
        if rest:
            got |= self.words(rest)
        return got

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 128):
            part = []
            for t in texts[at : at + 128]:
                b = (t or "").encode("utf-8", "replace")
                part.append((b if b"<|" in b else b.lower()).split())  # the tokenizer lower-cases, but for special tokens
            got = self.missing(set().union(*part).difference(self.known))
            if len(self.known) < self.remember:
                self.known.update(x for x in got.items() if len(x[0]) <= LONGEST)
            else:  # what came first is mostly what is frequent; begin anew if it no longer is
                self.missed += len(got)
                if self.missed > 20 * self.remember:
                    self.known, self.missed = {w: self.known[w] for w in set().union(*part).intersection(self.known)}, 0
            known = self.known
            out += [b"".join([known[w] if w in known else got[w] for w in words]) for words in part]
        return out


def ids(path: str, plain: bool = False, remember: int = WORDS) -> Ids:
    """One for each worker process and vocabulary. plain: strings of special tokens are ordinary text."""
    mine = memory.setdefault("ids", {})
    if (path, plain) not in mine:
        mine[path, plain] = Ids(path, plain, remember)
    return mine[path, plain]
