"""Values of a text made of values of its pre-tokens, remembered by a worker within a bound."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex

#: Entries of one memory, beyond which a new one begins, and the longest string it holds: a few dozen MB at most.
ENTRIES, CHARS = 150_000, 48


class Memory(dict):
    """Values of short strings, made where missing. The memory before this one is asked first."""

    def __init__(self, make: Callable, entries: int = ENTRIES) -> None:
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CHARS:
            self.turn(3)  # words that were learned together stay together
            self[key] = value
        return value

    def turn(self, times: int = 1) -> None:
        if len(self) >= times * self.entries:
            self.old = dict(self)
            self.clear()


class TextValues:
    """`join` over `of_piece` of every match of `pattern` in a text.

    With the public pattern, a space between two characters that are not white space always begins a match, and no match
    looks past it: such stretches of text are remembered whole, as words are fewer than the matches they are cut into.
    `of_pieces`, where given, makes the values of a list of pieces at once.
    """

    def __init__(self, pattern: str, of_piece: Callable, join: Callable, of_pieces: Callable | None = None, entries: int = ENTRIES) -> None:
        self.find, self.join, self.of_pieces = regex.compile(pattern).findall, join, of_pieces
        self.pieces, self.words = Memory(of_piece, ENTRIES // 4 if of_pieces else entries), Memory(self._word, entries)
        self.spaced = pattern == public_tokenizers.PATTERN

    def plain(self, text: str):
        return self.join(map(self.pieces.__getitem__, self.find(text)))

    def learn(self, texts: list[str]) -> None:
        """Remember the short words of `texts`, all of their pieces made at once."""
        if not (self.spaced and self.of_pieces):
            return
        words = set()
        for text in texts:
            words.update(text.split(" "))
        self.learn_words(words)

    def learn_words(self, words: set[str]) -> None:
        """Remember the short ones of `words`, all of their pieces made at once."""
        words.difference_update(self.words)
        self.words.turn()
        old = self.words.old
        known = words.intersection(old)
        self.words.update((w, old[w]) for w in known)
        words -= known
        # A word of letters alone is one piece with its space; isalpha and \p{L} are the same categories.
        plain, mixed = [], []
        for w in words:
            if w.isalpha():
                if len(w) <= CHARS:
                    plain.append(w)
            elif 0 < len(w) <= CHARS and w.strip() == w:
                mixed.append(w)
        # Matches that begin with a space are the first of their words.
        found: list[list[str]] = []
        for p in self.find(" " + " ".join(mixed)) if mixed else ():
            if p[0] == " ":
                found.append([p])
            else:
                found[-1].append(p)
        pieces = list({p for x in found for p in x})
        values = self.of_pieces([" " + w for w in plain] + pieces)
        value = dict(zip(pieces, values[len(plain) :], strict=True))
        self.words.update(zip(plain, values, strict=False))
        self.words.update((w, self.join([value[p] for p in x])) for w, x in zip(mixed, found, strict=True))

    def _word(self, word: str):
        """Of a space and the word; a word that white space bounds is no stretch of its own."""
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError
        return self.plain(" " + word)

    def of(self, text: str):
        if not self.spaced or " " not in text:
            return self.plain(text)
        first, *words = text.split(" ")
        last = words.pop()
        if first and not first[-1].isspace() and last and not last[0].isspace():
            try:
                return self.join([self.plain(first), *map(self.words.__getitem__, words), self.plain(" " + last)])
            except LookupError:
                pass
        return self.join(map(self._stretch, self.stretches(text)))

    def sums(self, texts) -> np.ndarray:
        """Of an Arrow string array, where values are numbers: the value of each text. Texts are cut and their words numbered
        by Arrow, so that Python meets every word once, not at every place it stands."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.spaced or not len(texts):
            return np.array([self.plain(t or "") for t in texts.to_pylist()], np.int64)
        parts = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
        first = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        numbered = parts.flatten().dictionary_encode()
        at_word, words = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False)
        opens, ends = np.ones(len(words), bool), np.ones(len(words), bool)  # begins, ends with something other than white space
        for i, w in enumerate(words.tolist()):
            if not w or w.strip() != w:
                opens[i], ends[i] = bool(w) and not w[0].isspace(), bool(w) and not w[-1].isspace()
        cut = opens[at_word]
        cut[1:] &= ends[at_word[:-1]]
        cut[first] = False
        begins = cut.copy()
        begins[first] = True
        at = np.flatnonzero(begins)
        end = np.append(at[1:], len(at_word))
        alone = cut[at] & (end - at == 1) & ends[at_word[at]]
        met = np.zeros(len(words), bool)
        met[at_word[at[alone]]] = True
        known = words[met].tolist()
        if self.of_pieces:
            self.learn_words(set(known))
        values = np.zeros(len(words), np.int64)
        values[met] = np.fromiter(map(self.words.__getitem__, known), np.int64, len(known))
        out = np.zeros(len(at), np.int64)
        out[alone] = values[at_word[at[alone]]]
        rest = np.flatnonzero(~alone)
        out[rest] = [self.plain((" " if cut[a] else "") + " ".join(words[at_word[a:b]])) for a, b in zip(at[rest].tolist(), end[rest].tolist(), strict=True)]
        return np.add.reduceat(out, np.searchsorted(at, first))

    def _stretch(self, x: str):
        return self.words[x[1:]] if x[0] == " " and len(x) > 1 and not x[1].isspace() and not x[-1].isspace() else self.plain(x)

    @staticmethod
    def stretches(text: str):
        """`text` cut before each space that stands between two characters other than white space."""
        a = at = 0
        before = ""
        for i, word in enumerate(text.split(" ")):
            if i and before and not before[-1].isspace() and word and not word[0].isspace():
                yield text[a : at - 1]
                a = at - 1
            at += len(word) + 1
            before = word
        if a < len(text):
            yield text[a:]
