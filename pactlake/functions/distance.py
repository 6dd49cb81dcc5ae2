"""Edit distances of very many strings at once.

A column of the edit table is two bit vectors, the places where it rises and falls, and one character moves it on by a dozen
operations on words (Myers 1999, blocks of 64 rows as Hyyrö 2003). Numpy does each for all pairs of a chunk. Sorted
texts share the columns of what they begin with.
"""

from __future__ import annotations

import numpy as np

#: Rows of the table in one word, and columns that are moved on at once, about: they should stay in a processor's cache.
WORD, AT_ONCE = 64, 1 << 15
#: Of so many pairs one at most may be left by their marks, as a pair alone costs several times one of all.
LEFT = 10
_ONE, _ALL = np.uint64(1), ~np.uint64(0)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all strings in a row, and how many each has."""
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32), np.fromiter(map(len, strings), np.int64, len(strings))


class Patterns:
    """Strings as bit vectors: `bits[w][c]` has, for each string, where character `c` of the alphabet stands in its word w."""

    def __init__(self, strings: list[str]) -> None:
        flat, self.size = _codes(strings)
        self.alphabet, code = np.unique(flat, return_inverse=True)
        self.words = max(1, -(-int(self.size.max(initial=0)) // WORD))
        row = np.repeat(np.arange(len(strings)), self.size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        # One character more than the alphabet: any other.
        self.bits = np.zeros((self.words, len(self.alphabet) + 1, len(strings)), np.uint64)
        np.bitwise_or.at(self.bits, (at // WORD, code, row), _ONE << (at % WORD).astype(np.uint64))
        left = np.clip(self.size - WORD * np.arange(self.words)[:, None], 0, WORD)
        self.mask = np.where(left < WORD, (_ONE << (left % WORD).astype(np.uint64)) - _ONE, _ALL)

    def texts(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Strings as rows of characters of the alphabet, and their lengths."""
        flat, size = _codes(strings)
        code = np.searchsorted(self.alphabet, flat)
        code[~np.isin(flat, self.alphabet)] = len(self.alphabet)
        rows = np.zeros((len(strings), int(size.max(initial=0))), np.int64)
        rows[np.arange(rows.shape[1]) < size[:, None]] = code
        return rows, size


def _moved(rises: list[np.ndarray], falls: list[np.ndarray], equal: list[np.ndarray]) -> None:
    """The columns after one more character, in place. The table's first row rises by one with each."""
    up, down = _ONE, None
    for w, e in enumerate(equal):
        p, m = rises[w], falls[w]
        either = e | m
        if down is not None:
            e = e | down
        x = e & p
        x += p
        x ^= p
        x |= e
        plus = x | p
        np.invert(plus, out=plus)
        plus |= m
        x &= p  # where the row falls
        next_up, next_down = (plus >> np.uint64(WORD - 1), x >> np.uint64(WORD - 1)) if w + 1 < len(equal) else (None, None)
        plus <<= _ONE
        plus |= up
        x <<= _ONE
        if down is not None:
            x |= down
        np.bitwise_and(plus, either, out=m)
        either |= plus
        np.invert(either, out=either)
        np.bitwise_or(x, either, out=p)
        up, down = next_up, next_down


def _last(rises: list[np.ndarray], falls: list[np.ndarray], mask: np.ndarray, length) -> np.ndarray:
    """The last number of each column: its first is the text's length."""
    out = np.zeros(rises[0].shape, np.int64)
    for p, m, k in zip(rises, falls, mask, strict=True):
        out += np.bitwise_count(p & k)
        out -= np.bitwise_count(m & k)
    return out + length


def all_pairs(patterns: Patterns, strings: list[str]):
    """(numbers of some strings, their distances from every pattern: a row a string), chunk after chunk."""
    n = len(patterns.size)
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
    step = max(1, AT_ONCE // n)
    for a in range(0, len(order), step):
        some = order[a : a + step]
        rows, size = patterns.texts([strings[i] for i in some.tolist()])
        shared = np.zeros(len(some), np.int64)
        same = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(1)
        shared[1:] = np.minimum(same, np.minimum(size[1:], size[:-1]))
        out = np.empty((len(some), n), np.int64)
        out[size == 0] = patterns.size
        rises, falls = [np.full((1, n), _ALL) for _ in range(patterns.words)], [np.zeros((1, n), np.uint64) for _ in range(patterns.words)]
        at = np.zeros(len(some), np.int64)  # each text's column
        for d in range(1, rows.shape[1] + 1):
            own = (size >= d) & (shared < d)
            new = np.flatnonzero(own)
            before, char = at[new], rows[new, d - 1]
            rises, falls = [x[before] for x in rises], [x[before] for x in falls]
            _moved(rises, falls, [b[char] for b in patterns.bits])
            at = np.cumsum(own) - 1
            ends = np.flatnonzero(size == d)
            if len(ends):
                out[ends] = _last([x[at[ends]] for x in rises], [x[at[ends]] for x in falls], patterns.mask, d)
        yield some, out


def pair_by_pair(patterns: Patterns, strings: list[str], of_pattern: np.ndarray, of_string: np.ndarray) -> np.ndarray:
    """The distance of each pair of a pattern and a string, by their numbers."""
    return _by_pair(patterns, *patterns.texts(strings), of_pattern, of_string)


def _by_pair(patterns: Patterns, texts: np.ndarray, sizes: np.ndarray, of_pattern: np.ndarray, of_string: np.ndarray) -> np.ndarray:
    out = np.empty(len(of_pattern), np.int64)
    order = np.argsort(-sizes[of_string], kind="stable")
    for a in range(0, len(order), AT_ONCE):
        some = order[a : a + AT_ONCE]
        p, rows, size = of_pattern[some], texts[of_string[some]], sizes[of_string[some]]
        rises, falls = [np.full(len(some), _ALL) for _ in range(patterns.words)], [np.zeros(len(some), np.uint64) for _ in range(patterns.words)]
        upto = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "right")  # the longest come first
        for d in range(1, int(size[0]) + 1):
            _moved([x[: upto[d]] for x in rises], [x[: upto[d]] for x in falls], [b[rows[: upto[d], d - 1], p[: upto[d]]] for b in patterns.bits])
        out[some] = _last(rises, falls, patterns.mask[:, p], size)
    return out


def marks(strings: list[str]) -> np.ndarray:
    """64 bits that say which characters a string has how often: an edit changes two of them at most."""
    flat, size = _codes(strings)
    row = np.repeat(np.arange(len(strings)), size)
    order = np.lexsort((flat, row))
    flat, row = flat[order].astype(np.uint64), row[order]
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(flat))
    often = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    bit = (flat * np.uint64(0x9E3779B97F4A7C15) + often * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(58)
    out = np.zeros(len(strings), np.uint64)
    np.bitwise_or.at(out, row, _ONE << bit)
    return out


def within(patterns: Patterns, pattern_marks: np.ndarray, strings: list[str], string_marks: np.ndarray, limit: np.ndarray):
    """(numbers of patterns, numbers of strings, distances) of the pairs whose distance is no more than `limit`, by the string's
    length and the pattern's number. Where marks leave few pairs, only those are compared."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    twice, step, found, n = (2 * limit).astype(np.int32), max(1, AT_ONCE // len(patterns.size)), [], 0
    texts = None

    def judged():
        i, j = map(np.concatenate, zip(*found, strict=True))
        d = _by_pair(patterns, *texts, i, j)
        near = d <= limit[size[j], i]
        return i[near], j[near], d[near]

    for a in range(0, len(strings), step):
        may = np.bitwise_count(string_marks[a : a + step, None] ^ pattern_marks) <= twice[size[a : a + step]]
        j, i = np.nonzero(may)
        if not a:
            if LEFT * len(i) > may.size:
                for some, d in all_pairs(patterns, strings):
                    j, i = np.nonzero(d <= limit[size[some]])
                    yield i, some[j], d[j, i]
                return
            texts = patterns.texts(strings)
        found.append((i, a + j))
        n += len(i)
        if n > AT_ONCE:
            yield judged()
            found, n = [], 0
    if n:
        yield judged()
