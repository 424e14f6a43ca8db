"""Symbols of word sequences by recompression, named alike wherever they occur.

A round makes one symbol of every maximal run of a symbol (block compression), deals the
symbols into a left and a right class, and makes one symbol of every left one followed by
a right one (pair compression). The name of a symbol is a 64-bit fingerprint of what it is
made of, and its class a bit of its name, so all tasks name and parse alike.

A symbol's *reach* are the words that decide it: wherever they stand together again, the
same symbol stands in the same place. A symbol inside an equal stretch is therefore met in
both copies as soon as its reach is inside too.
"""

import numpy as np

FAR = 1 << 40
ODD = tuple(np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mixed(x, k=0):
    """A fingerprint of each value; different ``k`` give unrelated ones."""
    x = (x ^ (x >> np.uint64(32))) * ODD[k]
    x ^= x >> np.uint64(29)
    x = x * ODD[k - 1]
    return x ^ (x >> np.uint64(32))


class Symbols:
    """Symbols in order: names (never 0), first word, end, reach (low, high), and the length
    of the longest symbol a symbol is made of (its own, if it was not made just now)."""

    def __init__(self, *columns):
        self.name, self.start, self.end, self.low, self.high, self.inner = columns

    def made(self, length):
        """Those made just now with a reach of at most ``length`` words: name, first word,
        words, words of the longest part, and first and last window that holds the reach."""
        size = self.end - self.start
        some = np.flatnonzero((self.high - self.low <= length) & (self.inner < size))
        first = np.maximum(self.high[some] - length, 0)
        return self.name[some], self.start[some], size[some], self.inner[some], first, self.low[some]

    def blocks(self, words):
        """Runs of one symbol become one. Where a run ends is decided by the next word
        already, if that differs from the word the symbol begins with; else by the next
        symbol's reach. The same holds to the left."""
        name = self.name
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        last = np.append(first[1:], len(name)) - 1
        start, end = self.start[first], self.end[last]
        low, high = self.low[first], self.high[last]
        after = words[end[:-1]] != words[start[:-1]]
        high[:-1] = np.maximum(high[:-1], np.where(after, end[:-1] + 1, self.high[last[:-1] + 1]))
        before = words[start[1:] - 1] != words[end[1:] - 1]
        low[1:] = np.minimum(low[1:], np.where(before, start[1:] - 1, self.low[first[1:] - 1]))
        high[-1], low[0] = FAR, -FAR
        new, times = name[first], last - first + 1
        many = times > 1
        new[many] = mixed(new[many] + times[many].astype(np.uint64) * ODD[1], 2) | np.uint64(1)
        return Symbols(new, start, end, low, high, self.end[first] - self.start[first])

    def pairs(self, number):
        """A left symbol and the right one after it become one. That a left one stays alone
        is decided by the symbol after it, and that a right one does by that before it."""
        name = self.name
        right = (mixed(name + np.uint64(number), 1) >> np.uint64(40)) & np.uint64(1) == 1
        second = np.append(False, ~right[:-1] & right[1:])
        first = np.flatnonzero(~second)
        last = np.append(first[1:], len(name)) - 1
        low, high = self.low[first], self.high[last]
        alone = first == last
        left, other = alone & ~right[first], alone & right[first]
        high[left] = np.maximum(high[left], self.high[np.minimum(first[left] + 1, len(name) - 1)])
        low[other] = np.minimum(low[other], self.low[np.maximum(first[other] - 1, 0)])
        high[-1], low[0] = FAR, -FAR
        new, both = name[first], ~alone
        new[both] = mixed(mixed(name[first[both]], 3) + name[last[both]], 0) | np.uint64(1)
        inner = np.maximum(self.end[first] - self.start[first], self.end[last] - self.start[last])
        return Symbols(new, self.start[first], self.end[last], low, high, inner)


def symbols_made(words, length):
    """All symbols of a sequence of words (64-bit names, odd) with a reach of at most
    ``length`` words, as ``made`` gives them, from the words themselves up."""
    at = np.arange(len(words))
    now = Symbols(words, at, at + 1, at, at + 1, np.zeros(len(words), np.int64))
    found, number = [now.made(length)], 0
    while len(words) and (now.high - now.low <= length).any():
        number += 1
        runs = now.blocks(words)
        now = runs.pairs(number)
        found += [runs.made(length), now.made(length)]
    return tuple(map(np.concatenate, zip(*found)))


# Symbols of this many words are looked for first, as they tell windows well apart; where a
# window has none, shorter ones serve, and at last single words.
LEAST = (4, 2, 1)


def anchors(words, length, windows):
    """For each window of ``length`` words (by its start, ascending) a symbol whose reach it
    holds: its name and first word. The window's words alone decide: of the symbols just
    long enough that with the largest name, of equal ones the first."""
    found, place = np.zeros(len(words), np.uint64), np.full(len(words), len(words))
    open_ = np.zeros(len(words), bool)
    open_[windows] = True
    name, start, size, inner, low, high = symbols_made(words, length)
    for least in LEAST:
        before = np.append(0, np.cumsum(open_))
        wanted = (size >= least) & (inner < least) & (before[high + 1] > before[low])
        k = np.flatnonzero(wanted)
        many = high[k] - low[k] + 1
        at = np.arange(many.sum()) + np.repeat(low[k] - np.cumsum(many) + many, many)
        k = np.repeat(k, many)
        some = open_[at]
        at, k = at[some], k[some]
        np.maximum.at(found, at, name[k])
        some = found[at] == name[k]
        np.minimum.at(place, at[some], start[k[some]])
        open_ &= found == 0
        if not open_.any():
            break
    return found[windows], place[windows]


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS = {}


def _powers(k, n):
    """The first ``n`` powers of a base, and those of its inverse, modulo 2**64."""
    if len(_POWERS.get(k, ((),))[0]) < n:
        base = BASES[k]
        sides = [np.full(n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for x in sides:
            x[0] = 1
        _POWERS[k] = tuple(np.cumprod(x, dtype=np.uint64) for x in sides)
    return tuple(x[:n] for x in _POWERS[k])


def stretches(words, starts, ends, k=0):
    """Fingerprints of stretches of a sequence of words."""
    up, down = _powers(k, len(words) + 1)
    sums = np.append(np.uint64(0), np.cumsum(words * up[:-1], dtype=np.uint64))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), k)
