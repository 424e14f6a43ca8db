"""Run-length grammars of symbol sequences by recompression, and extensions read off them.

Two steps alternate until one symbol is left: every maximal run of a symbol becomes one
symbol (block compression), then the symbols are dealt into a left and a right class and
every left one followed by a right one becomes one symbol with it (pair compression).
Equal stretches of the sequence are parsed alike but for their ends, so the first place
where two suffixes differ is found in a walk up and down the levels, with a few
comparisons on each. All walks of a batch take their steps together.
"""

import numpy as np


def _renamed(symbols, which, keys):
    """``symbols`` with new names where ``which``: one for each distinct key."""
    out = symbols.copy()
    out[which] = symbols.max() + 1 + np.unique(keys, return_inverse=True)[1]
    return out


def _sides(symbols, level):
    """Left (False) or right (True) class of each symbol, as good as at random."""
    x = (symbols + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= (x >> np.uint64(29)) + np.uint64(level * 0xBF58476D1CE4E5B9 % 2**64)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)) & np.uint64(1) == 1


class _Level:
    """A sequence, and where in it the symbols of the next one start."""

    def __init__(self, symbols):
        self.symbols = symbols
        self.starts = self.owner = None
        self.blocks = False

    def close(self, first, blocks):
        """``first`` marks the symbols that begin one of the next level."""
        self.starts = np.append(np.flatnonzero(first), len(first))
        self.owner = np.cumsum(first) - 1
        self.blocks = blocks

    def mirrored(self):
        other = _Level(self.symbols[::-1])
        if self.starts is not None:
            n = len(self.symbols)
            other.starts = n - self.starts[::-1]
            other.owner = self.owner[-1] - self.owner[::-1]
            other.blocks = self.blocks
        return other


class Grammar:
    """The levels of one sequence of integers, whose last symbol must occur once."""

    def __init__(self, symbols):
        now, self.levels, number = np.asarray(symbols, np.int64), [], 0
        while len(now) > 1:
            number += 1
            for step in (self._blocks, self._pairs):
                level = _Level(now)
                now = step(level, number)
                if now is not level.symbols:
                    self.levels.append(level)
        self.levels.append(_Level(now))
        self._back = None

    @staticmethod
    def _blocks(level, _):
        symbols = level.symbols
        first = np.append(True, symbols[1:] != symbols[:-1])
        if first.all():
            return symbols
        level.close(first, True)
        symbols, lengths = symbols[first], np.diff(level.starts)
        many = lengths > 1
        return _renamed(symbols, many, symbols[many] * (lengths.max() + 1) + lengths[many])

    @staticmethod
    def _pairs(level, number):
        symbols = level.symbols
        right = _sides(symbols, number)
        second = np.append(False, ~right[:-1] & right[1:])
        if not second.any():
            return symbols
        level.close(~second, False)
        at = np.flatnonzero(second)
        return _renamed(symbols[~second], level.owner[at],
                        symbols[at - 1] * (symbols.max() + 1) + symbols[at])

    def extensions(self, i, j):
        """How many symbols from places ``i`` on equal those from places ``j`` on."""
        return _walk(self.levels, i, j)

    def extensions_back(self, i, j):
        """How many symbols up to places ``i`` (not included) equal those up to ``j``. The
        first symbol of the sequence must occur once too."""
        if self._back is None:
            self._back = [level.mirrored() for level in self.levels]
        n = len(self.levels[0].symbols)
        return _walk(self._back, n - np.asarray(i), n - np.asarray(j))


def _step(level, i, j, equal):
    """Both places moved past what equal symbols share on this level: one symbol, or what
    is left of the shorter of two runs. Also whether nothing more can be equal here."""
    if not level.blocks:
        return i + equal, j + equal, ~equal
    left_i = level.starts[level.owner[i] + 1] - i
    left_j = level.starts[level.owner[j] + 1] - j
    shared = np.where(equal, np.minimum(left_i, left_j), 0)
    return i + shared, j + shared, ~equal | (left_i != left_j)


def _walk(levels, i, j):
    """Lengths of the equal stretches from different places ``i`` and ``j``."""
    i, j = np.array(i, np.int64), np.array(j, np.int64)
    begun, where = i.copy(), np.full(len(i), len(levels) - 1)
    # Up: as long as the next symbols are equal. Where one place is inside a symbol of the
    # next level, one step brings both to the start of one.
    active = np.arange(len(i))
    for h, level in enumerate(levels):
        a, b = i[active], j[active]
        equal = level.symbols[a] == level.symbols[b]
        stop = ~equal
        if level.starts is not None:
            inside = (level.starts[level.owner[a]] != a) | (level.starts[level.owner[b]] != b)
            moved_a, moved_b, over = _step(level, a, b, equal & inside)
            stop |= inside & over
            a, b = moved_a, moved_b
        i[active], j[active] = a, b
        where[active[stop]] = h
        active = active[~stop]
        if not len(active):
            break
        i[active], j[active] = level.owner[i[active]], level.owner[j[active]]
    # Down: the symbols at i and j differ on their level; what their parts share is at most
    # one symbol or one run a level.
    for h in range(int(where.max(initial=0)) - 1, -1, -1):
        level = levels[h]
        down = np.flatnonzero(where > h)
        a, b = level.starts[i[down]], level.starts[j[down]]
        i[down], j[down], _ = _step(level, a, b, level.symbols[a] == level.symbols[b])
    return i - begun
