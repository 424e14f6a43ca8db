"""Names for the suffixes of byte strings, by the recursion of a difference-cover sort.

A name stands for a prefix of a suffix. Three names in a row make the name of three
times the depth, and so on by recursion. Names are 64-bit fingerprints of their triples
instead of ranks after a sort of all triples: equal prefixes get equal names all the
same, but without a shuffle at every depth.
"""

import numpy as np

DEPTHS = (3, 9, 27, 81)
# Odd multipliers of the fingerprints, one set for each of the two halves of a name.
MULTIPLIERS = (
    (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9),
    (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB),
)


def _mixed(x, seed):
    x ^= x >> np.uint64(32)
    x *= np.uint64(MULTIPLIERS[seed][0])
    x ^= x >> np.uint64(29)
    return x


def triple(a, b, c, seed=0):
    """Names of triples of names."""
    k = [np.uint64(m) for m in MULTIPLIERS[seed]]
    x = a * k[0]
    x += b
    x *= k[1]
    x ^= x >> np.uint64(31)
    x += c
    x *= k[2]
    return _mixed(x, seed)


def byte_names(data, seed=0):
    table = _mixed((np.arange(1, 257, dtype=np.uint64)) * np.uint64(MULTIPLIERS[seed][1]), seed)
    return table[data]


def deeper(names, depth, seed=0):
    """From names of ``depth`` bytes those of three times as many; the last ones, where
    the string ends, stand for less and are not to be used."""
    out = names.copy()
    n = len(names) - 2 * depth
    if n > 0:
        out[:n] = triple(names[:n], names[depth:depth + n], names[2 * depth:2 * depth + n], seed)
    return out


def names(data, depth=DEPTHS[-1], seed=0, also=None):
    """Names of ``depth`` (a power of three) bytes from every place of ``data``; with those
    of the smaller depth ``also``, if one is given."""
    now, at, kept = byte_names(data, seed), 1, None
    while at < depth:
        now, at = deeper(now, at, seed), at * 3
        if at == also:
            kept = now
    return now if also is None else (now, kept)


def spanning(deep, places, lengths, depth=DEPTHS[-1], seed=0):
    """Names of ``lengths`` bytes (at least ``depth``) from ``places``: of the names that
    tile the string from its start, the last moved back to end where it ends, folded
    three at a time."""
    total = deep[places].copy()
    steps = -(-lengths // depth)
    for k in range(1, int(steps.max(initial=1))):
        on = steps > k
        at = places[on] + np.minimum(k * depth, lengths[on] - depth)
        total[on] = triple(total[on], deep[at], np.uint64(k), seed)
    return triple(total, lengths.astype(np.uint64), np.uint64(7), seed)
