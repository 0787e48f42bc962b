"""Two-stage suffix sorting and adjacent common prefixes of one block of bytes, in numpy.

Only suffixes smaller than their successors are sorted directly; every other suffix is
put in place by scanning the buckets of first bytes in order. Orders and prefixes are
exact up to ``depth`` bytes, which is all that windows of that many bytes need. Texts hold no
zero bytes: zero stands for what lies past the end.
"""

from __future__ import annotations

import numpy as np


class _Words:
    """Eight bytes from any position on, as a big-endian number; past the end there are zeros."""

    def __init__(self, text: np.ndarray, depth: int):
        self.words = np.concatenate([text, np.zeros(depth + 8, np.uint8)]).astype(np.uint64)
        for have in (1, 2, 4):
            self.words[:-have] = (self.words[:-have] << np.uint64(8 * have)) | self.words[have:]

    def at(self, positions: np.ndarray) -> np.ndarray:
        return self.words[positions]


def rising(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is larger than the empty suffix."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # last position of each run of one byte
    up = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    return np.repeat(up, np.diff(ends, prepend=-1))


def _by_group(group: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """An order by group, which is below 2^31, and key."""
    order = np.argsort(keys)
    ranks = np.empty(len(keys), np.int64)
    ordered = keys[order]
    ranks[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return np.argsort(group << 32 | ranks)


def _sort_directly(words: _Words, positions: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, eight bytes at a time and only among ties whose next eight bytes differ."""
    keys = words.at(positions)
    order = np.argsort(keys)
    positions, keys = positions[order], keys[order]
    slots, here = np.arange(len(positions)), positions
    new = np.zeros(len(positions), bool)  # where a group of ties begins
    new[:1] = True
    for done in range(8, depth + 8, 8):
        new[1:] |= keys[1:] != keys[:-1]
        tied = ~new
        tied[:-1] |= ~new[1:]
        if done >= depth or not tied.any():
            break
        slots, here, new = slots[tied], here[tied], new[tied]
        keys = words.at(here + done)
        group = np.cumsum(new) - 1
        differ = np.zeros(int(group[-1]) + 1, bool)
        differ[group[1:][~new[1:] & (keys[1:] != keys[:-1])]] = True
        some = np.flatnonzero(differ[group])
        if len(some):
            order = some[_by_group(group[some], keys[some])]
            here[some], keys[some] = here[order], keys[order]
            positions[slots[some]] = here[some]
    return positions


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes in order; suffixes equal for ``depth`` bytes stand in any order, but together."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = _Words(text, depth)
    up = rising(text)
    direct = _sort_directly(words, np.flatnonzero(up), depth)
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    n_up = np.bincount(text[direct], minlength=256)
    out = np.full(n, -1, np.int64)
    for byte in np.flatnonzero(n_up):
        first = int(n_up[:byte].sum())
        out[ends[byte] - n_up[byte] : ends[byte]] = direct[first : first + n_up[byte]]
    free = heads.copy()  # next place for an induced suffix of each bucket

    def induce(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~up[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, counts = before[order], np.bincount(first, minlength=256)
            at = 0
            for byte in np.flatnonzero(counts):
                k = counts[byte]
                out[free[byte] : free[byte] + k] = before[at : at + k]
                free[byte] += k
                at += k

    induce(np.array([n]))
    for byte in np.flatnonzero(sizes):
        done = heads[byte]
        while done < free[byte]:
            upto = int(free[byte])
            induce(out[done:upto])
            done = upto
        induce(out[ends[byte] - n_up[byte] : ends[byte]])
    return out


def shares_prefix(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each place of the suffix array but the first, whether ``width`` bytes are shared with the place before."""
    words = _Words(text, width)
    at = np.arange(1, len(order))
    for start in [*([width - 8] if width % 8 else []), *range(0, width - 7, 8)]:
        at = at[words.at(order[at] + start) == words.at(order[at - 1] + start)]
    out = np.zeros(max(len(order) - 1, 0), bool)
    out[at - 1] = True
    return out


def later_windows(text: np.ndarray, valid: np.ndarray, width: int, place: np.ndarray | None = None) -> np.ndarray:
    """Valid window starts whose ``width`` bytes also start at a valid position of a smaller place (by default, the position itself)."""
    order = suffix_array(text, width)
    order = order[valid[order]]
    out = np.zeros(len(text), bool)
    if len(order):
        starts = np.flatnonzero(np.append(True, ~shares_prefix(text, order, width)))
        own = order if place is None else place[order]
        least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(order))))
        out[order] = own > least
    return out
