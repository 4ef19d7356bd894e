"""Suffix arrays by external induced sorting, for shards that needn't fit in memory.

Arrays of more than ``IN_MEMORY`` bytes lie in memory-mapped files.  The queues of the
induction are the buckets of the first byte: a suffix that is taken from the queue
in order enters its predecessor at the head (L-type) or end (S-type) of the
predecessor's bucket.  Entries are taken in blocks, and a block holds only entries
that no entry of its own can precede.  The leftmost S-type suffixes are named by
their substrings and put in order by doubling on the names, up to ``depth`` bytes:
suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

BLOCK = 1 << 18
IN_MEMORY = 64 << 20


class Spool:
    """Arrays of a task; large ones are mapped from a temporary folder that goes with it."""

    def __enter__(self):
        self.path = None
        self.count = 0
        return self

    def __exit__(self, *_):
        if self.path:
            shutil.rmtree(self.path, ignore_errors=True)

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= IN_MEMORY:
            return np.empty(n, dtype)
        self.path = self.path or tempfile.mkdtemp(prefix="spool-")
        self.count += 1
        return np.memmap(os.path.join(self.path, str(self.count)), dtype, "w+", shape=(max(1, n),))[:n]


def types(text: np.ndarray) -> np.ndarray:
    """True for S-type; the end counts as smaller than any byte."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    smaller = np.zeros(len(differs) + 1, bool)
    smaller[:-1] = text[differs] < text[differs + 1]
    return np.repeat(smaller, np.diff(np.concatenate([[-1], differs, [n - 1]])))


def _place(order, at, chars, heads, step) -> None:
    """Puts suffixes ``at`` into the buckets of ``chars``, each next to those before it."""
    by = np.argsort(chars, kind="stable")
    at, chars = at[by], chars[by]
    used, first, n = np.unique(chars, return_index=True, return_counts=True)
    for c, a, k in zip(used.tolist(), first.tolist(), n.tolist()):
        if step > 0:
            order[heads[c] : heads[c] + k] = at[a : a + k]
            heads[c] += k
        else:
            order[heads[c] - k : heads[c]] = at[a : a + k][::-1]
            heads[c] -= k


def induce(text, s_type, counts, lms, order) -> np.ndarray:
    """Fills ``order`` with all suffixes, given the leftmost S-type ones in order."""
    n = len(text)
    ends = np.cumsum(counts)
    starts = ends - counts
    smallest = lms[np.argsort(text[lms], kind="stable")]
    cuts = np.searchsorted(text[smallest], np.arange(257))
    heads = starts.copy()
    last = n - 1  # the end of the text comes first of all; it enters the last suffix
    if not s_type[last]:
        _place(order, np.array([last]), text[[last]], heads, 1)

    def enter(block, of_type, heads, step):
        before = block[block > 0] - 1
        before = before[s_type[before] == of_type]
        if len(before):
            _place(order, before, text[before], heads, step)

    for c in range(256):
        at = int(starts[c])
        while at < heads[c]:
            to = min(int(heads[c]), at + BLOCK)
            enter(np.array(order[at:to]), False, heads, 1)
            at = to
        for a in range(int(cuts[c]), int(cuts[c + 1]), BLOCK):
            enter(smallest[a : min(a + BLOCK, int(cuts[c + 1]))], False, heads, 1)
    l_ends, tails = heads, ends.copy()
    for c in range(255, -1, -1):
        at = int(ends[c])
        while at > tails[c]:
            to = max(int(tails[c]), at - BLOCK)
            enter(np.array(order[to:at])[::-1], True, tails, -1)
            at = to
        at = int(l_ends[c])
        while at > starts[c]:
            to = max(int(starts[c]), at - BLOCK)
            enter(np.array(order[to:at])[::-1], True, tails, -1)
            at = to
    return order


def _refine(ranks: np.ndarray, active: np.ndarray, reach: int) -> np.ndarray:
    """Orders tied elements by the rank ``reach`` places on; a rank counts the elements before its group.

    Returns the elements that are still tied.
    """
    n = len(ranks)
    after = np.zeros(len(active), np.int64)
    inside = active + reach < n
    after[inside] = ranks[active[inside] + reach] + 1
    keys = ranks[active] * (n + 1) + after
    by = np.argsort(keys)
    active, keys, old = active[by], keys[by], ranks[active[by]]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    group = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    in_group = first - group[np.searchsorted(group, first, "right") - 1]
    ranks[active] = np.repeat(old[first] + in_group, sizes)
    return active[np.repeat(sizes > 1, sizes)]


def _name(text, lms, order, is_lms, spool) -> np.ndarray:
    """Ranks of the substrings between leftmost S-type places, by place."""
    ends = np.concatenate([lms[1:] + 1, [len(text)]])
    number = spool.array(len(text), order.dtype)
    number[lms] = np.arange(len(lms))
    taken = np.concatenate([np.zeros(0, np.int64), *[number[b[is_lms[b]]] for b in (order[a : a + BLOCK] for a in range(0, len(order), BLOCK))]])
    a, b = lms[taken[:-1]], lms[taken[1:]]
    size = ends[taken[:-1]] - a
    same = size == ends[taken[1:]] - b
    if len(taken) > 1:
        same &= (taken[:-1] != len(lms) - 1) & (taken[1:] != len(lms) - 1)  # the last one meets the end
    live, at = np.flatnonzero(same), 0
    while len(live):
        live = live[size[live] > at]
        equal = text[a[live] + at] == text[b[live] + at]
        same[live[~equal]] = False
        live, at = live[equal], at + 1
    ranks = np.zeros(len(lms), np.int64)
    group = np.flatnonzero(np.concatenate([[True], ~same]))
    ranks[taken] = np.repeat(group, np.diff(np.concatenate([group, [len(taken)]])))
    return ranks


def suffix_array(text: np.ndarray, spool: Spool, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order of their first ``depth`` bytes at least."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    s_type = types(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    counts = np.bincount(text, minlength=256).astype(np.int64)
    order = spool.array(n, np.int32 if n < 1 << 31 else np.int64)
    if len(lms) > 1:
        ranks = _name(text, lms, induce(text, s_type, counts, lms, order), is_lms, spool)
        active = np.flatnonzero((np.bincount(ranks, minlength=len(ranks)) > 1)[ranks])
        reach = 1
        while reach * 2 < 2 * depth + 4 and len(active):  # a substring has two bytes of its own at least
            active = _refine(ranks, active, reach)
            reach *= 2
        lms = lms[np.argsort(ranks)]
    return induce(text, s_type, counts, lms, order)


def _agree(text, x, y, length) -> np.ndarray:
    """Which of the pairs of starts have the next ``length`` bytes alike.

    Pairs that follow each other at one distance are compared as one range; ranges
    are taken up by ``4 * BLOCK`` bytes at a time.
    """
    by = np.lexsort((x, y - x))
    x, far = x[by], (y - x)[by]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (far[1:] != far[:-1]) | (x[1:] - x[:-1] > length)
    begins = np.flatnonzero(fresh)
    lasts = np.concatenate([begins[1:], [len(x)]]) - 1
    sizes = x[lasts] - x[begins] + length
    upto = np.cumsum(sizes)
    out, first = np.zeros(len(x), bool), 0
    while first < len(begins):
        before = upto[first] - sizes[first]
        to = max(first + 1, int(np.searchsorted(upto, before + 4 * BLOCK, "right")))
        some = slice(first, to)
        offset = upto[some] - sizes[some] - before
        place = np.arange(upto[to - 1] - before) + np.repeat(x[begins[some]] - offset, sizes[some])
        wrong = np.zeros(len(place) + 1, np.int32)
        np.cumsum(text[place] != text[place + np.repeat(far[begins[some]], sizes[some])], out=wrong[1:])
        pairs = slice(begins[first], lasts[to - 1] + 1)
        own = np.repeat(np.arange(to - first), lasts[some] + 1 - begins[some])
        at = x[pairs] - x[begins[some]][own] + offset[own]
        out[by[pairs]] = wrong[at + length] == wrong[at]
        first = to
    return out


def classes(text: np.ndarray, valid: np.ndarray, length: int, spool: Spool) -> tuple[np.ndarray, np.ndarray]:
    """(places, class) of all ``valid`` starts of ``length`` bytes; a class is one string, its places stand together."""
    order = suffix_array(text, spool, length)
    order = np.concatenate([np.zeros(0, np.int64), *[b[valid[b]].astype(np.int64) for b in (np.asarray(order[a : a + BLOCK]) for a in range(0, len(order), BLOCK))]])
    same = np.zeros(max(0, len(order) - 1), bool)
    likely = np.ones(len(same), bool)
    for at in (length - 1, length // 2, 0, length // 3, length - 5):  # turns most pairs away
        likely &= text[order[1:] + at] == text[order[:-1] + at]
    likely = np.flatnonzero(likely)
    likely = likely[np.argsort(order[likely], kind="stable")]
    for a in range(0, len(likely), BLOCK):
        some = likely[a : a + BLOCK]
        same[some] = _agree(text, order[some], order[some + 1], length)
    return order, np.cumsum(np.concatenate([[0], ~same]))[: len(order)]
