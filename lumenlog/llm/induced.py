"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than their right neighbour; the
leftmost-smaller substrings are sorted, named, and the string of
names is sorted recursively, at any size, until names are unique; the full order is
induced from theirs. Inducing visits buckets in order. A bucket with many suffixes moves
its entries on together, wave by wave, instead of one at a time. Neighbouring buckets
with few suffixes each, as wide alphabets of names have, are visited as one: what they
induce among themselves is put in order generation by generation, which are few, as
letters with long runs are visited alone.
"""

from __future__ import annotations

import numpy as np

#: Suffixes of neighbouring buckets that are visited as one.
BATCH = 16384


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one to its right; the last is larger (than the empty one)."""
    n = len(t)
    s = np.zeros(n, bool)
    change = np.flatnonzero(t[:-1] != t[1:])
    if len(change):
        rises = t[change] < t[change + 1]
        s[: change[-1] + 1] = np.repeat(rises, np.diff(change, prepend=-1))
    return s


def _deal(sa: np.ndarray, at: np.ndarray, p: np.ndarray, c: np.ndarray, step: int) -> None:
    """Append the positions ``p`` (letters ``c``) to their buckets, in order, upwards or downwards."""
    if len(p) == 1:
        k = c[0]
        if step > 0:
            sa[at[k]] = p[0]
            at[k] += 1
        else:
            at[k] -= 1
            sa[at[k]] = p[0]
        return
    order = np.argsort(c, kind="stable")
    c, p = c[order], p[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    sizes = np.diff(np.append(first, len(c)))
    within = np.arange(len(c)) - np.repeat(first, sizes)
    heads = c[first]
    if step > 0:
        sa[np.repeat(at[heads], sizes) + within] = p
        at[heads] += sizes
    else:
        sa[np.repeat(at[heads], sizes) - 1 - within] = p
        at[heads] -= sizes


def _by_bucket(t: np.ndarray, sa: np.ndarray, at: np.ndarray, p: np.ndarray, step: int) -> None:
    """Deal what one pass induces to later buckets."""
    if len(p):
        _deal(sa, at, p, t[p], step)


def _batches(t: np.ndarray, counts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of letters: neighbours with about ``most`` suffixes together, but letters that stand thrice in a row alone."""
    alone = np.zeros(len(counts) + 1, bool)
    alone[t[:-2][(t[1:-1] == t[:-2]) & (t[2:] == t[1:-1])]] = True
    alone[-1] = True
    stops = np.flatnonzero(alone)
    ends = np.cumsum(counts)
    out, low, k = [], 0, 0
    while low < len(counts):
        stop = int(stops[k])
        if stop == low:
            out.append((low, low + 1))
            low, k = low + 1, k + 1
            continue
        before = int(ends[low - 1]) if low else 0
        high = min(stop, max(low + 1, int(np.searchsorted(ends, before + most, side="right"))))
        out.append((low, high))
        low = high
    return out


def _settle(t: np.ndarray, moves: np.ndarray, lead: np.ndarray, lead_key: np.ndarray, low: int, high: int, step: int, place: np.ndarray) -> np.ndarray:
    """The order in which a pass visits the suffixes of the letters ``low`` to ``high``.

    ``lead`` are those that are in place before the range is visited, with keys that order them: three for each
    letter, the first for what came from earlier letters, the third for leftmost-smaller suffixes; the second is for
    those induced inside the range, generation by generation: a suffix's place follows that of its right neighbour, so
    each generation is put in order once that of the one before is known. ``place`` is room for a number per suffix.
    """
    every = fresh = lead
    tail, tail_key = np.zeros(0, lead.dtype), np.zeros(0, np.int64)
    lead_key = (lead_key << 32) | np.arange(len(lead), dtype=np.int64)
    while True:
        p = fresh - 1
        p = p[p >= 0]
        p = p[moves[p]]
        c = t[p]
        near = (c >= low) & (c < high)
        p = p[near]
        if not len(p):
            return every
        c = c[near].astype(np.int64)
        tail = np.concatenate([tail, p])
        tail_key = np.concatenate([tail_key, (3 * (c - low if step > 0 else high - 1 - c) + 1) << 32])
        place[every] = np.arange(len(every), dtype=np.int32)
        order = np.argsort(np.concatenate([lead_key, tail_key | place[tail + 1]]))
        every, fresh = np.concatenate([lead, tail])[order], p


def _pass(t: np.ndarray, moves: np.ndarray, sa: np.ndarray, at: np.ndarray, edge: np.ndarray, counts: np.ndarray, given: tuple[np.ndarray, np.ndarray, np.ndarray], step: int) -> None:
    """One pass over the buckets, upwards or downwards: each suffix visited puts its left neighbour, if it ``moves``, in its bucket.

    ``given``: suffixes that each bucket has besides those put there, in the order of visiting, and where each letter's begin and end.
    """
    own, from_, to = given
    ranges = _batches(t, counts, BATCH)
    place = np.empty(len(t) + 1, np.int32)
    for low, high in ranges if step > 0 else reversed(ranges):
        if high == low + 1:
            # One bucket: its entries move on together, wave by wave.
            done = edge[low]
            while done != at[low]:
                p = (sa[done : at[low]] if step > 0 else sa[at[low] : done][::-1]) - 1
                done = at[low]
                p = p[p >= 0]
                _by_bucket(t, sa, at, p[moves[p]], step)
            if to[low] > from_[low]:
                p = own[from_[low] : to[low]] - 1
                p = p[p >= 0]
                _by_bucket(t, sa, at, p[moves[p]], step)
            continue
        span = np.arange(low, high) if step > 0 else np.arange(high - 1, low - 1, -1)
        size = np.abs(at[span] - edge[span])
        extra = to[span] - from_[span]
        rank = np.arange(high - low, dtype=np.int64)
        begin = edge[span] if step > 0 else edge[span] - 1
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        put = sa[np.repeat(begin, size) + step * within]
        within = np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra)
        lms = own[np.repeat(from_[span], extra) + within]
        lead = np.concatenate([put, lms])
        if not len(lead):
            continue
        key = np.concatenate([3 * np.repeat(rank, size), 3 * np.repeat(rank, extra) + 2])
        order = np.argsort(key, kind="stable")
        lead, key = lead[order], key[order]
        every = _settle(t, moves, lead, key, low, high, step, place)
        p = every - 1
        p = p[p >= 0]
        _by_bucket(t, sa, at, p[moves[p]], step)


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes, given the order of the leftmost-smaller ones."""
    n = len(t)
    sa = np.empty(n, np.int32)
    counts = np.bincount(t, minlength=sigma)
    ends = np.cumsum(counts)
    heads = ends - counts
    larger = np.bincount(t[~small], minlength=sigma)
    letter = t[lms]
    names = np.arange(sigma)
    at = heads.copy()
    last = int(t[-1])
    sa[at[last]] = n - 1
    at[last] += 1
    _pass(t, ~small, sa, at, heads, counts, (lms, np.searchsorted(letter, names, "left"), np.searchsorted(letter, names, "right")), 1)
    # Downwards, a bucket's smaller suffixes are visited first, then its larger ones, from the right.
    at = ends.copy()
    _pass(t, small, sa, at, ends, counts, (sa[::-1], n - heads - larger, n - heads), -1)
    return sa


def _names(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> tuple[np.ndarray, int]:
    """The leftmost-smaller substrings' places in their order, equal ones alike, and how many different ones there are.

    A substring reaches to the next one's first letter, the last to the end of the text, which is less than any letter.
    Letters are compared with their kind, a larger suffix before a smaller one, so that none is the beginning of another:
    as many as fit are packed into one number, and those still tied go on with their next letters.
    """
    m = len(lms)
    bits = int(2 * sigma + 1).bit_length()
    per = 63 // bits
    code = np.zeros(len(t) + per + 1, np.uint32)
    code[: len(t)] = (t.astype(np.uint32) + np.uint32(1)) * np.uint32(2) + small
    size = np.append(np.diff(lms) + 1, len(t) - lms[-1] + 1)
    rank = np.zeros(m, np.int64)
    live, at = np.arange(m), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for k in range(at, at + per):
            key <<= bits
            key |= np.where(k < size[live], code[np.minimum(lms[live] + k, len(code) - 1)], 0)
        order = np.lexsort((key, rank[live])) if at else np.argsort(key)
        live, key = live[order], key[order]
        group = rank[live]
        new = np.ones(len(live), bool)
        fresh = np.ones(len(live), bool)
        np.not_equal(group[1:], group[:-1], out=new[1:])
        np.logical_or(new[1:], key[1:] != key[:-1], out=fresh[1:])
        here = np.arange(len(live))
        head = np.maximum.accumulate(np.where(fresh, here, 0))
        rank[live] = group + head - np.maximum.accumulate(np.where(new, here, 0))
        at += per
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        live = live[tied & (size[live] > at)]
    heads = np.zeros(m, bool)
    heads[rank] = True
    place = np.cumsum(heads) - 1
    return place[rank], int(place[-1]) + 1


def suffix_array(t: np.ndarray, sigma: int = 256) -> np.ndarray:
    """Order of all suffixes of the non-negative letters ``t`` below ``sigma``."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _smaller(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        names, total = _names(t, small, lms, sigma)
        if total < len(lms):
            lms = lms[suffix_array(names.astype(np.uint16 if total <= 65536 else np.int32), total)]
        else:
            lms = lms[np.argsort(names)]
    return _induce(t, small, lms, sigma)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix of its suffix with the one before it in order (0 for the first).

    Lengths are compared only where the preceding letters differ; elsewhere they
    are one less than the length one position before.
    """
    n = len(t)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    pos = np.arange(n, dtype=np.int32)
    start = (before <= 0) | (pos == 0)
    start[~start] = t[pos[~start] - 1] != t[before[~start] - 1]
    start[sa[0]] = True
    i = pos[start & (before >= 0)].astype(np.int64)
    j = before[i].astype(np.int64)
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = np.zeros(n, np.int64)
    got = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + got[live], j[live] + got[live]
        room = n - np.maximum(a, b)
        x = np.ascontiguousarray(words[np.minimum(a, n)]).view(np.uint64).ravel() ^ np.ascontiguousarray(words[np.minimum(b, n)]).view(np.uint64).ravel()
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        same = np.minimum(same, room)
        got[live] += same
        live = live[(same == 8)]
    length[i] = got
    reach = np.where(start, length + pos, -1)
    return (np.maximum.accumulate(reach) - pos).astype(np.int64)
