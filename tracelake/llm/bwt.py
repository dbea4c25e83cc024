"""Repeated strings of a block by threshold-bounded interval expansion on its Burrows-Wheeler transform.

A block is a run of texts, each ended by SEP, a byte that UTF-8 never has. Suffixes are ordered by their first bytes only, as
many as a match must have, which is all that backward steps up to that length need. Expansion starts from the interval of the
empty string and goes breadth first: each interval of a string w is extended backward to the intervals of cw for every byte c
before it; the end of a new interval has a common prefix with its neighbour of as many bytes as there were steps before, unless
an earlier step has told it already, and only ends that are new go on. So common prefixes come by increasing value, each place
once, and after `length` steps the places still untold are those where neighbours agree on `length` bytes or more.
"""

from __future__ import annotations

import numpy as np

SEP = 255


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts, ordered by at least their first `depth` bytes; prefix doubling over what is still tied."""
    n = len(data)
    key = np.zeros(n + 8, np.uint64)
    key[:n] = data
    for width in (1, 2, 4):
        key[: n + 8 - width] = (key[: n + 8 - width] << np.uint64(8 * width)) | key[width:]
    key = key[:n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    slots = np.arange(n, dtype=np.int32)
    rank = np.zeros(n + 1, np.int32)  # 0 stands for the end, the rest are one more than the group's first slot
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
    rank[n] = 0
    done = 8
    while done < depth and len(slots):
        last = np.append(new[1:], True)
        tied = ~(new & last)
        slots = slots[tied]
        if not len(slots):
            break
        at = order[slots]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + done, n)].astype(np.uint64)
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        done *= 2
    return order


def untold(data: np.ndarray, length: int):
    """(suffix order, flags): flag k says that suffixes k - 1 and k agree on `length` bytes or more; texts end with SEP."""
    n = len(data)
    order = suffix_order(data, length)
    before = data[order - 1]  # the transform; the first text's predecessor is the last SEP
    by = np.argsort(before, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)  # where a place goes when its byte is put before
    step[by] = np.arange(n, dtype=np.int32)
    # the places of the same byte on either side, to find a byte's first and last place within an interval
    prior, following = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    same = before[by[1:]] == before[by[:-1]]
    prior[by[1:][same]] = by[:-1][same]
    following[by[:-1][same]] = by[1:][same]
    open_ = before != SEP
    told = np.zeros(n + 1, bool)
    told[0] = told[n] = True
    lo, hi = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(length):
        if not len(lo):
            break
        one = hi - lo == 1
        single, lo, hi = lo[one], lo[~one], hi[~one]
        begins = step[single[open_[single]]]
        ends = begins + 1
        if len(lo):
            size = hi - lo
            shift = np.cumsum(size) - size
            place = np.arange(size.sum(), dtype=np.int32) + np.repeat(lo - shift.astype(np.int32), size)
            real = open_[place]
            first = step[place[real & (prior[place] < np.repeat(lo, size))]]
            last = step[place[real & (following[place] >= np.repeat(hi, size))]]
            # intervals of one length are disjoint, so firsts and lasts pair up by order
            begins, ends = np.concatenate((begins, np.sort(first))), np.concatenate((ends, np.sort(last) + 1))
        fresh = ~told[ends]
        lo, hi = begins[fresh], ends[fresh]
        told[hi] = True
    return order, ~told[:n]


def repeated(data: np.ndarray, length: int) -> np.ndarray:
    """For each place of a block whether the `length` bytes from there also start at another place; none reaches over a SEP."""
    n = len(data)
    out = np.zeros(n, bool)
    if n >= length:
        order, agree = untold(data, length)
        out[order] = agree | np.append(agree[1:], False)
        ends = np.flatnonzero(data == SEP)
        for end, last in zip(ends.tolist(), np.concatenate(([-1], ends[:-1])).tolist(), strict=True):
            out[max(last + 1, end - length + 1) : end + 1] = False
    return out
