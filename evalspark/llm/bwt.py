"""Repeated substrings of at least a given length inside one shard of byte strings, from its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

_DIRECT = 64  # intervals up to this size list their own symbols; larger ones try the alphabet


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols (more where doubling gives it); symbols are below 257."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key * 257 + padded[j:j + n]
    done = 7
    values, rank = np.unique(key, return_inverse=True)
    while done < depth and len(values) < n:
        tail = np.zeros(n, np.int64)
        if done < n:
            tail[:n - done] = rank[done:] + 1
        values, rank = np.unique(rank.astype(np.int64) * (n + 1) + tail, return_inverse=True)
        done *= 2
    return np.argsort(rank, kind="stable")


def open_borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Mask over sorted suffixes: True where the common prefix with the suffix before has ``length`` symbols or more.

    Breadth-first backward extension: the intervals of all strings w are extended to the left by every symbol c that
    precedes them; the right border of the interval of cw gets the common prefix len(w) unless it has one already, and
    only then the interval goes on. Values come in rising order, so the search stops at ``length``, and borders without
    a value lie at ``length`` or above. Symbol 0 separates strings and is never extended.
    """
    n = len(text)
    before = text[order - 1]
    place = np.argsort(before, kind="stable")
    ranked = before[place].astype(np.int64) * (n + 1) + place  # sorted: its search gives the backward step
    alphabet = np.unique(before)
    alphabet = alphabet[alphabet > 0].astype(np.int64)
    free = np.ones(n + 1, bool)
    free[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        near = size <= _DIRECT
        near_lo, near_size, near_hi = lo[near], size[near], hi[near]
        at = np.repeat(near_lo - (np.cumsum(near_size) - near_size), near_size) + np.arange(int(near_size.sum()))
        symbol, left, right = before[at].astype(np.int64), np.repeat(near_lo, near_size), np.repeat(near_hi, near_size)
        if not near.all():
            far = ~near
            symbol = np.concatenate([symbol, np.tile(alphabet, int(far.sum()))])
            left = np.concatenate([left, np.repeat(lo[far], len(alphabet))])
            right = np.concatenate([right, np.repeat(hi[far], len(alphabet))])
        keep = symbol > 0
        symbol, left, right = symbol[keep], left[keep], right[keep]
        new_hi = np.searchsorted(ranked, symbol * (n + 1) + right)
        keep = free[new_hi]
        symbol, left, new_hi = symbol[keep], left[keep], new_hi[keep]
        new_lo = np.searchsorted(ranked, symbol * (n + 1) + left)
        keep = new_lo < new_hi
        new_lo, new_hi = new_lo[keep], new_hi[keep]
        new_hi, first = np.unique(new_hi, return_index=True)
        new_lo = new_lo[first]
        free[new_hi] = False
        lo, hi = new_lo, new_hi
        if not len(lo):
            break
    return free[:n]


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, a mask over its first len - length + 1 bytes: the ``length`` bytes from there occur elsewhere in the shard."""
    if not strings:
        return []
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    data = np.frombuffer(b"".join(strings), np.uint8)
    inner = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    text[inner] = data.astype(np.uint16) + 1
    valid = np.zeros(len(text), bool)
    wide = np.maximum(sizes - length + 1, 0)
    at = np.repeat(starts - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
    valid[at] = True
    order = suffix_order(text, length)
    joined = open_borders(text, order, length)
    ok = valid[order]
    pair = joined.copy()
    pair[1:] &= ok[1:] & ok[:-1]
    pair[0] = False
    hit = np.zeros(len(text), bool)
    both = np.flatnonzero(pair)
    hit[order[both]] = True
    hit[order[both - 1]] = True
    return [hit[s:s + w] for s, w in zip(starts.tolist(), wide.tolist())]
