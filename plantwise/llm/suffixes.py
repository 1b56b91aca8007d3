"""Two-stage suffix sorting of many short texts at once, to a bounded depth.

A suffix smaller than its successor is sorted directly, by its bytes. The others are induced
by a scan over the buckets of first bytes, from small to large: within a bucket, a suffix
larger than its successor is ordered by the length of its run of equal bytes and then by the
rank of the suffix behind that run, which starts with a smaller byte and is already ranked;
all of them come before the bucket's directly sorted ones. Common prefixes of neighbours are
then computed by comparing bytes.
"""

from __future__ import annotations

import numpy as np

END = -1  # stands behind every text and is smaller than all bytes


def windows(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Rows of ``depth`` bytes from each place (zeros behind the last text)."""
    padded = np.concatenate([np.maximum(text, 0).astype(np.uint8), np.zeros(depth, dtype=np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, depth)[places]


def sorted_starts(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places of ``text`` (int16: bytes, END behind each text) by suffix; suffixes that
    agree in ``depth`` bytes stand together. ``wanted``: a mask of places."""
    n = len(text)
    after = np.concatenate([text[1:], [END - 1]])
    # place behind the run of equal bytes that starts here
    run_ends = np.flatnonzero(text != after)
    behind = run_ends[np.searchsorted(run_ends, np.arange(n))] + 1
    follower = np.where(behind < n, text[np.minimum(behind, n - 1)], END)
    direct = (follower > text) & (text != END)
    # a wanted suffix that isn't sorted directly needs the ranks of those behind it, up to the
    # first direct one or the text's end
    stops = np.concatenate([[0], np.cumsum(direct | (text == END))])
    last_wanted = np.maximum.accumulate(np.where(wanted, np.arange(n), -1))
    needed = (last_wanted >= 0) & (text != END) & (stops[:n] - stops[np.minimum(last_wanted + 1, n)] <= 0)
    needed |= wanted
    rank = np.full(n, -1, dtype=np.int64)
    places = np.flatnonzero(needed & direct)
    keys = np.ascontiguousarray(windows(text, places, depth)).view(f"S{depth}").ravel()
    places = places[np.argsort(keys, kind="stable")]
    induced = np.flatnonzero(needed & ~direct)
    induced = induced[np.argsort(text[induced], kind="stable")]
    direct_from = np.searchsorted(text[places], np.arange(257))
    induced_from = np.searchsorted(text[induced], np.arange(257))
    order, ranked = [], 0
    for byte in range(256):
        own = induced[induced_from[byte]:induced_from[byte + 1]]
        if len(own):
            ends = behind[own]
            key = np.where(text[np.minimum(ends, n - 1)] == END, -1, rank[np.minimum(ends, n - 1)])
            own = own[np.lexsort((key, ends - own))]
            rank[own] = ranked + np.arange(len(own))
            ranked += len(own)
            order.append(own)
        own = places[direct_from[byte]:direct_from[byte + 1]]
        if len(own):
            rank[own] = ranked + np.arange(len(own))
            ranked += len(own)
            order.append(own)
    if not order:
        return np.empty(0, dtype=np.int64)
    order = np.concatenate(order)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, chunk: int = 1 << 17) -> np.ndarray:
    """Common prefix, up to ``depth``, of each place in ``order`` with the one before it."""
    out = np.zeros(len(order), dtype=np.int64)
    for at in range(1, len(order), chunk):
        own = order[at:at + chunk]
        before = order[at - 1:at - 1 + len(own)]
        differ = windows(text, own, depth) != windows(text, before, depth)
        out[at:at + len(own)] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return out
