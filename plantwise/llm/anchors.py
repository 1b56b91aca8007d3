"""Content-defined anchors: every string of ``length`` bytes picks one place inside itself by
its bytes alone, so equal strings anywhere pick the same place and can be brought together."""

from __future__ import annotations

import numpy as np

GRAM = 32
PLACE_BITS = 24
BLOCK = 1 << 22  # bytes handled at a time
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)  # fixed seed


class Powers:
    """Powers of the multiplier and of its inverse modulo 2^64, grown as needed."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, factor in (("up", ODD), ("down", INVERSE)):
                steps = np.full(n, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    out, width = values, 1
    while 2 * width <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = window - width
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram, context, first, last, place) of every anchor: hash of its gram, hash of the bytes
    from ``first`` to ``last + length``, the first and last start of the strings that chose it
    and its own place. Of equal grams inside a string the leftmost is chosen."""
    out = []
    for begin in range(0, max(len(data) - length + 1, 0), BLOCK):
        block = data[begin:begin + BLOCK + length - 1]
        up, down = Powers.reach(len(block) + 1)
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[block] * up[:-1], out=sums[1:])
        h = mixed((sums[GRAM:] - sums[:-GRAM]) * down[:len(sums) - GRAM])
        low = np.uint64(PLACE_BITS)
        marked = ((h >> low) << low) | np.arange(len(h), dtype=np.uint64)
        chosen = (sliding_min(marked, length - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
        place = chosen[first]
        context = mixed((sums[last + length] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        out.append((h[place], context, first + begin, last + begin, place + begin))
    if not out:
        empty = np.empty(0, dtype=np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out))
