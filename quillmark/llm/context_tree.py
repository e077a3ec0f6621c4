"""Context-tree weighting over bytes, fitted on counts of all training texts.

A byte is eight binary decisions, and each of the 255 decisions (those above it in the byte are known) has a tree of its
own: a node is a context of the last 0 to DEPTH bytes, with a Krichevsky-Trofimov estimate from how often either bit came
there. A node's weighted probability is half its own estimate and half the product of the nodes one byte deeper; what a
node predicts is mixed by the posterior of those halves, so that all depths count as the counts deserve.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
LOW = np.uint64(0xFF)


def byte_grams(text: bytes, depth: int = DEPTH) -> np.ndarray:
    """For each byte of the text and the newline that ends it, that byte with the `depth` before it, the last one lowest."""
    b = np.frombuffer(bytes(depth) + text + b"\n", np.uint8)
    n = len(b) - depth
    g = np.zeros(n, np.uint64)
    for k in range(depth + 1):
        g <<= np.uint64(8)
        g |= b[k : k + n]
    return g


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: code (context, then the bits above with a 1 before them), counts and what is worked out of them."""

    def __init__(self, codes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray | None):
        """deeper: the logarithm of the product of the nodes' children; None at the greatest depth."""
        self.codes, self.zeros, self.ones = codes, zeros, ones
        own = estimate(zeros, ones)
        self.weighted = own if deeper is None else np.logaddexp(own, deeper) - np.log(2)
        self.stop = np.ones(len(codes)) if deeper is None else np.exp(own - np.log(2) - self.weighted)

    def mix(self, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """What the nodes at these places predict for the bits, given what the deeper ones do."""
        share = (np.where(bit, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)
        return self.stop[at] * share + (1 - self.stop[at]) * deeper

    def above(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, counts and product of the parents at `depth`, and each node's place among them."""
        context = self.codes >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1)
        codes, place = np.unique(context << np.uint64(8) | self.codes & LOW, return_inverse=True)
        sums = [np.bincount(place, x, len(codes)) for x in (self.zeros, self.ones, self.weighted)]
        return codes, *sums, place


def deep_levels(grams: np.ndarray, counts: np.ndarray, down_to: int, depth: int = DEPTH) -> tuple[list[Level], list[np.ndarray], np.ndarray]:
    """The levels from `depth` up to `down_to`, the place of each gram's eight decisions in each, and the bits decided.

    grams must hold all that share their last `down_to` context bytes.
    """
    byte, context = grams & LOW, grams >> np.uint64(8)
    j = np.arange(8, dtype=np.uint64)[:, None]
    above = np.uint64(1) << j | byte >> (np.uint64(8) - j)
    bits = (byte >> (np.uint64(7) - j) & np.uint64(1)).astype(bool)
    codes, place = np.unique(context << np.uint64(8) | above, return_inverse=True)
    place = place.reshape(bits.shape)
    n = np.broadcast_to(counts, bits.shape)
    ones = np.bincount(place.ravel(), (n * bits).ravel(), len(codes))
    levels, places = [Level(codes, np.bincount(place.ravel(), n.ravel(), len(codes)) - ones, ones, None)], [place]
    for d in range(depth - 1, down_to - 1, -1):
        codes, zeros, ones, product, up = levels[-1].above(d)
        levels.append(Level(codes, zeros, ones, product))
        places.append(up[places[-1]])
    return levels, places, bits


def shallow_levels(codes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, product: np.ndarray) -> tuple[Level, Level]:
    """The levels of one byte and of none, from sums over the nodes of two; at most 256 * 255 nodes."""
    order = np.argsort(codes)
    one = Level(codes[order], zeros[order], ones[order], product[order])
    root, zeros, ones, product, _ = one.above(0)
    return one, Level(root, zeros, ones, product)


def log_probabilities(grams: np.ndarray, counts: np.ndarray, shallow: tuple[Level, Level], depth: int = DEPTH) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the others."""
    levels, places, bits = deep_levels(grams, counts, 2, depth)
    p = np.full(bits.shape, 0.5)
    for level, place in zip(levels, places, strict=True):
        p = level.mix(place, bits, p)
    code = levels[-1].codes[places[-1]]
    for d, level in zip((1, 0), shallow, strict=True):
        own = (code >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | code & LOW
        p = level.mix(np.searchsorted(level.codes, own), bits, p)
    return np.log10(p).sum(0)


class Lookup:
    """Values by 64-bit keys, in arrays: a key stands at its hash or behind it."""

    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, np.nan, np.float32)  # nan: nothing there
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = np.isnan(self.values[slot])
            at, who = slot[free], left[free]
            self.keys[at], self.values[at] = keys[who], values[who]
            there = (self.keys[slot] == keys[left]) & ~np.isnan(self.values[slot])
            slot, left = slot[~there] + 1 & (1 << self.bits) - 1, left[~there]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values of these keys; nan for those that aren't there."""
        slot = self.slots(keys)
        wrong = np.flatnonzero(self.keys[slot] != keys)
        while len(wrong):
            wrong = wrong[~np.isnan(self.values[slot[wrong]])]
            slot[wrong] = slot[wrong] + 1 & (1 << self.bits) - 1
            wrong = wrong[self.keys[slot[wrong]] != keys[wrong]]
        return np.where(self.keys[slot] == keys, self.values[slot], np.float32(np.nan))
