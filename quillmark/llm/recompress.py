"""Recompression of word sequences: rounds that name runs and pairs of tokens, the same wherever the same words stand.

A name is a hash of what it names, so all tasks give equal sequences equal names without asking each other. In a round,
first every run of one token but its last copy becomes one token; then every token of the left class that is followed by
one of the right class becomes one token with it. A token's class is a bit of its hash. What becomes of a token is settled
by its neighbours alone, so that inside equal windows of words everything is named alike but for a margin, which is known:
at the left end a run's copies before its last, and a token of the right class; at the right end the last run, and a token of
the left class. What a window holds without these margins, after the last round that leaves anything, is its core. Equal
windows have equal cores at equal places: they share the token chosen from it, their anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

U = np.uint64
RUN, PAIR, SPAN = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Bytes of a text that are split into words at once; a longer text is cut between words.
BYTES_HELD = 1 << 18
BLANK = b" \t\n\x0b\x0c\r"


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each word of UTF-8 texts, one text after the other, and how many words each text has. Together they are the word's XXH3 of 128 bits."""
    found, sizes = [np.zeros((0, 2), U)], []
    for text in texts:
        n = 0
        for part in _pieces(text):
            words = part.split()
            n += len(words)
            found.append(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2).astype(U))
        sizes.append(n)
    both = np.concatenate(found)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), np.array(sizes, np.int64)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BYTES_HELD)
        while end < len(text) and text[end] not in BLANK:
            end += 1
        yield text[at:end]
        at = end


class Sums:
    """Hashes of any span of a sequence of tokens: polynomials in an odd base, modulo 2^64."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        powers = np.full(n + 1, BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.before = np.zeros(n + 1, U)
        np.cumsum(tokens * powers[:n], out=self.before[1:])
        self.back = np.full(n + 1, U(pow(int(BASE), -1, 1 << 64)))
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.before[end] - self.before[start]) * self.back[start])


class PrimeSums:
    """Hashes of any span, unrelated to Sums: polynomials modulo two primes under 2^31, side by side."""

    #: The primes, and a base of each.
    FIELDS = ((2147483647, 1103515245), (2147483629, 1597334677))

    def __init__(self, tokens: np.ndarray):
        self.parts = []
        for p, base in self.FIELDS:
            x = tokens % U(p)
            before = np.zeros(len(x) + 1, U)
            np.cumsum(x * self._powers(base, p, len(x)) % U(p), out=before[1:])  # under 2^31 * 2^31 words
            self.parts.append((U(p), before % U(p), self._powers(pow(base, -1, p), p, len(x) + 1)))

    @staticmethod
    def _powers(base: int, p: int, n: int) -> np.ndarray:
        out, step = np.ones(1, U), base % p
        while len(out) < n:
            out, step = np.concatenate([out, out * U(step) % U(p)]), step * step % p
        return out[:n]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = ((before[end] + p - before[start]) % p * back[start] % p for p, before, back in self.parts)
        return mix(high << U(32) | low)


def anchors(tokens: np.ndarray, part: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The name and the first word of the anchor of each window of `width` tokens that begins at `starts`.

    part: the text that a token is of; nothing is named across texts.
    """
    name, first = np.zeros(len(starts), U), np.zeros(len(starts), np.int64)
    sym, at, of = tokens, np.arange(len(tokens)), part
    live, low, high = np.arange(len(starts)), starts.copy(), starts + width
    for step in range(4 * width):
        if not len(live):
            break
        joined = of[1:] == of[:-1]
        if step % 2 == 0:
            head = np.zeros(len(sym), bool)
            head[:-1] = joined & (sym[1:] == sym[:-1])
            begin = np.ones(len(sym), bool)
            begin[1:] = ~(head[:-1] & head[1:])
            run_begin = np.ones(len(sym), bool)
            run_begin[1:] = ~head[:-1]
            run = np.maximum.accumulate(np.where(run_begin, np.arange(len(sym)), 0))
            to = np.cumsum(begin) - 1
            new_low = to[low] + head[low]
            new_high = np.where(run[high - 1] > low, to[run[high - 1]], new_low)
            keep = np.flatnonzero(begin)
            length = np.diff(np.append(keep, len(sym))).astype(U)
            new = np.where(head[keep], mix(sym[keep] * RUN + length), sym[keep])
        else:
            left = (mix(sym + U(step)) >> U(63)).astype(bool)
            pair = np.zeros(len(sym), bool)
            pair[:-1] = joined & left[:-1] & ~left[1:]
            begin = np.ones(len(sym), bool)
            begin[1:] = ~pair[:-1]
            to = np.cumsum(begin) - 1
            new_low = low + ~left[low]
            last = high - left[high - 1]
            empty = new_low >= last
            new_high = np.where(empty, 0, to[np.maximum(last, 1) - 1] + 1)
            new_low = np.where(empty, 0, to[np.minimum(new_low, len(sym) - 1)])
            keep = np.flatnonzero(begin)
            follower = np.append(sym, U(0))[keep + 1]
            new = np.where(pair[keep], mix(mix(sym[keep] + PAIR) ^ (follower * PAIR + U(1))), sym[keep])
        done = new_low >= new_high
        if done.any():
            a, b = low[done], high[done]
            best = a.copy()
            least = mix(sym[a] ^ SPAN)
            for k in range(1, 4):
                other = np.minimum(a + k, b - 1)
                h = mix(sym[other] ^ SPAN)
                better = h < least
                best, least = np.where(better, other, best), np.where(better, h, least)
            name[live[done]], first[live[done]] = sym[best], at[best]
            live, new_low, new_high = live[~done], new_low[~done], new_high[~done]
        sym, at, of, low, high = new, at[keep], of[keep], new_low, new_high
    return name, first
