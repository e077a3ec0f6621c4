"""Benchmark decontamination: exact hits of an item's pieces, verified by bit-parallel edit distance."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item; items with fewer characters than LEAST must stand there unchanged, as whole words.
ERROR_RATE, LEAST = 0.08, 20
#: Characters of the items that go to the tasks together: the bound of what is broadcast. More items make more blocks.
BLOCK_CHARS = 4_000_000
MATCHES = "array<struct<item_id:long,distance:int>>"


def normal(text: str) -> str:
    """Small letters and digits, everything between them one space."""
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def distance(pattern: dict[str, int], m: int, text: str) -> int:
    """Edits between the pattern and the nearest part of the text (Myers, whole vectors as Python integers)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh & full
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
    return best


class Matcher:
    """Finds items in texts with up to rate edits for each of an item's characters."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items, self.pieces = [], defaultdict(list)
        for item_id, text in items:
            if not text:
                continue
            k, m = int(rate * len(text)) if len(text) >= LEAST else 0, len(text)
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(text):
                masks[c] |= 1 << i
            cuts = [j * m // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                self.pieces[text[a:b]].append((len(self.items), a))
            self.items.append((item_id, k, m, dict(masks)))
        self.automaton = ahocorasick.Automaton()
        for p, of in self.pieces.items():
            self.automaton.add_word(p, (len(p), of))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(item, fewest edits) for each item found."""
        if not self.items:
            return []
        text = normal(text)
        near: dict[int, list[int]] = defaultdict(list)
        for end, (length, of) in self.automaton.iter(text):
            for item, at in of:
                near[item].append(end + 1 - length - at)
        out = []
        for item, starts in near.items():
            item_id, k, m, masks = self.items[item]
            best = k + 1
            if m < LEAST:
                best = 0 if any((not a or text[a - 1] == " ") and text[a + m : a + m + 1] in ("", " ") for a in starts) else 1
                starts = []
            for a, b in spans(starts, m, k):
                best = min(best, distance(masks, m, text[max(0, a) : b]))
            if best <= k:
                out.append((item_id, best))
        return sorted(out)


def spans(starts: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
    """Where an item that begins about there may stand; overlapping places become one."""
    a = b = None
    for s in sorted(set(starts)):
        if b is not None and s - k <= b:
            b = s + m + k
            continue
        if b is not None:
            yield a, b
        a, b = s - k, s + m + k
    if b is not None:
        yield a, b


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items of a benchmark(item_id, text), normalised, a bounded block at a time."""
    held, chars = [], 0
    for row in items.where(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if held and chars + len(text) > BLOCK_CHARS:
            yield held
            held, chars = [], 0
        held.append((row["item_id"], text))
        chars += len(text)
    if held:
        yield held


#: A worker's matchers by block, so that its next task needs not build them again.
MATCHERS: dict[str, Matcher] = {}


def finder(shared, rate: float):
    """A column function of a broadcast block of items."""
    block = uuid.uuid4().hex

    @F.pandas_udf(MATCHES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from quillmark.llm.decontaminate import MATCHERS  # this process's own

        if block not in MATCHERS:
            while len(MATCHERS) >= 8:
                MATCHERS.pop(next(iter(MATCHERS)))
            MATCHERS[block] = Matcher(shared.value, rate)
        search = MATCHERS[block]
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d} for i, d in search(t)] if t else [] for t in texts])

    return find


def matches(text: Column, items: DataFrame, rate: float = ERROR_RATE) -> Column:
    """A column with the items found in the text: array(struct(item_id, distance))."""
    sc = items.sparkSession.sparkContext
    found = [finder(sc.broadcast(block), rate)(text) for block in blocks(items)]
    return F.concat(*found) if found else F.array().cast(MATCHES)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, contaminated, matches) for every row of docs(doc_id, text).

    An item is found where its normalised text stands in the document's with at most rate edits for each of its
    characters. It is cut into one piece more than edits are allowed, so that one piece is there unchanged. Items of fewer than
    LEAST characters are found where they stand unchanged as whole words; items without a letter or digit match nothing; null and empty texts hold nothing. Rows that repeat come out each;
    an item that stands twice in the benchmark is found twice; other columns are ignored.
    """
    out = docs.select("doc_id", matches(F.col("text"), items, rate).alias("matches"))
    return out.select("doc_id", (F.size("matches") > 0).alias("contaminated"), "matches")
