"""SimHash near-duplicates: fingerprints, pigeonhole blocks, a check of the Hamming distance, and groups of what links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import arrow_schema, checkpointed, in_batches, shuffle_partitions
from quillmark.llm.components import components

SEED = 42
#: Shingles hashed at once; bounds the memory that a very long text takes.
SLICE = 1 << 16
#: Members of a block up to which all its pairs are compared side by side.
SMALL = 64


def fingerprint(text: bytes | None, shingle: int, bits: int) -> bytes:
    """The fingerprint of UTF-8 text; zero where there are no words."""
    words = (text or b"").lower().split()
    width = bits // 8
    if not words:
        return bytes(width)
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(bits, np.int64)
    for at in range(0, n, SLICE):
        part = words[at : at + min(SLICE, n - at) + shingle - 1]
        runs = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64)
        ones += set_bits(h, bits)
    return np.packbits(2 * ones > n).tobytes()


def set_bits(h: np.ndarray, bits: int) -> np.ndarray:
    """How many of the hashes have each bit set, the highest bit first. Beyond 64 bits the hash is mixed anew for each further 64."""
    parts = [h]
    for k in range(1, bits // 64):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        parts.append(x ^ (x >> np.uint64(31)))
    octets = np.stack(parts, 1).astype(">u8").view(np.uint8).reshape(len(h), bits // 8)
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(h), 255):  # so many fit into a byte's sum
        ones += np.unpackbits(octets[at : at + 255], axis=1).sum(0, dtype=np.uint8)
    return ones


def fingerprints(docs: DataFrame, *, shingle: int = 5, bits: int = 64) -> DataFrame:
    """(doc_id, fingerprint): lower-case hex of bits/4 digits."""

    def make():
        def f(cols):
            return {"doc_id": cols["doc_id"], "fingerprint": [fingerprint(t, shingle, bits).hex() for t in cols["text"]]}

        return f

    return in_batches(docs.select("doc_id", "text"), make, "doc_id long, fingerprint string")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, bits: int = 64, blocks: int = 4, same: int = 2, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text); component_id is the smallest doc_id that links reach.

    The fingerprint's hex digits are cut into `blocks` equal blocks. Two fingerprints that differ in at most blocks - same
    bits agree in `same` blocks, so all links of up to that distance are found; a greater distance finds what happens to agree.
    Documents with equal fingerprints become one before the join on blocks.
    Null and empty texts have fingerprint zero. A null doc_id counts for no component_id but gets its component's.
    Repeated rows come out as often as they came in; other columns are ignored.
    """
    each = checkpointed(fingerprints(docs, shingle=shingle, bits=bits))
    distinct = each.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    edges = links(distinct.select("fingerprint"), bits=bits, blocks=blocks, same=same, distance=distance)
    label = components(edges)
    known = distinct.join(label, distinct.fingerprint == label.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    known = checkpointed(known)
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = known.join(roots, "root").select("fingerprint", "component_id")
    return each.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def links(distinct: DataFrame, *, bits: int, blocks: int, same: int, distance: int) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them that whatever links connect stays connected."""
    digits = bits // 4 // blocks
    part = lambda k: F.substring("fingerprint", k * digits + 1, digits)
    keys = [F.concat(F.lit(f"{n}:"), *(part(k) for k in chosen)) for n, chosen in enumerate(combinations(range(blocks), same))]
    rows = distinct.select(F.explode(F.array(*keys)).alias("block"), F.unhex("fingerprint").alias("fp"))
    rows = rows.repartition(shuffle_partitions(distinct.sparkSession), "block").sortWithinPartitions("block")
    arrow = arrow_schema(distinct.sparkSession, "a string, b string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in whole_blocks(batches, bits):
            a, b = linked(*fps, distance)
            if len(a):
                text = lambda rows: [r.astype(">u8").tobytes().hex() for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(text(a)), pa.array(text(b))], schema=arrow)

    return rows.mapInArrow(run, "a string, b string")


def whole_blocks(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole blocks: the number of each row's block, and its fingerprint as 64-bit words. Blocks arrive sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key, last = b.column(0), b.column(0)[-1].as_py()
        if held and held[-1].column(0)[-1].as_py() == last and key[0].as_py() == last:
            held.append(b)
            continue
        cut = b.num_rows
        while cut and key[cut - 1].as_py() == last:
            cut -= 1
        yield from _numbered([*held, b.slice(0, cut)], bits)
        held = [b.slice(cut)]
    yield from _numbered(held, bits)


def _numbered(batches: list[pa.RecordBatch], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    table = pa.Table.from_batches(batches) if batches else None
    if table is not None and table.num_rows > 1:
        number = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        fps = np.frombuffer(b"".join(table.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(-1, bits // 64)
        yield number, fps


def linked(block: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of links that connect what is linked inside each block (rows of a block stand together)."""
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sizes = np.diff(np.r_[starts, len(block)])
    a, b = [], []
    large = np.repeat(sizes > SMALL, sizes)
    for step in range(1, SMALL):
        i = np.flatnonzero((block[:-step] == block[step:]) & ~large[:-step]) if step < len(block) else []
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]).sum(1) <= distance]
        a.append(i)
        b.append(i + step)
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        x, y = balls(fps[s : s + n]) if distance == 2 and fps.shape[1] == 1 and n > 4096 else scans(fps[s : s + n], distance)
        a.append(s + x)
        b.append(s + y)
    if not a:
        return fps[:0], fps[:0]
    a, b = stars(len(fps), np.concatenate(a), np.concatenate(b))
    return fps[a], fps[b]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between n rows: one from the first row of what they connect to each other row of it, instead of all."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(label, before):
            break
    other = np.flatnonzero(label != np.arange(n))
    return label[other], other


def balls(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of up to two bits in a large block: two fingerprints are that close just if some value is within one bit of both.

    Each value's fingerprints are joined to the first of them, so that no pairs of a block are listed. Values are taken in
    as many turns as keep the memory bounded.
    """
    x = fps[:, 0]
    flips = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)]
    turns = np.uint64(len(x) // 50_000 + 1)
    a, b = [], []
    for turn in range(int(turns)):
        near, who = [], []
        for f in flips:
            v = x ^ f
            own = np.flatnonzero((v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % turns == np.uint64(turn))
            near.append(v[own])
            who.append(own)
        near, who = np.concatenate(near), np.concatenate(who)
        order = np.argsort(near, kind="stable")
        near, who = near[order], who[order]
        first = np.maximum.accumulate(np.where(np.r_[True, near[1:] != near[:-1]], np.arange(len(near)), 0))
        own = first != np.arange(len(near))
        pairs = np.unique(np.stack([who[first[own]], who[own]], 1), axis=0)
        a.append(pairs[:, 0])
        b.append(pairs[:, 1])
    return np.concatenate(a), np.concatenate(b)


def scans(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected in a large block, without listing its pairs.

    The row nearest to the bitwise majority is held against all rows, and so is every row that the largest group doesn't
    hold yet: each link between two groups has an end outside the largest.
    """
    n = len(fps)
    wide = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(n, -1), axis=1)
    middle = np.packbits(2 * wide.sum(0, dtype=np.int64) > n).view(">u8").astype(np.uint64)
    order = np.argsort(np.bitwise_count(fps ^ middle).sum(1), kind="stable")
    group = np.arange(n)
    largest = order[0]
    a, b = [], []
    for i in order:
        if i != order[0] and group[i] == group[largest]:
            continue
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]).sum(1) <= distance)
        found = np.unique(group[near])
        if len(found) > 1:
            firsts = near[np.unique(group[near], return_index=True)[1]]
            a.append(np.full(len(firsts), i))
            b.append(firsts)
            to = group[largest] if group[largest] in found else found[0]
            group[np.isin(group, found)] = to
    if not a:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(a), np.concatenate(b)
