"""Vector code compression: vectors become one byte for each part, by codebooks that Lloyd's rounds fit and Yinyang bounds speed up.

Each task keeps, with a vector, the entry of every part and one lower bound for each group of entries: no other entry of
the group is nearer than that. After the entries have moved, a bound shrinks by the farthest move in its group, and only the groups whose
bound doesn't exceed the distance to the vector's own entry are looked at again. The result is that of Lloyd's rounds over all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import arrow_schema, quoted, written

#: Relative error that floating-point distances are trusted to; what lies closer together is compared in integers.
SLACK = 1e-9
#: Entries of a group, on average; and Lloyd's rounds that form the groups.
GROUP, GROUP_ROUNDS = 16, 5
#: Bits of a sum that a row carries, so that sums of any size add up in longs.
LIMB = 48


@dataclass
class Book:
    """The codebook of one part: entries as Python integers, and for each group the numbers of its entries and how far they moved."""

    entries: list[list[int]]
    groups: list[np.ndarray]
    drift: np.ndarray | None = None
    points: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.points = np.array(self.entries, np.float64).reshape(len(self.entries), -1)

    def moved_to(self, entries: list[list[int]]) -> Book:
        new = Book(entries, self.groups)
        far = np.sqrt(((new.points - self.points) ** 2).sum(1)) * (1 + SLACK)
        new.drift = np.array([far[g].max() for g in self.groups])
        return new


@dataclass
class Compressed:
    """rows: (id, carried columns, code, error); books: the final codebook of each part; scanned: for each assignment the share of distances computed."""

    rows: DataFrame
    books: list[Book]
    scanned: list[float]

    def sha256(self) -> str:
        numbers = (str(x) for b in self.books for e in b.entries for x in e)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def grouped(points: np.ndarray) -> list[np.ndarray]:
    """Entries in groups of near ones: farthest-first seeds, then a few of Lloyd's rounds. Always the same for the same entries."""
    n = max(1, len(points) // GROUP)
    seeds, away = [0], ((points - points[0]) ** 2).sum(1)
    while len(seeds) < n and away.max() > 0:
        seeds.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[seeds[-1]]) ** 2).sum(1))
    middle = points[seeds]
    for _ in range(GROUP_ROUNDS):
        of = ((points[:, None] - middle) ** 2).sum(2).argmin(1)
        middle = np.array([points[of == g].mean(0) if (of == g).any() else middle[g] for g in range(len(middle))])
    return [np.flatnonzero(of == g) for g in range(len(middle)) if (of == g).any()]


def squared(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of rows from points. Integers whose squares stay below 2^53 give exact ones by a matrix product."""
    most = max(np.abs(x).max(initial=0), np.abs(points).max(initial=0))
    if 4 * most * most * max(1, x.shape[1]) < 2**53:
        return (x * x).sum(1)[:, None] - 2 * (x @ points.T) + (points * points).sum(1)
    return ((x[:, None] - points) ** 2).sum(2)


def integers(x: np.ndarray, most: float) -> np.ndarray:
    """As 64-bit integers if squared distances fit into them, else as Python's."""
    if 4 * most * most * max(1, x.shape[-1]) < 2**63:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def verified(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries and their squared distances, in integers; ties go to the lower number."""
    most = max(np.abs(x).max(initial=0), np.abs(book.points).max(initial=0))
    entries = integers(book.points, most) if most < 2**53 else np.array(book.entries, object).reshape(book.points.shape)
    nearest, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for i, row in enumerate(integers(x, most)):
        d = ((entries - row) ** 2).sum(1)
        nearest[i] = d.argmin()
        distance[i] = int(d[nearest[i]])
    return nearest, distance


def scan(x: np.ndarray, book: Book, assigned: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entries, lower bounds, distances computed) of rows that had `assigned` and the bounds before the entries' last move."""
    n, groups = len(x), book.groups
    of_group = np.zeros(len(book.entries), np.int64)
    for g, members in enumerate(groups):
        of_group[members] = g
    if assigned is None:
        best, index, lower, computed = np.full(n, np.inf), np.full(n, -1), np.zeros((n, len(groups))), 0
    else:
        best, index, computed = ((x - book.points[assigned]) ** 2).sum(1), assigned.astype(np.int64), n
        lower = np.maximum(lower - book.drift, 0)
    before, own = index.copy(), best.copy()
    tied = np.zeros(n, bool)
    least, second, at = (np.full((n, len(groups)), v) for v in (np.nan, np.nan, -1))
    for g, members in enumerate(groups):
        rows = np.flatnonzero(lower[:, g] <= np.sqrt(best) * (1 + SLACK))
        if not len(rows):
            continue
        d = squared(x[rows], book.points[members])
        computed += d.size
        j = d.argmin(1)
        first, others = d[np.arange(len(rows)), j], d.copy()
        others[np.arange(len(rows)), j] = np.inf
        least[rows, g], second[rows, g], at[rows, g] = first, others.min(1), members[j]
        # rows whose best two entries, in this group or in two groups, are too close to tell apart
        tied[rows[first < best[rows] * (1 - SLACK)]] = False
        rival = (best[rows] <= first * (1 + SLACK)) & (members[j] != index[rows])
        tied[rows] |= (first <= best[rows] * (1 + SLACK)) & (rival | (others.min(1) <= first * (1 + SLACK)))
        nearer = first < best[rows]
        best[rows[nearer]], index[rows[nearer]] = first[nearer], members[j[nearer]]
    if tied.any():
        index[tied] = verified(x[tied], book)[0]
    seen = ~np.isnan(least)
    kept = np.where(at == index[:, None], second, least)
    lower = np.where(seen, np.sqrt(np.maximum(kept, 0)) * (1 - SLACK), lower)
    if assigned is not None:  # an entry that was left counts among the others of its group
        left = np.flatnonzero(before != index)
        g = of_group[before[left]]
        lower[left, g] = np.minimum(lower[left, g], np.sqrt(own[left]) * (1 - SLACK))
    return index, lower, computed


def packed(lower: np.ndarray) -> np.ndarray:
    """Bounds in two bytes each, rounded down: the upper half of a 32-bit float."""
    return (np.minimum(lower, 1e38).astype(np.float32) * np.float32(1 - 1e-6)).view(np.uint32).__rshift__(16).astype(np.uint16)


def unpacked(data: np.ndarray) -> np.ndarray:
    return (data.astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def cuts(width: int, parts: int) -> list[slice]:
    return [slice(p * width // parts, (p + 1) * width // parts) for p in range(parts)]


def number_type(books: list[Book]) -> type:
    """What holds the number of an entry."""
    return np.uint8 if max(len(b.entries) for b in books) <= 256 else np.uint16


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width)


def assigned_rows(rows: DataFrame, books: list[Book], width: int, carry: list[str], schema: str, *, scale: float | None, bounds: bool) -> DataFrame:
    """rows with components (scaled, the first time), entry numbers and bounds, or codes and errors where no further round follows."""
    parts, arrow = cuts(width, len(books)), arrow_schema(rows.sparkSession, schema)
    sizes = [len(b.groups) for b in books]
    at, number = np.cumsum([0, *sizes]), number_type(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = matrix(b.column("components"), width)
            if scale is not None:
                x = np.floor(x * scale)
            old = np.frombuffer(b"".join(b.column("entries").to_pylist()), number).reshape(n, -1) if "entries" in b.schema.names else None
            lows = unpacked(np.frombuffer(b"".join(b.column("lower").to_pylist()), np.uint16)).reshape(n, -1) if old is not None else None
            index, lower, computed = np.zeros((n, len(books)), np.int64), [], 0
            for p, book in enumerate(books):
                own = lows[:, at[p] : at[p + 1]] if lows is not None else None
                index[:, p], low, more = scan(x[:, parts[p]], book, None if old is None else old[:, p], own)
                lower.append(low)
                computed += more
            out = {c: b.column(c) for c in carry}
            work = np.zeros(n, np.int64)
            work[0] = computed
            out["entries"] = pa.array([r.tobytes() for r in index.astype(number)])
            if bounds:
                lower = packed(np.hstack(lower))
                out["components"] = pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, np.int32), x.ravel())
                out["lower"] = pa.array([r.tobytes() for r in lower])
            else:
                out["error"] = pa.array(errors(x, books, parts, index))
            out["computed"] = pa.array(work)
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


def errors(x: np.ndarray, books: list[Book], parts: list[slice], index: np.ndarray) -> list[int | None]:
    """Squared distances to the entries, summed over parts, in integers; None where a long can't hold it."""
    total = np.zeros(len(x), object)
    for p, book in enumerate(books):
        own = x[:, parts[p]]
        most = max(np.abs(own).max(initial=0), np.abs(book.points).max(initial=0))
        entries = integers(book.points, most) if most < 2**53 else np.array(book.entries, object).reshape(book.points.shape)
        total += ((integers(own, most) - entries[index[:, p]]) ** 2).sum(1).astype(object)
    return [int(v) if v < 2**63 else None for v in total]


def sums(rows: DataFrame, books: list[Book], width: int) -> dict[tuple[int, int], list[int]]:
    """For each part and entry in use, the number of its vectors, then the sum of each component. What reaches the driver is as large as the codebooks."""
    parts, number = cuts(width, len(books)), number_type(books)
    schema = "part int, entry int, limb int, sums array<long>"
    arrow = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b.entries), 1 + s.stop - s.start), np.int64) for b, s in zip(books, parts, strict=True)]
        held = 0.0  # no sum is larger
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("components"), width)
            index = np.frombuffer(b"".join(b.column("entries").to_pylist()), number).reshape(len(x), -1)
            held += len(x) * max(1.0, np.abs(x).max(initial=0))
            if held >= 2**62 and total[0].dtype != object:
                total = [t.astype(object) for t in total]
            exact = x.astype(np.int64) if total[0].dtype != object else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
            for p, s in enumerate(parts):
                np.add.at(total[p], index[:, p], np.hstack([np.ones((len(x), 1), exact.dtype), exact[:, s]]))
        for p, t in enumerate(total):
            used = [e for e in range(len(t)) if t[e, 0]]
            left, limb = [[int(v) for v in t[e]] for e in used], 0
            while left and any(v for row in left for v in row):
                low = [[v if -(2**LIMB) < v < 2**LIMB else v & (2**LIMB - 1) for v in row] for row in left]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([p] * len(used), used, [limb] * len(used), low), arrow, strict=True)], schema=arrow)
                left, limb = [[(v - w) >> LIMB for v, w in zip(a, b, strict=True)] for a, b in zip(left, low, strict=True)], limb + 1

    each = rows.select("components", "entries").mapInArrow(run, schema)
    added = each.select("part", "entry", "limb", F.posexplode("sums").alias("place", "v")).groupBy("part", "entry", "limb", "place").agg(F.sum("v").alias("v"))
    found: dict[tuple[int, int], list[int]] = {}
    for r in added.collect():
        own = found.setdefault((r.part, r.entry), [0] * (1 + parts[r.part].stop - parts[r.part].start))
        own[r.place] += r.v << (LIMB * r.limb)
    return found


def kept(vector: Column, scale: float) -> Column:
    """Whether a vector is one: not null, without a null, and finite when scaled."""
    there = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(there, F.lit(False))


def compress(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = (), parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024) -> Compressed:
    """Codes of all vectors and the codebooks behind them.

    Components become floor(scale * x). A vector is cut into `parts` of equal width (the first narrower where that doesn't divide). A codebook
    starts as that part of the `entries` smallest ids, ascending; null ids come last, equal ones by their vectors. Each round gives every
    part to its nearest entry, ties to the lower number, and moves entries to the floor of their parts' mean; unused ones stay. All sums and
    ties are settled in integers of any size.

    rows: id, carried columns, code (binary, a byte for each part, or two in native order beyond 256 entries) and error (null where it exceeds a long).
    Null vectors and those with a null or non-finite component are left out. The vector of the smallest id fixes the width; others of another width
    can't be coded: their code and error are null. Vectors without components get code 0. Fewer vectors than entries make smaller
    codebooks; no vectors, no rows and no books. Repeated rows stay. Other columns are ignored, whatever they are called.
    """
    if not 1 <= entries <= 1 << 16:
        raise ValueError("a codebook has 1 to 65,536 entries")
    own = [quoted(c) for c in (id, *carry)]
    source = vectors.where(kept(F.col(quoted(vector)), scale))
    picked = source.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(own)), F.col(quoted(vector)).alias("components"))
    names = [f"c{i}" for i in range(len(own))]
    kinds = ", ".join(f"{n} {picked.schema[n].dataType.simpleString()}" for n in names)
    named = lambda df: df.select(*(F.col(n).alias(c) for n, c in zip(names, (id, *carry), strict=True)), "code", "error")
    smallest = lambda rows: [r.components for r in rows.orderBy(F.col("c0").asc_nulls_last(), "components").limit(entries).collect()]  # noqa: E731  as many as a codebook has
    first = smallest(picked)
    if not first:
        return Compressed(named(picked.select(*names, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))), [], [])
    width = len(first[0])
    fits = F.size("components") == width
    if any(len(v) != width for v in first):
        first = smallest(picked.where(fits))
    start = np.floor(np.array(first, np.float64).reshape(-1, width) * scale)
    books = []
    for s in cuts(width, parts):
        books.append(Book([[int(v) for v in row] for row in start[:, s]], grouped(start[:, s])))
    state, scanned = picked.where(fits), []
    for n in range(rounds + 1):
        final = n == rounds
        schema = f"{kinds}, " + ("entries binary, error long, computed long" if final else "components array<double>, entries binary, lower binary, computed long")
        state = written(assigned_rows(state, books, width, names, schema, scale=None if n else scale, bounds=not final))
        count, work = state.agg(F.count("*"), F.sum("computed")).first()
        scanned.append((work or 0) / max(1, count * sum(len(b.entries) for b in books)))
        if not final:
            found = sums(state, books, width)
            books = [b.moved_to([[v // own[0] for v in own[1:]] if (own := found.get((p, e))) else old for e, old in enumerate(b.entries)]) for p, b in enumerate(books)]
    coded = state.select(*names, F.col("entries").alias("code"), "error")
    odd = picked.where(~fits).select(*names, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return Compressed(named(coded.unionByName(odd)), books, scanned)


def with_group_error(rows: DataFrame, group: str) -> DataFrame:
    """rows(error, group) with the group's sum of errors as group_error; null groups are one. Errors are added up before they are shuffled."""
    each = rows.groupBy(F.col(quoted(group)).alias("_of")).agg(F.sum("error").alias("group_error"))
    return rows.join(each, F.col(quoted(group)).eqNullSafe(F.col("_of")), "left").drop("_of")
