"""Pages of providers as a data source: each page that was asked for is a file in a folder, and a reader knows which pages belong to a search.

A search by starts can be read in any order, so its pages are partitions. A search by cursors tells only with a page where the next one is,
so a stream reads it, with the cursor as its offset: a batch has all pages that are there. cursor_no_progress: a page that leads to itself or to the
start; cursor_cycle: one that leads to another page before it. Both end a search.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

PAGE = "search string, position string, body string, sha256 string, error string"
#: Pages of a partition of a stream.
FOLLOWED = 100
#: About as many partitions has a read by starts at most, besides one for each search.
PARTITIONS = 2000


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that tasks open a path in, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def place(search: str, position: str) -> str:
    """Where the page of a search is kept: a folder for the search, a file for its start or cursor."""
    name = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return f"{name(search)}/{name(position)}"


def page(system: fs.FileSystem, folder: str, search: str, position: str) -> tuple:
    """A row of PAGE: page_missing where there is none, page_damaged where it isn't what was written."""
    try:
        with system.open_input_file(f"{folder}/{place(search, position)}") as f:
            stored = json.loads(f.read())
        body, sha = stored["body"], stored["sha256"]
        if (stored["search"], stored["position"]) != (search, position) or hashlib.sha256(body.encode()).hexdigest() != sha:
            return search, position, None, None, "page_damaged"
        return search, position, body, sha, None
    except FileNotFoundError:
        return search, position, None, None, "page_missing"
    except (ValueError, KeyError, TypeError, AttributeError):
        return search, position, None, None, "page_damaged"


@dataclass
class Pages(InputPartition):
    search: str
    starts: range


class ByStart(DataSourceReader):
    """Pages of the searches of option `searches` (JSON: name, total and page size of each), so many in a partition, or more where that made over PARTITIONS."""

    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("pages", 16))
        self.searches = json.loads(options["searches"])

    def partitions(self) -> list[Pages]:
        out, own = [], [(search, range(0, total, size)) for search, total, size in self.searches]
        each = max(self.each, -(-sum(len(starts) for _, starts in own) // PARTITIONS))
        for search, starts in own:
            out += [Pages(search, starts[at : at + each]) for at in range(0, len(starts), each)]
        return out or [Pages("", range(0))]

    def read(self, part: Pages) -> Iterator[tuple]:
        system, folder = located(self.path)
        for start in part.starts:
            yield page(system, folder, part.search, str(start))


@dataclass
class Followed(InputPartition):
    cursor: str | None
    pages: int
    ends: bool


class ByCursor(DataSourceStreamReader):
    """Follows a search from page to page: the offset is the cursor that comes next, or how it ended. A page that isn't there yet is waited for.

    The driver walks through all pages that are there and keeps of each only a digest of its cursor, and the cursors where partitions begin; tasks read the pages again.
    """

    def __init__(self, options: dict):
        self.path, self.search, self.field = options["path"], options["search"], options.get("next", "message.next-cursor")
        self.size, self.items = int(options["page_size"]), options.get("items", "message.items")
        self.at: dict | None = None
        self.marks: list[tuple[int, str]] = []
        self.seen: set[bytes] = set()

    def initialOffset(self) -> dict:
        return {"cursor": "*", "pages": 0}

    def _found(self, value: object, path: str) -> object:
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        return value

    def _next(self, body: str) -> str | None:
        """Where the next page is; None after the last, which is shorter than asked for."""
        value = json.loads(body)
        items, after = self._found(value, self.items), self._found(value, self.field)
        return after if isinstance(items, list) and len(items) >= self.size and isinstance(after, str) else None

    def _walk(self, cursor: str | None) -> Iterator[tuple[str, tuple, str | None]]:
        """Each page from a cursor on that is there: its cursor, its row, and where the next one is."""
        system, folder = located(self.path)
        while cursor is not None:
            row = page(system, folder, self.search, cursor)
            if row[4] == "page_missing":
                break
            after = None if row[4] else self._next(row[2])
            if after == cursor or after == "*":
                row, after = (*row[:4], "cursor_no_progress"), None
            yield cursor, row, after
            cursor = after

    def _met(self, cursor: str) -> bytes:
        return hashlib.sha256(cursor.encode()).digest()[:16]

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        end, n = at["cursor"], at["pages"]
        for cursor, _, after in self._walk(end):
            if n % FOLLOWED == 0:
                self.marks.append((n, cursor))
            self.seen.add(self._met(cursor))
            end, n = after, n + 1
            if after is not None and self._met(after) in self.seen:
                end = None
                break
        self.at = {"cursor": end, "pages": n}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Followed]:
        if self.at is None:  # Spark asks for the last batch first when a stream starts again
            self.at = end
            self.seen = {self._met(cursor) for cursor, _, _ in islice(self._walk("*"), end["pages"])}
        self.marks = [m for m in self.marks if m[0] > start["pages"]]
        cuts = [(start["pages"], start["cursor"]), *(m for m in self.marks if m[0] < end["pages"]), (end["pages"], end["cursor"])]
        return [Followed(cursor, after - n, end["cursor"] is None and after == end["pages"]) for (n, cursor), (after, _) in pairwise(cuts)]

    def read(self, part: Followed) -> Iterator[tuple]:
        for n, (_, row, after) in enumerate(islice(self._walk(part.cursor), part.pages), 1):
            yield (*row[:4], "cursor_cycle") if part.ends and n == part.pages and after is not None else row

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Stored(WriterCommitMessage):
    pages: int


class Store(DataSourceArrowWriter):
    """Writes rows (search, position, body), a file each; one that is written again is replaced, so a task may be run twice."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Stored:
        system, folder = located(self.path)
        n = 0
        for batch in iterator:
            for row in batch.to_pylist():
                name = f"{folder}/{place(row['search'], row['position'])}"
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name) as out:
                    out.write(json.dumps(row | {"sha256": hashlib.sha256(row["body"].encode()).hexdigest()}).encode())
                n += 1
        return Stored(n)


class ProviderPages(DataSource):
    """format("provider_pages"): load(path) with the option searches, or as a stream with search and page_size; save(path)."""

    @classmethod
    def name(cls) -> str:
        return "provider_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> ByStart:
        return ByStart(dict(self.options))

    def streamReader(self, schema) -> ByCursor:
        return ByCursor(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Store:
        return Store(dict(self.options))


def store(pages: DataFrame, path: str) -> None:
    """pages(search, position, body) into a folder that all executors share. Nulls are refused."""
    pages.sparkSession.dataSource.register(ProviderPages)
    pages.select("search", "position", "body").write.format("provider_pages").mode("append").save(path)


def by_start(spark: SparkSession, path: str, searches: list[tuple[str, int, int]], **options: object) -> DataFrame:
    """The pages (PAGE) of searches (name, total, page size), as many as the totals ask for; a missing one is a row with that error."""
    spark.dataSource.register(ProviderPages)
    return spark.read.format("provider_pages").options(searches=json.dumps(searches), **options).load(path)


def by_cursor(spark: SparkSession, path: str, search: str, page_size: int, **options: object) -> DataFrame:
    """The pages of a search as a stream that follows its cursors, from the first or from where its checkpoint says."""
    spark.dataSource.register(ProviderPages)
    return spark.readStream.format("provider_pages").options(search=search, page_size=page_size, **options).load(path)


