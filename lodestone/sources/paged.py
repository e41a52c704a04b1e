"""Paged sources as a Spark data source: batch and stream, a partition a page, the cursor as the offset.

A source is two functions. `advance(cursor, page)` tells the cursor behind a page, null behind the
last; it is asked on the driver and moves no rows. `fetch(cursor, page)` gives the rows of
a page, in the task that reads it. A stream's offset is the page and cursor to go on
from, with a fingerprint of the request that leaves its cursor out: a checkpoint goes on
after the last page of the last whole batch, refuses another request, and asks nothing once
the last page was read. A batch that is run again reads the same pages.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Fetch = Callable[[dict, str | None, int], Iterable[tuple]]
Advance = Callable[[dict, str | None, int], str | None]


def fingerprint(request: dict) -> str:
    """sha256 of a request without its cursor and without what bounds a run."""
    kept = {k: v for k, v in request.items() if k not in ("cursor", "pages")}
    return "sha256:" + hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Page(InputPartition):
    def __init__(self, cursor: str | None, page: int):
        super().__init__((cursor, page))


def _walk(advance: Advance, request: dict, cursor: str | None, page: int, most: int) -> Iterator[tuple[str | None, int, str | None]]:
    """(cursor, page, next cursor) of up to `most` pages."""
    while most > 0:
        following = advance(request, cursor, page)
        yield cursor, page, following
        if not following:
            return
        cursor, page, most = following, page + 1, most - 1


class _Reader(DataSourceReader):
    def __init__(self, request: dict, advance: Advance, fetch: Fetch):
        self.request, self.advance, self.fetch = request, advance, fetch

    def partitions(self) -> list[Page]:
        most = int(self.request.get("pages", 1 << 31))
        return [Page(c, p) for c, p, _ in _walk(self.advance, self.request, self.request.get("cursor"), 0, most)]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.fetch(self.request, *partition.value)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, request: dict, advance: Advance, fetch: Fetch):
        self.request, self.advance, self.fetch = request, advance, fetch
        self.at: dict | None = None
        self.known: dict[int, tuple[str | None, str | None]] = {}

    def initialOffset(self) -> dict:
        return {"request": fingerprint(self.request), "page": 0, "cursor": self.request.get("cursor"), "done": False}

    def _checked(self, offset: dict) -> dict:
        if offset["request"] != fingerprint(self.request):
            raise ValueError("the checkpoint belongs to another request")
        return offset

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        if at["done"]:
            return at
        for cursor, page, following in _walk(self.advance, self.request, at["cursor"], at["page"], int(self.request.get("pages", 1))):
            self.known[page] = (cursor, following)
            at = {**at, "page": page + 1, "cursor": following, "done": not following}
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self._checked(start), self._checked(end)
        if self.at is None or self.at["page"] < end["page"]:
            self.at = end  # a run that goes on from a checkpoint
        out, cursor = [], start["cursor"]
        for page in range(start["page"], end["page"]):
            if self.known.get(page, (object(),))[0] != cursor:
                self.known[page] = (cursor, self.advance(self.request, cursor, page) if page + 1 < end["page"] else end["cursor"])
            out.append(Page(cursor, page))
            cursor = self.known[page][1]
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.fetch(self.request, *partition.value)

    def commit(self, end: dict) -> None:
        self.known = {p: c for p, c in self.known.items() if p >= end["page"]}


def paged_source(name: str, rows: str, advance: Advance, fetch: Fetch) -> type[DataSource]:
    """A data source to register: its options are the request; `pages` bounds the pages of a batch."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return rows

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), advance, fetch)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(dict(self.options), advance, fetch)

    return Paged
