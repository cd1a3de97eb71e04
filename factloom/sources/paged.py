"""Paged REST source as a Python data source.

Every query is one partition and pages are followed inside its task, with bounded retries. The fetcher is named as
``module:function`` and takes ``(query, token, page_size)``; it returns ``(body, next_token)``. Tests give one that reads files.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_PAGE_SIZE = 100
MAX_GET_LENGTH = 1800


def retry(call: Callable[[], object], attempts: int = 3, base_delay: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """Result and number of attempts; waits ``base_delay * 2**(n-1)`` after failure ``n`` and raises the last error."""
    if attempts < 1:
        raise ValueError("attempts must be positive")
    for n in range(1, attempts + 1):
        try:
            return call(), n
        except Exception:
            if n == attempts:
                raise
            sleep(base_delay * 2 ** (n - 1))


def http_fetch(query: str, token: str | None, page_size: int) -> tuple[str, str | None]:
    """Default fetcher: ``query`` is a URL. Long queries go as POST."""
    url, _, params = query.partition("?")
    extra = {"pageSize": str(page_size), **({"pageToken": token} if token else {})}
    data = "&".join(p for p in (params, urllib.parse.urlencode(extra)) if p)
    request = urllib.request.Request(url, data=data.encode()) if len(data) > MAX_GET_LENGTH else urllib.request.Request(f"{url}?{data}")
    with urllib.request.urlopen(request, timeout=60) as response:
        body = response.read().decode("utf-8", errors="replace")
    return body, json.loads(body).get("nextPageToken")


class QueryPartition(InputPartition):
    def __init__(self, query: str):
        super().__init__(query)
        self.query = query


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.queries = json.loads(options["queries"])
        self.fetcher = options.get("fetcher", "factloom.sources.paged:http_fetch")
        self.page_size = min(int(options.get("pagesize", MAX_PAGE_SIZE)), MAX_PAGE_SIZE)
        self.max_pages = int(options["maxpages"]) if "maxpages" in options else None
        self.attempts, self.delay = int(options.get("attempts", 3)), float(options.get("basedelay", 1.0))

    def partitions(self) -> list[InputPartition]:
        return [QueryPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        token, page = None, 0
        while True:
            (body, following), used = retry(lambda t=token: fetch(partition.query, t, self.page_size), self.attempts, self.delay)
            page += 1
            last = not following or (self.max_pages is not None and page >= self.max_pages)
            yield partition.query, page, body, used, bool(last and following)
            if last:
                return
            token = following


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged").option("queries", json)``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "query string, page int, body string, attempts int, truncated boolean"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


# ---------------------------------------------------------------- query texts


def registry_query(names: list[str]) -> str:
    """Names joined by OR, each in quotes."""
    return " OR ".join(f'"{n}"' for n in names)


# Terms of the literature search.
TARGET_TERMS = ("HER2", "ERBB2", "TROP2", "TROP-2", "TACSTD2")
CONCEPT = ('"antibody-drug conjugate"[Title/Abstract] OR "antibody drug conjugate"[Title/Abstract] OR ADC[Title/Abstract]')


def literature_query(names: list[str]) -> str:
    """Papers on the concept together with a target or a name, or on a name alone."""
    field = lambda words: " OR ".join(f'"{w}"[Title/Abstract]' for w in words)
    by_name = field(dict.fromkeys(n.strip() for n in names if n.strip()))
    return f"(({CONCEPT}) AND (({field(TARGET_TERMS)}) OR ({by_name}))) OR ({by_name})"


def batches(ids: list[str], size: int = 100) -> list[list[str]]:
    return [ids[i:i + size] for i in range(0, len(ids), size)]
