"""Record source over HTTP: a search server with cursor marks.

``spark.read.format("record_server")`` asks ``url`` for pages of records sorted
by id and follows the cursor until it repeats, is empty, or a page is. The
option ``slices`` names id boundaries ("g,p"): each slice is read by a task of
its own with its own cursor, since one cursor can only be followed in sequence.

The option ``scan`` says what a record holds: ``lean`` (the default) every field
that the mapping reads, but not the source's own full text, which is most of a
record; ``light`` the id and the time of modification; ``classify`` these, the
artifacts and the policy flags; ``full`` everything. ``fields`` names them instead.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .records import SCANS, SCHEMA, _modified


class Slice(InputPartition):
    def __init__(self, low: str | None, high: str | None) -> None:
        self.low, self.high = low, high


def fetch(url: str, params: dict[str, object], timeout: float = 60) -> dict:
    """One answer; every kind of failure becomes a RuntimeError that names the address and the cause."""
    address = f"{url}?{urllib.parse.urlencode(params, doseq=True)}"
    try:
        with urllib.request.urlopen(address, timeout=timeout) as answer:  # noqa: S310
            body = json.loads(answer.read().decode("utf-8"))
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"{url}: HTTP {e.code}: {e.read()[:200].decode(errors='replace')}") from None
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        raise RuntimeError(f"{url}: {e}") from None
    except ValueError as e:
        raise RuntimeError(f"{url}: the answer is no JSON: {e}") from None
    if not isinstance(body, dict):
        raise RuntimeError(f"{url}: the answer is no object")
    return body


def scan(url: str, size: int, since: str | None, modified: str, fields: list[str], low: str | None = None, high: str | None = None) -> Iterator[dict]:
    """Records of all pages in the order of their ids."""
    filters = [f"{modified}:[{since} TO *]"] if since is not None else []
    if low is not None or high is not None:
        filters.append(f"id:[{low or '*'} TO {high or '*'}" + ("}" if high else "]"))
    cursor = "*"
    while True:
        params: dict[str, object] = {"q": "*:*", "sort": "id asc", "rows": size, "cursorMark": cursor, "wt": "json"}
        if filters:
            params["fq"] = filters
        if fields:
            params["fl"] = ",".join(dict.fromkeys([*fields, "id", modified]))
        body = fetch(url, params)
        docs = (body.get("response") or {}).get("docs") or []
        yield from (d for d in docs if isinstance(d, dict))
        after = body.get("nextCursorMark")
        if not docs or not after or after == cursor:
            return
        cursor = after


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.size = options["url"], int(options.get("pagesize", options.get("pageSize", 1000)))
        self.since, self.modified = options.get("since"), options.get("modified", "ddmudate")
        self.fields = [x for x in options.get("fields", "").split(",") if x] or SCANS[options.get("scan", "lean")]
        self.bounds = [x for x in options.get("slices", "").split(",") if x]

    def partitions(self) -> list[Slice]:
        return [Slice(a, b) for a, b in zip([None, *self.bounds], [*self.bounds, None], strict=True)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for record in scan(self.url, self.size, self.since, self.modified, self.fields, partition.low, partition.high):
            key = record.get("id")
            yield (key if isinstance(key, str) else None, _modified(record, self.modified), json.dumps(record, ensure_ascii=False))


class RecordServer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_server"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)
