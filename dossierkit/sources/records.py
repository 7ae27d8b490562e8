"""Cursor-paged record source as a Python data source.

``spark.read.format("record_pages")`` reads pages of JSON records, each page as
one input partition. A page is a file of JSON lines under ``path``, a folder that
the driver and all executors see under that name (a mounted one, on a cluster;
elsewhere ``spark.read.text`` gives the records as well); the options
``since`` and ``modified`` keep the records modified at or after a bound,
compared as text, and ``fields`` names the fields to keep, or ``scan`` one of the
lists of ``SCANS`` (all fields by default). Over a search server
only ``pages`` and ``records`` differ.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..operators.mapping import LIST_FIELDS, SCALAR_FIELDS

SCHEMA = "id string, modified string, record string"
POLICY = ["deaccessioned", "published"]
#: Fields of a record by the kind of scan; id and time of modification always come besides, and no list means all.
SCANS: dict[str, list[str]] = {
    "light": ["id"],
    "classify": ["artifact", *POLICY],
    "lean": [*SCALAR_FIELDS.values(), "ti", "filename", *LIST_FIELDS.values(), "artifact", *POLICY],
    "full": [],
}


class Page(InputPartition):
    def __init__(self, cursor: str) -> None:
        self.cursor = cursor


def _modified(record: dict, name: str) -> str | None:
    value = record.get(name)
    values = [v for v in value if isinstance(v, str)] if isinstance(value, list) else [value] if isinstance(value, str) else []
    return max(values, default=None)


def pages(path: str) -> list[str]:
    """Cursors of all pages in their order; a repeated or empty cursor ends the list."""
    names = sorted(x for x in os.listdir(path) if x.endswith(".jsonl"))
    return [os.path.join(path, x) for x in names]


def records(cursor: str, since: str | None, modified: str, fields: list[str] | None) -> Iterator[tuple[str | None, str | None, str]]:
    with open(cursor, encoding="utf-8") as f:
        for line in f:
            try:
                record = json.loads(line)
            except ValueError:
                continue
            if not isinstance(record, dict):
                continue
            at = _modified(record, modified)
            if since is not None and (at is None or at < since):
                continue
            if fields:
                record = {k: v for k, v in record.items() if k in {*fields, "id", modified}}
            key = record.get("id")
            yield (key if isinstance(key, str) else None, at, json.dumps(record, ensure_ascii=False))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.since, self.modified = options["path"], options.get("since"), options.get("modified", "ddmudate")
        self.fields = [x for x in options.get("fields", "").split(",") if x] or SCANS[options.get("scan", "full")] or None

    def partitions(self) -> list[Page]:
        return [Page(c) for c in pages(self.path)] or [Page("")]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.cursor:
            yield from records(partition.cursor, self.since, self.modified, self.fields)


class _StreamReader(SimpleDataSourceStreamReader):
    """Pages in order; the offset is the number of pages read, so a page is read once."""

    def __init__(self, options: dict) -> None:
        self.reader = _Reader(options)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = pages(self.reader.path)
        rows = [r for c in found[start["page"] :] for r in records(c, self.reader.since, self.reader.modified, self.reader.fields)]
        return iter(rows), {"page": max(start["page"], len(found))}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for c in pages(self.reader.path)[start["page"] : end["page"]] for r in records(c, self.reader.since, self.reader.modified, self.reader.fields)])

    def commit(self, end: dict) -> None:
        pass


class RecordPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001
        return _StreamReader(self.options)
