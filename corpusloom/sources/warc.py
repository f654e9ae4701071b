"""Web archives: WARC and WET files, gzipped or plain, as a stream of records."""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import place

#: Columns, and the header that each is from; file, length and content are the record's own.
HEADERS = {
    "type": "warc-type", "url": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "block_digest": "warc-block-digest",
    "language": "warc-identified-content-language",
}
SCHEMA = "file string, " + ", ".join(f"{c} string" for c in HEADERS) + ", length long, content string"
_BLOCK, _MEMBER = 1 << 20, b"\x1f\x8b\x08"
#: Bytes of records in a batch of rows.
_BATCH = 8 << 20


class CutRecord(ValueError):
    """A file ends within a record."""


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class Warc(DataSource):
    """`warc`: a row a record of the .warc, .wet and .gz files of a folder (option path). Gzipped files are read in ranges of
    rangeBytes (64 MB): a range has the members that begin in it, and what their last record needs of later ones. Other files
    are a partition each. One record is held at a time, besides a batch of rows.

    language: only records that name it, alone or in a list. cut: `raise` (the default) for a file that ends within a record, or `skip`."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        o = self.options
        return _Reader(o["path"], o.get("language"), int(o.get("rangeBytes", 64 << 20)), o.get("cut", "raise"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, language: str | None, size: int, cut: str):
        self.path, self.language, self.size, self.cut = path, language, size, cut

    def partitions(self):
        from pyarrow import fs

        where, root = place(self.path)
        found = [i for i in where.get_file_info(fs.FileSelector(root, recursive=True)) if i.base_name.endswith((".warc", ".wet", ".gz"))]
        steps = lambda i: range(0, max(i.size, 1), self.size) if i.base_name.endswith(".gz") else [0]
        return [_Range(i.path, lo, lo + self.size if i.base_name.endswith(".gz") else i.size) for i in found for lo in steps(i)] or [_Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        with place(self.path)[0].open_input_file(partition.path) as f:
            pieces = Members(f, partition.first, partition.last) if partition.path.endswith(".gz") else iter(lambda: f.read(_BLOCK), b"")
            held, size = [], 0
            for headers, body in self._records(pieces, partition.path):
                if self.language and self.language not in headers.get("warc-identified-content-language", "").replace(" ", "").split(","):
                    continue
                held.append((partition.path, *(headers.get(h) for h in HEADERS.values()), len(body), body.decode("utf-8", "replace")))
                size += len(body)
                if size > _BATCH:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    def _records(self, pieces, path: str):
        try:
            yield from records(pieces)
        except CutRecord as e:
            if self.cut != "skip":
                raise CutRecord(f"{path} ends within a record") from e


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["file", *HEADERS, "length", "content"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "length" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


class Members:
    """The bytes of the gzip members of a file that begin in a range, in pieces, and of later ones for as long as they are asked for.
    `spent` tells that the next member is behind the range."""

    def __init__(self, f, first: int, last: int):
        self.f, self.last, self.at = f, last, self._first(f, first, last)
        self.inflate, self.raw = None, b""
        f.seek(self.at)

    @staticmethod
    def _first(f, first: int, last: int) -> int:
        """Where the first member that holds the beginning of a record begins; `last` if none does."""
        at, tail = first, b""
        while first and at < last + len(_MEMBER):
            f.seek(at)
            block = f.read(_BLOCK)
            if not block:
                return last
            found = (tail + block).find(_MEMBER)
            while found >= 0:
                place_ = at - len(tail) + found
                f.seek(place_)
                try:
                    if zlib.decompressobj(31).decompress(f.read(1 << 12), 16).startswith(b"WARC/"):
                        return place_
                except zlib.error:
                    pass
                found = (tail + block).find(_MEMBER, found + 1)
            at, tail = at + len(block), (tail + block)[-len(_MEMBER) + 1 :]
        return first if not first else last

    @property
    def spent(self) -> bool:
        return self.inflate is None and self.at >= self.last

    def __iter__(self):
        return self

    def __next__(self) -> bytes:
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.f.read(_BLOCK)
            if not self.raw:
                raise StopIteration
        before = len(self.raw)
        out = self.inflate.decompress(self.raw)
        self.raw = self.inflate.unused_data
        self.at += before - len(self.raw)
        if self.inflate.eof:
            self.inflate = None
        return out


def records(pieces):
    """(headers with lower-cased names, body) of each record; a CutRecord where the pieces end within one. Pieces that can be `spent`
    aren't asked for more once they are, between two records."""
    held, spent, pieces = bytearray(), lambda: getattr(pieces, "spent", False), iter(pieces)

    def upto(n: int) -> bool:
        while len(held) < n:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while held[:1] in (b"\r", b"\n"):
            del held[:1]
        if not held and (spent() or not upto(1)):
            return
        if held[:1] in (b"\r", b"\n"):
            continue
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not upto(len(held) + 1):
                if bytes(held).strip():
                    raise CutRecord("within headers")
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").strip().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length", 0))
        if not upto(end + 4 + size):
            raise CutRecord("within a body")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def write(rows: DataFrame, path: str, url: str = "url", content: str = "content", language: str | None = None) -> None:
    """One gzipped WET file a task, a member a record, under a name that only a finished task leaves. `language`: a column."""

    def run(batches):
        where, root = place(path)
        where.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.warc.wet.gz"
        with where.open_output_stream(name + ".part", compression=None) as f:
            for b in batches:
                for u, t, *lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    body = (t or "").encode()
                    told = f"WARC-Identified-Content-Language: {lang[0]}\r\n" if lang and lang[0] else ""
                    head = f"WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: {u}\r\n{told}Content-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    f.write(pack.compress(head + body + b"\r\n\r\n") + pack.flush())
        where.move(name + ".part", name)
        yield pa.RecordBatch.from_pydict({"file": [name]})

    rows.select(url, content, *([language] if language else [])).mapInArrow(run, "file string").collect()  # names of files


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
