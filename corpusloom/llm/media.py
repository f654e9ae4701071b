"""Media columns: payloads become lossless images in ZIP archives; a Spark data source reads them back by byte ranges.

`store` writes one archive or more per task to a shared folder and a manifest of the archives that count (attempts that
died leave orphans that no manifest names). The data source `archive_members` plans partitions as byte ranges of
archives from the manifest, reads each archive's central directory, and yields the members whose headers begin in its
range as Arrow batches; a member that can't be read or fails its checksum is retried alone, by its offset.

The stored form is a greyscale PNG of 8-bit samples, 576 to a row."""

from __future__ import annotations

import hashlib
import io
import struct
import sys
import time
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import fresh_dir

ROW = 576
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> bytes:
    """UTF-8, filled with bytes 255 up to a positive multiple of ROW."""
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % ROW or (0 if raw else ROW))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    rows = np.zeros((len(samples) // ROW, ROW + 1), np.uint8)  # each row's first byte: no filter
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """Samples of an image as to_png() makes them; raises ValueError for anything else or a broken checksum."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at + 12 <= len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[0] != ROW or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of 8-bit grey samples")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of which cells of an 8 x 8 grid exceed their mean."""
    a = np.frombuffer(samples, np.uint8)
    share = np.bincount(a, minlength=256) / len(a)
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    cells = np.add.reduceat(a.astype(np.int64), np.arange(64) * len(a) // 64) / np.diff(np.append(np.arange(64) * len(a) // 64, len(a)))
    bits = int("".join("1" if x else "0" for x in cells > cells.mean()), 2)
    return f"{a.mean():.4f}:{a.std():.4f}:{entropy:.4f}:{bits:016x}"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def store(docs: DataFrame, id_column: str = "doc_id", text: str = "text", archive_bytes: int = 64 << 20) -> str:
    """Write all payloads as members `<id>.png` of archives of about archive_bytes; gives the folder with the manifest.

    Null and empty texts are one row of fill; repeated ids are members of their own; memory holds one archive."""
    folder = fresh_dir(docs.sparkSession, "media")

    def write(batches):
        where, root = _place(folder)
        where.create_dir(f"{root}/archives", recursive=True)
        buffer, archive, members = None, None, 0

        def close():
            archive.close()
            name = f"archives/{uuid.uuid4().hex}.zip"
            with where.open_output_stream(f"{root}/{name}") as f:
                f.write(buffer.getbuffer())
            return pa.RecordBatch.from_pydict({"archive": [name], "bytes": [buffer.getbuffer().nbytes], "members": [members]})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if archive is None:
                    buffer, members = io.BytesIO(), 0
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                raw = (t or "").encode()
                info = zipfile.ZipInfo("null.png" if i is None else f"{i}.png")
                info.comment = str(len(raw)).encode()  # unpadded bytes
                archive.writestr(info, to_png(payload(t)))
                members += 1
                if buffer.tell() >= archive_bytes:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    rows = docs.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(write, "archive string, bytes long, members long")
    rows.write.parquet(f"{folder}/manifest")
    return folder


class Ranges(InputPartition):
    """Byte ranges (archive, start, end); a member belongs to the range that it begins in."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class ArchiveMembers(DataSource):
    """Options: path (a folder from store()), range_bytes, retries, most_partitions.

    A partition is a byte range of an archive, or, where there would be over most_partitions of these, several ranges, whole
    archives as far as they fit; the driver plans with the archives' names and sizes, as for any source of files."""

    @classmethod
    def name(cls):
        return "archive_members"

    def schema(self):
        return "id long, n_bytes long, media binary, archive string, member_offset long"

    def reader(self, schema):
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.retries = int(options.get("retries", 3))
        self.most_partitions = int(options.get("most_partitions", 50_000))

    def partitions(self):
        where, root = _place(self.folder)
        archives = []
        for info in where.get_file_info(fs.FileSelector(f"{root}/manifest")):
            if info.base_name.endswith(".parquet"):
                with where.open_input_file(info.path) as f:
                    archives += [(r["archive"], r["bytes"]) for r in pq.read_table(f, columns=["archive", "bytes"]).to_pylist()]
        step = max(self.range_bytes, -(-sum(n for _, n in archives) // self.most_partitions))
        out, room = [], 0
        for name, size in archives:
            for at in range(0, size, step):
                end = min(at + step, size)
                if step == self.range_bytes or end - at > room:
                    out.append([])
                    room = step
                out[-1].append((name, at, end))
                room -= end - at
        return [Ranges(x) for x in out] or [Ranges([])]

    def member(self, where, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset, checked; each try opens the archive anew."""
        for left in range(self.retries, -1, -1):
            try:
                with where.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member at this offset")
                    names, extra = struct.unpack("<HH", head[26:30])
                    f.seek(info.header_offset + 30 + names + extra)
                    body = f.read(info.compress_size)
                if len(body) != info.file_size or zlib.crc32(body) != info.CRC:
                    raise ValueError("checksum of a member")
                return body
            except (OSError, ValueError):
                if not left:
                    raise
                time.sleep(0.05 * (self.retries - left + 1))
        raise AssertionError

    def read(self, partition):
        where, root = _place(self.folder)
        rows, size = [], 0
        for archive, start, end in partition.ranges:
            path = f"{root}/{archive}"
            with where.open_input_file(path) as f:
                infos = [x for x in zipfile.ZipFile(f).infolist() if start <= x.header_offset < end]
            for x in infos:
                body = self.member(where, path, x)
                name = x.filename.removesuffix(".png")
                rows.append((None if name == "null" else int(name), int(x.comment), body, archive, x.header_offset))
                size += len(body)
                if size >= 4 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_bytes", "media", "archive", "member_offset"])


def read(spark: SparkSession, folder: str, range_bytes: int = 16 << 20, retries: int = 3) -> DataFrame:
    """The stored members: id, n_bytes, media, archive, member_offset."""
    # The source's classes go to the workers by value: those that plan it get no path from the session.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.dataSource.register(ArchiveMembers)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    return spark.read.format("archive_members").option("range_bytes", range_bytes).option("retries", retries).load(folder)


def describe(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored members.

    Null and empty texts have been stored as one row of fill, with n_bytes 0; repeated ids are rows of their own, equal texts
    have equal values; an empty table gives an empty one; a text of any length is one member."""
    made = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for b in batches:
            rows = []
            for i, n, image in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                p = from_png(image)
                rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(p)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in made.split(", ")])

    return media.select("id", "n_bytes", "media").mapInArrow(run, made)
