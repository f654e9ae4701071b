"""Rows from raw files and ZIP archives, and the Arrow token stream."""

from __future__ import annotations

import hashlib
import io
import posixpath
import uuid
import zipfile
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import place

#: Extensions of common languages.
LANGUAGES = {
    "py": "Python", "java": "Java", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "hpp": "C++",
    "cs": "C#", "go": "Go", "rs": "Rust", "rb": "Ruby", "php": "PHP", "swift": "Swift", "kt": "Kotlin", "scala": "Scala", "r": "R", "pl": "Perl", "sh": "Shell", "sql": "SQL",
    "html": "HTML", "css": "CSS", "xml": "XML", "json": "JSON", "yaml": "YAML", "yml": "YAML", "md": "Markdown", "tex": "TeX", "lua": "Lua", "hs": "Haskell", "m": "MATLAB",
}
#: Bytes of texts that a task holds at once, and of one archive that it writes (compressed; its last text may go beyond).
PIECE, ARCHIVE = 4 << 20, 16 << 20
_ROWS = "title string, document string, contents string, document_id string, ext string, hash string, size long, date_acquired string, repo_name string"


def members(files: DataFrame, id_by_content: bool = False) -> DataFrame:
    """A row per text member of each ZIP archive (or per raw file) of a binaryFile frame; empty and undecodable ones are skipped."""

    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows, held = [], 0
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = posixpath.basename(path)
                for title, raw in _opened(name, bytes(content)):
                    try:
                        text = raw.decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if text.strip():
                        digest = hashlib.sha256(raw).hexdigest()
                        ident = digest if id_by_content else str(uuid.uuid5(uuid.NAMESPACE_URL, f"{path}!{title}"))
                        ext = posixpath.splitext(title)[1].lstrip(".").lower()
                        rows.append((title, name, text, ident, ext, digest, len(raw), pd.Timestamp.now("UTC").date().isoformat(), posixpath.splitext(name)[0]))
                        held += len(raw)
                    if held > PIECE:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, _ROWS)


def _opened(name: str, content: bytes):
    if not name.lower().endswith(".zip"):
        yield name, content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, z.read(info)


def write_archives(rows: DataFrame, path: str, title: str = "title", contents: str = "contents") -> None:
    """ZIP archives of text members, of about ARCHIVE bytes, since a reader holds one whole; each gets its name when it is finished."""

    def run(batches):
        where, root = place(path)
        where.create_dir(root, recursive=True)
        members = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        following = next(members, None)
        while following is not None:
            name = f"{root}/{uuid.uuid4().hex}.zip"
            with where.open_output_stream(name + ".part") as f:
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                    while following is not None and f.tell() < ARCHIVE:
                        z.writestr(following[0], following[1] or "")
                        following = next(members, None)
            where.move(name + ".part", name)
            yield pa.RecordBatch.from_pydict({"file": [name]})

    rows.select(title, contents).mapInArrow(run, "file string").collect()  # names of files


def code2parquet(spark: SparkSession, path: str, languages: dict[str, str] | None = None, language_column: str = "programming_language") -> DataFrame:
    """members() of the archives below a path, with the language by extension."""
    known = spark.createDataFrame(sorted((languages or LANGUAGES).items()), f"ext string, {language_column} string")
    rows = members(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return rows.join(F.broadcast(known), "ext", "left").withColumn(language_column, F.coalesce(language_column, F.lit("unknown")))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TokenStream(DataSource):
    """`token_stream`: Arrow IPC files of one record batch per document, with `tokens` as unsigned 32-bit numbers. Option: path (a folder)."""

    @classmethod
    def name(cls):
        return "token_stream"

    def schema(self):
        return "file string, doc long, tokens array<long>"

    def reader(self, schema):
        return _TokenReader(self.options["path"])

    def writer(self, schema, overwrite):
        return _TokenWriter(self.options["path"], schema.fieldNames().index("tokens"))


class _TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        where, root = place(self.path)
        return [_File(i.path) for i in where.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".arrow")] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        where = place(self.path)[0]
        with where.open_input_file(partition.path) as f, pa.ipc.open_file(f) as r:
            at, sizes, parts, held = 0, [], [], 0

            def batch():
                tokens = pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.concat_arrays(parts))
                return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(sizes)), pa.array(range(at, at + len(sizes)), pa.int64()), tokens], names=["file", "doc", "tokens"])

            for i in range(r.num_record_batches):
                parts.append(r.get_batch(i).column("tokens").cast(pa.int64()))
                sizes.append(len(parts[-1]))
                held += parts[-1].nbytes
                if held > PIECE:
                    yield batch()
                    at, sizes, parts, held = i + 1, [], [], 0
            if sizes:
                yield batch()


@dataclass
class _Written(WriterCommitMessage):
    file: str
    docs: int
    tokens: int


class _TokenWriter(DataSourceArrowWriter):
    """A file a task, under a name that readers pass over; commit() gives the files of the tasks that count their names, and abort()
    deletes what a failed job has left."""

    def __init__(self, path: str, at: int):
        self.path, self.at, self.job = path, at, uuid.uuid4().hex

    def write(self, iterator):
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        name = f"{root}/{self.job}-{uuid.uuid4().hex}.arrow"
        schema = pa.schema([("tokens", pa.uint32())])
        docs = total = 0
        with where.open_output_stream(name + ".part") as f, pa.ipc.new_file(f, schema) as w:
            for b in iterator:
                for row in b.column(self.at).to_pylist():
                    w.write_batch(pa.record_batch([pa.array(row or [], pa.uint32())], schema))
                    docs, total = docs + 1, total + len(row or [])
        return _Written(name, docs, total)

    def _left(self):
        from pyarrow import fs

        where, root = place(self.path)
        return [i.path for i in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith(self.job) and i.base_name.endswith(".part")]

    def commit(self, messages):
        where, root = place(self.path)
        kept = [m for m in messages if m is not None]
        for m in kept:
            where.move(m.file + ".part", m.file)
        for path in self._left():  # of attempts that were repeated
            where.delete_file(path)
        with where.open_output_stream(f"{root}/{self.job}.csv") as f:
            f.write("".join(f"{m.file},{m.docs},{m.tokens}\n" for m in kept).encode())

    def abort(self, messages):
        for path in self._left():
            place(self.path)[0].delete_file(path)


def write_token_stream(tokens: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write one Arrow IPC file per task, a batch a document; no file is seen before all tasks are done. `path`/<job>.csv then lists
    file, docs and tokens."""
    register(tokens.sparkSession)
    tokens.select(id_column, "tokens").write.format("token_stream").option("path", path).mode("append").save()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenStream)
