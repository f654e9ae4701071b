"""Ranges of gzipped archives, cut files and languages."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import warc


def record(i, body, language=None):
    told = f"WARC-Identified-Content-Language: {language}\r\n" if language else ""
    raw = body.encode()
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u{i}\r\n{told}Content-Length: {len(raw)}\r\n\r\n".encode() + raw + b"\r\n\r\n"


def test_ranges_have_every_record_once(tmp_path):
    rng = random.Random(3)
    bodies = ["".join(rng.choice("ab\r\n \x1f\x8b\x08WARC/é") for _ in range(rng.choice([0, 5, 300, 4000]))) for _ in range(60)]
    parts = [record(i, b) for i, b in enumerate(bodies)]
    files = {
        "member": b"".join(map(gzip.compress, parts)),
        "whole": gzip.compress(b"".join(parts)),
        "pairs": b"".join(gzip.compress(b"".join(parts[i : i + 2])) for i in range(0, 60, 2)),
        "torn": b"".join(gzip.compress(x) for p in parts for x in (p[:30], p[30:])),
    }
    for name, raw in files.items():
        path = tmp_path / f"{name}.gz"
        path.write_bytes(raw)
        for size in (200, 1_000, 5_000, 1 << 20):
            got = []
            with open(path, "rb") as f:
                for lo in range(0, len(raw), size):
                    got += [(h["warc-target-uri"], b.decode()) for h, b in warc.records(warc.Members(f, lo, lo + size))]
            assert got == [(f"u{i}", b) for i, b in enumerate(bodies)], (name, size)


def test_cut_files_are_told(spark, tmp_path):
    raw = record(1, "whole") + record(2, "cut here")[:-9]
    (tmp_path / "a.warc").write_bytes(raw)
    warc.register(spark)
    read = lambda **options: spark.read.format("warc").options(**options).load(str(tmp_path))
    with pytest.raises(Exception, match="ends within a record"):
        read().collect()
    assert [r["content"] for r in read(cut="skip").collect()] == ["whole"]
    with pytest.raises(warc.CutRecord):
        list(warc.records([record(1, "x")[:20]]))
    assert list(warc.records([b"\r\n\r\n"])) == [] == list(warc.records([]))


def test_languages(spark, tmp_path):
    raw = [record(1, "x", "eng"), record(2, "y", "deu,eng"), record(3, "z"), record(4, "w", "fra")]
    (tmp_path / "a.warc.wet.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    warc.register(spark)
    got = spark.read.format("warc").option("language", "eng").load(str(tmp_path))
    assert sorted(r["content"] for r in got.collect()) == ["x", "y"] and got.select(F.max("length")).first()[0] == 1
