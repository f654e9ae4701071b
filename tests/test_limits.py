"""Forms of queries that stay within limits of time, shuffle and tasks at larger sizes, against plain ones."""

import hashlib
import random

import numpy as np
import pytest

from corpusloom.functions.hashing import md5_heads
from corpusloom.operators import dedup


def test_md5_heads_equal_hashlib():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(3_000))
    first = np.array([rng.randrange(2_900) for _ in range(2_000)])
    end = first + np.array([rng.choice([0, 1, 3, 4, 9, 36, 54, 55, 56, 64, 90]) for _ in first])
    want = [int.from_bytes(hashlib.md5(raw[a:b]).digest()[:4], "big") for a, b in zip(first, end, strict=True)]
    assert md5_heads(raw, first, end, block=64).tolist() == want
    assert md5_heads(b"", first[:0], end[:0]).tolist() == [] and md5_heads(b"", np.array([0]), np.array([0])).tolist() == [0xD41D8CD9]


@pytest.mark.parametrize(("characters", "hashing"), [(False, "md5"), (False, "xxh32"), (True, "md5"), (True, "xxh32")])
def test_signatures_equal_plain_ones(spark, monkeypatch, characters, hashing):
    monkeypatch.setattr(dedup, "GRAMS", 20)
    rng = random.Random(2)
    texts = [" \n".join(rng.choice(["a", "é", "\U0001f600x", "long" * 20, "c d"]) for _ in range(rng.randrange(14))) for _ in range(30)]
    df = spark.createDataFrame([*enumerate(texts), (90, None), (91, ""), (92, " \t")], "doc_id long, text string")
    got = {r["id"]: r["minhashes"] for r in dedup.signatures(df, k=6, shingle=4, hashing=hashing, characters=characters).collect()}
    a = dedup.permutations(6)
    for i, t in [*enumerate(texts), (90, ""), (91, ""), (92, "")]:
        w = t.split()
        units = " ".join(w) if characters else w
        grams = {("" if characters else " ").join(units[j : j + 4]) for j in range(max(1, len(units) - 3))}
        want = dedup.min_hashes(np.array([dedup.HASHES[hashing](g) for g in grams], np.uint64), a).tolist() if w else [0] * 6
        assert got[i] == want


def _signatures(spark, n=60):
    """Some at the border of the distance, changed at places dealt evenly so that few bands stay, and copies."""
    rng = random.Random(4)
    base = [rng.randrange(1 << 32) for _ in range(112)]
    rows = []
    for i in range(n):
        m = list(base)
        for p in ([*range(0, 99, 3)], [*range(0, 102, 3)], [*range(33)], [], rng.sample(range(112), 30))[i % 5]:
            m[p] = rng.randrange(1 << 32)
        rows.append((i, m))
    return rows, spark.createDataFrame(rows, "id long, minhashes array<long>")


def test_nearest_misses_none(spark):
    rows, sigs = _signatures(spark)
    apart = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True)) / 112
    want = set()
    for i, m in rows[::3]:
        near = sorted((d, j) for j, o in rows if j != i and (d := apart(m, o)) <= 0.3 + 1e-9)[:4]
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(near)}
    got = {(r["query_id"], r["neighbor_id"], r["rank"]) for r in dedup.nearest(sigs.where("id % 3 = 0"), sigs).collect()}
    assert got == want


def test_met_pairs_equal_a_join_by_bands(spark):
    rows, sigs = _signatures(spark)
    bands = lambda m: {(b, tuple(m[8 * b : 8 * b + 8])) for b in range(14)}
    want = {(i, j, sum(p == q for p, q in zip(m, o, strict=True)) / 112) for i, m in rows if i % 3 == 0 for j, o in rows if bands(m) & bands(o)}
    assert {tuple(r) for r in dedup.met_pairs(sigs.where("id % 3 = 0"), sigs).collect()} == want


def test_word_shingles_are_not_exploded(spark, data):
    from corpusloom.plans import registry

    plan = registry.queries()["word_shingles"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "min(first" in plan


def test_stream_of_many_partitions_is_written_as_it_is(spark, tmp_path):
    from corpusloom.plans import registry

    rows = [(i, f"text {i % 40}") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    asked = []
    kind = type(spark.range(1))
    plain = kind.repartitionByRange
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a partition a file
    try:
        kind.repartitionByRange = lambda self, *a: asked.append(a) or plain(self, *a)
        keys = [r["key"] for r in registry.queries()["exact_dedup_stream"](spark, str(tmp_path)).collect()]
    finally:
        kind.repartitionByRange = plain
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(keys) == len(set(keys)) == 40 and not asked
