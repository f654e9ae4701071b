"""Passages by anchors against brute force, and that only anchors are shuffled."""

import random
from collections import Counter

import pytest

from corpusloom.operators import passages, repetition, suffixes


def test_fewer_anchors_than_places(spark):
    rng = random.Random(3)
    texts = [(i, i, " ".join(f"{rng.randrange(10**6):06d}" for _ in range(2_000))) for i in range(4)]
    rows = spark.createDataFrame(texts, "row long, id long, text string")
    assert 0 < passages.anchors(rows, "bytes", 100).count() < sum(len(t) for _, _, t in texts) // 20
    assert 0 < passages.anchors(rows, "words", 50).count() < 4 * 2_000 // 10
    assert not hasattr(suffixes, "repeated_places")  # a row a byte


@pytest.mark.parametrize(("n", "more_than", "keep_first"), [(1, 2, True), (5, 1, True), (5, 1, False), (12, 2, True), (50, 1, True)])
def test_ranges_of_words_equal_brute_force(spark, n, more_than, keep_first):
    rng = random.Random(n)
    passage = [f"p{i}" for i in range(70)]
    texts = []
    for i in range(9):
        ws = [rng.choice("abc") for _ in range(rng.randrange(40))]
        texts.append((i, "  ".join([*ws, *passage[rng.randrange(8) :], *ws[::-1], *(["x"] * 30 if i % 2 else [])])))
    texts += [(20, texts[0][1]), (21, None), (22, ""), (23, "a b")]
    ws = {i: (t or "").split() for i, t in texts}
    counts = Counter(tuple(w[p : p + n]) for w in ws.values() for p in range(len(w) - n + 1))
    seen, want = set(), []
    for i, w in sorted(ws.items()):
        for p in range(len(w) - n + 1):
            s = tuple(w[p : p + n])
            if counts[s] > more_than and (not keep_first or s in seen):
                if want and want[-1][0] == i and want[-1][2] >= p:
                    want[-1] = (i, want[-1][1], p + n)
                else:
                    want.append((i, p, p + n))
            seen.add(s)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in repetition.repeated_ranges(df, n=n, more_than=more_than, keep_first=keep_first).collect()) == want


def test_only_anchors_that_recur_are_shuffled(spark, monkeypatch):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = ["".join(rng.choice("ijklmnop ") for _ in range(2_999)) + chr(65 + i) + (passage if i % 3 == 0 else "") for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.selectExpr("doc_id AS row", "doc_id AS id", "text")
    every = passages.anchors(rows, "bytes", 100)
    kept, plain = [], passages.stored
    monkeypatch.setattr(passages, "stored", lambda d, name: kept.append((name, d.count())) or plain(d, name))
    found = {(r["id"], r["first"], r["last"]) for r in suffixes.repeated_bytes(df).collect()}
    assert found == {(i, 3_000, 3_300) for i in (3, 6, 9)}
    assert 0 < dict(kept)["anchors"] < every.count() // 10
    # a bitmap on whose bits all fall only adds work
    monkeypatch.setattr(passages, "BITS", 6)
    assert {(r["id"], r["first"], r["last"]) for r in suffixes.repeated_bytes(df).collect()} == found
