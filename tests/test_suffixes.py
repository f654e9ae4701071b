"""Repeated bytes and suffix arrays against brute force."""

import random
from collections import Counter, defaultdict

import pytest

from corpusloom.operators import suffixes


def plain_ranges(texts, length, more_than, keep_first):
    """{row: ranges} of (id, text) rows in the order of their ids."""
    raw = [(i, (t or "").encode()) for i, t in texts]
    counts = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    seen, out = set(), defaultdict(list)
    for row, (_, b) in enumerate(raw):
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if counts[s] <= more_than:
                continue
            if keep_first and s not in seen:
                seen.add(s)
                continue
            if out[row] and out[row][-1][1] >= p:
                out[row][-1] = (out[row][-1][0], p + length)
            else:
                out[row].append((p, p + length))
    return {r: v for r, v in out.items() if v}


def corpus(seed, n=7):
    rng = random.Random(seed)
    words = ["abc", "é", "zz z", "\U0001f600", "aaaaaaaaaaaaaaaaaaaaaaa", "\0\0", "the passage that is in all of the texts, or most"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(n)]
    return [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "q"), (n + 3, texts[0])]


@pytest.mark.parametrize(("length", "more_than", "keep_first"), [(1, 3, True), (7, 1, False), (16, 2, True), (21, 1, True), (48, 1, False), (100, 1, True)])
def test_repeated_ranges_equal_brute_force(spark, length, more_than, keep_first):
    texts = corpus(length)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, row string").repartition(3)
    got = defaultdict(list)
    for r in suffixes.repeated_bytes(df, length=length, more_than=more_than, keep_first=keep_first).collect():
        got[r["id"]].append((r["first"], r["last"]))
    want = plain_ranges(texts, length, more_than, keep_first)
    assert {k: sorted(v) for k, v in got.items()} == want
    kept = {r["id"]: r["text"] for r in suffixes.remove_repeated_bytes(df, length=length, more_than=more_than, keep_first=keep_first).collect()}
    for i, t in texts:
        raw, gone = (t or "").encode(), {p for a, b in want.get(i, []) for p in range(a, b)}
        chars, at, out = list(t or ""), 0, []
        for c in chars:
            size = len(c.encode())
            if not set(range(at, at + size)) <= gone:
                out.append(c)
            at += size
        assert at == len(raw) and kept[i] == "".join(out)


def test_ranges_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 8)
    texts = [(0, "0123456789" * 5 + "x" + "abcdefghij" * 3), (1, "y" + "0123456789" * 4 + "--" + "abcdefghij" * 2)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(tuple(r) for r in suffixes.repeated_bytes(df, length=6, keep_first=False).collect())
    assert got == sorted((i, a, b) for i, ranges in plain_ranges(texts, 6, 1, False).items() for a, b in ranges)


def test_suffix_array_equals_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed, 4)
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
        got = [(r["id"], r["pos"], r["lcp"]) for r in suffixes.suffix_array(df).orderBy("place").collect()]
        every = sorted(((t or "").encode()[p:], i, p) for i, t in texts for p in range(len((t or "").encode())))
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = [(i, p, common(every[k - 1][0], s) if k else 0) for k, (s, i, p) in enumerate(every)]
        assert got == want


def test_nothing_to_name(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeated_bytes(none).count() == 0 and suffixes.suffix_array(none).count() == 0 and suffixes.remove_repeated_bytes(none).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeated_bytes(none, length=0)
