"""Recognisers and the settling of overlaps against brute force, and language identification on held-out texts."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import languages, recognisers

SPANS = st.lists(st.tuples(st.integers(0, 12), st.integers(1, 5), st.sampled_from("AB"), st.sampled_from([0.4, 0.6, 0.75, 1.0])).map(lambda s: (s[0], s[0] + s[1], s[2], s[3])), max_size=7)


@settings(max_examples=300, deadline=None)
@given(SPANS)
def test_overlaps_are_settled_for_the_greatest_score(spans):
    got = recognisers.resolve(spans)
    free = lambda some: all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2))
    worth = lambda some: (round(sum(s[3] for s in some), 6), sum(s[1] - s[0] for s in some))
    every = [c for n in range(len(set(spans)) + 1) for c in itertools.combinations(sorted(set(spans)), n) if free(c)]
    assert free(got) and got == sorted(got) and worth(got) == max(map(worth, every))


def told(text, **options):
    return [(e, text[a:b], s) for a, b, e, s in recognisers.finds(text, recognisers.RECOGNISERS, options.get("threshold", recognisers.THRESHOLD))]


def test_entities():
    assert told("card 4111 1111 1111 1111, not 4111 1111 1111 1112") == [("CREDIT_CARD", "4111 1111 1111 1111", 1.0)]
    assert told("to DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00") == [("IBAN_CODE", "DE89 3704 0044 0532 0130 00", 1.0)]
    assert told("212-555-0199 is quiet") == [] and told("please call me: 212-555-0199") == [("PHONE_NUMBER", "212-555-0199", 0.75)]
    assert told("+1 (212) 555-0199") == [("PHONE_NUMBER", "+1 (212) 555-0199", 0.75)]
    assert told("ssn 123-45-6789, 666-45-6789") == [("US_SSN", "123-45-6789", 0.85)] and told("123-45-6789") == [] and told("123-45-6789", threshold=0.5) != []
    assert told("10.0.0.256 10.0.0.1.2 1.2.3.4") == [("IP_ADDRESS", "1.2.3.4", 0.6)]
    assert told("on 2024-02-29T10:00, 2023-02-29") == [("DATE_TIME", "2024-02-29T10:00", 0.6)]
    assert told("Mail Dr. Ann Lee at Acme Widgets GmbH: a.b@c.example.org.") == [("PERSON", "Dr. Ann Lee", 0.6), ("ORGANIZATION", "Acme Widgets GmbH", 0.6), ("EMAIL_ADDRESS", "a.b@c.example.org", 1.0)]
    assert recognisers.iban("GB82 WEST 1234 5698 7654 32") and not recognisers.iban("GB82 WEST 1234 5698 7654 3")


def test_redaction(spark):
    rows = [(1, "Mr Bean: b@x.org, b@x.org", "k"), (2, None, "k"), (3, "", "k"), (4, "nothing", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, new_contents string")
    got = {r["doc_id"]: (r["new_contents"], r["detected_pii"]) for r in recognisers.redact(df).collect()}
    assert got == {1: ("<PERSON>: <EMAIL_ADDRESS>, <EMAIL_ADDRESS>", ["PERSON", "EMAIL_ADDRESS", "EMAIL_ADDRESS"]), 2: (None, None), 3: ("", []), 4: ("nothing", [])}
    gone = {r["doc_id"]: r["new_contents"] for r in recognisers.redact(df, entities=["PERSON"], replace=False).collect()}
    assert gone[1] == ": b@x.org, b@x.org"
    spans = recognisers.detect(df).collect()
    assert [(r["id"], r["entity"], r["found"]) for r in spans] == [(1, "PERSON", "Mr Bean"), (1, "EMAIL_ADDRESS", "b@x.org"), (1, "EMAIL_ADDRESS", "b@x.org")]
    assert recognisers.detect(df.limit(0)).count() == 0


def test_languages_are_told_on_held_out_texts(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    table = languages.learn(docs.where(~out), most=3_000)
    assert len(table.grams) == 3_000 and (table.grams[1:] > table.grams[:-1]).all()
    told = languages.identify(docs.where(out), table).where("length(text) > 20")
    right, n = told.agg(F.avg((F.col("lang") == F.col("lang_label")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.98
    edges = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !", "x"), (4, "a" * 3_000_000, "x")], "doc_id long, text string, lang string")
    rows = languages.identify(edges, table).collect()
    assert len(rows) == 4 and len({(r["lang_label"], r["lang_score"]) for r in rows if r["doc_id"] < 4}) == 1 and languages.identify(edges.limit(0), table).count() == 0
    with pytest.raises(ValueError):
        languages.learn(edges.limit(0))


def test_counts_and_gains_equal_a_plain_version(spark):
    import math
    from collections import Counter

    rows = [(1, "Das ist gut", "de"), (2, "this is it", "en"), (3, "Gut, das!", "de"), (4, None, "en"), (5, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = lambda t: f" {' '.join(''.join(c if c.isalpha() else ' ' for c in t).lower().split())} "
    counts = Counter((lang, fold(t or "")[i : i + 3]) for _, t, lang in rows if lang for i in range(len(fold(t or "")) - 2))
    spell = lambda g: "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0))
    assert {(r["language"], spell(r["gram"])): r["n"] for r in languages.counted(df, "text", "lang").collect()} == counts
    every, per = sum(counts.values()), Counter()
    whole = Counter()
    for (lang, g), n in counts.items():
        per[lang] += n
        whole[g] += n
    gain = Counter()
    for (lang, g), n in counts.items():
        gain[g] += n / every * math.log(n * every / (whole[g] * per[lang]))
    best = sorted(whole, key=lambda g: (-round(gain[g], 12), g))[:5]
    assert sorted(map(spell, languages.learn(df, most=5).grams.tolist())) == sorted(best)
