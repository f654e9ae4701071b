"""Golden values, edge cases and properties of the operators."""

import hashlib
import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.text import str_to_int
from corpusloom.operators import code, dedup, filters, quality, repetition, structure, urls
from corpusloom.sources import archives, tables, warc
from corpusloom.streaming import online


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_doc_quality_values(spark):
    df = spark.createDataFrame([(1, " : This documents is for test . ? ")], "document_id long, contents string")
    r = quality.doc_quality(df, "contents").first().asDict()
    assert r["docq_total_words"] == 8 and r["docq_mean_word_len"] == 3.125 and r["docq_symbol_to_word_ratio"] == 0.0
    assert r["docq_sentence_count"] == 1 and r["docq_alphabet_word_ratio"] == 0.625
    assert r["docq_lorem_ipsum_ratio"] == r["docq_curly_bracket_ratio"] == r["docq_bullet_point_ratio"] == r["docq_ellipsis_line_ratio"] == 0.0
    assert not r["docq_contain_bad_word"] and not r["docq_contain_common_en_words"]


def test_doc_id_values(spark):
    df = spark.createDataFrame([("Tom",), ("Joe",)], "doc string")
    out = filters.doc_id(df, "doc", int_into="doc_int", order_by=["doc"], start=5)
    assert dict(values(out, "doc", "doc_int")) == {"Joe": 5, "Tom": 6}
    assert dict(values(out, "doc", "doc_hash"))["Tom"] == hashlib.sha256(b"Tom").hexdigest()


def test_blocklist_values(spark):
    hosts = ["https://poker/a", "http://poker.fr/", "https://poker.foo.bar/x?y", "https://this.pokerless.com", "http://a.fr", "https://foo.bar", "http://apoker.fr"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, title string")
    listed = spark.createDataFrame([("poker",), ("poker.fr",), ("poker.foo.bar",)], "domain string")
    got = dict(values(urls.blocklist(df, listed, "title"), "i", "blocklisted"))
    assert [got[i] for i in range(7)] == ["poker", "poker.fr", "poker.foo.bar", "", "", "", ""]


def test_license_and_language_values(spark):
    df = spark.createDataFrame([("ID1", "Apache-2.0"), ("ID2", "BAD_LICENSE"), ("ID3", None)], "document_id string, license string")
    assert values(filters.license_select(df, ["apache-2.0"], allow_no_license=True), "license_status") == [(True,), (False,), (True,)]
    assert values(filters.license_select(df, ["bad_license"], deny=True), "license_status") == [(True,), (False,), (False,)]
    df = spark.createDataFrame([("Cobol",), ("Python",), (None,)], "language string")
    assert values(filters.language_select(df, ["Python"], "language"), "allowed") == [(False,), (True,), (False,)]


def test_malware_values(spark):
    eicar = r"X5O!P%@AP[4\PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*"
    df = spark.createDataFrame([("clean",), (eicar,)], "text string")
    assert values(code.malware(df), "virus_detection") == [(None,), ("Eicar-Signature",)]


def test_tokenization_drops_empty(spark):
    df = spark.createDataFrame([("a", "Hello world!"), ("b", ""), ("c", None)], "doc_id string, text string")
    assert values(structure.tokenize(df, structure.bytes_tokenizer), "doc_id", "document_length", "token_count") == [("a", 12, 12)]
    assert values(structure.tokenize_regex(df), "doc_id", "token_count") == [("a", 3)]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "x " * 50_000, "python")], "doc_id long, text string, lang string")
    for out in (quality.doc_quality(df), quality.repeated_lines(df), quality.gram_repetition(df), quality.line_quality(df), quality.enrichment(df), quality.readability(df, scores=quality.SCORES), code.code_quality(df), structure.lang_id(df), structure.hap(df), structure.text_encoder(df), structure.redact(df)):
        assert out.count() == 3 and len(out.collect()) == 3
    assert dedup.signatures(df).where("id = 2").first()["minhashes"] == [0] * dedup.PERMUTATIONS
    assert dedup.exact_dedup(df).count() >= 2


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 2**64 - 1))
def test_limbs_equal_wrapping_product(h, a):
    a |= 1
    want = int((np.uint64(h) * np.array([a], np.uint64))[0] >> np.uint64(32))
    hi, lo = a >> 32, a & 0xFFFFFFFF
    got = ((((h >> 16) * lo + (((h & 65535) * lo) >> 16)) >> 16) + ((((h >> 16) * hi) & 65535) * 65536 + (h & 65535) * hi)) & 4294967295
    assert got == want
    assert str(hi) in dedup.sql_minhash("h", hi, lo)


def test_greedy_pivots_equal_a_plain_model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sigs = {r["id"]: np.array(r["minhashes"]) for r in dedup.signatures(docs).collect()}
    removed = set()
    for b in range(dedup.BANDS):
        buckets = {}
        for i, s in sigs.items():
            buckets.setdefault(tuple(s[b * dedup.ROWS : (b + 1) * dedup.ROWS]), []).append(i)
        for ids in buckets.values():
            rest = sorted(ids)
            while rest:
                pivot, *rest = rest
                hit = [i for i in rest if (sigs[i] == sigs[pivot]).mean() >= dedup.THRESHOLD]
                removed.update(hit)
                rest = [i for i in rest if i not in hit]
    stored = dedup.signatures(docs).persist()
    assert {r["id"] for r in dedup.fuzzy_removed(stored).collect()} == removed
    assert {r["removed"] for r in dedup.fuzzy_pairs(stored).collect()} <= removed
    stored.unpersist()


def test_exact_dedup_is_idempotent(spark, data):
    once = dedup.exact_dedup(spark.read.parquet(f"{data}/documents.parquet"))
    assert dedup.exact_dedup(once).count() == once.count()


def test_online_equals_batch_and_is_idempotent(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    store = online.ExactStore(str(tmp_path / "s"))
    online.add_in_batches(docs, store, 3)
    store.add(docs.where("doc_id < 50"), 0)  # delivered again
    got = sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "s/kept")).collect())
    assert got == sorted(r["doc_id"] for r in dedup.exact_dedup(docs).collect())


def test_near_duplicates_recall_against_all_pairs(spark, data):
    sigs = dedup.signatures(spark.read.parquet(f"{data}/documents.parquet")).persist()
    rows = {r["id"]: np.array(r["minhashes"]) for r in sigs.collect()}
    ids = sorted(rows)
    truth = {(a, b) for a in ids for b in ids if a != b and (rows[a] == rows[b]).mean() >= 0.9}
    found = {(r["query_id"], r["neighbor_id"]) for r in dedup.near_duplicates(sigs, sigs, k=50).collect()}
    assert len(truth & found) >= 0.9 * len(truth)
    sigs.unpersist()


def test_gram_scans():
    ws = "a b c d e a b c d e a b c d e".split()
    assert quality.Grams(ws).repeated_chars(5) == 10
    assert quality.Grams("a b a b c".split()).top_chars(2) == 6
    assert structure.long_splits("aaa bbb ccc", 7) == ["aaa", "bbb ccc"] or "".join(structure.long_splits("aaa bbb ccc", 7)).replace(" ", "") == "aaabbbccc"
    assert structure.long_splits("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_repetition_removal(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"one {passage} end"), (2, f"two {passage} tail"), (3, "alone here")], "doc_id long, text string")
    got = dict(values(repetition.remove_repetition(df), "doc_id", "text"))
    assert got == {1: f"one {passage} end", 2: "two tail", 3: "alone here"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(5, 60), st.integers(1, 6))
def test_ranges_summed_up_give_the_rule_of_one_scan(sizes, limit, ranges):
    want, k, h = [], 0, 0
    for n in sizes:
        h += n
        if h > limit:
            k, h = k + 1, 0
        want.append((k, h))
    cut, k, h = np.array_split(np.array(sizes), ranges), 0, 0
    at = 0
    for own in (c for c in cut if len(c)):
        rows = filters._summary(0, own, limit).to_pylist()
        hit = next(r for r in rows if r["upto"] is None or r["upto"] > limit - h)
        k, h, at = k + hit["slices"], hit["held"] if hit["upto"] is not None else h + hit["held"], at + len(own)
        assert (k, h) == want[at - 1]


def test_resize_bytes_rule(spark):
    df = spark.createDataFrame([(i, 40) for i in range(8)], "i int, n int")
    got = [r["slice"] for r in filters.resize_bytes(df, 50, F.col("n"), ["i"]).orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 1, 2, 2, 2]


def test_ml_filter_policy(spark):
    df = spark.createDataFrame([("en", 1.0)], "lang string, a double")
    with pytest.raises(ValueError):
        filters.ml_filter(df, {"en": {"b_min": 1}})
    with pytest.raises(ValueError):
        filters.ml_filter(df, {"en": {"a_min": 1, "b_min": 1}})
    assert filters.ml_filter(df, {"en": {"a_min": 1, "b_min": 1}}, ignore_missing=True).count() == 1


def test_archives_and_token_stream(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("src/a.py", "import os\n")
        z.writestr("b.bin", b"\xff\xfe\x00")
        z.writestr("empty.txt", "")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/repo.zip").write_bytes(buffer.getvalue())
    assert values(archives.code2parquet(spark, str(tmp_path / "in")), "title", "programming_language", "repo_name", "size") == [("src/a.py", "Python", "repo", 10)]
    archives.register(spark)
    tokens = spark.createDataFrame([(1, [5, 6]), (2, [7])], "doc_id long, tokens array<long>")
    out = str(tmp_path / "tok")
    archives.write_token_stream(tokens, out)
    assert sorted(r["tokens"] for r in spark.read.format("token_stream").option("path", out).load().collect()) == [[5, 6], [7]]


def test_listing_resume_samples(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.txt").write_text("x")
    listing = tables.files(spark, str(tmp_path), [".txt"])
    assert listing.count() == 5 and tables.capped(listing, 2).count() == 2 and tables.sampled(listing, 7).count() == 7
    assert tables.unprocessed(listing, listing.where("name < 'f3'")).count() == 2
    assert tables.batches(listing, 2).select("batch").distinct().count() == 3
    tables.write(spark.range(10).withColumn("text", F.lit("t")), str(tmp_path / "out"), max_rows=4)
    back = tables.read(spark, str(tmp_path / "out"))
    assert back.count() == 10
    assert tables.job_record(spark, "noop", {"a": 1}, back, back, 0.0, 1.0).first()["rows_out"] == 10


@pytest.mark.parametrize("block", [1, 4, 7, 100])
def test_pivots_of_buckets_in_blocks(spark, block):
    """Blocks change nothing: the same pivots as of one stream, which are those of a plain loop."""
    rng = np.random.default_rng(block)
    base = rng.integers(0, 4, size=(6, 10))
    rows = []
    for key, n in (((0, 5), 23), ((0, 6), 4), ((1, 5), 9)):
        for i in range(n):
            m = base[rng.integers(6)].copy()
            m[rng.integers(10, size=rng.integers(4))] = 9
            rows.append((*key, int(100 * key[1] + 7 * i % 97 + 1000 * key[0]), m.tolist()))
    df = spark.createDataFrame(rows, "band int, band_hash long, id long, minhashes array<long>").repartition(3)
    want, pivots = set(), {}
    for band, h, i, m in sorted(rows):
        held = pivots.setdefault((band, h), [])
        hit = next(((p, s) for p, q in held if (s := float(np.mean(np.array(q) == np.array(m)))) >= 0.7), None)
        if hit:
            want.add((hit[0], i, hit[1]))
        else:
            held.append((i, m))
    got = dedup.greedy_pivots(df, 0.7, block).collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_optimal_bands_use_the_hashes():
    bands, rows = dedup.optimal_bands(0.7, 112)
    assert bands * rows <= 112 and rows > 1


def test_manifests_must_match(spark):
    dedup.check_manifest(dedup.manifest_of(spark), dedup.manifest_of(spark))
    with pytest.raises(ValueError):
        dedup.check_manifest(dedup.manifest_of(spark), dedup.manifest_of(spark, seed=1))


def test_murmur_known_values(spark):
    rows = spark.createDataFrame([("",), ("hello",), ("hello, world",)], "s string").select(str_to_int("s", 0).alias("h"))
    assert [r["h"] for r in rows.collect()] == [0, 0x248BFA47, 0x149BBB7F]


def test_warc_records_of_plain_and_cut_streams():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na\r\nb\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x:1/\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    for step in (1, 3, 1000):
        raw = one + two + one[:-6]
        got = []
        with pytest.raises(warc.CutRecord):
            for r in warc.records(raw[i : i + step] for i in range(0, len(raw), step)):
                got.append(r)
        assert [(h["warc-type"], h.get("warc-target-uri"), b) for h, b in got] == [("warcinfo", None, b"a\r\nb"), ("response", "http://x:1/", b"")]


def test_upsert_keeps_the_last(spark):
    store = spark.createDataFrame([(1, "old", 0), (2, "stays", 0)], "id long, v string, at int")
    fresh = spark.createDataFrame([(1, "late", 5), (1, "early", 2), (3, "new", 1)], "id long, v string, at int")
    assert sorted(values(dedup.upsert(store, fresh, order_by="at"), "id", "v")) == [(1, "late"), (2, "stays"), (3, "new")]


def test_gram_hashes_equal_plain_scans():
    rng = np.random.default_rng(4)
    for _ in range(60):
        ws = ["a", "ab", "b", "bc", "c", "é😀"][:6]
        ws = [ws[i] for i in rng.integers(0, 6, rng.integers(0, 40))]
        g = quality.Grams(ws)
        for n in (2, 5):
            grams = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)]
            top = max(grams, key=grams.count, default="")
            assert g.top_chars(n) == len(top) * grams.count(top)
            seen, total, i = set(), 0, 0
            while i + n <= len(ws):
                gram = "".join(ws[i : i + n])
                if gram in seen:
                    total, i = total + len(gram), i + n
                else:
                    seen.add(gram)
                    i += 1
            assert g.repeated_chars(n) == total


def test_fuzzy_store_probes_without_inserting(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    store = online.FuzzyStore(str(tmp_path / "store"))
    assert store.probe(docs).where("known").count() == 0
    store.add(docs.where("doc_id % 2 = 0"), 0)
    held = store.signatures(spark).count()
    store.add(docs.where("doc_id % 2 = 0"), 0)
    got = store.probe(docs)
    assert store.signatures(spark).count() == held and got.count() == docs.count()
    assert got.where("doc_id % 2 = 0 and not known").count() == 0


@pytest.mark.parametrize("segment", [1_000_000, 1000])
def test_bloom_holds_more_ids_than_expected(spark, monkeypatch, segment):
    monkeypatch.setattr(filters, "SEGMENT", segment, raising=False)
    ids = spark.range(20_000).withColumnRenamed("id", "n")
    got = filters.bloom_member(ids, ids.where("n < 5000"), "n", expected=100, exact=False)
    assert got.count() == 20_000 and got.where("n < 5000 AND bloom = 0").isEmpty()
    assert got.where("n >= 5000 AND bloom = 1").count() <= 0.03 * 15_000


@pytest.mark.parametrize("name", ["encoded_data", "code_quality"])
def test_encoded_data_as_its_sql(spark, tmp_path, name):
    import duckdb

    from corpusloom.plans import registry

    pairs = "12 34 56 78 9a bc de f0"
    texts = ["a" * 201 + " !" * 1499 + " ", "a" * 323 + "!" * 317, "é" + pairs, pairs + "é", "x " + pairs + "\x0b11", "0x12,0x34,0x56,0x78,0x9a,0xbc,0xde,0xf0", r"a\x12\x34\x56\x78\x9a\xbc\xde\xf0", "a" + pairs, pairs[:20] + "\xa0" + pairs, "ab " * 200_000, "x"]
    spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()[name](spark, str(tmp_path)).select("doc_id", "max_encoded_data_length", "encoded_data_percent")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, max_encoded_data_length, encoded_data_percent FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(values(got, *got.columns)) == sorted(want)


def test_queries_get_batches_by_bytes(spark, data):
    from corpusloom.plans import registry

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        registry.queries()["noop"](spark, data)
        rows = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
        most = rows.mapInPandas(lambda bs: (b.assign(n=b["t"].str.len().sum())[["n"]] for b in bs), "n long").agg(F.max("n")).first()[0]
        assert most < 8 << 20
    finally:
        spark.conf.set(name, before)


def test_archives_of_bounded_size(spark, tmp_path, monkeypatch):
    rows = spark.range(40, numPartitions=1).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("title"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(80_000)), lambda i: F.xxhash64(i, "id").cast("string"))).alias("contents"))
    archives.write_archives(rows, str(tmp_path / "zips"))
    sizes = [p.stat().st_size for p in (tmp_path / "zips").iterdir()]
    assert len(sizes) > 1 and max(sizes) < 18 << 20
    got = archives.code2parquet(spark, str(tmp_path / "zips")).select("title", "contents")
    assert got.exceptAll(rows).isEmpty() and got.count() == 40


def test_store_finds_all_that_it_was_given(spark, tmp_path):
    """Chains of texts, each near its neighbours alone: what was dropped as a copy of a dropped one is found, too."""
    rows = [(c * 10 + k, " ".join(f"w{c}x{i}" for i in range(k * 15, k * 15 + 110))) for c in range(12) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store = online.FuzzyStore(str(tmp_path / "store"))
    store.add(docs, 0)
    assert store.probe(docs).where("NOT known").isEmpty()
    kept = store.signatures(spark)
    assert dedup.near_duplicates(kept, kept).isEmpty()


def test_search_shuffles_rows_and_not_pairs(spark, monkeypatch):
    """A group of near copies, other texts and copies: results as by brute force, in blocks, too; what is kept of pairs grows with
    the rows, and only rows that share a bucket get signatures."""
    rng, told = np.random.default_rng(3), {}
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(w if rng.random() > 0.01 else f"x{rng.integers(1e6)}" for w in words) for _ in range(120)] + [" ".join(f"{c}y{i}" for i in range(50)) for c in range(200)]
    texts += texts[5:15] + texts[200:203]
    sigs = dedup.stored(dedup.signatures(spark.createDataFrame([(i - 20, x) for i, x in enumerate(texts)], "doc_id long, text string")), "signatures")
    kept, pivots = dedup.stored, dedup.greedy_pivots

    def counted(df, name):
        out = kept(df, name)
        told[name] = out.count()
        return out

    monkeypatch.setattr(dedup, "stored", counted)
    m = {r["id"]: np.array(r["minhashes"]) for r in sigs.collect()}
    apart = lambda q, i: 1 - float((m[q] == m[i]).mean())
    for queries, index in ((sigs, sigs), (sigs.where("id % 3 = 0"), sigs.where("id % 2 = 0"))):
        ids = [[r["id"] for r in d.select("id").collect()] for d in (queries, index)]
        want = [(q, i, r) for q in ids[0] for r, (_, i) in enumerate(sorted((apart(q, i), i) for i in ids[1] if i != q and apart(q, i) <= 0.3 + 1e-9)[:4], 1)]
        for options in ({}, {"block": 7}):
            got = dedup.near_duplicates(queries, index, **options).collect()
            assert sorted((r["query_id"], r["neighbor_id"], r["rank"]) for r in got) == sorted(want)
    near = dedup.near_duplicates(sigs, sigs).count()
    assert near and told["pairs"] < 120 * 119 / 2
    seen = []
    monkeypatch.setattr(dedup, "greedy_pivots", lambda banded, *a, **o: seen.append(banded.count()) or pivots(banded, *a, **o))
    dedup.fuzzy_removed(sigs.where("id >= 100 AND id < 300")).count()
    assert seen == [0]


def test_store_of_older_bands_is_searched(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"{i}w{k}" for k in range(40))) for i in range(8)], "doc_id long, text string")
    store = online.FuzzyStore(str(tmp_path / "store"))
    store.add(docs.where("doc_id < 4"), 0)
    (tmp_path / "store" / "bands").rename(tmp_path / "store" / "index")
    again = docs.where("doc_id < 6").withColumn("doc_id", F.col("doc_id") + 100)
    assert sorted(r["doc_id"] for r in store.probe(again).where("known").collect()) == [100, 101, 102, 103]
    store.add(again, 1)
    assert sorted(r["id"] for r in store.signatures(spark).collect()) == [0, 1, 2, 3, 104, 105]
