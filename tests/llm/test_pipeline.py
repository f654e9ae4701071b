"""The pipeline against a brute-force version, stage by stage, and on tables of edge cases."""

import zlib

import corpus_pipeline
from corpusloom.llm import contamination, packing, quality
from tests.llm.test_llm_operators import brute, brute_hits, check_packed


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, data)
        if name != "packing":
            assert out.columns == docs.columns
        rows = out.collect()
        if name == "quality":
            model = quality.learn(docs, spark.read.parquet(f"{data}/labels.parquet"))
            import pyarrow as pa

            want = {i for i, t in kept.items() if model.score(quality.features(pa.array([t])))[0] >= 0.3}
        elif name == "near_copies":
            want = {i for i, (_, c) in brute(list(kept.items()), 5, 80).items() if c == i}
        elif name == "contamination":
            want = set()
            for i, t in kept.items():
                n, h, _ = brute_hits(t, items)
                if not (h and 20 * h >= n):
                    want.add(i)
        else:
            want = set(kept)
        if name == "packing":
            check_packed(rows, 2048)
            enc = packing.encoder("byte_bpe_50k.json")
            for i, t in kept.items():
                own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
                ids = enc.ids(t) + b"\0\0\0\0"
                assert sum(p[2] for p in own) * 4 == len(ids) and all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for _, s, n, c in own)
        else:
            assert {r["doc_id"] for r in rows} == want
            kept = {r["doc_id"]: r["text"] for r in rows}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
            now = spark.createDataFrame(rows, docs.schema)


def test_edges(spark, data):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "same words here", "en", "s", 15), (4, "same words here", "en", "s", 15), (4, "same words here", "en", "s", 15), (None, "no id", "en", "s", 5), (5, "z " * 20_000, "en", "s", 40_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, data).collect() is not None
    left = corpus_pipeline.distinct_documents(spark, spark.createDataFrame(rows, schema), data)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "5", "None"]


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and check_packed(out.collect(), 2048) > 0
    assert contamination.Automaton([]).least == 0
