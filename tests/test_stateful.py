"""Near copies by keyed state against brute force over all documents, over restarts."""

import numpy as np

from corpusloom.operators import dedup
from corpusloom.streaming import stateful


def test_pairs_over_restarts(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(1)
    docs = []
    for i in range(24):
        ws = list(rng.choice(words, 40)) if i % 4 == 0 or not docs else docs[i - i % 4][1].split()
        if i % 4 in (1, 2):
            ws[rng.integers(40)] = "other"
        docs.append((i, " ".join(ws)))
    docs[23] = (23, None)
    batches = [docs[:8], docs[8:16], docs[16:], [docs[3], docs[9]]]
    schema = "doc_id long, text string"
    options = {"bands": 6, "rows": 2, "threshold": 0.6}
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k != 1:  # two batches in one run, then restarts
            stateful.run(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "checkpoint"), **options)
    sigs = {r["id"]: r["minhashes"] for r in dedup.signatures(spark.createDataFrame(docs, schema), k=12).collect()}
    buckets, want = {}, set()
    for part in batches:
        for i, _ in sorted(part):
            for b in range(6):
                held = buckets.setdefault((b, tuple(sigs[i][2 * b : 2 * b + 2])), [])
                share = [(j, float(np.mean(np.array(sigs[i]) == np.array(sigs[j])))) for j in held]
                want |= {(i, j, s) for j, s in share if s >= 0.6 and j != i}
                if not any(s == 1 for _, s in share):
                    held.append(i)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert want and got == want
