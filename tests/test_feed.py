"""The feed's batches and its resumption, and a sink that nothing of a failed job is seen of."""

import os

import pytest

from corpusloom.sources import archives, feed


def write_files(folder, names):
    folder.mkdir(exist_ok=True)
    for k, name in enumerate(names):
        (folder / name).write_text(f"{name}\n" * (k + 1))
        os.utime(folder / name, ns=(10**18 + ord(name[0]) * 10**9,) * 2)


def test_feed_admits_files_and_goes_on(spark, tmp_path):
    source, seen = tmp_path / "in", []
    write_files(source, ["c.txt", "a.txt", "b.txt", "skip.csv", "_hidden.txt"])

    def handle(df, batch):
        seen.append((batch, sorted({r["value"] for r in df.collect()})))

    def run(handler=handle, **options):
        feed.run(spark, str(source), str(tmp_path / "checkpoint"), handler, "text", ending=".txt", **options)

    run(max_files=2)
    assert [s for _, s in seen] == [["a.txt", "b.txt"], ["c.txt"]]
    run(max_files=2)
    assert len(seen) == 2
    write_files(source, ["d.txt", "e.txt", "f.txt"])

    def failing(df, batch):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(failing, max_files=2)
    run(max_files=1)
    assert [s for _, s in seen[2:]] == [["d.txt", "e.txt"], ["f.txt"]]  # the batch that was lost has the same files
    write_files(source, ["g.txt", "h.txt"])
    run(max_bytes=1)
    assert [s for _, s in seen[4:]] == [["g.txt"], ["h.txt"]] and len({b for b, _ in seen}) == 6


def test_token_files_of_failed_jobs_are_not_seen(spark, tmp_path):
    from pyspark.sql import functions as F

    out = str(tmp_path / "tokens")
    rows = spark.range(40, numPartitions=4).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("int"), F.lit(7)).alias("tokens"))
    archives.write_token_stream(rows, out)
    read = lambda: sorted(tuple(r["tokens"]) for r in spark.read.format("token_stream").option("path", out).load().collect())
    assert read() == [(i, 7) for i in range(40)]
    bad = rows.withColumn("tokens", F.when(F.col("doc_id") == 35, F.array(F.raise_error(F.lit("broken")).cast("int"))).otherwise(F.col("tokens")))
    with pytest.raises(Exception, match="broken"):
        archives.write_token_stream(bad, out)
    assert read() == [(i, 7) for i in range(40)] and not list((tmp_path / "tokens").glob("*.part"))
    told = [line.split(",") for p in (tmp_path / "tokens").glob("*.csv") for line in p.read_text().split()]
    assert sum(int(x[1]) for x in told) == 40 and sum(int(x[2]) for x in told) == 80 and len(told) == 4
