"""Queries on odd texts against their SQL in DuckDB."""

import math

import duckdb
import pytest

from corpusloom.plans import registry

TEXTS = [None, "", " ", "\n", "\n\n\n\n\n\n", "\x0b", "a\x0bb", "x\r\ny\r\n", "a\x85b\u2028c\x1cd\n", "CONF\u0130G", "a\n\u212a\nUN\u0130T TESTS\n", "\u0870\u1e4f0\U0001e4f0\U00031350", "e\u0301\u200b\u00a0\u2029\ufeff", "12 a_b-c\tD"]


@pytest.mark.parametrize("name", ["code_quality", "tokenize_regex"])
def test_as_sql(spark, tmp_path, name):
    rows = [(i, t, (None, "en", "de")[i % 3], "s", None if t is None else len(t)) for i, t in enumerate(TEXTS + TEXTS[::-1])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    same = lambda r: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)
    got = registry.queries()[name](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(same, got)) == sorted(map(same, want.fetchall()))
