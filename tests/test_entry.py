import duckdb
import pytest

import __spark_entry__ as entry
from clausegraph.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v).removesuffix(".0") for v in row) for row in frame.astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bm25_topk", "expand_two_hop", "citation_status", "nearest_match", "mode_gap_divide", "vocab_expand"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert rows_of(registry.QUERIES[name](spark, SMALL).toPandas()) == rows_of(con.sql(registry.SQL[name]).df())


ODD = ['token = "a448b066" and more of it', 'he “said” “ "" \'so\' and went on”', '"', '""""', "", " ", "\u00a0 Ends in\u3000", "a\x0bb\x0b c d e f g h", "ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣΟΔΟΣ", "İstanbul ve İzmir  \t\n ŞEHİR", "back\\slash \\\" quoted", None, "plain words that are long enough to be cut", "“”", "x" * 50]


def odd_documents(tmp_path, spark):
    """Odd texts under their own, a shared and a null id."""
    rows = [(i if n == 0 else None if n == 1 else 7, t, "en" if i % 2 else None, "s", len(t or "")) for n in range(3) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return con


def test_quotes_missing_on_odd_texts_against_sql(spark, tmp_path):
    con = odd_documents(tmp_path, spark)
    got, want = registry.QUERIES["quotes_missing"](spark, str(tmp_path)).collect(), con.sql(registry.SQL["quotes_missing"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_quote_check_on_odd_texts_against_sql(spark, tmp_path):
    con = odd_documents(tmp_path, spark)
    quotes = [*ODD, "en", "kb", "ΟΔΟΣ ΟΔΟΣ", "οδοσ", "i\r\nzm", "and  MORE of i", "aid “", "ve\tİzmir şe", "b\x0b c d", "cut", "\u00a0long", "words that", "er the", "nowhere at all"]
    spark.createDataFrame(list(enumerate([*quotes, "words that"])), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con.sql(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    got, want = registry.QUERIES["quote_check"](spark, str(tmp_path)).collect(), con.sql(registry.SQL["quote_check"]).fetchall()
    assert want and sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_quote_check_reads_whole_texts_fast(spark, tmp_path):
    """A text of many words costs its length, not a copy of it for each of its words."""
    words = " ".join(f"w{i}" for i in range(200_000))
    spark.createDataFrame([(i, words, "en", "s", 1) for i in range(2)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "9998 w199999"), (2, "w5 w6 w7 W8\tw9"), (3, "w5 w7 w9")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = registry.QUERIES["quote_check"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert "explode" not in found._jdf.queryExecution().toString()
