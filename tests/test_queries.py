"""Every registered query outside llm against its SQL on the smallest tables, and the entry points."""

import importlib
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog = importlib.import_module("lexloom.catalog")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def norm(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in catalog.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    order = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == sorted(tuple(norm(r[i]) for i in order) for r in want.fetchall())


def test_interleaved_dictionary_beyond_one_ranking(spark, tmp_path):
    """More different words than a ranking holds: both rankings count, and no word of theirs is cut from what they make."""
    name = "interleaved_dictionary"
    con = duckdb.connect()
    letters = "translate(lpad({}::VARCHAR, 7, '0'), '0123456789', 'abcdefghij')"
    text = f"SELECT i // 5000 AS {{}}, string_agg({letters.format('i')}, ' ' ORDER BY i) AS text FROM range({{}}, {{}}) r(i) GROUP BY ALL"
    for t, key, low, high in (("documents", "doc_id", 0, 1_000_300), ("benchmark", "item_id", 999_900, 1_000_700)):
        con.sql(f"COPY ({text.format(key, low, high)}) TO '{tmp_path}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).fetchall()
    assert len(want) > 1_000_000 + 16
    catalog.queries()[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/got.parquet")
    assert con.sql(f"SELECT word_idx, word FROM '{tmp_path}/got.parquet/*.parquet' ORDER BY word_idx").fetchall() == sorted(want)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())


def test_nothing_outside_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for d, _, files in os.walk(os.path.join(root, "lexloom")):
        if os.path.basename(d) != "llm":
            assert all("lexloom.llm" not in open(os.path.join(d, f)).read() for f in files if f.endswith(".py"))
