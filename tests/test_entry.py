"""The driver's contract: every query runs on the smallest tables, and those with SQL agree with it."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_and_a_few_queries_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("flagship_search", "index_coverage", "plain_statistics", "average_precision_of_hits", "row_runs", "near_point_pairs"):
        df = queries[name](spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        out = con.execute(sql[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        assert sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()) == got, name


def test_import_without_the_training_data_operators(tmp_path):
    """With the subpackage, its tests and the pipeline deleted, or the first two only, the rest imports and has its queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(root, "terravane"), copy / "terravane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    for pipeline in (False, True):
        if pipeline and os.path.exists(os.path.join(root, "corpus_pipeline.py")):
            shutil.copy(os.path.join(root, "corpus_pipeline.py"), copy)
        subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True)
