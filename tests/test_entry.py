import duckdb

import __spark_entry__ as E
from tools.check_oracle import rows

SF = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "rule_id" in df.columns


def test_every_query_matches_its_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    bad = []
    for name, fn in qs.items():
        sp = fn(spark, SF).toPandas()
        if name not in sql:
            continue
        dk = con.execute(sql[name]).df()
        cols = sorted(sp.columns)
        if cols != sorted(dk.columns) or rows(sp, cols) != rows(dk, cols):
            bad.append(name)
    assert bad == []


def test_library_stands_without_the_training_data_subpackage(tmp_path):
    """A copy without those folders still imports, and its queries are the rest."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(E.__file__).parent
    shutil.copytree(root / "vigil", tmp_path / "vigil", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'detect_builtin' in q, 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)},
                         capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[2:] == ["True", "False"] and out.stdout.split()[0] == out.stdout.split()[1], out.stderr[-800:]
