"""The driver's contract, with and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
SOME = ["prj1_rail_trips", "agg2_regular_stations", "join13_next_departure", "agg14_never_worse", "win7_str6_latest_conditions", "str7_daily_counts"]


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_without_the_llm_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert not (copy / "stepspan" / "llm").exists() and not (copy / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    shutil.copy(ROOT / "corpus_pipeline.py", copy)  # the pipeline alone is no use, and no harm
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_reference_cases.py", "-k", "slugs or name_scores"], cwd=copy, check=True, timeout=300)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", SOME)
def test_some_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(f'\"{x}\"' for x in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{x}`" for x in cols]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
def test_the_matrix_breaks_no_rule(spark):
    """Trains take time between stops, so no journey is as fast as none; more options are never worse."""
    assert entry.queries()["dq1_dq3_matrix_checks"](spark, SMALL).collect() == []
