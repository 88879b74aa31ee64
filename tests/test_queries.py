"""Every query against its SQL, and that none of them is empty or all zeros."""

import subprocess
import sys

import duckdb
import pytest

from prosaic.plans import registry
from tests.conftest import ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)


KEYS = {"q_slop_score": ["tier1", "tier2_clusters", "tier3", "tells", "tics", "telling", "dashes", "transitions", "slop_penalty"], "q_fingerprint": ["abstract_per_1k", "well_body_pct", "section_breaks", "the_way_count", "he_start_pct", "simile_density", "dialogue_ratio"]}


@pytest.mark.parametrize("name", list(KEYS))
def test_detectors_are_not_vacuous(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert all((got[c] > 0).any() for c in KEYS[name])


def test_entry_point_without_the_subpackage(tmp_path):
    """The entry point imports, and keeps the other queries, where the optional folder is missing."""
    for item in ("prosaic", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / item), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "prosaic" / "llm")], check=True)
    code = "import __spark_entry__ as e; assert 'q_slop_score' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
