"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents labels pages embeddings lineitem orders events"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(r[i] for i in order) for r in rows]
    return sorted(picked, key=lambda t: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in t))


def test_entry_and_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    expected = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(df.columns)
    assert _sorted([tuple(r) for r in df.collect()], df.columns) == _sorted(expected.fetchall(), columns)


@pytest.mark.parametrize("name", ["bootstrap_interval"])
def test_query_without_sql(spark, name):
    assert driver.queries()[name](spark, SF_DIR).count() > 0


def test_models_do_their_whole_job(spark, monkeypatch):
    from claimspark.operators import classify
    from claimspark.operators import vectors as neighbours

    given = []

    class Seen(Exception):
        pass

    def note(*args, **options):
        given.append(options)
        raise Seen

    for module, name, query in (
        (classify, "train_baseline", "baseline_predictions"),
        (classify, "grid_search", "grid_search_scores"),
        (neighbours, "word_vectors", "word_vector_frequencies"),
    ):
        monkeypatch.setattr(module, name, note)
        with pytest.raises(Seen):
            driver.queries()[query](spark, SF_DIR)
    assert not any({"max_iter", "epochs"} & set(o) for o in given)


def test_synthetic_rows_are_made(spark):
    counts = driver.queries()["smote_counts"](spark, SF_DIR)
    assert "synthetic-" in "".join(counts.inputFiles())  # the new rows were written, not only counted
    digests = driver.queries()["smote_digests"](spark, SF_DIR)
    assert digests.count() == sum(r.n_synthetic for r in counts.collect()) > 0
    whole = driver.queries()["ranked_class_scores_whole"](spark, SF_DIR)
    assert whole.count() == driver.queries()["ranked_class_scores"](spark, SF_DIR).count() > 0
