from __future__ import annotations

import numpy as np
import pytest

from claimspark.operators import metrics, profile
from claimspark.sources import tables

CLASSES = ("Cuestionable", "Falso", "Verdadero")
MATRIX = ((40, 49, 0), (61, 266, 9), (5, 9, 0))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(t, p) for i, t in enumerate(CLASSES) for j, p in enumerate(CLASSES) for _ in range(MATRIX[i][j])]
    return spark.createDataFrame(data, "label string, prediction string").cache()


@pytest.fixture(scope="module")
def cells(rows):
    return metrics.confusion_cells(rows).cache()


def test_matrix_keeps_zeros(cells):
    got = metrics.confusion_matrix(cells, CLASSES).orderBy("position").collect()
    assert tuple(tuple(r[c] for c in CLASSES) for r in got) == MATRIX


def test_published_scores(cells):
    f1 = {r.label: r.f1 for r in metrics.class_scores(cells).collect()}
    assert [round(f1[c], 3) for c in CLASSES] == [0.410, 0.806, 0.0]
    assert round(metrics.macro_f1(cells).first().macro_f1, 3) == 0.405


def test_published_interval(cells):
    ci = metrics.bootstrap_ci(cells).first()
    assert ci.low == pytest.approx(0.371, abs=0.005) and ci.high == pytest.approx(0.440, abs=0.005)
    assert metrics.bootstrap_ci(cells.repartition(5)).first() == ci


def test_predicted_only_class_counts(frame):
    cells = metrics.confusion_cells(frame("label string, prediction string", [("a", "a"), ("a", "b")]))
    assert metrics.macro_f1(cells).first().macro_f1 == pytest.approx((2 / 3 + 0) / 2)


def test_replicate_averages_present_classes(frame):
    cells = frame("replicate long, truth string, predicted string, n long", [(0, "a", "a", 2), (1, "a", "a", 1), (1, "a", "b", 1), (1, "b", "b", 2)])
    scores = {r.replicate: r.macro_f1 for r in metrics.macro_f1(cells, ["replicate"]).collect()}
    assert scores == {0: 1.0, 1: pytest.approx((2 / 3 + 4 / 5) / 2)}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_draws_are_multinomial_however_blocked(cells, block):
    drawn = metrics.bootstrap_cells(cells, 400, block=block).collect()
    assert {sum(r.n for r in drawn if r.replicate == i) for i in range(400)} == {439}
    for i, t in enumerate(CLASSES):
        for j, p in enumerate(CLASSES):
            counts = np.array([next((r.n for r in drawn if (r.replicate, r.truth, r.predicted) == (k, t, p)), 0) for k in range(0, 400, 4)])
            share = MATRIX[i][j] / 439
            assert abs(counts.mean() - 439 * share) <= 4.5 * (439 * share * (1 - share) / 100) ** 0.5
            if MATRIX[i][j] > 40:
                assert counts.var() == pytest.approx(439 * share * (1 - share), rel=0.6)


def test_blocks_share_their_draws():
    edges = np.array([0, 5, 6, 20, 100])
    for replicate in range(50):
        parts = [metrics.drawn_total(edges, b, 70, 1, replicate) for b in range(4)]
        assert sum(parts) == 70 and min(parts) >= 0


def test_thousands_of_classes(spark):
    rows = spark.range(3000).selectExpr("concat('c', id) AS truth", "concat('c', id + id % 2) AS predicted", "id % 5 AS n")
    low, high = metrics.bootstrap_ci(rows, 20).first()
    assert 0 < low < high < 1


def test_groups_share_one_table(rows, cells, frame):
    both = rows.withColumn("split", rows["label"]).unionByName(rows.selectExpr("label", "prediction", "'all' AS split"))
    grouped = metrics.confusion_cells(both, by=["split"])
    assert metrics.macro_f1(grouped, ["split"]).filter("split = 'all'").first().macro_f1 == metrics.macro_f1(cells).first().macro_f1
    report = metrics.classification_report(grouped, ["split"])
    assert sorted(map(tuple, report.filter("split = 'all'").drop("split").collect())) == sorted(map(tuple, metrics.classification_report(cells).collect()))
    assert report.filter("split = 'Falso' and label = 'accuracy'").first().f1 == pytest.approx(266 / 336)


def test_report_summary_rows(cells):
    r = {x.label: x for x in metrics.classification_report(cells).collect()}
    assert r["accuracy"].f1 == pytest.approx(306 / 439) and r["weighted avg"].recall == pytest.approx(306 / 439)
    assert r["macro avg"].support == 439


def test_metrics_document(spark, rows, tmp_path):
    doc = metrics.evaluate(rows, "test", CLASSES, replicates=200)
    tables.write_document(doc, str(tmp_path / "m"))
    read = tables.read_document(spark, str(tmp_path / "m"), doc.schema).first()
    assert (read.split, read.n, read.macro_f1) == ("test", 439, 0.4054)
    assert read.confusion_matrix.rows_true == [list(r) for r in MATRIX] and read.confusion_matrix.labels == list(CLASSES)
    assert read.per_class_f1 == {"Cuestionable": 0.4103, "Falso": 0.8061, "Verdadero": 0.0}


def test_errors_and_comparison(frame):
    df = frame("id int, label string, prediction string", [(3, "a", "b"), (1, "a", "a"), (2, "b", None), (4, "b", "a")])
    assert [r.id for r in metrics.first_errors(df, "id", 2).collect()] == [2, 3]
    scores = frame("model string, split string, macro_f1 double", [("m", "val", 0.4), ("m", "test", 0.3), ("n", "val", 0.9)])
    assert [(r.model, r.split) for r in metrics.compare_models(scores).collect()] == [("m", "val"), ("m", "test")]


def test_null_rules(frame):
    df = frame("verdict string, rating string", [(None, None), ("x", None), ("x", "x"), ("x", "y")])
    assert profile.disagreement_count(df).first().n == 3
    assert profile.disagreements(df).count() == 3


def test_density_integrates_to_class_share(frame):
    rng = np.random.default_rng(0)
    data = [("a", int(x)) for x in rng.integers(1, 30, 300)] + [("b", int(x)) for x in rng.integers(5, 9, 100)] + [("c", 4)]
    rows = profile.length_density(frame("label string, n_words int", data)).collect()
    for label, share in (("a", 300 / 401), ("b", 100 / 401)):
        points = sorted((r.x, r.density) for r in rows if r.label == label)
        x, y = np.array(points).T
        assert len(x) == 200 and np.trapezoid(y, x) == pytest.approx(share, rel=0.01)
    assert {r.label for r in rows} == {"a", "b"}


def test_approximate_description(frame):
    df = frame("x int", [(i,) for i in range(1001)])
    exact, near = profile.describe(df, "x").first(), profile.describe(df, "x", approx=True).first()
    assert exact.p50 == 500 and near.p90 == pytest.approx(exact.p90, abs=1)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001])
def test_percentiles_of_doubles(spark, n):
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.normal(0, 1e6, n), rng.integers(0, 3, n // 2)]).tolist()
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(5)
    found = {r.share: r.value for r in profile.percentiles(df, "x", (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)).collect()}
    assert found == {p: pytest.approx(np.percentile(values, 100 * p)) for p in found} and len(found) == 6


def test_description_of_nothing(frame):
    row = profile.describe(frame("x double", []), "x").first()
    assert row["count"] == 0 and row.p50 is None and row.max is None
