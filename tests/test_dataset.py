from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimspark import domain
from claimspark.operators import dataset, features

SCHEMA = "seq long, url string, claim_reviewed string, rating string, pub_date string"
SIZES = {"Cuestionable": 23, "Falso": 57, "Verdadero": 19}
WHO = ("La alcaldesa", "Un meteorólogo", "El sindicato", "Una vecina")
DID = ("vio", "midió", "anunció", "negó", "compró")


def sentences(n):
    """Different texts of several words."""
    return [f"{WHO[i % 4]} {DID[i // 4 % 5]} {i} barcos azules" for i in range(n)]


@pytest.fixture(scope="module")
def raw(spark):
    labels = [label for label, n in SIZES.items() for _ in range(n)]
    claims = list(zip(sentences(len(labels)), labels))
    claims += [
        ("El río creció, aunque no tanto", "Verdadero pero..."),
        ("El río creció, aunque menos", "Verdadero pero"),
        ("barcos", "Falso"),
        ("\u2003barcos\n", "Falso"),
        ("", "Verdadero"),
        (" \t ", "Cuestionable"),
        (None, "Cuestionable"),
        ("Una mezcla de varias cosas", "Chequeo Múltiple"),
        ("Sin veredicto alguno", None),
        ("EL RÍO CRECIÓ, AUNQUE MENOS", "Falso"),  # other letters, so another text
        (claims[5][0], claims[5][1]),
        (claims[-1][0], "Falso"),  # a copy under another label: the first row counts
    ]
    rows = [(i * 3, f"https://notas.example/{i}", t, r, f"2022-0{i % 9 + 1}-11T09:30:00-05:00") for i, (t, r) in enumerate(claims)]
    return spark.createDataFrame(rows[::-1], SCHEMA)  # the order is in `seq`, not in the rows


@pytest.fixture(scope="module")
def built(raw):
    return dataset.build_dataset(raw).cache()


def test_rows_per_class(built):
    assert Counter(r.label for r in built.collect()) == {"Falso": 58, "Cuestionable": 23, "Verdadero": 21}


def test_both_nuanced_ratings_are_merged(built):
    rows = built.filter("text like 'El río creció%'").collect()
    assert [r.label for r in rows] == ["Verdadero"] * 2


def test_texts_of_one_word_or_none_and_strays_are_gone(built):
    texts = [r.text for r in built.collect()]
    assert all(t and len(t.split()) > 1 for t in texts)
    assert not any("mezcla" in t or "Sin veredicto" in t for t in texts)


def test_first_copy_stays(built):
    copies = {r.text: (r.seq, r.label) for r in built.collect()}
    known = sentences(sum(SIZES.values()))
    assert copies[known[5]] == (15, "Cuestionable") and copies[known[-1]] == (98 * 3, "Verdadero")


def test_binary_label_follows_the_class(built):
    pairs = {(r.label, r.label_binary) for r in built.collect()}
    assert pairs == {("Falso", "Falso"), ("Cuestionable", "no-Falso"), ("Verdadero", "no-Falso")}


def test_split_counts_are_exact(built):
    rows = dataset.add_splits(built).collect()
    counts = Counter((r.label, r.split) for r in rows)
    for label, n in Counter(r.label for r in rows).items():
        train, val = round(n * 0.7), round(n * 0.15)  # half to even, as the split rounds
        assert [counts[label, s] for s in ("train", "val", "test")] == [train, val, n - train - val]
    assert len({r.text for r in rows}) == len(rows) == 102


def test_equal_keys_are_split_exactly(frame):
    df = frame("text string, label string", [("same", "Falso")] * 20 + [("same", None)] * 10 + [(None, "otra")] * 10)
    rows = dataset.add_splits(df).groupBy("label", "split").count().collect()
    sizes = {"Falso": (14, 3, 3), None: (7, 2, 1), "otra": (7, 2, 1)}
    assert {(r.label, r.split): r["count"] for r in rows} == {
        (label, s): n for label, own in sizes.items() for s, n in zip(("train", "val", "test"), own)
    }


def test_summary_tells_totals_from_nulls(frame):
    df = frame("split string, label string", [("train", None), ("train", "a"), ("val", "a")])
    rows = {(r.split, r.label, r.totals): r.n for r in dataset.split_summary(df).collect()}
    assert rows == {
        ("train", None, 0): 1, ("train", "a", 0): 1, ("val", "a", 0): 1, ("train", None, 1): 2, ("val", None, 1): 1,
        (None, None, 2): 1, (None, "a", 2): 2, (None, None, 3): 3,
    }


def test_split_does_not_depend_on_partitioning(built):
    def splits(df):
        return {(r.text, r.split) for r in dataset.add_splits(df).collect()}

    once = splits(built)
    assert once == splits(built.repartition(13)) == splits(built.orderBy(F.rand(3)))
    other = {(r.text, r.split) for r in dataset.add_splits(built, seed=7).collect()}
    assert other != once


def test_published_split_sizes(frame):
    labels = ["Falso"] * 2245 + ["Cuestionable"] * 597 + ["Verdadero"] * 93
    df = frame("text string, label string", [(f"t{i}", c) for i, c in enumerate(labels)])
    rows = dataset.add_splits(df).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in rows} == {"train": 2055, "val": 441, "test": 439}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 11])
def test_small_strata(frame, n):
    df = frame("text string, label string", [(f"x{i}", "Falso") for i in range(n)])
    counts = Counter(r.split for r in dataset.add_splits(df).collect())
    train, val = round(n * 0.7), round(n * 0.15)
    assert (counts["train"], counts["val"], counts["test"]) == (train, val, n - train - val)


def test_coarse_buckets_give_the_same_cut(built):
    from claimspark.operators.keyed import stratified_cut

    def cut(digits):
        df = stratified_cut(built, "label", "text", domain.SPLITS, digits=digits)
        return {(r.text, r.split) for r in df.collect()}

    assert cut(1) == cut(4) == cut(8)


def test_written_dataset_equals_the_lazy_one(spark, raw, tmp_path):
    path = str(tmp_path / "dataset")
    dataset.build_processed(raw, path)
    read = spark.read.parquet(path)
    assert set(read.columns) == set(domain.DATASET_COLUMNS)
    lazy = {(r.text, r.split) for r in dataset.build_processed(raw).collect()}
    assert {(r.text, r.split) for r in read.collect()} == lazy


def test_classes_are_alphabetical():
    assert list(domain.CLASSES) == sorted(domain.LABELS)


def test_all_unknown_labels_are_named(frame):
    names = [f"clase {i}" for i in range(30)]
    bad = frame("text string, label string", [("x", n) for n in [*names, None, "Falso"]])
    with pytest.raises(ValueError) as error:
        dataset.with_label_ids(bad)
    assert all(repr(n) in str(error.value) for n in [*names, "None"]) and "Falso" not in str(error.value)


def test_class_weights(frame):
    df = frame("label string", [("a",), ("a",), ("b",), ("c",)])
    rows = {r.label: r.weight for r in features.class_weights(df, ["a", "b", "c", "d"]).collect()}
    assert rows == {"a": 4 / 8, "b": 1.0, "c": 1.0, "d": None}
    three = features.class_weights(df, ["a", "b", "c"]).orderBy("label_id").collect()
    assert [r.weight for r in three] == pytest.approx([4 / 6, 4 / 3, 4 / 3])


def test_rarest_class_weighs_most(frame):
    df = frame("label string", [("a",)] * 90 + [("b",)] * 9 + [("c",)])
    w = [r.weight for r in features.class_weights(df, ["a", "b", "c"]).orderBy("label_id").collect()]
    assert w[2] > w[1] > w[0]


def test_chronological_zone_and_bad_dates(frame):
    df = frame("seq long, date string", [(1, "2020-12-31T22:00:00-05:00"), (2, "not a date"), (3, "2019-01-01T00:00:00Z")])
    local = dataset.chronological(df).collect()
    assert [r.seq for r in local] == [3, 1, 2] and local[2].date is None
    assert local[1].date.year == 2020
    utc = {r.seq: r.date for r in dataset.chronological(df, zone="UTC").collect()}
    assert (utc[1].year, utc[1].hour) == (2021, 3)
