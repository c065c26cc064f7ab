from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimspark.functions import labels, text, urls


def one(spark, fn, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(fn(*[F.col(n) for n in names]).alias("v")).first().v


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Chequeo del martes: verdadero pero incompleto", "Verdadero pero"),
        ("Falso. El puente no se cayó; falso también el video", "Falso"),
        ("La lluvia llegó temprano a la costa", None),
        ("CHEQUEO MÚLTIPLE: algo", "Chequeo Múltiple"),
        ("falsos amigos", None),
        ("Falso: es verdadero que algo", "Verdadero"),
        ("ñFalso", None),
        ("Falso_", None),
        ("(falso)", "Falso"),
    ],
)
def test_detect_label(spark, value, expected):
    assert one(spark, labels.detect_label, value) == expected


@pytest.mark.parametrize(
    "value, label, expected",
    [
        ("Falso Falso: algo", "Falso", ": algo"),
        ("FALSO  falso algo Falso", "Falso", "algo Falso"),
        ("chequeo múltiple Chequeo Múltiple x", "Chequeo Múltiple", "x"),
        ("algo Falso", "Falso", "algo Falso"),
    ],
)
def test_strip_badge(spark, value, label, expected):
    assert one(spark, labels.strip_badge, value, label) == expected


def test_rewrite_in_sequence(spark):
    def merged(c):
        return labels.rewrite(c, {"a...": "a"}, {"a": "b"})

    assert [one(spark, merged, v) for v in ("a...", "a", "b", "z", None)] == ["b", "b", "b", "z", None]


def test_normalize_and_tokens(spark):
    assert one(spark, text.normalize, "¡Qué  PINGÜINO-ñandú, 3º_x!\xa0\u2003") == "que  pinguinoñandu 3º_x\xa0\u2003"
    got = one(spark, lambda c: text.tokens(c, ["más", "para"]), "Mas para el niño, Año 2020 está MÁS a1b cañón")
    assert got == ["niño", "año", "esta", "cañon"]


SPACES = " \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u3000"


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="añb.,_1" + SPACES, max_size=25), min_size=40, max_size=40))
def test_white_space_rules(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    rows = df.select("i", text.words(F.col("t")).alias("w"), text.word_count(F.col("t")).alias("n"),
                     text.squeeze(F.col("t")).alias("q"), text.strip_space(F.col("t")).alias("s"),
                     text.is_multiword(F.col("t")).alias("m"), text.is_single_word(F.col("t")).alias("o")).collect()
    for r in rows:
        t = values[r.i]
        assert (r.w, r.n, r.q, r.s) == (t.split(), len(t.split()), " ".join(t.split()), t.strip())
        assert (r.m, r.o) == (len(t.split()) > 1, len(t.split()) == 1)


def test_spanish_list_is_available(spark):
    words = text.spanish_stopwords(spark)
    assert "que" in words and "mas" in text.plain_stopwords(["más"])


@pytest.mark.parametrize(
    "href", ["/a/b?x=1#y", "https://z.example/q", "//cdn.example/x", "c/d", "../up", "./here", "/a/../b", "?q=1", "#top", "mailto:a@b.c", ""],
)
@pytest.mark.parametrize("base", ["https://s.example", "https://s.example/x/y?z=1"])
def test_absolute_url(spark, href, base):
    from urllib.parse import urljoin

    assert one(spark, lambda c: urls.absolute_url(c, base), href) == urljoin(base, href)


def test_page_key(spark):
    assert one(spark, urls.page_key, "https://a.example/b?c=ñ") == "https_a_example_b_c_.html"
    assert len(one(spark, urls.page_key, "x" * 400)) == 155
