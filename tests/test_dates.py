from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimspark.functions.dates import wall_clock

CASES = {
    "2020-12-31T22:00:00-05:00": ("2020-12-31 22:00", "2021-01-01 03:00"),
    "2020-12-31T22:00:00.250-0500": ("2020-12-31 22:00", "2021-01-01 03:00"),
    "2021-03-14 02:30:00Z": ("2021-03-14 02:30", "2021-03-14 02:30"),
    "2021-03-14T02:30": ("2021-03-14 02:30", "2021-03-14 02:30"),
    "2021-11-07T01:30+05:30": ("2021-11-07 01:30", "2021-11-06 20:00"),
    "2024-01-05": ("2024-01-05 00:00", "2024-01-05 00:00"),
    "2021-01-01T00:00:00+25:00": (None, None),
    "ayer": (None, None),
    "": (None, None),
}


@pytest.mark.parametrize("session", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_wall_clock(spark, session):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        df = spark.createDataFrame([(k,) for k in CASES], "t string")
        shown = [F.substring(wall_clock(F.col("t"), z).cast("string"), 1, 16).alias(z) for z in ("local", "UTC")]
        got = {r.t: (r.local, r.UTC) for r in df.select("t", *shown).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == CASES


def test_named_zone(frame):
    row = frame("t string", [("2020-07-01T03:00:00Z",)]).select(
        wall_clock(F.col("t"), "America/Bogota").cast("string").alias("b")
    ).first()
    assert row.b == "2020-06-30 22:00:00"
