from __future__ import annotations

import json

import pytest

from claimspark import domain
from claimspark.operators import harvest, listing
from claimspark.sources import tables
from claimspark.streaming import harvest as stream

SITE = "https://s.example"


def claim(url, text=None, seq=0, verdict="Falso"):
    return (url, verdict, text, None, None, None, False, seq)


CLAIMS = "url string, verdict string, claim_reviewed string, rating string, pub_date string, jsonld_types string, has_claimreview boolean, seq long"


def test_targets_pending_and_head(frame):
    cards = frame("url string, verdict string, seq long", [("a", "x", 2), ("a", "y", 1), ("b", "z", 3), ("c", None, 4)])
    targets = harvest.load_targets(cards)
    assert {(r.url, r.verdict) for r in targets.collect()} == {("a", "y"), ("b", "z"), ("c", None)}
    done = frame(CLAIMS, [claim("a", "text"), claim("b")])
    assert [r.url for r in harvest.pending(targets, done).collect()] == ["c"]
    assert {r.url for r in harvest.pending(targets, done, retry_failed=True).collect()} == {"b", "c"}
    assert [r.url for r in harvest.head(targets, 2).collect()] == ["a", "b"]


def test_upsert_is_idempotent(frame):
    done = frame(CLAIMS, [claim("a", "old", 1), claim("b", "kept", 2)])
    new = frame(CLAIMS, [claim("a", "mid", 3), claim("a", "new", 4), claim("c", None, 5)])
    columns = [*domain.CLAIM_COLUMNS, "seq"]
    once = harvest.upsert(done, new, order="seq", columns=columns)
    expected = {("a", "new"), ("b", "kept"), ("c", None)}
    assert {(r.url, r.claim_reviewed) for r in once.collect()} == expected
    twice = harvest.upsert(once, new, order="seq", columns=columns)
    assert {(r.url, r.claim_reviewed) for r in twice.collect()} == expected
    row = harvest.progress(once).first()
    assert (row.n_rows, row.n_filled, row.fill_share) == (3, 2, 2 / 3)
    assert harvest.progress(once.limit(0)).first().fill_share == 0


def review(text):
    body = json.dumps({"@type": "ClaimReview", "claimReviewed": text})
    return f'<script type="application/ld+json">{body}</script>'


def test_missing_page_gives_nulls(frame):
    targets = frame("url string, verdict string", [("a", "x"), ("b", "y")])
    pages = frame("url string, html string", [("a", review("t"))])
    rows = {r.url: r for r in harvest.harvest(targets, pages).collect()}
    assert rows["a"].claim_reviewed == "t" and rows["a"].has_claimreview is True
    assert rows["b"].claim_reviewed is None and rows["b"].has_claimreview is False


def test_stream_resumes_and_equals_batch(spark, frame, tmp_path):
    drops, log, checkpoint = (str(tmp_path / n) for n in ("drops", "log", "cp"))
    targets = frame("url string, verdict string", [("a", "x"), ("b", "y"), ("c", "z")])

    def drop(name, rows):
        frame("url string, html string", rows).coalesce(1).write.parquet(f"{drops}/{name}")

    def run():
        query = stream.run_harvest(spark, f"{drops}/*", targets, log, checkpoint)
        query.awaitTermination()
        return {(r.url, r.claim_reviewed) for r in stream.current_claims(spark, log).collect()}

    drop("one", [("a", review("first")), ("b", review("b")), ("unknown", review("u"))])
    assert run() == {("a", "first"), ("b", "b")}
    drop("two", [("a", review("second")), ("c", "<p>no markup</p>")])
    expected = {("a", "second"), ("b", "b"), ("c", None)}
    assert run() == expected
    files = sorted(str(p) for p in tmp_path.rglob("log/**/*.parquet"))
    assert run() == expected and sorted(str(p) for p in tmp_path.rglob("log/**/*.parquet")) == files
    stream.compact(spark, log, str(tmp_path / "base"))
    assert {(r.url, r.claim_reviewed) for r in stream.current_claims(spark, str(tmp_path / "base")).collect()} == expected


def test_a_batch_rewrites_its_own_buckets(spark, frame, tmp_path):
    drops, table, checkpoint = (str(tmp_path / n) for n in ("drops", "table", "cp"))
    targets = frame("url string, verdict string, seq long", [(f"u{i}", "x", i) for i in range(400)])

    def run(**options):
        stream.run_harvest(spark, f"{drops}/*", targets, table, checkpoint, buckets=64, **options).awaitTermination()
        return {r.url: r.claim_reviewed for r in stream.current_claims(spark, table).collect()}

    def written(gen):
        return sum(p.stat().st_size for p in tmp_path.glob(f"table/gen={gen}/**/*.parquet"))

    frame("url string, html string", [(f"u{i}", review(f"text {i}")) for i in range(300)]).write.parquet(f"{drops}/one")
    assert len(run()) == 300
    frame("url string, html string", [("u7", review("changed")), ("u8", None)]).coalesce(1).write.parquet(f"{drops}/two")
    got = run()
    assert len(got) == 300 and got["u7"] == "changed" and got["u8"] is None and got["u9"] == "text 9"
    assert 0 < written(1) < written(0) / 10
    # With a limit only the first targets that are still missing count.
    frame("url string, html string", [(f"u{i}", review("late")) for i in range(300, 400)]).write.parquet(f"{drops}/three")
    assert sorted(set(run(limit=3)) - set(got)) == ["u300", "u301", "u302"]


def csv_rows(spark, path, **options):
    return sorted(map(tuple, tables.read_table(spark, path, **options).collect()), key=str)


def test_large_csv_is_cut_at_record_ends(spark, frame, tmp_path):
    import random

    rng = random.Random(2)
    cells = ['a "quoted", word', "two\nlines\n\n", "", '"', "plain", ",", "\n" * 40, "é漢🙂" * 30, '""\n"', None]
    rows = [(f"u{i}", *[rng.choice(cells) for _ in range(5)], rng.choice([True, False, None])) for i in range(3000)]
    rows += [("long", "x\n" * 30_000, "end", None, None, None, True)]  # over several byte ranges
    frame(CLAIMS.rsplit(",", 1)[0], rows).coalesce(1).write.options(header=True, quote='"', escape='"', emptyValue="").csv(str(tmp_path / "c"))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = csv_rows(spark, str(tmp_path / "c"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        records = tables.csv_records(spark, str(tmp_path / "c"))
        assert records.select("start").distinct().count() > 8
        assert csv_rows(spark, str(tmp_path / "c")) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    texts = ", ".join(f"{c} string" for c in domain.CLAIM_COLUMNS)
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"').schema(texts).csv(str(tmp_path / "c"))
    plain = reader.select(*[tables.na_to_null(reader[c]).alias(c) for c in reader.columns[:-1]])
    assert sorted((r[:-1] for r in whole), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert len(whole) == 3001


def test_csv_columns_go_by_name(spark, tmp_path):
    names = list(domain.CLAIM_COLUMNS)
    for i, order in enumerate((names, names[::-1], ["extra", *names[3:], *names[:3]])):
        body = ",".join(order) + "\r\n" + ",".join(f'"{c} {i}\n"' if c != "has_claimreview" else "true" for c in order) + "\r\n"
        (tmp_path / f"f{i}.csv").write_bytes(("\ufeff" * (i == 0) + body).encode())
    rows = tables.read_table(spark, str(tmp_path)).collect()
    assert sorted((r.url, r.jsonld_types, r.has_claimreview) for r in rows) == [(f"url {i}\n", f"jsonld_types {i}\n", True) for i in range(3)]
    (tmp_path / "f3.csv").write_text("url,verdict\na,b\n")
    with pytest.raises(ValueError, match="rating"):
        tables.read_table(spark, str(tmp_path))


@pytest.mark.parametrize(
    "counts, max_pages, stop",
    [
        ({0: 5, 1: 0, 2: 3, 3: 0, 4: 0, 5: 4}, 1000, 4),
        ({0: 5, 1: 2, 3: 9}, 1000, 2),
        ({1: 2}, 1000, 0),
        ({}, 1000, 0),
        ({0: 1, 1: 1, 2: 1}, 2, 2),
        ({0: 0, 1: 0, 2: 5}, 1000, 1),
        ({0: 0, 1: 1, 2: 0, 3: 1}, 4, 4),
    ],
)
def test_archive_end(frame, counts, max_pages, stop):
    df = frame("listing_page long, n_cards long", list(counts.items()))
    assert listing.archive_end(df, max_pages).first().stop == stop


def card(href, text):
    return f'<a href="{href}">{text}</a>'


def test_listing(frame):
    body = "una afirmación bastante larga sobre algo"
    pages = [
        (0, card("/check/a?x#y", f"Falso Falso {body}") + card("/check/nav", "x" * 29) + card("/other/b", body)),
        (1, card(f"{SITE}/check/a?x#y", f"Verdadero {body}") + card("/check/c", "x" * 30)),
        (2, ""),
        (3, card("/check/d", f"Chequeo múltiple: {body}")),
        (5, card("/check/late", body)),
    ]
    rows = listing.listing_cards(frame("listing_page long, html string", pages), SITE, r"/check/[^?#]+").collect()
    got = {(r.url, r.verdict, r.card_text, r.listing_page) for r in rows}
    assert got == {
        (f"{SITE}/check/a?x#y", "Falso", body, 0),
        (f"{SITE}/check/c", None, "x" * 30, 1),
        (f"{SITE}/check/d", "Chequeo Múltiple", f": {body}", 3),
    }


def test_url_choice(frame):
    cards, site = frame("url string", [("l",)]), frame("url string", [("s",)])
    assert listing.choose_urls(cards, site).first().url == "l"
    assert listing.choose_urls(cards.limit(0), site).first().url == "s"


def test_csv_round_trip(spark, frame, tmp_path):
    rows = [("u1", "Falso", 'dos\nlíneas, "y" más', "None", "", None, True), ("u2", None, "NA", "x", "d", "t", None)]
    schema = CLAIMS.rsplit(",", 1)[0]
    path = str(tmp_path / "claims")
    tables.write_table(frame(schema, rows), path, domain.CLAIM_COLUMNS, "csv")
    got = {r.url: r for r in tables.read_table(spark, path).collect()}
    assert got["u1"].claim_reviewed == rows[0][2] and got["u1"].rating is None and got["u1"].pub_date is None
    assert got["u2"].claim_reviewed is None and got["u2"].has_claimreview is None and got["u1"].has_claimreview is True
    with pytest.raises(FileNotFoundError, match="harvest first"):
        tables.read_table(spark, str(tmp_path / "absent"), hint="harvest first")


def test_stream_leaves_null_rows_for_failed_pages(spark, frame, tmp_path):
    drops, log, checkpoint = (str(tmp_path / n) for n in ("drops", "log", "cp"))
    targets = frame("url string, verdict string", [("a", "x"), ("b", "y")])
    pages = frame("url string, html string", [("a", review("t")), ("a", None), ("b", None)])
    pages.coalesce(1).write.parquet(f"{drops}/one")
    stream.run_harvest(spark, f"{drops}/*", targets, log, checkpoint).awaitTermination()
    rows = {(r.url, r.verdict, r.claim_reviewed, r.has_claimreview) for r in stream.current_claims(spark, log).collect()}
    assert rows == {("a", "x", "t", True), ("b", "y", None, False)}
