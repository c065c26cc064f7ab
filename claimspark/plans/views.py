"""Claim-shaped views over the test tables, so every query works on the tables' own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators.dataset import add_splits, build_dataset, build_processed, eda_view
from claimspark.operators.profile import with_length
from claimspark.session import scratch_path

SITE = "https://checks.example"
CARDS_PER_PAGE = 20
ARTICLE_DATE = "2020-06-15T08:00:00Z"
EARLIER_DATE = "2018-03-01T00:00:00Z"

# Stopwords of the registered queries: a fixed small list of function words.
STOPWORDS = (
    "como con del des die donde ein els entre est für han las les los más mit not para pero por "
    "que son sur the this und une von war was with"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts."""
    return table(spark, sf_dir, name)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    both = documents.join(labels, "doc_id", "left")
    return both.withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def _url() -> Column:
    return F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"))


def _rating() -> Column:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return (
        F.when(good & ~toxic, "Falso")
        .when(~good & ~toxic, "Cuestionable")
        .when(good & toxic, "Verdadero pero...")
        .when(~good & toxic, "Verdadero")
    )


def _published() -> Column:
    day = F.date_add(F.lit("2019-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int"))
    return F.concat(day.cast("string"), F.lit("T00:00:00-05:00"))


def _verdict() -> Column:
    lang = F.col("lang")
    return (
        F.when(lang == "en", "Falso")
        .when(lang == "es", "Cuestionable")
        .when(lang == "fr", "Verdadero")
        .when(lang == "de", "Verdadero pero")
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claims: a labelled document has a claim, the others lack it as a block."""
    return labelled_documents(spark, sf_dir).select(
        F.col("doc_id").alias("seq"),
        _url().alias("url"),
        _verdict().alias("verdict"),
        F.when(F.col("labelled"), F.col("text")).alias("claim_reviewed"),
        _rating().alias("rating"),
        _published().alias("pub_date"),
        F.when(F.col("labelled"), F.lit("ClaimReview|NewsArticle")).alias("jsonld_types"),
        F.col("labelled").alias("has_claimreview"),
    )


def exploratory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda_view(claims(spark, sf_dir))


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_dataset(claims(spark, sf_dir))


def split_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_splits(dataset(spark, sf_dir))


def frozen_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split dataset as training reads it: built once, written by split, read back."""
    path = scratch_path(spark, "dataset")
    build_processed(claims(spark, sf_dir), path)
    return spark.read.parquet(path)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset with its word counts."""
    return with_length(dataset(spark, sf_dir), "text")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a truth, a rule-made prediction and a two-way split."""
    quantity = F.col("l_quantity")
    guess = F.when(quantity < 17, "A").when(quantity < 34, "N").otherwise("R")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_returnflag").alias("label"),
        guess.alias("prediction"),
        F.when(F.col("l_linestatus") == "O", "val").otherwise("test").alias("split"),
    )


def _escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def _script(*fields: Column) -> Column:
    body = F.replace(F.to_json(F.struct(*fields)), F.lit("<"), F.lit("\\u003c"))
    return F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article pages made from the documents, one markup style per language and label state.

    Labelled: ``en`` one graph with review and article; ``fr`` an article block, then a review
    with a type list, a numeric rating and a list of authors; ``es`` a broken block, a stale
    review and the real one; ``de`` a review without a claim. Unlabelled: ``en`` meta tags only,
    ``fr`` an article, ``es`` a type that merely contains the review's name; ``de`` has no page.
    """
    docs = labelled_documents(spark, sf_dir)
    lang, labelled = F.col("lang"), F.col("labelled")

    def lit(value, name: str) -> Column:
        return F.lit(value).alias(name)

    def kind(name: str) -> Column:
        return lit(name, "@type")

    headline = F.concat(F.lit("Note "), F.col("doc_id").cast("string"))
    person = F.struct(kind("Person"), F.col("source").alias("name"))

    def item(author: Column) -> Column:
        return F.struct(kind("Claim"), author.alias("author")).alias("itemReviewed")

    def rated(*fields: Column) -> Column:
        return F.struct(kind("Rating"), *fields).alias("reviewRating")

    claim = F.col("text").alias("claimReviewed")
    review = F.struct(
        kind("ClaimReview"), claim, rated(_rating().alias("alternateName")), item(person),
        _published().alias("datePublished"),
    )
    # Structs of one array share a type, so both graph nodes carry all fields; nulls are left out.
    empty = F.lit(None).cast("string")
    graph = F.to_json(review), F.to_json(
        F.struct(
            kind("NewsArticle"), headline.alias("headline"), lit(ARTICLE_DATE, "datePublished"),
            F.array("lang", "source").alias("keywords"),
        )
    )
    en = F.concat(
        F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@graph":['),
        F.replace(F.concat_ws(",", *graph), F.lit("<"), F.lit("\\u003c")),
        F.lit("]}</script>"),
    )
    article = _script(
        kind("NewsArticle"), lit("", "headline"), lit(ARTICLE_DATE, "datePublished"),
        F.col("source").alias("keywords"),
    )
    fr = F.concat(
        article,
        _script(
            F.array(F.lit("ClaimReview"), F.lit("Review")).alias("@type"), claim,
            rated((F.col("quality") + 1).alias("ratingValue")), item(F.array(person)),
        ),
    )
    es = F.concat(
        F.lit('<script type="application/ld+json">{"@type": "ClaimReview", </script>'),
        _script(
            kind("ClaimReview"), lit("stale claim", "claimReviewed"), item(person),
            lit(EARLIER_DATE, "datePublished"),
        ),
        _script(
            kind("ClaimReview"), claim, rated(lit("", "alternateName")), item(F.array(person)),
            lit("", "datePublished"),
        ),
    )
    de = F.concat(
        _script(kind("ClaimReview"), rated(_rating().alias("alternateName")), item(F.struct(kind("Person"), empty.alias("name")))),
        _script(kind("Article"), headline.alias("headline"), _published().alias("datePublished")),
    )
    meta = F.concat(
        F.lit('<meta property="og:title" content="'), _escape(F.concat(headline, F.lit(" & more"))),
        F.lit('"><meta property="article:published_time" content="'), _published(), F.lit('">'),
    )
    lookalike = _script(kind("ClaimReviewX"), claim)
    head = (
        F.when(labelled & (lang == "en"), en)
        .when(labelled & (lang == "fr"), fr)
        .when(labelled & (lang == "es"), es)
        .when(labelled & (lang == "de"), de)
        .when(lang == "en", meta)
        .when(lang == "fr", article)
        .when(lang == "es", lookalike)
    )
    badge = F.when(lang == "es", "CUESTIONABLE ").when(lang == "fr", "Chequeo múltiple ").otherwise("")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), headline, F.lit(" | Checks</title>"), head,
        F.lit("</head><body><!-- Falso --><script>var a='Falso';</script><p>"), badge,
        _escape(F.col("text")), F.lit("</p></body></html>"),
    )
    return docs.filter(head.isNotNull()).select(_url().alias("url"), html.alias("html"))


def edge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, html)``: one page per document, in markup that only a scanner reads right.

    Comment marks in scripts and claims, commented-out blocks, titles and links, ``>`` in quoted
    attributes, unquoted properties, links that are never closed, a comment that never ends.
    """
    docs = texts(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")

    def review(*fields: Column) -> Column:
        return _script(F.lit("ClaimReview").alias("@type"), *fields)

    rated = F.struct(F.col("lang").alias("alternateName")).alias("reviewRating")
    claim = F.concat(F.lit("<!-- "), F.col("text"), F.lit(" -->")).alias("claimReviewed")
    gone = review(F.lit("gone").alias("claimReviewed"), F.lit("1999-01-01").alias("datePublished"))
    # The claim's own marks stay as they are in the script: only `</` would end it.
    body = F.replace(review(claim, rated), F.lit("\\u003c!--"), F.lit("<!--"))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><!-- <title>gone</title><meta property=og:title content=gone> -->"),
        F.lit("<script>var a = '<!--', b = '<title>gone</title>';</script>"), F.lit("<!-- "), gone, F.lit(" -->"), body,
        F.lit("<meta name='x > y' property=og:title content='"), _escape(F.concat(number, F.lit(" > 0 & \"more\""))), F.lit("'>"),
        F.lit("<meta property='article:published_time' content=2020-01-01T00:00:00Z></head><body>"),
        F.lit('<a title="1 > 0" href="/check/'), number, F.lit('">first '), _escape(F.col("source")),
        F.lit("<a href=/check/x"), number, F.lit("><b>second</b><!-- </a> --> link</a>"),
        F.lit('<img alt="<a href=/check/none>none</a>"><p>'), _escape(F.col("lang")), F.lit("</p>"),
        F.lit("<!-- never closed <p>"), _escape(F.col("text")),
    )
    return docs.select(_url().alias("url"), html.alias("html"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(listing_page, html)``: the documents as cards, twenty to a page; copies share a link."""
    docs = texts(spark, sf_dir, "documents")
    lang = F.col("lang")
    badge = (
        F.when(lang == "en", "Falso Falso: ")
        .when(lang == "es", "CUESTIONABLE ")
        .when(lang == "de", "Verdadero pero ")
        .otherwise("")
    )
    card = F.concat(
        F.lit('<li><a class="card" href="/check/'), F.col("n_chars").cast("string"), F.lit('?from=list">'),
        F.lit("<b>"), badge, F.lit("</b>"), _escape(F.col("text")), F.lit("</a></li>"),
    )
    page = F.floor(F.col("doc_id") / CARDS_PER_PAGE).cast("long").alias("listing_page")
    cards = docs.groupBy(page).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", card.alias("card")))).alias("cards")
    )  # twenty per page by construction
    body = F.array_join(F.transform("cards", lambda c: c["card"]), "")
    nav = F.lit('<nav><a href="/check/about">About us</a><a href="/contact">Contact</a></nav><ul>')
    return cards.select("listing_page", F.concat(nav, body, F.lit("</ul>")).alias("html"))


def sitemap_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, xml)``: an index and one child per language of the pages, entries by page id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # A page's entry goes to the child named by its host's first letter.
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    child = F.concat(F.lit("sitemap-"), F.substring(host, 1, 1), F.lit(".xml"))
    stamp = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    entry = F.concat(
        F.lit("<url><loc> "), _escape(F.col("url")), F.lit(" </loc>"),
        F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("<lastmod>"), stamp, F.lit("</lastmod>"))).otherwise(""),
        F.lit("</url>"),
    )
    rows = pages.select(child.alias("url"), "page_id", entry.alias("entry"))
    packed = rows.groupBy("url", F.floor(F.col("page_id") / 50_000).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("page_id", "entry"))).alias("entries")
    )  # the protocol allows 50,000 entries per file
    name = F.concat(F.col("url"), F.lit("?part="), F.col("part").cast("string"))
    joined = F.array_join(F.transform("entries", lambda e: e["entry"]), "\n")
    head = F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
    children = packed.select(name.alias("url"), F.concat(head, joined, F.lit("</urlset>")).alias("xml"))
    listed = F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))
    index = children.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("url", listed.alias("entry")))).alias("entries")
    )  # one entry per file of 50,000
    names = F.array_join(F.transform("entries", lambda e: e["entry"]), "")
    root = index.select(
        F.lit("sitemap.xml").alias("url"),
        F.concat(F.lit("<sitemapindex>"), names, F.lit("</sitemapindex>")).alias("xml"),
    )
    return root.unionByName(children)
