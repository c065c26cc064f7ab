"""The registered queries: every operator at work on the test tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark import domain
from claimspark.functions import dates, html, text, urls, vectors
from claimspark.operators import classify, dataset, extract, features, harvest, jsonld, keyed
from claimspark.operators import listing, metrics, profile, quality, sampling, terms
from claimspark.operators import vectors as neighbours
from claimspark.plans import views
from claimspark.session import scratch_path, stage
from claimspark.sources import pages as page_source
from claimspark.sources import sitemap, tables
from claimspark.streaming import harvest as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FLAGS = ("A", "N", "R")
AS_OF = "2020-01-01"
LINK = r"/[^?#]+"
CARD_LINK = r"/check/[^?#]+"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> Column:
    return F.round(c, 6)


# --- dataset construction -------------------------------------------------------------------


@query
def split_label_counts(spark, sf):
    """Rows per split and class of the frozen dataset."""
    rows = views.split_dataset(spark, sf).groupBy("split", "label")
    return rows.agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


@query
def dataset_rows(spark, sf):
    rows = views.dataset(spark, sf)
    return rows.select(F.md5("text").alias("text_md5"), "label", "label_binary", "date", "url", "seq")


@query
def dataset_splits(spark, sf):
    return views.split_dataset(spark, sf).select("seq", "label", "split")


@query
def split_summary(spark, sf):
    return dataset.split_summary(views.split_dataset(spark, sf)).drop("totals")


@query
def split_all_labels(spark, sf):
    """Exact splits of every claim text, null and foreign labels included, with flagged totals."""
    rows = views.claims(spark, sf).select("seq", "claim_reviewed", F.col("rating").alias("label"))
    rows = dataset.add_splits(rows.withColumn("text", F.coalesce("claim_reviewed", F.lit("none"))))
    return dataset.split_summary(rows)


@query
def dataset_written(spark, sf):
    """The end-to-end build, written partitioned by split and read back for one split."""
    path = scratch_path(spark, "dataset")
    dataset.build_processed(views.claims(spark, sf), path)
    rows = spark.read.parquet(path)
    return dataset.split_rows(rows, "test", ["url", "label", "label_binary", "date"])


@query
def multiword_documents(spark, sf):
    """First copy of every document text of more than one token."""
    docs = views.texts(spark, sf, "documents").select("doc_id", "text")
    kept = keyed.keep_first(dataset.multiword(docs, "text"), "text", "doc_id")
    return kept.select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query
def exploratory_view(spark, sf):
    rows = views.exploratory(spark, sf)
    return rows.select("seq", "url", "verdict", F.md5("corpus").alias("corpus_md5"), "rating", "date", "has_review")


@query
def merged_ratings(spark, sf):
    rows = dataset.with_label(views.claims(spark, sf))
    return rows.groupBy("rating", "label").agg(F.count("*").alias("n"))


@query
def label_ids(spark, sf):
    rows = dataset.with_label_ids(views.split_dataset(spark, sf))
    return dataset.split_rows(rows, "val", ["seq", "label", "label_id"])


@query
def chronological_claims(spark, sf):
    rows = views.claims(spark, sf).select("seq", F.col("pub_date").alias("date"))
    local = dataset.chronological(rows)
    utc = dates.wall_clock(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T22:30:00-05:00")), "UTC")
    return local.select(
        "seq",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("local_time"),
        F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("late_evening_utc"),
    )


# --- sources and sinks ----------------------------------------------------------------------


@query
def claims_csv(spark, sf):
    """Claims written as CSV and read back: line breaks, quotes and missing cells survive."""
    path = scratch_path(spark, "claims-csv")
    tables.write_table(views.claims(spark, sf), path, domain.CLAIM_COLUMNS, "csv")
    rows = tables.read_table(spark, path)
    return rows.select(
        "url", "verdict", F.md5("claim_reviewed").alias("claim_md5"), "rating", "pub_date", "jsonld_types", "has_claimreview"
    )


@query
def run_metadata(spark, sf):
    """Run counters written as one JSON document and read back."""
    counts = views.claims(spark, sf).agg(F.count("*").alias("n_rows"), F.count("rating").alias("n_rated"))
    path = scratch_path(spark, "run-meta")
    tables.write_document(counts, path)
    return tables.read_document(spark, path, T.StructType.fromDDL("n_rows long, n_rated long"))


@query
def sitemap_pages(spark, sf):
    return sitemap.sitemap_urls(views.sitemap_docs(spark, sf), "sitemap.xml", "/en/")


@query
def page_lookup(spark, sf):
    """HTML sizes for the pages' own URLs and their https forms, which may be absent."""
    pages = views.table(spark, sf, "pages")
    wanted = pages.select(F.explode(F.array("url", F.regexp_replace("url", "^http:", "https:"))).alias("url"))
    found = page_source.lookup_pages(wanted.distinct(), page_source.read_pages(spark, f"{sf}/pages.parquet"))
    return found.select("url", F.length("html").alias("n_chars"))


@query
def page_keys(spark, sf):
    return page_source.with_page_key(views.table(spark, sf, "pages").select("page_id", "url"))


@query
def page_key_collisions(spark, sf):
    return page_source.key_collisions(views.table(spark, sf, "pages"), max_chars=16)


# --- pages ----------------------------------------------------------------------------------


@query
def page_links(spark, sf):
    links = listing.page_links(views.texts(spark, sf, "pages"), LINK, "page_id")
    return links.select("page_id", "pos", "href", "text", urls.absolute_url(F.col("href"), views.SITE).alias("url"))


@query
def page_titles(spark, sf):
    pages = views.texts(spark, sf, "pages")
    return pages.select("page_id", html.title_text(F.col("html")).alias("title"))


@query
def page_visible_text(spark, sf):
    shown = views.texts(spark, sf, "pages").select("page_id", html.visible_text(F.col("html")).alias("t"))
    return shown.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


@query
def jsonld_node_types(spark, sf):
    """Every node of every page with its position and types."""
    rows = jsonld.node_rows(views.article_pages(spark, sf))
    return rows.select("url", "ord", F.array_join("types", "|").alias("types"))


@query
def structured_records(spark, sf):
    rows = extract.structured_records(views.article_pages(spark, sf))
    return rows.select(
        "url", F.md5("claim_reviewed").alias("claim_md5"), "claimant", "rating", "date_jsonld", "headline", "keywords", "jsonld_types"
    )


@query
def article_sample(spark, sf):
    rows = extract.article_sample(views.article_pages(spark, sf), "Checks")
    return rows.select(
        "url", "title", "pub_date_raw", "verdict_in_page", F.md5("claim_reviewed").alias("claim_md5"), "claimant", "tags", "jsonld_types"
    )


@query
def harvested_claims(spark, sf):
    """Harvest of every target, also of those without a page."""
    rows = harvest.harvest(views.claims(spark, sf).select("url", "verdict"), views.article_pages(spark, sf))
    return rows.select(
        "url", "verdict", F.md5("claim_reviewed").alias("claim_md5"), "rating", "pub_date", "jsonld_types", "has_claimreview"
    )


@query
def markup_edge_cases(spark, sf):
    """What pages of odd markup yield: fields, links and visible text."""
    pages = views.edge_pages(spark, sf)
    linked = pages.select("url", "html", html.anchors(F.col("html"), CARD_LINK).alias("links"))
    shown = linked.select("url", "links", html.visible_text(F.col("html")).alias("shown"))
    rows = extract.article_sample(pages).join(shown, "url")
    return rows.select(
        "url", "title", "pub_date_raw", "verdict_in_page", F.md5("claim_reviewed").alias("claim_md5"), "jsonld_types", "shown",
        F.array_join(F.transform("links", lambda x: F.concat(x["href"], F.lit(" "), x["text"])), "|").alias("links"),
    )


# --- listing --------------------------------------------------------------------------------


@query
def labelled_cards(spark, sf):
    links = listing.page_links(views.listing_pages(spark, sf), CARD_LINK)
    cards = listing.labelled_cards(listing.without_nav(links), views.SITE)
    return cards.select("listing_page", "pos", "url", "verdict", F.md5("card_text").alias("card_md5"))


@query
def listing_cards(spark, sf):
    cards = listing.listing_cards(views.listing_pages(spark, sf), views.SITE, CARD_LINK)
    return cards.select("url", "verdict", F.md5("card_text").alias("card_md5"), "listing_page")


def _minutes(spark, sf) -> DataFrame:
    """Minutes since the first event as page numbers, purchases as cards."""
    events = views.table(spark, sf, "events")
    start = events.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp")))).scalar()
    minute = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - start) / 60).cast("long")
    return events.select(minute.alias("listing_page"), "event_id", "event_type")


@query
def archive_end(spark, sf):
    """Where an archive with one page per ten minutes of events would end."""
    pages = _minutes(spark, sf).withColumn("listing_page", F.floor(F.col("listing_page") / 10))
    counts = pages.groupBy("listing_page").agg(F.count_if(F.col("event_type") == "purchase").alias("n_cards"))
    return listing.archive_end(counts)


@query
def stride_sample(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "lang")
    return keyed.stride_sample(docs, 50, "doc_id")


@query
def dense_index(spark, sf):
    """Events numbered by user and time."""
    events = views.table(spark, sf, "events").select("user_id", "event_id")
    return keyed.dense_index(events, ["user_id", "event_id"])


@query
def chosen_urls(spark, sf):
    """Listing URLs, or the sitemap's where the listing has none (as for this link pattern)."""
    cards = listing.listing_cards(views.table(spark, sf, "pages").withColumn("listing_page", F.col("page_id")), views.SITE, "/none/[^?#]+")
    return listing.choose_urls(cards, sitemap.sitemap_urls(views.sitemap_docs(spark, sf), "sitemap.xml", "/"))


@query
def chosen_listing_urls(spark, sf):
    """The other branch: the listing has cards, so the sitemap's URLs are not taken."""
    cards = listing.listing_cards(views.listing_pages(spark, sf), views.SITE, CARD_LINK)
    return listing.choose_urls(cards, sitemap.sitemap_urls(views.sitemap_docs(spark, sf), "sitemap.xml", "/"))


# --- incremental harvest --------------------------------------------------------------------


@query
def harvest_targets(spark, sf):
    cards = views.table(spark, sf, "documents").select(
        F.concat(F.lit("u"), F.col("n_chars").cast("string")).alias("url"),
        F.col("lang").alias("verdict"),
        F.col("doc_id").alias("seq"),
    )
    return harvest.load_targets(cards)


@query
def harvest_pending(spark, sf):
    """Targets whose page is absent from the labelled claims."""
    claims = views.claims(spark, sf)
    done = claims.filter("has_claimreview")
    return harvest.pending(harvest.load_targets(claims), done).select("url", "verdict", "seq")


@query
def harvest_head(spark, sf):
    claims = views.claims(spark, sf)
    todo = harvest.pending(harvest.load_targets(claims), claims.filter("has_claimreview"))
    return harvest.head(todo, 25).select("url", "seq")


def _batches(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents keyed by source and length: the first copy is done, later ones are new."""
    rows = views.claims(spark, sf)
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "n_chars")
    keyed_rows = rows.join(docs, "seq").withColumn("url", F.concat(F.lit("u"), F.col("n_chars").cast("string")))
    done = keyed_rows.filter(F.col("verdict") == "Falso")
    new = keyed_rows.filter(F.col("verdict") != "Falso")
    return done, new


@query
def harvest_upsert(spark, sf):
    done, new = _batches(spark, sf)
    rows = harvest.upsert(done, new, order="seq", columns=[*domain.CLAIM_COLUMNS, "seq"])
    return rows.select("url", "verdict", "rating", "has_claimreview", "seq")


@query
def harvest_progress(spark, sf):
    rows = harvest.progress(views.claims(spark, sf))
    return rows.withColumn("fill_share", r6("fill_share"))


@query
def harvest_stream(spark, sf):
    """Two page drops through the stream; pages whose claims change in the second count as changed."""
    base = scratch_path(spark, "stream")
    pages, targets = views.article_pages(spark, sf), views.claims(spark, sf)
    early = pages.filter(F.col("html").contains('"@type":"NewsArticle"'))
    stale = F.replace("html", F.lit('"claimReviewed":"'), F.lit('"claimReviewed":"stale '))
    early.withColumn("html", F.replace(stale, F.lit("T08:00:00Z"), F.lit("T09:00:00Z"))).write.parquet(f"{base}/drops/first")
    stream.run_harvest(spark, f"{base}/drops/*", targets, f"{base}/table", f"{base}/cp").awaitTermination()
    pages.write.parquet(f"{base}/drops/second")
    stream.run_harvest(spark, f"{base}/drops/*", targets, f"{base}/table", f"{base}/cp").awaitTermination()
    rows = stream.current_claims(spark, f"{base}/table")
    return rows.select("url", "verdict", F.md5("claim_reviewed").alias("claim_md5"), "rating", "pub_date", "jsonld_types", "has_claimreview")


# --- quality and profiling ------------------------------------------------------------------


@query
def verdict_counts(spark, sf):
    return quality.value_counts(views.claims(spark, sf), "verdict").withColumn("pct", r6("pct"))


@query
def rating_counts(spark, sf):
    return quality.value_counts(views.claims(spark, sf), "rating").withColumn("pct", r6("pct"))


@query
def null_alarm(spark, sf):
    return quality.null_alarm(views.claims(spark, sf), "rating").withColumn("null_share", r6("null_share"))


@query
def claim_date_range(spark, sf):
    row = quality.date_range(views.claims(spark, sf), "pub_date")
    return row.select(*[F.col(c).cast("string").alias(c) for c in row.columns])


@query
def fill_rates(spark, sf):
    rows = quality.fill_rates(views.claims(spark, sf), list(domain.CLAIM_COLUMNS))
    return rows.withColumn("share", r6("share"))


@query
def markup_coverage(spark, sf):
    return quality.markup_coverage(views.claims(spark, sf)).withColumn("coverage", r6("coverage"))


@query
def date_plausibility(spark, sf):
    row = quality.date_plausibility(views.claims(spark, sf), "pub_date", AS_OF)
    days = [F.col(c).cast("string").alias(c) for c in ("first_day", "last_day")]
    return row.select("n_distinct", *days, r6("as_of_share").alias("as_of_share"), "warn")


@query
def recon_summary(spark, sf):
    """The three recon tables, written first and then summarised."""
    cards = listing.listing_cards(views.listing_pages(spark, sf), views.SITE, CARD_LINK)
    site = sitemap.sitemap_urls(views.sitemap_docs(spark, sf), "sitemap.xml", "/")
    sample = extract.article_sample(views.article_pages(spark, sf), "Checks")
    parts = [stage(df, name) for df, name in ((cards, "cards"), (site, "sitemap"), (sample, "sample"))]
    return quality.recon_summary(*parts, AS_OF)


@query
def missing_table(spark, sf):
    return profile.missing_table(views.exploratory(spark, sf))


@query
def missing_after_selection(spark, sf):
    rows = dataset.with_claim(views.exploratory(spark, sf), "corpus")
    masked = rows.withColumn("rating", F.when(F.col("rating") != "Verdadero pero", F.col("rating")))
    return profile.missing_table(masked)


@query
def nullity_patterns(spark, sf):
    return profile.nullity_patterns(views.exploratory(spark, sf).drop("seq", "url"))


@query
def nullity_correlation(spark, sf):
    rows = views.exploratory(spark, sf).select(
        "corpus", "rating", F.when(F.col("verdict") != "Falso", F.col("verdict")).alias("verdict"), "date"
    )
    return profile.nullity_correlation(rows).withColumn("correlation", r6("correlation"))


@query
def duplicate_counts(spark, sf):
    docs = views.texts(spark, sf, "documents").select("text", "lang")
    return profile.duplicate_counts(docs, "text")


@query
def shape_table(spark, sf):
    return profile.shape_table(views.exploratory(spark, sf))


@query
def class_retention(spark, sf):
    return profile.retention(views.exploratory(spark, sf))


@query
def class_share_shift(spark, sf):
    rows = profile.share_shift(views.exploratory(spark, sf))
    return rows.select("verdict", *[r6(c).alias(c) for c in ("share_before", "share_after", "shift")])


@query
def claims_per_year(spark, sf):
    return profile.counts_per_year(views.dataset(spark, sf))


@query
def claims_per_month(spark, sf):
    return profile.counts_per_month(views.dataset(spark, sf))


@query
def label_drift(spark, sf):
    return profile.label_drift(views.dataset(spark, sf))


@query
def verdict_and_rating(spark, sf):
    return profile.distributions(views.exploratory(spark, sf))


@query
def label_disagreements(spark, sf):
    return profile.disagreements(views.exploratory(spark, sf)).select("seq", "verdict", "rating")


@query
def disagreement_count(spark, sf):
    return profile.disagreement_count(views.exploratory(spark, sf))


@query
def length_description(spark, sf):
    docs = profile.with_length(views.texts(spark, sf, "documents"), "text")
    row = profile.describe(docs, "n_words")
    return row.select(*[r6(F.col(c).cast("double")).alias(c) for c in row.columns])


@query
def single_token_texts(spark, sf):
    return profile.single_token_texts(views.texts(spark, sf, "documents"), "text").select("doc_id", "text")


@query
def length_histogram(spark, sf):
    return profile.length_histogram(views.measured(spark, sf))


@query
def length_density(spark, sf):
    rows = profile.length_density(views.measured(spark, sf))
    return rows.select("label", "point", F.round("x", 4).alias("x"), F.round("density", 8).alias("density"))


@query
def short_text_crosstab(spark, sf):
    docs = profile.with_length(views.texts(spark, sf, "documents"), "text")
    return profile.short_text_crosstab(docs, ["en", "es", "fr", "de"], "lang")


@query
def label_leaks(spark, sf):
    """Which of some common words occur in how many documents."""
    return profile.label_leaks(views.texts(spark, sf, "documents"), "text", ["The", "Pour", "Más", "falso"])


@query
def class_distribution(spark, sf):
    return profile.class_distribution(views.dataset(spark, sf), [*domain.LABELS, "Engañoso"])


# --- terms ----------------------------------------------------------------------------------


def _doc_tokens(spark, sf) -> DataFrame:
    docs = views.texts(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return terms.with_tokens(docs, "text", views.STOPWORDS)


@query
def plain_texts(spark, sf):
    docs = views.texts(spark, sf, "documents")
    plain = text.normalize(F.col("text"))
    return docs.select("doc_id", F.md5(plain).alias("text_md5"), F.md5(text.strip_accents(F.col("text"))).alias("unaccented_md5"))


@query
def document_tokens(spark, sf):
    rows = _doc_tokens(spark, sf)
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query
def term_frequency(spark, sf):
    return terms.term_frequency(_doc_tokens(spark, sf))


@query
def top_terms(spark, sf):
    return terms.top_terms(_doc_tokens(spark, sf))


@query
def distinctive_terms(spark, sf):
    rows = terms.distinctive_terms(_doc_tokens(spark, sf), labels=["en", "es", "fr", "de"])
    return rows.withColumn("lift", r6("lift"))


@query
def frequent_vocabulary(spark, sf):
    return terms.frequent_vocabulary(_doc_tokens(spark, sf))


def _word_vectors(spark, sf) -> DataFrame:
    """Vectors with their frequency."""
    rows = terms.with_tokens(views.dataset(spark, sf), "text", views.STOPWORDS)
    vectors_of = neighbours.word_vectors(rows, partitions=8)
    return terms.with_frequency(vectors_of, terms.term_frequency(rows))


@query
def word_vector_frequencies(spark, sf):
    """Word vectors of the claims with their corpus frequency."""
    return _word_vectors(spark, sf).select("term", "n", F.size("vector").alias("dims"))


@query
def word_vector_digests(spark, sf):
    """A digest of every word vector."""
    rounded = F.transform("vector", lambda x: F.round(x, 4).cast("string"))
    return _word_vectors(spark, sf).select("term", "n", F.md5(F.concat_ws(",", rounded)).alias("vector_md5"))


@query
def nearest_vectors(spark, sf):
    vecs = views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values")
    )
    return neighbours.nearest(vecs, vecs, 5)


def _chunk_tokenizer():
    """Pieces of at most four characters per word, as a stand-in for a subword vocabulary."""
    return lambda t: [w[i : i + 4] for w in t.split() for i in range(0, len(w), 4)]


@query
def subword_lengths(spark, sf):
    count = terms.piece_count(_chunk_tokenizer)
    docs = views.texts(spark, sf, "documents").select("doc_id", count("text").alias("n_pieces"))
    row = profile.describe(docs, "n_pieces")
    return row.select(*[r6(F.col(c).cast("double")).alias(c) for c in row.columns])


def _pieces(spark, sf) -> DataFrame:
    count = terms.piece_count(_chunk_tokenizer)
    return stage(views.texts(spark, sf, "documents").select("lang", count("text").alias("n_pieces")), "pieces")


@query
def subword_histogram(spark, sf):
    """Documents per language and number of subwords."""
    return profile.length_histogram(_pieces(spark, sf), "lang", "n_pieces")


@query
def subword_density(spark, sf):
    rows = profile.length_density(_pieces(spark, sf), "lang", "n_pieces")
    return rows.select("lang", "point", F.round("x", 4).alias("x"), F.round("density", 8).alias("density"))


@query
def per_step_difference(spark, sf):
    """Change of each event's value against the user's previous event."""
    events = views.table(spark, sf, "events").select("user_id", "event_id", "value")
    return terms.per_step(events, "event_id", "value", "user_id").select("event_id", F.round("per_step", 4).alias("per_step"))


# --- modelling and evaluation ---------------------------------------------------------------


@query
def class_weights(spark, sf):
    train = dataset.split_rows(views.split_dataset(spark, sf), "train")
    return features.class_weights(train).withColumn("weight", r6("weight"))


@query
def tfidf_documents(spark, sf):
    """Kept terms, summed weight and largest weight of every document's TF-IDF row."""
    docs = views.texts(spark, sf, "documents").select("doc_id", "text")
    rows = features.tfidf_table(docs, "doc_id", "text").groupBy("doc_id")
    return rows.agg(
        F.count("*").alias("n_terms"),
        F.round(F.sum("weight"), 4).alias("weight_sum"),
        r6(F.max("weight")).alias("weight_max"),
        F.sum("df").alias("df_sum"),
    )


@query
def baseline_predictions(spark, sf):
    """Validation predictions of the TF-IDF and logistic regression baseline."""
    rows = dataset.with_label_ids(views.frozen_dataset(spark, sf))
    model = classify.train_baseline(dataset.split_rows(rows, "train"))
    scored = classify.predict(dataset.split_rows(rows, "val"), model)
    return scored.select("url", "label", "prediction", F.round(F.array_max("probs"), 3).alias("top_prob"))


@query
def grid_search_scores(spark, sf):
    """Cross-validated macro-F1 per penalty on the training rows."""
    rows = dataset.with_label_ids(views.frozen_dataset(spark, sf))
    train = classify.add_folds(dataset.split_rows(rows, "train"), "text")
    fitted = classify.grid_search(train.select("text", "label_id", "fold"))
    pairs = [
        F.struct(F.lit(c).alias("c"), F.lit(score).alias("macro_f1"), F.lit(c == fitted.best_c).alias("best"))
        for c, score in fitted.scores.items()
    ]
    return train.agg(F.count("*").alias("n_train")).select("n_train", F.inline(F.array(*pairs)))


@query
def fold_counts(spark, sf):
    rows = classify.add_folds(views.dataset(spark, sf), "text")
    return rows.groupBy("label", "fold").agg(F.count("*").alias("n"))


def _raised(spark, sf) -> DataFrame:
    rows = views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )
    return sampling.smote(rows).withColumn("values", vector_to_array("features"))


@query
def smote_counts(spark, sf):
    """Embeddings raised to the largest class; a synthetic row counts if it has numbers."""
    return _raised(spark, sf).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("synthetic") & F.exists("values", lambda x: ~F.isnan(x))).alias("n_synthetic")
    )


@query
def smote_digests(spark, sf):
    """Every synthetic row by a digest of its numbers."""
    rounded = F.transform("values", lambda x: F.round(x, 6).cast("string"))
    return _raised(spark, sf).filter("synthetic").select("id", "label", F.md5(F.concat_ws(",", rounded)).alias("vector_md5"))


def _stripe_scorer():
    """Logits: sums of every third number of a vector, starting at 0, 1 and 2."""

    def score(batch: np.ndarray) -> np.ndarray:
        wide = np.asarray(batch, dtype=np.float64)
        return np.stack([wide[:, i::3].sum(axis=1) for i in range(3)], axis=1)

    return score


@query
def external_predictions(spark, sf):
    vecs = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = classify.predict_external(vecs, ["embedding"], _stripe_scorer, input_shapes=[[64]])
    probs = [F.round(F.col("probs")[i], 4).alias(f"p{i}") for i in range(3)]
    return scored.select("vec_id", "prediction", *probs)


def _ranked(spark, sf, slices) -> DataFrame:
    vecs = views.table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("v"),
        F.when(F.col("label") == 0, " ").otherwise("claim").alias("text"),
    )
    sums = [vectors.dot(F.slice("v", *s), F.slice("v", *s)) for s in slices]
    scored = classify.with_prediction(vecs.withColumn("logits", F.array(*sums)), "logits")
    rows = classify.ranked_scores(scored, "vec_id", "text")
    return rows.select("vec_id", "position", "label", F.round("score", 4).alias("score"), "best_label")


@query
def ranked_class_scores(spark, sf):
    """The slices that the SQL names: numbers 1 to 63."""
    return _ranked(spark, sf, [(1, 21), (22, 21), (43, 21)])


@query
def ranked_class_scores_whole(spark, sf):
    """The same over all 64 numbers."""
    return _ranked(spark, sf, [(1, 21), (22, 21), (43, 22)])


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(metrics.confusion_cells(views.predictions(spark, sf)), [*FLAGS, "X"])


@query
def macro_f1(spark, sf):
    return metrics.macro_f1(metrics.confusion_cells(views.predictions(spark, sf))).withColumn("macro_f1", r6("macro_f1"))


@query
def class_scores(spark, sf):
    rows = metrics.class_scores(metrics.confusion_cells(views.predictions(spark, sf)))
    return rows.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def classification_report(spark, sf):
    rows = metrics.classification_report(metrics.confusion_cells(views.predictions(spark, sf)))
    return rows.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def bootstrap_interval(spark, sf):
    return metrics.bootstrap_ci(metrics.confusion_cells(views.predictions(spark, sf)))


@query
def evaluation_document(spark, sf):
    """The metrics document of the line-item predictions, written as JSON and read back."""
    doc = metrics.evaluate(views.predictions(spark, sf), "test", FLAGS)
    path = scratch_path(spark, "metrics")
    tables.write_document(doc, path)
    read = tables.read_document(spark, path, doc.schema)
    low, high = F.col("macro_f1_ci95")[0], F.col("macro_f1_ci95")[1]
    holds = (low <= F.col("macro_f1") + 0.0005) & (high >= F.col("macro_f1") - 0.0005)  # three digits against four
    return read.select(
        "split", "n", "macro_f1", holds.alias("interval_holds"), F.to_json("confusion_matrix").alias("matrix"),
        F.inline(F.map_entries("per_class_f1")),
    ).withColumnsRenamed({"key": "label", "value": "f1"})


@query
def first_errors(spark, sf):
    rows = views.predictions(spark, sf)
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")
    keyed_rows = rows.select(key, F.md5(F.concat("label", key.cast("string"))).alias("pick"), "label", "prediction")
    return metrics.first_errors(keyed_rows, "pick").select("line", "label", "prediction")


@query
def model_comparison(spark, sf):
    """Macro-F1 per model and split, from one table of counts; the model without a validation score is left out."""
    rows = views.predictions(spark, sf)
    models = {"quantity": F.col("prediction"), "always A": F.lit("A"), "always R": F.lit("R")}
    guesses = F.array(*[F.struct(F.lit(m).alias("model"), g.alias("prediction")) for m, g in models.items()])
    scored = rows.select("split", "label", F.inline(guesses)).filter("model <> 'always R' or split = 'test'")
    scores = metrics.macro_f1(metrics.confusion_cells(scored, by=["model", "split"]), ["model", "split"])
    return metrics.compare_models(stage(scores, "scores")).withColumn("macro_f1", r6("macro_f1"))


@query
def baseline_report(spark, sf):
    """The baseline's report on validation and test rows; ``sound`` holds what any model's must fulfil."""
    rows = dataset.with_label_ids(views.frozen_dataset(spark, sf))
    model = classify.train_baseline(dataset.split_rows(rows, "train"))
    scored = stage(classify.predict(rows.filter("split <> 'train'"), model), "scored")
    best = F.array_max("probs")
    named = vectors.class_name(vectors.argmax(F.col("probs")), domain.CLASSES)
    odd = scored.filter((F.abs(F.aggregate("probs", F.lit(0.0), lambda s, x: s + x) - 1) > 1e-9) | (best > 1) | (named != F.col("prediction")))
    cells = metrics.confusion_cells(scored, by=["split"])
    report = metrics.classification_report(cells, ["split"]).filter("support > 0 or label in ('accuracy', 'macro avg', 'weighted avg')")
    bounded = F.greatest("precision", "recall", "f1") <= 1
    return report.select("split", "label", "support", (bounded & (odd.agg(F.count("*")).scalar() == 0)).alias("sound"))


@query
def smote_classifier(spark, sf):
    """Grid search with oversampling inside each fold: held-out rows per fold and penalty.

    ``consistent`` says that each penalty's score is the mean macro-F1 of its folds' counts.
    """
    rows = dataset.with_label_ids(views.frozen_dataset(spark, sf))
    train = classify.add_folds(dataset.split_rows(rows, "train"), "text")
    result = classify.grid_search(train.select("url", "text", "label_id", "fold"), oversample="url")
    folds = metrics.class_scores(result.cells, ["fold", "c"]).groupBy("fold", "c").agg(F.avg("f1").alias("f1"), F.sum("support").alias("n_held"))
    means = folds.withColumn("mean", F.avg("f1").over(Window.partitionBy("c")))
    known = spark.createDataFrame(list(result.scores.items()), "c double, score double")
    return means.join(F.broadcast(known), "c").select("fold", "c", "n_held", (F.abs(F.col("mean") - F.col("score")) < 1e-12).alias("consistent"))


@query
def bootstrap_summary(spark, sf):
    """Replicates, draws per replicate, the score itself and whether the interval holds it."""
    cells = stage(metrics.confusion_cells(views.predictions(spark, sf)), "cells")
    drawn = stage(metrics.bootstrap_cells(cells), "drawn")
    point = metrics.macro_f1(cells).scalar()
    tails = F.percentile("macro_f1", F.array(F.lit(0.025), F.lit(0.975)))
    interval = metrics.macro_f1(drawn, ["replicate"]).agg(F.count("*").alias("replicates"), tails.alias("q"))
    draws = drawn.groupBy("replicate").agg(F.sum("n").alias("n")).agg(F.when(F.min("n") == F.max("n"), F.min("n"))).scalar()
    return interval.select(
        "replicates", draws.alias("draws"), r6(point).alias("point"),
        (F.col("q")[0] <= point).alias("low_holds"), (F.col("q")[1] >= point).alias("high_holds"),
    )


@query
def similar_words(spark, sf):
    """The nearest terms of the four most frequent, by vectors trained on the claims; without SQL, as they are learnt."""
    table = stage(_word_vectors(spark, sf), "word-vectors")
    words = [r.term for r in table.orderBy(F.desc("n"), "term").limit(4).collect()]
    return neighbours.similar_words(table.select("term", "vector"), words, 5)
