"""SQL that states what each registered query must return, on the same tables."""

from __future__ import annotations

from claimspark import domain
from claimspark.plans import views
from claimspark.plans.queries import AS_OF, FLAGS

ORACLES: dict[str, str] = {}


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LABELS = _list(domain.LABELS)
STOPWORDS = _list(sorted({w.translate(str.maketrans("áéíóúü", "aeiouu")) for w in views.STOPWORDS}))

CLAIMS = """
docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         l.doc_id IS NOT NULL AS labelled
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
claims AS (
  SELECT doc_id AS seq,
    'https://' || source || '.example/' || CAST(doc_id AS VARCHAR) AS url,
    CASE lang WHEN 'en' THEN 'Falso' WHEN 'es' THEN 'Cuestionable'
              WHEN 'fr' THEN 'Verdadero' WHEN 'de' THEN 'Verdadero pero' END AS verdict,
    CASE WHEN labelled THEN text END AS claim_reviewed,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'Falso'
         WHEN quality = 0 AND toxic = 0 THEN 'Cuestionable'
         WHEN quality = 1 AND toxic = 1 THEN 'Verdadero pero...'
         WHEN quality = 0 AND toxic = 1 THEN 'Verdadero' END AS rating,
    strftime(DATE '2019-01-01' + CAST(doc_id % 2000 AS INTEGER), '%Y-%m-%d')
      || 'T00:00:00-05:00' AS pub_date,
    CASE WHEN labelled THEN 'ClaimReview|NewsArticle' END AS jsonld_types,
    labelled AS has_claimreview
  FROM docs)"""

EDA = (
    CLAIMS
    + """,
eda AS (
  SELECT seq, url, verdict, claim_reviewed AS corpus,
    CASE rating WHEN 'Verdadero pero...' THEN 'Verdadero pero' ELSE rating END AS rating,
    pub_date AS date, has_claimreview AS has_review
  FROM claims)"""
)

DATASET = (
    CLAIMS
    + f""",
relabelled AS (
  SELECT *, CASE WHEN rating IN ('Verdadero pero...', 'Verdadero pero') THEN 'Verdadero'
                 ELSE rating END AS label FROM claims),
usable AS (
  SELECT *, len(regexp_extract_all(claim_reviewed, '\\S+')) AS n_words FROM relabelled
  WHERE claim_reviewed IS NOT NULL AND label IN ({LABELS})),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY claim_reviewed ORDER BY seq) AS copy
  FROM usable WHERE n_words > 1),
dataset AS (
  SELECT claim_reviewed AS text, label,
    CASE WHEN label = 'Falso' THEN 'Falso' ELSE 'no-Falso' END AS label_binary,
    pub_date AS date, url, seq, CAST(n_words AS BIGINT) AS n_words
  FROM numbered WHERE copy = 1)"""
)

SPLITS = (
    DATASET
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || text)) AS pos,
    count(*) OVER (PARTITION BY label) AS n_label FROM dataset),
splits AS (
  SELECT *, CASE WHEN pos <= round_even(n_label * 0.7, 0) THEN 'train'
    WHEN pos <= round_even(n_label * 0.7, 0) + round_even(n_label * 0.15, 0) THEN 'val'
    ELSE 'test' END AS split FROM ranked)"""
)

TOKENS = f"""
plain AS (
  SELECT doc_id, lang AS label, text,
    regexp_replace(translate(lower(text), 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU'),
                   '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS plain FROM documents),
tokenised AS (
  SELECT doc_id, label, list_filter(regexp_extract_all(plain, '\\S+'),
    lambda t: regexp_full_match(t, '\\p{{L}}+') AND length(t) > 2
      AND t NOT IN ({STOPWORDS})) AS tokens FROM plain),
terms AS (SELECT doc_id, label, unnest(tokens) AS term FROM tokenised)"""

PREDICTIONS = """
predictions AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS label,
    CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS prediction,
    CASE WHEN l_linestatus = 'O' THEN 'val' ELSE 'test' END AS split
  FROM lineitem)"""

SCORES = (
    PREDICTIONS
    + """,
names AS (SELECT DISTINCT label FROM predictions UNION SELECT DISTINCT prediction FROM predictions),
hits AS (
  SELECT n.label,
    (SELECT count(*) FROM predictions p WHERE p.label = n.label) AS n_true,
    (SELECT count(*) FROM predictions p WHERE p.prediction = n.label) AS n_pred,
    (SELECT count(*) FROM predictions p WHERE p.label = n.label AND p.prediction = n.label) AS n_hit
  FROM names n),
scores AS (
  SELECT label, coalesce(n_hit / nullif(n_pred, 0), 0.0) AS precision,
    coalesce(n_hit / nullif(n_true, 0), 0.0) AS recall,
    coalesce(2.0 * n_hit / nullif(n_true + n_pred, 0), 0.0) AS f1, n_true AS support
  FROM hits)"""
)

DECODE = (
    "replace(replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'),"
    " '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
)


def oracle(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes.strip()}\n{select.strip()}" if ctes else select.strip()


# --- dataset construction

oracle("split_label_counts", SPLITS, """
SELECT split, label, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM splits GROUP BY ALL""")
oracle("dataset_rows", DATASET, """
SELECT md5(text) AS text_md5, label, label_binary, date, url, seq FROM dataset""")
oracle("dataset_splits", SPLITS, "SELECT seq, label, split FROM splits")
oracle("split_summary", SPLITS, """
SELECT split, label, count(*) AS n FROM splits
GROUP BY GROUPING SETS ((split, label), (split), (label), ())""")
oracle("split_all_labels", CLAIMS + """,
sized AS (SELECT rating AS label, count(*) AS n, round_even(count(*) * 0.7, 0) AS a, round_even(count(*) * 0.15, 0) AS b
  FROM claims GROUP BY 1),
parts AS (
  SELECT 'train' AS split, label, a AS n FROM sized
  UNION ALL SELECT 'val', label, b FROM sized
  UNION ALL SELECT 'test', label, n - a - b FROM sized)""", """
SELECT split, label, CAST(sum(n) AS BIGINT) AS n, CAST(grouping(split, label) AS INTEGER) AS totals
FROM parts WHERE n > 0 GROUP BY CUBE (split, label)""")
oracle("dataset_written", SPLITS, """
SELECT url, label, label_binary, date FROM splits WHERE split = 'test'""")
oracle("multiword_documents", "", r"""
SELECT min(doc_id) AS doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words
FROM documents GROUP BY text HAVING len(regexp_extract_all(text, '\S+')) > 1""")
oracle("exploratory_view", EDA, """
SELECT seq, url, verdict, md5(corpus) AS corpus_md5, rating, date, has_review FROM eda""")
oracle("merged_ratings", CLAIMS, """
SELECT rating, CASE WHEN rating LIKE 'Verdadero%' THEN 'Verdadero' ELSE rating END AS label,
  count(*) AS n FROM claims GROUP BY ALL""")
oracle("label_ids", SPLITS, """
SELECT seq, label, CAST(CASE label WHEN 'Cuestionable' THEN 0 WHEN 'Falso' THEN 1 ELSE 2 END AS INTEGER)
  AS label_id FROM splits WHERE split = 'val'""")
oracle("chronological_claims", CLAIMS, """
SELECT seq, substr(pub_date, 1, 10) || ' 00:00:00' AS local_time,
  strftime(CAST(substr(pub_date, 1, 10) AS DATE) + INTERVAL 27 HOUR + INTERVAL 30 MINUTE,
           '%Y-%m-%d %H:%M:%S') AS late_evening_utc
FROM claims ORDER BY pub_date, seq""")

# --- sources and sinks

oracle("claims_csv", CLAIMS, """
SELECT url, verdict, md5(claim_reviewed) AS claim_md5, rating, pub_date, jsonld_types, has_claimreview
FROM claims""")
oracle("run_metadata", CLAIMS, "SELECT count(*) AS n_rows, count(rating) AS n_rated FROM claims")
oracle("sitemap_pages", "", """
SELECT url, CASE WHEN page_id % 5 <> 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END
  AS lastmod
FROM (SELECT *, row_number() OVER (
        PARTITION BY url ORDER BY page_id // 50000, substr(regexp_extract(url, '^https?://([^/]+)', 1), 1, 1), page_id) AS rn
      FROM pages WHERE url LIKE '%/en/%') WHERE rn = 1""")
oracle("page_lookup", "", """
SELECT w.url, CAST(length(p.html) AS INTEGER) AS n_chars
FROM (SELECT url FROM pages UNION SELECT regexp_replace(url, '^http:', 'https:') FROM pages) w
LEFT JOIN pages p ON p.url = w.url""")
oracle("page_keys", "", """
SELECT page_id, url, substr(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), 1, 150) || '.html' AS page_key
FROM pages""")
oracle("page_key_collisions", "", """
SELECT substr(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), 1, 16) || '.html' AS page_key,
  count(*) AS n_urls
FROM (SELECT DISTINCT url FROM pages) GROUP BY 1 HAVING count(*) > 1""")

# --- pages

oracle("page_links", """
links AS (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 1) AS hrefs,
    regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 2) AS texts FROM pages),
spread AS (
  SELECT page_id, unnest(range(len(hrefs))) AS i, hrefs, texts FROM links)""", f"""
SELECT page_id, CAST(i AS INTEGER) AS pos, {DECODE.format("hrefs[i + 1]")} AS href,
  trim(regexp_replace({DECODE.format("texts[i + 1]")}, '\\s+', ' ', 'g')) AS text,
  '{views.SITE}' || {DECODE.format("hrefs[i + 1]")} AS url
FROM spread""")
oracle("page_titles", "", f"""
SELECT page_id, trim({DECODE.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title
FROM pages""")
oracle("page_visible_text", rf"""
marked AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<!--.*?-->', '', 'g'), '(?s)<script\b.*?</script>', chr(1), 'g'),
    '(?s)<style\b.*?</style>', chr(1), 'g'), '<[/!a-zA-Z][^>]*>', chr(1), 'g') AS t FROM pages),
shown AS (
  SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(1)),
    lambda s: regexp_replace({DECODE.format("s")}, '^\s+|\s+$', '', 'g')),
    lambda s: s <> ''), ' ') AS t FROM marked)""", """
SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM shown""")

ARTICLE = (
    CLAIMS
    + f""",
facts AS (
  SELECT d.*, c.url, c.verdict, c.rating AS quality_rating, c.pub_date,
    'Note ' || CAST(d.doc_id AS VARCHAR) AS note
  FROM docs d JOIN claims c ON c.seq = d.doc_id),
fields AS (
  SELECT doc_id, url, verdict, text, lang, source, labelled, pub_date AS published, note,
    CASE WHEN labelled AND lang <> 'de' THEN text END AS claim,
    CASE WHEN labelled AND lang IN ('en') THEN source
         WHEN labelled AND lang = 'es' THEN source END AS claimant,
    CASE WHEN labelled AND lang IN ('en', 'de') THEN quality_rating
         WHEN labelled AND lang = 'fr' THEN CAST(quality + 1 AS VARCHAR) END AS rating,
    CASE WHEN labelled AND lang IN ('en', 'de') THEN pub_date
         WHEN lang = 'fr' THEN '{views.ARTICLE_DATE}'
         WHEN labelled AND lang = 'es' THEN '{views.EARLIER_DATE}' END AS date_jsonld,
    CASE WHEN labelled AND lang IN ('en', 'de') THEN note END AS headline,
    CASE WHEN labelled AND lang = 'en' THEN lang || ', ' || source
         WHEN lang = 'fr' THEN source END AS keywords,
    CASE WHEN labelled AND lang = 'en' THEN 'Claim|ClaimReview|NewsArticle|Person|Rating'
         WHEN labelled AND lang = 'fr' THEN 'Claim|ClaimReview|NewsArticle|Person|Rating|Review'
         WHEN labelled AND lang = 'es' THEN 'Claim|ClaimReview|Person|Rating'
         WHEN labelled AND lang = 'de' THEN 'Article|Claim|ClaimReview|Person|Rating'
         WHEN lang = 'fr' THEN 'NewsArticle'
         WHEN lang = 'es' THEN 'ClaimReviewX' END AS jsonld_types,
    labelled OR lang <> 'de' AS has_page
  FROM facts)"""
)

oracle("jsonld_node_types", ARTICLE + """,
nodes AS (
  SELECT url, unnest(CASE
    WHEN labelled AND lang = 'en' THEN ['', 'ClaimReview', 'Rating', 'Claim', 'Person', 'NewsArticle']
    WHEN labelled AND lang = 'fr' THEN ['NewsArticle', 'ClaimReview|Review', 'Rating', 'Claim', 'Person']
    WHEN labelled AND lang = 'es' THEN ['ClaimReview', 'Claim', 'Person', 'ClaimReview', 'Rating', 'Claim', 'Person']
    WHEN labelled AND lang = 'de' THEN ['ClaimReview', 'Rating', 'Claim', 'Person', 'Article']
    WHEN lang = 'fr' THEN ['NewsArticle']
    WHEN lang = 'es' THEN ['ClaimReviewX'] ELSE [] END) AS types,
    generate_subscripts(CASE
    WHEN labelled AND lang = 'en' THEN [1, 2, 3, 4, 5, 6] WHEN labelled AND lang = 'fr' THEN [1, 2, 3, 4, 5]
    WHEN labelled AND lang = 'es' THEN [1, 2, 3, 4, 5, 6, 7] WHEN labelled AND lang = 'de' THEN [1, 2, 3, 4, 5]
    WHEN lang IN ('fr', 'es') THEN [1] ELSE [] END, 1) AS ord FROM fields)""", """
SELECT url, CAST(ord - 1 AS INTEGER) AS ord, types FROM nodes""")
oracle("structured_records", ARTICLE, """
SELECT url, md5(claim) AS claim_md5, claimant, rating, date_jsonld, headline, keywords, jsonld_types
FROM fields WHERE has_page""")
oracle("article_sample", ARTICLE, """
SELECT url, CASE WHEN headline IS NOT NULL THEN headline
    WHEN lang = 'en' THEN note || ' & more' ELSE note END AS title,
  CASE WHEN date_jsonld IS NOT NULL THEN date_jsonld WHEN lang = 'en' THEN published END AS pub_date_raw,
  CASE WHEN rating IS NOT NULL THEN rating WHEN lang = 'fr' THEN 'Chequeo Múltiple'
    WHEN lang = 'es' THEN 'Cuestionable' END AS verdict_in_page,
  md5(claim) AS claim_md5, claimant, keywords AS tags, jsonld_types
FROM fields WHERE has_page""")
HARVEST = """
SELECT url, verdict, md5(claim) AS claim_md5, rating,
  CASE WHEN date_jsonld IS NOT NULL THEN date_jsonld WHEN lang = 'en' THEN published END AS pub_date,
  jsonld_types, coalesce(contains(jsonld_types, 'ClaimReview'), false) AS has_claimreview
FROM fields"""
oracle("harvested_claims", ARTICLE, HARVEST)
oracle("harvest_stream", ARTICLE, HARVEST + " WHERE has_page")

oracle("markup_edge_cases", CLAIMS, """
SELECT c.url, d.doc_id || ' > 0 & "more"' AS title, '2020-01-01T00:00:00Z' AS pub_date_raw, d.lang AS verdict_in_page,
  md5('<!-- ' || d.text || ' -->') AS claim_md5, 'ClaimReview' AS jsonld_types,
  'first ' || d.source || ' second link ' || d.lang AS shown,
  '/check/' || d.doc_id || ' first ' || d.source || '|/check/x' || d.doc_id || ' second link' AS links
FROM docs d JOIN claims c ON c.seq = d.doc_id""")

# --- listing

CARDS = r"""
raw AS (
  SELECT doc_id, doc_id // 20 AS listing_page,
    row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS pos,
    '%(site)s/check/' || CAST(n_chars AS VARCHAR) || '?from=list' AS url,
    trim(regexp_replace(CASE lang WHEN 'en' THEN 'Falso Falso: ' WHEN 'es' THEN 'CUESTIONABLE '
      WHEN 'de' THEN 'Verdadero pero ' ELSE '' END || text, '\s+', ' ', 'g')) AS card
  FROM documents),
badged AS (
  SELECT *, CASE %(cases)s END AS verdict FROM raw WHERE length(card) >= 30),
cards AS (
  SELECT *, CASE verdict %(cuts)s ELSE card END AS body FROM badged)""" % {
    "site": views.SITE,
    "cases": " ".join(
        rf"WHEN regexp_matches(card, '(?i)(^|[^\p{{L}}\p{{N}}_]){b}($|[^\p{{L}}\p{{N}}_])') THEN '{b}'"
        for b in domain.LISTING_BADGES
    ),
    "cuts": " ".join(
        rf"WHEN '{b}' THEN trim(regexp_replace(card, '(?i)^(?:{b}\s*)+', ''))" for b in domain.LISTING_BADGES
    ),
}
oracle("labelled_cards", CARDS, """
SELECT listing_page, CAST(pos AS INTEGER) AS pos, url, verdict, md5(body) AS card_md5 FROM cards""")
oracle("listing_cards", CARDS + """,
pages_of AS (SELECT p.listing_page, (SELECT count(*) FROM cards c WHERE c.listing_page = p.listing_page) AS n
  FROM (SELECT DISTINCT listing_page FROM raw) p),
streaks AS (SELECT listing_page, n, lag(n) OVER (ORDER BY listing_page) AS before,
  lag(listing_page) OVER (ORDER BY listing_page) AS page_before FROM pages_of),
stop AS (SELECT coalesce(min(CASE WHEN n = 0 AND before = 0 AND page_before = listing_page - 1
  THEN listing_page END), 1000000000) AS stop FROM streaks),
firsts AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY listing_page, pos) AS rn FROM cards
  WHERE listing_page < (SELECT stop FROM stop))""", """
SELECT url, verdict, md5(body) AS card_md5, listing_page FROM firsts WHERE rn = 1""")
oracle("archive_end", """
minutes AS (
  SELECT CAST(floor((epoch(date_trunc('second', ts)) - (SELECT epoch(date_trunc('second', min(ts))) FROM events)) / 60) AS BIGINT) AS m,
    event_type FROM events),
counts AS (SELECT m // 10 AS page, count(*) FILTER (event_type = 'purchase') AS n FROM minutes GROUP BY 1),
flagged AS (SELECT page, n, lag(page, 1, -1) OVER (ORDER BY page) AS page_before,
  lag(n) OVER (ORDER BY page) AS n_before FROM counts)""", """
SELECT CAST(coalesce(min(CASE WHEN page_before <> page - 1 THEN page_before + 1
    WHEN n = 0 AND n_before = 0 THEN page END),
  (SELECT max(page) + 1 FROM counts)) AS BIGINT) AS stop FROM flagged""")
oracle("stride_sample", """
indexed AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i,
  count(*) OVER () AS n FROM documents)""", """
SELECT doc_id, lang FROM indexed WHERE i % greatest(1, n // 50) = 0 AND i // greatest(1, n // 50) < 50""")
oracle("dense_index", "", """
SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS idx FROM events""")
oracle("chosen_urls", "", "SELECT DISTINCT url FROM pages WHERE url LIKE '%/%'")

oracle("chosen_listing_urls", ORACLES["listing_cards"].removeprefix("WITH ").rsplit("SELECT url, verdict", 1)[0], """
SELECT url FROM firsts WHERE rn = 1""")

# --- incremental harvest

oracle("harvest_targets", "", """
SELECT 'u' || CAST(n_chars AS VARCHAR) AS url, arg_min(lang, doc_id) AS verdict, min(doc_id) AS seq
FROM documents GROUP BY n_chars""")
oracle("harvest_pending", CLAIMS, "SELECT url, verdict, seq FROM claims WHERE NOT has_claimreview")
oracle("harvest_head", CLAIMS, """
SELECT url, seq FROM claims WHERE NOT has_claimreview ORDER BY seq LIMIT 25""")
oracle("harvest_upsert", CLAIMS + """,
sides AS (SELECT 'u' || CAST(d.n_chars AS VARCHAR) AS url, c.verdict, c.rating, c.has_claimreview, c.seq,
    CASE WHEN c.verdict = 'Falso' THEN 0 ELSE 1 END AS gen
  FROM claims c JOIN docs d ON d.doc_id = c.seq),
newest AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY gen DESC, seq DESC) AS rn FROM sides)""", """
SELECT url, verdict, rating, has_claimreview, seq FROM newest WHERE rn = 1""")
oracle("harvest_progress", CLAIMS, """
SELECT count(*) AS n_rows, count(claim_reviewed) AS n_filled,
  round(count(claim_reviewed) / count(*), 6) AS fill_share FROM claims""")

# --- quality and profiling

for _name, _col in (("verdict_counts", "verdict"), ("rating_counts", "rating")):
    oracle(_name, CLAIMS, f"""
SELECT {_col} AS value, count(*) AS n,
  round(count(*) * 100.0 / (SELECT count(*) FROM claims), 6) AS pct FROM claims GROUP BY 1""")
oracle("null_alarm", CLAIMS, """
SELECT round(avg(CASE WHEN rating IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share,
  avg(CASE WHEN rating IS NULL THEN 1.0 ELSE 0.0 END) > 0.1 AS warn FROM claims""")
oracle("claim_date_range", CLAIMS, """
SELECT min(substr(pub_date, 1, 10)) AS first_day, max(substr(pub_date, 1, 10)) AS last_day FROM claims""")
oracle("fill_rates", CLAIMS, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(count({c}) / count(*), 6) AS share FROM claims"
    for c in domain.CLAIM_COLUMNS))
oracle("markup_coverage", CLAIMS, """
SELECT round(avg(CASE WHEN jsonld_types LIKE '%ClaimReview%' THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  avg(CASE WHEN jsonld_types LIKE '%ClaimReview%' THEN 1.0 ELSE 0.0 END) > 0.5 AS recommend FROM claims""")
oracle("date_plausibility", CLAIMS, f"""
SELECT count(DISTINCT pub_date) AS n_distinct, min(substr(pub_date, 1, 10)) AS first_day,
  max(substr(pub_date, 1, 10)) AS last_day,
  round(avg(CASE WHEN substr(pub_date, 1, 10) = '{AS_OF}' THEN 1.0 ELSE 0.0 END), 6) AS as_of_share,
  avg(CASE WHEN substr(pub_date, 1, 10) = '{AS_OF}' THEN 1.0 ELSE 0.0 END) > 0.5
    OR count(DISTINCT pub_date) <= 2 AS warn FROM claims""")


def _missing(source: str, columns) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing,"
        f" round_even(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) AS percent FROM {source}"
        for c in columns
    )
    return f"SELECT * FROM ({parts}) WHERE n_missing > 0"


EDA_COLUMNS = ("seq", "url", "verdict", "corpus", "rating", "date", "has_review")
LISTED = ORACLES["listing_cards"].removeprefix("WITH ").rsplit("SELECT url, verdict", 1)[0]
oracle("recon_summary", LISTED + """,
listed AS (SELECT * FROM firsts WHERE rn = 1),
site AS (SELECT url, arg_min(CASE WHEN page_id % 5 <> 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END, page_id) AS lastmod
  FROM pages GROUP BY url),
""" + ARTICLE.strip() + f""",
sample AS (SELECT *, CASE WHEN date_jsonld IS NOT NULL THEN date_jsonld WHEN lang = 'en' THEN published END AS stamp
  FROM fields WHERE has_page),
days AS (SELECT stamp, substr(stamp, 1, 10) AS day FROM sample WHERE stamp IS NOT NULL),
n AS (SELECT count(*) AS n, avg(CASE WHEN verdict IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM listed)""", f"""
SELECT 'listing' AS section, 'n_listing' AS metric, CAST(n AS VARCHAR) AS value FROM n
UNION ALL SELECT 'listing', 'verdict_null_share', CAST(round(missing, 4) AS VARCHAR) FROM n
UNION ALL SELECT 'listing', 'verdict_warn', CAST(missing > 0.1 AS VARCHAR) FROM n
UNION ALL SELECT 'verdicts', coalesce(verdict, 'None'),
  count(*) || ' (' || format('{{:.1f}}', round(count(*) * 100.0 / (SELECT n FROM n), 1)) || '%)' FROM listed GROUP BY verdict
UNION ALL SELECT 'sitemap', 'n_sitemap', CAST(count(*) AS VARCHAR) FROM site
UNION ALL SELECT 'sitemap', 'first_day', min(lastmod) FROM site
UNION ALL SELECT 'sitemap', 'last_day', max(lastmod) FROM site
UNION ALL SELECT 'sample', 'n_sample', CAST(count(*) AS VARCHAR) FROM sample
UNION ALL SELECT 'sample', 'title_filled', '1.0'
UNION ALL SELECT 'sample', 'pub_date_raw_filled', CAST(round(count(stamp) / count(*), 4) AS VARCHAR) FROM sample
UNION ALL SELECT 'sample', 'claim_reviewed_filled', CAST(round(count(claim) / count(*), 4) AS VARCHAR) FROM sample
UNION ALL SELECT 'sample', 'claimant_filled', CAST(round(count(claimant) / count(*), 4) AS VARCHAR) FROM sample
UNION ALL SELECT 'sample', 'tags_filled', CAST(round(count(keywords) / count(*), 4) AS VARCHAR) FROM sample
UNION ALL SELECT 'sample', 'markup_coverage',
  CAST(round(avg(CASE WHEN jsonld_types LIKE '%ClaimReview%' THEN 1.0 ELSE 0.0 END), 4) AS VARCHAR) FROM sample
UNION ALL SELECT 'sample', 'markup_recommend',
  CAST(avg(CASE WHEN jsonld_types LIKE '%ClaimReview%' THEN 1.0 ELSE 0.0 END) > 0.5 AS VARCHAR) FROM sample
UNION ALL SELECT 'dates', 'n_distinct', CAST(count(DISTINCT stamp) AS VARCHAR) FROM days
UNION ALL SELECT 'dates', 'first_day', min(day) FROM days
UNION ALL SELECT 'dates', 'last_day', max(day) FROM days
UNION ALL SELECT 'dates', 'as_of_share', CAST(round(avg(CASE WHEN day = '{AS_OF}' THEN 1.0 ELSE 0.0 END), 4) AS VARCHAR) FROM days
UNION ALL SELECT 'dates', 'warn', CAST(avg(CASE WHEN day = '{AS_OF}' THEN 1.0 ELSE 0.0 END) > 0.5 OR count(DISTINCT stamp) <= 2 AS VARCHAR) FROM days""")
oracle("missing_table", EDA, _missing("eda", EDA_COLUMNS))
oracle("missing_after_selection", EDA + """,
kept AS (SELECT * REPLACE (CASE WHEN rating <> 'Verdadero pero' THEN rating END AS rating)
  FROM eda WHERE corpus IS NOT NULL)""", _missing("kept", EDA_COLUMNS))
oracle("nullity_patterns", EDA, """
SELECT verdict IS NULL AS verdict, corpus IS NULL AS corpus, rating IS NULL AS rating,
  date IS NULL AS date, has_review IS NULL AS has_review, count(*) AS n FROM eda GROUP BY ALL""")
oracle("nullity_correlation", EDA + """,
flags AS (SELECT CAST(corpus IS NULL AS INTEGER) AS c, CAST(rating IS NULL AS INTEGER) AS r,
  CAST(verdict = 'Falso' AS INTEGER) AS v FROM eda)""", """
SELECT 'corpus' AS left_column, 'rating' AS right_column, round(corr(c, r), 6) AS correlation FROM flags
UNION ALL SELECT 'corpus', 'verdict', round(corr(c, v), 6) FROM flags
UNION ALL SELECT 'rating', 'verdict', round(corr(r, v), 6) FROM flags""")
oracle("duplicate_counts", "", """
SELECT 'row' AS kind, (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n
UNION ALL
SELECT 'text', (SELECT count(*) FROM documents) - (SELECT count(DISTINCT text) FROM documents)""")
oracle("shape_table", EDA, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, count({c}) AS n_filled FROM eda"
    for c, t in zip(EDA_COLUMNS, ("bigint", *["string"] * 5, "boolean"))))
oracle("class_retention", EDA, """
SELECT verdict, count(*) AS n_before, count(corpus) AS n_after,
  round_even(count(corpus) * 100.0 / count(*), 1) AS retention_pct
FROM eda WHERE verdict IS NOT NULL GROUP BY 1""")
oracle("class_share_shift", EDA, """
SELECT verdict, round(count(*) / sum(count(*)) OVER (), 6) AS share_before,
  round(count(corpus) / sum(count(corpus)) OVER (), 6) AS share_after,
  round(count(corpus) / sum(count(corpus)) OVER () - count(*) / sum(count(*)) OVER (), 6) AS shift
FROM eda WHERE verdict IS NOT NULL GROUP BY 1""")
for _name, _part, _at in (("claims_per_year", "year", "1, 4"), ("claims_per_month", "month", "6, 2")):
    oracle(_name, DATASET, f"""
SELECT CAST(substr(date, {_at}) AS INTEGER) AS {_part}, count(*) AS n FROM dataset GROUP BY 1""")
oracle("label_drift", DATASET, "SELECT CAST(substr(date, 1, 4) AS INTEGER) AS year, " + ", ".join(
    f"count(*) FILTER (label = '{c}') AS \"{c}\"" for c in domain.LABELS) + " FROM dataset GROUP BY 1")
oracle("verdict_and_rating", EDA, """
SELECT 'verdict' AS "column", verdict AS value, count(*) AS n FROM eda WHERE verdict IS NOT NULL GROUP BY 2
UNION ALL SELECT 'rating', rating, count(*) FROM eda WHERE rating IS NOT NULL GROUP BY 2""")
oracle("label_disagreements", EDA, """
SELECT seq, verdict, rating FROM eda WHERE NOT coalesce(verdict = rating, false)""")
oracle("disagreement_count", EDA, """
SELECT count(*) AS n FROM eda WHERE NOT coalesce(verdict = rating, false)""")


def _describe(expr: str, source: str) -> str:
    quantiles = ", ".join(
        f"round(quantile_cont(x, {q}), 6) AS p{round(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    )
    return (
        f"SELECT CAST(count(x) AS DOUBLE) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,"
        f" CAST(min(x) AS DOUBLE) AS min, {quantiles}, CAST(max(x) AS DOUBLE) AS max"
        f" FROM (SELECT CAST({expr} AS DOUBLE) AS x FROM {source})"
    )


oracle("length_description", "", _describe(r"len(regexp_extract_all(text, '\S+'))", "documents"))
oracle("single_token_texts", "", r"""
SELECT doc_id, text FROM documents WHERE len(regexp_extract_all(text, '\S+')) = 1""")
oracle("length_histogram", DATASET, "SELECT label, n_words, count(*) AS n FROM dataset GROUP BY ALL")
oracle("length_density", DATASET + """,
stats AS (SELECT label, count(*) AS n, min(n_words) AS lo, max(n_words) AS hi,
  stddev_samp(n_words) * pow(count(*), -0.2) AS bw FROM dataset GROUP BY 1),
grid AS (SELECT s.*, g.point, (lo - 3 * bw) + ((hi + 3 * bw) - (lo - 3 * bw)) * g.point / 199 AS x
  FROM stats s, range(200) g(point))""", """
SELECT g.label, CAST(g.point AS INTEGER) AS point, round(g.x, 4) AS x,
  round(sum(exp(-0.5 * pow((g.x - d.n_words) / g.bw, 2)))
    / (g.bw * sqrt(2 * pi()) * (SELECT count(*) FROM dataset)), 8) AS density
FROM grid g JOIN dataset d ON d.label = g.label GROUP BY g.label, g.point, g.x, g.bw""")
oracle("short_text_crosstab", "", r"""
SELECT CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words,
  count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es,
  count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de
FROM documents WHERE len(regexp_extract_all(text, '\S+')) <= 5 GROUP BY 1""")
oracle("label_leaks", "", " UNION ALL ".join(
    rf"SELECT '{w}' AS word, count(*) FILTER (regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])')) AS n,"
    rf" count(*) FILTER (regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])')) > 0 AS warn FROM documents"
    for w in ("the", "pour", "más", "falso")))
oracle("class_distribution", DATASET + """,
places AS (SELECT * FROM (VALUES (0, 'Falso'), (1, 'Cuestionable'), (2, 'Verdadero'), (3, 'Engañoso')) v(position, label))""", """
SELECT CAST(p.position AS INTEGER) AS position, p.label, c.n FROM places p
LEFT JOIN (SELECT label, count(*) AS n FROM dataset GROUP BY 1) c ON c.label = p.label""")

# --- terms

oracle("plain_texts", TOKENS, """
SELECT doc_id, md5(plain) AS text_md5, md5(translate(text, 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU')) AS unaccented_md5
FROM plain""")
oracle("document_tokens", TOKENS, """
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5
FROM tokenised""")
oracle("term_frequency", TOKENS, "SELECT term, count(*) AS n FROM terms GROUP BY 1")
oracle("top_terms", TOKENS + """,
counts AS (SELECT label, term, count(*) AS n FROM terms GROUP BY ALL),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS INTEGER) AS rank FROM counts)""", """
SELECT label, term, n, rank FROM placed WHERE rank <= 10""")
oracle("distinctive_terms", TOKENS + """,
counts AS (SELECT label, term, count(*) AS n FROM terms GROUP BY ALL),
lifted AS (SELECT label, term, n,
  (n / sum(n) OVER (PARTITION BY label)) / (sum(n) OVER (PARTITION BY term) / sum(n) OVER ()) AS lift FROM counts),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY lift DESC, term) AS INTEGER) AS rank
  FROM lifted WHERE n >= 3)""", """
SELECT label, term, n, round(lift, 6) AS lift, rank FROM placed WHERE rank <= 15""")
oracle("frequent_vocabulary", TOKENS, """
SELECT term, count(*) AS n FROM terms GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 50""")
oracle("nearest_vectors", """
unit AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS len FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id,
  round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (a.len * b.len), 6) AS score
  FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank FROM pairs)""", """
SELECT query_id, neighbour_id, score, rank FROM placed WHERE rank <= 5""")
oracle("subword_lengths", "", _describe(
    r"2 + list_sum(list_transform(regexp_extract_all(text, '\S+'), lambda w: (length(w) + 3) // 4))", "documents"))
PIECES = r"""
pieces AS (SELECT lang, CAST(2 + list_sum(list_transform(regexp_extract_all(text, '\S+'), lambda w: (length(w) + 3) // 4)) AS BIGINT) AS n_pieces
  FROM documents)"""
oracle("subword_histogram", PIECES, "SELECT lang, n_pieces, count(*) AS n FROM pieces GROUP BY ALL")
oracle("subword_density", PIECES + """,
stats AS (SELECT lang, min(n_pieces) AS lo, max(n_pieces) AS hi, stddev_samp(n_pieces) * pow(count(*), -0.2) AS bw FROM pieces GROUP BY 1),
grid AS (SELECT s.*, g.point, (lo - 3 * bw) + ((hi + 3 * bw) - (lo - 3 * bw)) * g.point / 199 AS x FROM stats s, range(200) g(point))""", """
SELECT g.lang, CAST(g.point AS INTEGER) AS point, round(g.x, 4) AS x,
  round(sum(exp(-0.5 * pow((g.x - d.n_pieces) / g.bw, 2))) / (g.bw * sqrt(2 * pi()) * (SELECT count(*) FROM pieces)), 8) AS density
FROM grid g JOIN pieces d ON d.lang = g.lang GROUP BY g.lang, g.point, g.x, g.bw""")
oracle("per_step_difference", "", """
SELECT event_id, round(value - lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS per_step
FROM events""")

oracle("word_vector_frequencies", DATASET + f""",
words AS (SELECT unnest(list_filter(regexp_extract_all(
    regexp_replace(translate(lower(text), 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\S+'),
    lambda t: regexp_full_match(t, '\\p{{L}}+') AND length(t) > 2 AND t NOT IN ({STOPWORDS}))) AS term FROM dataset)""", """
SELECT term, count(*) AS n, CAST(100 AS INTEGER) AS dims FROM words GROUP BY 1 HAVING count(*) >= 2""")

# --- modelling and evaluation

oracle("class_weights", SPLITS + """,
counts AS (SELECT label, count(*) AS n FROM splits WHERE split = 'train' GROUP BY 1),
places AS (SELECT * FROM (VALUES (0, 'Cuestionable'), (1, 'Falso'), (2, 'Verdadero')) v(label_id, label))""", """
SELECT CAST(p.label_id AS INTEGER) AS label_id, p.label, coalesce(c.n, 0) AS n,
  round((SELECT sum(n) FROM counts) / nullif(3 * c.n, 0), 6) AS weight
FROM places p LEFT JOIN counts c ON c.label = p.label""")
oracle("tfidf_documents", r"""
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
grams AS (
  SELECT doc_id, unnest(t) AS term FROM toks
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
raw AS (SELECT tf.doc_id, tf.term, df.df,
  tf.tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df.df)) + 1.0) AS w
  FROM tf JOIN df ON df.term = tf.term),
scaled AS (SELECT doc_id, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)""", """
SELECT doc_id, count(*) AS n_terms, round(sum(w), 4) AS weight_sum, round(max(w), 6) AS weight_max,
  CAST(sum(df) AS BIGINT) AS df_sum FROM scaled GROUP BY 1""")
oracle("fold_counts", DATASET.replace("dataset AS (", "base AS (") + """,
placed AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || text)) AS pos,
  count(*) OVER (PARTITION BY label) AS n FROM base),
folded AS (SELECT label, CASE WHEN pos <= round_even(n / 3, 0) THEN 0
  WHEN pos <= 2 * round_even(n / 3, 0) THEN 1 ELSE 2 END AS fold FROM placed)""", """
SELECT label, CAST(fold AS INTEGER) AS fold, count(*) AS n FROM folded GROUP BY ALL""")
oracle("smote_counts", """
counts AS (SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings GROUP BY 1)""", """
SELECT label, (SELECT max(n) FROM counts) AS n, (SELECT max(n) FROM counts) - n AS n_synthetic FROM counts""")


def _softmax(source: str) -> str:
    return f""",
exps AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb,
  exp(c - greatest(a, b, c)) AS ec FROM {source}),
probs AS (SELECT *, ea / (ea + eb + ec) AS p0, eb / (ea + eb + ec) AS p1, ec / (ea + eb + ec) AS p2,
  CASE WHEN a >= b AND a >= c THEN 'Cuestionable' WHEN b >= c THEN 'Falso' ELSE 'Verdadero' END AS best
  FROM exps)"""


oracle("external_predictions", """
wide AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
logits AS (SELECT vec_id, sum(x) FILTER (i % 3 = 0) AS a, sum(x) FILTER (i % 3 = 1) AS b,
  sum(x) FILTER (i % 3 = 2) AS c FROM wide GROUP BY 1)""" + _softmax("logits"), """
SELECT vec_id, best AS prediction, round(p0, 4) AS p0, round(p1, 4) AS p1, round(p2, 4) AS p2 FROM probs""")
oracle("ranked_class_scores", """
wide AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i
  FROM embeddings WHERE label <> 0),
logits AS (SELECT vec_id, sum(x * x) FILTER (i < 21) AS a, sum(x * x) FILTER (i BETWEEN 21 AND 41) AS b,
  sum(x * x) FILTER (i BETWEEN 42 AND 62) AS c FROM wide GROUP BY 1)""" + _softmax("logits"), """
SELECT vec_id, CAST(0 AS INTEGER) AS position, 'Falso' AS label, round(p1, 4) AS score, best AS best_label FROM probs
UNION ALL SELECT vec_id, 1, 'Cuestionable', round(p0, 4), best FROM probs
UNION ALL SELECT vec_id, 2, 'Verdadero', round(p2, 4), best FROM probs""")
ORACLES["ranked_class_scores_whole"] = ORACLES["ranked_class_scores"].replace("i BETWEEN 42 AND 62", "i >= 42")
oracle("confusion_matrix", PREDICTIONS + """,
places AS (SELECT * FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R'), (3, 'X')) v(position, truth))""",
    "SELECT CAST(p.position AS INTEGER) AS position, p.truth, " + ", ".join(
    f"count(*) FILTER (q.prediction = '{c}') AS \"{c}\"" for c in (*FLAGS, "X"))
    + " FROM places p LEFT JOIN predictions q ON q.label = p.truth GROUP BY 1, 2")
oracle("macro_f1", SCORES, "SELECT round(avg(f1), 6) AS macro_f1 FROM scores")
ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
oracle("class_scores", SCORES, f"SELECT label, {ROUNDED}, support FROM scores")
oracle("classification_report", SCORES + """,
n AS (SELECT CAST(sum(support) AS BIGINT) AS n FROM scores),
rows_ AS (
  SELECT label, precision, recall, f1, support FROM scores
  UNION ALL SELECT 'accuracy', (SELECT sum(n_hit) FROM hits) / n, (SELECT sum(n_hit) FROM hits) / n,
    (SELECT sum(n_hit) FROM hits) / n, n FROM n
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM scores
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM scores)""",
    f"SELECT label, {ROUNDED}, support FROM rows_")
_CELL = "(SELECT count(*) FROM predictions WHERE label = '{}' AND prediction = '{}')"
oracle("evaluation_document", SCORES, """
SELECT 'test' AS split, (SELECT count(*) FROM predictions) AS n,
  (SELECT round_even(avg(f1), 4) FROM scores) AS macro_f1, true AS interval_holds,
  '{"labels":["A","N","R"],"rows_true":[' || """ + " || ',' || ".join(
    "'[' || " + " || ',' || ".join(_CELL.format(t, p) for p in FLAGS) + " || ']'" for t in FLAGS
) + """ || ']}' AS matrix, label, round_even(f1, 4) AS f1 FROM scores""")
oracle("baseline_report", SPLITS + """,
counts AS (SELECT split, label, count(*) AS support FROM splits WHERE split <> 'train' GROUP BY ALL)""", """
SELECT split, label, support, true AS sound FROM counts
UNION ALL SELECT split, s.label, CAST(sum(support) AS BIGINT), true
FROM counts, (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) s(label) GROUP BY split, s.label""")
oracle("smote_classifier", SPLITS + """,
placed AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || text)) AS place,
  count(*) OVER (PARTITION BY label) AS n FROM splits WHERE split = 'train'),
folded AS (SELECT CASE WHEN place <= round_even(n / 3, 0) THEN 0
  WHEN place <= 2 * round_even(n / 3, 0) THEN 1 ELSE 2 END AS fold FROM placed)""", """
SELECT CAST(fold AS INTEGER) AS fold, g.c, count(*) AS n_held, true AS consistent
FROM folded, (VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0)) g(c) GROUP BY ALL""")
oracle("bootstrap_summary", SCORES, """
SELECT CAST(1000 AS BIGINT) AS replicates, (SELECT count(*) FROM predictions) AS draws,
  (SELECT round(avg(f1), 6) FROM scores) AS point, true AS low_holds, true AS high_holds""")
oracle("first_errors", PREDICTIONS, """
SELECT l_orderkey * 10 + l_linenumber AS line, label, prediction FROM predictions WHERE label <> prediction
ORDER BY md5(label || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)) LIMIT 15""")
oracle("model_comparison", PREDICTIONS + """,
guesses AS (
  SELECT 'quantity' AS model, split, label, prediction FROM predictions
  UNION ALL SELECT 'always A', split, label, 'A' FROM predictions),
sides AS (
  SELECT model, split, label AS c, 1 AS t, 0 AS p, CAST(label = prediction AS INTEGER) AS h FROM guesses
  UNION ALL SELECT model, split, prediction, 0, 1, 0 FROM guesses),
f AS (SELECT model, split, c, 2.0 * sum(h) / (sum(t) + sum(p)) AS f1 FROM sides GROUP BY ALL)""", """
SELECT model, split, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY ALL""")
