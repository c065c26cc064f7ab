"""Fixed domain values. Every operator takes them as parameters with these defaults."""

# Verdict badges in priority order (multi-word labels before their prefix).
LISTING_BADGES = (
    "Chequeo Múltiple",
    "Verdadero pero",
    "Verdadero",
    "Cuestionable",
    "Falso",
    "Engañoso",
    "Inflado",
    "Aproximado",
    "Ligero",
)

# The two exact-match rating rewrites, applied in this sequence.
RATING_NORMALIZE = {"Verdadero pero...": "Verdadero pero"}
RATING_MERGE = {"Verdadero pero": "Verdadero"}

# The modelling classes (majority first), the binary positive, the split shares.
LABELS = ("Falso", "Cuestionable", "Verdadero")
BINARY_POSITIVE = "Falso"
SPLITS = (("train", 0.7), ("val", 0.15), ("test", 0.15))
SEED = 42

# Class ids follow the alphabetical order of the labels.
CLASSES = tuple(sorted(LABELS))

# Column order of the claim table, the dataset and the page sample.
CLAIM_COLUMNS = (
    "url",
    "verdict",
    "claim_reviewed",
    "rating",
    "pub_date",
    "jsonld_types",
    "has_claimreview",
)
DATASET_COLUMNS = ("text", "label", "label_binary", "date", "url", "split")

# Cell texts a CSV reader of the source data treats as missing.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
