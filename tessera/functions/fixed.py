"""Fixed values that results depend on."""

#: Words left out of a business name's core (fixed values).
STOP_WORDS = [
    "inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "co", "company",
    "and", "or", "of", "the", "group", "holdings", "international", "services", "enterprises",
    "pvt", "private", "llp", "gmbh", "sa", "spa", "bv", "plc", "lp",
]

#: Cell texts that a TSV reader with pandas semantics reads as missing (fixed values).
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

#: BM25 constants (fixed values).
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

#: Caps and thresholds of the candidate stages (fixed values).
BUCKET_ROWS, PURGE_IDS, ARRIVALS = 200, 200, 50
RARE_TOKEN_INDEX, RARE_NUMBER_INDEX, RARE_RUNNING, RARE_TOKEN_QUERY = 100, 500, 500, 50
CHAR_THRESHOLD, WORD_THRESHOLD = 0.3, 0.2
STRUCTURAL_BASE, STRUCTURAL_STREAM = 0.1, 0.15
MATCH_PROBABILITY, RERANK_SCORE, MODEL_TOP = 0.50, 0.45, 10
"""Decision thresholds: strict above the first, at or above the second."""
