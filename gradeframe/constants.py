"""Fixed values.

Everything in this file has to equal the published scoring recipe for the
results to agree with it: patterns, thresholds, ranges, constants and weights.
"""

import string

# --- Text cleaning: (pattern, replacement), applied in this order after lower().
# Python's Unicode-aware \w, \d and \s are spelled out as explicit classes so
# that Java, RE2 and Python agree.
CLEANING_STEPS = [
    (r"<[^\n]*?>", ""),
    (r"@[\p{L}\p{N}_]+", ""),
    (r"'\p{Nd}+", ""),
    (r"\p{Nd}+", ""),
    (r"http[\p{L}\p{N}_]+", ""),
    (r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " "),
    (r"\.+", "."),
    (r",+", ","),
]
PUNCTUATION = string.punctuation

# --- Piece separators and filters.
PARAGRAPH_SEPARATOR = "\n\n"
MIN_SENTENCE_LENGTH = 15

# --- Thresholds of the counting features.
PARAGRAPH_AT_LEAST = [0, 50, 75, 100, 125, 150, 175, 200, 250, 300, 350, 400, 500, 600, 700]
PARAGRAPH_AT_MOST = [25, 49]
SENTENCE_AT_LEAST = [0, 15, 50, 100, 150, 200, 250, 300]
SENTENCE_AT_MOST = [15, 50]
WORD_AT_LEAST = list(range(1, 16))

# --- n-gram vectorizers: size range and document-frequency limits (fractions).
TFIDF_SIZES = (3, 6)
TFIDF_DF = (0.05, 0.95)
COUNT_SIZES = (2, 3)
COUNT_DF = (0.10, 0.85)

# --- Target scale.
SCORE_MIN, SCORE_MAX = 1, 6
SCORE_CENTRE = 2.998
SCORE_VARIANCE = 1.092

# --- Splits.
N_FOLDS = 5
FOLD_SEED = 2018
SELECTION_FOLD_SEED = 0
HOLDOUT_FRACTION = 0.4
HOLDOUT_SEED = 42
SAMPLE_ROWS = 100

# --- Training.
PATIENCE = 75
DEFAULT_ROUNDS = 150
FEATURE_CAP = 13000

# --- Blend of the two learners.
BLEND_WEIGHTS = (0.76, 0.24)

# --- The two learners: shrinkage, depth, L1 and L2 leaf penalties, share of the
# features offered to each tree, most rounds, seed, most leaves, random thresholds, least rows of a leaf.
LEARNERS = {
    "first": dict(
        learning_rate=0.05, max_depth=5, l1=2.0, l2=0.1, feature_share=0.3, max_rounds=700, seed=42,
        max_leaves=10, random_thresholds=True, min_rows=20,
    ),
    "second": dict(
        learning_rate=0.1, max_depth=5, l1=1.0, l2=0.1, feature_share=0.5, max_rounds=1024, seed=42
    ),
}
# The stand-alone feature selection run uses these values instead.
SELECTION_LEARNER = LEARNERS["first"] | dict(l1=0.7, seed=412)
