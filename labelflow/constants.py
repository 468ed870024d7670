"""Fixed values.

The values in this module must equal the reference behaviour for equal
results (label order, missing-value tokens, patterns, parameters). They are
stated plainly here and nowhere else.
"""

# --- Fixed values: class labels in label_id order (negative 0, neutral 1, positive 2).
LABELS = ("negative", "neutral", "positive")

# --- Fixed values: raw CSV fields read as missing (the pandas read_csv default NA set).
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

# --- Fixed values: required columns of the strict and the lenient loader.
REQUIRED_STRICT = ("text", "language", "label")
REQUIRED_LENIENT = ("text", "label")

# --- Fixed values: patterns.
# Python ``str.strip()`` whitespace (Unicode White_Space plus U+001C..U+001F),
# built from its definition (``str.isspace``).
STRIP_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Word tokens: runs of two or more letters, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# --- Fixed values: split, features, model and report parameters.
RANDOM_STATE = 42
TEST_SIZE = 0.3
VAL_TEST_SIZE = 0.5
MAX_FEATURES = 5000
MAX_LENGTH = 128
BATCH_ROWS = 8  # texts of a batch that is padded to its own longest
MAX_ITER = 1000
INVERSE_REG = 1.0  # C of the L2-penalised logistic regression
TOL = 1e-4  # stopping tolerance of the classifier's optimiser
DIGITS = 4

# --- Fixed values: presentation headers.
SUMMARY_HEADERS = {
    "model": "Модель",
    "accuracy": "Accuracy",
    "precision_weighted": "Precision",
    "recall_weighted": "Recall",
    "f1_weighted": "F1-score",
}
CLASS_TABLE_HEADERS = {
    "row_name": "Класс",
    "precision": "Precision",
    "recall": "Recall",
    "f1_score": "F1-score",
}
REPORT_ACCURACY = "accuracy"
REPORT_MACRO = "macro avg"
REPORT_WEIGHTED = "weighted avg"

# --- Our own choices (not from the reference).
PAD_ID = 0  # id of padding in fixed-length encodings
UNK_ID = 1  # id of a word outside the vocabulary; vocabulary ids start at 2
SPLIT_BUCKET_HEX_DIGITS = 4  # 16**4 hash buckets per class in the exact split
FIT_ROWS_PER_PARTITION = 50_000  # training rows per partition of the optimiser's input
