"""Table schemas, and the numeric defaults that are part of the semantics."""

from __future__ import annotations

from pyspark.sql import types as T

RATINGS = T.StructType(
    [
        T.StructField("userId", T.LongType()),
        T.StructField("movieId", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

CATALOGUE = T.StructType(
    [
        T.StructField("movieId", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("genres", T.StringType()),
    ]
)

ID_MAP = T.StructType([T.StructField("idx", T.LongType()), T.StructField("raw_id", T.LongType())])

SPLITS = ("train", "val", "test")

# They decide results, so they equal the published configuration.
MAX_SEQ_LEN = 200
MIN_SEQ_LEN = 0
SEQ_STEP = 96
K_LIST = (10, 20, 50, 100)
TEMPERATURE = 0.05
MINING_TOP_K = 100
MINING_SKIP_TOP = 20
RANDOM_NEGATIVES = 2
EXPLICIT_NEG_WEIGHT = 4.0
RANDOM_NEG_RATIO = 1.0
PROMPT_HISTORY_LEN = 10
PROMPT_MIN_HISTORY = 5
RETRIEVAL_K = 100
LOG_EPS = 1e-10
STD_EPS = 1e-6
MASKED = -1e9
UNSCORED = -999.0
SEED = 42
