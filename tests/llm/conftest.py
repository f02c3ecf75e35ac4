import pytest
from pyspark.sql import types as T

from llm_helpers import prose

#: Extra columns whose names operators use themselves.
CLASHING = (
    "fp fingerprint component_id size source_size target taken quota_blocks shard slot curve text_crc32 score predicted held_out kept "
    "perplexity base_failed row document share item_id windows toxic p_toxic pool pack ids verdict rule mined host path html_ n_words "
    "label key place word copy group row_key"
).split()


def odd_rows():
    long = prose(99, 60_000)
    return [
        (1, prose(1), "en", "a", 1),
        (2, prose(1), "en", "b", 1),  # a copy
        (3, prose(3) + "\nToDAY! é ß 東京", "de", "a", 1),
        (4, None, "en", "a", None),
        (5, "", "fr", None, 0),
        (6, " \t\n\x0b\x0c\r ", None, "c", 7),
        (7, long, "en", "a", len(long)),
        (7, long, "en", "a", len(long)),  # a repeated row
        (None, prose(8), None, None, None),
        (None, None, None, None, None),
        (9, "word", "en", "b", 4),
        (10, "x" * 300_000, "en", "b", 300_000),  # one very long word
        (11, prose(1) + " more", "en", "b", 2),
    ]


@pytest.fixture(scope="session")
def documents_schema():
    return T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )


@pytest.fixture(scope="session")
def odd(spark, documents_schema):
    return spark.createDataFrame(odd_rows(), documents_schema)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


@pytest.fixture(scope="session")
def none(spark, documents_schema):
    return spark.createDataFrame([], documents_schema)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(1, 12)] + [(None, 1, 1), (3, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
