import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns whose names an operator might want for itself.
CLASHING = "size bigint, target double, key string, h bigint, run int, passes int, score double, _text string, group string"

FRENCH, ENGLISH = "le la des une dans pour avec être où", "the and of with from this that would which"


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    rng = random.Random(4)
    english, french = ENGLISH.split(), FRENCH.split()
    rows = [(k, sentence(rng, english if k % 2 else french, 20 + k), "en" if k % 2 else "fr", f"s{k % 4}", 5)
            for k in range(40)]
    rows += [(100, None, "en", "s1", None), (101, "", None, "s1", 0), (102, " \n\t ", "fr", None, 4),
             (None, "no id here at all", "en", "s2", 9), (103, "one two", "en", None, 7), (104, "one two", "en", None, 7),
             (105, "ONE\ttwo", "fr", "s0", 7), (106, "12345 67890 !!", "en", "s0", 9)]
    rows += [(107, sentence(rng, english, 30000), "en", "s3", 1)]
    rows += [(108, "x" * 70000, "en", "s3", 70000), (109, "a copy of a text here", "en", "s1", 3)]
    rows += [(110, "a copy of a text here", "en", "s1", 3)] * 3  # repeated rows
    rows += [(111, "naïve café 東京 \U0001F600   x", "fr", "s2", 2), (112, rows[0][1], "fr", "s9", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark):
    """The same rows with extra columns of clashing names."""
    extra = (7, 0.5, "k", 3, 1, 9, 2.0, "t", "g")
    return spark.createDataFrame([(*r, *extra) for r in odd_rows()], f"{SCHEMA}, {CLASHING}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
