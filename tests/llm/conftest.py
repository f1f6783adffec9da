import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (id, text) pairs."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def words():
    """Prose of `n` words from a seed."""
    import random

    def make(n, seed=0):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))

    return make


class Tables:
    """A folder of tables for queries that take one."""

    def __init__(self, path):
        self.path = str(path)

    def add(self, df, name):
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}.parquet")
        return self


@pytest.fixture
def tables(tmp_path):
    return Tables(tmp_path / "tables")
