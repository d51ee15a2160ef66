import random

import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations".split()
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score double, "
          "key string, copies int, path string")


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    words = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    prose = lambda n: " ".join(words.choice(vocabulary) for _ in range(n))
    long_text = prose(30_000)
    twin = prose(120)
    near = twin.replace(twin.split()[60], "other", 1)
    texts = [None, "", "   \n\t ", "one", "one two three four", twin, twin, near, long_text, long_text + " end",
             "é ü   ß 你好 \U0001f600 mail a.b@c.de +1 (555) 123-4567", "x" * 50_000, prose(50), prose(50)]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 3}", None, i, 0.5, "k", 1, "p") for i, t in enumerate(texts)]
    rows += [(100, twin, None, None, 3, None, None, None, None, None), (None, prose(40), "en", "s0", None, 1, 1.0, "k", 2, "q"),
             (None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[12]] * 3 + [rows[-1]] * 2 + [rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
