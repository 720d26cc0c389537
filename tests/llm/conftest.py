import os
import random

import pytest
from pyspark.sql import types as T

KINDS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that operators use themselves
        *(T.StructField(c, T.StringType()) for c in ("score", "row", "n", "doc", "size", "rank", "spans", "features", "label")),
    ]
)


def _texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 30, 60, 200]))) for _ in range(30)]
    near = []
    for text in base[:12]:
        parts = text.split(" ")
        for _ in range(3):
            copy = list(parts)
            copy[rng.randrange(len(copy))] = "changed"
            near.append(" ".join(copy))
    passage = " ".join(rng.choices(words, k=55))
    shared = [f"{rng.random()} {passage} {rng.random()}" for _ in range(8)]
    odd = [None, "", " ", "\n\t", "one", "One two", "ONE  two", "x " * 3000, "ab" * 400, "日本語 テキスト " * 20, "a\x00b c", passage]
    return base + near + shared + odd + base[:5] + base[:2]


@pytest.fixture(scope="session")
def edge_rows():
    """Ids with gaps, not in order, one of them null; nulls, ties, repeats and very long texts."""
    texts = _texts()
    ids = [(i * 37) % 1009 for i in range(len(texts))]
    rows = [(i, t, "en" if n % 3 else None, f"s{n % 4}" if n % 5 else None) for n, (i, t) in enumerate(zip(ids, texts))]
    rows.append((None, "a text without an id", "en", "s1"))
    rows.append(rows[3])  # the same row again
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows, tmp_path_factory):
    """Those rows as a stored table with more columns than needed, some of clashing names."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rows = [(*r, *(["other"] * 9)) for r in edge_rows]
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def table_dir(small_dir):
    return small_dir if os.path.isdir(small_dir) else None
