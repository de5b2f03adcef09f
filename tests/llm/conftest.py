import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, kept boolean, row int, key string, copies int, number long, `class` string, `x` int, `at` int"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "ri", "no", "èl", "ku", "ßo"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def messy_rows() -> list[tuple]:
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (0, base, "a"),
        (1, base, "a"),
        (1, base, "a"),  # a repeated row
        (2, " ".join(near), "b"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n\x0b ", "b"),
        (6, "x" * 50_000, "a"),
        (7, words(2, 5_000) + "\n" + words(2, 5_000), "b"),
        (8, "one two", "c"),
        (9, "ONE two", "c"),
        (None, words(3, 60), None),
        (None, None, None),
        (10, 'token = "0123456789abcdef0123456789abcdef" ' + words(4, 60), "c"),
        (10, words(5, 40), "c"),  # a doc_id that two texts share
        (11, base + "\n" + "<|startoftext|> ΟΔΟΣ ﬁne İ", "a"),
        (12, "\n".join(["same line of words here"] * 40), "a"),
    ]
    return [(i, t, "en", s, len(t or ""), 7, "s", True, 1, "k", 2, 3, "c", 4, 5) for i, t, s in texts]


@pytest.fixture(scope="session")
def messy(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messy") / "documents.parquet")
    spark.createDataFrame(messy_rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
