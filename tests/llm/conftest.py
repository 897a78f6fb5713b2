import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that is was for on with as by at from river stone cloud amber copper window garden letter".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 16) % len(WORDS)] + ("," if i % 11 == 10 else ".\n" if i % 17 == 16 else ""))
    return " ".join(out)


def rows() -> list[tuple]:
    texts = {1: None, 2: "", 3: " \n\t ", 4: "same text here", 5: "same text here", 7: prose(7, 30_000), 8: "Ünïcödé Σ ΑΣ İ naïve 漢字", 9: "one", 10: "a <|endoftext|> b  c\x00d\n\n e"}
    texts |= {i: prose(i, 40 + i) for i in range(20, 60)}
    texts[60] = texts[20] + " end"
    found = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in texts.items()]
    return [*found, found[4], (None, "no id at all", "en", "a", 12), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank and very long texts, repeated rows, ties, and extra columns of clashing names."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    for name in ("size", "shard", "slot", "key", "fp", "kind", "part", "token_ids", "decoded", "score", "words", "spaced", "__x"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain():
    return rows()
