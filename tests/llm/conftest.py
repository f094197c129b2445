import pytest
from pyspark.sql import types as T

#: Columns beyond those of documents, named like ones that operators use inside.
CLASH = ["words", "counts", "limits", "spans", "sig", "id", "n_words", "kept", "_leak_key", "_extra", "at", "text_crc32"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows, with clashing extra columns."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASH]])

    def make(rows):
        full = []
        for r in rows:
            key, text, lang, source = (*r, "en", "src0")[:4] if len(r) == 2 else r
            full.append((key, text, lang, source, None if text is None else len(text), *["x"] * len(CLASH)))
        return spark.createDataFrame(full, schema)

    return make


WORDS = "the of and river stone maple orbit candle harbor signal velvet copper meadow lantern puzzle winter garden".split()


def prose(seed, n):
    """n words that depend on the seed."""
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er", "ful"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, texts, languages and sources, empty and very long texts, repeated rows."""
    return [
        (1, None, "en", "src0"), (2, "", "en", None), (3, " \t\n ", None, "src0"), (None, prose(1, 80), "en", "src0"),
        (4, prose(2, 60), "de", "src1"), (4, prose(2, 60), "de", "src1"), (5, "x" * 300_000, "en", "src0"),
        (6, prose(3, 30_000), "en", "src0"), (7, "é" * 50 + " 😀 " + "ß" * 20, "fr", "src2"), (8, "one", None, None),
        (None, None, None, None),
    ]
