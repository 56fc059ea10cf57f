import pytest

LONG = "Lorem ipsum dolor " * 20_000 + "mail a.b@c.example " + "x" * 100_000

#: Nulls in any column, empty and very long texts, ties and repeated rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and the cat sits by", "en", "a", 10),
    (1, "The quick brown fox jumps over the lazy dog and the cat sits by", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog and the cat sits by", "en", "b", 10),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (None, "le chat est sur la table et le chien est dans la maison avec nous", "fr", "a", 5),
    (5, " \t\n", "fr", "", 3),
    (6, LONG, None, "b", 1),
    (7, "le chien et le chat sont dans la maison", "fr", None, 2),
    (8, "CC by this, released under the mit license. All rights reserved", "en", "b", 2),
    (9, "1234 5678 9012 3452 and 10.0.0.1, call +1 (555) 010-9999 or 999.1.1.1", "en", "b", 2),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same documents with further columns named like results and helpers."""
    from pyspark.sql import functions as F

    names = ("score", "labels", "fp", "size", "copies", "spans", "rejected", "ids", "host", "kept", "u", "m", "target", "component_id", "root", "base", "n_words", "media", "__i", "__n", "__h", "__s", "__z", "__m", "__c", "__t", "__k", "__row", "__text", "__value", "__base", "__y", "__all", "k", "h", "row", "m0", "label", "part", "g", "t", "again", "c0", "fp0")
    return docs.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
