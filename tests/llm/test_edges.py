"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from weirgate.llm import bpe_codec, html_text, language, license_scan, matroska, mixing, pii, quality, simhash_dedup, token_count

OPERATORS = {
    "licence": license_scan.scan_licenses,
    "pii": pii.find,
    "mixing": lambda d: mixing.of_rows(mixing.copies(d)),
    "simhash": simhash_dedup.near_duplicates,
    "html": lambda d: html_text.extract_text(d, "doc_id", "text"),
    "media": matroska.store_and_read,
    "bpe": lambda d: bpe_codec.digest(d, bpe_codec.default_path()),
    "quality": quality.judge,
    "count": lambda d: token_count.count_tokens(d, token_count.default_path()),
    "language": lambda d: language.predict(d, language.fit(d)),
}
#: Operators that keep rows: redaction, one of each, language, mix.
ROWWISE = {"redact": pii.redact, "one_of_each": simhash_dedup.one_of_each, "keep_known": lambda d: language.keep_known(d, language.fit(d)), "mixed": mixing.mixed}


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(docs, clashing, nothing, name):
    f = OPERATORS[name]
    got = rows(f(docs))
    assert len(got) == docs.count()
    assert rows(f(clashing)) == got
    assert f(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_rowwise(docs, clashing, nothing, name):
    f = ROWWISE[name]
    assert f(docs).columns == docs.columns and f(clashing).columns == clashing.columns
    assert rows(f(clashing).select(docs.columns)) == rows(f(docs))
    assert f(nothing).count() == 0


def test_one_of_each_keeps_one(docs):
    kept = simhash_dedup.one_of_each(docs).collect()
    texts = [r.text for r in kept]
    assert len([t for t in texts if t and t.startswith("The quick")]) == 1 and len([t for t in texts if not (t or "").strip()]) == 1
    assert sorted((r.doc_id for r in kept if r.doc_id), reverse=False)[:2] == [1, 3]


def test_null_columns(spark):
    d = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for f in OPERATORS.values():
        assert f(d).count() == 3
    assert simhash_dedup.one_of_each(d).count() == 1


def test_reruns_agree(docs):
    f = lambda d: rows(mixing.copies(d))
    assert f(docs) == f(docs.repartition(3)) == f(docs.orderBy(F.desc("doc_id")))
