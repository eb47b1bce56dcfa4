"""Nulls in every column, empty and very long texts, repeated rows, clashing columns, empty tables."""

import public_tokenizers
import pytest

from tidemark.llm import bpe, decontaminate, html_text, licenses, quality, repeats, secrets, simhash, sketches, token_counts

MODEL, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = secrets.vocabulary_words([public_tokenizers.path(f) for f in secrets.VOCABULARIES])
LONG = "the mit license and token = abcdef0123456789abcd of all " * 4000
ROWS = [
    (1, "some plain words to read here and there", "en", "s", 39, "X", 1), (1, "some plain words to read here and there", "en", "s", 39, "X", 1),
    (2, None, None, None, None, None, None), (None, "no id at all", "en", None, 12, None, None), (None, None, None, None, None, None, None),
    (3, "", "en", "s", 0, "", 0), (4, LONG, "en", "s", len(LONG), "y", 2), (5, " \n\t ", "en", "s", 4, "z", 3), (6, LONG, "en", "s", len(LONG), "y", 2),
    (7, " " * 1_000_000, "en", "s", 1_000_000, "y", 2), (8, "w" * 300_000, "en", "s", 300_000, "y", 2),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, hits long"
LABELS = [(1, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1), (1, 1, 0)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "plain words to read"), (None, "no id at all"), (2, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def row_operators(items, labels):
    return {
        "tokens": lambda d: token_counts.count_tokens(d, RANKS),
        "secrets": lambda d: secrets.scan(d, WORDS),
        "bpe": lambda d: bpe.encode_decode(d, MODEL),
        "licenses": licenses.scan,
        "decontaminate": lambda d: decontaminate.report(d, items),
        "simhash": simhash.near_duplicates,
        "fingerprints": sketches.report,
        "repeats": repeats.repeats,
        "quality": lambda d: quality.resample(d, labels),
    }


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


NAMES = ["tokens", "secrets", "bpe", "licenses", "decontaminate", "simhash", "fingerprints", "repeats", "quality"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(odd, items, labels, name):
    got = row_operators(items, labels)[name](odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(odd, items, labels, name):
    assert row_operators(items, labels)[name](odd.limit(0)).count() == 0


def test_defined_results(odd, items):
    got = {r.doc_id: r for r in decontaminate.report(odd, items).where("doc_id IS NOT NULL").collect()}
    assert got[1].n_hit == 4 and not got[2].contaminated and got[5].n_words == 0
    got = {r.doc_id: r for r in repeats.repeats(odd).where("doc_id IS NOT NULL").collect()}
    assert got[4].n_removed == got[6].n_removed == len(LONG) and got[1].n_removed == got[2].n_bytes == 0
    assert (got[7].n_removed, got[7].n_spans, got[8].n_removed, got[8].n_spans) == (1_000_000, 1, 300_000, 1)
    got = {r.doc_id: r for r in simhash.near_duplicates(odd).where("doc_id IS NOT NULL").collect()}
    assert got[2].fingerprint == "0" * 16 and got[5].component_id == got[3].component_id == got[2].component_id == 2 and got[6].component_id == 4 and got[7].component_id == 2
    got = {r.doc_id: r for r in sketches.report(odd).where("doc_id IS NOT NULL").collect()}
    assert got[3].near_edited == 1.0 and got[4].near_next == 0.0
    got = {r.doc_id: r for r in token_counts.count_tokens(odd, RANKS).where("doc_id IS NOT NULL").collect()}
    assert got[2].n_tokens == got[2].n_sections == got[3].n_tokens == 0 and got[5].n_sections == 2 and got[7].n_sections == 1 and got[8].n_tokens > 0
    other = {r.doc_id: r for r in bpe.encode_decode(odd, MODEL).where("doc_id IS NOT NULL").collect()}
    assert {i: r.n_tokens for i, r in other.items()} == {i: r.n_tokens for i, r in got.items()}
    got = {r.doc_id: r for r in secrets.scan(odd, WORDS).where("doc_id IS NOT NULL").collect()}
    assert got[4].n_assign == got[6].n_assign == 4000 and got[2].spans == got[3].spans == got[7].spans == got[8].spans == ""
    got = {r.doc_id: r for r in quality.resample(odd, odd.selectExpr("doc_id", "1 AS quality", "0 AS toxic").limit(0)).where("doc_id IS NOT NULL").collect()}
    assert all(r.keep and r.score == r.evidence == 0 for r in got.values())  # no labels
    got = {r.doc_id: r for r in licenses.scan(odd).where("doc_id IS NOT NULL").collect()}
    assert got[4].n_base == 4000 and got[4].base_labels == "mit"


def test_stages_keep_columns(odd, items, labels):
    for stage in (lambda d: quality.accepted(d, labels), simhash.deduplicate, lambda d: decontaminate.remove(d, items), lambda d: secrets.redact(d, WORDS)):
        assert stage(odd).columns == odd.columns
        assert stage(odd.limit(0)).count() == 0
    kept = simhash.deduplicate(odd).collect()
    # one of the repeated rows, one of the long copies, one of those without words, and the one without an id
    assert sorted(str(r[0]) for r in kept) == ["1", "2", "4", "8", "None"]
    clean = {r[0]: r for r in decontaminate.remove(odd, items, coverage=0.9).collect() if r[0]}
    assert clean[1][1] == "some  here and there" and clean[1][4] == len(clean[1][1]) and clean[2][1] is None
    red = {r[0]: r for r in secrets.redact(odd, WORDS).collect() if r[0]}
    assert "abcdef0123456789abcd" not in red[4][1] and red[4][4] == len(red[4][1])


def test_pages(spark):
    rows = [(1, "http://a.b/c", "<p>x</p>", 5), (1, "http://a.b/c", "<p>x</p>", 5), (None, None, None, None), (2, "not a url", "<p>" + "y " * 100_000, 1), (3, "http://a.b/c", "", 0)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string, HOST int")
    df = plain.selectExpr("*", "'<p>other' AS h1", "'http://x.y/z' AS u1", "'<p>third' AS h2").toDF("page_id", "url", "html", "HOST", "HTML", "URL", "html")
    got = html_text.extract(df).collect()
    assert len(got) == 5 and {r.page_id: r.n_chars for r in got} == {1: 1, None: 0, 2: 199_999, 3: 0}
    assert html_text.extract(df.limit(0)).count() == 0
