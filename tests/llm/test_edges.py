"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator on documents."""

import pytest

from claimspan.llm import decontaminate, jaccard_join, language_id, line_dedup, media, mixing, quality, substring_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _row long, held_out string, _k string, size long, part int, fp long, predicted string"
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "lorem ipsum dolor " * 40_000), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "a b c d e f g"), (None, "x y z"), (7, "ünï cödé 漢字 🙂 scum"), (8, "one\x00two\n\n\nthree"), (9, "A\r\nb")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if (i or 0) % 3 == 0 else "en", None if i in (None, 4) else f"s{(i or 0) % 2}", None, 0.1, 7, "h", "k", 1, 2, 3, "p") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (4, 0, 0), (5, 1, 0), (7, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def runs(labels):
    items = labels.sparkSession.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (None, "q r s t u v")], "item_id long, text string")
    return {
        "decontaminate": lambda d: decontaminate.leaks(d, items),
        "line_dedup": lambda d: line_dedup.line_dedup(d, min_docs=2),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "language_id": lambda d: language_id.language_id(d),
        "mixing": lambda d: mixing.mix_sources(d, block_words=8)[0],
        "jaccard": lambda d: jaccard_join.jaccard_components(d),
        "quality": lambda d: quality.quality(d, labels),
        "media": lambda d: media.audio_features(d),
        "substring": lambda d: substring_dedup.substring_dedup(d, window=4, anchor=2),
    }


NAMES = ["decontaminate", "line_dedup", "toxicity", "language_id", "mixing", "jaccard", "quality", "media", "substring"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, docs, labels):
    got = runs(labels)[name](docs).collect()
    if name == "decontaminate":
        assert {r["doc_id"] for r in got} == {5, 6} and all(r["item_id"] == 1 for r in got)
    else:
        assert len(got) == len(TEXTS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, empty, labels):
    assert runs(labels)[name](empty).collect() == []


def test_repeated_rows_agree(docs, labels):
    for name in ("toxicity", "language_id", "jaccard", "quality", "media", "substring"):
        rows = [tuple(map(str, r)) for r in runs(labels)[name](docs).where("doc_id = 5").collect()]
        assert len(rows) == 2 and rows[0] == rows[1], name


def test_undetermined_and_silent(docs, labels):
    lang = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert all(lang[i]["lang_pred"] == "und" and lang[i]["score"] == 0 for i in (1, 2, 3))
    sound = {r["doc_id"]: r for r in media.audio_features(docs).collect()}
    assert sound[1]["payload_bytes"] == 192 and sound[1]["n_bytes"] == 0 and sound[1]["payload_sha256"] == sound[2]["payload_sha256"]
    sets = {r["doc_id"]: r for r in jaccard_join.jaccard_components(docs).collect()}
    assert sets[1]["n_shingles"] == 0 and sets[1]["component_id"] == 1 and sets[6]["component_id"] == 5


def test_warc_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "h", "y"), (None, "u", "", "z"), (3000, "u", "ü" * 10_000, None), (-5, "v", "w", "q")], "page_id long, url string, html string, record string")
    primary = warc.store(warc.records(pages), "a")
    leaves, found = warc.fixity(primary, primary)
    assert leaves.count() == 5 and found.count() == 0
    none = warc.store(warc.records(pages.limit(0)), "n")
    assert warc.fixity(none, none)[1].count() == 0
    assert warc.fixity(primary, none)[1].where("status = 'missing'").count() == 5
    assert warc.fixity(none, primary)[1].where("status = 'extra'").count() == 5


