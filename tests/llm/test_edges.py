"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gleanspark.llm import bpe, hamming_join, language, line_rules, nra, packing, passages, quality_crf, sanitise
from gleanspark.llm import suffix_levels

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 900}x{i}" for i in range(12_000))
COPY = " ".join(f"passage{i}" for i in range(70))
ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \n\t ", "en", "a", 4),
    (4, LONG, "en", "a", len(LONG)),
    (5, "one", "de", "a", 3),
    (6, COPY, "en", None, 1),
    (7, COPY, "en", "a", 1),
    (7, COPY, "en", "a", 1),
    (None, "no id at all", "en", "a", 12),
    (None, None, None, None, None),
    (8, "write to me@mail.example or +1 (386) 555-3733 from 10.0.0.1", "en", "a", 9),
]
# Columns with names that operators use inside.
CLASHING = ["n_words", "key", "host", "node", "score", "start", "rank", "component", "doc", "line", "total", "spans"]


@pytest.fixture(scope="module")
def documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame(ROWS, schema)
    return rows.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.limit(0)


def by_id(frame, column):
    return {r["doc_id"]: r[column] for r in frame.collect() if r["doc_id"] is not None}


def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 0), (5, 1), (6, 1), (8, None), (None, 0), (3, 0)], "doc_id long, quality int")


def test_quality(spark, documents, nothing):
    field = quality_crf.fit(documents, labels(spark), F.lit(True))
    got = quality_crf.score(documents, field)
    assert got.count() == len(ROWS)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert quality_crf.score(nothing, field).count() == 0
    unlearned = quality_crf.fit(nothing, labels(spark), F.lit(True))
    assert {r.score for r in quality_crf.score(documents, unlearned).collect()} == {0.5}


def test_passages(documents, nothing):
    got = passages.spans(passages.repeated_passages(documents)).collect()
    assert [(r.doc, r.starts, r.ends, r.first_doc) for r in got] == [(7, [0], [70], 6)]
    found = passages.spans(passages.repeated_passages(nothing))
    assert found.count() == 0
    assert passages.without_passages(nothing, found).count() == 0
    left = passages.without_passages(documents, passages.spans(passages.repeated_passages(documents)))
    assert left.columns == documents.columns and left.count() == len(ROWS)
    assert by_id(left, "text")[7] == "" and by_id(left, "text")[6] == COPY and by_id(left, "text")[4] == LONG


def test_line_rules(documents, nothing):
    got = line_rules.judge(documents)
    assert got.count() == len(ROWS)
    assert by_id(got, "kept") == {1: False, 2: False, 3: False, 4: True, 5: False, 6: True, 7: True, 8: False}
    assert by_id(got, "n_words")[4] == 12_000
    assert line_rules.judge(nothing).count() == 0
    left = line_rules.clean(documents)
    assert left.columns == documents.columns
    assert sorted(r.doc_id for r in left.collect()) == [4, 6, 7, 7]
    assert line_rules.clean(nothing).count() == 0


def test_sanitise(documents, nothing):
    got = sanitise.digests(documents)
    assert got.count() == len(ROWS)
    spans = by_id(got, "spans")
    assert spans[8] == "email:9:24,phone:28:45,ip:51:59" and spans[1] == "" and spans[4] == ""
    assert by_id(got, "base_sha256")[2] == hashlib.sha256(b"").hexdigest()
    clean = sanitise.sanitise(documents)
    assert clean.columns == documents.columns
    texts = by_id(clean, "text")
    assert texts[8] == "write to [EMAIL] or [PHONE] from [IP]" and texts[1] is None and texts[4] == LONG
    assert sanitise.digests(nothing).count() == 0 and sanitise.sanitise(nothing).count() == 0


def test_byte_bpe(documents, nothing):
    got = bpe.digests(documents, RANKS, public_tokenizers.PATTERN)
    assert got.count() == len(ROWS)
    assert by_id(got, "n_tokens")[1] == 0 and by_id(got, "n_tokens")[2] == 0
    assert by_id(got, "decoded_sha256")[4] == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(documents, RANKS, public_tokenizers.PATTERN), RANKS)
    assert {k: bytes(v).decode() for k, v in by_id(back, "data").items()} == {r[0]: r[1] or "" for r in ROWS if r[0]}


def test_suffix_levels(documents, nothing):
    got = suffix_levels.dedup(documents, with_bytes=True)
    assert got.count() == len(ROWS)
    # Rows that share an id are one document, so the second row of 7 is no repeat of the first; both repeat 6.
    assert by_id(got, "n_removed") == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: len(COPY), 8: 0}
    assert bytes(by_id(got, "kept")[4]).decode() == LONG
    assert suffix_levels.dedup(nothing).count() == 0


def test_packing(documents, nothing):
    got = packing.pack(documents, WORDS, with_ids=True).collect()
    assert len({(r.doc_id, r.piece) for r in got}) == len({(r[0], 0) for r in ROWS}) + sum(r.piece > 0 for r in got)
    assert {r.length for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack(nothing, WORDS).count() == 0


def test_near_duplicates(documents, nothing):
    got = hamming_join.near_duplicates(documents)
    assert got.count() == len(ROWS)
    assert by_id(got, "component_id") == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    assert by_id(got, "kept")[7] is False and by_id(got, "kept")[6] is True
    assert {(r.component_id, r.kept) for r in got.collect() if r.doc_id is None} == {(None, True)}
    assert hamming_join.near_duplicates(nothing).count() == 0


def test_search(spark):
    rows = [
        (0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 2.0]), (3, [-1.0, 2.0]), (4, None),
        (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]),
        (50, []), (100, [1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = nra.search(nra.usable(table), F.col("vec_id") % 50 == 0, 2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [
        (0, 1, 1, 32768), (0, 2, 2, 32768), (50, 1, 9, 0), (100, 1, 8, 65536),
    ]
    assert nra.search(nra.usable(table.limit(0)), F.lit(True)).count() == 0


def test_search_of_large_components(spark):
    table = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1e14, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = nra.search(nra.usable(table), F.col("vec_id") == 0, 3).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 65536 * 10**14), (2, 2, 131072), (3, 2, 131072)]


def test_language(documents, nothing):
    network = language.fit(documents, F.lit(True))
    got = language.predict(documents, network)
    found = by_id(got, "lang_pred")
    assert got.count() == len(ROWS)
    assert {found[k] for k in (1, 2, 3)} == {"und"} and found[4] == "en"
    assert language.predict(nothing, network).count() == 0
    unlearned = language.fit(nothing, F.lit(True))
    assert {r.lang_pred for r in language.predict(documents, unlearned).collect()} == {"und"}


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, documents, nothing, empty):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, nothing if empty else documents, "")
        if name != "packing":
            assert got.columns == documents.columns
        assert (got.count() == 0) == empty
