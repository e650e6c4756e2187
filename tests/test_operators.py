"""Operators against plain Python on small data, on their rare paths too."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark import runtime
from gleanspark.operators import bm25, bm25_scan, corpus, dense, fusion, joins, neardup, ordering, readers, rerank, selection, skew, stats, support, tiers
from gleanspark.operators.bm25 import Bm25Parameters, build_index, load_index, merge_indexes, save_index, search
from test_functions import python_shingles

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma".split()


def random_texts(n, seed, low=3, high=30):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) for _ in range(n)]


# --- order ---------------------------------------------------------------------------------


def test_running_total_over_many_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**12), i, rng.randrange(5)) for i in range(500)]
    frame = spark.createDataFrame(rows, "k long, i long, w long").repartition(7)
    got = {r.i: r.at for r in ordering.running_total(frame, "k", F.col("w"), "at", ["i"], rows_per_bucket=40).collect()}
    total, want = 0, {}
    for k, i, w in sorted(rows):
        want[i], total = total, total + w
    assert got == want


def test_running_total_with_a_hot_key(spark):
    rows = [(5 if i % 3 else i, i) for i in range(300)]
    frame = spark.createDataFrame(rows, "k long, i long")
    got = {r.i: r.at for r in ordering.running_total(frame, "k", None, "at", ["i"], rows_per_bucket=20).collect()}
    assert got == {i: at for at, (_, i) in enumerate(sorted(rows))}


def quantiles(frame, probs):
    found = {r["prob"]: r["quantile"] for r in ordering.exact_quantiles(frame, "v", probs).collect()}
    return [found[p] for p in probs]


def test_exact_quantiles_on_both_paths(spark, monkeypatch):
    values = [random.Random(3).gauss(0, 10) for _ in range(400)] + [1.5] * 200
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    want = np.quantile(values, [0.1, 0.5, 0.9, 1.0])
    assert np.allclose(quantiles(frame, [0.1, 0.5, 0.9, 1.0]), want)
    monkeypatch.setattr(ordering, "PERCENTILE_VALUES", 10)
    assert np.allclose(quantiles(frame, [0.1, 0.5, 0.9, 1.0]), want)
    assert quantiles(frame.where("v is null"), [0.5]) == [None]


def test_top_k_with_salts_equals_the_plain_one(spark, monkeypatch):
    frame = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("s"), "id")
    order = [F.col("s").desc(), F.col("id")]
    plain = sorted(map(tuple, selection.top_k(frame, ["g"], order, 20).collect()))
    monkeypatch.setattr(selection, "GROUP_LIMIT", 5)
    assert sorted(map(tuple, selection.top_k(frame, ["g"], order, 20).collect())) == plain


def test_keep_first_treats_nulls_as_equal(spark):
    frame = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "i long, k string")
    assert sorted(r.i for r in selection.keep_first(frame, ["k"], ["i"]).collect()) == [1, 3]


def test_sampling_does_not_depend_on_partitioning(spark):
    frame = spark.range(1000).withColumnRenamed("id", "k")
    first = {r.k for r in selection.sample_exact(frame, "k", 50).collect()}
    assert len(first) == 50
    assert first == {r.k for r in selection.sample_exact(frame.repartition(13), "k", 50).collect()}
    assert selection.sample_exact(frame, "k", 5000).count() == 1000
    shares = selection.sample_share(frame, "k", 0.14).count()
    assert 90 < shares < 190


def test_exact_sample_with_nulls_and_repeats(spark):
    rows = [(None, 1), ("a", 2), ("a", 3), ("a", 3), ("b", 4), ("c", 5), (None, 6)]
    frame = spark.createDataFrame(rows, "k string, v int")
    for n in range(9):
        got = sorted(map(repr, selection.sample_exact(frame, "k", n).collect()))
        assert len(got) == min(n, len(rows))
        again = selection.sample_exact(frame.repartition(5), "k", n).collect()
        assert got == sorted(map(repr, again))


def test_split_parts_are_disjoint_and_nested_draws_agree(spark):
    frame = spark.range(300).select(F.col("id").cast("string").alias("k"))
    small = selection.split_by_draw(frame, "k", {"monitor": 50, "train": 20})
    large = selection.split_by_draw(frame, "k", {"monitor": 50, "train": 100})
    assert Counter(r.part for r in large.collect()) == {"monitor": 50, "train": 100}
    monitor = {r.k for r in small.where("part = 'monitor'").collect()}
    assert monitor == {r.k for r in large.where("part = 'monitor'").collect()}


# --- corpus --------------------------------------------------------------------------------


def test_chunk_ids_follow_input_order_and_titles_first_seen(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 2)
    rows = [(10, "b", "s1", "one two three four five"), (11, "a", "s2", "x"), (12, "b", "s3", ""), (13, "c", "s4", "p q r")]
    frame = spark.createDataFrame(rows, "para_no long, title string, section string, text string")
    got = [tuple(r) for r in corpus.chunk_paragraphs(frame, max_words=2).orderBy("chunk_id").collect()]
    assert got == [
        (0, 0, "b", "s1", "b: one two"),
        (1, 0, "b", "s1", "b: three four"),
        (2, 0, "b", "s1", "b: five"),
        (3, 1, "a", "s2", "a: x"),
        (4, 0, "b", "s3", "b: "),
        (5, 2, "c", "s4", "c: p q"),
        (6, 2, "c", "s4", "c: r"),
    ]


def test_slice_drops_late_repeats_of_kept_titles(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate("aabcab")], "para_no long, title string")
    assert sorted(r.para_no for r in corpus.slice_by_article_count(frame, 2).collect()) == [0, 1, 2]
    assert corpus.slice_by_article_count(frame, 9).count() == 6


# --- near duplicates -----------------------------------------------------------------------


def brute_near(candidates, references, threshold=0.8):
    found = set()
    for i, text in candidates:
        a = python_shingles(text)
        for _, other in references:
            b = python_shingles(other)
            if len(a & b) / len(a | b) >= threshold:
                found.add(i)
                break
    return found


def near_fixture(seed):
    rng = random.Random(seed)
    base = random_texts(25, seed, 4, 40) + ["", "abc", "abcd efg"]
    refs = list(enumerate(base[:15] + ["", "Boiler plate text number one repeated over and over again"]))
    candidates = []
    for i, text in enumerate(base + base[:10]):
        words = text.split()
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
        candidates.append((i, "  ".join(words).upper()))
    family = "Boiler plate text number one repeated over and over again"
    candidates += [(100 + i, family + " " * (i % 3) + "!" * (i % 4)) for i in range(40)]
    return candidates, refs


@pytest.mark.parametrize("first", [1, 8])
@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_near_duplicates_equal_the_nested_loop(spark, monkeypatch, first, threshold):
    monkeypatch.setattr(neardup, "FIRST_ROUND", first)
    candidates, refs = near_fixture(7)
    cand = spark.createDataFrame(candidates, "i long, prompt string").repartition(5)
    ref = spark.createDataFrame(refs, "i long, prompt string")
    keys = neardup.near_duplicate_keys(cand, ref, "prompt", threshold, 5)
    from gleanspark.functions.text import collapse

    keyed = cand.withColumn("tid", neardup.text_id(collapse("prompt"))).join(keys, "tid", "left_semi")
    assert {r.i for r in keyed.collect()} == brute_near(candidates, refs, threshold)


def test_alike_but_not_close_texts_are_hardly_compared(spark):
    """One template with other letters at its end: under 80 percent, so filters leave few pairs of a quadratic number."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template = letters(150)
    texts = [(k, template + letters(26)) for k in range(1500)]
    close = [(1500 + k, texts[k][1][:-2] + "zz") for k in range(5)]
    frame = spark.createDataFrame(texts, "i long, prompt string")
    asked = spark.createDataFrame(close + [(9000 + k, template + letters(26)) for k in range(1500)], "i long, prompt string")
    cand, refs = neardup._folded(asked, "prompt", 5), neardup._folded(frame, "prompt", 5)
    pairs = neardup.possible_pairs(*neardup._prefixes(cand.cache(), refs.cache(), 0.8), 0.8)
    assert 5 <= pairs.count() < 20 * 1500
    marked = {r.i for r in neardup.mark_near_duplicates(asked, frame).collect() if r.near_duplicate}
    assert marked == {1500 + k for k in range(5)}


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Several blocks of a size, short slices, little room for products; short, odd and long texts among them."""
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 8)
    monkeypatch.setattr(neardup, "CELLS", 5_000)
    monkeypatch.setattr(neardup, "CHARS", 300)
    candidates, refs = near_fixture(11)
    long = random_texts(6, 5, 400, 900)
    odd = ["a", "ab\0c", "ab", "\U0001f600 \U0001f601 smile smile", "İstanbul ΣΑΣ STRASSE ß"]
    candidates += [(500 + k, t) for k, t in enumerate(long + odd)]
    refs += [(900 + k, t) for k, t in enumerate([t[: 9 * len(t) // 10] for t in long[:4]] + [t.upper() for t in odd])]
    cand = spark.createDataFrame(candidates, "i long, prompt string").repartition(5)
    found = neardup.mark_near_duplicates(cand, spark.createDataFrame(refs, "i long, prompt string"), threshold=0.6)
    assert {r.i for r in found.collect() if r.near_duplicate} == brute_near(candidates, refs, 0.6)


def folder_bytes(paths):
    return sum(f.stat().st_size for p in paths for f in Path(p.removeprefix("file:")).rglob("*.parquet"))


def test_the_near_duplicate_search_writes_signatures_instead_of_texts(spark):
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    texts = [(k, letters(rng.randrange(20_000, 25_000))) for k in range(80)]
    texts += [(80, texts[0][1][:-300])]
    cand = spark.createDataFrame(texts[40:], "i long, prompt string")
    refs = spark.createDataFrame(texts[:40], "i long, prompt string")
    before = len(runtime._made)
    assert [r.i for r in neardup.drop_near_duplicates(cand, refs).collect()] == list(range(40, 80))
    assert folder_bytes(runtime._made[before:]) < sum(len(t) for _, t in texts) / 3
    cand, refs = neardup._folded(cand, "prompt", 5), neardup._folded(refs, "prompt", 5)
    assert "flat" not in neardup._prefixes(cand, refs, 0.8)[0].columns + cand.columns


def test_near_duplicate_flags_do_not_multiply_rows(spark):
    candidates, refs = near_fixture(3)
    cand = spark.createDataFrame(candidates, "i long, prompt string")
    ref = spark.createDataFrame(refs + refs, "i long, prompt string")
    rows = neardup.mark_near_duplicates(cand, ref).collect()
    assert len(rows) == len(candidates)
    assert {r.i for r in rows if r.near_duplicate} == brute_near(candidates, refs)


def test_a_long_prefix_is_cut_by_ranges(spark, monkeypatch):
    frame = spark.range(40_000).select(F.col("id"), (F.col("id") * 7919 % 40_009 % 500).alias("k"), F.lit("x").alias("other")).repartition(6)
    want = {r.id for r in selection.first_rows(frame, ["k", "id"], 25_000).collect()}
    monkeypatch.setattr(selection, "ONE_TASK", 100)
    got = selection.first_rows(frame, ["k", "id"], 25_000)
    assert got.columns == frame.columns
    rows = [r.id for r in got.collect()]
    assert len(rows) == 25_000 and set(rows) == want
    assert selection.first_rows(frame, ["k", "id"], 90_000).count() == 40_000
    texts = frame.select("id", F.repeat(F.lit("a"), F.col("k").cast("int")).alias("text"))
    assert {r.id for r in selection.longest(texts, "text", "id", 101).collect()} == {r.id for r in texts.orderBy(F.length("text").desc(), "id").limit(101).collect()}


def test_spread_hot_keys_keeps_the_join_whole(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("l"))
    right = spark.range(40).select((F.col("id") % 8).alias("k"), F.col("id").alias("r"))
    a, b = skew.spread_hot_keys(left, right, ["k"], 100)
    assert a.select("k", "salt").distinct().where("k = 0").count() > 1
    got = a.join(b, ["k", "salt"]).select("k", "l", "r")
    want = left.join(right, "k")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_spread_hot_keys_cuts_both_sides(spark):
    left = spark.range(900).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("l"))
    right = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 11).alias("k"), F.col("id").alias("r"))
    a, b = skew.spread_hot_keys(left, right, ["k"], 100)
    for side in (a, b):
        assert max(r["count"] for r in side.groupBy("k", "salt").count().collect()) < 200
    got = a.join(b, ["k", "salt"]).select("k", "l", "r")
    want = left.join(right, "k")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


# --- BM25 ----------------------------------------------------------------------------------


def brute_bm25(chunks, query, k, p=Bm25Parameters()):
    import re

    def tok(t):
        return [w for w in re.findall(r"\w{2,}", t.lower()) if w not in p.stopwords]

    docs = {i: tok(t) for i, t in chunks}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    asked = Counter(tok(query))
    if not p.query_tf:
        asked = dict.fromkeys(asked, 1)
    scores = defaultdict(float)
    for i, d in docs.items():
        tf = Counter(d)
        for w, q in asked.items():
            if tf[w]:
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                scores[i] += q * idf * tf[w] / (tf[w] + p.k1 * (1 - p.b + p.b * len(d) / avg))
    return [(i, round(s, 6)) for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]


@pytest.fixture(scope="module")
def bm25_data(spark):
    chunks = list(enumerate(random_texts(60, 11) + ["the and of", ""]))
    queries = list(enumerate(random_texts(8, 12, 2, 6) + ["nothing known"]))
    return chunks, queries, spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(queries, "qid long, query string")


def check_search(found, chunks, queries, k, p=Bm25Parameters()):
    rows = defaultdict(list)
    for r in found.orderBy("qid", "rank").collect():
        rows[r.qid].append((r.chunk_id, round(r.score, 6)))
    for qid, query in queries:
        assert rows[qid] == brute_bm25(chunks, query, k, p), query


def test_search_equals_a_plain_loop(spark, bm25_data):
    chunks, queries, frame, asked = bm25_data
    check_search(search(build_index(frame), asked, 5), chunks, queries, 5)
    once = Bm25Parameters(k1=1.2, b=0.5, query_tf=False)
    check_search(search(build_index(frame, once), asked, 4), chunks, queries, 4, once)


def test_search_with_too_many_query_terms_to_broadcast(spark, bm25_data, monkeypatch):
    
    chunks, queries, frame, asked = bm25_data
    monkeypatch.setattr(bm25, "fits", lambda df: False)
    monkeypatch.setattr(skew, "ROWS_PER_SPLIT", 10)
    check_search(search(build_index(frame), asked, 5), chunks, queries, 5)


def test_saved_index_gives_the_same_and_reads_its_folders_only(spark, bm25_data, tmp_path):
    chunks, queries, frame, asked = bm25_data
    save_index(build_index(frame), str(tmp_path / "index"), 16)
    index = load_index(spark, str(tmp_path / "index"))
    check_search(search(index, asked, 5), chunks, queries, 5)
    plan_of = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    weighed, _ = bm25._weighed(index, asked.limit(1), ["qid"], "query")
    picked = weighed.select("qid").distinct().withColumn("block", F.lit(0).cast("long"))
    pruned = re.compile(r"PartitionFilters: \[[^\]]*folder")
    assert pruned.search(plan_of(bm25._score_blocks(index, picked, weighed, ["qid"])))
    assert pruned.search(plan_of(bm25._in_folders(index.bounds, index.folders, "term", weighed)))
    plan = plan_of(search(index, asked, 5))
    assert "hashpartitioning(qid" in plan and "WindowGroupLimit" in plan


def test_a_saved_index_is_scanned_for_frequent_terms(spark, bm25_data, monkeypatch, tmp_path):
    """Tokens saved where they lie or by folder, bounds joined from small lists; nothing is written by block and query."""
    chunks, queries, frame, asked = bm25_data
    built = build_index(frame.repartition(5))
    monkeypatch.setattr(bm25, "HELD_BOUNDS", 40)
    monkeypatch.setattr(bm25, "PART_BLOCKS", 1)
    monkeypatch.setattr(bm25, "BLOCK_CHUNKS", 3)
    monkeypatch.setattr(bm25, "BLOCK_MATCHES", 0)
    for files, name in ((10**6, "a"), (0, "b")):
        monkeypatch.setattr(bm25, "FILES", files)
        save_index(built, str(tmp_path / name), 4)
        index = load_index(spark, str(tmp_path / name))
        rows = lambda df, *columns: sorted(tuple(r) for r in df.select(*columns).collect())
        assert rows(index.postings, "chunk_id", "term", "tf", "dl") == rows(built.postings, "chunk_id", "term", "tf", "dl")
        columns = ["block", "term", "tf", "dl"]
        want = bm25.block_bounds(built.postings.withColumn("block", bm25.block_of("chunk_id")))
        assert rows(index.bounds, *columns) == rows(want, *columns)
        before = len(runtime._made)
        check_search(search(index, asked, 5), chunks, queries, 5)
        assert len(runtime._made) == before
    save_index(merge_indexes(index), str(tmp_path / "again"), 2)
    check_search(search(load_index(spark, str(tmp_path / "again")), asked, 5), chunks, queries, 5)
    save_index(build_index(frame.limit(0)), str(tmp_path / "none"), 2)
    assert search(load_index(spark, str(tmp_path / "none")), asked, 5).count() == 0


def test_a_term_in_most_chunks_does_not_shuffle_by_term(spark, bm25_data):
    _, _, frame, asked = bm25_data
    plan = search(build_index(frame), asked, 5)._jdf.queryExecution().executedPlan().toString()
    scoring = plan.split("BroadcastExchange")[0]
    assert "hashpartitioning(term" not in scoring


def test_blocks_under_the_kth_score_are_not_scored(spark, monkeypatch):
    """A skewed corpus, one word of every query in all chunks: a fifth of the pairs are scored at most."""
    rng = random.Random(3)
    chunks = []
    for k in range(3000):
        topic = k // 60
        words = ["common"] * rng.randrange(1, 4) + [f"topic{topic}word{rng.randrange(12)}" for _ in range(20)]
        chunks.append((k, " ".join(words + [f"rare{rng.randrange(400)}" for _ in range(5)])))
    queries = [(q, f"common topic{3 * q}word1 topic{3 * q}word2 rare{q}") for q in range(12)] + [(12, "common")]
    index = build_index(spark.createDataFrame(chunks, "chunk_id long, text string"))
    asked = spark.createDataFrame(queries[:12], "qid long, query string")
    every, scored = bm25.score_chunks(index, asked).count(), bm25.candidates(index, asked, 5).count()
    assert every > 12 * 2900 and scored <= every / 5
    check_search(search(index, spark.createDataFrame(queries, "qid long, query string"), 5), chunks, queries, 5)


def test_equal_scores_across_blocks(spark):
    chunks = [(k, "same text here" if k % 50 == 7 else "other words again") for k in range(1000, 2000)]
    queries = [(0, "same text"), (1, "same"), (2, "again words")]
    frame = spark.createDataFrame(chunks, "chunk_id long, text string")
    check_search(search(build_index(frame), spark.createDataFrame(queries, "qid long, query string"), 9), chunks, queries, 9)


def test_few_query_terms_are_scanned_in_place(spark, bm25_data, monkeypatch):
    """Pieces of few chunks, ties included; besides the token rows nothing is written."""
    chunks, queries, frame, asked = bm25_data
    chunks = chunks + [(100 + i, text) for i, text in chunks[:20]]
    frame = spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3)
    monkeypatch.setattr(bm25_scan, "CELLS", 50)
    monkeypatch.setattr(bm25_scan, "GAINS", 40)
    before = len(runtime._made)
    found = search(build_index(frame), asked, 3)
    check_search(found, chunks, queries, 3)
    assert [re.search("gleanspark-(.*)-", path)[1] for path in runtime._made[before:]] == ["chunk-tokens"]
    check_search(search(build_index(frame), asked, 500), chunks, queries, 500)
    check_search(search(build_index(frame.limit(0)), asked, 3), [], [], 3)
    two = asked.withColumn("part", F.when(F.col("qid") > 2, "x"))
    assert search(build_index(frame), two, 3, ["part", "qid"]).drop("part").exceptAll(found).isEmpty()


def test_more_query_terms_than_a_scan_takes(spark, bm25_data, monkeypatch):
    chunks, queries, frame, asked = bm25_data
    monkeypatch.setattr(bm25_scan, "MOST_TERMS", 2)
    check_search(search(build_index(frame), asked, 5), chunks, queries, 5)
    monkeypatch.setattr(bm25, "fits", lambda df: False)
    monkeypatch.setattr(skew, "ROWS_PER_SPLIT", 10)
    check_search(search(build_index(frame), asked, 5), chunks, queries, 5)


def test_merged_indexes_equal_one_of_all_chunks(spark, bm25_data, tmp_path):
    chunks, queries, frame, asked = bm25_data
    halves = [build_index(frame.where(F.col("chunk_id") % 2 == k)) for k in (0, 1)]
    save_index(halves[0], str(tmp_path / "half"), 4)
    both = merge_indexes(load_index(spark, str(tmp_path / "half")), halves[1])
    check_search(search(both, asked, 5), chunks, queries, 5)
    whole = build_index(frame)
    assert whole.totals.collect() == both.totals.collect()
    assert whole.terms.exceptAll(both.terms.select("term", "df")).isEmpty()


# --- fusion and reranking ------------------------------------------------------------------


def ranked(spark, lists):
    rows = [(0, n, r, d) for n, docs in enumerate(lists) for r, d in enumerate(docs, 1)]
    return spark.createDataFrame(rows, "qid long, list_no int, rank int, chunk_id long")


def test_rank_fusion_rules(spark):
    def fused(lists, k=60, top=None):
        return [(r.chunk_id, r.fused) for r in fusion.fuse_ranks(ranked(spark, lists), ["qid"], "chunk_id", k, top).orderBy("rank").collect()]

    assert [d for d, _ in fused([[1, 2, 3]])] == [1, 2, 3]
    agreed = fused([[1, 2], [2, 3]])
    assert agreed[0][0] == 2 and abs(agreed[0][1] - (1 / 62 + 1 / 61)) < 1e-12
    assert [d for d, _ in fused([[7, 8], [8, 7]])] == [7, 8]
    assert [d for d, _ in fused([[5], [4]])] == [5, 4]
    assert fused([[1, 2], [2, 3]], 1)[0][1] > agreed[0][1]
    assert len(fused([[1, 2], [3, 4]], 60, 3)) == 3


def test_score_pool_prefers_the_first_list_on_ties(spark):
    rows = [(0, 0, 1, 10, 2.0), (0, 0, 2, 11, 1.0), (0, 1, 1, 20, 2.0), (0, 1, 2, 21, 1.5)]
    frame = spark.createDataFrame(rows, "qid long, list_no int, rank int, chunk_id long, score double")
    assert [r.chunk_id for r in fusion.fuse_scores(frame, ["qid"], 3).orderBy("rank").collect()] == [10, 20, 21]


def test_phrase_rerank_counts_shared_phrases(spark):
    queries = spark.createDataFrame([(5, "copper kettle lid")], "qid long, query string")
    texts = ["nothing here", "a kettle lid and copper", "one copper kettle lid", "copper kettle", "lid copper"]
    rows = [(5, n, 10 * n, 20.0 - n, text) for n, text in enumerate(texts, 1)]
    frame = spark.createDataFrame(rows, "qid long, rank int, chunk_id long, score double, text string")
    got = rerank.rerank_by_phrases(frame, queries, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.phrase_count) for r in got] == [(30, 3), (20, 1), (40, 1), (10, 0), (50, 0)]


def test_sentence_rerank_keeps_single_sentences(spark):
    rows = [(0, "moon rocks", "The sun is hot. Some moon rocks are old. Water is wet."), (1, "moon", "only one  sentence"), (2, "x", "")]
    frame = spark.createDataFrame(rows, "qid long, query string, context string")
    got = {r.qid: (r.context_reranked, r.n_sentences) for r in rerank.rerank_sentences(frame, F.col("query")).collect()}
    assert got[0] == ("Some moon rocks are old. The sun is hot. Water is wet.", 3)
    assert got[1] == ("only one  sentence", 1)
    assert got[2] == ("", 0)


# --- dense ---------------------------------------------------------------------------------


def test_blocks_of_short_vectors_are_skipped(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 8))
    vectors *= (np.linspace(0.01, 3, 900) / np.linalg.norm(vectors, axis=1))[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    asked = frame.select(F.col("vec_id").alias("qid"), "embedding").where("qid % 30 = 0")
    placed, blocks = dense._placed(frame.select(F.col("vec_id").alias("item"), "embedding"), 100)
    assert 9 <= blocks.count() <= 12 and max(r.n for r in blocks.collect()) < 200
    got = defaultdict(list)
    for r in dense.nearest(asked, frame, 5, block=10, item_block=100).orderBy("qid", "rank").collect():
        got[r.qid].append(r.vec_id)
    sims = np.round(vectors @ vectors.T, 9)
    assert got == {q: sorted(range(900), key=lambda i: (-sims[q, i], i))[:5] for q in range(0, 900, 30)}
    queries = asked.select(F.col("qid").alias("query"), "embedding")
    first = spark.createDataFrame(
        [(q, float(s)) for q in range(0, 900, 30) for s in sorted(sims[q, 800:])[-5:]], "query long, score double"
    )
    opened = dense.open_blocks(queries, first, blocks, 5).count()
    assert opened < 0.6 * 30 * (blocks.count() - 1)


@pytest.mark.parametrize("block", [1000, 7])
def test_nearest_equals_numpy(spark, block):
    """Small vectors of few lengths, many equal scores."""
    rng = np.random.default_rng(0)
    vectors = rng.integers(-2, 3, size=(60, 4)).astype(float)
    frame = spark.createDataFrame([(i, int(i % 5), v.tolist()) for i, v in enumerate(vectors)], "vec_id long, document_id int, embedding array<double>").repartition(5)
    asked = frame.select(F.col("vec_id").alias("qid"), "embedding").where("qid < 20")
    got = defaultdict(list)
    for r in dense.nearest(asked, frame, 6, block=block, item_block=2 * block).orderBy("qid", "rank").collect():
        got[r.qid].append(r.vec_id)
    sims = vectors @ vectors.T
    for q in range(20):
        assert got[q] == sorted(range(60), key=lambda i: (-sims[q, i], i))[:6]

    allowed = spark.createDataFrame([(q, d) for q in range(19) for d in (q % 5, (q + 1) % 5)], "qid long, document_id int")
    stored = frame.withColumnRenamed("vec_id", "sentence_id")
    inside = defaultdict(list)
    for r in dense.nearest_within(asked, allowed, stored, 4).orderBy("qid", "rank").collect():
        inside[r.qid].append(r.sentence_id)
    for q in range(19):
        open_ = [i for i in range(60) if i % 5 in (q % 5, (q + 1) % 5)]
        assert inside[q] == sorted(open_, key=lambda i: (-sims[q, i], i))[:4]
    assert 19 not in inside


@pytest.mark.parametrize("cells, item_block", [(2_000_000, 20_000), (9, 20_000), (9, 6)])
def test_search_within_documents_by_blocks(spark, monkeypatch, cells, item_block):
    """A large document in pieces, small ones together; rows without a vector come last; few products at a time."""
    monkeypatch.setattr(dense, "CELLS", cells)
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, size=(50, 4)).astype(float)
    part = [0 if i < 25 else 1 + i % 9 for i in range(50)]
    rows = [(i, part[i], None if i in (3, 40) else v.tolist()) for i, v in enumerate(vectors)]
    stored = spark.createDataFrame(rows, "sentence_id long, document_id int, embedding array<double>").repartition(4)
    asked = stored.select(F.col("sentence_id").alias("qid"), "embedding").where("qid < 10")
    allowed = spark.createDataFrame([(q, d) for q in range(10) for d in (0, 1 + q % 9, 77)], "qid long, document_id int")
    got = defaultdict(list)
    found = dense.nearest_within(asked, allowed, stored, 30, query_block=4, item_block=item_block)
    for r in found.orderBy("qid", "rank").collect():
        got[r.qid].append((r.sentence_id, r.score))
    for q in range(10):
        score = lambda i: None if q == 3 or i in (3, 40) else float(vectors[q] @ vectors[i])  # noqa: E731, B023
        open_ = [(i, score(i)) for i in range(50) if part[i] in (0, 1 + q % 9)]
        assert got[q] == sorted(open_, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:30]
    near = dense.nearest(asked.where("qid <> 3"), stored.where("embedding is not null").withColumnRenamed("sentence_id", "vec_id"), 4, block=5)
    assert near.count() == 36


# --- statistics ----------------------------------------------------------------------------


def score_frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "qid long, score double")


def test_bootstrap_interval_matches_direct_resampling(spark):
    rng = np.random.default_rng(5)
    values = rng.choice([0, 1 / 3, 0.5, 1], size=800)
    row = stats.bootstrap_ci(score_frame(spark, values), resamples=4000).first()
    direct = np.quantile(values[rng.integers(0, 800, size=(4000, 800))].mean(axis=1), [0.025, 0.975])
    assert abs(row["mean"] - values.mean()) < 1e-9 and row["n"] == 800
    assert abs(row["ci_lower"] - direct[0]) < 0.005 and abs(row["ci_upper"] - direct[1]) < 0.005


def test_bootstrap_is_the_same_on_any_partitioning(spark):
    frame = score_frame(spark, np.random.default_rng(1).choice([0, 0.5, 1], size=200))
    a = stats.bootstrap_ci(frame, resamples=1000).first()
    assert a == stats.bootstrap_ci(frame.repartition(9), resamples=1000).first()


def test_bootstrap_with_many_distinct_values(spark):
    values = [((i * 37) % 1009) / 100 for i in range(1009)]
    frame = score_frame(spark, values)
    row = stats.bootstrap_ci(frame, resamples=2000).first()
    again = stats.bootstrap_ci(frame.repartition(7), resamples=2000).first()
    assert (row.ci_lower, row.ci_upper) == (again.ci_lower, again.ci_upper)
    rng = np.random.default_rng(1)
    means = rng.choice(values, (4000, len(values))).mean(axis=1)
    assert row.ci_lower == pytest.approx(np.quantile(means, 0.025), abs=0.02)
    assert row.ci_upper == pytest.approx(np.quantile(means, 0.975), abs=0.02)
    hashed = stats.hashed_bootstrap_ci(frame, resamples=1000).first()
    assert hashed.ci_lower == pytest.approx(row.ci_lower, abs=0.05)


def test_binomial_quantile_is_that_of_the_distribution():
    u = np.random.default_rng(2).uniform(size=300)
    for n, share in ((1, 0.3), (40, 0.02), (40, 0.97), (60, 0.5), (900, 0.01), (5000, 0.4), (5000, 0.9)):
        got = stats.binomial_quantile(np.full(300, n), share, u)
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log(1 - share) for k in range(n + 1)]
        below = np.cumsum(np.exp(logs))
        want = np.searchsorted(below, u)
        slack = 1 if n * min(share, 1 - share) > stats.EXACT_MEAN else 0
        assert np.abs(got - want).max() <= slack and (got != want).mean() < 0.05
    assert stats.binomial_quantile(np.array([7]), 1.0, np.array([0.4])).tolist() == [7]


def test_random_ranking_interval_contains_the_baseline(spark):
    rng = random.Random(42)
    scores = []
    for _ in range(4000):
        order = rng.sample("ABCDE", 3)
        truth = rng.choice("ABCDE")
        scores.append(1 / (order.index(truth) + 1) if truth in order else 0.0)
    row = stats.bootstrap_ci(score_frame(spark, scores), resamples=1000).first()
    assert row["ci_lower"] < 11 / 30 < row["ci_upper"]


def test_empty_scores_are_an_error(spark):
    with pytest.raises(ValueError):
        stats.bootstrap_ci(score_frame(spark, [1.0]).where("qid > 5"))


def test_paired_difference_is_variant_minus_baseline(spark):
    rng = np.random.default_rng(3)
    a = rng.choice([0, 0.5], size=300)
    base, better = score_frame(spark, a), score_frame(spark, a + 0.3)
    row = stats.paired_bootstrap(base, better, resamples=500).first()
    assert abs(row["mean"] - 0.3) < 1e-9 and row["ci_lower"] > 0
    same = stats.paired_bootstrap(base, base, resamples=500).first()
    assert same["mean"] == same["ci_lower"] == same["ci_upper"] == 0.0
    report = stats.compare(base, better, resamples=300).first()
    assert report["resolved"] and report["rows_changed"] == 1.0 and abs(report["delta_mean"] - 0.3) < 1e-9


def test_unpaired_keys_are_an_error(spark):
    with pytest.raises(ValueError):
        stats.paired(score_frame(spark, [1, 0]), score_frame(spark, [1, 0, 1]))
    with pytest.raises(ValueError):
        stats.paired(score_frame(spark, [1, 0]), score_frame(spark, [1, 0]).union(score_frame(spark, [1, 0])))


def test_detectable_effect(spark):
    def mde(n):
        rng = np.random.default_rng(0)
        pairs = stats.paired(score_frame(spark, rng.integers(0, 2, n)), score_frame(spark, rng.integers(0, 2, n)))
        return pairs.agg(stats.detectable_effect("difference").alias("m")).first()["m"]

    assert mde(2000) < mde(50)
    with pytest.raises(ValueError):
        stats.detectable_effect("difference", 0.8)


def test_compare_arms_and_ship(spark):
    rows = [(arm, q, base + extra) for arm, extra in (("base", 0.0), ("up", 0.2), ("down", -0.1)) for q, base in enumerate([0.1, 0.4, 0.7] * 20)]
    frame = spark.createDataFrame(rows, "arm string, qid long, score double")
    report = stats.compare_arms(frame, "base", resamples=200)
    assert {r.arm: r.resolved for r in report.collect()} == {"up": True, "down": True}
    assert [r.arm for r in stats.ship(report).collect()] == ["up"]


# --- support, readers, tiers ---------------------------------------------------------------


def test_first_hit_rank_and_oracle_context(spark):
    questions = spark.createDataFrame(
        [(0, "q", "photosynthesis", "gravity", "magnet", "quartz", "oxygen", "A"), (1, "q", "xx", "yy", "zz", "ww", "vv", "B")],
        "qid long, prompt string, A string, B string, C string, D string, E string, answer string",
    )
    lists = spark.createDataFrame([(0, 1, "about gravity"), (0, 2, "PHOTOSYNTHESIS works"), (0, 3, "photosynthesis"), (1, 1, "yy")], "qid long, rank int, text string")
    ranks = {r.qid: r.hit_rank for r in support.first_hit_ranks(questions, lists).collect()}
    assert ranks == {0: 2, 1: 0}
    oracle = {r.qid: (r.oracle_context, r.oracle_available) for r in support.oracle_contexts(questions, lists).collect()}
    assert oracle == {0: ("PHOTOSYNTHESIS works", True), 1: ("", False)}
    contexts = {r.qid: r.context for r in support.join_contexts(questions, lists).collect()}
    assert contexts[0] == "about gravity PHOTOSYNTHESIS works photosynthesis"


def test_texts_are_cut_for_the_ranked_chunks_only(spark, tmp_path):
    from gleanspark.catalog.fixtures import Tables

    # Article 7 has 1,002 pieces: its ids run into those of article 8.
    texts = {i: " ".join(f"w{i}" for _ in range(450)) for i in [-1, *range(12)]} | {7: "x " * (200 * 1001 + 1), 8: "short", 9: ""}
    rows = [(i, text, "en", "web", len(text)) for i, text in texts.items()] + [(10**13, "far", "en", "web", 3), (None, "none", "en", "web", 4)]
    rows.append((11, None, "en", "web", 0))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    ids = [-999, 3001, 3003, 7500, 8000, 8001, 9000, 10**16]
    ranked = spark.createDataFrame([(0, i + 1, c) for i, c in enumerate(ids)], "qid long, rank int, chunk_id long")
    assert {r.article_id for r in t.chunks_of(ranked).select("article_id").distinct().collect()} == {-1, 3, 7, 8, 9, 10**13}
    for parity in (None, 0, 1):
        whole = t.chunks if parity is None else t.half(parity)
        part = t.chunks_of if parity is None else t.half_of(parity)
        want = support.with_texts(ranked, whole, len(ids)).select("rank", "chunk_id", "text").collect()
        got = support.with_texts(ranked, part, len(ids)).select("rank", "chunk_id", "text").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == {None: 8, 0: 2, 1: 5}[parity]


def test_nan_logits_rank_last_and_ties_keep_option_order(spark):
    rows = [(0, i, v) for i, v in enumerate([0.5, float("nan"), 0.9, 0.5, -1.0])]
    frame = spark.createDataFrame(rows, "qid long, option_no int, logit double")
    assert readers.ranked_letters(frame).first()["letters"] == ["C", "A", "D", "E", "B"]
    ranks = readers.option_ranks(frame, ["qid"], 0).orderBy("option_no").collect()
    assert [r["rank"] for r in ranks] == [1, 4, 0, 2, 3]


def test_constant_logits_normalise_to_zero(spark):
    frame = spark.createDataFrame([("a", 0, i, 3.0) for i in range(5)], "arm string, qid long, option_no int, logit double")
    assert [r.logit for r in readers.normalized_logits(frame).collect()] == [0.0] * 5


def test_scorers_keep_keys(spark):
    pairs = spark.createDataFrame([(7, 1, "a b c", "c d"), (7, 0, "x", "yy zz z")], "qid long, option_no int, first string, second string")
    got = {r.option_no: r.logit for r in readers.overlap_scores(pairs).collect()}
    assert got == {0: 0.0, 1: 0.5}


def test_joins_match_null_with_null(spark):
    left = spark.createDataFrame([(1, None, "x"), (2, "b", None), (3, "c", "d")], "i long, k string, m string")
    right = spark.createDataFrame([(None, "x", "hit"), ("c", "other", "no")], "k string, m string, v string")
    assert {r.i: r.v for r in joins.attach(left, right, ["k", "m"], ["v"]).collect()} == {1: "hit", 2: None, 3: None}
    assert sorted(r.i for r in joins.without(left, right, ["k", "m"]).collect()) == [2, 3]
    with pytest.raises(ValueError):
        joins.require_attached(joins.attach(left, right, ["k", "m"], ["v"]), "i", "v")


def test_arc_letters_come_from_positions(spark):
    rows = [("a", "q1", "3", (["1", "2", "3"], ["x", "y", "z"])), ("b", "q2", "B", (["A", "B"], ["x", "y"])), ("c", "q3", "Q", (["A"], ["x"]))]
    frame = spark.createDataFrame(rows, "id string, question string, answerKey string, choices struct<label: array<string>, text: array<string>>")
    assert {r.id: r.answer for r in tiers.normalize_arc(frame).collect()} == {"a": "C", "b": "B"}


def test_build_t1_excludes_near_gold_and_needs_enough_rows(spark):
    gold = spark.createDataFrame([("What is the speed of light in a vacuum?",)], "prompt string")
    pool = spark.createDataFrame(
        [(0, "What is the speed of light in a vacuum ?"), (1, "Which planet is the largest one?"), (2, "Which planet is the largest one?"), (3, "Who wrote the play?")],
        "i long, prompt string",
    )
    assert sorted(r.i for r in tiers.build_t1(pool, gold, "i", 2).collect()) == [1, 3]
    with pytest.raises(ValueError):
        tiers.build_t1(pool, gold, "i", 3)


def test_build_t1_gives_rows_that_are_written(spark):
    gold = spark.createDataFrame([("What is the speed of light in a vacuum?",)], "prompt string")
    pool = spark.createDataFrame([(1, "Which planet is the largest one?"), (3, "Who wrote the play?")], "i long, prompt string")
    tier = tiers.build_t1(pool, gold, "i", 2)
    assert tier.count() == 2 and "Exchange" not in tier._jdf.queryExecution().executedPlan().toString()


def test_build_t1_draws_prompts_without_writing_the_pool(spark):
    """Long, repeated and null prompts: the draw of the first rows that have them, as on rows written first."""
    rng = random.Random(6)
    prompts = [" ".join(f"{rng.randrange(10**9)}" for _ in range(rng.choice([2, 400]))) for _ in range(40)] + [None]
    rows = [(i, rng.choice(prompts)) for i in range(150)]
    pool = spark.createDataFrame(rows, "i long, prompt string").repartition(3)
    gold = spark.createDataFrame([(prompts[0],), (prompts[1],)], "prompt string")
    clean = selection.keep_first(neardup.drop_near_duplicates(pool, gold), ["prompt"], ["i"])
    want = {r.i for r in selection.sample_exact(clean, "prompt", 12).collect()}
    before = len(runtime._made)
    tier = tiers.build_t1(pool, gold, "i", 12)
    assert {r.i for r in tier.collect()} == want and len(want) == 12
    names = [re.search("gleanspark-(.*)-", path)[1] for path in runtime._made[before:]]
    assert "clean-pool" not in names and "tier" in names


def test_long_keys_leave_as_digests(spark):
    long = ["x" * 500 + str(k) for k in range(4)]
    rows = spark.createDataFrame([(0, long[0], 1), (1, long[1], 1), (2, long[0], 2), (3, None, 1), (4, "y", None)], "i long, k string, m int")
    others = spark.createDataFrame([(long[0], 1), (long[0], 1), (None, 1), (long[2], 1)], "k string, m int")
    left = joins.without(rows, others, ["k", "m"])
    assert sorted(r.i for r in left.collect()) == [1, 2, 4] and left.columns == rows.columns
    assert folder_bytes([runtime._made[-1]]) < 4000 and "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.i for r in joins.without(rows, rows.where("i = 2"), ["k"]).collect()) == [1, 3, 4]


def test_null_policy_and_split_checks(spark):
    rows = spark.createDataFrame([("p", None, "b"), ("r", "a", "b")], "prompt string, A string, B string")
    assert tiers.apply_null_policy(rows, "drop", ["A", "B"]).count() == 1
    assert {r.A for r in tiers.apply_null_policy(rows, "empty", ["A", "B"]).collect()} == {"", "a"}
    with pytest.raises(ValueError):
        tiers.apply_null_policy(rows, "other")
    parts = spark.createDataFrame([("p", "A", "train"), ("p", "Z", "monitor"), ("g", "B", "train")], "prompt string, answer string, part string")
    found = tiers.split_violations(parts, spark.createDataFrame([("p",)], "prompt string"), spark.createDataFrame([("g",)], "prompt string"))
    assert found.first().asDict() == {"train_in_dev": 1, "monitor_in_dev": 1, "train_in_gold": 1, "train_in_monitor": 1, "bad_answers": 1}
    with pytest.raises(ValueError):
        tiers.require_clean(found)
    with pytest.raises(ValueError):
        tiers.require_answers(parts)


def test_hash_windows_are_bounded_by_the_group_limit(spark):
    frame = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = selection.top_k(frame, ["g"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- scratch -------------------------------------------------------------------------------


def test_scratch_folders_can_be_released(spark):
    import os

    from gleanspark import runtime

    path = runtime.scratch_path(spark, "probe")
    runtime.materialize(spark.range(3), "probe")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path)
    assert runtime.release_scratch(spark) >= 2
    assert not os.path.isdir(path) and runtime.release_scratch(spark) == 0


def test_context_sweep_pairs_clip_sizes(spark):
    from gleanspark.plans import inference

    rows = [(q, "which word", "x " * 150 + f"word{q}", "none", f"word{q}", "other", None, "last", "B") for q in range(40)]
    frame = spark.createDataFrame(rows, "qid long, prompt string, context string, A string, B string, C string, D string, E string, answer string")
    scores = inference.context_sweep(frame, (50, 400))
    got = {(r.chars, r.score) for r in scores.collect()}
    assert got == {(50, 0.5), (400, 1.0)} and scores.count() == 80
    report = {r.chars: r for r in inference.sweep_report(scores, 50, resamples=50).collect()}
    assert report[400].delta == 0.5 and report[400].resolved and report[50].delta is None and report[50].mean == 0.5
    assert {r.quantile for r in inference.context_lengths(frame).collect()} <= {305.0, 306.0}


def test_context_lengths_reads_its_contexts_once(spark):
    from gleanspark.plans import inference

    seen = spark.sparkContext.accumulator(0)

    def context(n):
        seen.add(1)
        return "x" * n

    frame = spark.range(40, numPartitions=2).select(F.udf(context, "string")("id").alias("context"))
    got = {r.prob: r.quantile for r in inference.context_lengths(frame).collect()}
    assert got == {0.5: 19.5, 0.9: pytest.approx(35.1)} and seen.value == 40


def test_index_sizes_count_no_chunks_again(spark, bm25_data):
    from gleanspark.plans import retrieval

    _, _, frame, _ = bm25_data
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    watched = frame.select("chunk_id", F.udf(seen, "string")("text").alias("text"))
    indexes = {"half": build_index(watched.where("chunk_id % 2 = 0")), "full": build_index(watched)}
    half, full = frame.where("chunk_id % 2 = 0").count(), frame.count()
    before = read.value
    assert {r.arm: r.n_chunks for r in retrieval.index_sizes(indexes).collect()} == {"half": half, "full": full}
    assert read.value == before == half + full
