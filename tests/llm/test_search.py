"""Lexical search, conversation repair and nearest neighbours: brute force, recall and edge cases."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.llm import code_search, lexical_blocks, queries, turn_repair

SF_DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def brute_force_ranks(documents, items, k=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, Counter(terms(t))) for d, t in documents]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = set()
    for item, text in items:
        scores = []
        for (d, c), size in zip(counts, sizes):
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + (75 * size * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        out |= {(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])}
    return out


def test_lexical_blocks_skip_and_stay_exact(spark, monkeypatch):
    """A skewed corpus in small chunks: most blocks are skipped, and the ranks are those of brute force."""
    rng = random.Random(2)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(40)]
    text = lambda: " ".join(rng.choice(["the", "of", "and", rng.choice(topics[0])]) for _ in range(30))
    documents = []
    for k in range(1200):
        topic = rng.choice(topics)
        documents.append((k, text() + " " + " ".join(rng.choice(topic) for _ in range(rng.randrange(1, 25)))))
    items = [(k, " ".join(["the", "of", *rng.sample(topics[k], 12)])) for k in range(15)]
    monkeypatch.setattr(lexical_blocks, "CHUNK", 300)
    table = spark.createDataFrame(documents, "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in lexical_blocks.search(table, asked).collect()}
    assert got == brute_force_ranks(documents, items)
    # The same index by hand, to see what it reads.
    names = sorted({t for _, x in items for t in x.split()})
    group = lexical_blocks.Items([k for k, _ in items], [sorted(set(x.split())) for _, x in items], [[1] * len(set(x.split())) for _, x in items])
    counts = [Counter(t for t in x.split() if t in group.number) for _, x in documents]
    starts = np.cumsum([0, *map(len, counts)])
    terms = np.array([group.number[t] for c in counts for t in c])
    values = np.array([1000 * v // (v + 2) for c in counts for v in c.values()])
    best, read = lexical_blocks.Best(len(items), 10), Counter()
    for a in range(0, 1200, 300):
        s, e = starts[a], starts[a + 300]
        lexical_blocks.search_chunk(group, best, np.arange(a, a + 300), starts[a : a + 301] - s, terms[s:e], values[s:e], read)
    assert len(names) == len(group.number)
    assert read["blocks skipped"] > 0 and read["lists skipped"] > 0.2 * read["lists"]


def test_lexical_blocks_summaries_are_bounds():
    rng = np.random.default_rng(3)
    starts = np.cumsum([0, *rng.integers(1, 12, 400)])
    terms = np.concatenate([np.sort(rng.choice(60, e - s, replace=False)) for s, e in zip(starts, starts[1:])])
    values = rng.integers(1, 1000, len(terms))
    lists = lexical_blocks.Lists(starts, terms, values, 60, rng.normal(size=(60, 8)))
    for term in range(60):
        members, keys, tops = lists.blocks(term)
        assert sorted(np.concatenate(members)) == sorted(d for d in range(400) if term in terms[starts[d] : starts[d + 1]])
        tops = dict(zip(keys.tolist(), tops.tolist()))
        for b, docs in enumerate(members):
            want = Counter()
            for d in docs:
                for t, v in zip(terms[starts[d] : starts[d + 1]], values[starts[d] : starts[d + 1]]):
                    want[int(t)] = max(want[int(t)], int(v))
            assert all(tops[b * 60 + t] == v for t, v in want.items())


def test_lexical_edges(spark):
    documents = [(1, "Red fox, red FOX!"), (2, "red"), (2, "red"), (3, None), (4, ""), (5, "é ü"), (None, "red fox"), (6, "x " * 30_000), (7, "red red fox fox")]
    items = [(1, "red fox"), (1, "red fox"), (1, "fox x"), (2, None), (3, " ?!"), (None, "red"), (4, "É ü ü"), (5, "nothing here")]
    table = spark.createDataFrame(documents, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "terms", "item", "rank")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in lexical_blocks.search(table, asked).collect()]
    kept = [(1, "red fox"), (4, "É ü ü"), (5, "nothing here")]
    both = brute_force_ranks(documents, kept) | brute_force_ranks(documents, [(1, "fox x")])
    assert set(got) == both and len(got) == len(both)
    assert [d for i, r, d, s in sorted(got) if i == 4] == [5]
    assert lexical_blocks.search(table.limit(0), asked).count() == 0
    assert lexical_blocks.search(table, asked.limit(0)).count() == 0


def cheapest(turns):
    """(cost, audit, digest) by trying all edits of (role, text, must go, unended)."""
    found, limit = [], [3 * len(turns)]

    def go(i, cost, audit, roles, lines):
        if cost > limit[0] or not re.fullmatch("(s?(ua)*u?)?", roles):
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit, "\n".join(lines)))
            limit[0] = min(limit[0], cost)
        for x, name in turn_repair.ROLES.items():
            go(i, cost + 2, audit + "I", roles + x, [*lines, f"{name}:"])
        if i < len(turns):
            role, text, must_go, unended = turns[i]
            go(i + 1, cost + 3, audit + "D", roles, lines)
            if not must_go:
                go(i + 1, cost + unended, audit + "K", roles + (role[:1] if role[:1] in "sua" and role else "x"), [*lines, f"{role}:{text}"])
                for x, name in turn_repair.ROLES.items():
                    go(i + 1, cost + 2 + unended, audit + "R", roles + x, [*lines, f"{name}:{text}"])

    go(0, 0, "", "", [])
    cost, audit, text = min(found)
    return cost, audit, hashlib.sha256(text.encode()).hexdigest()


def test_cheapest_repair():
    rng = random.Random(3)
    for _ in range(400):
        roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
        turns = [(rng.choice(roles), rng.choice("pq"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(6))]
        parser = turn_repair.Parser()
        for turn in turns:
            parser.turn(*turn)
        assert parser.result() == cheapest(turns), turns


def test_repaired_turns(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello!"), (1, 2, "user", "Hm"), (1, 2, "user", "Hm"), (1, 4, "assistant", "Yes."),
        (2, 5, None, None), (2, 7, "tool", " \n"), (3, None, "user", "First."), (3, 1, "assistant", "Then."), (3, 2, "assistant", "Then."),
        (None, 1, "user", "No id."), (None, None, "assistant", "No id."), (4, 1, "assistant", "a." + " b" * 40_000),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    table = table.withColumns({c: F.lit("clash") for c in ("conv", "audit", "cost", "said", "n", "c", "s")})
    got = {r.conv_id: r for r in turn_repair.repair(table).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert (got[1].gaps, got[1].duplicate, got[1].truncated, got[1].illegal, got[1].audit, got[1].cost) == (1, 1, 1, 2, "KIKKDK", 6)
    assert (got[2].gaps, got[2].blank, got[2].audit, got[2].cost) == (1, 2, "DD", 6)
    assert (got[3].gaps, got[3].audit, got[3].duplicate) == (0, "KKD", 1)
    assert got[None].audit == "IKKI" and got[None].gaps == 0
    assert (got[4].audit, got[4].truncated, got[4].cost) == ("D", 1, 3)
    left = turn_repair.repaired_turns(table, turn_repair.repair(table)).collect()
    for key, row in got.items():
        turns = sorted((r.position, r.role, r.text) for r in left if r.conv_id == key)
        text = "\n".join(f"{role}:{text}" for _, role, text in turns)
        assert hashlib.sha256(text.encode()).hexdigest() == row.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in turns))
    assert turn_repair.repair(table.limit(0)).count() == 0 and turn_repair.digests(table.limit(0)).count() == 0
    assert turn_repair.digests(table).count() == 5


@tables
def test_neighbours_recall(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    got = {}
    for r in queries.QUERIES["op13_multi_index_codes"](spark, SF_DIR).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, matrix = np.array(list(rows)), np.array(list(rows.values()))
    shares = []
    for query in (k for k in rows if k % 20 == 0):
        scores = (matrix * rows[query]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:20]
        mine = sorted(got[query])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(s == pytest.approx(float(rows[query] @ rows[v]), rel=1e-12) for _, v, s in mine)
        shares.append(len({ids[i] for i in order} & {v for _, v, _ in mine}) / 20)
    assert np.mean(shares) > 0.97


def test_neighbours_within_the_radius():
    """Probing retrieves every code within a query's radius: what is within it by a scan is found."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32))
    rows = centres[rng.integers(0, 20, 3000)] + 0.2 * rng.normal(size=(3000, 32))
    index = code_search.Index(rows, code_search.rotations(code_search._unit(rows), 32))
    q, c = index.near(rows[:50], 10)
    scores = rows[:50] @ rows.T
    shares = [len(set(np.argsort(-scores[i])[:10]) & set(c[q == i])) / 10 for i in range(50)]
    assert np.mean(shares) > 0.95 and len(q) < 50 * 3000 * 0.4
    # Balls of the pigeonhole: every row whose code differs by at most the level in a substring.
    for level in (0, 1, 3):
        sets = index._ball(level)
        j, key = 2, int(index.codes[7, 2])
        want = np.bitwise_count(index.codes[:, j] ^ np.uint8(key)) <= level
        assert (np.unpackbits(sets[j][key], count=3000).astype(bool) == want).all()


def test_neighbours_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]),
        (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [2.0]), (40, [3.0]), (9, []), (None, [1.0, 1.0]), (10, [-5.0, 1.0]), (11, [1e200, 1e-200]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = table.withColumns({c: F.lit("clash") for c in ("v", "length", "size", "block", "ids", "score", "rank")})
    found = code_search.search(code_search.usable(table), F.col("vec_id") % 20 == 0, 3).collect()
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)
    assert got == [
        (0, 1, 11, 1e200), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (20, 1, 11, 5e199), (20, 2, 0, 0.5), (20, 3, 1, 0.5), (40, 1, 8, 6.0),
    ]
    every = code_search.search(code_search.usable(table), F.col("vec_id") == 0, 20).collect()
    assert [r.vec_id for r in sorted(every, key=lambda r: r.rank)] == [11, 1, 2, 20, 10]
    assert code_search.search(code_search.usable(table.limit(0)), F.lit(True)).count() == 0
    assert code_search.search(code_search.usable(table), F.lit(False)).count() == 0
    copies = [(k, [0.6, 0.8]) for k in range(500)] + [(1000, [0.0, 1.0])]
    table = spark.createDataFrame(copies, "vec_id long, embedding array<double>")
    got = code_search.search(code_search.usable(table), F.col("vec_id") % 20 == 0, 5).collect()
    assert all(sorted(r.vec_id for r in got if r.query_id == q) == ([1, 2, 3, 4, 5] if q == 0 else list(range(5))) for q in (0, 20, 480))
