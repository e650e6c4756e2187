"""Every operator against brute force, a library, SQL or held-out labels."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from check import connect, differences

from gleanspark.llm import bpe, hamming_join, language, line_rules, nra, packing, passages, quality_crf, queries, sanitise
from gleanspark.llm import suffix_levels
from gleanspark.llm.components import components

SMALL, SF_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
KINDS = ["email", "ip", "card", "phone"]
#: The patterns of the four kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) == []


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_quality_on_held_out_labels(spark):
    rows = queries.op1(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").where("held_out")
    right = [r.predicted == r.quality for r in rows.collect()]
    assert len(right) > 40 and np.mean(right) > 0.95


def test_chain_marginals():
    rng = np.random.default_rng(1)
    field = quality_crf.Field()
    field.pairs = rng.normal(size=(2, 2))
    counts = np.array([3, 1, 4])
    good = rng.normal(size=8)
    got, _, normaliser = field._marginals(good, counts)
    want, total, at = [], 0.0, 0
    for n in counts:
        weights = {}
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            s = sum(good[at + k] for k in range(n) if y[k]) + sum(field.pairs[y[k], y[k + 1]] for k in range(n - 1))
            weights[tuple(y)] = np.exp(s)
        z = sum(weights.values())
        total += np.log(z)
        want += [sum(w for y, w in weights.items() if y[k]) / z for k in range(n)]
        at += n
    assert np.allclose(got, want) and np.isclose(normaliser, total)


def test_language_on_held_out_rows(spark):
    rows = queries.op10(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id").where("held_out")
    right = [r.lang_pred == r.lang for r in rows.collect()]
    assert len(right) > 200 and np.mean(right) > 0.97


def test_network_gradients():
    network = language.Network(["a", "b", "c"], hidden=3)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    data, lengths = language.padded([b" abc", b" q", b" abcdefg"])
    targets = np.array([0, 1, 2])
    _, grads = network.gradients(data, lengths, targets)
    for name in network.weights:
        flat = network.weights[name].reshape(-1)
        at = int(np.argmax(np.abs(grads[name])))
        held, step = flat[at], 1e-3
        flat[at] = held + step
        up = network.gradients(data, lengths, targets)[0]
        flat[at] = held - step
        down = network.gradients(data, lengths, targets)[0]
        flat[at] = held
        assert np.isclose((up - down) / (2 * step), grads[name].reshape(-1)[at], rtol=0.02, atol=1e-4), name


def word_spans(texts):
    """Words that lie in a stretch of 50 words which an earlier document has."""
    first, covered = {}, {}
    for key in sorted(texts):
        words = (texts[key] or "").encode().lower().split()
        hit = np.zeros(len(words), bool)
        for s in range(len(words) - 49):
            if first.setdefault(tuple(words[s : s + 50]), key) != key:
                hit[s : s + 50] = True
        covered[key] = hit
    return covered


def test_passages_find_exact_repeats(spark, texts):
    want = word_spans(texts)
    got = {r.doc_id: r for r in queries.op2(spark, SF_DIR).collect()}
    found = total = 0
    for key, hit in want.items():
        mine = np.zeros(len(hit), bool)
        if key in got:
            for a, b in zip(got[key].starts, got[key].ends):
                mine[a:b] = True
        found, total = found + (hit & mine).sum(), total + hit.sum()
        assert not hit.any() or (hit & mine).any()
    assert found > 0.995 * total > 1000


def test_passages_are_similar(spark, texts):
    rows = passages.repeated_passages(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()
    for r in random.Random(1).sample(rows, 40):
        words = texts[r.doc].encode().lower().split()[r.start : r.end]
        other = texts[r.pdoc].encode().lower().split()
        mine = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        every = {tuple(other[i : i + 5]) for i in range(len(other) - 4)}
        assert len(words) >= 50 and r.pdoc < r.doc and len(mine & every) >= 0.8 * len(mine)


def test_passages_of_a_family(spark):
    """One template, other words changed in each text: under 80 percent and without a run of 50 words, but for some pairs."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") for _ in range(7))
    template = [word() for _ in range(60)]

    def variant():
        words = list(template)
        for third in range(4):
            words[third * 15 + rng.randrange(2, 13)] = word()
        return words

    family = [variant() for _ in range(90)]
    near = list(family[20])
    near[30] = word()
    for later, words in ((60, family[10]), (80, family[10]), (70, near), (85, near)):
        family[later] = list(words)
    rows = [(k, " ".join([word() for _ in range(30)] + x + [word() for _ in range(30)])) for k, x in enumerate(family)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc: (r.starts, r.ends) for r in passages.spans(passages.repeated_passages(table)).collect()}
    sets = [{tuple(x[i : i + 5]) for i in range(56)} for x in family]
    want = {k for k in range(90) if any(100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j]) for j in range(k))}
    assert want == {60, 70, 80, 85} and want <= got.keys()
    for k in (60, 80, 85):
        assert got[k][0][0] <= 30 and got[k][1][-1] >= 90


def _passage_shapes(rng):
    """Texts, and of the later ones the kind and the words that repeat an earlier text with one word changed in 50 or 60."""
    word = lambda: "".join(rng.choice("bcdfghklmnprst") for _ in range(7))
    words = lambda n: [word() for _ in range(n)]

    def edited(passage, at=None):
        passage = list(passage)
        passage[rng.randrange(3, len(passage) - 3) if at is None else at] = word()
        return passage

    rows, want = [], {}
    for _ in range(60):  # apart in the earlier text, next to each other in the later one
        a, b = words(60), words(60)
        rows.append(words(30) + a + words(200) + b + words(30))
        want[len(rows)] = (30, 150)
        rows.append(words(30) + edited(a) + edited(b) + words(30))
    for _ in range(400):  # the shortest passage, changed in its middle
        a = words(50)
        rows.append(words(30) + a + words(30))
        want[len(rows)] = (40, 90)
        rows.append(words(40) + edited(a, 25) + words(40))
    return [" ".join(x) for x in rows], want


def test_edited_passages(spark):
    rows, want = _passage_shapes(random.Random(5))
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc: (r.starts, r.ends) for r in passages.spans(passages.repeated_passages(table)).collect()}
    assert set(got) <= set(want)
    shares = []
    for key, (a, b) in want.items():
        covered = {w for s, e in zip(*got.get(key, ([], []))) for w in range(s, e)}
        shares.append(len(covered & set(range(a, b))) / (b - a))
        assert len(covered - set(range(a, b))) == 0
    assert np.mean(shares) > 0.99


def test_alignment():
    """All stretches that begin and end with a match and are similar enough, against every stretch."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        mine = rng.permutation(1000)[:60].astype(np.int32)
        theirs = np.concatenate([rng.integers(1000, 2000, rng.integers(0, 9)), mine[rng.integers(0, 9) :]]).astype(np.int32)
        theirs[rng.random(len(theirs)) < 0.08] += 5000
        at = {v: k for k, v in enumerate(theirs.tolist())}
        hits = [(k, at[v]) for k, v in enumerate(mine.tolist()) if v in at]
        want = set()
        for p, (i, j) in enumerate(hits):
            for q in range(p, len(hits)):
                k, m = hits[q]
                if k - i + 1 >= 20 and 100 * (q - p + 1) >= 80 * (k - i + 1 + m - j + 1 - (q - p + 1)):
                    want |= set(range(i, k + 1))
        got = {x for a, b in passages.aligned(mine, theirs, -9, 9, 20, 80) for x in range(a, b)}
        assert got == want


def test_compact_windows():
    rng = np.random.default_rng(2)
    values = rng.integers(1, 40, 300).astype(np.uint64)
    values[[90, 91, 200]] = 0
    got = set(zip(*(x.tolist() for x in passages.compact_windows(values, 7))))
    want = set()
    for c, v in enumerate(values):
        left, right = c, c
        while v and left > 0 and values[left - 1] > v:
            left -= 1
        while v and right + 1 < len(values) and values[right + 1] >= v:
            right += 1
        if v and right - left + 1 >= 7:
            want.add((c, left, right))
    assert got == want


def luhn(digits):
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def personal(text):
    found = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_patterns(spark):
    rng = random.Random(3)
    letters = "0123456789.+@-() aB_%\nx4444é\x01\x02"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2_500)]
    rows += ["4111 1111 1111 1111", "x@y.z_q@a.b", "9" * 30_000, "a" * 30_000, "1.2.3.4.5.6.7.8", "000255.1.2.3"]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in sanitise.digests(table).collect()}
    for key, text in enumerate(rows):
        want = personal(text)
        assert got[key].spans == want and got[key].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_personal_data_of_the_table(spark, texts):
    got = {r.doc_id: r.base_sha256 for r in queries.op4(spark, SF_DIR).collect()}
    assert got == {k: hashlib.sha256(personal(t).encode()).hexdigest() for k, t in texts.items()}


def test_terms_that_disclose(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join("".join(rng.choice("bcdfgklmnprst") for _ in range(6)) for _ in range(n))
    rows = [f"{noise(3)} the moonwalker wrote to ann@x.example {noise(3)}" for _ in range(6)]
    rows += [f"{noise(8)} the {noise(8)}" for _ in range(300)]
    # A copied text is no evidence, however often it is there.
    rows += [f"elderberry merchant bob@x.example {k % 2}" for k in range(8)]
    rows.append("Moonwalker! said ann@x.example")
    rows.append("moonwalker alone is left as it is")
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in sanitise.digests(table).collect()}
    marked = {k for k, x in got.items() if "term" in x}
    assert marked == {0, 1, 2, 3, 4, 5, len(rows) - 2}
    assert got[len(rows) - 2] == "term:0:10,email:17:30"
    clean = {r.doc_id: r.text for r in sanitise.sanitise(table).collect()}
    assert clean[len(rows) - 2] == "[TERM]! said [EMAIL]" and clean[len(rows) - 1] == rows[-1]


def test_terms_on_other_lines(spark):
    """The name stands above the address, or far from it, and its neighbours are the same each time."""
    rng = random.Random(6)
    noise = lambda n: " ".join("".join(rng.choice("bcdfgklmnprst") for _ in range(6)) for _ in range(n))
    rows = [f"{noise(20)}\nJane Moonwalker, Acme, jane@x.example" for _ in range(25)]
    rows += [f"Igor Blacksmith\n{noise(40)}\nigor@y.example" for _ in range(25)]
    rows += [noise(25) for _ in range(950)]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in sanitise.digests(table).collect()}
    terms = lambda k: {rows[k][int(a) : int(b)].lower() for kind, a, b in got[k] if kind == "term"}
    for k in range(1000):
        wanted = {"jane", "moonwalker", "acme"} if k < 25 else {"igor", "blacksmith"} if k < 50 else set()
        assert terms(k) == wanted


def test_disclosure_against_brute_force(spark):
    rng = random.Random(7)
    names = [f"name{chr(97 + k)}" for k in range(8)]
    rows = []
    for k in range(300):
        person = rng.randrange(8)
        text = [f"plain{rng.choice('abcdef')}{rng.choice('uvwxyz')}" for _ in range(12)]
        if k % 3 == 0:
            text.append(f"\n{names[person] if rng.random() < 0.9 else names[0]} p{person}@x.example\n")
        if rng.random() < 0.05:
            text.append(rng.choice(names))
        rows.append(" ".join(text))
    rows += rows[:40]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    texts = sorted(set(rows))
    held = {t: set(x for x in re.split(r"[^a-z]+", t.lower()) if len(x) >= 3) for t in texts}
    entities = {t: set(re.findall(PATTERNS["email"].replace("(", "(?:"), t.lower())) for t in texts}
    pairs = defaultdict(lambda: [0, set()])
    for t in texts:
        for e in entities[t]:
            rest = "\n".join(x for x in t.split("\n") if e not in x.lower())
            for w in held[t]:
                pairs[e, w][0] += 1
                pairs[e, w][1].add(rest if rest.strip() else t)
    want = set()
    for (e, w), (c, contexts) in pairs.items():
        n, df_e, df_w = len(texts), sum(e in x for x in entities.values()), sum(w in x for x in held.values())
        share = math.log(n * c / (df_w * df_e)) / math.log(n / df_e)
        assert abs(share - sanitise.DISCLOSURE) > 1e-9
        if len(contexts) >= sanitise.MIN_CONTEXTS and share >= sanitise.DISCLOSURE:
            want.add((e, w))
    got = {r.doc_id: r.spans for r in sanitise.digests(table).collect()}
    assert len(want) > 3
    for k, t in enumerate(rows):
        mine = {t[int(a) : int(b)].lower() for kind, a, b in (x.split(":") for x in got[k].split(",") if x) if kind == "term"}
        addresses = [m.span() for m in re.finditer(PATTERNS["email"], t)]
        outside = lambda w: any(not any(a <= m.start() < b for a, b in addresses) for m in re.finditer(rf"\b{w}\b", t))
        assert mine == {w for e in entities[t] for x, w in want if x == e and re.search(rf"(?<![a-z]){w}(?![a-z])", t) and outside(w)}


def test_boilerplate_beside_other_lines(spark):
    """Twelve lines that all pages of a host share go, two own lines stay; lines of a copied text are no boilerplate."""
    rng = random.Random(8)
    line = lambda n=6: " ".join("".join(rng.choice("bcdfgklmnprst") for _ in range(5)) for _ in range(n))
    shared, copy = [line() for _ in range(12)], "\n".join(line() for _ in range(9))
    rows = [("\n".join(rng.sample(shared, 12) + [line(12), line(30)]), "h") for _ in range(400)]
    rows += [(copy, "h")] * 300 + [("\n".join(shared), "h")] * 50 + [("\n".join([*shared, line(20)]), "other")] * 20
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.judge(table).collect()}
    assert {(got[k].n_boilerplate, got[k].kept) for k in range(400)} == {(72, True)}
    assert {(got[k].n_boilerplate, got[k].kept) for k in range(400, 700)} == {(0, True)}
    assert {(got[k].n_boilerplate, got[k].kept) for k in range(700, 750)} == {(72, False)}
    assert {(got[k].n_boilerplate, got[k].kept) for k in range(750, 770)} == {(0, True)}
    left = {r.doc_id: r.text for r in line_rules.clean(table).collect()}
    assert left[0] == "\n".join(rows[0][0].split("\n")[12:]) and left[400] == copy and 700 not in left


def test_byte_bpe_is_the_library(spark, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op5(spark, SF_DIR).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest)
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    coder = bpe.Coder(path, bpe.split_patterns(public_tokenizers.PATTERN))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for c in random.Random(2).sample(every, 60_000):
        assert coder.encode(f"1a{c}a1 {c}") == library.encode_ordinary(f"1a{c}a1 {c}")


def repeats(rows, span):
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        hit = np.zeros(len(data), bool)
        for s in range(len(data) - span + 1):
            if data[s : s + span] in seen:
                hit[s : s + span] = True
            seen.add(data[s : s + span])
        spans = int((hit[1:] & ~hit[:-1]).sum() + hit[:1].sum())
        left = bytes(np.frombuffer(data, np.uint8)[~hit])
        out[key] = (len(data), int(hit.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def test_repeated_strings(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abc ") for _ in range(2_000))
    rows = ["a" * 500, "ab" * 300, None, "", "x" * 99, base[:400], base[100:600] + base[300:700], "é" * 80 + base[:150]]
    for _ in range(50):
        at = rng.randrange(1_500)
        text = list(base[at : at + rng.randrange(50, 500)])
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice("XYZ")
        rows.append("".join(text) + rng.choice(["", "a" * 130]))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_levels.dedup(table).collect()}
    assert got == repeats(rows, 100)


def test_strings_of_rows_that_share_an_id(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, other = text(150), text(150)
    known = [(1, line + text(200)), (2**63 - 1, text(300))]
    # Without an id: a repeat, a text with nothing repeated, equal strings at equal places, and a copy.
    none = [line + text(100), text(400), other + text(200), other + text(200), text(120)]
    shared = [(5, text(160) + line), (5, text(400))]
    rows = known + shared + [(None, x) for x in [*none, none[0]]]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_bytes, r.kept.decode()) for r in suffix_levels.dedup(table, with_bytes=True).collect()}
    left = {x for key, n, x in got if key is None}
    assert got > {(k, len(t), t) for k, t in (*known, shared[1])} and (5, 310, shared[0][1][:160]) in got
    assert {none[0][150:], none[1], none[4]} < left and len(left) == 5
    assert sorted(len(x) for x in left) == sorted([100, 400, 200, 350, 120])


def test_levels():
    levels = suffix_levels.Levels()
    rng = np.random.default_rng(3)
    records = [[rng.integers(0, 50, 400), np.zeros(400, np.int64), rng.integers(0, 30, 400), rng.integers(0, 9, 400)] for _ in range(9)]
    settled = [levels.add(*r) for r in records]
    sizes = [len(x[0]) for x in levels.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    k, _, doc, place = levels.drain()
    least = {}
    for r in records:
        for key, d, p in zip(r[0], r[2], r[3]):
            least[key] = min(least.get(key, (d, p)), (d, p))
    assert {key: (d, p) for key, d, p in zip(k, doc, place)} == least and len(k) == len(least)
    for s in settled:
        assert all((d, p) > least[key] for key, d, p in zip(s[0], s[2], s[3]))


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = {}
    for key, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[key, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = queries.op7(spark, SF_DIR).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_word_ids_are_the_tokenizer():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    parts = ["a", "B", "é", "é", ".", ",", "!", " ", "\n", " ", "\x1c", "5", "²", "ß", "Σ", "İ"]
    parts += ["'s", "'", "|", "中", "́", "​", "<|endoftext|>", "\x85", "_", "　", "क़", "ŉ", "&&&"]
    for _ in range(5_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        want = np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.encode([text]) == [want], repr(text)


def test_few_open_bins():
    rng = random.Random(7)
    bins, used = packing.Bins(100, 3), defaultdict(int)
    for _ in range(2_000):
        length = rng.randrange(1, 101)
        number, offset = bins.put(length)
        assert offset == used[number] and bins.count <= 3
        used[number] += length
        assert used[number] <= 100


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def classes(texts, size, share):
    sets = {k: shingles(t, size) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n, m = len(sets[a]), len(sets[b])
            if 100 * min(n, m) >= share * max(n, m):
                shared = len(sets[a] & sets[b])
                if 100 * shared >= share * (n + m - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_near_duplicates(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8(spark, SF_DIR).collect()}
    assert got == classes(texts, 3, 85)


def test_family_of_near_copies(spark):
    """Copies with changed words: some are links of the first, some of each other, some of none."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 12)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(words))
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hamming_join.near_duplicates(table, 3, 85).collect()}
    assert got == classes(dict(enumerate(rows)), 3, 85)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_search_against_brute_force():
    rng = np.random.default_rng(9)
    for n, dims, size in ((3, 4, 2.0), (60, 1, 2.0), (400, 6, 2.0), (700, 24, 2.0), (40, 3, 1e14), (40, 3, 1e200)):
        rows = rng.uniform(-size, size, (n, dims))
        rows[n // 2 :] = rows[: n - n // 2]  # ties
        ids, times = rng.permutation(n) * 7, rng.integers(1, 3, n)
        asked = rng.choice(n, min(n, 5), replace=False)
        got, _ = nra.block_top(rows[asked], ids[asked], rows, ids, times, 5)
        whole = [[math.floor(Fraction(x) * 256) for x in r] for r in rows]
        for i in asked:
            every = [(-sum(a * b for a, b in zip(whole[j], whole[i])), ids[j]) for j in range(n) if j != i for _ in range(times[j])]
            want = [(d, min(max(-s, nra.LONGS[0]), nra.LONGS[1])) for s, d in sorted(every)[:5]]
            assert [(d, s) for q, d, s, _ in got if q == ids[i]] == want


def test_lists_are_read_in_order():
    """Where the best rows stand out, reading stops long before the lists end."""
    rng = np.random.default_rng(4)
    rows = rng.uniform(0, 1, (6_000, 8)) ** 40
    rows[:10] = 1 + np.arange(10)[:, None] / 10
    lists = nra.Lists(np.floor(rows * 256))
    [(found, _)] = lists.best(np.ones((1, 8)), np.zeros((1, 6_000), bool), 5)
    assert {9, 8, 7, 6, 5} <= set(found.tolist()) and lists.read == nra.STEP * 8


def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    got = {r.doc_id: r.text for r in stages["near_dedup"](spark, docs, SMALL).collect()}
    assert set(got) == {k for k, (_, c) in classes(before, 5, 80).items() if c == k}
    left = {r.doc_id: r.text for r in stages["substring_dedup"](spark, docs, SMALL).collect()}
    spans = {r.doc: (r.starts, r.ends) for r in passages.spans(passages.repeated_passages(docs)).collect()}
    assert set(left) == set(before)
    for key, text in before.items():
        gone = sum(b - a for a, b in zip(*spans[key])) if key in spans else 0
        assert len(left[key].split()) == len(text.split()) - gone
        assert gone or left[key] == text
    assert sum(x.sum() for x in word_spans(left).values()) <= 0.01 * sum(x.sum() for x in word_spans(before).values())
    clean = {r.doc_id: r.text for r in stages["personal_data"](spark, docs, SMALL).collect()}
    assert all(personal(t) == "" for t in clean.values())
    assert all(clean[k] == t for k, t in before.items() if personal(t) == "")


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and all(r.length <= 2048 for r in rows)
    assert rows[0].asDict().keys() >= {"doc_id", "piece", "sequence_id", "offset"}

