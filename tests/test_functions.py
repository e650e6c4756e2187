"""Column functions on literal values."""

import re

from pyspark.sql import functions as F

from gleanspark.functions import questions as Q
from gleanspark.functions import scores as S
from gleanspark.functions import text as X

PYTHON_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    frame = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_words_split_like_python(spark):
    text = "a" + "b".join(PYTHON_BLANKS) + "c​d  "
    assert one(spark, X.words("t"), t=text) == text.split()
    assert one(spark, X.words("t"), t=" \n ") == []
    assert one(spark, X.strip("t"), t="  a b \n") == "a b"


def test_short_text_is_kept_as_it_is(spark):
    assert one(spark, X.windows("t", 3), t="  a  b\n c ") == ["  a  b\n c "]
    assert one(spark, X.windows("t", 3), t="") == [""]


def test_long_text_is_cut_into_word_windows(spark):
    text = "a b\n c  d e f g"
    assert one(spark, X.windows("t", 3), t=text) == ["a b c", "d e f", "g"]
    assert one(spark, X.window_count("t", 3), t=text) == 3
    assert one(spark, X.window_count("t", 3), t="") == 1


def python_shingles(text, n=5):
    flat = " ".join(text.lower().split())
    return {flat} if len(flat) < n else {flat[i : i + n] for i in range(len(flat) - n + 1)}


def test_shingles_match_a_plain_loop(spark):
    for text in ["", "ab", "Hello  World", "naïve café", "x😀y😀z😀w", "aaaaaaaa", "😀😀😀😀😀😀", "12345"]:
        assert set(one(spark, X.shingles("t"), t=text)) == python_shingles(text), text


def test_tokens_drop_stop_words_and_single_letters(spark):
    assert one(spark, X.tokens("t"), t="The cat, a Dog_2 and x ÉTÉ the") == ["cat", "dog_2", "été"]
    assert one(spark, X.tokens("t", []), t="The cat a") == ["the", "cat"]


def test_phrases_are_distinct_word_ngrams(spark):
    text = "Tide over tide, over TIDE over"
    words = ["tide", "over", "tide", "over", "tide", "over"]
    want = {" ".join(words[i : i + n]) for n in (2, 3, 4) for i in range(7 - n)}
    got = one(spark, X.phrases("t"), t=text)
    assert set(got) == want and len(got) == len(want) == 6
    assert one(spark, X.phrases("t"), t="alone") == [] and one(spark, X.phrases("t"), t="") == []
    hits = X.phrase_hits(X.phrases("q"), "t")
    assert one(spark, hits, q="slow green river delta", t="the GREEN river delta, slow green") == 4


def test_sentences_match_the_python_split(spark):
    pattern = re.compile(r"""(?:(?<=[.!?])|(?<=[.!?]["')]))\s+(?=[A-Z0-9=*(])""")
    text = ' First one. Second "two." Third! no Split? 4th (x) a.b. Ok. ( five ) end'
    want = [p.strip() for p in pattern.split(text.strip()) if len(p.strip()) > 3]
    assert one(spark, X.sentences("t"), t=text) == want
    found = one(spark, X.sentences_with_offsets("t"), t=text)
    assert [s["text"] for s in found] == want
    assert all(text[s["start"] : s["end"]] == s["text"] for s in found)


def test_keywords_of_the_right_option_only(spark):
    options = ["photosynthesis in plants", "respiration in animals", "osmosis", None, "plants and animals"]
    assert one(spark, Q.distinctive_keywords("o", F.lit(0)), o=options) == ["photosynthesis"]
    assert one(spark, Q.distinctive_keywords("o", F.lit(3)), o=options) == []


def test_support_hit_is_containment(spark):
    assert one(spark, Q.support_hit("t", "k"), t="The PHOTOSYNTHESISING leaf", k=["photosynthesis"])
    assert not one(spark, Q.support_hit("t", "k"), t="a leaf", k=["photosynthesis"])
    assert not one(spark, Q.support_hit("t", "k"), t="anything", k=[])


def test_average_precision_by_rank(spark):
    # Average precision of a right answer at each of three places, and where it is missing or repeated.
    cases = [
        ("A", ["A", "B", "C"], 1.0),
        ("B", ["A", "B", "C"], 0.5),
        ("C", ["A", "B", "C"], 1 / 3),
        ("D", ["A", "B", "C"], 0.0),
        ("D", ["A", "B", "C", "D"], 0.0),
        ("B", ["A", "A", "B"], 1 / 3),
        ("A", ["A", "A", "A"], 1.0),
        ("A", [], 0.0),
    ]
    for actual, predicted, want in cases:
        assert abs(one(spark, S.average_precision("a", "p"), a=actual, p=predicted) - want) < 1e-12
    # The other definition scores a repeated label again.
    assert one(spark, S.precision_sum("a", "p"), a="A", p=["A", "A", "B"]) == 2.0


def test_rank_metrics(spark):
    ranks = spark.createDataFrame([(2,), (4,), (0,), (7,), (30,)], "r int")
    rows = ranks.select(S.recall_at("r", 5), S.reciprocal_rank("r"), S.ndcg_at("r", 10)).collect()
    assert [r[0] for r in rows] == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert [round(r[1], 6) for r in rows] == [0.5, 0.25, 0.0, 0.142857, 0.033333]
    assert [round(r[2], 6) for r in rows] == [0.63093, 0.430677, 0.0, 0.333333, 0.0]


def test_random_baseline(spark):
    assert abs(one(spark, S.random_baseline()) - 11 / 30) < 1e-12


def test_letters_and_positions(spark):
    assert one(spark, Q.position_of("a"), a="C") == 2
    assert one(spark, Q.position_of("a"), a="AB") == -1
    assert one(spark, Q.position_of("a"), a="Z") == -1
    assert one(spark, Q.letter_of(F.lit(4))) == "E"
    assert one(spark, Q.padded_option("o", 4), o=["a", "b"]) == ""
