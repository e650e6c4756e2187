"""Words, n-grams, shingles, sentences and chunk windows as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware string split treats as blanks, NBSP included;
# without (?U) a bare \s would miss most of them.
UNICODE = "(?U)"
BLANK = r"\s\x{1C}-\x{1F}"

# The English stop words of the sparse retriever.
ENGLISH_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]

# Patterns that decide what counts as a token, keyword or sentence end.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
KEYWORD_PATTERN = r"[A-Za-z]{5,}"
PHRASE_WORD_PATTERN = r"[A-Za-z0-9]+"
SENTENCE_END_PATTERN = r"""(?<=[.!?]|[.!?]["')])[""" + BLANK + r"]+(?=[A-Z0-9=*(])"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, even where lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column | str) -> Column:
    """The blank-separated words of a text; an empty array for a blank text."""
    return F.regexp_extract_all(_column(text), F.lit(f"{UNICODE}[^{BLANK}]+"), F.lit(0))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_column(text), f"{UNICODE}^[{BLANK}]+|[{BLANK}]+$", "")


def collapse(text: Column | str) -> Column:
    """Lowercase, single blanks, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(_column(text)), f"{UNICODE}[{BLANK}]+", " "))


def windows(text: Column | str, max_words: int = 200) -> Column:
    """Non-overlapping windows of at most ``max_words`` words.

    A text that fits comes back untouched, blanks and all.
    """
    text = _column(text)

    def cut(w: Column) -> Column:
        last = F.floor((F.size(w) - 1) / max_words).cast("int")
        return F.when(F.size(w) <= max_words, F.array(text)).otherwise(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.array_join(F.slice(w, i * max_words + 1, F.lit(max_words)), " "),
            )
        )

    return let(words(text), cut)


def window_count(text: Column | str, max_words: int = 200) -> Column:
    """How many pieces :func:`windows` gives, without building them."""
    n = F.size(words(text))
    return F.greatest(F.lit(1), F.ceil(n / max_words)).cast("long")


def tokens(text: Column | str, stopwords: list[str] | None = None) -> Column:
    """Search tokens: lowercased runs of two or more word characters, less stop words."""
    found = F.regexp_extract_all(F.lower(_column(text)), F.lit(TOKEN_PATTERN), F.lit(0))
    stopwords = ENGLISH_STOPWORDS if stopwords is None else stopwords
    if not stopwords:
        return found
    return F.filter(found, lambda t: ~t.isin(stopwords))


def shingles(text: Column | str, n: int = 5) -> Column:
    """Distinct character n-grams of the collapsed text; a shorter text is its own shingle."""

    # One window starts at every character; a position inside a surrogate pair is none.
    window = rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{n - 1}}}))"

    def grams(flat: Column) -> Column:
        return F.when(F.length(flat) < n, F.array(flat)).otherwise(
            F.array_distinct(F.regexp_extract_all(flat, F.lit(window), F.lit(1)))
        )

    return let(collapse(text), grams)


def keywords(text: Column | str) -> Column:
    """Distinct lowercased words of five or more ASCII letters."""
    found = F.regexp_extract_all(F.lower(_column(text)), F.lit(KEYWORD_PATTERN), F.lit(0))
    return F.array_distinct(found)


def phrases(text: Column | str, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Distinct word n-grams of the given sizes."""
    found = F.regexp_extract_all(F.lower(_column(text)), F.lit(PHRASE_WORD_PATTERN), F.lit(0))

    def of_size(w: Column, n: int) -> Column:
        return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.size(w) - (n - 1)),
                lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "),
            )
        )

    return let(found, lambda w: F.array_distinct(F.concat(*[of_size(w, n) for n in sizes])))


def phrase_hits(grams: Column | str, text: Column | str) -> Column:
    """How many of the phrases the lowercased text contains."""
    grams = _column(grams)
    return let(
        F.lower(_column(text)), lambda low: F.size(F.filter(grams, lambda g: F.contains(low, g)))
    )


def sentences(text: Column | str, min_chars: int = 3) -> Column:
    """Sentences longer than ``min_chars`` characters, trimmed, in order."""
    parts = F.split(strip(text), UNICODE + SENTENCE_END_PATTERN)
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > min_chars)


def sentences_with_offsets(text: Column | str, min_chars: int = 3) -> Column:
    """Sentences as ``struct<text, start, end>``, offsets counted in the given text.

    The gaps between sentences are kept as their own pieces, so the running
    length of the pieces is the offset of each sentence.
    """
    text = _column(text)
    body = F.regexp_extract_all(
        text,
        F.lit(UNICODE + r"(?s).+?(?:(?=" + SENTENCE_END_PATTERN + r")|$)"),
        F.lit(0),
    )
    empty = F.array().cast("array<struct<text:string,start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state: Column, piece: Column) -> Column:
        trimmed = strip(piece)
        lead = F.length(piece) - F.length(F.regexp_replace(piece, f"{UNICODE}^[{BLANK}]+", ""))
        start = (state["at"] + lead).cast("int")
        one = F.struct(
            trimmed.alias("text"),
            start.alias("start"),
            (start + F.length(trimmed)).cast("int").alias("end"),
        )
        return F.struct(
            (state["at"] + F.length(piece)).cast("int").alias("at"),
            F.when(F.length(trimmed) > min_chars, F.array_append(state["found"], one))
            .otherwise(state["found"])
            .alias("found"),
        )

    return F.aggregate(body, zero, step)["found"]


def title_prefixed(title: Column | str, piece: Column | str) -> Column:
    return F.concat(_column(title), F.lit(": "), _column(piece))
