"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base figures of a text come from its words and lines. The method then counts,
for each host, in how many documents a normalised line stands. Lines above the
limit are boilerplate and are removed; a document that loses most of its words
with them, or keeps too few, is rejected.

Copies of one document must not make its own lines boilerplate. Lines that more
than ``MAX_DOCUMENTS`` rows of the host have are frequent; a document is known by
a digest of the rest, its lines that are not. A frequent line is boilerplate if
more than ``MAX_DOCUMENTS`` different rests stand beside it. Copies of one text have one
rest, however many they are, and pages that share all of their navigation have as
many as there are pages. Copies with other edits in each have different
rests: of these a line counts as often as there are edited texts.

Lines are first counted per host with partial sums. The frequent ones are joined as
a broadcast when they were counted to be few, and by a shuffle otherwise; each
row then sums up its rest before anything is shuffled.

Defined results: a null text has no words and fails the base rules, as does an
empty one. A null host is a host of its own. Every row is answered by itself;
identical rows (same id, host and text) get the same answer, and a line counts
once in a row however often it stands there. Lines of digits only have no words
and are never boilerplate. An empty table gives no rows; other columns do not
matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.runtime import broadcast_if_small, materialize

#: Distinct documents of a host that may share a line.
MAX_DOCUMENTS = 30
#: A document must keep this share of its words, and so many words.
MIN_SHARE_LEFT = 0.3
MIN_WORDS_LEFT = 10
#: Frequent lines that are broadcast at most.
BROADCAST_LINES = 500_000

SPACE = "\\x20\\x09-\\x0D"
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def normalised(text: Column) -> Column:
    """Lower case, with runs of white space and digits as one blank; line ends stay."""
    return F.regexp_replace(F.lower(text), "[\\x20\\x09\\x0B-\\x0D0-9]+", " ")


def line_hash(line: Column) -> Column:
    """Of a line of a normalised text."""
    return F.xxhash64(F.trim(line))


def with_figures(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    full = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("__words", words_of(full)).withColumn("__lines", lines_of(full))
    last = F.size("__words") - WINDOW
    at = lambda i: [F.element_at("__words", i + k) for k in range(1, WINDOW + 1)]
    rows = rows.withColumn(
        "__hashes",
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*at(i)))),
    )
    repeats = F.size("__hashes") > F.size(F.array_distinct("__hashes"))
    rows = rows.withColumn(
        "__sorted",
        F.when(repeats, F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))),
    )
    h = lambda i: F.get("__sorted", i)["h"]
    twice = F.filter("__sorted", lambda x, i: (x["h"] == h(i - 1)) | (x["h"] == h(i + 1)))
    rows = rows.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["p"])))
    # A window adds the words behind the last one counted.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        "__places",
        start,
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
        ),
    )["n"]
    rows = rows.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(full, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(full) - F.length(F.translate(full, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        }
    ).drop("__words", "__lines", "__hashes", "__sorted", "__places")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _key(id_column: str, text_column: str, host_column: str) -> Column:
    """Sixteen bytes that identical rows share and no others."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0002"))
    return F.unhex(F.md5(F.concat_ws("\u0001", part(id_column), part(host_column), part(text_column)).cast("binary")))


def line_rows(documents: DataFrame, id_column="doc_id", text_column="text", host_column="source") -> DataFrame:
    """Per row and distinct normalised line with words: key, host, the hash of the line, its words ``n``, and the words
    ``total`` of all of the row's distinct lines."""
    lines = F.transform(F.split(normalised(F.coalesce(F.col(text_column), F.lit(""))), "\n"), F.trim)
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    line = lambda x: F.struct(F.xxhash64(x).alias("line"), words(x).alias("n"))
    rows = documents.select(
        _key(id_column, text_column, host_column).alias("key"),
        F.col(host_column).alias("host"),
        F.transform(F.array_distinct(F.array_remove(lines, "")), line).alias("lines"),
    )
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return rows.select("key", "host", total.alias("total"), F.explode("lines").alias("x")).select("key", "host", "total", "x.*")


def boilerplate_in_rows(
    documents: DataFrame, id_column="doc_id", text_column="text", host_column="source", max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """Per row key with boilerplate: the hashes of those lines, their words ``n``, and ``total``."""
    rows = line_rows(documents, id_column, text_column, host_column)
    counted = rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max_documents)
    counted = counted.select(F.col("host").alias("h"), F.col("line").alias("l"))
    frequent = broadcast_if_small(materialize(counted, "frequent-lines"), BROADCAST_LINES)
    same = F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))
    often = F.col("l").isNotNull()
    # The mean of the hashes stays the same where identical rows are put together; short of 44 bits no sum overflows.
    rest = F.expr("sum(if(l is null, shiftright(line, 20), null)) div count(if(l is null, 1, null))")
    found = (
        rows.join(frequent, same, "left")
        .groupBy("key", "host")
        .agg(
            F.max("total").alias("total"),
            F.coalesce(rest, F.lit(0).cast("long")).alias("rest"),
            F.collect_set(F.when(often, F.struct("line", "n"))).alias("lines"),
        )
        .where(F.size("lines") > 0)
    )
    found = materialize(found, "lines-found").select("key", "host", "total", "rest", F.explode("lines").alias("x"))
    found = found.select("key", "host", "total", "rest", "x.*")
    beside = found.groupBy("host", "line").agg(F.countDistinct("rest").alias("documents"))
    bad = beside.where(F.col("documents") > max_documents).select(F.col("host").alias("h"), F.col("line").alias("l"))
    bad = broadcast_if_small(materialize(bad, "boilerplate-lines"), BROADCAST_LINES)
    return (
        found.join(bad, same)
        .groupBy("key")
        .agg(F.collect_set("line").alias("lines"), F.sum("n").cast("long").alias("n"), F.max("total").alias("total"))
    )


def judge(documents: DataFrame, id_column="doc_id", text_column="text", host_column="source") -> DataFrame:
    """Id, base figures, ``n_boilerplate`` (words of boilerplate lines) and ``kept`` of every row."""
    base = documents.select(
        F.col(id_column), F.col(text_column).alias("__text"), _key(id_column, text_column, host_column).alias("__key")
    )
    base = with_figures(base, "__text").drop("__text")
    gone = boilerplate_in_rows(documents, id_column, text_column, host_column).select(
        F.col("key").alias("__key"), F.col("n").alias("n_boilerplate"), F.col("total").alias("__total")
    )
    return _verdict(base.join(gone, "__key", "left")).drop("__key", "__total")


def _verdict(rows: DataFrame) -> DataFrame:
    left = F.col("__total") - F.col("n_boilerplate")
    depleted = (left < MIN_WORDS_LEFT) | (left < MIN_SHARE_LEFT * F.col("__total"))
    return rows.withColumns(
        {
            "n_boilerplate": F.coalesce("n_boilerplate", F.lit(0).cast("long")),
            "kept": ~F.col("base_failed") & ~F.coalesce(depleted, F.lit(False)),
        }
    )


def clean(documents: DataFrame, id_column="doc_id", text_column="text", host_column="source") -> DataFrame:
    """The kept rows with all their columns, and their texts without boilerplate lines."""
    key = _key(id_column, text_column, host_column)
    base = with_figures(documents.select(F.col(text_column).alias("__text"), key.alias("__key")), "__text")
    gone = boilerplate_in_rows(documents, id_column, text_column, host_column).select(
        F.col("key").alias("__key"), F.col("lines").alias("__lines"), F.col("n").alias("n_boilerplate"),
        F.col("total").alias("__total"),
    )
    verdict = _verdict(base.select("__key", "n_words", "base_failed").join(gone, "__key", "left"))
    # Written first: a condition on the verdict would be copied into every step of its computation.
    verdict = materialize(verdict.select("__key", "kept", "__lines"), "verdicts")
    changed = verdict.where(~F.col("kept") | F.col("__lines").isNotNull()).groupBy("__key").agg(
        F.max("kept").alias("kept"), F.first("__lines").alias("__lines")
    )
    changed = broadcast_if_small(materialize(changed, "rows-to-change"), BROADCAST_LINES)
    names = documents.columns
    rows = documents.select(F.struct(*names).alias("__row"), key.alias("__key")).join(changed, "__key", "left")
    rows = rows.where(F.coalesce("kept", F.lit(True)))
    is_bad = lambda x: F.array_contains("__lines", line_hash(normalised(x)))
    text = F.col("__row")[text_column]
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_bad(x)), "\n")
    text = F.when(F.col("__lines").isNull(), text).otherwise(left)
    return rows.select(*[text.alias(c) if c == text_column else F.col("__row")[c].alias(c) for c in names])
