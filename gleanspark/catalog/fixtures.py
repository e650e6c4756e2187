"""Inputs of the registered queries, derived from the given tables in Spark and in SQL.

Nothing is cut off: every document, every benchmark item and every word takes part.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions.questions import letter_of
from gleanspark.functions.text import ENGLISH_STOPWORDS, words
from gleanspark.operators.bm25 import Bm25Index, build_index
from gleanspark.operators.corpus import MAX_CHUNK_WORDS, explode_chunks
from gleanspark.operators.joins import within
from gleanspark.operators.selection import sample_share, short_key
from gleanspark.runtime import broadcast_if_small, materialize, use_all_cores
from gleanspark.schemas import OPTION_COLUMNS

DEV_SHARE = 0.1
# Chunk ids of an article: its number times this, and up.
PIECE_IDS = 1000


def _cut(articles: DataFrame) -> DataFrame:
    pieces = explode_chunks(articles, ["para_no", "title", "section"])
    return pieces.select(
        (F.col("para_no") * PIECE_IDS + F.col("piece_no")).alias("chunk_id"),
        F.col("para_no").alias("article_id"),
        "title",
        "section",
        F.concat("title", F.lit(": "), "piece").alias("text"),
    )


class Tables:
    """The given tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return use_all_cores(self.read("documents"), "doc_id")

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.read("benchmark")

    @cached_property
    def labels(self) -> DataFrame:
        return self.read("labels")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings")

    @cached_property
    def paragraphs(self) -> DataFrame:
        """Documents as paragraphs of articles named by source and language."""
        return self.documents.select(
            F.col("doc_id").alias("para_no"),
            F.concat_ws("-", "source", "lang").alias("title"),
            F.col("lang").alias("section"),
            "text",
        )

    @cached_property
    def articles(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("para_no"),
            F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
            F.col("source").alias("section"),
            "text",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        return _cut(self.articles)

    def half(self, parity: int) -> DataFrame:
        """One of two half corpora: even or odd articles."""
        return self.chunks.where(F.col("article_id") % 2 == parity)

    def chunks_of(self, wanted: DataFrame) -> DataFrame:
        """The chunks of those articles that can hold the ids of ``wanted(chunk_id)``; no other text is cut.

        Behind its first ``PIECE_IDS`` pieces an article has ids of the range of later ones, so texts long enough for that are cut too.
        """
        owner = F.expr(f"(chunk_id - pmod(chunk_id, {PIECE_IDS})) div {PIECE_IDS}")
        asked = wanted.select(owner.alias("para_no")).distinct().withColumn("__asked", F.lit(True))
        # A word and the blank behind it take two bytes at least.
        long = F.octet_length("text") >= 2 * MAX_CHUNK_WORDS * PIECE_IDS
        able = self.articles.join(broadcast_if_small(asked), "para_no", "left")
        return _cut(able.where(F.col("__asked") | long))

    def half_of(self, parity: int) -> Callable[[DataFrame], DataFrame]:
        """``chunks_of`` for one of the half corpora."""
        return lambda wanted: self.chunks_of(wanted).where(F.col("article_id") % 2 == parity)

    @cached_property
    def index(self) -> Bm25Index:
        return build_index(self.chunks)

    @cached_property
    def option_rows(self) -> DataFrame:
        """``(qid, prompt, option_no, option, answer_no)``; the right option continues the prompt."""
        n = self.benchmark.count()
        w = words("text")
        cut = F.floor((F.size(w) + 1) / 2).cast("int")
        own = self.benchmark.select(
            "item_id",
            F.array_join(F.slice(w, F.lit(1), cut), " ").alias("prompt"),
            F.array_join(F.slice(w, cut + 1, F.size(w)), " ").alias("own"),
        )
        p = F.col("item_id") % 5
        asked = own.select("item_id", "prompt", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("option_no"))
        asked = asked.select(
            F.col("item_id").alias("qid"),
            "prompt",
            "option_no",
            p.alias("answer_no"),
            ((F.col("item_id") + F.pmod(F.col("option_no") - p, F.lit(5))) % n).alias("other"),
        )
        other = own.select(F.col("item_id").alias("other"), F.col("own").alias("option"))
        return asked.join(other, "other").drop("other")

    @cached_property
    def questions(self) -> DataFrame:
        return self.option_rows.groupBy("qid", "prompt").agg(
            *[
                F.max(F.when(F.col("option_no") == i, F.col("option"))).alias(c)
                for i, c in enumerate(OPTION_COLUMNS)
            ],
            letter_of(F.max("answer_no")).alias("answer"),
        )

    @cached_property
    def pool_all(self) -> DataFrame:
        """Documents as question rows: the text is the prompt, its last five words the options."""
        w = words("text")
        options = [F.try_element_at(w, F.lit(i - 5)).alias(c) for i, c in enumerate(OPTION_COLUMNS)]
        return self.documents.select(
            "doc_id",
            F.col("text").alias("prompt"),
            *options,
            letter_of(F.col("doc_id") % 5).alias("answer"),
            "source",
            F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string")).alias("context"),
        )

    @cached_property
    def _labelled(self) -> DataFrame:
        """Ids only, so that the texts stay where they are."""
        return broadcast_if_small(self.labels.select("doc_id"))

    @cached_property
    def gold(self) -> DataFrame:
        return self.pool_all.join(self._labelled, "doc_id", "left_semi")

    @cached_property
    def pool(self) -> DataFrame:
        return self.pool_all.join(self._labelled, "doc_id", "left_anti")

    @cached_property
    def dev(self) -> DataFrame:
        """A seeded share of the pool rows with distinct prompts."""
        first = self.pool.groupBy(short_key("prompt")).agg(F.min("doc_id").alias("doc_id"))
        drawn = sample_share(first.select("doc_id"), "doc_id", DEV_SHARE)
        return self.pool.join(broadcast_if_small(materialize(drawn, "dev-ids")), "doc_id", "left_semi")

    def logits(self, arm: int) -> DataFrame:
        base = (F.col("qid") * 7919 + F.col("option_no") * 104729 + arm * 1299709) % 1000
        lift = F.when(
            (F.col("option_no") == F.col("answer_no")) & ((F.col("qid") * 31 + arm) % 3 != 0), 0.6
        ).otherwise(0.0)
        return self.option_rows.select(
            F.lit(f"r{arm}").alias("arm"),
            "qid",
            "option_no",
            (base.cast("double") / 1000.0 + lift).alias("logit"),
        )

    @cached_property
    def both_logits(self) -> DataFrame:
        return self.logits(0).unionByName(self.logits(1))

    @cached_property
    def answers(self) -> DataFrame:
        return self.benchmark.select(
            F.col("item_id").alias("qid"), letter_of(F.col("item_id") % 5).alias("answer")
        )

    @cached_property
    def arc_raw(self) -> DataFrame:
        """Five options; labels are letters or digits; every seventh key is unknown."""
        texts = F.array(*[F.col(c) for c in OPTION_COLUMNS])
        position = F.instr(F.lit("ABCDE"), F.col("answer"))
        odd = F.col("qid") % 2 == 1
        key = F.when(odd, position.cast("string")).otherwise(F.col("answer"))
        labels = F.when(odd, F.array(*[F.lit(str(i)) for i in range(1, 6)])).otherwise(
            F.array(*[F.lit(c) for c in OPTION_COLUMNS])
        )
        return self.questions.select(
            F.col("qid").alias("id"),
            F.col("prompt").alias("question"),
            F.when(F.col("qid") % 7 == 0, "?").otherwise(key).alias("answerKey"),
            F.struct(labels.alias("label"), texts.alias("text")).alias("choices"),
        )

    @cached_property
    def mmlu_raw(self) -> DataFrame:
        """Four or five choices; one subject in three is outside STEM."""
        subject = F.element_at(
            F.array(F.lit("astronomy"), F.lit("law"), F.lit("anatomy")), (F.col("qid") % 3 + 1).cast("int")
        )
        options = F.array(*[F.col(c) for c in OPTION_COLUMNS])
        answer = F.instr(F.lit("ABCDE"), F.col("answer")) - 1
        return self.questions.select(
            F.col("qid").alias("row_no"),
            F.col("prompt").alias("question"),
            subject.alias("subject"),
            F.when((F.col("qid") % 2 == 0) | (answer == 4), options)
            .otherwise(F.slice(options, 1, 4))
            .alias("choices"),
            answer.cast("int").alias("answer"),
        )

    def within_labels(self, rows: DataFrame) -> DataFrame:
        return within(rows, self.labels, ["doc_id"])


BLANK_SQL = (
    r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
STOP_SQL = ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS)


def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{BLANK_SQL}]+')"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{BLANK_SQL}]+|[{BLANK_SQL}]+$', '', 'g')"


def collapse_sql(text: str) -> str:
    return strip_sql(f"regexp_replace(lower({text}), '[{BLANK_SQL}]+', ' ', 'g')")


def tokens_sql(text: str) -> str:
    return (
        rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), "
        f"lambda t: t NOT IN ({STOP_SQL}))"
    )


def keywords_sql(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[A-Za-z]{{5,}}'))"


OPTION_LIST_SQL = "['A', 'B', 'C', 'D', 'E']"

# name: (names it builds on, body)
VIEWS: dict[str, tuple[list[str], str]] = {
    "doc_words": ([], f"SELECT *, {words_sql('text')} AS w FROM documents"),
    "paragraphs": (
        [],
        "SELECT doc_id AS para_no, source || '-' || lang AS title, lang AS section, text FROM documents",
    ),
    "chunks": (
        ["doc_words"],
        "SELECT doc_id * 1000 + i AS chunk_id, doc_id AS article_id, 'doc ' || doc_id AS title, "
        "source AS section, i AS piece_no, 'doc ' || doc_id || ': ' || CASE WHEN len(w) <= 200 THEN text "
        "ELSE array_to_string(w[i * 200 + 1 : i * 200 + 200], ' ') END AS text "
        "FROM doc_words, unnest(range(0, greatest(1, (len(w) + 199) // 200))) u(i)",
    ),
    "own": (
        [],
        f"SELECT item_id, array_to_string(w[1 : (len(w) + 1) // 2], ' ') AS prompt, "
        "array_to_string(w[(len(w) + 1) // 2 + 1 : len(w)], ' ') AS own, (SELECT count(*) FROM benchmark) AS n "
        f"FROM (SELECT item_id, {words_sql('text')} AS w FROM benchmark)",
    ),
    "option_rows": (
        ["own"],
        "SELECT a.item_id AS qid, a.prompt, i AS option_no, o.own AS option, a.item_id % 5 AS answer_no "
        "FROM own a, unnest(range(0, 5)) u(i), own o "
        "WHERE o.item_id = (a.item_id + ((i - a.item_id % 5 + 5) % 5)) % a.n",
    ),
    "questions": (
        ["option_rows"],
        "SELECT qid, prompt, "
        + ", ".join(f"max(option) FILTER (option_no = {i}) AS {c}" for i, c in enumerate("ABCDE"))
        + ", chr(65 + CAST(max(answer_no) AS INTEGER)) AS answer FROM option_rows GROUP BY qid, prompt",
    ),
    "pool_all": (
        ["doc_words"],
        "SELECT doc_id, text AS prompt, "
        + ", ".join(f"CASE WHEN len(w) >= {5 - i} THEN w[len(w) - {4 - i}] END AS {c}" for i, c in enumerate("ABCDE"))
        + ", chr(65 + CAST(doc_id % 5 AS INTEGER)) AS answer, source, "
        "source || ' ' || lang || ' ' || doc_id AS context FROM doc_words",
    ),
    "gold": (["pool_all"], "SELECT * FROM pool_all WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "pool": (["pool_all"], "SELECT * FROM pool_all WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "dev": (
        ["pool"],
        "SELECT * FROM pool WHERE doc_id IN (SELECT min(doc_id) FROM pool GROUP BY prompt) "
        f"AND CAST(('0x' || substr(md5('42|' || doc_id), 1, 13)) AS BIGINT) < {DEV_SHARE} * CAST(16 AS DOUBLE) ** 13",
    ),
    "logits": (
        ["option_rows"],
        "SELECT 'r' || arm AS arm, qid, option_no, "
        "CAST((qid * 7919 + option_no * 104729 + arm * 1299709) % 1000 AS DOUBLE) / 1000.0 "
        "+ CASE WHEN option_no = answer_no AND (qid * 31 + arm) % 3 <> 0 THEN CAST(0.6 AS DOUBLE) "
        "ELSE CAST(0 AS DOUBLE) END AS logit FROM option_rows, unnest(range(0, 2)) v(arm)",
    ),
    "answers": ([], "SELECT item_id AS qid, chr(65 + CAST(item_id % 5 AS INTEGER)) AS answer FROM benchmark"),
    # Every option order of both readers as a list of letters, and AP@3.
    "letters": (
        ["logits"],
        "SELECT arm, qid, list(chr(65 + CAST(option_no AS INTEGER)) ORDER BY logit DESC, option_no) AS letters "
        "FROM logits GROUP BY arm, qid",
    ),
    "scores": (
        ["letters", "answers"],
        "SELECT arm, qid, CASE WHEN list_position(letters[1:3], answer) > 0 "
        "THEN CAST(1 AS DOUBLE) / list_position(letters[1:3], answer) ELSE 0 END AS score "
        "FROM letters JOIN answers USING (qid)",
    ),
    "wanted": (
        ["option_rows"],
        "SELECT qid, list_filter(max(own_words), lambda k: NOT list_contains(flatten(list(other_words)), k)) AS wanted "
        "FROM (SELECT qid, "
        f"CASE WHEN option_no = answer_no THEN {keywords_sql('option')} END AS own_words, "
        f"CASE WHEN option_no <> answer_no THEN {keywords_sql('option')} ELSE [] END AS other_words "
        "FROM option_rows) GROUP BY qid",
    ),
    "queries": (
        ["questions"],
        "SELECT qid, prompt || ' ' || A || ' ' || B || ' ' || C || ' ' || D || ' ' || E AS query FROM questions",
    ),
}


def bm25_sql(prefix: str, chunks: str, queries: str, keys: str, k: int) -> dict[str, tuple[list[str], str]]:
    """Views ``{prefix}_ranked(keys…, rank, chunk_id, score)`` for a search over ``chunks``."""
    on = keys.split(", ")[0]
    return {
        f"{prefix}_tok": (
            [chunks],
            f"SELECT chunk_id, unnest({tokens_sql('text')}) AS term FROM {chunks}",
        ),
        f"{prefix}_tf": ([f"{prefix}_tok"], f"SELECT chunk_id, term, count(*) AS tf FROM {prefix}_tok GROUP BY ALL"),
        f"{prefix}_dl": ([f"{prefix}_tok"], f"SELECT chunk_id, count(*) AS dl FROM {prefix}_tok GROUP BY ALL"),
        f"{prefix}_df": ([f"{prefix}_tf"], f"SELECT term, count(*) AS df FROM {prefix}_tf GROUP BY ALL"),
        f"{prefix}_n": (
            [f"{prefix}_tok", chunks],
            f"SELECT (SELECT count(*) FROM {chunks}) AS n, (SELECT count(*) FROM {prefix}_tok) AS total",
        ),
        f"{prefix}_qt": (
            [queries],
            f"SELECT {keys}, term, count(*) AS qtf FROM (SELECT {keys}, unnest({tokens_sql('query')}) AS term "
            f"FROM {queries}) GROUP BY ALL",
        ),
        f"{prefix}_scored": (
            [f"{prefix}_tf", f"{prefix}_dl", f"{prefix}_df", f"{prefix}_n", f"{prefix}_qt"],
            f"SELECT {keys}, chunk_id, sum(CAST(qtf AS DOUBLE) * ln(1 + (CAST(n AS DOUBLE) - df + 0.5) / (df + 0.5)) "
            "* tf / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / (CAST(total AS DOUBLE) / n)))) AS score "
            f"FROM {prefix}_qt JOIN {prefix}_df USING (term) JOIN {prefix}_tf USING (term) "
            f"JOIN {prefix}_dl USING (chunk_id), {prefix}_n GROUP BY ALL",
        ),
        f"{prefix}_ranked": (
            [f"{prefix}_scored"],
            f"SELECT * FROM (SELECT {keys}, row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY round(score, 9) DESC, chunk_id) AS rank, chunk_id, score FROM {prefix}_scored) WHERE rank <= {k}",
        ),
    }


def sql(body: str, *needs: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """A statement with the views it needs, and theirs, in front."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in known:
            return
        for parent in known[name][0]:
            visit(parent)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    views = ",\n".join(f"{name} AS MATERIALIZED ({known[name][1]})" for name in order)
    return f"WITH {views}\n{body}"
