"""From paragraphs or articles to title-prefixed chunks with dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.text import title_prefixed, window_count, windows
from gleanspark.operators.ordering import running_total
from gleanspark.operators.selection import first_rows

MAX_CHUNK_WORDS = 200


def article_ids(rows: DataFrame, order: str, title: str = "title") -> DataFrame:
    """``(title, article_id)``: 0, 1, 2 … by first appearance."""
    first = rows.groupBy(title).agg(F.min(order).alias("__first"))
    return running_total(first, "__first", None, "article_id").drop("__first")


def explode_chunks(
    rows: DataFrame, keep: list[str], text: str = "text", max_words: int = MAX_CHUNK_WORDS
) -> DataFrame:
    """One row per chunk with its 0-based ``piece_no`` within the source row."""
    pieces = F.posexplode(windows(text, max_words)).alias("piece_no", "piece")
    return rows.select(*keep, pieces)


def chunk_paragraphs(
    paragraphs: DataFrame, order: str = "para_no", max_words: int = MAX_CHUNK_WORDS
) -> DataFrame:
    """Chunks with ids: ``chunk_id`` counts chunks in input order, ``article_id`` titles.

    The titles table joins last. A title that owns a large share of the rows is
    split by the adaptive skew join, since the titles side has one row each.
    """
    placed = running_total(
        paragraphs.select(order, "title", "section", "text"), order, window_count("text", max_words)
    )
    pieces = explode_chunks(placed, ["offset", "title", "section"], "text", max_words)
    return pieces.join(article_ids(paragraphs, order), "title").select(
        (F.col("offset") + F.col("piece_no")).alias("chunk_id"),
        "article_id",
        "title",
        "section",
        title_prefixed("title", "piece").alias("text"),
    )


def chunk_articles(
    articles: DataFrame, order: str, max_words: int = MAX_CHUNK_WORDS
) -> DataFrame:
    """The paragraph chunker over whole articles; blank articles are left out."""
    filled = articles.where(F.length("text") > 0).withColumn("section", F.lit(""))
    return chunk_paragraphs(filled, order, max_words)


def slice_by_article_count(rows: DataFrame, n_articles: int, order: str = "para_no") -> DataFrame:
    """Rows in front of the first row of the (n+1)-th new title.

    Late repeats of a kept title behind that row are left out as well.
    """
    first = rows.groupBy("title").agg(F.min(order).alias("__first"))
    cut = first_rows(first, ["__first"], n_articles + 1).agg(
        F.max("__first").alias("last"), F.count(F.lit(1)).alias("n")
    ).first()
    if cut["n"] <= n_articles:
        return rows
    return rows.where(F.col(order) < cut["last"])
