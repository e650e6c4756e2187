"""Personal data by patterns, and terms that give it away, in DataFrame functions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the
protected entities. The corpus then tells
how much a term says about an entity. With N distinct texts, df texts that hold
the entity or the term, and c texts that hold both,

    PMI(term, entity) = log(N * c / (df(term) * df(entity)))
    IC(entity)        = log(N / df(entity))

and the term discloses the share PMI / IC of the entity's information. Terms at
``DISCLOSURE`` or above are generalised wherever they stand in a text that
holds the entity: a reader who has the term would know who is meant.

A share needs evidence: term and entity must stand together in ``MIN_CONTEXTS``
different contexts. A context is the text without the lines that hold the entity
(the whole text if nothing else is left): a copied page, signed by the
same line or not, is one context. Terms of the whole text are looked at, on
any line and at any distance.

Positions are found by marking each match with two control characters and
summing the lengths of the parts between them; those two characters stand for a
third one where a text holds them already, which no pattern contains.

Defined results: a null text counts as empty, and has no spans. Identical rows
get the same answer, as do rows with null ids; texts count once in the
statistics however often they are repeated. Spans of different kinds may
overlap. An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.runtime import broadcast_if_small, materialize

#: Kinds in their order; the last is the method's own.
KINDS = ["email", "ip", "card", "phone", "term"]
TERM = len(KINDS) - 1

#: Share of an entity's information that a term may disclose.
DISCLOSURE = 0.8
#: Different contexts in which a term must stand with an entity.
MIN_CONTEXTS = 3
MIN_TERM = 3
# The part of the texts that common words are told by: one in so many.
PARTS = 8
BROADCAST_PAIRS = 1_000_000

# The patterns of the base kinds, with possessive groups and look-behinds, which match
# the same text and take time in proportion to its length: no match can begin inside a
# run of characters whose beginning has failed.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9]){11}(?:[\x20-]?[0-9])*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip_is_good(match: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

    return F.forall(F.split(match, r"\."), small)


def _card_is_good(match: Column) -> Column:
    digits = F.reverse(_digits(match))
    n = F.length(digits)

    def worth(i: Column) -> Column:
        digit = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        return F.when(i % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i))
    return (n <= 19) & (total % 10 == 0)


def _phone_is_good(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


# Kind → pattern, what a text must hold for it, and the test of a match.
RULES = {
    "email": (_EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (_IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _ip_is_good),
    "card": (_CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _card_is_good),
    "phone": (_PHONE, lambda t: F.contains(t, F.lit("+")), _phone_is_good),
}
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _places(text: Column, pattern: str, kind: int, wanted) -> Column:
    """Spans of the matches of ``pattern`` for which ``wanted(match)`` holds."""
    marked = F.regexp_replace(F.translate(text, "\u0001\u0002", "\u0003\u0003"), pattern, "\u0001$0\u0002")
    # Each part behind a first mark is a match, what is behind the second mark lies between.
    parts = F.split(marked, "[\u0001\u0002]")
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("found"))

    def step(acc: Column, part: Column, is_match: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        held = F.coalesce(acc["found"], F.array().cast(SPAN))
        found = F.when(is_match & wanted(part), F.concat(held, F.array(span))).otherwise(held)
        return F.struct(end.alias("at"), found.alias("found"))

    numbered = F.transform(parts, lambda x, i: F.struct(x.alias("x"), (i % 2 == 1).alias("hit")))
    return F.aggregate(numbered, start, lambda acc, p: step(acc, p["x"], p["hit"]))["found"]


def base_spans(text: Column) -> Column:
    """All spans of the base kinds, by start and kind."""
    none = F.array().cast(SPAN)
    each = [
        F.when(asks(text), _places(text, pattern, KINDS.index(kind), good)).otherwise(none)
        for kind, (pattern, asks, good) in RULES.items()
    ]
    return F.array_sort(F.concat(*[F.coalesce(x, none) for x in each]))


def written(spans: Column) -> Column:
    def one(s: Column) -> Column:
        name = reduce(lambda rest, k: F.when(s["kind"] == k, KINDS[k]).otherwise(rest), range(TERM), F.lit(KINDS[TERM]))
        return F.concat_ws(":", name, s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def terms_in(text: Column) -> Column:
    """Distinct lower-case runs of letters, the short ones left out."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\P{L}+"), lambda x: F.length(x) >= MIN_TERM))


def _entities(spotted: DataFrame) -> DataFrame:
    """(tkey, entity, context): each protected value of a text, and a digest of the lines that do not hold it."""
    rows = spotted.select("tkey", "text", F.explode("spans").alias("s"))
    value = F.lower(F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")))
    entity = F.xxhash64("s.kind", value)
    rows = rows.select("tkey", "text", value.alias("value"), entity.alias("entity")).dropDuplicates(["tkey", "entity"])
    others = F.filter(F.split("text", "\n"), lambda x: ~F.contains(F.lower(x), F.col("value")))
    rest = F.array_join(others, "\n")
    return rows.select("tkey", "entity", F.xxhash64(F.when(rest.rlike(r"\S"), rest).otherwise(F.col("text"))).alias("context"))


def _hashed_terms(text: Column) -> Column:
    return F.transform(terms_in(text), lambda x: F.xxhash64(x))


def disclosing_terms(documents: DataFrame, spotted: DataFrame, entities: DataFrame, text_column="text") -> DataFrame:
    """(entity, term, disclosure) at or above the threshold; entities and terms by their hashes."""
    held = entities.groupBy("entity").agg(
        F.count(F.lit(1)).alias("df_entity"), F.countDistinct("context").alias("contexts")
    )
    held = materialize(held.where(F.col("contexts") >= MIN_CONTEXTS).select("entity", "df_entity"), "entities-often")
    able = entities.join(broadcast_if_small(held.select("entity"), BROADCAST_PAIRS), "entity")
    terms = spotted.select("tkey", _hashed_terms(F.col("text")).alias("terms"))
    rows = able.join(terms, "tkey").select("entity", "context", F.explode("terms").alias("term"))
    # Texts of one context are counted together before contexts are.
    both = (
        rows.groupBy("entity", "term", "context")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("contexts"))
        .where(F.col("contexts") >= MIN_CONTEXTS)
        .select("entity", "term", "c")
    )
    # A term stands in as many texts at least as it stands with this entity in. Pairs that would
    # stay under the threshold with the texts that hold any entity have no need of a count over the corpus.
    around = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    texts = documents.select(F.col(text_column).alias("text")).where("text is not null")
    total = texts.agg(F.countDistinct(F.xxhash64("text")).alias("n"))
    pmi = F.log(F.col("n") * F.col("c") / (F.col("df_term") * F.col("df_entity")))
    information = F.log(F.col("n") / F.col("df_entity"))

    def shares(pairs: DataFrame) -> DataFrame:
        """The pairs, joined with ``df_term``, that disclose enough."""
        return (
            pairs.crossJoin(F.broadcast(total))  # one row
            .where(information > 0)
            .withColumn("disclosure", pmi / information)
            .where(F.col("disclosure") >= DISCLOSURE)
        )

    both = shares(both.join(around, "term").join(held, "entity")).select("entity", "term", "c", "df_entity")

    def counted(some: DataFrame, pairs: DataFrame) -> DataFrame:
        wanted = broadcast_if_small(pairs.select("term").distinct(), BROADCAST_PAIRS)
        found = some.select("t", F.explode(_hashed_terms(F.col("text"))).alias("term")).join(wanted, "term")
        return found.groupBy("term").agg(F.countDistinct("t").alias("df_term"))

    # Common words go by a count of one part in ``PARTS`` of the texts, which they exceed already; those that are left are
    # counted in all texts.
    both = materialize(both, "with-entities")
    texts = texts.withColumn("t", F.xxhash64("text"))
    at_least = counted(texts.where(F.pmod("t", F.lit(PARTS)) == 0), both)
    rest = both.join(at_least, "term", "left").withColumn("df_term", F.greatest(F.coalesce("df_term", F.lit(0)), "c"))
    rest = materialize(shares(rest).select("entity", "term", "c", "df_entity"), "rare-with-entities")
    return shares(rest.join(counted(texts, rest), "term")).select("entity", "term", "disclosure")


def find(documents: DataFrame, id_column="doc_id", text_column="text", keep: list[str] | None = None) -> DataFrame:
    """``__spans`` of every row, ``__base`` of them the base kinds', its text, and its columns in ``__row``."""
    columns = list(dict.fromkeys([id_column, *(keep or [])]))
    full = F.coalesce(F.col(text_column), F.lit(""))
    tkey = F.unhex(F.md5(full.cast("binary")))
    spotted = (
        documents.select(full.alias("text"))
        .where(F.contains("text", F.lit("@")) | F.col("text").rlike(r"[0-9](?:[^0-9]*+[0-9]){3}"))
        .select("text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("tkey"), base_spans(F.col("text")).alias("spans"))
        .where(F.size("spans") > 0)
        .dropDuplicates(["tkey"])
    )
    spotted = materialize(spotted, "texts-with-entities")
    entities = materialize(_entities(spotted), "entities")
    pairs = materialize(disclosing_terms(documents, spotted, entities, text_column), "disclosing-terms")
    given = (
        entities.select("tkey", "entity")
        .join(broadcast_if_small(pairs.select("entity", "term"), BROADCAST_PAIRS), "entity")
        .groupBy("tkey")
        .agg(F.collect_set("term").alias("__terms"))
    )
    given = materialize(given, "terms-given")
    values = given.agg(F.sum(F.size("__terms"))).first()[0] or 0
    rows = documents.select(
        F.struct(*columns).alias("__row"), full.alias("__text"), tkey.alias("tkey"), base_spans(full).alias("__base"),
    )
    rows = rows.join(F.broadcast(given) if values <= BROADCAST_PAIRS else given, "tkey", "left")
    wanted = lambda m: F.array_contains("__terms", F.xxhash64(F.lower(m)))
    own = F.when(F.col("__terms").isNotNull(), _places(F.col("__text"), r"\p{L}+", TERM, wanted))
    rows = rows.withColumn("__own", F.coalesce(own, F.array().cast(SPAN)))
    # A term inside an entity needs no span of its own.
    outside = F.filter(
        "__own", lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    spans = F.array_sort(F.concat("__base", outside))
    return rows.select("__row", "__text", "__base", spans.alias("__spans"))


def digests(documents: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """Counts of each base kind, a digest of the base spans, all spans as text and their number."""
    rows = find(documents, id_column, text_column)
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        F.col("__row")[id_column].alias(id_column),
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(TERM)],
        F.sha2(written(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("__spans")).alias("spans"),
        F.size("__spans").cast("long").alias("n_spans"),
    )


def sanitise(documents: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """All rows and columns; in the texts every span is replaced by its kind in brackets."""
    rows = find(documents, id_column, text_column, documents.columns)

    def step(acc: Column, s: Column) -> Column:
        name = reduce(lambda rest, k: F.when(s["kind"] == k, KINDS[k].upper()).otherwise(rest), range(TERM), F.lit("TERM"))
        # What an earlier span has covered is not written again.
        before = F.substring("__text", acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        tag = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), name, F.lit("]"))).otherwise("")
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["text"], before, tag).alias("text")
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    done = F.aggregate("__spans", start, step)
    rest = F.substring(F.col("__text"), done["at"] + 1, F.length("__text"))
    own = F.col("__row")
    text = F.when(F.size("__spans") == 0, own[text_column]).otherwise(F.concat(done["text"], rest))
    return rows.select(*[text.alias(c) if c == text_column else own[c].alias(c) for c in documents.columns])
