"""Question rows: option arrays, query texts, reader layouts, answers, predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanspark.functions.text import _column, keywords, let
from gleanspark.schemas import OPTION_COLUMNS

LETTERS = "ABCDE"


def options_array(columns: Sequence[str] = OPTION_COLUMNS) -> Column:
    return F.array(*[F.col(c) for c in columns])


def padded_option(options: Column | str, position: int) -> Column:
    """Option at a 0-based position, or an empty text where the array is shorter."""
    return F.coalesce(F.get(_column(options), F.lit(position)), F.lit(""))


def letter_of(position: Column) -> Column:
    """0-based position to letter."""
    return F.char(F.lit(ord("A")) + position)


def position_of(letter: Column | str) -> Column:
    """Letter to 0-based position; -1 when it is not one of the option letters."""
    return F.when(F.length(_column(letter)) == 1, F.instr(F.lit(LETTERS), _column(letter)) - 1).otherwise(-1)


def pooled_query(prompt: Column | str, options: Column | str) -> Column:
    """One query per question: the prompt and every option."""
    return F.concat(_column(prompt), F.lit(" "), F.array_join(_column(options), " "))


def option_query(prompt: Column | str, option: Column | str) -> Column:
    return F.concat(_column(prompt), F.lit(" "), _column(option))


def clip(text: Column | str, chars: int) -> Column:
    return F.substring(_column(text), 1, chars)


def layout_pair(context: Column | str, prompt: Column | str, option: Column | str) -> list[Column]:
    """Context first, prompt with one option second."""
    return [_column(context).alias("first"), option_query(prompt, option).alias("second")]


def layout_inference(
    context: Column | str, prompt: Column | str, option: Column | str, chars: int = 1750
) -> list[Column]:
    """Clipped context and prompt first, the option alone second."""
    first = F.concat(clip(context, chars), F.lit(" #### "), _column(prompt))
    return [first.alias("first"), _column(option).alias("second")]


def layout_training(context: Column | str, prompt: Column | str, option: Column | str) -> list[Column]:
    """The marked-up layout: markers are part of the text."""
    first = F.concat(F.lit("[CLS] "), _column(context))
    second = F.concat(
        F.lit(" #### "), _column(prompt), F.lit(" [SEP] "), _column(option), F.lit(" [SEP]")
    )
    return [first.alias("first"), second.alias("second")]


def distinctive_keywords(options: Column | str, answer_position: Column) -> Column:
    """Keywords of the right option that no other option has."""
    options = _column(options)
    right = keywords(F.coalesce(F.get(options, answer_position), F.lit("")))
    wrong = F.transform(
        F.filter(options, lambda o, i: (i != answer_position) & o.isNotNull()), keywords
    )
    return F.array_except(right, F.flatten(wrong))


def support_hit(text: Column | str, wanted: Column | str) -> Column:
    """True when the lowercased text contains any wanted keyword; no keyword, no hit."""
    wanted = _column(wanted)
    found = let(F.lower(_column(text)), lambda low: F.exists(wanted, lambda w: F.contains(low, w)))
    return F.coalesce(found, F.lit(False))


def prediction_text(letters: Column | str, k: int = 3) -> Column:
    return F.array_join(F.slice(_column(letters), 1, k), " ")
