"""Explicit schemas of the tables the toolkit reads and writes."""

from pyspark.sql import types as T

OPTION_COLUMNS = ["A", "B", "C", "D", "E"]
QUESTION_KEY = ["prompt", *OPTION_COLUMNS, "answer"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_STRINGS = T.ArrayType(_S)

PARAGRAPHS = _struct(para_no=_L, title=_S, section=_S, text=_S)
ARTICLES = _struct(id=_S, title=_S, text=_S, categories=_STRINGS)
CHUNKS = _struct(chunk_id=_L, article_id=_L, title=_S, section=_S, text=_S)
QUESTIONS = _struct(**{name: _S for name in QUESTION_KEY})
QUESTIONS_WITH_CONTEXT = T.StructType([*QUESTIONS.fields, *_struct(context=_S, source=_I).fields])
OOD_QUESTIONS = _struct(id=_S, source=_S, subject=_S, question=_S, options=_STRINGS, answer=_S)
RAW_ARC = _struct(id=_S, question=_S, answerKey=_S, choices=_struct(label=_STRINGS, text=_STRINGS))
RAW_MMLU = _struct(row_no=_L, question=_S, subject=_S, choices=_STRINGS, answer=_I)
RANKED = _struct(qid=_L, rank=_L, chunk_id=_L, score=_D)
LOGITS = _struct(qid=_L, option_no=_I, logit=_D)
SCORES = _struct(arm=_S, qid=_L, score=_D)
SUBMISSION = _struct(id=_L, prediction=_S)

# The column order of the run log.
LOG_FIELDS = [
    "date",
    "git_sha",
    "config",
    "tier",
    "n",
    "map3_mean",
    "map3_ci_lower",
    "map3_ci_upper",
    "random_baseline",
    "train_seconds",
    "eval_seconds",
    "hypothesis",
    "notes",
]
EXPERIMENT_LOG = _struct(**{name: _S for name in LOG_FIELDS})

# The columns of the prediction / outcome log.
OUTCOME_LOG = _struct(
    date=_S, git_sha=_S, config=_S, predicted=_S, public=_D, private=_D, notes=_S
)
