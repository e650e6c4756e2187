"""Byte-level BPE by a sentencepiece model that is serialised from the vocabulary.

The model file is a protocol buffer with one piece per vocabulary entry. A
piece spells the entry's bytes as characters (byte ``b`` is ``chr(256 + b)``),
its score is the negative rank, and normalisation is the identity. The best
score first is then the lowest rank first, which is the merge order of the
ranks. Text is cut into pre-tokens by the pattern, each is encoded by the
model, and ids are decoded by the inverse mapping of the pieces.

Defined results: a null or empty text has no ids; every other text is encoded
whole, whatever its length. Repeated rows are encoded again, each by itself;
columns other than the id and the text are not read; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from gleanspark.llm.arrow import map_columns

# Distinct pre-tokens whose ids are kept in a worker; the store is emptied when it is full.
KEPT_TOKENS = 300_000
# Pre-tokens longer than this are never kept.
KEPT_LENGTH = 64
#: Character that stands for byte b is chr(BYTE_BASE + b).
BYTE_BASE = 0x100
BYTE_TABLE = {b: chr(BYTE_BASE + b) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes → rank of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def spell(data: bytes) -> str:
    return data.decode("latin-1").translate(BYTE_TABLE)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: pieces by rank (so that a piece's id is its rank), then ``<unk>``.

    Ranks must be 0, 1, 2, … without gaps.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        score = struct.pack("<f", -float(rank))
        piece = _message(1, spell(token).encode()) + _varint(2 << 3 | 5) + score + _number(3, normal)
        out += _message(1, piece)
    out += _message(1, _message(1, b"<unk>") + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
    # Identity: no dummy prefix, no removal and no escaping of white space.
    normalizer = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out) + _message(2, trainer) + _message(3, normalizer)


@lru_cache(maxsize=4)
def _codec(path: str):
    import sentencepiece

    ranks = read_ranks(path)
    processor = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
    tokens = sorted(ranks, key=ranks.__getitem__)
    # A pre-token that is an entry itself is that entry, also where merging by rank would not reach it.
    whole = {
        spell(t): [i]
        for i, (t, ids) in enumerate(zip(tokens, processor.encode([spell(t) for t in tokens])))
        if ids != [i]
    }
    return processor, tokens, whole


@lru_cache(maxsize=4)
def split_patterns(pattern: str) -> tuple[str, str, str]:
    """``pattern``, the same with its letter and number classes as the tiktoken
    library knows them, and the characters on which the two differ.

    The two regular-expression libraries may follow different versions of
    Unicode. A text with none of those characters is split by the plain pattern.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    exact, differing = pattern, ""
    for name in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(probe.decode(probe.encode_ordinary(every)))
        ours = set(regex.findall(name, every))
        added, dropped = _ranges(theirs - ours), _ranges(ours - theirs)
        if added or dropped:
            own = f"[{name}{added}]"
            exact = exact.replace(name, f"[{own}--[{dropped}]]" if dropped else own)
            differing += added + dropped
    return pattern, "(?V1)" + exact, f"[{differing}]" if differing else ""


def _ranges(characters: set[str]) -> str:
    """The characters as ranges of a set."""
    out: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last in out)


class Coder:
    """Encoder and decoder of one task; pre-tokens seen before are looked up."""

    def __init__(self, path: str, patterns: tuple[str, str, str]):
        self.processor, self.tokens, self.whole = _codec(path)
        self.plain, self.exact = regex.compile(patterns[0]).findall, regex.compile(patterns[1]).findall
        self.differing = regex.compile(patterns[2]).search if patterns[2] else None
        self.kept: dict[str, list[int]] = {}

    def ids_of(self, pre_token: str) -> list[int]:
        spelled = spell(pre_token.encode())
        ids = self.whole.get(spelled) or self.processor.encode(spelled)
        if len(pre_token) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_TOKENS:
                self.kept.clear()
            self.kept[pre_token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known, extend, find = self.kept.get, out.extend, self.ids_of
        text = text or ""
        split = self.exact if self.differing and not text.isascii() and self.differing(text) else self.plain
        for token in split(text):
            extend(known(token) or find(token))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def coder_of(path: str, patterns: tuple[str, str, str]) -> Coder:
    """One coder for all tasks that a Python worker runs."""
    return Coder(path, patterns)


def encode(documents: DataFrame, path: str, pattern: str, id_column="doc_id", text_column="text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    own = split_patterns(pattern)

    def make():
        coder = coder_of(path, own)
        return lambda keys, texts: [keys, [coder.encode(x) for x in texts.to_pylist()]]

    kind = documents.schema[id_column].dataType.simpleString()
    return map_columns(documents, [id_column, text_column], f"`{id_column}` {kind}, ids array<int>", make)


def decode(encoded: DataFrame, path: str, id_column="doc_id", ids_column="ids") -> DataFrame:
    """(id, data binary) of every row of ids."""

    def make():
        tokens = _codec(path)[1]
        return lambda keys, ids: [keys, [b"".join(map(tokens.__getitem__, x or ())) for x in ids.to_pylist()]]

    kind = encoded.schema[id_column].dataType.simpleString()
    return map_columns(encoded, [id_column, ids_column], f"`{id_column}` {kind}, data binary", make)


def digests(documents: DataFrame, path: str, pattern: str, id_column="doc_id", text_column="text") -> DataFrame:
    """Per row: number of ids, and digests of the ids and of the bytes decoded from them.

    The same coder as ``encode`` and ``decode`` in one pass, without moving the ids out of the worker.
    """
    own = split_patterns(pattern)

    def make():
        coder = coder_of(path, own)
        decimal = [str(i) for i in range(len(coder.tokens))]

        def step(keys, texts):
            counts, ids_hash, data_hash = [], [], []
            for text in texts.to_pylist():
                ids = coder.encode(text)
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                data_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            return [keys, counts, ids_hash, data_hash]

        return step

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_columns(documents, [id_column, text_column], schema, make)
