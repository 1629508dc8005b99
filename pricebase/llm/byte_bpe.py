"""Byte-level BPE encoding and decoding over Arrow batches, with the tokenizers library's BPE model.

A text is split by the vocabulary's pattern; the bytes of a piece are mapped to printable characters and merged by
``tokenizers.models.BPE``. Rank files become merges by replaying, for every token, the merges of its own bytes. Pieces
recur, so each worker remembers a bounded number of them; text between single spaces is looked up as a whole.

Characters that Unicode versions classify differently are asked of the library whose splits are to be matched
(``letter_or_number``) and stand in the pattern as a character of that class.

Decoding reverses the byte table; a character split between tokens is whole again once their bytes are joined, and a
part of one alone becomes U+FFFD in text. Offsets count characters: a token that holds part of a character covers it.

Defined results: a null text is empty and has no ids; null ids or elements decode to no bytes; an id outside the vocabulary
decodes to U+FFFD; texts are never cut; repeated rows are encoded separately; further columns pass through unread, and are
replaced if they are named like an added one.
"""

from __future__ import annotations

import base64
import functools
import string
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer, models

from pricebase.llm.common import prepared

#: Remembered pieces (and space-separated chunks) of a worker, and the longest one remembered.
REMEMBERED, LONGEST = 340_000, 40
_REPLACEMENT = "�".encode()


def byte_characters() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_TO_CHARACTERS = {b: c for b, c in byte_characters().items()}
_TO_BYTES = {c: b for b, c in _TO_CHARACTERS.items()}
_LATIN = str.maketrans({chr(b): c for b, c in _TO_CHARACTERS.items()})


def as_characters(piece: bytes) -> str:
    return piece.decode("latin-1").translate(_LATIN)


def as_bytes(token: str) -> bytes:
    return bytes(_TO_BYTES[c] for c in token)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """The pair that makes each token of two bytes or more, in rank order: its own bytes merged until two parts are left."""
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in ranks]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:  # others are found whole only
            merges.append((as_characters(parts[0]), as_characters(parts[1])))
    return merges


class _Remembered(dict):
    """Two generations: what the older one is still asked for moves on when the younger is full."""

    def __init__(self, make: Callable[[str], bytes]):
        self._make, self._older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= LONGEST and "\n" not in key:
            if len(self) >= REMEMBERED:
                self._older.clear()  # before the copy takes its place
                self._older = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self._older = {}


#: ASCII marks that are neither letter nor number and begin no contraction: after a word they are one piece.
_MARKS = string.punctuation.replace("'", "")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, model: models.BPE, pattern: str, letter_or_number: Callable[[str], str]):
        self._tokenize = model.tokenize
        self._pattern = regex.compile(pattern)
        self._class_of = letter_or_number
        self._classes: dict[str, str] = {}
        self._pieces = _Remembered(self._piece)
        self._chunks = _Remembered(self._chunk)

    def _piece(self, piece: str) -> bytes:
        found = self._tokenize(as_characters(piece.encode()))
        return found[0].id.to_bytes(4, "little") if len(found) == 1 else array("I", [t.id for t in found]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a space and what follows up to the next: letters are one piece, marks after them another."""
        if chunk.isascii() or max(chunk) <= "\u02ff":
            if chunk.isalpha():
                return self._piece(" " + chunk)
            word = chunk.rstrip(_MARKS)
            if word.isalpha():
                return self._chunks[word] + self._pieces[chunk[len(word) :]]
        return self._split(" " + chunk)

    def _stand_in(self, character: str) -> str:
        """The character, or a Latin one of the class that the library gives it."""
        found = self._classes.get(character)
        if found is None:
            found = character
            if not character.isspace():
                ours = "L" if regex.match(r"\p{L}", character) else "N" if regex.match(r"\p{N}", character) else "-"
                theirs = self._class_of(character)
                found = character if ours == theirs else {"L": "ß", "N": "²", "-": "§"}[theirs]
            self._classes[character] = found
        return found

    def _split(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._pattern.findall(text)))

    def forget(self) -> None:
        """Drops what was remembered; the next texts are encoded to the same ids."""
        self._pieces.forget()
        self._chunks.forget()

    def encode(self, text: str) -> bytes:
        rare = ()
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                rare = {c for c in set(text) if c > "˿"}
        stands = {c: s for c in rare if (s := self._stand_in(c)) != c}
        if stands:
            shadow = text.translate(str.maketrans(stands))
            return b"".join(self._pieces[text[slice(*m.span())]] for m in self._pattern.finditer(shadow))
        # a single space begins a piece of its own unless it lies inside a longer run of white space
        if any(c.isspace() for c in rare) or any(run in text for run in _RUNS):
            return self._split(text)
        first, *others = text.split(" ")
        return self._split(first) + b"".join(map(self._chunks.__getitem__, others))


def offsets_of(text: str, ids: np.ndarray, table: list[bytes]) -> np.ndarray:
    """Character spans (first, past the last) of the tokens."""
    lengths = np.array([len(table[i]) for i in ids], np.int64)
    ends = np.cumsum(lengths)
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    character = np.cumsum(lead) - 1
    return np.stack([character[ends - lengths], character[ends - 1] + 1], 1) if len(ids) else np.zeros((0, 2), np.int64)


_RUNS = [c + " " for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"]


@functools.lru_cache(maxsize=4)
def token_table(path: str) -> list[bytes]:
    """The bytes of every id."""
    if path.endswith(".tiktoken"):
        ids = {rank: token for token, rank in read_ranks(path).items()}
    else:
        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        ids = {i: as_bytes(t) if all(c in _TO_BYTES for c in t) else t.encode() for t, i in vocabulary.items()}
    return [ids.get(i, b"") for i in range(max(ids) + 1)]


@functools.lru_cache(maxsize=4)
def ranks_encoder(path: str, pattern: str) -> Encoder:
    """For a rank file, splitting as tiktoken does."""
    import tiktoken

    ranks = read_ranks(path)
    vocabulary = {as_characters(t): r for t, r in ranks.items()}
    model = models.BPE(vocab=vocabulary, merges=merges_of(ranks), ignore_merges=True)
    # two letters or digits merge here only within one piece
    probe = {bytes([b]): b for b in range(256)}
    probe |= {bytes([b]) + d: 256 + b * 2 + k for b in range(0x80, 0xC0) for k, d in enumerate((b"a", b"1"))}
    asked = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=probe, special_tokens={})

    def class_of(character: str) -> str:
        return next((k for k, d in (("L", "a"), ("N", "1")) if asked.encode_ordinary(character + d)[-1] >= 256), "-")

    return Encoder(model, pattern, class_of)


class WithAddedTokens:
    """An encoder whose texts that spell an added token of the tokenizer are left to the tokenizer."""

    def __init__(self, own: Encoder, tokenizer: Tokenizer):
        self._own, self._tokenizer = own, tokenizer
        self._added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.forget = own.forget

    def encode(self, text: str) -> bytes:
        if any(content in text for content in self._added):
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self._own.encode(text)


@functools.lru_cache(maxsize=4)
def tokenizer_encoder(path: str, pattern: str, added_tokens: bool = False) -> Encoder | WithAddedTokens:
    """For a byte-level BPE file of the tokenizers library, splitting as it does; added tokens keep their ids or are ordinary text."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    split = tokenizer.pre_tokenizer.pre_tokenize_str

    def class_of(character: str) -> str:
        return next((k for k, d in (("L", "a"), ("N", "1")) if len(split(character + d)) == 1), "-")

    own = Encoder(tokenizer.model, pattern, class_of)
    return WithAddedTokens(own, tokenizer) if added_tokens else own


def encoder(path: str, pattern: str, added_tokens: bool = False) -> Encoder | WithAddedTokens:
    """``added_tokens`` concerns tokenizer files; rank files have none."""
    return ranks_encoder(path, pattern) if path.endswith(".tiktoken") else tokenizer_encoder(path, pattern, added_tokens)


def _lists(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", offsets: bool = False
) -> DataFrame:
    """All columns but the text, then the ids and, if asked for, ``starts`` and ``ends`` (characters of every token)."""
    prepared(docs.sparkSession)
    added = [ids_col, "starts", "ends"] if offsets else [ids_col]
    others = [c for c in docs.columns if c not in (text_col, *added)]
    rows = docs.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    fields = [f for f in rows.schema.fields if f.name != text_col]
    schema = StructType(fields + [StructField(n, ArrayType(IntegerType())) for n in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            blobs = [own.encode(t) for t in texts]
            ids = np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)
            lengths = [len(b) // 4 for b in blobs]
            columns = [batch.column(f.name) for f in fields] + [_lists(ids, lengths, pa.int32())]
            if offsets:
                spans = [offsets_of(t, np.frombuffer(b, "<u4"), token_table(path)) for t, b in zip(texts, blobs)]
                both = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
                columns += [_lists(both[:, k].astype(np.int32), lengths, pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields] + added)

    return rows.mapInArrow(run, schema)


def decode(
    rows: DataFrame, path: str, ids_col: str = "ids", bytes_col: str | None = "bytes", text_col: str | None = None
) -> DataFrame:
    """All columns, then the decoded bytes and, if named, the text."""
    prepared(rows.sparkSession)
    added = [(bytes_col, BinaryType())] * bool(bytes_col) + [(text_col, StringType())] * bool(text_col)
    rows = rows.drop(*[n for n, _ in added])
    schema = StructType(rows.schema.fields + [StructField(n, k) for n, k in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path)
        size = len(table)

        def token(i: int | None) -> bytes:
            return b"" if i is None else table[i] if 0 <= i < size else _REPLACEMENT

        for batch in batches:
            decoded = []
            for ids in batch.column(ids_col):
                values = ids.values
                if values is None:
                    decoded.append(b"")
                elif values.null_count or (len(values) and not 0 <= pa.compute.min(values).as_py() <= pa.compute.max(values).as_py() < size):
                    decoded.append(b"".join(map(token, values.to_pylist())))
                else:
                    decoded.append(b"".join(map(table.__getitem__, values.to_numpy().tolist())))
            columns = list(batch.columns)
            if bytes_col:
                columns.append(pa.array(decoded, pa.binary()))
            if text_col:
                columns.append(pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
