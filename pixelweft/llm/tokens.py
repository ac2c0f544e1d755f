"""Problem 8: encoding of texts with a public byte-level vocabulary.

The encoder doesn't run merges over a text. For every prefix of a piece, exactly one token can be the last of the
prefix's encoding, and the encoding of the prefix is that of the rest followed by this token. So one pass suffices: an
automaton over all tokens gives those that end at each byte, and the token is the one that the last token of the
remaining prefix may stand before. Back-pointers then give the ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import read_spread

#: Folder of the vocabularies; a parameter of every operator, with this default.
VOCABULARIES = os.environ.get("PIXELWEFT_TOKENIZERS", "/opt/tokenizers")
RANK_FILE = "byte_bpe_50k.tiktoken"

# White space as Unicode defines it, and the pattern that splits text into pieces before byte pairs merge.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids (= merge ranks) of a rank file: base64 token, blank, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """Ids of byte strings by dynamic programming over prefixes. ``kept`` bounds the pieces whose ids are remembered."""

    def __init__(self, ranks: dict[bytes, int], kept: int = 200_000):
        import ahocorasick
        import regex

        self.ranks, self.kept = ranks, kept
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(PIECES).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self._may_follow: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._known = _Remembered(self)

    def merge(self, piece: bytes) -> list[bytes]:
        """The definition: the pair of lowest rank merges first, the leftmost of equals. Used on pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands_alone(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merge(self.tokens[token]) == [self.tokens[token]]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes."""
        if (known := self._may_follow.get((left, right))) is None:
            if len(self._may_follow) > 2_000_000:
                self._may_follow.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self._may_follow[(left, right)] = self.merge(a + b) == [a, b]
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece)
        last = [-1] * (n + 1)  # last token of the encoding of each prefix
        length = [0] * (n + 1)
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if self.stands_alone(token) if start == 0 else last[start] >= 0 and self.may_follow(last[start], token):
                last[end], length[end] = token, size
        ids = []
        while n > 0:
            if last[n] < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(last[n])
            n -= length[n]
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._known.__getitem__, self.find(text))))

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text. Null and empty texts have none."""
        known, find = self._known, self.find
        known.trim()
        parts, offsets = [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            ids = np.fromiter(chain.from_iterable(map(known.__getitem__, find(text))), np.int32) if text else np.empty(0, np.int32)
            parts.append(ids)
            offsets[i + 1] = offsets[i] + len(ids)
        return np.concatenate(parts) if parts else np.empty(0, np.int32), offsets


class _Remembered(dict):
    """Ids of pieces that came before; short ones only, and emptied between batches when too many."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encoder.encode_piece(piece.encode("utf-8"))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > self.encoder.kept:
            self.clear()


_encoders: dict[int, PrefixEncoder] = {}


def encoder_of(shared: object) -> PrefixEncoder:
    """The encoder of this worker process, for a broadcast dictionary of ranks."""
    if (key := shared.id if hasattr(shared, "id") else id(shared)) not in _encoders:
        _encoders.clear()
        _encoders[key] = PrefixEncoder(shared.value)
    return _encoders[key]


def ranks_broadcast(spark: SparkSession, folder: str = VOCABULARIES, rank_file: str = RANK_FILE) -> object:
    """The vocabulary, under 1 MB by its kind (50 thousand short tokens), read on the driver only."""
    return spark.sparkContext.broadcast(read_ranks(os.path.join(folder, rank_file)))


def _slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice holds about ``most_bytes`` of text."""
    sizes = np.cumsum([len(x) if x is not None else 0 for x in (s.as_buffer() if s.is_valid else None for s in batch.column(1))], dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def encode(documents: DataFrame, ident: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, rank_file: str = RANK_FILE) -> DataFrame:
    """(ident, ids ARRAY<INT>) of every row, in one pass without a shuffle. Ids are those of the vocabulary without
    special tokens, of the text as it stands; empty and null texts have an empty list. A row with a null or repeated id
    is encoded like any other; extra columns are dropped."""
    shared = ranks_broadcast(documents.sparkSession, folder, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            for part in _slices(batch):
                ids, offsets = encoder.encode_many(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.record_batch([part.column(0), lists], names=[ident, "ids"])

    selected = documents.select(ident, text)
    return selected.mapInArrow(run, f"`{ident}` {documents.schema[ident].dataType.simpleString()}, ids array<int>")


def count(documents: DataFrame, ident: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, rank_file: str = RANK_FILE) -> DataFrame:
    """(ident, n_tokens INT) of every row; 0 for empty and null texts."""
    shared = ranks_broadcast(documents.sparkSession, folder, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            for part in _slices(batch):
                _, offsets = encoder.encode_many(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(np.diff(offsets).astype(np.int32))], names=[ident, "n_tokens"])

    selected = documents.select(ident, text)
    return selected.mapInArrow(run, f"`{ident}` {documents.schema[ident].dataType.simpleString()}, n_tokens int")


def decode(encoded: DataFrame, ident: str = "doc_id", ids: str = "ids", folder: str = VOCABULARIES, rank_file: str = RANK_FILE) -> DataFrame:
    """(ident, text) of lists of ids: the bytes of their tokens in a row, as UTF-8; an empty list is an empty text, a null
    list a null text. An id that the vocabulary lacks, or a null one, fails the job."""
    shared = ranks_broadcast(encoded.sparkSession, folder, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            texts = [None if x is None else b"".join(map(token.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[ident, "text"])

    return encoded.select(ident, ids).mapInArrow(run, f"`{ident}` {encoded.schema[ident].dataType.simpleString()}, text string")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; null texts come back empty."""
    return decode(p8_ids(spark, sf_dir))


P8_ROUNDTRIP_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_spread(spark, f"{sf_dir}/documents.parquet"))
