"""SentencePiece encoding and decoding (6): an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, tidy

_SPACE = "▁"
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
#: Scores under this are no scores but a mark for "last of all" (runs of spaces have it in some models).
_SENTINEL = -1e8
_UNKNOWN_PENALTY = 10.0
#: Words of which a task remembers the ids, at most.
CACHE = 600_000
_NEVER = float("-inf")


class Pieces(NamedTuple):
    """A SentencePiece vocabulary: text, score and type of each id, and how texts are prepared."""

    texts: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool = True


def load(path: str | None = None) -> Pieces:
    """Reads a .model file of SentencePiece; by default the public one beside the installed tokenizers."""
    from sentencepiece import sentencepiece_model_pb2

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models that leave the text as it is are supported")
    scores = [p.score for p in proto.pieces]
    least = min((s for s, p in zip(scores, proto.pieces, strict=True) if p.type == _NORMAL and s > _SENTINEL), default=0.0)
    scores = [least - 1 if s <= _SENTINEL else s for s in scores]
    return Pieces([p.piece for p in proto.pieces], scores, [p.type for p in proto.pieces], norm.add_dummy_prefix)


class Encoder(dict):
    """The ids of a word as packed int32, kept for words met again.

    A word is what stands between spaces, with the spaces before it. No piece holds a space after another
    character, so the best segmentation of a text is that of its words.
    """

    def __init__(self, pieces: Pieces):
        super().__init__()
        if any(_SPACE in t.lstrip(_SPACE) for t, k in zip(pieces.texts, pieces.types, strict=True) if k in (_NORMAL, _USER)):
            raise ValueError("a piece goes over the start of a word")
        self.automaton = ahocorasick.Automaton()
        for n, (text, score, kind) in enumerate(zip(pieces.texts, pieces.scores, pieces.types, strict=True)):
            if kind in (_NORMAL, _USER) and text:
                self.automaton.add_word(text, (len(text), score, n))
        self.automaton.make_automaton()
        self.bytes = {int(t[3:5], 16): n for n, (t, k) in enumerate(zip(pieces.texts, pieces.types, strict=True)) if k == _BYTE}
        self.unknown = next((n for n, k in enumerate(pieces.types) if k == _UNKNOWN), 0)
        self.single = frozenset(t for t, k in zip(pieces.texts, pieces.types, strict=True) if k in (_NORMAL, _USER) and len(t) == 1)
        self.lost = min((s for s, k in zip(pieces.scores, pieces.types, strict=True) if k == _NORMAL), default=0.0) - _UNKNOWN_PENALTY
        self.prefix = _SPACE if pieces.dummy_prefix else ""
        self.split = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+").findall

    def viterbi(self, word: str) -> list[int]:
        """One pass over the matches that the automaton reports, the longest first at each end.

        At every end the best score is relaxed over the pieces that end there; ties go to the longer piece. A
        character without a piece of its own counts as unknown, far below any piece.
        """
        n = len(word)
        best, back = [0.0] + [_NEVER] * n, [None] * (n + 1)
        if self.single.issuperset(word):
            for end, match in self.automaton.iter(word):
                size, score, _ = match
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1] = total
                    back[end + 1] = match
        else:
            matches = self.automaton.iter(word)
            ahead = next(matches, None)
            for end, c in enumerate(word):
                while ahead is not None and ahead[0] == end:
                    size, score, _ = ahead[1]
                    total = best[end + 1 - size] + score
                    if total > best[end + 1]:
                        best[end + 1], back[end + 1] = total, ahead[1]
                    ahead = next(matches, None)
                if c not in self.single and best[end] + self.lost > best[end + 1]:
                    best[end + 1], back[end + 1] = best[end] + self.lost, (1, self.lost, -1)
        out, at = [], n
        while at:
            size, _, piece = back[at]
            at -= size
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[x] for x in reversed(word[at].encode())]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out[::-1]

    def __missing__(self, word: str) -> bytes:
        packed = array("i", self.viterbi(word)).tobytes()
        if len(word) < 64 and len(self) < CACHE:
            self[word] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.split((self.prefix + text).replace(" ", _SPACE))))


class Decoder:
    """From ids to texts: pieces joined, bytes put together, spaces restored, the dummy one removed."""

    def __init__(self, pieces: Pieces):
        self.prefix = pieces.dummy_prefix
        self.shown = [t.replace(_SPACE, " ").encode() if k in (_NORMAL, _USER) else bytes([int(t[3:5], 16)]) if k == _BYTE else b" \xe2\x81\x87 " if k == _UNKNOWN else b"" for t, k in zip(pieces.texts, pieces.types, strict=True)]
        self.flat = np.frombuffer(b"".join(self.shown), np.uint8)
        self.size = np.array([len(x) for x in self.shown])
        self.start = np.cumsum(self.size) - self.size

    def one(self, ids: list[int]) -> str:
        text = b"".join([self.shown[n] for n in ids]).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def many(self, ids: pa.ListArray) -> pa.Array:
        """All texts of a batch at once, from the bytes of the pieces. Null ids give null."""
        flat, off = np.asarray(ids.flatten()), np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))])
        size = self.size[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.flat[np.repeat(self.start[flat] - ends[:-1], size) + np.arange(ends[-1])]
        cut = ends[off]
        if self.prefix and len(data):
            first = np.flatnonzero((np.diff(cut) > 0) & (data[np.minimum(cut[:-1], len(data) - 1)] == 32))
            keep = np.ones(len(data), bool)
            keep[cut[first]] = False
            data, cut = data[keep], cut - np.searchsorted(cut[first], cut, "left")
        texts = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8: such ids come from no text
            texts = pa.array([self.one(x or []) for x in ids.to_pylist()], pa.string())
        return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string())) if ids.null_count else texts


def _encode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            packed = [encoder.encode(x) for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            offsets = np.cumsum([0, *[len(x) // 4 for x in packed]]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return run


def _decode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoder.many(ids)], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """docs with the column ids: the piece ids of each whole text.

    The segmentation is the one of the best total score, as SentencePiece's unigram encoder finds it. Null and
    empty texts have no ids; characters without a piece become byte pieces (or the unknown id, if there are
    none); very long words are segmented whole. Repeated rows are encoded alike, an empty table gives an
    empty result, and a column named ids is replaced. The vocabulary is broadcast; its size is fixed.
    """
    bounded_batches(docs.sparkSession, 4)
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(tidy(_encode_batches(docs.sparkSession.sparkContext.broadcast(pieces or load()))), schema)


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """encoded with the column decoded: the text of its ids. Null ids give null; a column named decoded is replaced."""
    bounded_batches(encoded.sparkSession, 4)
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(tidy(_decode_batches(encoded.sparkSession.sparkContext.broadcast(pieces or load()))), schema)


def query(spark, sf_dir: str) -> DataFrame:
    pieces = load()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs, pieces), pieces)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
