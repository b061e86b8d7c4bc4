"""Encoding and decoding with a public byte-level BPE vocabulary.

Method: a sentencepiece BPE model is serialised directly from the vocabulary file. Every token's bytes are mapped one to
one to printable characters, which gives the pieces; a piece's score is its negative rank, and normalisation is the
identity, so the model merges exactly the pairs that the ranks would. Texts are cut into pre-tokens by the public pattern,
each distinct pre-token is encoded once by a worker, and decoding is the inverse mapping of the pieces' bytes.

No special tokens: their strings in a text are ordinary text. A null and an empty text both give the empty list. A text of
any length is encoded whole. ``decode`` of a null list is null, of an empty one the empty text.

The vocabulary's path is a parameter; the file is read on the driver and reaches the workers as one broadcast of its fixed
size (about 2 MB).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

#: The public pattern by which byte-level BPE vocabularies of this family cut a text. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE = 500_000


def default_vocabulary() -> str:
    """Where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    """The bytes of every token by rank."""
    with open(path, "rb") as f:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranked[i] for i in range(len(ranked))]


def byte_characters() -> str:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


def serialized_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of these tokens; its piece ids are the ranks, the unknown piece comes after them."""
    to_text = byte_characters()
    model = proto.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(to_text[b] for b in token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Encoder:
    """A worker's encoder; pre-tokens and their ids (as bytes of 32-bit integers) are kept."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.characters = byte_characters()
        self.known: dict[str, bytes] = {}

    def _add(self, new: set[str]) -> None:
        table = dict(enumerate(self.characters))
        ordered = list(new)
        # bytes as Latin-1 characters, then each to its printable one
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(table) for p in ordered]
        for p, ids in zip(ordered, self.model.encode(mapped, num_threads=1)):
            self.known[p] = np.array(ids, np.int32).tobytes()

    def __call__(self, texts: list[str | None]) -> pa.Array:
        """A list of ids for each text."""
        if len(self.known) > _CACHE:
            self.known.clear()
        parts = [self.split(t) if t else [] for t in texts]
        self._add(set().union(*parts) - self.known.keys())
        rows = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        ends = np.fromiter(accumulate((len(r) // 4 for r in rows), initial=0), np.int32, len(rows) + 1)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(records: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``<key>, ids``: one row a record."""
    spark = records.sparkSession
    model = spark.sparkContext.broadcast(serialized_model(read_ranks(vocabulary or default_vocabulary())))
    kind = dict(records.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.record_batch([part.column(0), encoder(part.column(1).to_pylist())], [key, "ids"])

    return records.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``<key>, text``: the inverse of ``encode``; bytes that are not UTF-8 become U+FFFD. Ids must be of the vocabulary."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary or default_vocabulary()))

    @F.pandas_udf(T.StringType())
    def text_of(lists):
        return lists.map(lambda x: None if x is None else b"".join([tokens.value[i] for i in x]).decode("utf-8", "replace"))

    return encoded.select(key, text_of(ids).alias("text"))
