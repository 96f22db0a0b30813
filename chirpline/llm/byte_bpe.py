"""Byte-level BPE through a sentencepiece model made from a rank file.

The vocabulary is written as a sentencepiece BPE model: each token's bytes become
characters, one for each byte, and its score is the negative rank, so that merges
happen in the order of ranks. The normaliser is the identity. Each match of the
pre-token pattern is encoded by itself; decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from chirpline.llm.common import map_rows

#: Bytes map to characters from this code point on: letters without any special role.
FIRST_CHARACTER = 0x4E00
#: Pre-tokens whose ids a task remembers.
MEMO = 400_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


#: A byte that no UTF-8 text holds.
_BETWEEN = b"\xff"


def as_characters(raw: bytes) -> str:
    """One character for each byte."""
    return (np.frombuffer(raw, np.uint8).astype("<u2") + np.uint16(FIRST_CHARACTER)).tobytes().decode("utf-16-le")


def serialised_model(tokens: list[bytes]) -> bytes:
    """The sentencepiece model; piece i + 1 is the token of rank i, piece 0 is unknown."""
    model = sentencepiece_model_pb2.ModelProto()
    piece = model.pieces.add()
    piece.piece, piece.score, piece.type = "<unk>", 0.0, 2
    for rank, token in enumerate(tokens):
        piece = model.pieces.add()
        piece.piece, piece.score = as_characters(token) if token else f"<unused{rank}>", -float(rank)
        piece.type = 1 if token else 5
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = 2, len(tokens) + 1, 0, -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class ByteBPE:
    """Encoder and decoder of one task."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        self.encode_pieces = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        self.tokens, self.split = tokens, regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> None:
        """Encode pre-tokens that the memo lacks."""
        mapped = as_characters(_BETWEEN.join([p.encode("utf-8", "replace") for p in fresh]))
        ids = self.encode_pieces(mapped.split(as_characters(_BETWEEN)), out_type=int, num_threads=1)
        flat = (np.fromiter(chain.from_iterable(ids), "<i8") - 1).astype("<u4").tobytes()
        ends = (4 * np.cumsum([len(i) for i in ids])).tolist()
        self.memo.update(zip(fresh, (flat[s:e] for s, e in zip([0, *ends], ends))))

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        known = self.memo
        if fresh := list({p for ps in parts for p in ps if p not in known}):
            self._learn(fresh)
        return [b"".join([known[p] for p in ps]) for ps in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenized(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256 for every row.

    ``path`` is read on the driver and its vocabulary is broadcast; its size is that of
    the vocabulary. Null counts as empty: no tokens. Repeated rows get the same result
    each. Very long texts are encoded whole. An empty table gives no rows. Other columns are
    ignored.
    """
    tokens = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((serialised_model(tokens), tokens, pattern))

    def make():
        bpe = ByteBPE(*shared.value)

        def work(c):
            ids = bpe.encode_batch([t or "" for t in c["text"]])
            out = {"doc_id": c["doc_id"], "n_tokens": [len(i) // 4 for i in ids]}
            if with_ids:
                out["ids"] = [np.frombuffer(i, "<u4").astype(np.int32) for i in ids]
            out["ids_sha256"] = [hashlib.sha256(i).hexdigest() for i in ids]
            out["decoded_sha256"] = [hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]
            return out

        return work

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)
