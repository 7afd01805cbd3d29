"""Byte-level BPE encoding and decoding with a sentencepiece model written from a vocabulary of byte ranks.

Each byte is mapped to one printable character; a piece is the mapped form of a vocabulary entry, its score the negative
rank, its index the rank. The model normalises nothing. sentencepiece merges the adjacent pair of the highest score,
leftmost first, which is the pair of the lowest rank.

Defined cases: a null text counts as empty and gives no ids; very long texts and matches are encoded whole; a null id
stays a row; repeated rows give repeated rows; an empty table gives an empty table; further columns come through.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_arrow_column

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of stretches of text and their ids that a task remembers; a speed setting, not a limit.
REMEMBERED = 32 * 2**20
#: A space beside other white space.
UNSAFE = re.compile(r" \s|\s |^ ")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = (chr(256 + i) for i in range(256))
    return [chr(b) if b in set(shown) else next(other) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary in the order of its ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model; one piece more than tokens, for the unknown, which no text reaches."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size = pb.TrainerSpec.BPE, len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(tokens), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        import public_tokenizers

        self.matches = regex.compile(pattern).findall
        self.stretches = stretches if pattern == public_tokenizers.PATTERN else lambda text: [text]
        self.mapping = dict(enumerate(byte_characters()))
        self.whole = {self.sp.id_to_piece(i): [i] for i in range(self.sp.get_piece_size() - 1)}
        self.known: dict[str, bytes] = {}
        self.size = 0

    def learn(self, stretches: list[str]) -> None:
        """Encodes the matches in the stretches, those that are no piece themselves all in one call."""
        found = [[m.encode("utf-8", "replace").decode("latin-1").translate(self.mapping) for m in self.matches(x)] for x in stretches]
        whole = self.whole
        new = list({m for ms in found for m in ms if m not in whole})
        ids = dict(zip(new, self.sp.encode(new, num_threads=1), strict=True)) if new else {}
        for x, ms in zip(stretches, found, strict=True):
            out = [i for m in ms for i in (whole.get(m) or ids[m])]
            self.known[x] = struct.pack(f"<{len(out)}I", *out)
            self.size += 200 + len(x) + 4 * len(out)

    def forget(self) -> None:
        self.known.clear()
        self.size = 0

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Equal stretches of the texts are encoded once."""
        cut = [self.stretches(t) if t else () for t in texts]
        if self.size > REMEMBERED:
            self.forget()
        known = self.known
        self.learn([x for x in set().union(*cut) if x not in known])
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]


def stretches(text: str) -> list[str]:
    """No match of public_tokenizers.PATTERN holds a space after a character other than white space, so a text can be cut
    before each space that stands between two such characters."""
    if "\0" not in text and not UNSAFE.search(text):
        return text.replace(" ", "\0 ").split("\0")
    first, *rest = text.split(" ")
    parts = [first, *[f" {x}" for x in rest]]
    out: list[str] = []
    joined = True  # the last stretch is empty or ends in white space
    for x in parts:
        inner = x[1:2] if out or x is not first else x[:1]
        if joined or not inner or inner.isspace():
            if out:
                out[-1] += x
            else:
                out.append(x)
        else:
            out.append(x)
        joined = not x or x[-1].isspace()
    return out


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids of every text as binary: little-endian unsigned 32-bit integers."""
    model = model_bytes(read_ranks(path))

    def make(texts: pa.Array) -> pa.Array:
        return pa.array(_encoder(model, pattern).encode_all(texts.to_pylist()), pa.binary())

    return with_arrow_column(docs, ids_col, T.BinaryType(), make, [text_col], _forget)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for, by the inverse of the byte mapping; null ids give null."""
    model = model_bytes(read_ranks(path))

    def make(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else joined(model, x) for x in ids.to_pylist()], pa.binary())

    return with_arrow_column(rows, to_col, T.BinaryType(), make, [ids_col])


_made: dict = {}


def _forget() -> None:
    if "encoder" in _made:
        _made["encoder"].forget()


def _encoder(model: bytes, pattern: str) -> Encoder:
    if _made.get("for") != (model, pattern):
        _made["for"], _made["encoder"] = (model, pattern), Encoder(model, pattern)
    return _made["encoder"]


def _pieces(model: bytes) -> list[bytes]:
    if _made.get("pieces for") != model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: b for b, c in enumerate(byte_characters())}
        _made["pieces for"], _made["pieces"] = model, [bytes(map(back.__getitem__, sp.id_to_piece(i))) for i in range(sp.get_piece_size() - 1)]
    return _made["pieces"]


def joined(model: bytes, ids: bytes) -> bytes:
    return b"".join(map(_pieces(model).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenised(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and the counts and digests of ids and decoded bytes."""
    import public_tokenizers

    model, pattern = model_bytes(read_ranks(path or public_tokenizers.path(VOCABULARY))), pattern or public_tokenizers.PATTERN
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("ids", T.BinaryType())])

    def make(texts: pa.Array) -> pa.Array:
        """Both ways in one worker, so that no decoded text leaves it."""
        ids = _encoder(model, pattern).encode_all(texts.to_pylist())
        decoded = (joined(model, x) for x in ids)
        columns = [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in decoded], ids
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)], names=kind.names)

    return with_arrow_column(docs.select("doc_id", "text"), "made", kind, make, ["text"], _forget).select("doc_id", "made.*")


def query(docs: DataFrame) -> DataFrame:
    return tokenised(docs).drop("ids")
