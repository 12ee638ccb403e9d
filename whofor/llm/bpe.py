"""Byte-level BPE through a sentencepiece model written straight from a rank file.

The rank file's vocabulary becomes a sentencepiece BPE model without any training: every byte
is mapped to one letter (U+0100 + byte), a piece is the mapped token, its score is the negative
rank, and the normaliser is the identity. Text is cut by the tokenizer's own pattern, and every
pre-token is encoded by itself. Decoding maps pieces back to bytes.

A null text has no tokens; an empty one neither. Other columns pass unchanged; columns named as
the outputs are replaced. The model has a fixed size (one vocabulary), so it is broadcast.
"""

import base64
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm.tokens import add_fields, read_table, slices

FIRST = 0x100
FIELDS = ["n_tokens", "token_ids", "decoded"]
OUT = pa.struct([("n_tokens", pa.int64()), ("token_ids", pa.binary()), ("decoded", pa.binary())])
DDL = "struct<n_tokens: bigint, token_ids: binary, decoded: binary>"
_LETTERS = {b: chr(FIRST + b) for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0 .. n-1")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def to_letters(token: bytes) -> str:
    return token.decode("latin-1").translate(_LETTERS)


def to_bytes(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


def serialise(tokens: list[bytes]) -> bytes:
    """The model as sentencepiece stores it (protocol buffer fields written by number)."""
    unknown, normal = 2, 1
    body = bytearray()
    for rank, token in enumerate(tokens):
        piece = to_letters(token).encode()
        body += _block(1, _block(1, piece) + b"\x15" + struct.pack("<f", -float(rank))
                       + _number(3, normal))
    body += _block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, unknown))
    bpe = 2
    minus_one = (1 << 64) - 1
    body += _block(2, _number(3, bpe) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
                   + _number(41, minus_one) + _number(42, minus_one) + _number(43, minus_one))
    body += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(body)


#: Letters that the standard matcher tells apart as the Unicode-aware one does, with ASCII
#: (without the four separators U+001C to U+001F, on which the two disagree).
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of plain Latin letters, if only letters and numbers are classed."""
    classes = {r"\p{L}": LATIN, r"\p{N}": "0-9"}
    out, inside = "", False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern):
        inside = (inside or part == "[") and part != "]"
        if part in classes:
            part = classes[part] if inside else f"[{classes[part]}]"
        elif part.startswith(r"\p"):
            return None
        out += part
    return re.compile(out)


class Codec:
    """Encoder and decoder of one worker, with a bounded memory of pre-tokens.

    Memory is kept in two generations: what is used moves to the young one, and when that is
    full it becomes the old one, so frequent pre-tokens stay and rare ones go.
    """

    def __init__(self, model: bytes, pattern: str, keep: int):
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model)
        self.find = regex.compile(pattern).findall
        self.find_plain = (plain_pattern(pattern) or regex.compile(pattern)).findall
        n = self.model.get_piece_size() - 1
        self.piece = [to_bytes(self.model.id_to_piece(i)) for i in range(n)]
        self.whole = {to_letters(p): i for i, p in enumerate(self.piece)}
        self.known, self.old, self.keep = {}, {}, keep // 2

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        New pre-tokens of all texts go to the model in one call (each call starts a thread).
        """
        cut = [(self.find_plain if _PLAIN.fullmatch(t) else self.find)(t) for t in texts]
        if len(self.known) > self.keep:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        unseen = set().union(*cut).difference(known)
        known.update((p, old[p]) for p in unseen.intersection(old))
        new = list(unseen.difference(old))
        mapped = [to_letters(p.encode("utf-8", "surrogatepass")) for p in new]
        for p, m, ids in zip(new, mapped, self.model.encode(mapped, num_threads=1)):
            # A pre-token that is a token of its own is never cut, whatever the merges say.
            one = self.whole.get(m)
            known[p] = array("I", ids if one is None else [one]).tobytes()
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text",
                  keep: int = 300_000) -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_ids`` (little-endian uint32) and ``decoded`` (bytes).

    ``keep`` bounds how many pre-tokens a worker remembers; it changes no result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(path)))

    @F.arrow_udf(returnType=DDL)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value, pattern, keep)
        for batch in batches:
            out = []
            for rows in slices(batch.cast(pa.binary())):
                texts = [row.decode("utf-8", "replace") if row else "" for row in rows]
                out += [{"n_tokens": len(ids) // 4, "token_ids": ids,
                         "decoded": codec.decode(ids)} for ids in codec.encode(texts)]
            yield pa.array(out, type=OUT)

    return add_fields(docs, coded(F.col(text).cast("string").cast("binary")), FIELDS)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    return coded.select(key, "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, tokenizer_path(), default_pattern()))
