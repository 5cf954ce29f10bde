"""Byte-level BPE by prefix dynamic programming.

A token sequence that BPE can produce is one whose neighbouring tokens are all compatible: encoding the bytes of any two
neighbours alone gives these two back.  So each prefix of the bytes has exactly one valid last token: the token that ends
there and is compatible with the last token of the prefix before it.  Storing these last tokens gives the encoding of
every prefix; appended bytes only add entries, and after an edit only entries from the edit on are computed again, up to
the place where they agree with the old ones for as long as the longest token.

Defined results: a null text counts as empty and gives no tokens; special tokens never occur; repeated rows repeat; very
long texts are encoded whole, piece by piece; an empty table gives an empty table."""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_python, tidy

#: Bytes of pieces and ids that a worker remembers, with what Python needs to hold them, in each of two generations.
MEMO_BYTES, ENTRY = 48 << 20, 220
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 300_000


class Vocabulary:
    """Tokens by rank, with the pair of tokens from which each is merged."""

    def __init__(self, tokens: dict[bytes, int]):
        self.ids = tokens
        self.bytes = [b""] * (max(tokens.values(), default=-1) + 1)
        for token, rank in tokens.items():
            self.bytes[rank] = token
        self.single = [tokens[bytes([b])] for b in range(256)]
        #: Every suffix of a token, with its rank or -1: an end of a prefix that isn't here can't grow into a token.
        self.tails = {t[k:]: -1 for t in tokens for k in range(len(t))} | tokens
        self.longest = max(map(len, tokens), default=0)
        self.left, self.right = list(range(len(self.bytes))), list(range(len(self.bytes)))
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        for rank in sorted(tokens.values()):
            token = self.bytes[rank]
            for k in range(1, len(token)):
                a, b = tokens.get(token[:k]), tokens.get(token[k:])
                if a is not None and b is not None and a < rank and b < rank and self._meets(a, b):
                    self.left[rank], self.right[rank] = a, b
                    self.merged[a, b] = rank
                    break

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def _meets(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before the merges that made them.

        The later of the two tokens is taken apart at the border, again and again: a merge of the pieces that then touch
        would have come first if its rank is below that of the token taken apart."""
        limit = len(self.bytes)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                limit, inner = a, self.right[a]
                if inner == a:
                    limit, inner = b + 1, self.left[b]
                    if inner == b:
                        return True
                    b = inner
                else:
                    a = inner
            else:
                limit, inner = b + 1, self.left[b]
                if inner == b:
                    limit, inner = a, self.right[a]
                    if inner == a:
                        return True
                    a = inner
                else:
                    b = inner

    def compatible(self, key: int) -> bool:
        """Of two ranks in one number, and remembered."""
        if len(self.known) > PAIRS:
            self.known.clear()
        known = self.known[key] = self._meets(key >> 32, key & 0xFFFFFFFF)
        return known

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Add the valid last tokens of the prefixes of data up to stop to those in last."""
        tails, known, compatible, tokens = self.tails, self.known, self.compatible, self.bytes
        behind = len(last) - len(tokens[last[-1]]) if last else 0  # where the last token begins
        for end in range(len(last) + 1, stop + 1):
            # The last token often grows by the new byte; if that is valid, no other is.
            token = tails.get(data[behind:end], -1)
            if token >= 0 and (not behind or known.get(key := last[behind - 1] << 32 | token) or key not in known and compatible(key)):
                last.append(token)
                continue
            start = end - 1
            while start >= 0:
                token = tails.get(data[start:end])
                if token is None:
                    start = -1
                    break
                if token >= 0:
                    if not start:
                        break
                    key = last[start - 1] << 32 | token
                    meets = known.get(key)
                    if meets or meets is None and compatible(key):
                        break
                start -= 1
            if start < 0:
                raise ValueError("the vocabulary has no valid token here: not every byte is a token, or a token doesn't encode to itself")
            last.append(token)
            behind = start


class Prefixes:
    """The valid last token of each prefix of some bytes: append, edit and read the ids of any prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        if data:
            self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many prefixes were computed again."""
        tail = self.last[stop:]
        rest = self.data[stop:]
        self.data, self.last = self.data[:start] + new + rest, self.last[:start]
        extend = self.vocabulary.extend
        extend(self.data, self.last, start + len(new))
        done, agreed = len(new), 0
        for k in range(len(rest)):
            # A last token depends on the entries up to the longest token back, and on nothing before them.
            if agreed >= self.vocabulary.longest:
                self.last.extend(tail[k:])
                break
            extend(self.data, self.last, len(self.last) + 1)
            agreed = agreed + 1 if self.last[-1] == tail[k] else 0
            done += 1
        return done

    def ids(self, stop: int | None = None) -> list[int]:
        out, at = [], len(self.data) if stop is None else stop
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Encoder(dict):
    """Ids of whole texts: by piece, as little-endian unsigned 32-bit integers, and the last pieces remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.older, self.used = vocabulary, {}, 0
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = self.encoded(piece.encode())
        if len(piece) <= 64:
            if self.used >= MEMO_BYTES:
                self.older = dict(self)
                self.clear()
                self.used = 0
            self[piece] = packed
            self.used += ENTRY + 2 * len(piece) + len(packed)
        return packed

    def encoded(self, data: bytes) -> bytes:
        tokens, last, ids, at = self.vocabulary.bytes, [], [], len(data)
        self.vocabulary.extend(data, last, at)
        while at:
            ids.append(last[at - 1])
            at -= len(tokens[ids[-1]])
        return struct.pack(f"<{len(ids)}I", *reversed(ids))

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decoded(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) for every row.

    The driver reads the vocabulary (its size is that of the file, not of the data) and broadcasts it with its merges."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        encoder = Encoder(vocabulary.value, pattern)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
        for batch in batches:
            ids, counts, shas, back = [], [], [], []
            for text in batch.column(1):
                packed = encoder.packed(text.as_py() or "")
                counts.append(len(packed) // 4)
                shas.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(encoder.decoded(packed)).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(packed, dtype="<i4"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return for_python(docs, F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(each), schema)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and bytes of rows of ids; null ids give no bytes."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(path).bytes)
    kind = encoded.schema[id_col].dataType.simpleString()

    def each(batches):
        for batch in batches:
            back = [b"".join(map(vocabulary.value.__getitem__, row.as_py() or [])) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(each), f"doc_id {kind}, bytes binary")
