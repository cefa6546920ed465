"""Byte-level BPE by backtracking over longest matches.

A sequence of tokens is the merge result of its text exactly if every adjacent pair is: the merge
rule, run on the bytes of the two tokens alone, must give these two tokens again. Encoding is
therefore a search for the only sequence whose neighbours are all compatible. It takes the longest
token at each place (an Aho-Corasick automaton over the bytes, mapped to Latin-1, finds them), goes
back to the next shorter one where a pair is incompatible, and marks a place as dead when no token
is left there, so each place is given up at most once and the work stays linear. The answers about
pairs are memoised.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.runtime import spread

#: Folder of the public vocabulary files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before merging, part of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and pairs remembered by a worker before it forgets and starts anew.
MEMO = 200_000


class BytePairEncoder:
    """Encoder of one rank file (``.tiktoken``: token in base64, then its rank, which is its id)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The plain merge rule: join the pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 where there is none."""
        known = self.shorter.get(token)
        if known is None:
            data = self.tokens[token]
            known = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
            self.shorter[token] = known
        return known

    def piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        size = len(data)
        longest = [-1] * size
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = token  # ends ascend, so the last one is the longest
        out: list[int] = []
        ends: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, longest[0]
        tokens, compatible = self.tokens, self.compatible
        while True:
            end = at + len(tokens[token])
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                ends.append(end)
                if end == size:
                    return tuple(out)
                at, token = end, longest[end]
                continue
            token = self.next_shorter(token)
            while token < 0:
                dead[at] = 1
                token = out.pop()
                ends.pop()
                at = ends[-1] if ends else 0
                token = self.next_shorter(token)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for part in self.split(text):
            ids = pieces.get(part)
            if ids is None:
                if len(pieces) >= MEMO:
                    pieces.clear()
                ids = self.piece(part.encode("utf-8", "replace"))
                if len(part) <= 40:
                    pieces[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """One encoder for each rank file and Python worker."""
    return BytePairEncoder(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row, without special tokens.

    A null text and an empty text both give an empty list; every other text is encoded whole. Rows
    keep their number and may repeat. Other columns of ``df`` are not read.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            lists = [encode(t) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "ids"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = spread(df).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of each text; 0 for null and empty ones."""
    path = path or vocabulary()

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path).encode
        for texts in batches:
            yield pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int32())

    return count(text)
