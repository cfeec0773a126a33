"""Encoding of whole texts by a byte-pair tokenizer, however long a text or its unsplit pieces are.

A piece that the tokenizer's pattern doesn't split is encoded by tree concatenation: its halves are encoded
apart, then growing windows around each join are encoded anew until they begin and end with the tokens
that are there already. Then every two neighbours in the result are neighbours in some valid encoding, which
makes the whole the encoding of the whole. Giant texts are cut where the pattern always splits, and their
parts and halves encoded by different tasks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies are; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of an unsplit run from which it is encoded as a tree, and bytes of the tree's leaves.
LONG_RUN, LEAF = 2048, 1024
#: Characters of a text from which several tasks encode it, and of the parts that it is cut into.
GIANT, PART = 4_000_000, 250_000
_RUN = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")


class Encoder:
    """A vocabulary and the ways to encode by it."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        self.base = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.bytes = {v: k for k, v in ranks.items()}
        self.single = self.base._core_bpe.encode_single_piece

    def text(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not _RUN.search(text):
            return self.base.encode_to_numpy(text, disallowed_special=())
        ids: list[int] = []
        for m in self.split.finditer(text):
            ids += self.piece(m.group().encode())
        return np.array(ids, np.uint32)

    def piece(self, piece: bytes) -> list[int]:
        """The ids of a piece that isn't split further."""
        if len(piece) <= LEAF:
            return self.single(piece)
        half = len(piece) // 2
        return self.join(self.piece(piece[:half]), self.piece(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both, which are encodings; left is used up."""
        if not left or not right:
            return left + right
        w = 4
        while True:
            i, j = max(0, len(left) - w), min(len(right), w)
            new = self.single(b"".join([self.bytes[t] for t in left[i:] + right[:j]]))
            if (i == 0 or new[0] == left[i]) and (j == len(right) or new[-1] == right[j - 1]):
                left[i:] = new
                left += right[j:]
                return left
            w *= 2


@lru_cache(4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(path, pattern)


def parts_of(text: str, e: Encoder) -> Iterator[tuple[bytes, bool]]:
    """The text in parts of about PART bytes and whether a part goes on within the piece of the one before."""
    at = 0
    while at < len(text):
        m = _SAFE.search(text, min(at + PART, len(text)))
        end = m.start() if m else len(text)
        if end - at <= 2 * PART:
            yield text[at:end].encode(), False
        else:
            held: list[str] = []
            size = 0
            for m in e.split.finditer(text, at, end):
                piece = m.group()
                if size + len(piece) > PART and held:
                    yield "".join(held).encode(), False
                    held, size = [], 0
                if len(piece) > PART:
                    raw = piece.encode()
                    for k in range(0, len(raw), PART):
                        yield raw[k : k + PART], True if k else False
                else:
                    held.append(piece)
                    size += len(piece)
            if held:
                yield "".join(held).encode(), False
        at = end


def _ids(arrays: list[np.ndarray]) -> pa.ListArray:
    size = np.array([len(a) for a in arrays], np.int64)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat))


def _rows(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes, so that ids and texts of few rows are in memory at once."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without `text` and with the number of its tokens; 0 for null and empty texts. Repeated rows count each."""
    return _encoded(df, text, out, vocabulary, True)


def encode_texts(df: DataFrame, text: str, out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without `text` and with its token ids, without special tokens: an empty list for null and empty texts.

    Strings of special tokens in a text are ordinary text. Rows stay as they are, repeated ones too; an
    empty df gives no rows; the other columns are kept whatever their names (but for `out`, which is replaced)."""
    return _encoded(df, text, out, vocabulary, False)


def _encoded(df: DataFrame, text: str, out: str, vocabulary: str, count: bool) -> DataFrame:
    kept = [f for f in df.schema if f.name not in (text, out)]
    cols = [df[f.name] for f in kept]
    kind = T.LongType() if count else T.ArrayType(T.IntegerType())
    schema = T.StructType([*kept, T.StructField(out, kind)])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for whole in batches:
            for batch in _rows(whole):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                ids = [e.text(t) if t else np.zeros(0, np.uint32) for t in texts]
                col = pa.array([len(a) for a in ids], pa.int64()) if count else _ids(ids)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], col], names=schema.names)

    giant = F.length(text) > GIANT
    plain = df.filter(~F.coalesce(giant, F.lit(False))).select(*cols, df[text]).mapInArrow(short, schema)

    row = F.struct(*cols) if cols else F.struct(F.lit(0).alias("none"))
    long = df.filter(giant).select(F.monotonically_increasing_id().alias("__row"), row.alias("__kept"), df[text].alias("__text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                for k, (part, goes_on) in enumerate(parts_of(batch.column(2)[i].as_py(), e)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([k], pa.int32()), pa.array([part], pa.binary()), pa.array([goes_on])], names=["__row", "__kept", "k", "part", "goes_on"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            # a part that its follower goes on from is one piece; the follower is, too
            ids = [np.array(e.piece(p), np.uint32) if one else e.text(p.decode()) for p, one in zip(batch.column(3).to_pylist(), pc.or_(batch.column(4), batch.column(5)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), _ids(ids)], names=["__row", "__kept", "k", "goes_on", "ids"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        e = encoder(vocabulary)
        pdf = pdf.sort_values("k")
        done: list[np.ndarray] = []
        piece: list[int] = []
        for goes_on, ids in zip(pdf.goes_on, pdf.ids):
            if goes_on:
                piece = e.join(piece, [int(x) for x in ids])
            else:
                done.append(np.array(piece, np.int32))
                piece = [int(x) for x in ids]
        done.append(np.array(piece, np.int32))
        return pd.DataFrame({"__kept": [pdf["__kept"].iloc[0]], out: [np.concatenate(done)]})

    held = T.StructField("__kept", long.schema["__kept"].dataType)
    cut_schema = T.StructType([T.StructField("__row", T.LongType()), held, T.StructField("k", T.IntegerType()), T.StructField("part", T.BinaryType()), T.StructField("goes_on", T.BooleanType())])
    from pyspark.sql import window as W

    pieces = long.mapInArrow(cut_up, cut_schema)
    pieces = pieces.withColumn("led", F.coalesce(F.lead("goes_on").over(W.Window.partitionBy("__row").orderBy("k")), F.lit(False))).select("__row", "__kept", "k", "part", "goes_on", "led").repartition("__row", "k")
    leaf_schema = T.StructType([*cut_schema.fields[:3], cut_schema["goes_on"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    whole = pieces.mapInArrow(leaves, leaf_schema).groupBy("__row").applyInPandas(joined, T.StructType([held, T.StructField(out, T.ArrayType(T.IntegerType()))]))
    whole = whole.select(*(F.col("__kept")[f.name].alias(f.name) for f in kept), (F.size(out).cast("long") if count else F.col(out)).alias(out))
    return plain.unionByName(whole)
