"""Several values packed in one field: split by delimiters, quotes and brackets.

The text is never handled row by row. Each Arrow batch is one byte buffer; quote parity, nesting and
delimiters are masks over that buffer, the children's offsets follow from the masks, and the list
array made from them is flattened with the ordinals of its parents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_BLANK, _HARD, _QUOTE, _OPEN, _CLOSE = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
for _chars, _kind in ((b" \t\r\n\x0b\x0c", _BLANK), (b",;|/", _HARD), (b"\"'", _QUOTE), (b"([{", _OPEN), (b")]}", _CLOSE)):
    for _c in _chars:
        _KIND[_c] = _kind
_PAIR = np.zeros(256, np.uint8)
_PAIRS = (b"()", b"[]", b"{}", b'""', b"''")
for _a, _b in _PAIRS:
    _PAIR[_a] = _b
#: Bytes in one pass over a batch; longer batches are halved by rows.
_CHUNK = 8 << 20


def _count(data: np.ndarray, byte: int) -> np.ndarray:
    """Cumulative count of byte, with a leading 0."""
    return np.concatenate(([0], np.cumsum(data == byte, dtype=np.int64)))


def _trim(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without blanks at their ends."""
    solid = np.concatenate((np.flatnonzero(_KIND[data] != _BLANK), [len(data)]))
    first = solid[np.searchsorted(solid, start)]
    last = np.searchsorted(solid, end) - 1
    last = np.where(last >= 0, solid[np.maximum(last, 0)] + 1, 0)
    empty = (first >= end) | (start >= end)
    return np.where(empty, start, first), np.where(empty, start, last)


def _unwrap(data: np.ndarray, start: np.ndarray, end: np.ndarray, counts: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the quotes or brackets that enclose the whole of them, three deep at most.

    A pair of quotes encloses a span if it has no other such quote. Brackets enclose it if the closing
    one is the span's last byte and both are odd in number: those of breakends come in twos."""
    for _ in range(3):
        start, end = _trim(data, start, end)
        long = end - start >= 2
        a = data[np.minimum(start, max(len(data) - 1, 0))] if len(data) else np.zeros(len(start), np.uint8)
        b = data[np.maximum(end - 1, 0)] if len(data) else a
        hit = long & (_PAIR[a] == b) & (_PAIR[a] != 0)
        for opens, closes in _PAIRS:
            inside = counts[opens][end] - counts[opens][start]
            alone = inside == 2 if opens == closes else (inside % 2 == 1) & (counts[closes][end] - counts[closes][start] == inside)
            hit &= (a != opens) | alone
        start, end = np.where(hit, start + 1, start), np.where(hit, end - 1, end)
    return _trim(data, start, end)


def split_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows data[offsets[i]:offsets[i + 1]]: row, position from 1, start and end of each value that isn't empty."""
    n = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if n == 0 or len(data) == 0:
        return none, none, none, none
    counts = {c: _count(data, c) for c in b"()[]{}\"'"}
    start, end = _unwrap(data, offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64), counts)
    where = np.arange(len(data))
    row = np.repeat(np.arange(n), np.diff(offsets))
    inside = (where >= start[row]) & (where < end[row])
    # quote parity and depth of <>, both counted from the row's start
    quote = counts[ord('"')]
    quoted = ((quote[1:] - quote[start[row]]) % 2 == 1) | (data == ord('"'))
    odd = (quote[end] - quote[start]) % 2 == 1  # broken quoting protects nothing
    quoted &= ~odd[row]
    less, more = _count(data, ord("<")), _count(data, ord(">"))
    angled = ((less[1:] - less[start[row]]) - (more[1:] - more[start[row]]) > 0) & ((less[end] - less[start]) == (more[end] - more[start]))[row]
    kind = _KIND[data]
    free = ~(quoted | angled)
    solid = np.flatnonzero(inside & ~((kind == _BLANK) & free))
    if not len(solid):
        return none, none, none, none
    hard = ((kind == _HARD) & free)[solid]
    r = row[solid]
    new_row = np.concatenate(([True], r[1:] != r[:-1]))
    gap = np.zeros(len(solid), bool)
    gap[1:] = ~new_row[1:] & (np.diff(solid) > 1) & ~hard[1:] & ~hard[:-1]
    steps = np.cumsum(hard.astype(np.int64) + gap)
    base = np.zeros(n, np.int64)
    base[r[new_row]] = (steps - hard - gap)[new_row]
    piece = steps - base[r]  # a delimiter counts with the piece that it opens
    keep = ~hard
    at, r, piece = solid[keep], r[keep], piece[keep]
    if not len(at):
        return none, none, none, none
    first = np.concatenate(([True], (r[1:] != r[:-1]) | (piece[1:] != piece[:-1])))
    begin = np.flatnonzero(first)
    finish = np.concatenate((begin[1:], [len(at)])) - 1
    vs, ve = _unwrap(data, at[begin], at[finish] + 1, counts)
    full = ve > vs
    return r[begin][full], piece[begin][full] + 1, vs[full], ve[full]


def split_array(text: pa.Array, least: int = 1) -> pa.ListArray:
    """A list of structs (val_pos, val) for each text; rows with fewer than `least` values get an empty list."""
    text = text.cast(pa.large_string())
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "")
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64, n + 1 + text.offset)[text.offset :] if n else np.zeros(1, np.int64)
    raw = text.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    row, pos, start, end = split_spans(data, offsets - offsets[0])
    count = np.bincount(row, minlength=n)
    keep = count[row] >= least
    row, pos, start, end = row[keep], pos[keep], start[keep], end[keep]
    size = end - start
    ends = np.cumsum(size)
    take = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    body = np.ascontiguousarray(data[take])
    val = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64).tobytes()), pa.py_buffer(body.tobytes()))
    lists = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), val.cast(pa.string())], ["val_pos", "val"]))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about _CHUNK bytes."""
    rows = max(1, int(batch.num_rows * _CHUNK / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def split_packed(df: DataFrame, columns: dict[str, str], key: str, least: int = 1, names: tuple[str, str, str, str] = ("fld", "rec_id", "val_pos", "val")) -> DataFrame:
    """One row per value packed in the fields of df: (fld, rec_id, val_pos from 1, val).

    columns: of each field, the name given in fld. key: the column that identifies a row.
    Delimiters are `, ; | /` and blanks; blanks beside another delimiter belong to it. Pieces lose the
    blanks, quotes and brackets that enclose them or the entire field. A delimiter between double quotes
    around one piece, or within <...>, is part of it. Empty pieces keep their place and give no row.
    Null, empty and blank fields give none; a row with a null key gives its values under a null rec_id;
    repeated rows give repeated values; other columns, whatever their names, aren't read.
    least: rows only of fields that hold that many values or more."""
    fields = list(columns)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], kind), T.StructField(names[2], T.IntegerType()), T.StructField(names[3], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                for k, c in enumerate(fields):
                    lists = split_array(batch.column(k + 1), least)
                    parents, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
                    if len(flat):
                        yield pa.RecordBatch.from_arrays([pa.array([columns[c]] * len(flat), pa.string()), batch.column(0).take(parents), flat.field("val_pos"), flat.field("val")], names=list(names))

    return df.select(df[key].alias("__k"), *(df[c].cast("string").alias(f"__v{i}") for i, c in enumerate(fields))).mapInArrow(run, schema)
