"""Subject areas of documents: sentences in a latent space of weighted terms, assigned to refined seed centroids.

Terms are weighted by rarity and by how unevenly they fall on the subjects; a truncated singular value
decomposition of the sentence-term matrix (randomized subspace iteration, its products summed over the
whole corpus by all tasks) gives the space. Labelled documents seed a centroid for each subject and language, all
sentences near enough refine them, and weights, space and centroids are fitted once more to what came out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release, small
from .mail import own_sentences

#: Sentences that a term must be in; dimensions of the space.
LEAST_SENTENCES, DIMENSIONS = 3, 64
#: Most subjects that are told apart; more are an error.
MOST_SUBJECTS = 1000
#: Passes of the decomposition, of the refinement, and rounds of the whole.
PASSES, REFINEMENTS, ROUNDS = 2, 2, 3
#: A term in one of so many sentences or fewer has full rarity: shares count, so a larger corpus doesn't make all terms common.
RAREST = 10_000
#: Words and bearing terms that a sentence must have to be about a subject, least weight of a bearing term, and least cosine.
LEAST_WORDS, LEAST_TERMS, BEARING, LEAST_COSINE = 4, 2, 0.25, 0.3
_WORD = re.compile(r"[^\W\d_]{2,}")
#: Rows of a block of a sum of matrices, and parts that a task adds up.
_BLOCK, _FAN_IN = 1024, 64


def sentences(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc, lang, words): of every document the words of each own sentence that has LEAST_WORDS or more; whole texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * (8 << 20) / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                texts = batch.column(2).to_pylist()
                said = [[w for x in own_sentences(t) if len(w := _WORD.findall(x.lower())) >= LEAST_WORDS] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.list_(pa.list_(pa.string())))], names=[doc, "lang", "words"])

    short = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(lang), F.lit("")))), r"^([a-z]{2})(?![a-z])", 1)
    kind = dict(docs.dtypes)[doc]
    return docs.filter(F.col(text).isNotNull() & (F.length(text) > 0)).select(doc, short.alias("lang"), text).mapInArrow(run, f"`{doc}` {kind}, lang string, words array<array<string>>")


@dataclass
class Model:
    """Weights of the terms, their places in the space, and the centroids with their subjects."""

    weight: np.ndarray
    space: np.ndarray
    centroids: np.ndarray
    of: np.ndarray

    def embed(self, flat: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of n sentences (0 for those without weight), and how many different bearing terms each has."""
        keep = self.weight[flat] >= BEARING
        flat, row = flat[keep], row[keep]
        x = _sums((self.space * self.weight[:, None])[flat], row, n)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.maximum(norm, 1e-9), np.bincount(row, minlength=n)

    def assign(self, flat: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each sentence the centroid that it is assigned to, or -1; and the unit vectors."""
        x, terms = self.embed(flat, row, n)
        if not len(self.centroids):
            return np.full(n, -1), x
        cos = x @ self.centroids.T
        best = cos.argmax(1)
        return np.where((cos[np.arange(n), best] >= LEAST_COSINE) & (terms >= LEAST_TERMS), best, -1), x


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values' rows by `row`, which ascends: neighbours of one sum are added in pairs until each is one."""
    out = np.zeros((n, values.shape[1]), np.float32)
    while len(row):
        place = np.arange(len(row))
        first = np.concatenate(([True], row[1:] != row[:-1]))
        if first.all():
            break
        even = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
        kept = np.flatnonzero(even)
        paired = np.flatnonzero(~even[np.minimum(kept + 1, len(row) - 1)])
        x = values[kept]
        x[paired] += values[kept[paired] + 1]
        values, row = x, row[kept]
    out[row] = values
    return out


def _tokens(docs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents as lists of sentences: the terms, the sentence of each term, and the document of each sentence."""
    said = pc.list_flatten(docs)
    return np.asarray(pc.list_flatten(said)), np.asarray(pc.list_parent_indices(said)), np.asarray(pc.list_parent_indices(docs))


def _gathered(table: DataFrame, columns: list[str], kernel: object, rows: int, width: int) -> np.ndarray:
    """The sum over the table of matrices (rows, width) that kernel adds to for each batch: by blocks of rows, in all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rows, width), np.float64)
        for batch in batches:
            kernel(batch, total)
        for at in range(0, rows, _BLOCK):
            part = total[at : at + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.astype(np.float32).tobytes()])], names=["at", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf.part.iloc[0]) // 4)
        for x in pdf.part:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "k": [pdf["k"].iloc[0]], "part": [total.astype(np.float32).tobytes()]})

    parts = table.select(*columns).mapInArrow(run, "at int, part binary").withColumn("k", F.spark_partition_id())
    # whatever the number of tasks, none adds more than _FAN_IN parts of a block, and the driver gets a block once
    left = table.rdd.getNumPartitions()
    while True:
        left = math.ceil(left / _FAN_IN)
        parts = parts.withColumn("k", F.expr(f"k div {_FAN_IN}"))
        parts = parts.groupBy("at", "k").applyInPandas(add, "at int, k long, part binary")
        if left <= 1:
            break
    out = np.zeros((rows, width))
    for r in parts.collect():  # rows * width floats
        x = np.frombuffer(r.part, np.float32).reshape(-1, width)
        out[r["at"] : r["at"] + len(x)] += x
    return out


def _weights(counts: np.ndarray, frequency: np.ndarray, n: int) -> np.ndarray:
    """Rarity times unevenness over the subjects, from 0 to about 1; terms seen too seldom with subjects have none.

    From 50 * RAREST sentences on, rarity goes by a term's share of them alone."""
    share = counts / np.maximum(counts.sum(0), 1)
    p = share / np.maximum(share.sum(1, keepdims=True), 1e-12)
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    # an entropy from few sightings is too low by about (subjects - 1) / (2 sightings)
    seen = counts.sum(1)
    entropy += (counts.shape[1] - 1) / (2 * np.maximum(seen, 0.5))
    uneven = np.clip(1 - entropy / math.log(max(counts.shape[1], 2)), 0, 1)
    rare = np.log(n / frequency)
    return (uneven * np.minimum(rare / math.log(max(min(n / 50, RAREST), 3)), 1)).astype(np.float32)


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: list[str], doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc, subject): the subjects that at least one own sentence of a document is about; no row for a document with none.

    labels: (doc, subject), known subjects of some documents, a few of which may be wrong; subjects that aren't
    in `subjects` don't count. Null, empty and blank texts have no subject, nor has anything if there are no
    labels or no texts; repeated documents give repeated evidence but one row per document and subject."""
    if len(subjects) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc]
    none = spark.createDataFrame([], f"`{doc}` {kind}, subject string")
    said = cut(sentences(docs, doc, text, lang))
    n = said.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    vocabulary = said.select(F.explode("words").alias("words")).select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_SENTENCES).orderBy(F.col("n").desc(), "w").collect()
    if not vocabulary or not subjects:
        return none
    terms = pa.array([r.w for r in vocabulary])
    frequency = np.array([r.n for r in vocabulary], float)
    place = {s: i for i, s in enumerate(subjects)}
    known = labels.filter(F.col("subject").isin(subjects)).select(F.col(doc).alias("__doc"), "subject").distinct().groupBy("__doc").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    joined = said.join(small(known), said[doc] == F.col("__doc"), "left").select(doc, "lang", "words", "labels")

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said_here = pc.list_flatten(batch.column(2))
            ids, row = pc.index_in(pc.list_flatten(said_here), terms), pc.list_parent_indices(said_here)
            here = pc.is_valid(ids)
            # a term counts once in a sentence
            both = np.unique(np.asarray(row.filter(here)).astype(np.int64) * len(terms) + np.asarray(ids.filter(here)))
            ids, row = pa.array((both % len(terms)).astype(np.int32)), both // len(terms)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(said_here))))).astype(np.int32)
            per_doc = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(batch.column(2)))))).astype(np.int32)
            nested = pa.ListArray.from_arrays(pa.array(per_doc), pa.ListArray.from_arrays(pa.array(offsets), ids))
            marks = pa.array([None if x is None else [place[s] for s in x] for x in batch.column(3).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nested, marks], names=[doc, "lang", "ids", "labels"])

    table = cut(joined.mapInArrow(to_ids, f"`{doc}` {kind}, lang string, ids array<array<int>>, labels array<int>"))
    release(said)
    marked = table.filter(F.col("labels").isNotNull())
    # two letters each, so they are few; the last place is the other languages'
    langs = sorted(r.lang for r in marked.filter((F.col("lang") != "") & F.exists("ids", lambda x: F.size(x) > 0)).select("lang").distinct().collect()) + [""]
    v, s = len(terms), len(subjects)
    tongue = {x: i for i, x in enumerate(langs)}

    def seen_with_labels(batch: pa.RecordBatch, total: np.ndarray) -> None:
        flat, row, of_doc = _tokens(batch.column(0))
        _count(total, flat, _label_shares(batch.column(1), s)[of_doc][row])

    said_by_labels = counts = _gathered(marked, ["ids", "labels"], seen_with_labels, v, s)
    if not counts.any():
        return none
    rng = np.random.default_rng(5)
    model = Model(np.zeros(v, np.float32), np.zeros((v, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, int))
    for round_ in range(ROUNDS):
        weight = _weights(counts, frequency, n)
        heavy = cut(table.select("lang", "labels", "ids").mapInArrow(_bearing(weight), "lang string, labels array<int>, ids array<array<int>>"))
        space = np.linalg.qr(rng.normal(size=(v, min(DIMENSIONS, v))) * (weight >= BEARING)[:, None])[0].astype(np.float32) if round_ == 0 else model.space
        for _ in range(PASSES):
            space = np.linalg.qr(_gathered(heavy, ["ids"], _product(weight, space), v, space.shape[1]))[0].astype(np.float32)
        blank = Model(weight, space, np.zeros((0, space.shape[1]), np.float32), np.zeros(0, int))
        if round_ == 0:
            sums = _gathered(heavy.filter(F.col("labels").isNotNull()), ["ids", "lang", "labels"], _seed_sums(blank, tongue, s), s * len(langs), space.shape[1])
            model = _centred(blank, sums, len(langs))
        else:
            # the old space's assignment carries over: its centroids are sums of sentences, made anew in this one
            sums = _gathered(table, ["ids", "lang"], _assigned_sums(model, blank, tongue), s * len(langs), space.shape[1])
            model = _centred(blank, sums, len(langs))
        for _ in range(REFINEMENTS):
            model = _centred(model, _gathered(heavy, ["ids", "lang"], _assigned_sums(model, model, tongue), s * len(langs), space.shape[1]), len(langs))
        release(heavy)
        if round_ < ROUNDS - 1:
            counts = said_by_labels + _gathered(table, ["ids"], _term_counts(model), v, s)  # by what else is said in the same document

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(subjects)
        for batch in batches:
            flat, row, of_doc = _tokens(batch.column(1))
            best, _ = model.assign(flat, row, len(of_doc))
            hit = np.flatnonzero(best >= 0)
            cases = np.unique(of_doc[hit].astype(np.int64) * s + model.of[best[hit]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cases // s)), names.take(pa.array(cases % s))], names=[doc, "subject"])

    return table.select(doc, "ids").mapInArrow(decide, f"`{doc}` {kind}, subject string").distinct()


def _label_shares(labels: pa.Array, s: int) -> np.ndarray:
    """Of each document how its labels divide it among the subjects."""
    out = np.zeros((len(labels), s))
    marks = pc.fill_null(pc.list_value_length(labels), 0)
    at = np.repeat(np.arange(len(labels)), np.asarray(marks))
    out[at, np.asarray(pc.list_flatten(labels))] = 1
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def _count(total: np.ndarray, flat: np.ndarray, shares: np.ndarray) -> None:
    """Adds to each term's counts the shares of where it stands."""
    for m in range(total.shape[1]):
        total[:, m] += np.bincount(flat, shares[:, m], minlength=len(total))


def _bearing(weight: np.ndarray) -> object:
    """Documents (lang, labels, ids) with none but their bearing terms, without the sentences that have too few of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row, of_doc = _tokens(batch.column(2))
            keep = weight[flat] >= BEARING
            n = np.bincount(row[keep], minlength=len(of_doc))
            said = n >= LEAST_TERMS
            keep &= said[row]
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[said]))).astype(np.int32)), pa.array(flat[keep]))
            outer = np.concatenate(([0], np.cumsum(np.bincount(of_doc[said], minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(outer), inner)], names=["lang", "labels", "ids"])

    return run


def _product(weight: np.ndarray, space: np.ndarray) -> object:
    """Adds X'X space, X the weighted sentence-term matrix."""

    def kernel(batch: pa.RecordBatch, total: np.ndarray) -> None:
        flat, row, of_doc = _tokens(batch.column(0))
        keep = weight[flat] >= BEARING
        flat, row = flat[keep], row[keep]
        if not len(flat):
            return
        y = _sums((space * weight[:, None])[flat], row, len(of_doc))
        # a stable sort of 16-bit numbers is a radix sort; the vocabulary fits
        order = np.argsort(flat.astype(np.uint16 if len(weight) < 1 << 16 else np.int32), kind="stable")
        total += _sums(y[row[order]], flat[order], len(weight)) * weight[:, None]

    return kernel


def _seed_sums(model: Model, tongue: dict[str, int], s: int) -> object:
    """Sums of the labelled documents' sentences, by subject and language."""

    def kernel(batch: pa.RecordBatch, total: np.ndarray) -> None:
        flat, row, of_doc = _tokens(batch.column(0))
        x, _ = model.embed(flat, row, len(of_doc))
        shares, at = _label_shares(batch.column(2), s)[of_doc], _places(batch.column(1), tongue)[of_doc]
        for m in range(s):
            hit = np.flatnonzero(shares[:, m] > 0)
            np.add.at(total, m * len(tongue) + at[hit], x[hit] * shares[hit, m : m + 1])

    return kernel


def _places(langs: pa.Array, tongue: dict[str, int]) -> np.ndarray:
    """Each document's language; those without a place of their own share the last."""
    return np.asarray(pc.index_in(langs, pa.array(list(tongue))).fill_null(len(tongue) - 1))


def _assigned_sums(by: Model, into: Model, tongue: dict[str, int]) -> object:
    """Sums in the space of `into` of the sentences that `by` assigns, by subject and language."""

    def kernel(batch: pa.RecordBatch, total: np.ndarray) -> None:
        flat, row, of_doc = _tokens(batch.column(0))
        best, x = by.assign(flat, row, len(of_doc))
        if into is not by:
            x, _ = into.embed(flat, row, len(of_doc))
        at = _places(batch.column(1), tongue)[of_doc]
        hit = np.flatnonzero(best >= 0)
        np.add.at(total, by.of[best[hit]] * len(tongue) + at[hit], x[hit])

    return kernel


def _term_counts(model: Model) -> object:
    """Counts each term with the subjects of the other sentences of its document: what a term always says of itself proves nothing."""

    def kernel(batch: pa.RecordBatch, total: np.ndarray) -> None:
        flat, row, of_doc = _tokens(batch.column(0))
        best, _ = model.assign(flat, row, len(of_doc))
        own = np.zeros((len(of_doc), total.shape[1]))
        hit = np.flatnonzero(best >= 0)
        own[hit, model.of[best[hit]]] = 1
        others = _sums(own.astype(np.float32), of_doc, batch.num_rows)[of_doc] - own
        _count(total, flat, (others / np.maximum(others.sum(1, keepdims=True), 1))[row])

    return kernel


def _centred(model: Model, sums: np.ndarray, langs: int) -> Model:
    norm = np.linalg.norm(sums, axis=1)
    keep = np.flatnonzero(norm > 1e-6)
    return Model(model.weight, model.space, (sums[keep] / norm[keep, None]).astype(np.float32), keep // langs)
