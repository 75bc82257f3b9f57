"""Language identification with error-correcting output codes.

Each language learned has a codeword of bits. For each bit a binary naive Bayes classifier
over hashed byte trigrams (A-Z lower-cased, all bytes but letters and those above 127 as
spaces) tells languages with a 1 from those with a 0; its margin on a text is the mean
log-ratio of the text's trigrams times MARGIN. Decoding adds, over bits, the logistic loss of
the margin against each codeword's bit, and takes the language with the least loss. score
is 1 - least / second least; below AMBIGUOUS the prediction is flagged. The code has
10 log2(k) distinct splits of the k languages in two, or all there are.

Counts are taken over all training documents: those with text and lang whose crc32(doc_id
as text) mod 4 is not 2. Only a vector of fixed size for each language reaches the driver.

Result for each document: doc_id, held_out, lang_pred, score, ambiguous. lang_pred is und
with score 0 where text is null or has no letter (Unicode category L), or nothing could be learned. With one
language learned it is that, with score 1. Ties go to the first language by name; repeated
rows are predicted alike; null doc_id is not held out and not learned from; a very long text is a
slice of its own, and memory follows it; other columns are ignored (filter_documents keeps them).
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.arrowkit import COUNTS, byte_grams, count_rows, releasing, slices, small_batches, span_sums, summed_counts, text_bytes

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
GRAM, BITS = 3, 14
MARGIN, AMBIGUOUS = 4.0, 0.05
#: Letters and bytes of other scripts; all else is a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1, all different: columns are distinct splits of the languages in two, drawn in a seeded order."""
    width = min((1 << (k - 1)) - 1, math.ceil(10 * math.log2(k)))
    rng = random.Random(k)
    while True:
        splits: dict[int, None] = {}
        while len(splits) < width:
            splits.setdefault(rng.getrandbits(k - 1) << 1)
            splits.pop(0, None)
        code = np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(k)], dtype=np.float64)
        if len(np.unique(code, axis=0)) == k:
            return code


def grams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram, range of each document's, and the texts' bytes per document's range."""
    data, at = text_bytes(column)
    grams = byte_grams(FOLD[data], GRAM, BITS)
    begin = np.minimum(at[:-1], len(grams))
    end = np.minimum(np.maximum(at[1:] - GRAM + 1, at[:-1]), len(grams))
    return grams, begin, np.maximum(begin, end), data


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        k = len(self.langs)
        self.code = codewords(k) if k > 1 else np.zeros((k, 0))
        # each language counts alike, so that common ones don't outweigh rare ones
        share = [(counts[x] + 0.5) / (counts[x].sum() + 0.5 * len(counts[x])) for x in self.langs]
        self.weights = []
        for bit in self.code.T:
            one, zero = (np.mean([s for s, b in zip(share, bit) if b == sign], axis=0) for sign in (1, -1))
            self.weights.append(np.log(one / zero))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        grams, begin, end, data = grams_of(column)
        n, k = len(begin), len(self.langs)
        size = np.maximum(end - begin, 1)
        texts = None
        letters = (FOLD[data] > 32) & (data < 128)
        _, at = text_bytes(column)
        und = span_sums(letters.astype(np.int64), at[:-1], at[1:]) == 0
        for i in np.flatnonzero(und):
            texts = column[int(i)].as_py()
            und[i] = not any(map(str.isalpha, texts or ""))
        if not k:
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        if k == 1:
            best, score = np.zeros(n, np.int64), np.ones(n)
        else:
            margins = np.stack([np.round(span_sums(w[grams], begin, end) / size, 6) for w in self.weights], axis=1) * MARGIN
            loss = np.stack([np.logaddexp(0, -margins * c).sum(1) for c in self.code], axis=1)
            order = np.sort(loss, axis=1)
            best, score = np.argmin(loss, axis=1), 1 - order[:, 0] / order[:, 1]
        score = np.where(und, 0.0, np.clip(score, 0, 1))
        return ["und" if u else self.langs[b] for u, b in zip(und, best)], score, score < AMBIGUOUS


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(~held_out()).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            grams, begin, end, _ = grams_of(batch.column(0))
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            which = np.repeat(np.array([number[x] for x in langs]), end - begin)
            inside = np.zeros(len(grams) + 1, np.int64)
            np.add.at(inside, begin, 1)
            np.subtract.at(inside, end, 1)
            picked = grams[np.cumsum(inside[:-1]) > 0].astype(np.int64)
            both = np.bincount(which * (1 << BITS) + picked, minlength=len(names) << BITS).reshape(len(names), -1)
            for x, v in zip(names, both):
                counts[x] = counts[x] + v if x in counts else v
        if counts:
            yield count_rows(counts, TaskContext.get().partitionId())

    return Model(summed_counts(rows.mapInArrow(releasing(count), COUNTS), 1 << BITS))


def predict_languages(docs: DataFrame) -> DataFrame:
    """A prediction for every document; see above."""
    model = fit(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, score, ambiguous = model.predict(batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(score), pa.array(ambiguous)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(releasing(work), SCHEMA)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents in a language that was learned, with all their columns; those without one, or between two, go. Where nothing could be learned, all stay."""
    model = fit(docs)
    if not model.langs:
        return docs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, _, ambiguous = model.predict(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(np.array([x != "und" for x in langs], dtype=bool) & ~ambiguous))

    return docs.mapInArrow(releasing(work), docs.schema)
