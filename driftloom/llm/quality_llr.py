"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Byte 4-grams are hashed into 2^BITS buckets. Each language (column lang; without that column
all documents are one) has two multinomials over buckets, with one added to each count: the raw one
from all its documents, the target one from the texts of its trusted rows, of which at most
SAMPLE are taken over all languages (labels with quality 1, in the order of a hash of doc_id). A
document's verdict is the mean over its 4-grams of log(target / raw) in its language; at LEAST or
more it is kept. A trusted document is judged by the target without its own 4-grams. Where the
target has fewer than LEAST_GRAMS 4-grams of other documents it says nothing of the language: the
ratio is 0 and the base decides. Counts are summed over all tasks; only totals of languages
with trusted rows reach the driver, 2^BITS for each multinomial.

Base figures, words being [^\\x20\\x09-\\x0D]+: n_words; word_chars, code points in words;
n_symbols, characters of [#*$%&|<>]; n_dup_lines, lines with a word that equal an earlier
line; n_repeat_words, words in 5-word windows found twice or more in the text. base_failed
if n_words < 10 or 100 * n_repeat_words > 20 * n_words; kept is false then.

Null text has no words, so fails; a text of under 4 bytes has ratio 0; null lang is a language of its
own; without trusted rows every ratio is 0 and the base decides; repeated rows are judged alike; null
doc_id stays null and is never trusted; a very long text is a slice of its own, and memory follows it; other columns are
ignored (filter_documents keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.arrowkit import COUNTS, IS_SPACE, U, Words, byte_grams, count_rows, mix, releasing, slices, small_batches, span_sums, summed_counts, text_bytes

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
GRAM, BITS = 4, 14
#: Most trusted rows that the target multinomial is fitted on.
SAMPLE = 20_000
#: 4-grams of other documents that a target must have to judge by.
LEAST_GRAMS = 4 << BITS
#: Documents with a lower mean log-likelihood ratio are rejected.
LEAST = -0.25
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
SPACES = " \t\n\x0b\x0c\r"


def repeat_words(words: Words) -> np.ndarray:
    """For each document the words that lie in a window found twice or more in it."""
    n, m = len(words.first) - 1, len(words.hash)
    hashes, whole = words.shingles(WINDOW)
    if not len(hashes):
        return np.zeros(n, np.int64)
    at = np.flatnonzero(whole)
    keys = hashes[at] ^ mix(words.doc[at].astype(np.uint64) + U(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(m + 1, np.int64)
    hits = at[twice]
    edge[hits] += 1
    np.subtract.at(edge, hits + WINDOW, 1)
    covered = np.cumsum(edge[:m]) > 0
    return span_sums(covered.astype(np.int64), words.first[:-1], words.first[1:])


def dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


class Model:
    """Counts of each language's two multinomials, by the language's name."""

    def __init__(self, counts: dict[str, np.ndarray], least_grams: int = LEAST_GRAMS):
        self.least_grams = least_grams
        self.target = {k[1:]: v for k, v in counts.items() if k[0] == "t" and v.sum() >= least_grams}
        raw = {k[1:]: v for k, v in counts.items() if k[0] == "r"}
        self.raw = {k: np.log((raw[k] + 1) / (raw[k].sum() + len(raw[k]))) for k in self.target}
        self.ratio = {k: np.log((v + 1) / (v.sum() + len(v))) - self.raw[k] for k, v in self.target.items()}

    def without(self, lang: str, grams: np.ndarray) -> float:
        """Mean log-ratio of a trusted document, its own grams taken out of the target."""
        rest = self.target[lang].sum() - len(grams)
        if rest < self.least_grams or not len(grams):
            return 0.0
        at, n = np.unique(grams, return_counts=True)
        target = np.log((self.target[lang][at] - n + 1) / (rest + len(self.target[lang])))
        return float((n * (target - self.raw[lang][at])).sum() / len(grams))

    def ratios(self, data: np.ndarray, at: np.ndarray, langs: list[str], trusted: list[bool]) -> np.ndarray:
        grams = byte_grams(data, GRAM, BITS)
        begin = np.minimum(at[:-1], len(grams))
        end = np.maximum(begin, np.minimum(at[1:] - GRAM + 1, len(grams)))
        llr = np.zeros(len(begin))
        names = np.array(langs, dtype=object)
        for lang in set(langs) & self.ratio.keys():
            rows = np.flatnonzero(names == lang)
            mine = np.repeat(names == lang, np.diff(np.append(begin, len(grams)))) if len(rows) < len(names) else slice(None)
            scores = np.zeros(len(grams))
            scores[mine] = self.ratio[lang][grams[mine]]
            llr[rows] = (span_sums(scores, begin, end) / np.maximum(end - begin, 1))[rows]
        for i in np.flatnonzero(trusted):
            if langs[i] in self.ratio:
                llr[i] = self.without(langs[i], grams[begin[i] : end[i]])
        # so that equal texts have equal ratios wherever they stand
        return np.round(llr, 6)


def judge(column: pa.Array, langs: list[str], trusted: list[bool], model: Model) -> dict[str, np.ndarray]:
    """All figures of a slice of texts."""
    data, at = text_bytes(column)
    begin, end = at[:-1], at[1:]
    words = Words(data, at, lower=False)
    n_words = np.diff(words.first)
    letters = ~IS_SPACE[data] & ((data & 0xC0) != 0x80)
    repeated = repeat_words(words)
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    llr = model.ratios(data, at, langs, trusted)
    whole = data.tobytes()
    return {
        "n_words": n_words,
        "word_chars": span_sums(letters.astype(np.int64), begin, end),
        "n_symbols": span_sums(IS_SYMBOL[data].astype(np.int64), begin, end),
        "n_dup_lines": np.fromiter((dup_lines(whole[a:b].decode("utf-8", "replace")) for a, b in zip(begin.tolist(), end.tolist())), np.int64, len(begin)),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": ~failed & (llr >= LEAST),
        "llr": llr,
    }


def marked(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Adds __quality_lang (empty for null) and __quality_trusted. The trusted rows, sample at most, are broadcast."""
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("__quality_id"), F.lit(True).alias("__quality_trusted"))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.withColumn("__quality_lang", lang).join(F.broadcast(trusted), F.col("doc_id") == F.col("__quality_id"), "left").withColumn("__quality_trusted", F.coalesce("__quality_trusted", F.lit(False))).drop("__quality_id")


def fit(docs: DataFrame, labels: DataFrame, least_grams: int = LEAST_GRAMS) -> Model:
    """The multinomials of all languages with trusted rows."""
    small_batches(docs.sparkSession)
    rows = marked(docs, labels)
    # at most as many languages as trusted rows
    known = sorted(r[0] for r in rows.where("__quality_trusted").select("__quality_lang").distinct().collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            data, at = text_bytes(batch.column(0))
            grams = byte_grams(data, GRAM, BITS)
            inside = np.ones(len(grams), dtype=bool)
            for i in range(1, GRAM):
                edge = at[1:-1] - i
                inside[edge[(edge >= 0) & (edge < len(grams))]] = False
            langs = batch.column(1).to_pylist()
            trusted = np.repeat(np.array(batch.column(2).to_pylist(), dtype=bool), np.diff(at))[: len(grams)]
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            which = np.repeat(np.array([number[x] for x in langs]), np.diff(at))[: len(grams)]
            for kind, pick in (("r", inside), ("t", inside & trusted)):
                both = np.bincount((which[pick] << BITS) + grams[pick], minlength=len(names) << BITS).reshape(len(names), -1)
                for x, v in zip(names, both):
                    counts[kind + x] = counts.get(kind + x, 0) + v
        if counts:
            yield count_rows(counts, TaskContext.get().partitionId())

    if not known:
        return Model({}, least_grams)
    texts = rows.where(F.col("__quality_lang").isin(known)).select("text", "__quality_lang", "__quality_trusted")
    return Model(summed_counts(texts.mapInArrow(releasing(count), COUNTS), 1 << BITS), least_grams)


def quality_rules(docs: DataFrame, labels: DataFrame, least_grams: int = LEAST_GRAMS) -> DataFrame:
    """Figures and verdict of every document; see above."""
    model = fit(docs, labels, least_grams)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = judge(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), model)
            yield pa.record_batch([batch.column(0), *map(pa.array, out.values())], names=["doc_id", *out])

    return marked(docs, labels).select("doc_id", "text", "__quality_lang", "__quality_trusted").mapInArrow(releasing(work), SCHEMA)


def filter_documents(docs: DataFrame, labels: DataFrame, least_grams: int = LEAST_GRAMS) -> DataFrame:
    """The documents kept, with all their columns."""
    model = fit(docs, labels, least_grams)
    at, n = docs.columns.index("text"), len(docs.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept = judge(batch.column(at), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), model)["kept"]
            yield batch.select(list(range(n))).filter(pa.array(kept))

    return marked(docs, labels).mapInArrow(releasing(work), docs.schema)
