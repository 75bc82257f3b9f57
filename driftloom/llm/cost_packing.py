"""Cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs n + n^2 / capacity (the linear layers and the attention within
the piece). Each run of about RUN_TOKENS tokens is packed on its own, in the map task that
tokenised it, so nothing is shuffled. A run opens as many sequences as its tokens fill. Documents go,
in descending length, to the sequence of lowest cost that still has room for all of it; one longer
than a sequence is cut to fill sequences first. Room of GAP tokens or more that is left is filled, lowest cost
first, by cutting documents for which no sequence had room; smaller room stays and is padded. What is
left of the documents goes to the next run, and at a task's end to further sequences, so only a
task's last one may be far from full.

Result for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
and sequence_tokens (before padding). A document's ids are those of the library followed by end_id; null and
empty texts have end_id alone. Repeated rows are packed as documents of their own; null
doc_id stays null; a very long text is tokenised whole, and memory follows it; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from driftloom.llm.arrowkit import no_gc, releasing, slices, small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
CAPACITY, END_ID = 4096, 2
#: Tokens that are packed together: about five hundred sequences.
RUN_TOKENS = 1 << 21
#: A sequence is padded by fewer tokens than this, but for a task's last.
GAP = 24
MOST_WORDS = 400_000
#: Words that go to the library as one text.
JOINED = 256
#: Fixed value: how the vocabulary's file splits lower-cased text, for Latin-1 characters.
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^ \t-\r\x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
ASCII_SPACE = re.compile(r"[ \t-\r]+")


class WordIds:
    """Ids of texts by the tokenizers library, called once for each distinct word.

    No token of this vocabulary spans white space, so a text's ids are those of its
    words one after another. Latin-1 texts are cut as the vocabulary's file says; others
    only at ASCII white space, and the library does the rest.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.ids: dict[str, bytes] = {"": b""}

    def learn(self, words: list[str]) -> None:
        """Adds words of Latin-1 texts: each has one token that ends a word, so many go to the library as one text."""
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        codes = [np.array(c.ids, dtype="<u4") for c in self.library.encode_batch(texts, add_special_tokens=False)]
        if not codes:
            return
        ids = np.concatenate(codes)
        stops = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        whole = ids.tobytes()
        for word, i, j in zip(words, stops[:-1], stops[1:], strict=True):
            self.ids[word] = whole[i:j]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut, plain, odd = [], set(), set()
        for text in texts:
            try:
                if any(s in text for s in self.special):
                    raise ValueError
                text.encode("latin-1")
                words = LATIN_WORDS.findall(text.lower())
                plain.update(words)
            except ValueError:
                words = ASCII_SPACE.split(text)
                odd.update(words)
            cut.append(words)
        new, far = plain - self.ids.keys(), odd - self.ids.keys()
        if len(self.ids) + len(new) + len(far) > MOST_WORDS:
            self.ids.clear()
            new, far = plain, odd
        self.learn(list(new))
        far = list(far - new)
        for word, code in zip(far, self.library.encode_batch(far, add_special_tokens=False), strict=True):
            self.ids[word] = np.array(code.ids, dtype="<u4").tobytes()
        get = self.ids.__getitem__
        return [b"".join(map(get, ws)) for ws in cut]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pack_run(lengths: np.ndarray, capacity: int = CAPACITY, gap: int = GAP) -> tuple[list[tuple[int, int, int, int, int]], list[int], np.ndarray]:
    """Pieces (document, start, length, sequence, offset) of one run, tokens in each sequence, and how many tokens of each document are placed."""
    room = np.full(max(1, int(lengths.sum()) // capacity), capacity, dtype=np.int64)
    cost = np.zeros(len(room))
    done = np.zeros(len(lengths), np.int64)
    pieces = []

    def put(doc: int, k: int, n: int) -> None:
        pieces.append((int(doc), int(done[doc]), n, k, capacity - int(room[k])))
        room[k] -= n
        cost[k] += n + n * n / capacity
        done[doc] += n

    opened = 0
    for doc in np.argsort(-lengths, kind="stable"):
        while lengths[doc] - done[doc] >= capacity and opened < len(room):
            put(doc, opened, capacity)
            opened += 1
    waiting = []
    for doc in np.argsort(done - lengths, kind="stable"):
        left = int(lengths[doc] - done[doc])
        fits = room >= left
        if not left:
            continue
        if fits.any():
            put(doc, int(np.argmin(np.where(fits, cost, np.inf))), left)
        else:
            waiting.append(doc)
    for doc in waiting:
        while left := int(lengths[doc] - done[doc]):
            fits = room >= min(gap, left)
            if not fits.any():
                break
            k = int(np.argmin(np.where(fits, cost, np.inf)))
            put(doc, k, min(left, int(room[k])))
    return pieces, (capacity - room).tolist(), done


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs all documents; see above. path: a word-end BPE file of the tokenizers library, there on every machine."""
    end = end_id.to_bytes(4, "little")
    small_batches(docs.sparkSession)

    def run(held: list[tuple]) -> tuple[pa.RecordBatch, int, list[tuple]]:
        """Pieces, their sequences numbered from 0, how many sequences, and what is left. held: doc_id, ids and tokens placed before of each document."""
        lengths = np.fromiter((len(c) // 4 - at for _, c, at in held), np.int64, len(held))
        pieces, sizes, done = pack_run(lengths, capacity)
        doc, start, length, k, offset = np.array(pieces, dtype=np.int64).reshape(-1, 5).T
        before = np.fromiter((at for _, _, at in held), np.int64, len(held))
        start = start + before[doc]
        crc = [zlib.crc32(memoryview(held[d][1])[4 * s : 4 * (s + n)]) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
        whole = np.fromiter((len(c) // 4 for _, c, _ in held), np.int64, len(held))
        columns = [pa.array([held[d][0] for d in doc], pa.int64()), start, length, np.array(crc, np.int64), whole[doc], k, offset, np.array(sizes, np.int64)[k]]
        left = [(i, c, at + int(d)) for (i, c, at), d, n in zip(held, done, lengths) if d < n]
        return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=NAMES), len(sizes), left

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[tuple] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal held, tokens, first
            out, n, held = run(held)
            at = NAMES.index("sequence_id")
            out = out.set_column(at, "sequence_id", pc.add(out.column(at), first))
            tokens = sum(len(c) // 4 - k for _, c, k in held)
            first += n
            return out

        for batch in slices(batches, "text"):
            with no_gc():
                codes = [c + end for c in words.encode_batch([t or "" for t in batch.column(1).to_pylist()])]
            held += [(i, c, 0) for i, c in zip(batch.column(0).to_pylist(), codes)]
            tokens += sum(map(len, codes)) // 4
            if tokens >= RUN_TOKENS:
                yield packed()
        while held:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(releasing(work), SCHEMA)
