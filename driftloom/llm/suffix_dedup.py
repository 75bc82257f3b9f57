"""Removal of repeated 50-byte strings across documents, by deep-shallow sorting of sampled suffixes.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id;
strings are judged on the input. Work is dealt out by content: the lowest-hashed 8 bytes of a
string (its anchor, the leftmost of equal ones) depend on the string alone, so equal strings
meet wherever they stand. Consecutive strings with one anchor travel as one record, at most
42 bytes to the left of the anchor and 50 from it on.

1. Map tasks cut their texts into records. Of equal records in a flush one of the least doc_id
   is sent on, with the places of that document's other ones; those of larger doc_ids are already
   decided. So what a flush sends of a string that a third of all documents hold is one record.
   Anchors that many records share, in whatever surroundings, are learned from every HOT_SAMPLEth text (by a
   hash) beforehand; that changes no result. Their records are cut in two at most, by the 28 or 30 bytes
   that all strings of a part have in common, and dealt out by these.
2. Each anchor's records (or, of a hot one, those of equal 28 or 30 bytes) meet in a bucket, where equal ones are folded again. What goes of a record goes
   at all its places. Strings whose 28 or 30 bytes around
   the anchor stand in one document only can't repeat and drop out. The suffixes of the others are
   ordered: a multikey quicksort on 8 bytes at a time splits all open groups down to SHALLOW bytes,
   then a blind trie orders each group that still has a common prefix. Neighbours with 50 equal
   bytes form a class; in all documents but its least the string goes.
3. Runs of removed bytes and the documents meet by doc_id; what is left is put together there.

Result for each row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.
Null text counts as empty. A row with null doc_id keeps all and removes nothing. Rows with the
same doc_id don't remove each other's bytes; each has runs of its own, told apart by 32 bits of a
hash of the text. Other columns are ignored
(dedup_documents keeps them). Memory follows SLICE_BYTES, the longest document and the buckets, of
which there are as many as four times the shuffle partitions.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.arrowkit import U, cut_lineage, dropping_shuffles, mix, n_partitions, release, releasing, slices, small_batches, text_bytes

LENGTH, ANCHOR = 50, 8
LEFT = LENGTH - ANCHOR
ROW = 96
#: Bytes that all strings of a record share which start at SPLIT or later, or before it.
SPLIT = 22
RIGHT_CORE, LEFT_CORE = (LEFT, LEFT + 30), (SPLIT, LENGTH)
SHALLOW = 24
FLUSH_BYTES, CARRY_BYTES, CUT_BYTES = 6 << 20, 8 << 20, 1 << 20
CHUNK = 1 << 16
#: Of zstd; 6 takes 6 % less than 3 of records, and hardly more than 9.
LEVEL = 6
#: An anchor is hot if it has more than HOT_LEAST records of the sample and more than one in HOT_SHARE; so at most HOT_SHARE are.
HOT_SAMPLE, HOT_SHARE, HOT_LEAST = 64, 1000, 256
_KEYS = np.random.default_rng(7).integers(1, 2**63, ROW // 8, dtype=np.uint64) * U(2) + U(1)
META = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("at", "<u4"), ("u", "u1"), ("v", "u1"), ("again", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("begin", "<u4"), ("end", "<u4")])


def anchors(data: np.ndarray) -> np.ndarray:
    """Position of the anchor of the string that starts at each position."""
    n = len(data) - ANCHOR + 1
    word = np.ndarray((n,), "<u8", data.tobytes(), strides=(1,))
    h = word * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h &= U(0xFFFFFFFF00000000)
    h |= np.arange(n, dtype=np.uint64)
    width, step = LENGTH - ANCHOR + 1, 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return (np.minimum(h[: len(h) - rest], h[rest:]) & U(0xFFFFFFFF)).astype(np.int64)


def records(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a slice of documents: record bytes, document, first string's place in it, and first and last string's place in the record."""
    if len(data) < LENGTH:
        return
    anchor = anchors(data)
    good = np.ones(len(anchor), dtype=bool)
    for e in at[1:-1].tolist():
        good[max(0, e - LENGTH + 1) : e] = False
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    keep = good[first]
    first, last = first[keep], last[keep]
    anchor = anchor[first]
    doc = np.searchsorted(at, first, side="right") - 1
    padded = np.concatenate((np.zeros(LEFT, np.uint8), data, np.zeros(ROW, np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(padded, ROW)
    place = np.arange(ROW, dtype=np.uint8)[None, :]
    for a in range(0, len(first), CHUNK):
        b = a + CHUNK
        u, v = (first[a:b] - anchor[a:b] + LEFT).astype(np.uint8), (last[a:b] - anchor[a:b] + LEFT).astype(np.uint8)
        rec = view[anchor[a:b]]
        rec *= (place >= u[:, None]) & (place < v[:, None] + np.uint8(LENGTH))
        yield rec, doc[a:b], first[a:b] - at[doc[a:b]], u, v


def anchor_words(rec: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rec[:, LEFT : LEFT + ANCHOR]).view("<u8")[:, 0]


def core_keys(rec: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hash of the bytes from a to b of each record."""
    core = np.zeros((len(rec), 32), np.uint8)
    core[:, : b - a] = rec[:, a:b]
    key = np.zeros(len(rec), np.uint64)
    for i in range(4):
        key += mix(core.view("<u8")[:, i] * _KEYS[i])
    return key


def hot_parts(meta: np.ndarray, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int]]]:
    """Rows, their meta and core, of the two kinds of strings that hot records hold."""
    for low, high, core in ((SPLIT, ROW, RIGHT_CORE), (0, SPLIT - 1, LEFT_CORE)):
        rows = np.flatnonzero(hot & (meta["v"] >= low) & (meta["u"] <= high))
        part = meta[rows]
        begin = np.maximum(part["u"], low)
        part["at"] += begin - part["u"]
        part["u"], part["v"] = begin, np.minimum(part["v"], high)
        yield rows, part, core


def fold(rec: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """For each row the row that stands for its class of equal records, one of the least document; -1 for rows of other documents in the class."""
    stands = np.full(len(rec), -1, np.int64)
    if not len(rec):
        return stands
    words = rec.view("<u8")
    key = np.zeros(len(rec), np.uint64)
    for i in range(words.shape[1]):
        key += mix(words[:, i] * _KEYS[i])
    key += meta["u"].astype(np.uint64) * U(0x51ED270B) + meta["v"].astype(np.uint64) * U(0xA4F1C94D3)
    order = np.lexsort((meta["doc"], mix(key)))
    w, k = words[order], meta[order]
    same = np.concatenate(([False], (w[1:] == w[:-1]).all(1) & (k["u"][1:] == k["u"][:-1]) & (k["v"][1:] == k["v"][:-1])))
    head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
    least = k["doc"] == k["doc"][head]
    stands[order[least]] = order[head[least]]
    return stands


def inside(meta: np.ndarray) -> np.ndarray:
    """Which bytes of each record its strings cover; the others are 0 and need not travel."""
    place = np.arange(ROW, dtype=np.uint8)[None, :]
    return (place >= meta["u"][:, None]) & (place < meta["v"][:, None] + np.uint8(LENGTH))


def packed(rec: np.ndarray, meta: np.ndarray) -> bytes:
    """The covered bytes alone, record after record."""
    return rec[inside(meta)].tobytes()


def unpacked(data: bytes, meta: np.ndarray) -> np.ndarray:
    rec = np.zeros((len(meta), ROW), np.uint8)
    rec[inside(meta)] = np.frombuffer(data, np.uint8)
    return rec


def spans_of(meta: np.ndarray) -> np.ndarray:
    """What goes when all strings of these records go."""
    out = np.zeros(len(meta), SPAN)
    out["doc"], out["tag"], out["begin"] = meta["doc"], meta["tag"], meta["at"]
    out["end"] = meta["at"] + (meta["v"].astype(np.uint32) - meta["u"]) + LENGTH
    return out


def blind_trie(keys: list[bytes]) -> list[list[int]]:
    """Order of a group of strings of one length: lists of equal ones, ascending.

    A node is [depth, {byte: node or leaf}]; a leaf is a list of strings. An insertion goes down
    by branching bytes alone, compares once with a leaf found there, and then goes down
    again to where the two part.
    """
    root: list = [keys[0], [0]]  # leaf: string, members
    for i in range(1, len(keys)):
        key, node = keys[i], root
        while isinstance(node[0], int):
            child = node[1].get(key[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = node[0]
        if other == key:
            node[1].append(i)
            continue
        depth = next(d for d, (x, y) in enumerate(zip(key, other)) if x != y)
        node, above = root, None
        while isinstance(node[0], int) and node[0] < depth:
            above = (node, key[node[0]])
            node = node[1][key[node[0]]]
        leaf = [key, [i]]
        if isinstance(node[0], int) and node[0] == depth:
            node[1][key[depth]] = leaf
        else:
            new = [depth, {other[depth]: node, key[depth]: leaf}]
            if above is None:
                root = new
            else:
                above[0][1][above[1]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node[0], int):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out.append(node[1])
    return out


def deep_shallow(flat: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the LENGTH bytes from each start on, and whether each equals the one before it in that order."""
    word = np.ndarray((len(flat) - 7,), ">u8", flat.tobytes(), strides=(1,))
    order = np.arange(len(start))
    group = np.zeros(len(start), np.int64)
    same = np.zeros(len(start), dtype=bool)
    open_ = np.arange(len(start))
    # shallow: every open group is split by its next 8 bytes
    for depth in range(0, SHALLOW, 8):
        key = word[start[order[open_]] + depth].astype(np.uint64)
        by = np.lexsort((key, group[open_]))
        order[open_] = order[open_][by]
        key, g = key[by], group[open_]
        split = np.concatenate(([True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])))
        # a group is named by the place where it begins
        group[open_] = open_[np.maximum.accumulate(np.where(split, np.arange(len(open_)), 0))]
        size = np.bincount(group[open_], minlength=len(start))
        open_ = open_[size[group[open_]] > 1]
        if not len(open_):
            return order, same
    # deep: a blind trie for each group left; one of two strings has a single comparison
    heads = np.flatnonzero(np.concatenate(([True], group[open_][1:] != group[open_][:-1])))
    sizes = np.diff(np.append(heads, len(open_)))
    view = np.lib.stride_tricks.sliding_window_view(flat, LENGTH - SHALLOW)
    two = open_[heads[sizes == 2]]
    for a in range(0, len(two), CHUNK):
        t = two[a : a + CHUNK]
        x, y = view[start[order[t]] + SHALLOW], view[start[order[t + 1]] + SHALLOW]
        differ = x != y
        at = differ.argmax(1)
        any_ = differ.any(1)
        same[t + 1] = ~any_
        rows = np.arange(len(t))
        turn = t[any_ & (x[rows, at] > y[rows, at])]
        order[turn], order[turn + 1] = order[turn + 1], order[turn].copy()
    data = flat.tobytes()
    for head, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        p = int(open_[head])
        members = order[p : p + size]
        keys = [data[s + SHALLOW : s + LENGTH] for s in start[members].tolist()]
        new = []
        for equal in blind_trie(keys):
            same[p + len(new) + 1 : p + len(new) + len(equal)] = True
            new += equal
        order[p : p + size] = members[new]
    return order, same


def resolve(rec: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """What goes in the documents of a bucket's records. meta also has a row, marked again, for each other place of a record."""
    first = meta["again"] == 0
    stands = fold(rec, meta[first])
    of = stands[np.cumsum(first) - 1]
    out = [spans_of(meta[of < 0])]
    stay = np.flatnonzero(stands == np.arange(len(stands)))
    # all places of the records that stay, record by record
    by = np.argsort(of, kind="stable")
    by = by[np.count_nonzero(of < 0) :]
    places, of = meta[by], np.searchsorted(stay, of[by])
    edges = np.searchsorted(of, np.arange(len(stay) + 1))
    rec, meta = rec[stay], meta[first][stay]
    row, place = [], []
    u, v = meta["u"].astype(np.int64), meta["v"].astype(np.int64)
    for (a, b), low, high in ((RIGHT_CORE, np.maximum(u, SPLIT), v), (LEFT_CORE, u, np.minimum(v, SPLIT - 1))):
        has = np.flatnonzero(low <= high)
        if not len(has):
            continue
        key = core_keys(rec[has], a, b)
        order = np.argsort(key)
        key, doc = key[order], meta["doc"][has][order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        mixed = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
        alive = has[order[np.repeat(mixed, np.diff(np.append(head, len(key))))]]
        n = (high - low + 1)[alive]
        row.append(np.repeat(alive, n))
        place.append(np.repeat(low[alive] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()))
    if row and sum(map(len, row)):
        row, place = np.concatenate(row), np.concatenate(place)
        flat = np.append(rec.reshape(-1), np.zeros(8, np.uint8))
        order, same = deep_shallow(flat, row * ROW + place)
        head = np.flatnonzero(~same)
        doc = meta["doc"][row[order]]
        least = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(doc))))
        lost = order[doc > least]
        if len(lost):
            r, p = row[lost], place[lost]
            by = np.lexsort((p, r))
            r, p = r[by], p[by]
            head = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1))))
            tail = np.append(head[1:], len(r)) - 1
            n = np.diff(edges)[r[head]]
            run = np.repeat(np.arange(len(head)), n)
            m = places[np.repeat(edges[r[head]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            found = np.zeros(len(m), SPAN)
            found["doc"], found["tag"] = m["doc"], m["tag"]
            found["begin"] = m["at"] + p[head][run] - m["u"]
            found["end"] = m["at"] + p[tail][run] - m["u"] + LENGTH
            out.append(found)
    return np.concatenate(out)


def home(doc: np.ndarray, n: int) -> np.ndarray:
    """Bucket in which a document and its runs meet."""
    return (mix(doc.view(np.uint64) + U(0x5851F42D4C957F2D)) >> U(33)).astype(np.int64) % n


def parted(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    edges = np.searchsorted(key[order], np.arange(n + 1))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            yield k, order[a:b]


def planes(table: np.ndarray) -> bytes:
    """A structured array column by column, as that compresses better."""
    return b"".join(np.ascontiguousarray(table[f]).tobytes() for f in table.dtype.names)


def unplanes(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // sum(kind[f].itemsize for f in kind.names)
    out, at = np.zeros(n, kind), 0
    for f in kind.names:
        out[f] = np.frombuffer(data, kind[f], n, at)
        at += n * kind[f].itemsize
    return out


def _blobs(rows: list[tuple[int, int, bytes | None, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "kind", "rec", "meta"])


def hot_anchors(texts: DataFrame) -> np.ndarray:
    """Anchors with very many different records in a sample of texts, HOT_SHARE at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, Counter()
        for batch in slices(batches, "text", CUT_BYTES):
            for rec, doc, _, u, v in records(*text_bytes(batch.column(0))):
                meta = np.zeros(len(rec), META)
                meta["doc"], meta["u"], meta["v"] = doc, u, v
                words = anchor_words(rec[fold(rec, meta) == np.arange(len(rec))])
                total += len(words)
                word, n = np.unique(words, return_counts=True)
                # those left out have less than their share in this piece
                often = n * HOT_SHARE * 2 > len(words)
                seen.update(dict(zip(word[often].tolist(), n[often].tolist())))
        seen[None] = total
        yield pa.record_batch([pa.array([None if w is None else w.to_bytes(8, "little") for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    found = texts.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0).select("text").mapInArrow(releasing(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(HOT_SHARE + 1).collect()
    total = sum(r.n for r in found if r.word is None)
    return np.array([int.from_bytes(r.word, "little") for r in found if r.word is not None and r.n > max(HOT_LEAST, total // HOT_SHARE)], np.uint64)


def removed_spans(docs: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, spans (packed): removed stretches, by the bucket of their documents."""
    import zstandard

    texts = docs.where("doc_id is not null").select("doc_id", F.pmod(F.xxhash64("text"), F.lit(1 << 32)).alias("tag"), "text")
    hot = hot_anchors(texts)

    def span_rows(spans: np.ndarray, squeeze) -> list[tuple]:
        return [(k, 1, None, squeeze(planes(np.sort(spans[rows], order=("doc", "begin"))))) for k, rows in parted(home(np.ascontiguousarray(spans["doc"]), n_buckets), n_buckets)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rec, meta = (np.concatenate(x) for x in zip(*held))
            held.clear()
            stands = fold(rec, meta)
            out = span_rows(spans_of(meta[stands < 0]), squeeze)
            # a record's places follow it
            rows = np.argsort(stands, kind="stable")[np.count_nonzero(stands < 0) :]
            stands = stands[rows]
            meta = meta[rows]
            meta["again"] = stands != rows
            word = anchor_words(rec)[stands]
            is_hot = np.isin(word, hot)
            cold = np.flatnonzero(~is_hot)
            dealt = [(cold, meta[cold], mix(word[cold]))]
            for rows, part, core in hot_parts(meta, is_hot):
                dealt.append((rows, part, core_keys(rec[stands[rows]], *core)))
            for at, part, key in dealt:
                for k, rows in parted((key >> U(33)).astype(np.int64) % n_buckets, n_buckets):
                    once = rows[part["again"][rows] == 0]
                    out.append((k, 0, squeeze(packed(rec[stands[at[once]]], part[once])), squeeze(planes(part[rows]))))
            return _blobs(out)

        for batch in slices(batches, "text", CUT_BYTES):
            data, at = text_bytes(batch.column(2))
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            tags = np.array(batch.column(1).to_pylist(), np.int64).astype(np.uint32)
            parts = []
            for rec, doc, place, u, v in records(data, at):
                meta = np.zeros(len(rec), META)
                meta["doc"], meta["tag"], meta["at"], meta["u"], meta["v"] = ids[doc], tags[doc], place, u, v
                parts.append((rec, meta))
                size += rec.nbytes // 4
                if size > FLUSH_BYTES:
                    held += parts
                    parts, size = [], 0
                    yield flush()
            held += parts
        if held:
            yield flush()

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        expand, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=LEVEL).compress
        out, recs, metas = [], [], []
        for kind, rec, meta in zip(*(rows.column(c) for c in ("kind", "rec", "meta"))):
            if kind.as_py() == 1:
                out.append((key[0], 1, None, meta.as_py()))
                continue
            metas.append(unplanes(expand(meta.as_py()), META))
            recs.append(unpacked(expand(rec.as_py()), metas[-1][metas[-1]["again"] == 0]))
        if recs:
            rec, meta = np.concatenate(recs), np.concatenate(metas)
            recs.clear()
            out += span_rows(resolve(rec, meta), squeeze)
            del rec, meta
        release()
        return pa.Table.from_batches([_blobs(out)])

    kind = "bucket int, kind int, rec binary, meta binary"
    return texts.mapInArrow(releasing(cut), kind).groupBy("bucket").applyInArrow(meet, kind).select("bucket", F.col("meta").alias("spans"))


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs that these cover, sorted by begin before."""
    reach = np.maximum.accumulate(spans["end"])
    head = np.flatnonzero(np.concatenate(([True], spans["begin"][1:] > reach[:-1])))
    return spans["begin"][head].astype(np.int64), reach[np.append(head[1:], len(spans)) - 1].astype(np.int64)


def _applied(docs: DataFrame, schema, finish) -> DataFrame:
    """Brings documents (all columns) and their runs together; finish(table, runs of each row) gives the result."""
    import zstandard

    small_batches(docs.sparkSession)
    n_buckets = 4 * n_partitions(docs.sparkSession)
    with dropping_shuffles(docs.sparkSession):
        spans = cut_lineage(removed_spans(docs, n_buckets))
    tagged = docs.withColumn("_tag", F.pmod(F.xxhash64("text"), F.lit(1 << 32)))
    names = docs.columns

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in slices(batches, "text", CARRY_BYTES):
            # rows without doc_id meet no runs; they are spread over all buckets
            ids = np.array([i * 0x9E3779B1 + t if x is None else x for i, (x, t) in enumerate(zip(batch.column(names.index("doc_id")).to_pylist(), batch.column(len(names)).to_pylist()))], np.int64)
            out = []
            for k, rows in parted(home(ids, n_buckets), n_buckets):
                sink = pa.BufferOutputStream()
                part = batch.take(pa.array(rows))
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                out.append((k, squeeze(sink.getvalue().to_pybytes())))
            yield pa.record_batch([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "rows"])

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        parts = [unplanes(expand(x.as_py()), SPAN) for x in right.column("spans")]
        found = np.concatenate(parts) if parts else np.zeros(0, SPAN)
        found = found[np.lexsort((found["begin"], found["tag"], found["doc"]))]
        out = []
        for x in left.column("rows"):
            table = pa.ipc.open_stream(expand(x.as_py())).read_all()
            ids, tags = table.column("doc_id").to_pylist(), table.column("_tag").to_pylist()
            runs = []
            for doc, tag in zip(ids, tags):
                mine = found[:0]
                if doc is not None:
                    a, b = np.searchsorted(found["doc"], (doc, doc + 1))
                    mine = found[a:b]
                    mine = mine[mine["tag"] == tag]
                runs.append(merged(mine) if len(mine) else (np.zeros(0, np.int64),) * 2)
            out.append(finish(table, runs))
        release()
        return pa.concat_tables(out)

    carried = tagged.mapInArrow(releasing(carry), "bucket int, rows binary")
    return carried.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(join, schema)


def _kept(text: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    out, at = [], 0
    for b, e in zip(begin.tolist(), end.tolist()):
        out.append(text[at:b])
        at = e
    return b"".join([*out, text[at:]])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """What is removed of every document; see above."""

    def finish(table: pa.Table, runs: list) -> pa.Table:
        rows = []
        for text, (begin, end) in zip(table.column("text").to_pylist(), runs):
            data = (text or "").encode()
            rows.append((len(data), int((end - begin).sum()), len(begin), hashlib.sha256(_kept(data, begin, end)).hexdigest()))
        a, b, c, d = zip(*rows) if rows else ((),) * 4
        return pa.table([table.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _applied(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", finish)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without the bytes that go; letters cut in half go too. n_chars follows where there is such a column."""

    def finish(table: pa.Table, runs: list) -> pa.Table:
        texts = [t if t is None or not len(begin) else _kept(t.encode(), begin, end).decode("utf-8", "ignore") for t, (begin, end) in zip(table.column("text").to_pylist(), runs)]
        table = table.drop_columns(["_tag"])
        at = table.column_names.index("text")
        table = table.set_column(at, table.schema.field("text"), pa.array(texts, table.schema.field("text").type))
        if "n_chars" in table.column_names:
            at = table.column_names.index("n_chars")
            old = table.column(at).to_pylist()
            sizes = [len(t) if t is not None and len(run[0]) else n for t, n, run in zip(texts, old, runs)]
            table = table.set_column(at, table.schema.field("n_chars"), pa.array(sizes, table.schema.field("n_chars").type))
        return table

    return _applied(docs, docs.schema, finish)
