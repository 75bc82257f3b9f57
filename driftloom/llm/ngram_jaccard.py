"""Exact Jaccard self-join of documents' n-word shingles by vertical partitioning.

A document's set has the hashes of its distinct n-word shingles; documents with equal sets are
one class from the start, named by a digest of 128 bits. Two sets A and B link when
den * |A & B| >= num * |A | B|. The global order of shingles is by the number of sets that hold
them, HOT counting as most, then by hash, and the hash range is cut into fragments:

1. Each fragment gets all sets' shingles in its range and tells which stand in two sets or more;
   only these can count. They go back to their sets, and a set of which less than num / den is
   shared links with none and drops out. Most do.
2. The others, in the global order, with their unshared shingles first: two that link share one of
   the first |A| - ceil(num / den * |A|) + 1. Sets sharing one of these are candidates; each is
   tied to the least of them, and connected candidates make a cluster.
3. Each cluster's least set is its pivot. The pairs of a set and its pivot are judged exactly: both
   are cut into 2^FRAGMENT_BITS fragments, each fragment's partial overlap is counted in a task of its own, and
   the partial overlaps are summed for each pair. Sets that link with the pivot are of one component, so
   their links with each other need no look.
4. One less the similarity is a metric, so sets whose distances from the pivot differ by more than the
   threshold's distance can't link. Sets that don't link with their pivot are dealt to rings
   by their distance from it, a third of the threshold's distance wide, and meet those of their own and near
   rings, at most BLOCK sets at a time; there the shingle order is cut into fragments again,
   partial overlaps are counted for each, summed per pair, and each pair is judged by its exact sum. A task gives a
   tree over the sets that it found linked. So rows grow with sets, not with pairs; trees are
   joined by connected components.

Hot keys: map tasks fold equal sets and send a shingle that HOT of their sets hold once, with a count;
candidates of a shingle that HOT sets hold are tied in as many parts as there are partitions, then part by part; clusters
are cut into blocks of PIVOT_BLOCK and BLOCK sets; joins on sets and clusters broadcast the rows of hot keys. So no
task gets more than a share of a group, and no pair is dropped.

Result for each document: doc_id, n_shingles, component_id (least doc_id reachable by links,
itself included). Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; fewer than n words are one
shingle; null text or no word: an empty set, linked with nothing. Repeated rows are linked if not
empty. A null doc_id links but names no component. A very long text is a slice of its own, and
memory follows it. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.arrowkit import U, Words, cut_lineage, forget, join_hot, n_partitions, release, releasing, shingle_sets, slices, small_batches, text_bytes
from driftloom.llm.components import connected_components

N, NUM, DEN = 4, 85, 100
HOT = 64
BLOCK = 1024
#: Sets that meet their pivot in one task.
PIVOT_BLOCK = 128
FLUSH_GRAMS = 1_000_000
#: Columns of a block that are counted at a time.
FRAGMENT = 4096
#: Fragments that a pivot and its cluster are cut into, as bits of the hash.
FRAGMENT_BITS = 2
PARTS = "frag int, kind int, flush long, gram long, data binary"
FLUSH_SETS = 60_000


def set_ids(sets: list[np.ndarray]) -> list[bytes]:
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]


def sets_of(column: pa.Array, n: int) -> list[np.ndarray]:
    return shingle_sets(Words(*text_bytes(column), lower=True), n)


def _pack(at: np.ndarray, gram: np.ndarray, often: np.ndarray | None = None) -> bytes:
    """Shingles of sets of one flush: numbers of the sets, ascending, as differences, how many sets hold each (HOT at most), then the shingles."""
    gaps = np.diff(at, prepend=0).astype("<u2")
    often = np.zeros(len(gram), "u1") if often is None else often.astype("u1")
    return zstandard.ZstdCompressor(level=1).compress(gaps.tobytes() + often.tobytes()) + gram.astype("<u8").tobytes() + np.array([len(gram)], "<u4").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data[-4:], "<u4")[0])
    gram = np.frombuffer(data, "<u8", n, len(data) - 4 - 8 * n)
    head = zstandard.ZstdDecompressor().decompress(data[: len(data) - 4 - 8 * n])
    return np.cumsum(np.frombuffer(head, "<u2", n).astype(np.int64)), np.frombuffer(head, "u1", n, 2 * n), gram


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["frag", "kind", "flush", "gram", "data"])


def classes(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles and sid, the digest of its set, of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = sets_of(batch.column(1), n)
            yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_ids(sets), pa.binary())], names=["doc_id", "n_shingles", "sid"])

    return docs.select("doc_id", "text").mapInArrow(releasing(work), "doc_id long, n_shingles long, sid binary")


def shared_shingles(docs: DataFrame, n: int, n_frags: int) -> DataFrame:
    """Step 1: rows of kind 1 (shared shingles of a flush's sets) and 3 (a flush's sets).

    A flush is what a map task has gathered: its sets are numbered, so that a fragment needs
    a few bits for each shingle's set; ids and sizes go along once.
    """

    def flush(sets: dict[bytes, np.ndarray], number: int) -> list[tuple]:
        size = np.array([len(s) for s in sets.values()], np.int64)
        at = np.repeat(np.arange(len(size)), size)
        gram = np.concatenate(list(sets.values()))
        order = np.argsort(gram, kind="stable")
        ordered = gram[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        count = np.diff(np.append(first, len(gram)))
        hot = count >= HOT
        each = np.zeros(len(gram), dtype=bool)
        each[order] = np.repeat(hot, count)
        frag_of = lambda g: (g >> U(32)).astype(np.int64) * n_frags >> 32
        home = (number * 0x9E3779B97F4A7C15 % 2**64 >> 33) % n_frags
        out = [(home, 3, number, None, b"".join(sets) + size.astype("<u8").tobytes())]
        if each.any():
            out.append((home, 1, number, None, _pack(at[each], gram[each], np.full(int(each.sum()), HOT))))
        g = ordered[first[hot]]
        out += [(int(f), 2, None, int(x), None) for f, x in zip(frag_of(g), g.view(np.int64))]
        at, gram = at[~each], gram[~each]
        frag = frag_of(gram)
        order = np.argsort(frag, kind="stable")
        at, gram = at[order], gram[order]
        edges = np.searchsorted(frag[order], np.arange(n_frags + 1))
        out += [(f, 0, number, None, _pack(at[a:b], gram[a:b])) for f, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        total, number = 0, TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            sets = [s for s in sets_of(batch.column(0), n) if len(s)]
            for key, s in zip(set_ids(sets), sets):
                if key not in held:
                    held[key] = s
                    total += len(s)
                if total > FLUSH_GRAMS or len(held) >= FLUSH_SETS:
                    yield _rows(flush(held, number))
                    held, total, number = {}, 0, number + 1
        if held:
            yield _rows(flush(held, number))

    def fragment(key: tuple, rows: pa.Table) -> pa.Table:
        out, parts, grams, flushes = [], [], [], []
        for kind, number, gram, data in zip(*(rows.column(c) for c in ("kind", "flush", "gram", "data"))):
            kind = kind.as_py()
            if kind in (1, 3):
                out.append((key[0].as_py(), kind, number.as_py(), None, data.as_py()))
            elif kind == 2:
                grams.append(gram.as_py())
            else:
                at, _, g = _unpack(data.as_py())
                parts.append((at + (len(flushes) << 16), g))
                flushes.append(number.as_py())
        if parts:
            owner, gram = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.argsort(gram, kind="stable")
            ordered = gram[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            size = np.diff(np.append(first, len(gram)))
            hot = np.isin(ordered[first], np.array(grams, np.int64).view(np.uint64))
            often = np.empty(len(gram), "u1")
            often[order] = np.repeat(np.where(hot, HOT, np.minimum(size, HOT)), size)
            # owners ascend, as parts came flush by flush
            shared = often > 1
            owner, gram, often = owner[shared], gram[shared], often[shared]
            edges = np.searchsorted(owner, np.arange(len(flushes) + 1) << 16)
            out += [(key[0].as_py(), 1, flushes[i], None, _pack(owner[a:b] - (i << 16), gram[a:b], often[a:b])) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        release()
        return pa.Table.from_batches([_rows(out)])

    return docs.select("text").mapInArrow(releasing(send), PARTS).groupBy("frag").applyInArrow(fragment, PARTS)


def candidates(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Step 2, first part: sid, n, prefix (number of leading shingles to match on), cold (how many of those fewer than HOT sets hold), grams (in the global order). Sets of several flushes come several times."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        parts, ids, size = [], [], np.zeros(0, "<u8")
        for kind, data in zip(rows.column("kind"), rows.column("data")):
            data = data.as_py()
            if kind.as_py() == 3:
                m = len(data) // 24
                ids, size = [data[i : i + 16] for i in range(0, 16 * m, 16)], np.frombuffer(data, "<u8", m, 16 * m)
            else:
                parts.append(_unpack(data))
        at, often, gram = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        order = np.lexsort((gram, often, at))
        at, gram = at[order], gram[order]
        first = np.searchsorted(at, np.arange(len(ids)))
        held = np.diff(np.append(first, len(at)))
        few = np.bincount(at[often[order] < HOT], minlength=len(ids))
        n = size.astype(np.int64)
        need = -(-num * n // den)
        keep = np.flatnonzero(held >= need)
        prefix = (held - need + 1)[keep]
        data = [gram[a : a + s].astype("<u8").tobytes() for a, s in zip(first[keep], held[keep])]
        return pa.table([pa.array([ids[i] for i in keep], pa.binary()), pa.array(n[keep]), pa.array(prefix), pa.array(np.minimum(prefix, few[keep])), pa.array(data, pa.binary())], names=["sid", "n", "prefix", "cold", "grams"])

    return shared.where("kind in (1, 3)").select("flush", "kind", "data").groupBy("flush").applyInArrow(work, "sid binary, n long, prefix long, cold long, grams binary")


def tied(sets: DataFrame, n_parts: int) -> DataFrame:
    """Step 2, second part: a, b: each set and the least that shares one of its leading shingles."""

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, cold = (np.array(batch.column(i).to_pylist(), np.int64) for i in (1, 2))
            grams = np.concatenate([np.frombuffer(x.as_py(), "<i8", k) for x, k in zip(batch.column(3), prefix)])
            part = np.array([int.from_bytes(x.as_py()[:4], "little") % n_parts for x in batch.column(0)], np.int32)
            row = np.repeat(np.arange(len(prefix)), prefix)
            place = np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(grams), pa.array(np.where(place < cold[row], 0, part[row]).astype(np.int32))], names=["sid", "gram", "part"])

    keys = sets.select("sid", "prefix", "cold", "grams").mapInArrow(leading, "sid binary, gram long, part int")
    local = keys.groupBy("gram", "part").agg(F.min("sid").alias("m"), F.count("*").alias("c"))
    least = local.groupBy("gram").agg(F.min("m").alias("least"), F.sum("c").alias("c")).where("c > 1").select("gram", "least")
    # no shingle has more rows here than there are parts
    parts = local.join(least, "gram").select("gram", "part", "m", "least")
    ties = keys.join(parts.select("gram", "part", "m"), ["gram", "part"]).select(F.col("sid").alias("a"), F.col("m").alias("b"))
    return ties.union(parts.select("m", "least")).where("a <> b").distinct()


def pivot_overlaps(members: DataFrame) -> DataFrame:
    """Step 3: sid, n, pivot_n, overlap of each member that shares a shingle with its pivot. members: sid, n, grams, root (the pivot), blocks, block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sid, n, grams, root, blocks, block in zip(*(c.to_pylist() for c in batch.columns)):
                g = np.sort(np.frombuffer(grams, "<u8"))
                edges = np.searchsorted(g >> U(64 - FRAGMENT_BITS), np.arange((1 << FRAGMENT_BITS) + 1))
                for f, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if b > a:
                        out.append((root, block, f, False, sid, n, g[a:b].tobytes()))
                        # the pivot goes to every block of its cluster
                        out += [(root, k, f, True, sid, n, out[-1][6]) for k in range(blocks if sid == root else 0)]
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["root", "block", "frag", "pivot", "sid", "n", "grams"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial overlaps. In each group the pivot's row comes first."""
        at = pivot = None
        for batch in batches:
            out = []
            for root, block, frag, is_pivot, sid, n, grams in zip(*(c.to_pylist() for c in batch.columns)):
                g = np.frombuffer(grams, "<u8")
                if is_pivot:
                    at, pivot, pivot_n = (root, block, frag), g, n
                elif at == (root, block, frag):
                    found = np.searchsorted(pivot, g)
                    hits = int((pivot[np.minimum(found, len(pivot) - 1)] == g).sum())
                    if hits:
                        out.append((sid, n, pivot_n, hits))
            columns = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["sid", "n", "pivot_n", "overlap"])

    pieces = members.select("sid", "n", "grams", "root", "blocks", "block").mapInArrow(releasing(cut), "root binary, block int, frag int, pivot boolean, sid binary, n long, grams binary")
    dealt = pieces.repartition("root", "block", "frag").sortWithinPartitions("root", "block", "frag", F.desc("pivot"))
    partial = dealt.mapInArrow(releasing(count), "sid binary, n long, pivot_n long, overlap long")
    return partial.groupBy("sid", "n", "pivot_n").agg(F.sum("overlap").alias("overlap"))


def ring_of(num: int, den: int):
    """0 if n, pivot_n and overlap make a link, else 1 and up by the distance from the pivot; the last ring has sets that share nothing with it."""
    width = max(den - num, 1)
    union = "(n + pivot_n - overlap)"
    return F.expr(f"case when overlap is null then {1 + 3 * num // width} when {den} * overlap >= {num} * {union} then 0 else 1 + 3 * ({den} * ({union} - overlap) - {width} * {union}) div ({width} * {union}) end")


def meetings(ringed: DataFrame) -> DataFrame:
    """Step 4: sid, root, and i and j, the two units that meet, for each meeting of a set. ringed: sid, root, ring; clusters whose sets all link with the pivot have none."""
    sizes = ringed.groupBy("root", "ring").agg(F.count("*").alias("size"))
    unit = BLOCK // 2
    rings = (
        sizes.groupBy("root")
        .agg(F.sum("size").alias("total"), F.max("ring").alias("furthest"), F.sort_array(F.collect_list(F.struct("ring", F.expr(f"cast((size + {unit - 1}) div {unit} as int)").alias("blocks")))).alias("rings"))
        .where("furthest > 0")
    )
    placed = join_hot(ringed, rings, "root", ringed.count())
    code = f"shiftleft(cast(ring as long), 32) + pmod(xxhash64(sid), element_at(filter(rings, q -> q.ring = ring), 1).blocks)"
    near = "filter(rings, q -> abs(q.ring - ring) <= 4 and q.ring + ring > 0)"
    others = f"filter(flatten(transform({near}, q -> transform(sequence(0, q.blocks - 1), k -> shiftleft(cast(q.ring as long), 32) + k))), u -> u <> mine)"
    met = placed.withColumn("mine", F.expr(f"if(total <= {BLOCK}, 0L, {code})")).withColumn("others", F.expr(f"if(total <= {BLOCK}, array(0L), {others})"))
    alone = "if(size(others) = 0 and ring > 0, array(mine), others)"
    return met.select("sid", "root", F.explode(F.expr(f"transform({alone}, u -> named_struct('i', least(u, mine), 'j', greatest(u, mine)))")).alias("p")).select("sid", "root", "p.i", "p.j")


def link_components(n: np.ndarray, grams: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Least linked row of each row's component, by exact overlaps counted fragment by fragment and summed."""
    m = len(n)
    owner = np.repeat(np.arange(m), [len(g) for g in grams])
    _, column, freq = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    overlap = np.zeros((m, m), np.float32)
    rare = (freq > 1) & (freq <= 8)
    pick = rare[column]
    if pick.any():
        order = np.argsort(column[pick], kind="stable")
        c, o = column[pick][order], owner[pick][order]
        for step in range(1, 8):
            same = c[step:] == c[:-step]
            i, j = o[:-step][same], o[step:][same]
            flat = np.bincount(np.minimum(i, j) * m + np.maximum(i, j), minlength=m * m) if len(i) > m * m // 8 else None
            if flat is not None:
                overlap += flat.reshape(m, m)
            else:
                np.add.at(overlap, (np.minimum(i, j), np.maximum(i, j)), 1)
        overlap = overlap + overlap.T
    often = np.flatnonzero(freq > 8)
    place = np.full(len(freq), -1)
    place[often] = np.arange(len(often))
    pick = place[column] >= 0
    c, o = place[column][pick], owner[pick]
    order = np.argsort(c, kind="stable")
    c, o = c[order], o[order]
    for begin in range(0, len(often), FRAGMENT):
        a, b = np.searchsorted(c, (begin, begin + FRAGMENT))
        held = np.zeros((m, min(FRAGMENT, len(often) - begin)), np.float32)
        held[o[a:b], c[a:b] - begin] = 1
        overlap += held @ held.T
    linked = den * overlap.astype(np.float64) >= num * (n[:, None] + n[None, :] - overlap)
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        new = np.where(linked, label[None, :], m).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def jaccard_components(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document; see above."""
    spark = docs.sparkSession
    small_batches(spark)
    table = cut_lineage(classes(docs, n))
    shared = cut_lineage(shared_shingles(docs, n, 2 * n_partitions(spark)))
    sets = cut_lineage(candidates(shared, num, den))
    forget(shared)

    clusters = cut_lineage(connected_components(tied(sets, n_partitions(spark))))
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / PIVOT_BLOCK).cast("int").alias("blocks"))
    placed = join_hot(clusters, sizes, "root", clusters.count()).select(F.col("node").alias("sid"), "root", "blocks", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("block"))
    found = pivot_overlaps(sets.join(placed, "sid").dropDuplicates(["sid"]))
    ringed = cut_lineage(clusters.select(F.col("node").alias("sid"), "root").join(found, "sid", "left").select("sid", "root", ring_of(num, den).cast("int").alias("ring")))

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        sid = rows.column("sid").to_pylist()
        size = np.array(rows.column("n").to_pylist(), np.int64)
        label = link_components(size, [np.frombuffer(x.as_py(), "<u8") for x in rows.column("grams")], num, den)
        off = np.flatnonzero(label != np.arange(len(sid)))
        return pa.table([pa.array([sid[i] for i in off], pa.binary()), pa.array([sid[i] for i in label[off]], pa.binary())], names=["a", "b"])

    met = sets.select("sid", "n", "grams").join(meetings(ringed), "sid").dropDuplicates(["sid", "i", "j"])
    trees = met.groupBy("root", "i", "j").applyInArrow(link, "a binary, b binary")
    roots = connected_components(ringed.where("ring = 0").select(F.col("sid").alias("a"), F.col("root").alias("b")).union(trees))
    least_doc = table.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("doc"))
    joined = cut_lineage(least_doc.join(roots, least_doc.sid == roots.node, "left").select("sid", "doc", F.coalesce("root", "sid").alias("root")))
    for done in (sets, clusters, ringed):
        forget(done)
    named = join_hot(joined, joined.groupBy("root").agg(F.min("doc").alias("component_id")), "root", joined.count()).select("sid", "component_id")
    whole = join_hot(table, named, "sid", table.count(), "left")
    return whole.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, that with the least doc_id, with all its columns; of rows with that doc_id one, and all with none."""
    found = jaccard_components(docs, n, num, den).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null")).select(docs.columns)
