"""Self-join of documents on the Jaccard similarity of their word shingles, by PartEnum signatures.

Sizes fall into bands so wide that linked sets are in one band or in neighbouring ones. A band's label covers pairs within the band
and with the next one; the sets differ in at most k elements there. The feature domain (shingle hashes) is cut on two levels: into
n1 = 0.6 (k + 1) partitions, more than k / 2, and each of these into three. Of the three, every subset of two is enumerated: a
signature is what a set has in such a subset. Linked sets differ in at most one element in some partition, and so agree in a subset of it.

One difference spoils two subsets of a partition, two spoil all three. So of the subsets that two linked sets agree in, the first in
any common order has few others before it, and each set needs to emit no more than that bound and one. The order puts subsets with
rare shingles first (by a sketch of all shingles' counts): passages that many documents share and empty subsets go first, and no link is lost.

Equal sets are one node, named by a 64-bit hash. Nodes with a common signature are a list of candidates; their pairs go through exact bounds from
sizes and counts in cells of the domain (about half as many as shingles). What may be linked forms clusters. Each of their nodes is compared with a
hub of its list first, exactly; then, in blocks, the nodes of a cluster that those links leave in different components: a large component's
nodes only meet the rest, never one another.
Sets are compared as 48-bit hashes: two different shingles of a pair of 1000-word texts agree with a chance of 4e-9.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import partitions, ship, trim, written
from .components import connected_components, union
from .shingles import mix, pieces, shingles

SKETCH_BITS, SKETCH_BLOCK = 18, 1 << 14
#: Nodes that are compared in one block, and about how many shingles they may have together.
BLOCK, BLOCK_SHINGLES = 256, 500_000
#: Longer lists of candidates are kept in parts, and compared part by part.
LIST = 2048
#: Bits of the filter that keeps most texts that are no candidates out of the shuffle.
FILTER_BITS = 1 << 22
#: Classes of equal sets that a task remembers at once.
SEEN = 100_000
#: Signatures that a task gathers before it sends them, packed, to their partitions.
PACK = 2_000_000


class Bands:
    """Size bands and difference bounds for 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.p = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low, np.int64)
        self.high = self.low * 100 // percent

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def differ(self, a, b):
        """The most elements that linked sets of sizes a and b differ in."""
        return (a + b) * (100 - self.p) // (100 + self.p)

    def parts(self, label) -> np.ndarray:
        """First-level partitions of a label: more than half of its most differences."""
        r = self.high[label]
        k = self.differ(r, r * 100 // self.p)
        return np.maximum((k + 2) // 2, -(-3 * (k + 1) // 5))


def spoilt(d: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The most subsets (three in each of n1 partitions) that d < 2 * n1 differences can touch."""
    return np.where(d <= n1, 2 * d, n1 + d)


def rarity(sketch: np.ndarray) -> np.ndarray:
    """A class for each cell of the sketch: 15 for shingles about as frequent as the sketch's mean, lower for frequent ones."""
    base = max(sketch.sum() / len(sketch), 1.0)
    return (15 - np.clip(np.floor(2 * np.log2(np.maximum(sketch, 1) / base)), 0, 15)).astype(np.uint8)


def signatures(h: np.ndarray, n: np.ndarray, bands: Bands, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) for sets of n[i] distinct hashes, one set after another; at most 4096 sets."""
    cell = rare[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    doc = np.repeat(np.arange(len(n)), n)
    size, band = n.astype(np.int64), bands.of(n)
    docs, found = [], []
    for below in (0, 1):
        use = (n > 0) & (band >= below)
        label = np.where(use, band - below, 0)
        if below:  # a set may be too large for any partner in the band below its own
            use &= 100 * bands.high[label] >= bands.p * size
        d = bands.differ(size, bands.high[label] if below else size * 100 // bands.p)
        n1 = np.where(use, bands.parts(label), 0)
        keep = np.where(use, np.minimum(spoilt(d, n1) + 1, 3 * n1), 0)
        begin, total = np.cumsum(n1) - n1, int(n1.sum())
        mine = use[doc]
        own = doc[mine]
        m = mix(h[mine] ^ ((label[own].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        at = begin[own] + (((m >> np.uint64(32)) * n1[own].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        third = 3 * at + (((m & np.uint64(0xFFFFFF)) * np.uint64(3)) >> np.uint64(24)).astype(np.int64)
        sums, cls = np.zeros(3 * total, np.uint64), np.zeros(3 * total, np.uint8)
        np.add.at(sums, third, mix(m))
        np.maximum.at(cls, third, cell[mine])
        del m, at, third, own, mine
        sums, cls = sums.reshape(-1, 3), cls.reshape(-1, 3)
        of = np.repeat(np.arange(len(n)), n1)
        seed = (np.arange(total) - begin[of]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + label[of].astype(np.uint64)
        key = np.empty((total, 3), np.uint64)
        for left in range(3):  # the subset without third number `left`
            a, b = (left + 1) % 3, (left + 2) % 3
            sig = mix(sums[:, a] + sums[:, b] + seed * np.uint64(2 * left + 3)) >> np.uint64(16)
            key[:, left] = of.astype(np.uint64) << np.uint64(52) | np.maximum(cls[:, a], cls[:, b]).astype(np.uint64) << np.uint64(48) | sig
        key = key.ravel()
        key.sort()
        of = np.repeat(of, 3)
        last = np.arange(3 * total) - 3 * begin[of] >= (3 * n1 - keep)[of]
        docs.append(of[last])
        found.append(key[last] & np.uint64((1 << 52) - 1))
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def cell_counts(h: np.ndarray) -> bytes:
    """A set's counts (at most 255 each) in a power of two of cells, 64 to 8192; by the hashes' low bits, so that cells fold into half as many."""
    cells = 1 << min(13, max(6, (len(h) // 2).bit_length()))
    return np.minimum(np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of linked sets, by one exact matrix of intersection sizes."""
    n = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    doc, column = doc[shared], column[shared]
    both = np.zeros((len(sets), len(sets)))
    if len(column):
        column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
        step = 8192
        for a in range(0, int(column[-1]) + 1, step):
            own = slice(*np.searchsorted(column, [a, a + step]))
            m = np.zeros((len(sets), min(step, int(column[-1]) + 1 - a)), np.float32)
            m[doc[own], column[own] - a] = 1
            both += m @ m.T
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    return np.nonzero(np.triu(linked & (n[:, None] > 0), 1))


def _sets(batch, width: int):
    """(row, its sorted distinct hashes) in chunks: (first row, hashes, sizes), of at most 4000 rows."""
    column = batch.column("text")
    for start in range(0, max(len(column), 1), 4000):
        for first, data, ends in pieces(column.slice(start, 4000)):
            yield start + first, *shingles(data, ends, width)


def _node(h: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash of its sorted hashes."""
    import xxhash

    x = xxhash.xxh3_64_intdigest(h)
    return x - (1 << 64) if x >> 63 else x


class Fresh:
    """Which sets a task has not met yet; it forgets what it knows when that is much, and then names a set again."""

    def __init__(self):
        self.seen: set[int] = set()

    def of(self, h: np.ndarray, n: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """(names of the sets, null for empty ones; whether each is new)."""
        names, new, stop = [], np.zeros(len(n), bool), np.cumsum(n)
        for i, (b, size) in enumerate(zip(stop.tolist(), n.tolist())):
            name = _node(h[b - size : b]) if size else None
            names.append(name)
            if size and name not in self.seen:
                self.seen.add(name)
                new[i] = True
        if len(self.seen) > SEEN:
            self.seen.clear()
        return names, new


def shingle_classes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, node, cells), (block, counts)): set sizes, the sets' names and counts in cells, null for empty ones; and the sketch's counts per task."""

    def rows(batches):
        import pyarrow as pa

        names = ["doc_id", "n", "node", "cells", "block", "counts"]
        sketch, fresh = np.zeros(1 << SKETCH_BITS, np.int64), Fresh()
        for batch in batches:
            for first, h, n in _sets(batch, width):
                nodes, new = fresh.of(h, n)
                sketch += np.bincount((h[np.repeat(new, n)] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                empty = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
                cells = [cell_counts(h[b - size : b]) if size else None for b, size in zip(np.cumsum(n).tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(n)), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(cells, pa.binary()), *empty], names)
        trim()
        if sketch.any():
            k = len(sketch) // SKETCH_BLOCK
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sketch.reshape(k, -1)], pa.binary())], names)

    both = written(docs.mapInArrow(rows, "doc_id long, n long, node long, cells binary, block int, counts binary"), "classes")
    return both.where("block IS NULL").select("doc_id", "n", "node", "cells"), both.where("block IS NOT NULL").select("block", "counts")


def merged_sketch(counts: DataFrame) -> np.ndarray:
    """The tasks' sketches added up; the driver gets its fixed size, not the tasks' number."""

    def rows(batches):
        import pyarrow as pa

        total = {}
        for batch in batches:
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                total[b] = total.get(b, 0) + np.frombuffer(c, "<i8")
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in counts.repartition(1 << SKETCH_BITS - 14, "block").mapInArrow(rows, "block int, counts binary").collect():
        out[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(r.counts, "<i8")
    return out


def packed(sig: np.ndarray, own: np.ndarray, names: np.ndarray, parts: int):
    """(partition, bytes) of signatures and whose they are (names[own]): a partition takes a range of the signatures' hashes.

    A block has its sets' names once, and its signatures in order as gaps, byte by byte of all of them, which compress to little more than
    the gaps' own bits.
    """
    import pyarrow as pa

    part = (((sig >> 16) & 0xFFFFFFFF) * parts) >> 32
    order = np.lexsort((sig, part))
    sig, own, part = sig[order], own[order], part[order]
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(begin, np.append(begin[1:], len(part))):
        mine, at = np.unique(own[a:b], return_inverse=True)
        planes = [np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T) for x in (np.diff(sig[a:b], prepend=0), at.astype(np.int32))]
        raw = b"".join([np.array([b - a, len(mine)], np.int64).tobytes(), names[mine].tobytes(), *(x.tobytes() for x in planes)])
        yield int(part[a]), np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, names of their sets) of a block."""
    import pyarrow as pa

    raw = pa.decompress(body[8:], int(np.frombuffer(body[:8], np.int64)[0]), "zstd", asbytes=True)
    count, n = np.frombuffer(raw, np.int64, 2)
    names = np.frombuffer(raw, np.int64, n, 16)
    planes = np.frombuffer(raw, np.uint8, offset=16 + 8 * n)
    gaps, at = (np.ascontiguousarray(x.reshape(-1, count).T) for x in (planes[: 8 * count], planes[8 * count :]))
    return np.cumsum(gaps.view(np.int64).ravel()), names[at.view(np.int32).ravel()]


def candidates(docs: DataFrame, width: int, percent: int, rare: np.ndarray, parts: int) -> DataFrame:
    """(sig, least, members): nodes that share a signature, in order, and the least of them; sig is null but for the parts of lists over LIST.

    Signatures go to their partitions in packed blocks, and are rows again before they are sorted: lists stream in order of signature, so
    none has to fit in memory. Equal lists of a task are one row.
    """
    table = docs.sparkSession.sparkContext.broadcast(rare)

    def emit(batches):
        import pyarrow as pa

        bands, fresh, held, size = Bands(percent), Fresh(), [], 0

        def out():
            nonlocal held, size
            first = np.cumsum([0, *(len(x[2]) for x in held)])
            sig, names = (np.concatenate([x[i] for x in held]) for i in (0, 2))
            own = np.concatenate([x[1] + a for x, a in zip(held, first)])
            held, size = [], 0
            rows, weight = [], 0
            for row in packed(sig, own, names, parts):
                rows.append(row)
                weight += len(row[1])
                if weight > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["part", "body"])
                    rows, weight = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["part", "body"])

        for batch in batches:
            for _, h, n in _sets(batch, width):
                nodes, new = fresh.of(h, n)
                if new.any():
                    own, sig = signatures(h[np.repeat(new, n)], n[new], bands, table.value)
                    held.append((sig, own, np.array([x for x, y in zip(nodes, new.tolist()) if y], np.int64)))
                    size += len(sig)
                    if size > PACK:
                        yield from out()
        if size:
            yield from out()
        trim()

    def opened(batches):
        import pyarrow as pa

        for batch in batches:
            for body in batch.column("body"):
                sig, node = unpacked(body.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], ["sig", "node"])

    def grouped(batches):
        import pyarrow as pa

        sig, node = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the last signature, which may go on
        rows, known, size = [], set(), 0
        long, least = None, 0  # the signature of which a part is out, and the least node in it

        def out():
            nonlocal rows, size
            made = [pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)]
            offsets = np.append(0, np.cumsum([len(x[2]) for x in rows])).astype(np.int32)
            members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*[x[2] for x in rows], np.zeros(0, np.int64)])))
            rows, size = [], 0
            known.clear()
            return pa.RecordBatch.from_arrays([*made, members], ["sig", "least", "members"])

        def close(own, own_sig):
            nonlocal size
            if own_sig == long:
                rows.append((long, least, own))
            elif len(own) > 1 and (raw := own.tobytes()) not in known:
                known.add(raw)
                rows.append((None, int(own[0]), own))
            else:
                return
            size += len(own)

        for batch in batches:
            sig = np.concatenate([sig, batch.column("sig").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            keep = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
            sig, node = sig[keep], node[keep]
            begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            ends = np.append(begin, len(sig))
            many = np.diff(ends) > 1
            many[0] |= int(sig[0]) == long
            for i in np.flatnonzero(many[:-1]):
                close(node[ends[i] : ends[i + 1]], int(sig[ends[i]]))
            sig, node = sig[begin[-1] :], node[begin[-1] :]
            while len(node) > LIST:
                if int(sig[0]) != long:
                    long, least = int(sig[0]), int(node[0])
                close(node[:LIST], long)
                sig, node = sig[LIST:], node[LIST:]
            if size > 500_000:
                yield out()
        if len(node):
            close(node, int(sig[0]))
        yield out()

    blocks = docs.where("doc_id IS NOT NULL").mapInArrow(emit, "part int, body binary").repartitionById(parts, "part")
    signed = blocks.mapInArrow(opened, "sig long, node long")
    return signed.sortWithinPartitions("sig", "node").mapInArrow(grouped, "sig long, least long, members array<long>")


def filtered(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids, and few others: by a bitmap of fixed size, made with built-in aggregates."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    marks = ids.select(place("doc_id").alias("p")).groupBy(F.call_function("bitmap_bucket_number", F.col("p")).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("p"))).alias("bits"))
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in marks.collect():  # at most FILTER_BITS / 32768 rows of 4 kB
        own = np.frombuffer(bytes(r.bits), np.uint8)
        whole[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + len(own)] = own
    table = docs.sparkSession.sparkContext.broadcast(whole)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            p = batch.column("p").fill_null(1).to_numpy(zero_copy_only=False) - 1
            yield batch.filter(pa.array((table.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)).select(["doc_id", "text"])

    return docs.select("doc_id", "text", place("doc_id").alias("p")).mapInArrow(rows, "doc_id long, text string")


def named_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, n, hashes): names, sizes and 48-bit hashes of the sets of the documents in ids (doc_id)."""

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            for _, h, n in _sets(batch, width):
                stop = np.cumsum(n)
                own = [h[b - size : b] for b, size in zip(stop.tolist(), n.tolist()) if size]
                short = [np.ascontiguousarray((x >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array(short, pa.binary())], ["node", "n", "hashes"])
        trim()

    made = filtered(docs, ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return written(made.select("text").mapInArrow(sets, "node long, n long, hashes binary"), "sets")


def _compared(full: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): stars of the linked nodes within each block (columns keys) of full (node, hashes)."""

    def joined(batches):
        import pyarrow as pa

        held, now = [], None

        def flush():
            if len(held) > 1:
                ids = np.array([x for x, _ in held])
                i, j = links([s for _, s in held], percent)
                if len(i):
                    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in union(ids[i], ids[j])], ["a", "b"])

        for batch in batches:
            for key, node, raw in zip(zip(*(batch.column(c).to_pylist() for c in keys)), batch.column("node").to_pylist(), batch.column("hashes")):
                if key != now:
                    if (out := flush()) is not None:
                        yield out
                    held, now = [], key
                h = np.zeros((raw.as_buffer().size // 6, 8), np.uint8)
                h[:, :6] = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, 6)
                held.append((node, h.view(np.uint64).ravel()))
        if (out := flush()) is not None:
            yield out

    spread = full.select(*keys, "node", "hashes").repartition(partitions(full.sparkSession), *keys)
    return spread.sortWithinPartitions(*keys).mapInArrow(joined, "a long, b long")


def beside_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): stars of linked nodes, each compared with its hub and others of that hub. pairs: hub, node.

    A hub with many nodes is repeated in as many blocks as they need, so that no block is large.
    """
    some = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = pairs.join(sets.select("node", "n"), "node").groupBy("hub").agg(some.alias("blocks"))
    items = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node")
    items = items.unionByName(blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.col("hub").alias("node")))
    return _compared(items.join(sets.select("node", "hashes"), "node"), ["hub", "block"], percent)


def placed(rows: DataFrame, most: int) -> DataFrame:
    """(gid, i, j, main, node, component): blocks in which the nodes of each group (gid, node, component, n) meet all those of other components.

    Groups of one component are left out. The largest component's nodes only meet the rest; either is cut into parts of about `most`
    nodes and BLOCK_SHINGLES shingles, and each part of the rest meets each of the largest component and each of the rest.
    """
    each = rows.groupBy("gid", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    main = each.groupBy("gid").agg(F.max(F.struct("m", "component", "w")).alias("main"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    parts = lambda m, w: F.greatest(F.ceil(m / most), F.ceil(w / BLOCK_SHINGLES), F.lit(1)).cast("int")
    rest = parts(F.col("m") - F.col("main.m"), F.col("w") - F.col("main.w"))
    main = written(main.select("gid", F.col("main.component").alias("main"), parts(F.col("main.m"), F.col("main.w")).alias("mains"), rest.alias("others")), "open")
    item = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    every = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    first = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(first, F.col("mains")).otherwise(F.col("others"))).cast("int")
    beside = F.concat(
        F.transform(every(F.col("mains")), lambda j: item(F.col("own"), j)),
        F.transform(every(F.col("own")), lambda j: item(F.col("own"), F.col("mains") + j)),
        F.transform(F.filter(every(F.col("others")), lambda x: x > F.col("own")), lambda i: item(i, F.col("mains") + F.col("own"))),
    )
    items = F.when(first, F.transform(every(F.col("others")), lambda i: item(i, F.col("own")))).otherwise(beside)
    met = rows.join(main, "gid").withColumn("own", own)
    return met.select("gid", F.explode(items).alias("item"), "node", "component", first.alias("main")).select("gid", "item.i", "item.j", "main", "node", "component")


def plausible(lists: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(u, v): edges that join the nodes that share a list (gid, members) and may be linked, by sizes and cell counts (known: node, n, cells)."""
    rows = lists.select("gid", F.explode("members").alias("node"))
    full = placed(rows.select("gid", "node", F.col("node").alias("component"), F.lit(0).alias("n")), LIST).join(known.select("node", "n", "cells"), "node")

    def sifted(batches):
        import pyarrow as pa

        bands, held, now = Bands(percent), [], None

        def flush():
            held.sort(key=lambda x: not x[0])
            ids, comp, n = (np.array([x[i] for x in held], np.int64) for i in (1, 2, 3))
            width = min(len(x[4]) for x in held)
            cells = np.stack([np.frombuffer(x[4], np.uint8).reshape(-1, width).sum(0, dtype=np.int16) for x in held])
            a, b = [], []
            for i in range(max(1, sum(x[0] for x in held)), len(ids)):
                may = np.flatnonzero((comp[:i] != comp[i]) & (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i])))
                fine = may[np.abs(cells[may] - cells[i]).sum(1, dtype=np.int32) <= bands.differ(n[may], n[i])]
                a.append(np.full(len(fine), i))
                b.append(fine)
            if a and len(i := np.concatenate(a)):
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in union(ids[i], ids[np.concatenate(b)])], ["u", "v"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gid", "i", "j", "main", "node", "component", "n", "cells")]
            for gid, i, j, *row in zip(*columns):
                if (gid, i, j) != now:
                    if len(held) > 1 and (out := flush()) is not None:
                        yield out
                    held, now = [], (gid, i, j)
                held.append(row)
        if len(held) > 1 and (out := flush()) is not None:
            yield out

    spread = full.select("gid", "i", "j", "main", "node", "component", "n", "cells").repartition(partitions(lists.sparkSession), "gid", "i", "j")
    return spread.sortWithinPartitions("gid", "i", "j").mapInArrow(sifted, "u long, v long")


def within_clusters(clusters: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): stars of linked nodes, each compared with those of its cluster (node, cluster) that are in other components."""
    rows = clusters.join(components, "node", "left").join(sets.select("node", "n"), "node").select(F.col("cluster").alias("gid"), "node", F.coalesce("component", "node").alias("component"), "n")
    return _compared(placed(written(rows, "clusters"), BLOCK).join(sets.select("node", "hashes"), "node"), ["gid", "i", "j"], percent)


def similar_groups(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; other columns are ignored).

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the least doc_id that
    links reach, itself included. Null and empty texts and those without words have no shingles, no links and are their own component; texts of fewer
    than `width` words have one shingle, the whole. Rows that share a doc_id are one document of which each row has its size;
    rows without doc_id have no component. No rows, no groups.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes, counts = shingle_classes(docs, width)
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(partitions(spark), ceil(total / 2_000_000))
    found = written(candidates(docs, width, percent, rarity(merged_sketch(counts)), parts), "candidates")
    short = found.where("sig IS NULL").select("members").distinct().select(F.xxhash64("members").alias("gid"), F.col("members")[0].alias("least"), "members")
    lists = written(short.unionByName(found.where("sig IS NOT NULL").select(F.col("sig").alias("gid"), "least", "members")), "lists")
    known = classes.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("cells").alias("cells"), F.min("doc_id").alias("doc_id"))
    known = written(known.join(lists.select(F.explode("members").alias("node")).distinct(), "node", "left_semi"), "known")
    may = written(plausible(lists, known, percent), "may")
    clusters = connected_components(may).withColumnRenamed("component", "cluster")
    ids = written(known.join(clusters, "node", "left_semi").select("doc_id").distinct(), "ids")
    sets = named_sets(docs, ids, width)
    hubs = may.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("hub"))
    components = connected_components(written(beside_hubs(hubs, sets, percent), "links"))
    more = written(within_clusters(clusters, components, sets, percent), "links")
    components = connected_components(components.toDF("a", "b").unionByName(more))
    # a node's least document stands for it; rows that share a doc_id belong together
    own = classes.where("node IS NOT NULL AND doc_id IS NOT NULL")
    twice = own.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most")
    same = written(own.join(twice, "doc_id").select(F.col("node").alias("a"), "b"), "same")
    if not same.isEmpty():
        components = connected_components(components.toDF("a", "b").unionByName(same))
    least = own.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = written(least.join(components, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "named")
    smallest = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = written(named.join(smallest, "component").select("node", "component_id"), "components")
    return classes.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The rows of docs that are their group's least document; columns as they came, rows without doc_id stay."""
    keep = similar_groups(docs.select("doc_id", "text"), percent, width).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(keep, docs["doc_id"] == keep["_kept"], "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
