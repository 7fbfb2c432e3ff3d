"""Documents packed into sequences of bounded length: best fit first, then swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import ship, written

#: Pieces that one group packs together, about; bounds the memory and time of a task.
GROUP = 2048
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that has room."""
    bins, free = [], []  # free: (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(free, (sizes[i], -1))
        room, b = free.pop(k) if k < len(free) else (cap, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        insort(free, (room - sizes[i], b))
    return bins


class Bin:
    """A bin as sizes and their number: what may leave it, alone or in pairs, is looked up by size, however many items share one."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.fill = sum(sizes)
        self.made = None

    def change(self, gone: tuple[int, ...], come: tuple[int, ...]) -> None:
        for s in gone:
            self.count[s] -= 1
            if not self.count[s]:
                del self.count[s]
        for s in come:
            self.count[s] = self.count.get(s, 0) + 1
        self.fill += sum(come) - sum(gone)
        self.made = None

    def sums(self) -> tuple[list[int], dict[int, tuple[int, int]], list[int]]:
        """(sizes in order; two sizes for each sum that two items make; 0, sizes and sums in order)."""
        if self.made is None:
            ones = sorted(self.count)
            twos = {x + y: (x, y) for i, x in enumerate(ones) for y in ones[: i + 1] if x != y or self.count[x] > 1}
            self.made = ones, twos, sorted({0, *ones, *twos})
        return self.made


def _exchange(giver: Bin, taker: Bin, room: int):
    """The exchange that fills `taker` most: (gain, sizes that leave giver, sizes that leave taker), or None.
    Moves one item, or exchanges one for one, two for one, one for two."""
    ones, twos, _ = giver.sums()
    own, own_twos, outs = taker.sums()
    best, most = None, 0
    for give, back in ((ones, outs), (twos, own)):
        for g in give:
            k = bisect_left(back, g - room)
            if k < len(back) and most < g - back[k]:
                best, most = (g, back[k], give is twos), g - back[k]
                if most == room:
                    break
        if most == room:
            break
    if best is None:
        return None
    g, s, two = best
    return most, twos[g] if two else (g,), () if not s else (s,) if s in taker.count else own_twos[s]


def local_search(sizes: list[int], bins: list[list[int]], cap: int) -> list[list[int]]:
    """Empties bins: the emptiest bin gives to fuller ones as long as that raises the sum of squared fills.

    Each exchange makes a bin at least as full as the giver fuller, so the sum rises and the search ends; it
    stops at the lower bound ceil(total / cap), or when no bin can be emptied.
    """
    held = [Bin([sizes[i] for i in b]) for b in bins]
    least = -(-sum(b.fill for b in held) // cap)
    live = sorted((b for b in held if b.count), key=lambda b: b.fill)
    stuck: set[int] = set()
    while len(live) > least:
        giver = next((b for b in live if id(b) not in stuck and b.fill < cap), None)
        if giver is None:
            break
        others = [b for b in live if b is not giver and b.fill < cap]
        moved = True
        while giver.count and moved:
            moved = False
            for taker in sorted(others, key=lambda b: -b.fill):
                if taker.fill >= cap or taker.fill < giver.fill or not giver.count:
                    continue
                if found := _exchange(giver, taker, cap - taker.fill):
                    _, gone, come = found
                    giver.change(gone, come)
                    taker.change(come, gone)
                    moved = True
        if giver.count:
            stuck.add(id(giver))
        else:
            stuck.clear()
        live = sorted((b for b in live if b.count), key=lambda b: b.fill)
    items: dict[int, list[int]] = {}
    for i in reversed(range(len(sizes))):
        items.setdefault(sizes[i], []).append(i)
    return [[items[s].pop() for s, n in b.count.items() for _ in range(n)] for b in live]


def pack(sizes: list[int], cap: int) -> list[list[int]]:
    return local_search(sizes, best_fit(sizes, cap), cap)


def token_pieces(docs: DataFrame, cap: int, vocabulary: str | None = None, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every whole text's ids, cut only where they are longer than cap."""
    ship(docs.sparkSession)

    def cut(rows):
        import pyarrow as pa

        from stratalog.llm.tokens import Encoder, batches, merged

        encoder = Encoder.of(vocabulary)
        for batch in merged(rows):
            for first, texts in batches(batch.column("text")):
                ids, n = encoder.encode(texts, end)
                per = -(-n // cap)
                doc = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * cap
                length = np.minimum(n[doc] - start, cap)
                at = (np.cumsum(n) - n)[doc] + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
                own = batch.column("doc_id").slice(first, len(texts)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE)


def _grouped(pieces: DataFrame, cap: int, group: int, round_: int) -> DataFrame:
    """The pieces with sequence_id, offset and the sequence's fill, packed within groups of about `group` pieces."""
    ship(pieces.sparkSession)
    groups = max(1, -(-pieces.count() // group))

    def packed(key, pdf):
        sizes = pdf["length"].tolist()
        seq, offset, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, items in enumerate(pack(sizes, cap)):
            at = 0
            for i in items:
                seq[i], offset[i] = (2 * int(key[0]) + round_) << 24 | b, at
                at += sizes[i]
            fill[items] = at
        return pdf.assign(sequence_id=seq, offset=offset, fill=fill)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]].astype({"doc_id": "Int64"})

    # the row's number in the written table deals repeated rows apart, and is the same when a task runs again
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(packed, PIECE + ", sequence_id long, offset long, fill long")


def pack_documents(docs: DataFrame, cap: int = 4096, vocabulary: str | None = None, group: int = GROUP, underfull: float = 0.98) -> DataFrame:
    """Every document's ids (tokenizers library, end id 1) in sequences of at most `cap`.

    docs: doc_id, text; other columns are ignored. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null text is empty and so a piece of one id; a null doc_id stays null; repeated rows are packed each; no rows, no sequences.
    Only documents longer than cap are cut, into pieces of cap and a rest. Full pieces are sequences of their own. The others
    are dealt into groups of about `group` pieces that are packed apart; what then lies in sequences filled below `underfull`
    is packed again, across groups, so that little more than the last sequence of a few groups has room.
    """
    pieces = written(token_pieces(docs, cap, vocabulary), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = pieces.where(F.col("length") == cap).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    first = written(_grouped(pieces.where(F.col("length") < cap), cap, group, 0), "packed")
    loose = F.col("fill") < int(cap * underfull)
    again = _grouped(first.where(loose).drop("sequence_id", "offset", "fill"), cap, group, 1)
    return full.select(columns).unionByName(first.where(~loose).select(columns)).unionByName(again.select(columns))
