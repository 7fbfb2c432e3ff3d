"""Token ids as wavelet matrices in shard files.

File format (little-endian): the magic ``SLWM0001``; int64 tokens n, documents d, bits b; d document ids (int64),
d validity bytes, d token counts (int64); then for each of b bit-planes, highest bit first: int64 number of
zeros, ceil(n / 64) 64-bit words of bits, ceil(n / 512) + 1 uint32 ranks (ones before each block of 512 bits).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .common import new_path, ship, written

MAGIC, BLOCK = b"SLWM0001", 512


class WaveletMatrix:
    """A sequence of n ids below 2**bits: access, rank, count, select and decoding of ranges, from bit-planes."""

    def __init__(self, n: int, bits: int, planes):
        self.n, self.bits, self.planes = n, bits, planes

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        x = np.asarray(ids, np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for k in range(bits - 1, -1, -1):
            one = ((x >> k) & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            padded = np.zeros(-(-len(x) // 64) * 8, np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(np.append(padded, np.zeros(-len(padded) % (BLOCK // 8), np.uint8)).view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
            planes.append((int(len(x) - ones.sum()), padded, np.append(0, np.cumsum(ones)).astype(np.uint32)))
            x = np.concatenate([x[~one], x[one]])
        return cls(len(x), bits, planes)

    def _rank1(self, plane, i):
        """Ones among the first i bits; i may be an array."""
        _, packed, ranks = plane
        i = np.asarray(i, np.int64)
        words = np.append(packed, np.zeros(BLOCK // 8 + 8, np.uint8))[: (len(packed) // 8 + BLOCK // 64) * 8].view(np.uint64)
        out = ranks[i // BLOCK].astype(np.int64)
        base, full = i // BLOCK * (BLOCK // 64), i % BLOCK // 64
        for j in range(BLOCK // 64):
            w = words[base + j]
            keep = np.where(full == j, (np.uint64(1) << (i % 64).astype(np.uint64)) - np.uint64(1), np.where(full > j, ~np.uint64(0), np.uint64(0)))
            out = out + np.bitwise_count(w & keep)
        return out

    def access(self, i):
        """The ids at positions i."""
        i = np.asarray(i, np.int64)
        out = np.zeros(i.shape, np.int64)
        for zeros, packed, ranks in self.planes:
            bit = (packed[i // 8] >> (i % 8).astype(np.uint8)) & 1
            r = self._rank1((zeros, packed, ranks), i)
            out = out * 2 + bit
            i = np.where(bit == 1, zeros + r, i - r)
        return out

    def rank(self, token: int, i: int) -> int:
        """How often the id stands among the first i."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = 0, i
        for k, plane in enumerate(self.planes):
            ra, rb = (int(x) for x in self._rank1(plane, [a, b]))
            a, b = (plane[0] + ra, plane[0] + rb) if token >> (self.bits - 1 - k) & 1 else (a - ra, b - rb)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence, or -1."""
        if not 0 <= k < self.count(token):
            return -1
        a = 0
        for j, plane in enumerate(self.planes):
            r = int(self._rank1(plane, a))
            a = plane[0] + r if token >> (self.bits - 1 - j) & 1 else a - r
        at = a + k
        for j in range(self.bits - 1, -1, -1):
            zeros = self.planes[j][0]
            one = token >> (self.bits - 1 - j) & 1
            want = at - zeros if one else at
            low, high = 0, self.n
            while low < high:  # the least position with more than `want` such bits up to and with it
                mid = (low + high) // 2
                r = int(self._rank1(self.planes[j], mid + 1))
                low, high = (low, mid) if (r if one else mid + 1 - r) > want else (mid + 1, high)
            at = low
        return at

    def decode(self) -> np.ndarray:
        """All ids: the planes' stable partitions undone from the last to the first."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k, (zeros, packed, _) in enumerate(reversed(self.planes)):
            one = np.unpackbits(packed, count=self.n, bitorder="little").astype(bool)
            y = np.empty_like(x)
            y[~one] = x[:zeros]
            y[one] = x[zeros:] | x.dtype.type(1 << k)
            x = y
        return x


def dump(doc_ids, valid, counts, ids: np.ndarray, bits: int) -> bytes:
    m = WaveletMatrix.build(ids, bits)
    parts = [MAGIC, struct.pack("<3q", m.n, len(counts), bits), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(valid, np.uint8).tobytes(), np.asarray(counts, "<i8").tobytes()]
    for zeros, packed, ranks in m.planes:
        parts += [struct.pack("<q", zeros), packed.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(parts)


def load(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    n, d, bits = struct.unpack_from("<3q", data, 8)
    at = 32
    doc_ids = np.frombuffer(data, "<i8", d, at)
    valid = np.frombuffer(data, np.uint8, d, at + 8 * d)
    counts = np.frombuffer(data, "<i8", d, at + 9 * d)
    at += 17 * d
    words, blocks, planes = -(-n // 64) * 8, -(-(-(-n // 64) * 64) // BLOCK) + 1, []
    for _ in range(bits):
        (zeros,) = struct.unpack_from("<q", data, at)
        planes.append((zeros, np.frombuffer(data, np.uint8, words, at + 8), np.frombuffer(data, "<u4", blocks, at + 8 + words)))
        at += 8 + words + 4 * blocks
    return doc_ids, valid, counts, WaveletMatrix(n, bits, planes)


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = 1, bits: int = 16, most: int = 1 << 21) -> DataFrame:
    """Encodes every whole text and writes shard files of about `most` tokens under `path`, in ascending (doc_id, text) order.

    docs: doc_id, text; other columns are ignored. A null text is empty (its only id is `end`); a null doc_id sorts first;
    repeated rows are documents of their own; without rows there are no files. Ids of `bits` bits or more raise ValueError.
    A document is in one file whole, so one of more than `most` tokens makes a longer file.
    Returns the manifest, one row a file: part, seq, file, documents, tokens. Files have names of their own for each attempt,
    and only those of the attempts that Spark committed are in the manifest, so a lost executor leaves unused files at worst.
    """
    spark = docs.sparkSession
    ship(spark)

    def shards(rows):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        from stratalog.llm.tokens import Encoder, batches, merged

        store, root = fs.FileSystem.from_uri(path)
        encoder, part, seq = Encoder.of(vocabulary), TaskContext.get().partitionId(), 0
        held, tokens = [], 0

        def flush():
            nonlocal held, tokens, seq
            columns = [np.concatenate([x[i] for x in held]) for i in range(4)]
            if len(columns[3]) and int(columns[3].max()) >> bits:
                raise ValueError(f"a token id needs more than {bits} bits")
            name = f"{part:07d}-{seq:06d}-{uuid.uuid4().hex}.slwm"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(dump(*columns, bits))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "file": [name], "documents": pa.array([len(columns[0])], pa.int64()), "tokens": pa.array([len(columns[3])], pa.int64())})
            held, tokens, seq = [], 0, seq + 1
            return row

        for batch in merged(rows):
            for first, texts in batches(batch.column("text")):
                ids, n = encoder.encode(texts, end)
                own = batch.column("doc_id").slice(first, len(texts))
                held.append((own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False), n, ids))
                tokens += len(ids)
                while tokens >= most:  # cut at documents
                    doc, ok, n, ids = (np.concatenate([x[i] for x in held]) for i in range(4))
                    k = int(np.searchsorted(np.cumsum(n), most)) + 1
                    at = int(n[:k].sum())
                    held = [(doc[:k], ok[:k], n[:k], ids[:at])]
                    yield flush()
                    held, tokens = ([(doc[k:], ok[k:], n[k:], ids[at:])], len(ids) - at) if k < len(n) else ([], 0)
        if held:
            yield flush()
        encoder.forget()

    # as many ranges as the scan has splits: about a split's text for each task
    ranges = max(1, docs.rdd.getNumPartitions())
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return written(ordered.mapInArrow(shards, "part long, seq long, file string, documents long, tokens long"), "manifest")


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """One row a document from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts come from a running sum over the manifest, which has a row for each file of millions of tokens.
    """
    spark = manifest.sparkSession
    ship(spark)

    def documents(rows):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in rows:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as f:
                    doc_ids, valid, counts, matrix = load(f.read())
                ids = memoryview(matrix.decode().astype("<u4")).cast("B")
                stop = np.cumsum(counts)
                crc = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for b, n in zip(stop.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=valid == 0), pa.array(stop - counts + start, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")).alias("start"))
    return files.repartition(max(1, manifest.count())).mapInArrow(documents, T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]))


def encode_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, path, vocabulary), path)
