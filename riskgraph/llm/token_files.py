"""Token ids as binary shard files with a minimal perfect hash index.

Documents are range-partitioned by id, so files follow each other in ascending order. A file is a row of segments,
each of a bounded number of ids and complete in itself:

    magic "TOKSEG1\\n" | u32 header length | JSON header | index levels | entries | keys | raw ids

The index sends a key to its own slot out of ``n`` (levels of bit arrays; a key's slot is the number of set bits
before its own), the slot's entry holds the key's stored fingerprint, the place of its ids and their number, so a
lookup reads a few words whatever the segment's size, and a key that isn't there fails the fingerprint. Keys are kept
in file order for scans. Ids are little-endian, 16-bit where the vocabulary fits, else 32-bit.

A null text is the end id alone. Repeated ids share a slot, their rows stand beside each other; a row without id has
the reserved key -2**63 and stands first. An empty table gives no segments and an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder, stored

MAGIC = b"TOKSEG1\n"
END_ID = 2
#: Text bytes of one file, about, and ids of one segment, at most one document more.
FILE_BYTES = 16 << 20
SEGMENT_IDS = 2 << 20
NO_KEY = -(1 << 63)
LEVEL_LOAD = 2.0  # bits of an index level for each key that comes to it
MOST_LEVELS = 40
ENTRY = np.dtype([("fingerprint", "<u4"), ("rows", "<u4"), ("at", "<u8"), ("ids", "<u8")])


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over key and seed."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Minimal perfect hash of distinct keys: on each level keys that fall alone into a place keep it."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before = [np.concatenate([[0], np.cumsum(b)]) for b in levels]
        self.start = np.concatenate([[0], np.cumsum([int(b.sum()) for b in levels])])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == MOST_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, int(LEVEL_LOAD * len(left)))
            place = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(place, minlength=size)
            levels.append(hits == 1)
            left = left[hits[place] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of a key that isn't there some slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            place = (_mix(keys[open_], i) % np.uint64(len(bits))).astype(np.int64)
            here = bits[place]
            out[open_[here]] = self.start[i] + self.before[i][place[here]]
            open_ = open_[~here]
        return out


class Segment:
    """One segment read from bytes; ``end`` is where the next begins."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        if data[at:at + 8] != MAGIC:
            raise ValueError(f"no segment at {at}")
        n = int.from_bytes(data[at + 8:at + 12], "little")
        self.header = json.loads(data[at + 12:at + 12 + n])
        at += 12 + n
        levels = []
        for bits in self.header["levels"]:
            size = -(-bits // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=bits).astype(bool))
            at += size
        self.index = PerfectHash(levels)
        self.entries = np.frombuffer(data, ENTRY, self.header["keys"], at)
        at += self.entries.nbytes
        self.keys = np.frombuffer(data, "<i8", self.header["rows"], at)
        at += self.keys.nbytes
        self.lengths = np.frombuffer(data, "<u8", self.header["rows"], at)
        at += self.lengths.nbytes
        self.payload = memoryview(data)[at:at + self.header["payload"]]
        self.end = at + self.header["payload"]
        self.dtype = np.dtype(self.header["dtype"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry number of each key, -1 where the fingerprint says it isn't there."""
        slots = self.index.slots(keys)
        known = (slots >= 0) & (self.entries["fingerprint"][slots] == fingerprints(keys)) if len(self.entries) else slots >= 0
        return np.where(known, slots, -1)

    def ids(self, key: int) -> np.ndarray | None:
        """Ids of the key's rows in constant time."""
        slot = int(self.find(np.array([key], np.int64))[0])
        if slot < 0:
            return None
        e = self.entries[slot]
        return np.frombuffer(self.payload, self.dtype, int(e["ids"]), int(e["at"]))


def segment(keys: list[int], payloads: list[bytes], dtype: str) -> bytes:
    """Bytes of one segment; equal keys must stand beside each other."""
    k = np.array(keys, "<i8")
    sizes = np.array([len(p) for p in payloads], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    last = np.concatenate([first[1:], [len(k)]])
    index = PerfectHash.build(k[first])
    entries = np.zeros(len(first), ENTRY)
    slot = index.slots(k[first])
    wide = np.dtype(dtype).itemsize
    entries["fingerprint"][slot] = fingerprints(k[first])
    entries["rows"][slot] = last - first
    entries["at"][slot] = at[first]
    entries["ids"][slot] = (at[last] - at[first]) // wide
    header = json.dumps({
        "dtype": dtype, "rows": len(k), "keys": len(first), "payload": int(at[-1]),
        "levels": [len(b) for b in index.levels], "least": int(k.min()), "most": int(k.max())}).encode()
    return b"".join([
        MAGIC, len(header).to_bytes(4, "little"), header, *(np.packbits(b).tobytes() for b in index.levels),
        entries.tobytes(), k.tobytes(), (sizes // wide).astype("<u8").tobytes(), *payloads])


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID,
                      file_bytes: int = FILE_BYTES) -> None:
    """Files of segments in ascending id order under ``path``; the writer's commit makes repeated tasks safe."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc = encoder(tokenizer)
        dtype = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        wide = np.dtype(dtype).itemsize
        end = int(end_id).to_bytes(4, "little")
        keys, payloads, size = [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(keys, payloads, dtype)], pa.binary())], ["segment"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                key, text = ids[i].as_py(), texts[i].as_py()
                key = NO_KEY if key is None else key
                if size >= SEGMENT_IDS * wide and key != keys[-1]:
                    yield full()
                    keys, payloads, size = [], [], 0
                raw = enc.encode(text or "") + end
                if wide == 2:
                    raw = np.frombuffer(raw, "<u4").astype("<u2").tobytes()
                keys.append(key)
                payloads.append(raw)
                size += len(raw)
        if keys:
            yield full()

    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    files = max(1, -(-total // file_bytes))
    rows = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    # the text writer puts bytes as they are; its line end after a segment is skipped by the reader
    rows.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string")).write.text(path)


def segments(data: bytes) -> Iterator[Segment]:
    at = 0
    while at < len(data):
        found = Segment(data, at)
        yield found
        at = found.end + 1


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """file, segment, row, doc_id, n_tokens, ids_crc32 of every document, each looked up through the index."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                file = int(name.as_py().rsplit("/part-", 1)[1].split("-")[0])
                for s, seg in enumerate(segments(content.as_py())):
                    slots = seg.find(seg.keys)
                    if (slots < 0).any():
                        raise ValueError(f"{name}: a key is missing from the index")
                    # rows of one key follow each other from the entry's place on
                    wide = seg.dtype.itemsize
                    size = seg.lengths.astype(np.int64) * wide
                    at = seg.entries["at"][slots].astype(np.int64)
                    same = np.concatenate([[False], seg.keys[1:] == seg.keys[:-1]])
                    for i in np.flatnonzero(same):
                        at[i] = at[i - 1] + size[i - 1]
                    crcs = [zlib.crc32(np.frombuffer(seg.payload[a:a + n], seg.dtype).astype("<u4"))
                            for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                    rows = len(crcs)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(rows, file, np.int32)), pa.array(np.full(rows, s, np.int32)),
                        pa.array(np.arange(rows, dtype=np.int32)), pa.array(seg.keys, mask=seg.keys == NO_KEY),
                        pa.array(seg.lengths.astype(np.int64)), pa.array(crcs, pa.int64()),
                    ], ["file", "segment", "row", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, "file int, segment int, row int, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(found: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before it. Files are summed first, so no window holds all rows."""
    bases = found.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(
        "file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("base"))  # a row per file
    in_file = W.partitionBy("file").orderBy("segment", "row")
    return found.withColumn("start", F.sum("n_tokens").over(in_file) - F.col("n_tokens")).join(bases, "file").withColumn(
        "start", F.col("start") + F.col("base"))


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = shared_folder(spark, "tokens")
    write_token_files(docs, tokenizer, path, end_id)
    found = stored(read_token_files(spark, path), "token-rows")
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted ``doc_id`` values by constant-time access, an array of ids for each that exists."""
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1), strict=True):
                k = np.array(wanted.as_py(), np.int64)
                for seg in segments(content.as_py()):
                    mine = k[seg.find(k) >= 0]
                    mine = mine[(mine >= seg.header["least"]) & (mine <= seg.header["most"])]
                    found = [(int(x), seg.ids(int(x)).tolist()) for x in mine]
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                            ["doc_id", "ids"])

    ranges = (
        stored(read_token_files(spark, path), "token-ranges").groupBy("file")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
    wanted = (
        keys.select("doc_id").distinct()
        .join(ranges, F.col("doc_id").between(F.col("lo"), F.col("hi")))
        .groupBy("file").agg(F.collect_list("doc_id").alias("wanted")))
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"/part-(\d+)", 1).cast("int").alias("file"), "content")
    return files.join(wanted, "file").select("content", "wanted").mapInArrow(fetch, "doc_id long, ids array<long>")
