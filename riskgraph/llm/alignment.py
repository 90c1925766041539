"""Alignment of two tokenizers over byte offsets, with corpus counts of linked id pairs under a minimal perfect hash.

A text, with a space before it, is encoded by A (byte-level) and by B (pieces, which adds that space itself). Places where
tokens of both end cut it into groups; an A and a B token whose byte ranges overlap are linked. An id pair's count is the
number of documents that hold it linked.

Texts are aligned once, in blocks, whose words, links and digests are written to the shared folder. First pass over these:
each task sums the pairs' document counts. The distinct pairs are dealt into shards of
bounded size, each with a minimal perfect hash and its keys in slot order. The tasks' counts become dense vectors indexed by
the hash, a few tasks to a vector, which are summed in a tree. Second pass: the blocks' links are
looked up; a key that isn't the one stored in its slot is an error. Vectors of up to ``LOOKUP_BYTES`` are broadcast at
once; if all pairs together need more, the second pass runs once for each such part and the parts' sums are added.

Both vocabularies end a token before a space or line end that stands alone between other characters, so words are aligned
by word: a block's new words are encoded together, and a worker remembers their alignments. Special tokens' strings in texts are plain text. Texts that are
null or empty, and those whose tokens' bytes differ from the text (a text that holds U+2581), have no tokens: zeros and ''.
Very long texts are held by one task as a whole, as their groups have one digest, but aligned word by word. Repeated rows are
documents of their own and count as often; ties at an A id's highest count are all best; rows without id are rows like others. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, stored
from .resampling import blocks
from .token_files import PerfectHash, _mix

#: Bytes of texts aligned together; words, and bytes of them and their groups, that one worker remembers from one block to the next.
BLOCK_BYTES = 1 << 20
REMEMBERED, REMEMBERED_BYTES = 400_000, 48 << 20
#: Pairs that one task sums before it puts them out.
TASK_PAIRS = 4 << 20
#: Keys of one hash, about; vectors added at once; bytes of keys, counts and hashes broadcast at once.
SHARD_KEYS = 1 << 16
FAN = 16
LOOKUP_BYTES = 64 << 20

#: Files of blocks are cut into parts of so many bytes, as a reader holds a part at once; a block is a row of more than a MB.
PART_BYTES = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Uneven(Exception):
    """A word that white space stands beside."""


def _byte_characters() -> dict[str, int]:
    """Byte-level vocabularies spell a byte as its Latin-1 character if that is visible, others from U+0100 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = _byte_characters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.width = len(pieces)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        # an id's text inside a group and at the end of its side
        self.texts = [f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"] + [f"{i}{c}" for i in range(self.width) for c in ",;"]
        self.text_sizes = np.array([len(x) for x in self.texts], np.int64)
        # whether words can be aligned by themselves
        cuts = self.a.pre_tokenizer.pre_tokenize_str(" a b\nc") if self.a.pre_tokenizer else []
        self.by_word = {0, 2, 4, 5} <= {at[0] for _, at in cuts} and not any(
            "\n" in p or "▁" in p.lstrip("▁") for p in pieces)

    def encode(self, content: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and B of content, which begins with a space or a line end; None if their bytes are others."""
        a = self.a.encode(content, add_special_tokens=False).ids
        b = self.b.encode(content[1:] if content[0] == " " else content)
        if content[0] != " ":
            if self.b_bytes[b[0]] != b" ":
                return None
            b = b[1:]
        raw = content.encode("utf-8", "surrogatepass")
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None

    def align(self, contents: list[str]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
        """For parts of the contents in order: numbers of A tokens, B tokens, groups and links of each (-1 where the tokens'
        bytes are others), the groups as text, the links' codes. They are encoded in one text, as tokens of both end where
        one content ends; where that isn't so, or bytes differ, in halves."""
        ids = self.encode("".join(contents))
        if ids is not None:
            a, b = ids
            a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in contents])
            # what lies between two neighbouring ends of either side belongs to one token of each: a link
            either, times = _distinct(np.concatenate([a_ends, b_ends]))
            both = either[times == 2]
            if np.isin(ends, both, assume_unique=True).all():
                codes = a[np.searchsorted(a_ends, either)] * self.width + b[np.searchsorted(b_ends, either)]
                sizes = np.stack([np.bincount(np.searchsorted(ends, e), minlength=len(ends)) for e in (a_ends, b_ends, both, either)], 1)
                a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
                order = np.argsort(np.concatenate([a_group, b_group]), kind="stable")
                token = np.concatenate([
                    2 * a + (both[a_group] == a_ends), 2 * (len(self.a_bytes) + b) + (both[b_group] == b_ends)])[order]
                text = "".join(map(self.texts.__getitem__, token.tolist())).encode()
                last = np.cumsum(self.text_sizes[token])[np.cumsum(sizes[:, 0] + sizes[:, 1]) - 1].tolist()
                yield sizes, [text[s:e - 1] for s, e in zip([0, *last], last, strict=False)], codes
                return
        if len(contents) == 1:
            yield np.array([[-1, -1, -1, 0]]), [b""], np.zeros(0, np.int64)
            return
        half = len(contents) // 2
        yield from self.align(contents[:half])
        yield from self.align(contents[half:])


class Words(dict):
    """Numbers of words met, and their alignments by number."""

    def __init__(self, pair: Pair) -> None:
        super().__init__()
        self.pair = pair
        self.sizes = array("q")  # tokens of A and B, groups, links; -1 where the bytes differ
        self.groups: list[bytes] = []
        self.codes = array("q")  # links
        self.new: list[str] = []  # not aligned yet
        self.alone: list[int] = []  # of these, what stands beside more white space or can't be aligned
        self.bytes = 0

    def __missing__(self, key: str) -> int:
        if key[:1] == " ":
            self.alone.append(len(self.new))
            content = key
        else:
            core = key[1:] if key[:1] == "\n" else key
            if not core or core[0].isspace() or core[-1].isspace():
                raise _Uneven
            content = key if key[0] == "\n" else " " + key
            if "▁" in key:
                self.alone.append(len(self.new))
        self.new.append(content)
        self[key] = len(self)
        return self[key]

    def of_text(self, text: str) -> list[int]:
        """Numbers of the text's words in order."""
        if not text:
            return []
        if not self.pair.by_word:
            return [self[" " + text]]
        try:
            return list(map(self.__getitem__, text.replace("\n", " \n").split(" ")))
        except _Uneven:
            return [self[" " + w] for w in _SINGLE_SPACE.split(text)]

    def align(self) -> None:
        """The new words."""
        at = 0
        for i in [*self.alone, len(self.new)]:
            for part in (self.new[at:i], self.new[i:i + 1]):
                for sizes, groups, codes in self.pair.align(part) if part else ():
                    self.sizes.frombytes(sizes.astype(np.int64).tobytes())
                    self.groups += groups
                    self.codes.frombytes(codes.tobytes())
                    self.bytes += sum(map(len, part)) + sum(map(len, groups))
            at = i + 1
        self.new, self.alone = [], []

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words' numbers, ends of texts); a text with a word whose bytes differ has none."""
        found = [self.of_text(t.decode("utf-8", "surrogatepass")) for t in texts]
        self.align()
        ends = np.cumsum([len(f) for f in found])
        numbers = np.fromiter(chain.from_iterable(found), np.int64, int(ends[-1]))
        odd = np.frombuffer(self.sizes, np.int64)[::4][numbers] < 0 if len(numbers) else np.zeros(0, bool)
        if odd.any():
            of = np.searchsorted(ends, np.arange(len(numbers)), "right")
            gone = np.bincount(of, weights=odd, minlength=len(texts)) > 0
            numbers = numbers[~gone[of]]
            ends = np.cumsum(np.where(gone, 0, np.diff(ends, prepend=0)))
        return numbers, ends

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all words, places where each word's begin, one more at the end)."""
        n = np.array(self.sizes, np.int64).reshape(-1, 4)[:, 3]
        return np.array(self.codes, np.int64), np.concatenate([[0], np.cumsum(n)])


def _remembered(paths: tuple[str, str]) -> Words:
    """The worker's words, begun anew when they are too many."""
    held = in_worker(("words", paths), lambda: [Words(Pair(*paths))])
    if len(held[0]) > REMEMBERED or held[0].bytes > REMEMBERED_BYTES:
        held[0] = Words(held[0].pair)
    return held[0]


def _spread(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, place in the codes) of every link of the words."""
    n = starts[words + 1] - starts[words]
    owner = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[words], n)
    return owner, at


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each occurs."""
    x = np.sort(x, kind="stable")  # fast on a few sorted runs, which most are
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate(codes), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def shard_hash(codes: np.ndarray) -> np.ndarray:
    return (_mix(codes, 77) >> np.uint64(34)).astype(np.int32)


def _array(data: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(data, kind)


ALIGNED = ("doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
           "groups_sha256 array<string>, ends binary, words binary, times binary, word_ends binary, links binary, codes binary")
_LINKS = ("ends", "words", "times", "word_ends", "links", "codes")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each block of texts: their ids, sizes and digests. For the links: ``codes``, the block's distinct pairs (A id
    times B's vocabulary, plus B id), 64-bit; ``links``, the words' links as places in codes; ``word_ends``, where each word's
    links end; ``words`` and ``times``, each text's distinct words and how often it holds them; ``ends``, where each text's end."""
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1), BLOCK_BYTES):
                known = _remembered((a_path, b_path))
                numbers, ends = known.of_texts(texts)
                codes, starts = known.links()
                bounds = np.concatenate([[0], ends])
                sizes = np.array(known.sizes, np.int64).reshape(-1, 4)
                numbers_list, b = numbers.tolist(), bounds.tolist()
                digests = [hashlib.sha256(b";".join(map(known.groups.__getitem__, numbers_list[s:e]))).hexdigest() if e > s else ""
                           for s, e in zip(b[:-1], b[1:], strict=True)]
                used, _ = _distinct(numbers)
                place = np.zeros(len(known.groups), np.int64)
                place[used] = np.arange(len(used))
                of = np.repeat(np.arange(len(texts)), np.diff(bounds))
                words, times = _distinct(of * max(1, len(used)) + place[numbers])
                text_ends = np.searchsorted(words, np.arange(1, len(texts) + 1) * max(1, len(used)))
                owner, at = _spread(used, starts)
                pairs, _ = _distinct(codes[at])
                row = [batch.column(0).slice(first, len(texts)).to_pylist(),
                       *(np.diff(np.concatenate([[0], np.cumsum(v[numbers])])[bounds]) for v in sizes.T), digests,
                       *(x.astype(np.int32).tobytes() for x in (
                           text_ends, words % max(1, len(used)), times, np.cumsum(np.bincount(owner, minlength=len(used))),
                           np.searchsorted(pairs, codes[at]))), pairs.tobytes()]
                kinds = [*[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.binary()] * len(_LINKS)]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Of aligned blocks: code, hash and n, the number of a task's documents that hold it; part, the task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = done = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(codes[0]), pa.array(shard_hash(codes[0])), pa.array(counts[0])], ["code", "hash", "n"])

        for batch in batches:
            for ends, words, word_ends, links, keys in zip(*batch.columns, strict=True):
                ends, words, word_ends, links = (_array(x.as_py()) for x in (ends, words, word_ends, links))
                keys = _array(keys.as_py(), np.int64)
                if not len(keys):
                    continue
                owner, at = _spread(words, np.concatenate([[0], word_ends]))
                of = np.searchsorted(ends, np.arange(len(words)), "right")
                in_doc, _ = _distinct(of[owner] * len(keys) + links[at])
                codes.append(keys)
                counts.append(np.bincount(in_doc % len(keys), minlength=len(keys)))
                held += len(keys)
                if held > 2 * done + TASK_PAIRS // 4:
                    summed = _summed(codes, counts)
                    codes, counts = [summed[0]], [summed[1]]
                    held = done = len(codes[0])
                    if held >= TASK_PAIRS:
                        yield out()
                        codes, counts, held, done = [], [], 0, 0
        if codes:
            summed = _summed(codes, counts)
            codes, counts = [summed[0]], [summed[1]]
            yield out()

    return rows.select("ends", "words", "word_ends", "links", "codes").mapInArrow(
        count, "code long, hash int, n long").withColumn("part", F.spark_partition_id())


INDEX = "shard int, keys long, sizes array<long>, levels array<binary>, codes binary"


def hashes(pairs: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """A minimal perfect hash for each shard of the distinct codes, with the codes in slot order, and the number of shards."""
    keys = stored(pairs.select("code", "hash").distinct(), "pair-keys")
    shards = max(1, -(-keys.count() // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        codes = table.column("code").to_numpy()
        index = PerfectHash.build(codes)
        slots = index.slots(codes)
        ordered = np.zeros(len(codes), np.int64)
        ordered[slots] = codes
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "keys": pa.array([len(codes)], pa.int64()),
            "sizes": pa.array([[len(b) for b in index.levels]], pa.list_(pa.int64())),
            "levels": pa.array([[np.packbits(b).tobytes() for b in index.levels]], pa.list_(pa.binary())),
            "codes": pa.array([ordered.tobytes()], pa.binary())})

    dealt = keys.select("code", (F.col("hash") % shards).alias("shard"))
    return stored(dealt.groupBy("shard").applyInArrow(build, INDEX), "pair-hashes"), shards


def _index(row: dict) -> PerfectHash:
    return PerfectHash([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
                        for n, b in zip(row["sizes"], row["levels"], strict=True)])


def count_vectors(pairs: DataFrame, index: DataFrame, shards: int, fan: int = FAN) -> DataFrame:
    """shard and counts: the dense vector of each shard, in slot order, summed in a tree over the tasks."""
    groups = ((pairs.agg(F.max("part").alias("m")).first()["m"] or 0) // fan) + 1
    schema = "shard int, grp int, counts binary"

    def vector(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "grp": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
        row = right.to_pylist()[0]
        codes = left.column("code").to_numpy()
        slots = _index(row).slots(codes)
        if (np.frombuffer(row["codes"], np.int64)[slots] != codes).any():
            raise ValueError("a pair is missing from its hash")
        total = np.zeros(row["keys"], np.int64)
        np.add.at(total, slots, left.column("n").to_numpy())
        return pa.table({"shard": pa.array([row["shard"]], pa.int32()), "grp": pa.array([row["grp"]], pa.int32()),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), np.int64) for v in table.column("counts"))
        return pa.table({"shard": table.column("shard")[:1], "grp": table.column("grp")[:1],
                         "counts": pa.array([total.tobytes()], pa.binary())})

    left = pairs.select("code", "n", (F.col("hash") % shards).alias("shard"), F.floor(F.col("part") / fan).cast("int").alias("grp"))
    right = index.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    vectors = left.groupBy("shard", "grp").cogroup(right.groupBy("shard", "grp")).applyInArrow(vector, schema)
    while groups > 1:
        vectors = vectors.withColumn("grp", F.floor(F.col("grp") / fan).cast("int")).groupBy("shard", "grp").applyInArrow(add, schema)
        groups = -(-groups // fan)
    return vectors.select("shard", "counts")


class Lookup:
    """Counts of the pairs of some shards, and the highest count of each A id."""

    def __init__(self, rows: list[dict], shards: int, best: np.ndarray, width: int) -> None:
        self.shards, self.best, self.width = shards, best, width
        self.of = {r["shard"]: (_index(r), np.frombuffer(r["codes"], np.int64), np.frombuffer(r["counts"], np.int64)) for r in rows}

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """Of each code; 0 of those in other shards."""
        out = np.zeros(len(codes), np.int64)
        shard = shard_hash(codes) % self.shards
        order = np.argsort(shard, kind="stable")
        at = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, (index, keys, counts) in self.of.items():
            mine = order[at[s]:at[s + 1]]
            if len(mine):
                slots = index.slots(codes[mine])
                if (slots < 0).any() or (keys[slots] != codes[mine]).any():
                    raise ValueError("a pair is missing from its hash")
                out[mine] = counts[slots]
        return out

    def best_of(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether each code has its A id's highest count."""
        return (counts > 0) & (counts == self.best[codes // self.width])


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _measured(rows: DataFrame, lookup) -> DataFrame:
    """The second pass over aligned blocks, with the pairs of one broadcast lookup."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                ends, words, times, word_ends, links = (_array(column[c][i].as_py()) for c in _LINKS[:-1])
                codes = _array(column["codes"][i].as_py(), np.int64)
                counts = lookup.value.counts(codes)

                def of_texts(per_code: np.ndarray) -> pa.Array:
                    of_word = np.diff(np.concatenate([[0], np.cumsum(per_code[links])])[np.concatenate([[0], word_ends])])
                    return pa.array(np.diff(np.concatenate([[0], np.cumsum(of_word[words] * times)])[np.concatenate([[0], ends])]))

                found = {"n_best": of_texts(lookup.value.best_of(codes, counts).astype(np.int64)), "count_sum": of_texts(counts)}
                yield pa.RecordBatch.from_arrays([found[c] if c in found else column[c][i].values for c in names], names)

    return rows.mapInArrow(measure, RESULT)


def align_documents(docs: DataFrame, a_path: str, b_path: str, shard_keys: int = SHARD_KEYS, fan: int = FAN,
                    lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    pair = Pair(a_path, b_path)
    width, vocabulary = pair.width, len(pair.a_bytes)
    done = stored(aligned(docs, a_path, b_path), "aligned", **PART_BYTES)
    pairs = stored(pair_counts(done), "pairs")
    index, shards = hashes(pairs, shard_keys)
    table = stored(index.join(count_vectors(pairs, index, shards, fan), "shard"), "pair-counts")

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in zip(batch.column(0), batch.column(1), strict=True):
                top = np.zeros(vocabulary, np.int64)
                np.maximum.at(top, np.frombuffer(codes.as_py(), np.int64) // width, np.frombuffer(counts.as_py(), np.int64))
                used = np.flatnonzero(top)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(top[used], pa.int64())], ["a", "n"])

    best = np.zeros(vocabulary, np.int64)
    for r in table.select("codes", "counts").mapInArrow(highest, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect():
        best[r["a"]] = r["n"]  # a row for each A id at most

    sizes = {r["shard"]: r["n"] for r in table.select("shard", (F.col("keys") * 17).alias("n")).collect()}
    parts: list[list[int]] = [[]]
    for s in sorted(sizes):
        if parts[-1] and sum(sizes[x] for x in parts[-1]) + sizes[s] > lookup_bytes:
            parts.append([])
        parts[-1].append(s)
    found = []
    for part in parts:  # no more than lookup_bytes, or one shard, on the driver at once
        rows = table.filter(F.col("shard").between(min(part), max(part))).collect() if part else []
        lookup = spark.sparkContext.broadcast(Lookup([r.asDict() for r in rows], shards, best, width))
        measured = _measured(done, lookup)
        if len(parts) == 1:
            return measured
        found.append(stored(measured, "measured"))
        lookup.unpersist()
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    fixed = [c.split()[0] for c in RESULT.split(", ") if not c.startswith(("n_best", "count_sum"))]
    # rows alike in all of these have the same links; each part has as many of them
    copies = F.count("*") / len(parts)
    summed = every.groupBy(*fixed).agg(
        *((F.sum(c) / copies).cast("long").alias(c) for c in ("n_best", "count_sum")), copies.cast("long").alias("copies"))
    return summed.select(*fixed, "n_best", "count_sum", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
