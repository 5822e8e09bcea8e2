"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by doc_id; each task encodes its range and writes one table file: blocks of
prefix-compressed keys with their ids (each block deflated by zstd), a sparse index with the last key of each block, a
Bloom filter over the keys, and a footer that says where these are. A lookup asks the filter, finds the block by binary
search and reads that block alone. A task writes under a name of its own and renames at the end, so a repeated or lost
task leaves whole files only.

Defined results: a null text is encoded as an empty one; a null doc_id has the smallest key; rows with one doc_id
follow each other, by the hash of their text, and a lookup returns them all; very long texts pass through memory one
batch at a time; extra columns are not read; an empty table gives an empty table and no lookup hits.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_or_null, scratch_dir, ship, table, written

MAGIC = b"SSTRUN01"
#: Bytes of a block before compression, Bloom bits for each key and probes, and the id that ends a document.
BLOCK, BITS, PROBES, END = 65_536, 10, 7, 2
#: Pieces of words that a task remembers the ids of (then it starts anew), and bytes of text whose words are told apart together.
MEMO, TOGETHER = 1_000_000, 16_000_000
#: Pieces that are encoded as one string, and the longest such piece.
JOINED, LONGEST = 2_000, 256
#: Python's white space, which holds all of the library's and U+001C to U+001F, as a class of Arrow's expressions.
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space that white space follows, or that ends a text after some.
SPACE_IN_RUN = rf" {SPACES}|{SPACES} \z"
WHITE = re.compile(r"\s").search
#: A Latin letter or ASCII digit before an ASCII mark (neither letter, number nor white space).
BEFORE_MARK = r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~])"

#: A pre-token of Latin letters.
LATIN = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+").fullmatch


# --- the file format ---


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes that sort as the ids do, null first."""
    return bytes(9) if doc_id is None else b"\1" + struct.pack(">Q", (int(doc_id) + 2**63) % 2**64)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - 2**63 if key[0] else None


def probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Writes ascending (key, ids) to one file."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.pack = out, width, zstandard.ZstdCompressor(level=1).compress
        self.at = self.rows = self.tokens = self.n = 0
        self.index: list[tuple[str, int, int]] = []
        self.block, self.last, self.keys = bytearray(), b"", []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        same = 0
        while same < min(len(self.last), len(key)) and self.last[same] == key[same]:
            same += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += struct.pack("<BBI", same, len(key) - same, len(value)) + key[same:] + value
        self.last, self.rows, self.tokens, self.n = key, self.rows + 1, self.tokens + len(ids), self.n + 1
        self.keys.append(zlib.crc32(key) << 32 | (zlib.crc32(key, 0x9E3779B9) | 1))
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.n:
            data = self.pack(bytes(self.block))
            self.out.write(data)
            self.index.append((self.last.hex(), self.at, len(data)))
            self.at, self.block, self.last, self.n = self.at + len(data), bytearray(), b"", 0

    def close(self) -> None:
        self.flush()
        bits = max(64, BITS * self.rows)
        both = np.array(self.keys, dtype=np.uint64)
        filled = np.zeros(bits, dtype=np.uint8)
        for i in range(PROBES):
            filled[((both >> np.uint64(32)) + np.uint64(i) * (both & np.uint64(0xFFFFFFFF))) % np.uint64(bits)] = 1
        index, bloom = self.pack(json.dumps(self.index).encode()), np.packbits(filled).tobytes()
        footer = struct.pack("<QQQQQQB8s", self.at, len(index), self.at + len(index), len(bloom), bits, self.rows, self.width, MAGIC)
        self.out.write(index + bloom + footer)


class Reader:
    """Looks keys up in one file, or scans it in order."""

    TAIL = struct.calcsize("<QQQQQQB8s")

    def __init__(self, path: str):
        import zstandard

        system, name = fs.FileSystem.from_uri(path)
        self.file, self.unpack = system.open_input_file(name), zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        at, length, bloom_at, bloom, self.bits, self.rows, self.width, magic = struct.unpack("<QQQQQQB8s", self.file.read_at(self.TAIL, size - self.TAIL))
        if magic != MAGIC:
            raise ValueError(f"{path} is no table of this format")
        self.index = json.loads(self.unpack(self.file.read_at(length, at)))
        self.last = [bytes.fromhex(k) for k, _, _ in self.index]
        self.bloom = self.file.read_at(bloom, bloom_at)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, length = self.index[i]
        data, pos, key = self.unpack(self.file.read_at(length, at)), 0, b""
        while pos < len(data):
            same, rest, size = struct.unpack_from("<BBI", data, pos)
            pos += 6
            key = key[:same] + data[pos : pos + rest]
            pos += rest
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, pos)
            pos += size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] & (0x80 >> (p & 7)) for p in probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this doc_id."""
        key, found = key_of(doc_id), []
        if self.may_hold(key):
            i = bisect.bisect_left(self.last, key)
            while i < len(self.index):
                found += [v for k, v in self.block(i) if k == key]
                if self.last[i] > key:
                    break
                i += 1
        return found


# --- encoding ---


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """The tokenizers library, with the ids of pieces of words remembered. A pre-token of this byte-level pattern has a space inside
    or at its end only as part of a run of white space (of any kind, U+00A0 and line ends too): where a space is followed by more
    of it, or ends a text after some. A text without either has the ids of its words, each with its space; others go whole. No
    pre-token goes on from a letter or number to a mark, so words are cut there. Arrow tells words and pieces apart and puts their
    ids together; Python sees each piece once for many texts."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        first = self.library.pre_tokenizer
        # whether a pre-token reaches the library's model as its bytes and nothing else
        self.bare = self.library.normalizer is None and isinstance(first, pre_tokenizers.ByteLevel) and first.use_regex and not first.add_prefix_space
        self.model, self.letters = self.library.model, _byte_letters()
        self.width = 2 if self.library.get_vocab_size() < 2**16 else 4
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        alone = self.library.encode("\n", add_special_tokens=False).ids
        self.line_end = alone[0] if len(alone) == 1 else -1

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=f"<u{self.width}").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_token(self, p: str) -> list[int]:
        """The ids that the library's model gives one pre-token. This is what the library does with it, but for the positions and
        types that it keeps of each token and that nobody reads here."""
        return [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters) if not p.isascii() else "\u0120" + p[1:] if p[0] == " " else p)]

    def _learn(self, pieces: list[str]) -> None:
        """Remember pieces. A line end between two other characters is a pre-token, so pieces are cut there. Latin words are one
        pre-token; many others without white space (but a space before them) are encoded as one string, with line ends between them."""
        known, latin, short, other, size = self.known, [], [], [], self.width
        lines = {p: p.split("\n") for p in pieces if "\n" in p}
        several = {p: x for p, x in lines.items() if all(x) and x[0] != " " and not WHITE(p[1:].replace("\n", ""))}
        for p in set(pieces).difference(several).union(*several.values()):
            if p not in known:
                (latin if self.bare and len(p) <= LONGEST and LATIN(p) else other if not p or p == " " or len(p) > LONGEST or WHITE(p, 1) else short).append(p)
        for k in range(0, len(latin), JOINED):
            part = latin[k : k + JOINED]
            ids = list(map(self._pre_token, part))
            cuts = list(accumulate(map(len, ids), initial=0))
            every = np.fromiter(chain.from_iterable(ids), f"<u{size}", cuts[-1]).tobytes()
            known.update(zip(part, [every[a * size : b * size] for a, b in pairwise(cuts)]))
        for k in range(0, len(short), JOINED):
            part = short[k : k + JOINED]
            ids = self._library(["\n".join(part)])[0]
            cuts = np.flatnonzero(np.frombuffer(ids, f"<u{size}") == self.line_end) * size
            if len(cuts) == len(part) - 1:
                cuts = cuts.tolist()
                known.update(zip(part, [ids[a:b] for a, b in zip([0, *[c + size for c in cuts]], [*cuts, len(ids)])]))
            else:  # a pattern or vocabulary that takes line ends otherwise
                other += part
        known.update((p, self._library([p])[0]) for p in other)
        if several:
            between = self._library(["\n"])[0]
            known.update((p, between.join(map(known.__getitem__, x))) for p, x in several.items())

    def _ids(self, words: pa.Array) -> pa.Array:
        """Each word's ids as bytes."""
        cut = pc.split_pattern(pc.replace_substring_regex(words, BEFORE_MARK, "\\1\0\\2"), "\0")
        apart = cut.flatten().dictionary_encode()
        pieces = apart.dictionary.to_pylist()
        if len(self.known) > MEMO:
            self.known.clear()
        found = [self.known.get(p) for p in pieces]
        new = [i for i, f in enumerate(found) if f is None]
        self._learn([pieces[i] for i in new])
        for i in new:
            found[i] = self.known[pieces[i]]
        _, ends, data = pa.array(found, pa.large_binary()).take(apart.indices).buffers()
        at = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()]
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at), data])

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = pc.match_substring_regex(texts, SPACE_IN_RUN)
        for s in ["\0", *self.special]:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        split = pc.split_pattern(texts.filter(pc.invert(whole)), " ")
        begin, words = split.offsets.to_numpy(), split.flatten()
        apart = words.dictionary_encode()
        space, none = (pa.scalar(x, words.type) for x in (" ", ""))
        spaced = pc.binary_join_element_wise(space, apart.dictionary, none)
        # a text's first word has no space before it
        heads = words.take(pa.array(begin[:-1])).dictionary_encode()
        at = apart.indices.to_numpy(zero_copy_only=False).copy()
        at[begin[:-1]] = heads.indices.to_numpy(zero_copy_only=False) + len(spaced)
        ids = self._ids(pa.concat_arrays([spaced, heads.dictionary])).take(pa.array(at))
        kind, (_, offsets, data) = f"<u{self.width}", ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[begin] // self.width
        every = np.frombuffer(data, kind, ends[-1]) if ends[-1] else np.empty(0, kind)
        plain = iter(zip(ends[:-1].tolist(), ends[1:].tolist()))
        return [np.frombuffer(self._library([texts[i].as_py()])[0], kind) if w else every[slice(*next(plain))] for i, w in enumerate(whole.to_pylist())]


def write_tables(docs: DataFrame, vocabulary: str, folder: str, tables: int | None = None, end: int = END) -> DataFrame:
    """Write (doc_id, text) as tables in ``folder``; returns one row per file: part, path, rows, tokens, first, last."""
    spark = docs.sparkSession
    ship(spark)
    n = tables or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    placed = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("rows", pa.int64()), ("tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer = Encoder.load(vocabulary), None
        part = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        name, own = f"part-{part:06d}.sst", f"{root}/_writing-{uuid.uuid4().hex}"
        for b in batches:
            passed = pc.cumulative_sum(pc.binary_length(b.column("text")).cast(pa.int64())).to_numpy() // TOGETHER
            cuts = [*np.flatnonzero(np.diff(passed, prepend=-1)).tolist(), b.num_rows]
            for k, to in zip(cuts, cuts[1:]):
                some = b.slice(k, to - k)
                ids = encoder.encode(some.column("text"))
                if writer is None and ids:
                    system.create_dir(root)
                    writer = Writer(system.open_output_stream(own), encoder.width)
                for doc_id, i in zip(some.column("doc_id").to_pylist(), ids):
                    writer.add(key_of(doc_id), np.append(i, np.array([end], dtype=i.dtype)))
        if writer:
            writer.close()
            writer.out.close()
            system.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, f"{folder}/{name}", writer.rows, writer.tokens), schema.types)], schema=schema)

    return written(placed.select("doc_id", "text").mapInArrow(write, "part int, path string, rows long, tokens long"))


def read_tables(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Scan the files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32. The starts of the files come
    from the manifest, whose rows are as many as the files."""
    ship(spark)
    before, files = 0, []
    for r in manifest.orderBy("part").collect():
        files.append((r["path"], before))
        before += r["tokens"]
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                rows = []
                for key, ids in Reader(path).scan():
                    rows.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return spark.createDataFrame(files, "path string, before long").repartition(len(files)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the rows with the ids in ``wanted``: every file asks its filter and index, block by block."""

    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file: dict[str, Reader] = {}
        for b in batches:
            for path, doc_id in zip(b.column("path").to_pylist(), b.column("doc_id").to_pylist()):
                if path not in open_file:
                    open_file = {path: Reader(path)}
                found = [v.astype(np.int32) for v in open_file[path].get(doc_id)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    files = [(r["path"], *_bounds(r["path"])) for r in manifest.orderBy("part").collect()]
    ranges = manifest.sparkSession.createDataFrame(files, "path string, first binary, last binary")
    keyed = wanted.select("doc_id").distinct().withColumn("key", F.when(F.col("doc_id").isNull(), F.unhex(F.lit("00" * 9))).otherwise(F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0")))))
    # as many rows as there are files
    asked = keyed.join(F.broadcast(ranges), (F.col("key") >= F.col("first")) & (F.col("key") <= F.col("last"))).select("path", "doc_id")
    return asked.repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(read, "doc_id long, ids array<int>")


def _bounds(path: str) -> tuple[bytes, bytes]:
    reader = Reader(path)
    return next(reader.block(0))[0], reader.last[-1]


def encode_to_tables(docs: DataFrame, vocabulary: str | None = None, tables: int | None = None) -> DataFrame:
    """Encode whole texts into tables in the shared folder; returns the manifest."""
    import public_tokenizers as P

    spark = docs.sparkSession
    return write_tables(columns_or_null(docs, doc_id="long", text="string"), vocabulary or P.path("byte_bpe_50k.json"), scratch_dir(spark), tables)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: what the files hold of every document."""
    return read_tables(spark, encode_to_tables(table(spark, sf_dir, "documents")))
