"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised on its own (chunks are rows, so the chunks of
one text run in parallel); two neighbours agree from the first pre-token boundary that both have in their overlap, as the
pattern looks only ahead, and a boundary counts only if the text that decided it lies inside the chunk. Between such
boundaries lie the pieces, which are encoded in parallel; a pair of chunks that never agrees (one run of letters over
the whole overlap) becomes one piece. A document's ids are its pieces' ids in order; decoding concatenates the raw
bytes of the ids.

Defined results: a null text is encoded as an empty one (no ids, no bytes); empty texts give no ids; repeated rows are
encoded each; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_or_null, ship, table, written

#: Characters in a chunk, those it shares with the next, and how far the pattern can look beyond a match.
CHUNK, OVERLAP, AHEAD = 32_768, 2_048, 3


class Codec:
    """Ranks and pattern of one vocabulary, loaded once per Python worker."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.raw: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.raw[i] = token

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path, pattern)
        return cls._loaded[path]

    def boundaries(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text)]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of one piece. The library is quicker than a memory of words would be."""
        return np.array(self.encoder.encode_ordinary(text), dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _mapped(df: DataFrame, source: str, schema: str, work) -> DataFrame:
    """Replace the column ``source`` by one that ``work`` makes of its values, batch by batch; keep the others."""
    ship(df.sparkSession)
    names = [f.name for f in df.schema if f.name != source]
    name, kind = schema.split(" ", 1)
    arrow = {"binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # small slices: the results of long texts don't pile up
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                made = pa.array(work(part.column(source).to_pylist()), arrow)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [made], names=[*names, name])

    types = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)
    return df.mapInArrow(run, f"{types}, {schema}" if names else schema)


def _cut(df: DataFrame, others: list[str], names: str, places) -> DataFrame:
    """A row for every stretch of every text: the columns ``others``, then ``names`` (two: a number and the stretch). ``places`` gives a
    row's stretches as (from, to). Each text is gone through once, however many stretches it has."""
    number, stretch = names.split(" ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.to_pylist()):
                text = row["text"]
                found = places(row, len(text))
                for k in range(0, len(found), 64):  # a few at a time: the stretches of a very long text don't pile up
                    part = found[k : k + 64]
                    same = [b.column(c).slice(i, 1).take(pa.array([0] * len(part))) for c in others]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(k, k + len(part)), pa.int32()), pa.array([text[x:y] for x, y in part], pa.string())], names=[*others, number, stretch])

    ship(df.sparkSession)
    return df.mapInArrow(run, "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in others) + f"{number} int, {stretch} string")


def cut_chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, c, text): a row for every chunk of every text. Chunks are dealt out before anything is done with them: those of one text
    run in parallel, and a task keeps one Python worker, not one that cuts and one that holds the vocabulary."""
    step = chunk - overlap
    return _cut(docs.select("row", "text"), ["row"], "c text", lambda row, n: [(a, a + chunk) for a in range(0, max(n - overlap, 1), step)]).repartition("row", "c")


def agreed_boundaries(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, at): for neighbouring chunks the first boundary that both have in their overlap; none where they don't agree."""
    step = chunk - overlap

    def ends(texts: list[str]) -> list[list[int]]:
        codec, out = Codec.load(path, pattern), []
        for t in texts:
            b = codec.boundaries(t)
            safe = [x for x in b if x + AHEAD <= len(t)] if len(t) == chunk else b
            out.append([x for x in [0, *safe] if x <= overlap or x >= step])
        return out

    found = _mapped(chunks.select("row", "c", "text"), "text", "ends array<int>", ends)
    begins = found.where("c > 0").select("row", (F.col("c") - 1).alias("c"), F.transform(F.filter("ends", lambda x: (x > 0) & (x <= overlap)), lambda x: x + step).alias("heads"))
    both = found.join(begins, ["row", "c"]).select("row", "c", F.array_min(F.array_intersect("ends", "heads")).alias("at"))
    return both.where("at is not null").select("row", (F.col("at") + F.col("c") * step).alias("at"))


def encode_long(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, ids) of the rows of (row, text) with more than a chunk, by chunks, stitching and pieces."""
    cuts = agreed_boundaries(cut_chunks(docs.where(F.length("text") > chunk), chunk, overlap), path, pattern, chunk, overlap)
    cuts = cuts.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    whole = docs.join(cuts, "row", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    pieces = _cut(whole, ["row"], "k piece", lambda row, n: list(zip([0, *row["cuts"]], [*row["cuts"], n]))).repartition("row", "k")
    coded = _mapped(pieces, "piece", "ids binary", lambda texts: list(map(Codec.load(path, pattern).encode, texts)))
    joined = coded.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p"))
    # a text's pieces are put together as hex, as no built-in function concatenates an array of binaries
    return joined.select("row", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))


def _short_and_long(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text) of the texts of one chunk, which need no stitching, and (row, doc_id, ids) of the others."""
    if overlap >= chunk // 2:
        raise ValueError("chunks must be over twice as long as their overlap")
    docs = docs.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = written(docs.where(F.length("text") > chunk))
    stitched = long.select("row", "doc_id").join(encode_long(long.select("row", "text"), path, pattern, chunk, overlap), "row")
    return docs.where(F.length("text") <= chunk), stitched.select("row", "doc_id", "ids")


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, ids) of rows of (row, doc_id, text); ids are little-endian unsigned 32-bit integers."""
    short, long = _short_and_long(docs, path, pattern, chunk, overlap)
    return _mapped(short, "text", "ids binary", lambda texts: list(map(Codec.load(path, pattern).encode, texts))).unionByName(long)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, ids, decoded) of rows of (row, doc_id, text). A text of one chunk is encoded and its ids are decoded in one
    visit to Python, so a task keeps one worker busy and no ids go there twice."""
    short, long = _short_and_long(docs, path, pattern, chunk, overlap)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [codec.encode(t) for t in part.column("text").to_pylist()]
                made = [pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *made], names=["row", "doc_id", "ids", "decoded"])

    return short.mapInArrow(both, "row long, doc_id long, ids binary, decoded binary").unionByName(decode(long, path, pattern))


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded``, the raw bytes, to rows with ``ids``."""
    both = coded.withColumn("_ids", F.col("ids"))
    return _mapped(both, "_ids", "decoded binary", lambda ids: list(map(Codec.load(path, pattern).decode, ids)))


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text). The ids hold for one written table of long texts: short rows never use theirs."""
    return columns_or_null(docs, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())


def code_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode whole texts, with digests of both."""
    import public_tokenizers as P

    path = path or P.path("byte_bpe_multi_50k.tiktoken")
    out = encode_and_decode(numbered(docs), path, P.PATTERN)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6(spark, sf_dir: str) -> DataFrame:
    """The query: digests of every document's ids and of what they decode to."""
    return code_digests(table(spark, sf_dir, "documents"))
