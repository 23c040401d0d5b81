"""Token ids as binary files (operator 4).

A data set is a folder with two tables. ``dictionary`` has one row: the zstandard
dictionary, its hash, the id width and the digest of the tokenizer. ``shards`` has one
row for each shard, in ascending order of the document id; its ``image`` is a file:

    magic, version, id width in bytes, number of documents, hash of the dictionary,
    index: for each document its id, whether the id is null, offset, number of ids,
    then one zstandard frame for each document: its ids, little-endian.

Every document is compressed by itself with the shared dictionary, so one document is
read by its index entry and frame alone. The tables are Parquet because only Spark's
writers reach every store; the images are complete files of their own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.llm.bpe import encoder_of, read_tokenizer

MAGIC, VERSION = b"TIDZ", 1
HEAD = "<4sHHQ16s"
ENTRY = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("n_tokens", "<u8")])
#: A shard is closed at so many bytes; a document is never split.
SHARD_BYTES = 4_000_000
#: The dictionary is trained on at most so many documents of at most so many characters
#: (those with the smallest hash of the id). It changes sizes only, never what is read back.
DICTIONARY_DOCS, DICTIONARY_CHARS, DICTIONARY_BYTES = 400, 16_384, 65_536
LEVEL = 3
SHARD_SCHEMA = "part int, shard int, first_id long, last_id long, n_docs long, n_tokens long, part_start long, image binary"


def train_dictionary(docs: DataFrame, spec: str, end_id: int, width: int, id_col: str, text_col: str) -> bytes:
    """A shared dictionary; b'' if there are too few documents to train one."""
    key = F.col(id_col).cast("long")
    sample = docs.select(key.alias("k"), F.col(text_col).cast("string").alias("t")).filter(F.length("t").between(1, DICTIONARY_CHARS))
    # Ids first: each task sends its least hashes only, not the texts behind them.
    keys = [r.k for r in sample.select("k").orderBy(F.xxhash64("k"), "k").limit(DICTIONARY_DOCS).collect()]
    rows = sample.filter(F.col("k").isin(keys)).orderBy(F.xxhash64("k"), "k", "t").limit(DICTIONARY_DOCS).collect() if keys else []
    ids, counts = encoder_of(spec).encode([r.t for r in rows])
    cuts = np.split(ids, np.cumsum(counts)[:-1]) if rows else []
    samples = [np.append(x, end_id).astype(f"<u{width}").tobytes() for x in cuts]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row, append ``end_id``, and write the data set to ``path``.

    Rows are in ascending order of the id, null ids first, repeated ids in order of their
    texts. A null or empty text has the end id only. An empty table gives a data set
    without shards. Other columns are left out.
    """
    spark, spec = docs.sparkSession, read_tokenizer(tokenizer_path)
    width = 2 if max(encoder_of(spec).codec.size, end_id + 1) <= 1 << 16 else 4
    trained = train_dictionary(docs, spec, end_id, width, id_col, text_col)
    mark = hashlib.blake2b(trained, digest_size=16).digest()
    about = [(mark, trained, width, end_id, hashlib.sha256(spec.encode()).hexdigest())]
    spark.createDataFrame(about, "hash binary, dictionary binary, width int, end_id int, tokenizer string").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast((spec, trained))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, data = shared.value
        encoder = encoder_of(text)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data), write_content_size=True)
        part, shard, done = TaskContext.get().partitionId(), 0, 0
        entries: list[tuple[int, int, int, int]] = []
        frames: list[bytes] = []
        held = tokens = 0

        def close() -> pa.RecordBatch:
            index = np.array(entries, ENTRY)
            image = b"".join([struct.pack(HEAD, MAGIC, VERSION, width, len(entries), mark), index.tobytes(), *frames])
            known = index["doc_id"][index["is_null"] == 0]
            row = [part, shard, int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None, len(entries), tokens, done, image]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        for batch in batches:
            ids, counts = encoder.encode(batch.column(1).to_pylist())
            at = 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                frame = packer.compress(np.append(ids[at : at + n], np.uint32(end_id)).astype(f"<u{width}").tobytes())
                at += n
                entries.append((doc_id or 0, doc_id is None, held, n + 1))
                frames.append(frame)
                held += len(frame)
                tokens += n + 1
                if held >= SHARD_BYTES:
                    yield close()
                    shard, done = shard + 1, done + tokens
                    entries, frames, held, tokens = [], [], 0, 0
        if entries:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(write, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/shards")


def _opened(image: bytes, mark: bytes) -> tuple[int, np.ndarray, int]:
    magic, version, width, n, found = struct.unpack_from(HEAD, image)
    if magic != MAGIC or version != VERSION or found != mark:
        raise ValueError("not a token file of this data set")
    index = np.frombuffer(image, ENTRY, n, struct.calcsize(HEAD))
    return width, index, struct.calcsize(HEAD) + n * ENTRY.itemsize


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary: little-endian unsigned 32-bit) of a data set.

    ``start`` counts the ids of all documents before. With ``doc_ids``, shards that hold
    none of them are skipped, and only the frames of these documents are read.
    """
    about = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast((bytes(about["hash"]), bytes(about["dictionary"]), sorted(set(doc_ids)) if doc_ids is not None else None))
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    # One row for each range partition of the writer: their number is a setting, not the data's size.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    if doc_ids is not None:  # one constant, however many are asked for
        asked = F.split(F.lit(",".join(map(str, sorted(set(doc_ids))))), ",").cast("array<long>") if doc_ids else F.array().cast("array<long>")
        shards = shards.filter(F.exists(asked, lambda k: k.between(F.col("first_id"), F.col("last_id"))))
    placed = shards.join(parts, "part").select((F.col("before") + F.col("part_start")).alias("start"), "image")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, data, wanted = shared.value
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for start, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                width, index, base = _opened(image, mark)
                starts = start + np.append(0, np.cumsum(index["n_tokens"])[:-1]).astype(np.int64)
                ends = np.append(index["offset"][1:], len(image) - base).astype(np.int64) + base
                picked = np.arange(len(index)) if wanted is None else np.nonzero(np.isin(index["doc_id"], wanted) & (index["is_null"] == 0))[0]
                for group in np.array_split(picked, max(1, int(index["n_tokens"][picked].sum() // 2_000_000))):
                    ids = [np.frombuffer(reader.decompress(image[base + int(index["offset"][k]) : ends[k]]), f"<u{width}").astype("<u4").tobytes() for k in group.tolist()]
                    found = pa.array(index["doc_id"][group], pa.int64(), mask=index["is_null"][group] == 1)
                    yield pa.RecordBatch.from_arrays([found, pa.array(starts[group]), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
