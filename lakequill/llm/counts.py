"""Token counts through a digest cache (operator 5).

The cache is a table (tokenizer, digest, n_tokens). Contents are known by the SHA-256
of the normalised text, tokenizers by the SHA-256 of their file. One narrow pass makes
the digests; only distinct contents that the cache lacks are encoded, each once, and
their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.llm.bpe import encoder_of
from lakequill.llm.shared import looked_up, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def _blank(text: Column, spec: bytes, path: str) -> Column:
    """The text as the tokenizer can't tell it apart from others: null is '', and runs of
    plain white space are one space if the tokenizer's own normaliser makes them so."""
    text = F.coalesce(text, F.lit(""))
    if path.endswith(".json"):
        steps = (json.loads(spec).get("normalizer") or {}).get("normalizers", [])
        if any(s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps):
            text = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")
    return text


def _word_ends(spec: dict) -> bool:
    """Whether the batch encoder knows this kind of vocabulary."""
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    return spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"]


def counter(spec: bytes, path: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts as the file's library does, without special tokens added."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
    text = spec.decode()
    if _word_ends(json.loads(text)):
        return lambda texts: encoder_of(text).encode(texts, want_ids=False)[1].tolist()
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(text)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; the cache at ``cache_path`` grows.

    Null and empty texts have no bytes and no tokens; null ids and repeated rows stay;
    other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as file:
        spec = file.read()
    version = hashlib.sha256(spec).hexdigest()
    shared = spark.sparkContext.broadcast(spec)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(_blank(text, spec, tokenizer_path), 256)).alias("digest"))
    keyed = written(rows.select("doc_id", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"), "digest"), "digests")

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
    # One row stands for each content: the one with the least id. Digests are combined before they are dealt out.
    contents = keyed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    misses = contents.drop("copies").join(cache.select("digest"), "digest", "left_anti")
    todo = rows.join(misses.withColumnRenamed("digest", "missing").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("missing"))).select("digest", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(shared.value, tokenizer_path)
        for batch in batches:
            found = counts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["digest", "n_tokens"])

    counted = todo.mapInArrow(count, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    # Runs that share a cache may have added a content twice; their counts are equal.
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return looked_up(keyed, contents.select("digest", "copies").join(known, "digest", "left"), ["digest"], "copies").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
