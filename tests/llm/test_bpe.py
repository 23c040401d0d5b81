"""The rank array against the tokenizers library, and the operators built on it."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakequill.llm import bpe, counts, queries, shared, tokenfile

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXT = bpe.read_tokenizer(PATH)
LIBRARY = Tokenizer.from_str(TEXT)
CODEC = bpe.Codec(TEXT)
ENCODER = bpe.BatchEncoder(CODEC)
ODD = [
    "", " ", "\t\n", "It's we've they'll i'd i'm're 'tis 's''s '''d", "x<|endoftext|>y <|startoftext|>Z <|endoftext", "a" * 500 + " b", "abc" * 3000,
    "ΣΟΦΟΣ σας İstanbul ſtraße K", "é é ﬁ ½² Ⅷ ٣ 中文字 🎉👩‍👩‍👧", "a\x1cb\x1fc\x85d e　f\xa0g", "12 345\n6.7!?…—‘’“”", "\x00\x7f", "Ж ж 漢字かなカナ", "naïve ÇA ŒUVRE ß ẞ",
]


def library(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


def batch(texts: list[str]) -> list[list[int]]:
    ids, many = ENCODER.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] if texts else []


def test_odd_texts():
    assert batch(ODD) == [library(t) for t in ODD]
    assert [np.frombuffer(CODEC.encode(t), "<u4").tolist() for t in ODD] == [library(t) for t in ODD]
    assert [CODEC.decode(library(t)) for t in ODD] == [LIBRARY.decode(library(t), skip_special_tokens=False) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="aAbstmdrevlLé'’ \t\n<|>!.9½中"), st.text(alphabet="thinger")), max_size=8))
def test_any_text(texts):
    assert batch(texts) == [library(t) for t in texts]


def test_long_words_merge_alike():
    symbols = "".join(random.Random(3).choice("thingersonaed") for _ in range(400))
    own = CODEC._bpe
    ids = [own.vocab[c] for c in symbols[:-1]] + [own.vocab[symbols[-1] + own.suffix]]
    assert own._heap(list(ids)) == own._scan(list(ids)) == library(symbols)


def test_groups_and_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_BYTES", 50)
    texts = ["one two three " * 20, None, "four", "", "five six " * 9 + "é"]
    ids, many = ENCODER.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == [library(t or "") for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "x") for k, t in enumerate(ODD)] + [(100, None, None, None), (None, "null id", "en", "x"), (7, ODD[6], "en", "x"), (7, ODD[6], "en", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start string").repartition(3)


def test_encode_decode_documents(docs):
    encoded = bpe.encode_documents(docs, PATH)
    wanted = sorted((str(r.doc_id), library(r.text or "")) for r in docs.collect())
    assert sorted((str(r.id), r.ids) for r in encoded.collect()) == wanted
    decoded = sorted((str(r.id), r.text) for r in bpe.decode_documents(encoded, PATH).collect())
    assert decoded == sorted((k, LIBRARY.decode(v, skip_special_tokens=False)) for k, v in wanted)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_round_trip_digests(docs):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = sorted(map(tuple, bpe.round_trip_digests(docs, PATH).collect()), key=repr)
    ids = [(r.doc_id, library(r.text or "")) for r in docs.collect()]
    assert found == sorted(((k, len(v), sha(" ".join(map(str, v))), sha(LIBRARY.decode(v, skip_special_tokens=False))) for k, v in ids), key=repr)


def test_words_with_one_hash(monkeypatch):
    """If all words of a batch had one hash, each would be encoded for itself."""
    encoder = bpe.BatchEncoder(CODEC)
    monkeypatch.setattr(encoder, "_salt", np.zeros_like(encoder._salt))
    texts = ["one two six ten one", "the cat", *ODD]
    ids, many = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == [library(t) for t in texts]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_registered_queries_over_their_whole_table(spark):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    ids = {i: library(t) for i, t in rows}
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, SF).collect()}
    assert found == {i: (len(x), sha(" ".join(map(str, x))), sha(LIBRARY.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    start, wanted = 0, {}
    for i, _ in rows:
        x = np.array([*ids[i], 1], "<u4")
        wanted[i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_output(spark, SF).collect()} == wanted
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5_token_counts(spark, SF).collect()}
    assert found == {i: (len(t.encode()), len(ids[i]), len(ids[i]) > 2048) for i, t in rows}


def read_back(spark, path, **kw):
    return sorted(((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfile.read_token_files(spark, path, **kw).collect()))


def test_token_files(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 60)
    path = shared.fresh_path(spark, "files")
    tokenfile.write_token_files(docs, path, PATH, end_id=1)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, wanted = 0, []
    for r in rows:
        ids = [*library(r.text or ""), 1]
        wanted.append((start, r.doc_id, len(ids), ids))
        start += len(ids)
    assert read_back(spark, path) == sorted(wanted, key=lambda r: r[0])
    assert read_back(spark, path, doc_ids=[7, 3, 555]) == [w for w in sorted(wanted, key=lambda r: r[0]) if w[1] in (3, 7)]
    assert len(read_back(spark, path, doc_ids=list(range(-3000, 3000)))) == sum(w[1] is not None for w in wanted)
    assert read_back(spark, path, doc_ids=[]) == []
    assert zlib.crc32(np.array(wanted[0][3], "<u4").tobytes()) == tokenfile.read_token_files(spark, path).filter("start = 0").selectExpr("crc32(ids) AS c").first().c


def test_token_files_of_an_empty_table(spark, docs):
    path = shared.fresh_path(spark, "files")
    tokenfile.write_token_files(docs.limit(0), path, PATH, end_id=1)
    assert read_back(spark, path) == []


def test_dictionary_is_used_and_checked(spark):
    docs = spark.createDataFrame([(k, f"the cat number {k} and the dog of house {k % 7} went over the river to see {k * 31}") for k in range(300)], "doc_id long, text string")
    path = shared.fresh_path(spark, "files")
    tokenfile.write_token_files(docs, path, PATH, end_id=1)
    about = spark.read.parquet(f"{path}/dictionary").first()
    assert len(about.dictionary) > 100 and about.width == 2
    image = bytes(spark.read.parquet(f"{path}/shards").first().image)
    with pytest.raises(ValueError):
        tokenfile._opened(image, b"0" * 16)
    assert len(read_back(spark, path)) == 300


def test_counts_and_cache(spark, docs):
    cache = shared.fresh_path(spark, "cache")
    wanted = sorted(((r.doc_id, len((r.text or "").encode()), len(library(r.text or "")), len(library(r.text or "")) > 100) for r in docs.collect()), key=repr)
    for _ in range(2):
        found = sorted(map(tuple, counts.count_tokens(docs, PATH, cache, limit=100).collect()), key=repr)
        assert found == wanted
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count()  # the second call adds none
    assert counts.count_tokens(docs.limit(0), PATH, cache).count() == 0


def test_counts_by_other_libraries(spark):
    import sentencepiece

    texts = ["Hello  world", "é中🎉", "", None, "a\tb\n\nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=model)
    found = {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, model, shared.fresh_path(spark, "c")).collect()}
    assert found == {k: len(plain.encode(t or "")) for k, t in enumerate(texts)}
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    found = {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, path, shared.fresh_path(spark, "c")).collect()}
    assert found == {k: len(other.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_memory_of_a_large_batch(spark, monkeypatch):
    """A batch as Spark hands it over, 10,000 rows, is encoded slice by slice; what is held at once doesn't grow with it."""
    draw = random.Random(5)
    words = ["".join(draw.choices("thingersonaed", k=draw.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(draw.choices(words, k=400)) for _ in range(10_000)]
    texts[3], texts[4], texts[5], texts[77] = None, "", " ".join(texts[6:1500]), "é <|endoftext|> Σ"
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run, rows = bpe.encode_documents(docs, PATH), pa.record_batch([pa.array(range(10_000)), pa.array(texts)], ["id", "text"])
    found: dict[int, list[int]] = {}
    peak, many = 0, []
    list(run(iter([rows.slice(0, 3)])))  # the encoder itself is there before
    tracemalloc.start()
    for batch in run(iter([rows])):
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        many += batch.column(0).to_pylist()
        found |= {i: batch.column(1)[k].as_py() for k, i in enumerate(batch.column(0).to_pylist()) if i < 6 or i % 77 == 0}
    tracemalloc.stop()
    assert many == list(range(10_000))
    assert found == {i: library(texts[i] or "") for i in found} and len(found) > 100
    assert peak < 200_000_000  # 290 MB when a batch was encoded at once
