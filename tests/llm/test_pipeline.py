"""The stages against brute force of what each decides."""

from __future__ import annotations

import random
import re

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

from lakequill.llm import quality, shared
from lakequill.llm.queries import LANGUAGE_SHARES

from .test_mixing_licenses_hamming import brute_rates
from .test_ngrams import brute as brute_components
from .test_quality import brute as brute_rules
from .test_secrets import base

SF = "/root/testdata/sf0.01"


def redacted(text):
    out, at = "", 0
    for a, _, b in base(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for n, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        count = docs.count()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after = docs.collect()
        if n < 4:
            assert docs.columns == columns
        if name == "quality rules":
            rules = brute_rules([(r.doc_id, r.text, r.lang) for r in before.values()])
            assert sorted(r.doc_id for r in after) == sorted(k for k, v in rules.items() if v[-1])
        elif name == "near duplicates":
            groups = brute_components([(r.doc_id, r.text) for r in before.values()])
            assert sorted(r.doc_id for r in after) == sorted(i for i, _, c, _ in groups if i == c)
        elif name == "secret scan":
            assert {r.doc_id: r.text for r in after} == {k: redacted(r.text) for k, r in before.items()}
            assert not any(re.search("[0-9a-f]{16,}", r.text) for r in after)
        elif name == "mixing":
            _, rate, _ = brute_rates(list(before), [r.text for r in before.values()], [r.lang for r in before.values()], LANGUAGE_SHARES)
            assert abs(len(after) - rate.sum()) < 0.05 * len(before)
            assert {r.doc_id for r in after} == set(before)
        else:
            assert len(after) == count
            assert all(r.ids == library.encode(before[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in after)


def test_edges(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (None, text + " more words here", "fr", "s", 1), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for n, (_, stage) in enumerate(P.STAGES):
            path = str(tmp_path / f"{len(rows)}-{n}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if n == 1 and rows:
                assert docs.filter("doc_id = 1").count() == 1 and docs.filter("doc_id = 2").count() == 0
        assert (docs.count() > 0) == bool(rows)


WORDS = "the of and to in that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much go good new write our used me man too any day same right look think also around another came come work three word must because does part even place well such here take why things help put years different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always looked show large often together asked house world going want".split()


def prose(seed, many=120):
    rnd = random.Random(seed)
    return " ".join(rnd.choices(WORDS, k=many))


def test_clashing_columns_null_ids_and_long_texts(spark, tmp_path):
    """Rows are judged by themselves: null and shared ids, columns named as the stages' own, and one very long text."""
    one, two, three = prose(1), prose(2), prose(3)
    long = prose(4, 60_000)
    rows = [(5, one), (None, one), (5, one), (None, two), (None, two), (None, "too short"), (5, "#*$%"), (7, three), (8, three + " more"), (9, long), (7, "another text " + prose(5))]
    names = ["gone", "kept", "hi", "lo", "n", "component", "rate", "t", "p", "base", "found", "many", "token"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *range(len(names))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names)).repartition(3)
    columns = docs.columns
    for n, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        out = spark.read.parquet(str(tmp_path / str(n)))
        found = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) if n < 4 else []
        if n < 4:
            assert out.columns == columns
        if name == "quality rules":  # against a mean of so few texts, the long one may go
            assert [x for x in found if x[1] != long] == sorted([r for r in rows if r[1] not in ("too short", "#*$%", long)], key=repr)
        elif name == "near duplicates":
            assert found == sorted([(5, one), (None, two), (None, "too short"), (5, "#*$%"), (7, three), (9, long), (7, rows[-1][1])], key=repr)
        elif name == "secret scan":
            assert found == sorted(rows, key=repr)
        else:
            assert out.count() >= len(rows)


def test_a_result_outlives_other_operators(spark):
    """Tables of an operator's result stay until their own scope is dropped."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    waiting = quality.quality_rules(docs)
    P.run(spark, "/root/testdata/sf0.001").count()
    paths = []
    with shared.scope(paths):
        own = quality.quality_rules(docs)
    assert own.count() == waiting.count() == docs.count() and paths
    shared.drop_paths(spark, paths)
    assert not paths and waiting.count() == docs.count()


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is P.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert {"doc_id", "n_tokens", "ids"} == set(P.run(spark, "/root/testdata/sf0.001").columns)
