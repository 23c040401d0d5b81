"""Mixing, licences and top-k search against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
import xxhash

from lakequill.llm import hamming, licenses, mixing
from lakequill.llm.queries import LANGUAGE_SHARES, op6_licenses, op7_top_k, op9_mixing
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def bucket(word):
    return (xxhash.xxh64_intdigest(word.encode(), seed=42) - ((xxhash.xxh64_intdigest(word.encode(), seed=42) >> 63) << 64)) % mixing.BUCKETS


def brute_rates(ids, texts, domains, targets, total=None):
    """The method in plain Python: naive Bayes memberships from all labelled rows, projected gradient rates."""
    names = sorted(targets)
    share = np.array([targets[n] for n in names]) / sum(targets.values())
    words = [[w for w in re.split("[\x20\x09-\x0D]+", (t or "").lower()) if w] for t in texts]
    buckets = [[bucket(w) for w in x] for x in words]
    tokens = np.array([float(len(x)) for x in words])
    logs = np.zeros((len(texts), len(names)))
    used = [(i, d) for i, d in zip(ids, domains)]
    counts = np.array([1.0 + sum(d == n for i, d in used if i is not None) for n in names])
    for k, n in enumerate(names):
        hits = np.full(mixing.BUCKETS, mixing.SMOOTHING)
        for x, (i, d) in zip(buckets, used):
            if d == n and i is not None:
                np.add.at(hits, x, 1)
        weights = np.round(mixing.PART * np.log(hits / hits.sum()))
        sums = np.array([weights[x].sum() if x else 0.0 for x in buckets])
        logs[:, k] = math.log(counts[k] / counts.sum()) + np.minimum(1.0, mixing.EVIDENCE / np.maximum(tokens, 1.0)) / mixing.PART * sums
    p = np.exp(logs - logs.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    own = (tokens[:, None] * p).sum(0)
    wanted = share * (own.sum() * total if total else mixing.HEADROOM * max(own[share > 0] / share[share > 0]))
    r = np.ones(len(texts))
    for _ in range(mixing.STEPS):
        totals = ((r * tokens)[:, None] * p).sum(0)
        if (np.abs(totals - wanted) / np.where(wanted > 0, wanted, wanted.sum())).max() <= mixing.CLOSE:
            break
        r = np.maximum(0, r - p @ ((totals - wanted) / own))
    return p, r, ((r * tokens)[:, None] * p).sum(0) - wanted


def by_language(docs):
    return docs.select("doc_id", F.col("lang").alias("domain"))


@pytest.mark.parametrize(("targets", "total"), [(LANGUAGE_SHARES, 1.0), ({"en": 0.1, "fr": 0.4, "de": 0.5, "es": 0.0}, 0.6), ({"de": 0.9, "en": 0.05, "es": 0.02, "fr": 0.03}, None)])
def test_mixing_against_plain_python(spark, targets, total):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    p, rate, miss = brute_rates([r.doc_id for r in rows], [r.text for r in rows], [r.lang for r in rows], targets, total)
    out = op9_mixing(spark, SF) if total == 1.0 else mixing.rates(docs, by_language(docs), targets, total)
    found = {r.doc_id: r for r in out.collect()}
    assert np.allclose([found[r.doc_id].rate for r in rows], rate, atol=5e-4)
    assert np.allclose([found[r.doc_id].membership for r in rows], p.max(1), atol=1e-6)
    tokens = sum(r.n_tokens * r.rate for r in found.values())
    assert np.abs(miss).max() / tokens < 5e-3
    assert all(r.copies in (math.floor(r.rate), math.ceil(r.rate)) for r in found.values())
    assert np.mean([found[r.doc_id].domain == r.lang for r in rows]) > 0.97
    assert min(rate) == 0 if total == 0.6 else min(rate) > 0  # the projection acts
    assert max(rate) > 1 and (min(rate) > 0.9) == (total is None)


def test_held_out_languages(spark, monkeypatch):
    """Fitted on a sample of a few hundred rows, the classifier is right on the others."""
    monkeypatch.setattr(mixing, "LABELLED", 300)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chosen = {r.doc_id for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 300 / docs.count())).collect()}
    assert 200 < len(chosen) < 400
    found = {r.doc_id: r.domain for r in op9_mixing(spark, SF).collect()}
    assert np.mean([found[r.doc_id] == r.lang for r in docs.collect() if r.doc_id not in chosen]) > 0.96


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"rate": F.lit(1), "t": F.col("doc_id") % 7 + 1})
    for total, tokens in ((None, None), (0.5, "t")):
        copies = {r.doc_id: r.copies for r in mixing.rates(docs, by_language(docs), LANGUAGE_SHARES, total, tokens_col=tokens).collect()}
        out = mixing.mixed(docs, by_language(docs), LANGUAGE_SHARES, total, tokens_col=tokens)
        assert out.columns == docs.columns
        assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
        assert (min(copies.values()) >= 1) == (total is None)  # without a total no document goes


def test_mixing_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (None, "the of and the of", None), (3, "der und die", "de"), (3, "der und die", "de"), (4, "x " * 100_000, "zz")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, rate double")
    known = by_language(docs)
    out = mixing.rates(docs, known, {"en": 0.5, "de": 0.5}).collect()
    assert len(out) == 6 and all(r.rate >= 0 and r.n_tokens >= 0 for r in out)
    assert mixing.rates(docs.limit(0), known, {"en": 1.0}).count() == 0
    assert mixing.mixed(docs.limit(0), known, {"en": 1.0}).count() == 0
    for targets, total in (({}, None), ({"en": -1.0, "de": 2.0}, None), ({"en": 0.0}, None), ({"en": 1.0}, 0.0)):
        with pytest.raises(ValueError):
            mixing.rates(docs, known, targets, total)


def test_missed_targets_are_reported(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with pytest.warns(UserWarning, match="miss their targets"):
        mixture, _ = mixing.fit(docs, by_language(docs), {"en": 0.02, "de": 0.9, "fr": 0.08, "es": 0.0}, 1.0)
    assert mixture.residual > mixing.CLOSE and len(mixture.steps) == 1


def test_native_plans(spark):
    for query in (op9_mixing, op6_licenses):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan


def brute_license(text):
    import re

    idf, unknown, rows = licenses.template_vectors()
    templates = {}
    for name, term, w in rows:
        templates.setdefault(name, {})[term] = w
    best, words = None, 0
    for line in re.split(r"\n|(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ])", text or ""):
        if not re.search(licenses.CUE, line):
            continue
        terms = licenses.terms_of(line)
        weights = {t: terms.count(t) * idf.get(t, unknown) for t in set(terms)}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        scores = [(round(sum(w * templates[n].get(t, 0) for t, w in weights.items()) / norm, 6), n) for n in templates] if norm else []
        hit = max(scores, default=(0, ""))
        if hit[0] >= licenses.LEAST_COSINE:
            best = max(best or hit, hit)
            words += len([w for w in re.split(r"[\x20\x09-\x0D]+", line) if w])
    return best, words / max(1, len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]))


def test_license_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in op6_licenses(spark, SF).collect()}
    own = {r.doc_id: brute_license(r.text) for r in rows}
    files = {}
    for r in rows:
        best, cover = own[r.doc_id]
        if best and cover >= licenses.LEAST_SHARE:
            name = best[1].split("#")[0]
            files[r.source, r.lang] = max(files.get((r.source, r.lang), (0, "")), (best[0], name))
    for r in rows:
        best, _ = own[r.doc_id]
        above = files.get((r.source, r.lang), (0, None))[1]
        wanted = best[1].split("#")[0] if best else above
        assert (found[r.doc_id].license, found[r.doc_id].inherited) == (wanted, best is None and above is not None)
    assert sum(r.license is not None for r in found.values()) > 10


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    mit = licenses.TEMPLATES["MIT"][3]
    rows = [
        (1, "a/LICENSE", "Apache License Version 2.0, January 2004\n" + "word " * 400), (2, "a/b/LICENSE.txt", mit), (3, "a/b/c/d.py", "code"), (4, "a/x/y.py", "code"), (5, "z.py", None),
        (6, "a/b/own.py", "# Licensed under CC BY-NC 4.0.\n" + "code " * 90), (7, None, ""), (3, "a/b/c/d.py", "code"), (None, "a/b/n.py", "licensed to nobody at all by any of us here"), (8, "ab/q.py", "x"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    found = sorted(((r.doc_id, r.license, r.inherited) for r in licenses.scan_licenses(docs, F.col("path")).collect()), key=repr)
    assert found == sorted([(1, "Apache-2.0", False), (2, "MIT", False), (3, "MIT", True), (3, "MIT", True), (4, "Apache-2.0", True), (5, None, False), (6, "CC-BY-NC-4.0", False), (7, None, False), (None, "MIT", True), (8, None, False)], key=repr)
    assert licenses.scan_licenses(docs.limit(0), F.col("path")).count() == 0


GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_wrapped_notices_and_whole_texts(spark):
    code = "\n\ndef area(r):\n    return r * r * 3\n" * 20
    commented = lambda text, mark: "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
    rows = [(k, f"whole{k}/a", licenses.full_text(x), x) for k, x in enumerate(licenses.FULL_TEXTS)]
    rows += [(100 + k, f"whole{k}/b", "code", x) for k, x in enumerate(licenses.FULL_TEXTS)]  # they inherit
    headers = {"GPL-3.0": GPL_HEADER, "MIT": licenses.full_text("MIT"), "BSD-3-Clause": "Copyright 2020 Ann Other. All rights reserved.\n\n" + licenses.full_text("BSD-3-Clause").split("reserved.")[1].strip()}
    rows += [(200 + 10 * j + k, "src/x", commented(h, mark) + code, x) for j, mark in enumerate(("#", "//", " *")) for k, (x, h) in enumerate(headers.items())]
    rows += [(300, "p/x", "# Copyright 2020 Ann Other. All rights reserved." + code, "proprietary"), (301, "q/x", "the licence of the story was, and the rest of it is in the hands\nof the reader, under the terms that all of us know " * 90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string, wanted string")
    found = {r.doc_id: (r.license, r.inherited) for r in licenses.scan_licenses(docs, F.col("path")).collect()}
    assert found == {r[0]: (r[3], 100 <= r[0] < 200) for r in rows}


def nearest(ids, vectors, queries, k):
    bits = np.array([[x is not None and x > 0 for x in v] for v in vectors])
    out = []
    for q, v in queries:
        d = (bits != np.array([x is not None and x > 0 for x in v])).sum(1)
        order = np.lexsort((ids, d))[:k]
        out += [(q, n + 1, int(ids[j]), int(d[j])) for n, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize(("cost", "hot"), [(0, 100_000), (0, 7), (32, 100_000)])
def test_top_k_query(spark, monkeypatch, cost, hot):
    """By probes alone, with values dealt out in parts, and with the scan that the size of the table calls for."""
    monkeypatch.setattr(hamming, "PROBE_COST", cost)
    monkeypatch.setattr(hamming, "HOT_ROWS", hot)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 7)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = sorted(map(tuple, op7_top_k(spark, SF).collect()))
    assert found == nearest(np.array([r[0] for r in rows]), [r[1] for r in rows], [r for r in rows if r[0] % 50 == 0], 10)


def test_top_k_with_copies_ties_and_nulls(spark):
    rnd = random.Random(4)
    common = [rnd.uniform(-1, 1) for _ in range(80)]
    rows = [(k, common) for k in range(40)] + [(100 + k, [rnd.uniform(-1, 1) if rnd.random() < 0.1 else x for x in common]) for k in range(60)]
    extra = [(500, None), (501, [None] * 80), (7, common)]
    vectors = spark.createDataFrame([(*r, 0) for r in rows + extra], "vec_id long, embedding array<double>, rank int").repartition(3)
    usable = [r for r in rows + extra if r[1] is not None]
    asked = [rows[0], rows[50], rows[77], (501, extra[1][1])]
    queries = spark.createDataFrame(asked, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, hamming.top_k(vectors, queries, k=45, dimensions=80).collect()))
    assert found == nearest(np.array([r[0] for r in usable]), [r[1] for r in usable], asked, 45)
    assert hamming.top_k(vectors.limit(0), queries, k=3, dimensions=80).count() == 0
    few = hamming.top_k(vectors.filter("vec_id in (1, 2)"), queries.filter("vec_id = 0"), k=5, dimensions=80).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
