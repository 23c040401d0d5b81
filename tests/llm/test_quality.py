"""Quality rules and the classifier against brute force and held-out labels."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakequill.llm import discriminant, quality
from lakequill.llm.queries import op8_quality_classifier, op10_quality_rules

SF = "/root/testdata/sf0.01"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(marked)


def jensen_shannon(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(total, 0))


def histograms(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    kinds = Counter()
    for c in (text or ""):
        if c in " \t\n\v\f\r":
            continue
        kinds["beyond" if ord(c) > 127 else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "stop" if c in ".,;:?'\"()-" else "mark" if c == "!" else "symbol" if 32 < ord(c) < 127 else "control"] += 1
    common = Counter(quality.SLOT[w] for w in words if w in quality.SLOT)
    n, m = sum(kinds.values()), len(words)
    chars = [kinds[k] / max(n, 1) for k in quality.CLASSES]
    return chars, [common[k] / max(m, 1) for k in range(len(quality.VOCABULARY))] + [(m - sum(common.values())) / max(m, 1)], n, m


def brute(rows):
    seen = [(i, lang, *histograms(t), *base(t)) for i, t, lang in rows]

    def distances(r, refs):
        if r[1] is not None and r[1] not in refs:
            return 0.0, 0.0
        chosen = refs[r[1]] if r[1] in refs else min((refs[k] for k in sorted(refs)), key=lambda f: jensen_shannon(r[2], f[0]) + jensen_shannon(r[3], f[1]))
        return jensen_shannon(r[2], chosen[0]), jensen_shannon(r[3], chosen[1])

    def within(r, refs):
        c, w = distances(r, refs)
        return (r[4] < quality.CHARS_LEAST or c <= quality.CHARS_BASE + quality.CHARS_SPREAD / math.sqrt(r[4])) and (r[5] < quality.WORDS_LEAST or w <= quality.WORDS_BASE + quality.WORDS_SPREAD / math.sqrt(r[5]))

    refs = None
    long = Counter(r[1] for r in seen if r[4] >= quality.CHARS_LEAST and r[5] >= quality.WORDS_LEAST)
    for _ in range(2):
        used = [r for r in seen if r[4] >= quality.CHARS_LEAST and r[5] >= quality.WORDS_LEAST and r[1] is not None and long[r[1]] >= quality.LEAST_ROWS and (refs is None or within(r, refs))]
        refs = {k: tuple(np.mean([r[j] for r in used if r[1] == k], axis=0) for j in (2, 3)) for k in {r[1] for r in used}}
    out = {}
    for r in seen:
        n, chars, symbols, duplicates, repeats = r[6:]
        failed = n < 50 or 100 * repeats > 50 * n
        out[r[0]] = (n, chars, symbols, duplicates, repeats, failed, not failed and (not refs or within(r, refs)))
    return out


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r.doc_id: tuple(r)[1:8] for r in op10_quality_rules(spark, SF).collect()}
    assert found == brute(rows)


def test_clean_is_kept_and_junk_goes(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op10_quality_rules(spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    kept = {q: [r.kept for r in rows if labels[r.doc_id] == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.99 and np.mean(kept[0]) < 0.3


def test_every_language_of_the_table_has_its_own_reference(spark):
    rnd = np.random.default_rng(6)
    foreign = ["".join(rnd.choice(list("абвгдежзиклмнопрст"), rnd.integers(2, 9))) for _ in range(300)]
    english = "the of and to in that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which".split()
    rows = [(k, " ".join(rnd.choice(foreign, 150)), "ru") for k in range(8)] + [(100 + k, " ".join(rnd.choice(english, 150)), "en") for k in range(8)]
    rows += [(200, " ".join(rnd.choice(foreign, 150)), "en"), (201, " ".join(rnd.choice(foreign, 150)), "xx"), (202, " ".join(rnd.choice(foreign, 150)), None)]
    found = {r.doc_id: (r.kept, r.chars_distance) for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[k][0] for k in [*range(8), *range(100, 108), 201, 202]) and not found[200][0]
    assert found[201][1] is None and found[202][1] < 0.2
    assert {k: v[0] for k, v in found.items()} == {k: v[-1] for k, v in brute(rows).items()}


def test_rules_at_the_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "\n\n a\n a\nb", "xx"), (4, "w " * 49, "en"), (5, " ".join(f"w{i}" for i in range(50)), None), (6, "#*$%&|<> a\n" * 60, "de"), (None, "a b c a b c d", "en"), (7, "x" * 200_000, "en"), (5, " ".join(f"w{i}" for i in range(50)), None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_words int")
    found = sorted((tuple(r)[:7] for r in quality.quality_rules(docs).collect()), key=repr)
    wanted = sorted(((i, *base(t), base(t)[0] < 50 or 100 * base(t)[4] > 50 * base(t)[0]) for i, t, _ in rows), key=repr)
    assert found == wanted
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_classifier_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op8_quality_classifier(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(texts)


def test_scores_against_plain_formula(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    table = quality.class_table()
    x = {i: np.array(discriminant.features(t, table)) for i, t in texts.items()}
    part = lambda v: np.rint(v * discriminant.PART) / discriminant.PART
    by = {q: np.array([part(x[i]) for i, v in labels.items() if v == q and zlib.crc32(str(i).encode()) % 4 != 2]) for q in (0, 1)}
    total = sum(map(len, by.values()))
    covariances = {q: np.cov(v.T, bias=True) for q, v in by.items()}
    pooled = sum(len(by[q]) * np.diag(covariances[q]) for q in by) / total
    logs = []
    sample = np.array([x[i] for i in sorted(x)])
    for q in (0, 1):
        c = 0.9 * covariances[q] + 0.1 * np.diag(np.maximum(pooled, 1e-4)) + 1e-4 * np.eye(len(pooled))
        d = sample - by[q].mean(0)
        logs.append(math.log(len(by[q]) / total) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    wanted = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    found = {r.doc_id: r.score for r in discriminant.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert np.allclose([found[i] for i in sorted(x)], wanted, atol=1e-6)
    again = discriminant.classify(docs.repartition(7, "text"), spark.read.parquet(f"{SF}/labels.parquet").repartition(3)).collect()
    assert {r.doc_id: r.score for r in again} == found  # to the last digit, whatever the order of rows


def test_classifier_at_the_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "some text", 3), (2, "", 3), (4, "z" * 100_000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (9, 0)], "doc_id long, quality int")
    rows = discriminant.classify(docs, labels).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1 and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert discriminant.classify(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "é" * 10, "\x00", "a b a b a b"])
def test_features_are_finite(text):
    assert np.isfinite(discriminant.features(text, quality.class_table())).all()
