"""The Jaccard join and components against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lakequill.llm import ngrams
from lakequill.llm.components import components
from lakequill.llm.queries import op2_ngram_jaccard
from lakequill.llm.shared import written

SF = "/root/testdata/sf0.001"


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, percent=90, k=3):
    """(id, n, component, links) by all pairs of rows."""
    sets = [shingles(t, k) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            links[a] += 1
            links[b] += 1
            p, q = top(a), top(b)
            parent[max(p, q)] = min(p, q)
    least = {}
    for r, (i, _) in enumerate(rows):
        if i is not None:
            least[top(r)] = min(least.get(top(r), i), i)
    return sorted(((i, len(s), least.get(top(r)) if s else i, links[r]) for r, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect()), key=repr)


def variants(seed, groups, copies, words=120, edits=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        text = rnd.choices(vocabulary, k=words)
        for _ in range(rnd.randint(1, copies)):
            t = list(text)
            for _ in range(rnd.randint(0, edits)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append(" ".join(t))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "percent", "high", "block"), [(1, 90, 64, 2048), (2, 80, 4, 5), (3, 66, 2, 3)])
def test_groups_of_near_copies(spark, monkeypatch, seed, percent, high, block):
    monkeypatch.setattr(ngrams, "HIGH", high)
    monkeypatch.setattr(ngrams, "BLOCK_CLASSES", block)
    monkeypatch.setattr(ngrams, "BLOCK_ROWS", block)
    rows = variants(seed, 12, 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(ngrams.ngram_jaccard(docs, percent=percent)) == brute(rows, percent)


def test_chains_of_links_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "OFTEN", 2)
    monkeypatch.setattr(ngrams, "HIGH_LEVEL", 3)
    monkeypatch.setattr(ngrams, "HIGH", 3)
    monkeypatch.setattr(ngrams, "BLOCK_ROWS", 2)
    base = [f"c{i}" for i in range(100)]
    rows = []
    for k in range(12):  # each links to the next, far ones don't link
        rows.append(" ".join([f"x{i}" if i < 2 * k else w for i, w in enumerate(base)]))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"u{k}_{i}" for i in range(60)) for k in range(8)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(ngrams.ngram_jaccard(docs)) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "a b c"), (9, "a b c a b c"), (10, "é É"), (11, "é é"), (12, "ab c d"), (12, "ab c d"), (13, "x " * 30000)]
    docs = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, component_id string, n long")
    assert result(ngrams.ngram_jaccard(docs)) == brute(rows)
    assert result(ngrams.ngram_jaccard(docs.limit(0))) == []
    nulls = [(None, "a b c d"), (None, "a b c d"), (5, "e f g"), (None, "e f g"), (5, "another text")]
    assert result(ngrams.ngram_jaccard(spark.createDataFrame(nulls, "doc_id long, text string"))) == brute(nulls)


@pytest.mark.parametrize("percent", [50, 66, 100])
def test_short_sets_at_any_percent(spark, percent):
    rnd = random.Random(percent)
    rows = [(1, "a b c"), (2, "a b c d"), (3, "b c d")] + [(i, " ".join(rnd.choices("abcd", k=rnd.randint(1, 7)))) for i in range(4, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(ngrams.ngram_jaccard(docs, percent=percent)) == brute(rows, percent)
    with pytest.raises(ValueError):
        ngrams.ngram_jaccard(docs, percent=0)


def test_overlaps_by_blocks_of_columns(monkeypatch):
    monkeypatch.setattr(ngrams, "CELLS", 1)
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 900, rnd.integers(0, 700)).astype(np.uint64)) for _ in range(9)]
    wanted = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    apart = ~np.eye(9, dtype=bool)  # a set with itself is never asked for
    assert (ngrams.overlaps(sets)[apart] == np.array(wanted)[apart]).all()
    assert ngrams.overlaps(sets[:4], sets[4:]).tolist() == [w[4:] for w in wanted[:4]]


def test_deduplicated(spark):
    rows = variants(9, 10, 8) + [(500, None), (501, ""), (501, ""), (None, "a null id"), (None, "a null id"), (7, "a null id"), (7, "of a shared id")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, hi long").repartition(3)
    out = ngrams.deduplicated(docs)
    assert out.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    keep = {}
    for r, (i, t) in enumerate(rows):
        if shingles(t):
            mates = [s for s, (_, u) in enumerate(rows) if 100 * len(shingles(t) & shingles(u)) >= 90 * len(shingles(t) | shingles(u))]
            keep[r] = mates
    parent = {r: r for r in keep}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r, mates in keep.items():
        for m in mates:
            p, q = top(r), top(m)
            parent[max(p, q)] = min(p, q)
    groups = {}
    for r in keep:
        groups.setdefault(top(r), []).append(rows[r])
    wanted = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()] + [r for r in rows if not shingles(r[1])]
    assert [x[0] for x in found] == [x[0] for x in sorted(wanted, key=repr)] and len(found) == len(wanted)


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_sets_of_any_texts(monkeypatch, piece):
    """As many shingles as there are, and equal for equal words only, however the bytes are cut."""
    monkeypatch.setattr(ngrams.Shingler, "PIECE", piece)
    rnd = random.Random(piece)
    texts = [None, "", " ", "a", " a  B\tc ", "x" * 200 + " " + "x" * 201, "x" * 64 + " " + "x" * 65, "é É \x00 \x1f \x85 🎉", "A b C d", "a B c D", "word" * 50 + " end"]
    texts += ["".join(rnd.choices("abAB é\n\v_", k=rnd.randint(0, 60))) for _ in range(300)]
    column = pa.array(["skipped", *texts, "skipped"], pa.string()).slice(1, len(texts))
    for k in (1, 3):
        found = list(ngrams.Shingler(k).sets(column))
        seen = {}
        for t, s in zip(texts, found):
            real = shingles(t, k)
            assert len(s) == len(real) and (np.diff(s.astype(np.int64)) > 0).all()
            assert seen.setdefault(real, s.tobytes()) == s.tobytes()
        assert len(set(seen.values())) == len(seen)
        assert [x.tolist() for x in map(ngrams.Shingler(k), texts[:20])] == [x.tolist() for x in found[:20]]


def test_signature_bounds_the_difference():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rnd.integers(0, 1 << 62, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rnd.integers(100, 200)], rnd.integers(0, 1 << 62, 10, dtype=np.uint64)]))
        bits = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(ngrams.signature(a), ngrams.signature(b)))
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("percent", [90, 93, 99])
def test_linked_sets_have_a_part_in_common(monkeypatch, percent):
    monkeypatch.setattr(ngrams, "SPARED", 3)  # so that small parts are left out of small sets as well
    rnd = np.random.default_rng(percent)
    linked = 0
    for size in [*range(9, 60), *rnd.integers(60, 900, 60).tolist()]:
        for _ in range(6):
            a = np.unique(rnd.integers(0, 1 << 63, size, np.uint64))
            gone = int(rnd.integers(0, size * (100 - percent) // 90 + 1))
            new = int(rnd.integers(0, size * (100 - percent) // 90 + 1))
            b = np.unique(np.concatenate([rnd.permutation(a)[gone:], rnd.integers(0, 1 << 63, new, np.uint64)]))
            same = len(np.intersect1d(a, b))
            if 100 * same >= percent * (len(a) + len(b) - same):
                linked += 1
                assert len(np.intersect1d(ngrams.parts(a, percent), ngrams.parts(b, percent)))
    assert linked > 100


def test_unlike_texts_with_common_shingles_do_not_meet(spark, monkeypatch):
    """Texts of few frequent words share shingles by chance; the pairs that are stored must not grow with their square."""
    stored = {}

    def noted(df, name, **options):
        found = written(df, name, **options)
        stored[name] = found.count()
        return found

    monkeypatch.setattr(ngrams, "written", noted)
    rnd = random.Random(5)
    rows = [" ".join(rnd.choices([f"w{i}" for i in range(40)], k=150)) for _ in range(300)]
    rows = list(enumerate([*rows, *(r + " end" for r in rows[:20])]))
    found = result(ngrams.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert found == brute(rows)
    assert stored["met"] < 2 * len(rows) and stored["pairs"] < len(rows)


def test_deduplicated_leaves_rows_where_they_are(spark):
    """Rows that stay are not dealt out, so they keep their order; of repeated and linked rows one stays."""
    rnd = random.Random(8)
    unlike = [(i, " ".join(rnd.choices([f"w{i}" for i in range(300)], k=200))) for i in rnd.sample(range(1000), 60)]
    (a, text), (b, other), (_, third) = unlike[:3]
    again = [(a + 1000, text + " end"), (b, other), (None, third), (None, "alone here"), (None, "alone here"), (2000, ""), (2000, ""), (None, None)]
    docs = spark.createDataFrame(unlike + again, "doc_id long, text string").coalesce(1)
    found = [(r.doc_id, r.text) for r in ngrams.deduplicated(docs).collect()]
    assert sorted(found, key=repr) == sorted([*unlike, (None, "alone here"), (2000, ""), (2000, ""), (None, None)], key=repr)
    untouched = [r for r in unlike if r[0] != b]
    assert [r for r in found if r in untouched] == untouched


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        parent[max(p, q)] = min(p, q)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {x: top(x) for x in linked}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(op2_ngram_jaccard(spark, SF)) == brute(rows)
