"""Mixing sources to target weights (operator 9), by column expressions only.

A labelled table names the domain of some documents. A naive Bayes classifier over hashed
words, fitted on a bounded sample of the labelled rows and with its evidence scaled down
for long texts, gives each document soft memberships. Nonnegative document rates r are
fitted by projected gradient steps so that the expected tokens of each domain, sum over
documents of r * tokens * membership, come to the targets; squares are weighted by the
domains' own totals, so that a step of 1 is safe:

    r <- max(0, r - sum over domains of membership * (total - target) / own total)

A step needs the totals only, one small sum per domain, from one pass over a narrow table.
Texts are read once to fit the classifier, the sampled ones only, and once for memberships.
"""

from __future__ import annotations

import json
import math
import warnings
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.llm.shared import written

WHITE = "[\\x20\\x09-\\x0D]+"
#: Words are hashed to so many buckets.
BUCKETS = 4096
#: The classifier is fitted on about so many labelled rows, chosen by a hash of their ids; with fewer, on all.
LABELLED = 20_000
#: A document counts for at most so many words; prior words of each bucket in each domain.
EVIDENCE, SMOOTHING = 40.0, 0.1
#: Logarithms of the profiles are whole numbers of this part, so that their sums are exact.
PART = 100
STEPS, CLOSE = 60, 1e-4
#: Where no total is asked for, it is so many times the least for which no domain has to shrink: rates stay over 1.
HEADROOM = 1.01


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WHITE), lambda w: w != "")


def _buckets(words: Column) -> Column:
    """The bucket of each word, from 1."""
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int") + 1)


class Mixture:
    """Domains, classifier weights, the residuals of the steps taken, and how near the targets they came."""

    def __init__(self, domains: list[str], priors: list[float], weights: list[list[int]]):
        self.domains, self.priors, self.weights = domains, priors, weights
        self.steps: list[list[float]] = []
        #: The largest miss of a domain's total, as a share of its target; where that is 0, of the wanted total.
        self.residual = 0.0

    def scores(self, buckets: Column) -> Column:
        """Array of the sums of weights by domain."""

        def score(weights: list[int]) -> Column:
            table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # a constant
            return F.aggregate(buckets, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b))

        return F.array(*map(score, self.weights))

    def memberships(self, scores: Column, words: Column) -> Column:
        """Array of posteriors."""
        scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(words.cast("double"), F.lit(1.0))) / PART
        logs = F.array(*(F.lit(math.log(p)) + scale * scores[k] for k, p in enumerate(self.priors)))
        return F.transform(logs, lambda x: 1 / F.aggregate(logs, F.lit(0.0), lambda a, y: a + F.exp(F.least(y - x, F.lit(700.0)))))

    def rate(self, p: Column) -> Column:
        """The rate of a document with memberships ``p`` after all steps, one after the other."""
        steps = F.from_json(F.lit(json.dumps(self.steps)), "array<array<double>>")  # a constant

        def step(r: Column, s: Column) -> Column:
            return F.greatest(F.lit(0.0), r - reduce(add, (p[k] * s[k] for k in range(len(self.domains)))))

        return F.round(F.aggregate(steps, F.lit(1.0), step), 6) if self.steps else F.lit(1.0)


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, domain_col: str) -> Mixture:
    """Naive Bayes over the sampled labelled rows. Rows without id are not used."""
    known = labelled.select(F.col(id_col).alias("__known_id"), F.col(domain_col).cast("string").alias("__domain")).filter(F.col("__domain").isin(domains) & F.col("__known_id").isNotNull())
    many = known.count()
    if many > LABELLED:
        known = known.filter(F.pmod(F.xxhash64("__known_id"), F.lit(1 << 30)) < int((1 << 30) * LABELLED / many))
    sample = F.broadcast(known.dropDuplicates(["__known_id"]))  # about LABELLED rows
    chosen = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).join(sample, F.col("__id") == F.col("__known_id"))
    # A row beside the words counts the documents: bucket 0.
    counted = chosen.select("__domain", F.explode(F.concat(F.array(F.lit(0)), _buckets(_words(F.col("__text"))))).alias("bucket")).groupBy("__domain", "bucket").agg(F.count("*").alias("n"))
    hits = {d: [SMOOTHING] * BUCKETS for d in domains}
    rows = dict.fromkeys(domains, 1.0)
    for r in counted.collect():  # domains x buckets numbers
        if r["bucket"]:
            hits[r["__domain"]][r["bucket"] - 1] += r["n"]
        else:
            rows[r["__domain"]] += r["n"]
    weights = [[round(PART * math.log(h / total)) for h in hits[d]] for d in domains for total in (sum(hits[d]),)]
    return Mixture(domains, [rows[d] / sum(rows.values()) for d in domains], weights)


def _scored(docs: DataFrame, mixture: Mixture, text_col: str, tokens_col: str | None, columns: list[str]) -> DataFrame:
    """The ``columns`` of ``docs`` with __mix_t (tokens) and __mix_p (memberships), stored: each text is counted once."""
    staged = docs.withColumn("__mix_b", _buckets(_words(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    staged = staged.withColumns({"__mix_n": F.size("__mix_b"), "__mix_s": mixture.scores(F.col("__mix_b"))})
    tokens = F.col("__mix_n") if tokens_col is None else F.coalesce(F.col(tokens_col), F.lit(0))
    return written(staged.select(*columns, tokens.cast("double").alias("__mix_t"), mixture.memberships(F.col("__mix_s"), F.col("__mix_n")).alias("__mix_p")), "memberships")


def _steps(scored: DataFrame, mixture: Mixture, targets: dict[str, float], total: float | None) -> None:
    """Takes the gradient steps."""
    share = [targets[d] / sum(targets.values()) for d in mixture.domains]
    p, own, wanted, whole = F.col("__mix_p"), None, [], 0.0
    for _ in range(STEPS + 1):
        rate = mixture.rate(p)
        totals = [float(x or 0.0) for x in scored.select("__mix_t", "__mix_p").withColumn("__mix_r", F.col("__mix_t") * rate).agg(*(F.sum(F.col("__mix_r") * p[k]) for k in range(len(share)))).first()]
        if own is None:
            if sum(totals) <= 0:
                return
            own = [max(x, 1e-9) for x in totals]
            whole = sum(totals) * total if total is not None else HEADROOM * max(o / s for o, s in zip(totals, share) if s > 0)
            wanted = [whole * s for s in share]
        mixture.residual = max(abs(x - w) / (w or whole) for x, w in zip(totals, wanted))
        if mixture.residual <= CLOSE:
            return
        if len(mixture.steps) < STEPS:
            step = [(x - w) / o if o > 1e-9 else 0.0 for x, w, o in zip(totals, wanted, own)]
            if mixture.steps and max(abs(a) for a in step) < 1e-9:
                break
            mixture.steps.append(step)
    warnings.warn(f"rates miss their targets by {mixture.residual:.3g} after {len(mixture.steps)} steps", stacklevel=3)


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", tokens_col: str | None = None, keep: list[str] | None = None) -> tuple[Mixture, DataFrame]:
    """The mixture, and ``docs`` (the columns ``keep``, or all) with __mix_t (tokens) and __mix_p (memberships).

    ``targets`` are the wanted shares of tokens, none negative. ``total`` is the wanted
    number of tokens as a multiple of what there is; without it, it is the least for which
    no domain has to shrink, so that mixing adds copies and need not drop documents. Tokens
    are words unless ``tokens_col`` has counts. Domains of ``labelled`` without target are
    ignored; a domain without labelled rows has a flat profile. An empty table takes no
    steps. Targets that can't be met (no tokens in a domain) are missed by the least
    squares, with a warning; ``residual`` says by how much.
    """
    domains = sorted(targets)
    if not domains or min(targets.values()) < 0 or sum(targets.values()) <= 0 or (total is not None and total <= 0):
        raise ValueError("targets must not be negative, one must be positive, and so must the total")
    mixture = classifier(docs, labelled, domains, id_col, text_col, domain_col)
    scored = _scored(docs, mixture, text_col, tokens_col, docs.columns if keep is None else keep)
    _steps(scored, mixture, targets, total)
    return mixture, scored


def copies(rate: Column, id_col: Column) -> Column:
    """A whole number of copies whose expectation over ids is the rate; the same each time."""
    chance = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, **names: str) -> DataFrame:
    """(doc_id, n_tokens, domain, membership, rate, copies) for every row of ``docs``.

    ``domain`` is the likeliest domain and ``membership`` its posterior. Null and empty
    texts have no tokens and the prior memberships. Null ids and repeated rows stay; other
    columns are left out.
    """
    mixture, scored = fit(docs, labelled, targets, total, id_col, text_col, tokens_col=tokens_col, keep=[id_col], **names)
    scored = scored.withColumnRenamed(id_col, "doc_id")
    rate = scored.withColumn("rate", mixture.rate(F.col("__mix_p")))
    top = F.array_position("__mix_p", F.array_max("__mix_p")).cast("int")
    return rate.select("doc_id", F.col("__mix_t").cast("long").alias("n_tokens"), F.element_at(F.array(*map(F.lit, mixture.domains)), top).alias("domain"), F.round(F.array_max("__mix_p"), 9).alias("membership"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, id_col: str = "doc_id", **names: str | None) -> DataFrame:
    """``docs`` with each row as often as its rate says; columns unchanged."""
    mixture, scored = fit(docs, labelled, targets, total, id_col=id_col, **names)
    staged = scored.withColumn("__mix_n", copies(mixture.rate(F.col("__mix_p")), F.col(id_col)))
    return staged.withColumn("__mix_k", F.explode(F.array_repeat(F.lit(0), F.col("__mix_n")))).select(*docs.columns)
