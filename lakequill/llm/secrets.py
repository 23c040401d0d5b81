"""Secret scans (operator 3), by column expressions only.

Base kinds are patterns. The method looks at other long runs of code-like characters:
for each it infers the encoding, and a battery of three tests asks whether the run is
random over the alphabet of that encoding:

* chi-squared of the symbol counts against a uniform alphabet, scaled to its exact mean
  and variance for this length and alphabet,
* Wald-Wolfowitz runs of symbols above and below the middle of the alphabet,
* serial correlation of neighbouring symbol values.

Their p-values are combined by Cauchy's rule into one, and Benjamini-Hochberg over the runs
of a document, weighted by length (weights of mean 1), rejects runs as not random.

What short identifiers and words hide from these tests, a second null hypothesis tells:
a Markov chain of ordinary identifiers over the symbols of the alphabet. The likelihood of
a run under it over that under randomness bounds its p-value, at any length: the inverse
of that ratio has mean 1 under the null. These p-values go through the same procedure. A
run that is discovered as not ordinary and not rejected as not random is ``random``.

Positions come from the pieces between matches: split and extract_all cut a text at the
same places, so running sums of their lengths are the starts, in code points. Running
sums and maxima go by blocks, about the square root of the array long.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs are maximal, so a least length in the pattern finds the runs that a later filter would.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Runs that the battery looks at.
RUN = "[A-Za-z0-9+/_-]{20,}"
#: False-discovery levels: of runs that are not ordinary, and of runs that are not random.
LEVEL, REJECTED = 0.001, 0.01
#: The normal tail beyond z, by a logistic approximation with these factors of z and its cube.
TAIL = (1.5976, 0.07056)
#: Neighbouring symbols of 107,516 distinct identifiers and words of 8 to 60 characters in
#: Python sources: rows and columns are a to z in either case, a digit, one of +/_-; each
#: place is the binary logarithm of the count and one, rounded down, as a digit of base 36.
FOLLOWS = (
    "7bcc79b6b6adcd5b6dceba89a69b", "b887b665a95b76a72a97b4549589", "c7a9c87cb3cb88d95bacb655848b", "c99ad987c66a98b84aa9a775849c",
    "c9ddbbb8a68ccd9baedd8baca79e", "b788aa75c24a67c63a89a455839a", "a787d78aa26a8a971ba99554656c", "c677c656a26886b7398b8543826b",
    "baccbac5758cbedb6bcdaa5a4a6a", "8235932262533375018282503046", "9687c686b447687757979673625b", "c99bd987d57c87c948bbb863a57c",
    "da88d765b26aa8bc57a8a557826b", "c8cddbd8b69a9ac969cdaa76857d", "aabc7aa6a7accebb4dbbcab9667b", "c789c78aa28b87cb5caba764a67b",
    "31352332410854244664b4311137", "d8bbe9a7d3aabad95bcca985b37c", "b7b9d98bc5aa99bb98ceb886a38c", "d8baea8cd58aa8ca6dbbb898b68d",
    "aa99b993b15bbc8b0cbc553724b8", "b585c664a2256787267644526389", "a5779659b16769a61a965554315a", "7696a6459236856a357b4556838a",
    "878887758349998b38aa5675656b", "8334a30380145174227533105457", "99899944544655463576565621eb", "cbdcccbbc8accbbc8cdcbbb977bc",
)
#: Share of letters, where an alphabet has both cases, in the case of the letter before, or lower after another symbol.
SAME_CASE = 0.85
ALPHABETS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
SPAN = "array<struct<start:int,rank:int,stop:int>>"
#: Code points of the pieces that a text is cut into before parts of it are taken out.
PIECE = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, most: bool = False) -> Column:
    """Sums (or maxima) of an array of integers, not empty, up to each place."""
    join = (lambda x, y: F.greatest(x, y)) if most else (lambda x, y: x + y)
    state = lambda head: F.struct(head.alias("at"), F.array().cast("array<int>").alias("seen"))

    def whole(block: Column, head: Column) -> Column:
        return F.aggregate(block, state(head), lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["seen"], F.array(join(acc["at"], v))).alias("seen")), lambda acc: acc["seen"])

    def by_blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = _let(width, lambda w: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / w).cast("int")), lambda k: F.slice(v, k * w + 1, w)))
        heads = lambda blocks: F.concat(F.array(F.lit(0)), whole(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), join)), F.lit(0)))
        return _let(cut, lambda blocks: F.flatten(F.zip_with(blocks, F.slice(heads(blocks), F.lit(1), F.size(blocks)), whole)))

    return _let(values, by_blocks)


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """The leftmost non-overlapping matches, and what lies before each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))


def _stops(found: Column, gaps: Column) -> Column:
    """Where each match ends."""
    return _running(F.zip_with(gaps, found, lambda g, f: F.length(g) + F.length(f)))


def _matches(found: Column, stops: Column) -> Column:
    """array<struct<start, stop, found>>, in code points from 0."""
    return F.zip_with(found, stops, lambda f, stop: F.struct((stop - F.length(f)).alias("start"), stop.alias("stop"), f.alias("found")))


@cache
def ratios(alphabet: str) -> tuple[int, ...]:
    """For each pair of symbols, row by row: log of (1 / k) over the second's share after the first in identifiers of this alphabet, in hundredths."""
    group = lambda c: 26 if c.isdigit() else ord(c.lower()) - 97 if c.isalpha() else 27
    members = [sum(group(c) == g for c in alphabet.lower() if not c.isalpha()) for g in range(28)]
    both = alphabet.lower() != alphabet and alphabet.upper() != alphabet
    found = []
    for a in alphabet:
        weights = []
        for b in alphabet:
            w = 1.5 * 2.0 ** int(FOLLOWS[group(a)][group(b)], 36)
            if not b.isalpha():
                w /= members[group(b)]
            elif both:
                w *= SAME_CASE if b.isupper() == a.isupper() else 1 - SAME_CASE
            weights.append(w)
        found += [round(100 * math.log(sum(weights) / w / len(alphabet))) for w in weights]
    return tuple(found)


def _encoded(run: Column) -> Column:
    """The run with the place of its alphabet in ALPHABETS, from 1."""
    kind = F.coalesce(*(F.when(run["found"].rlike(p), F.lit(i)) if p else F.lit(i) for i, (_, p, _) in enumerate(ALPHABETS, 1)))
    return F.struct(run["start"].alias("start"), run["stop"].alias("stop"), run["found"].alias("found"), kind.alias("kind"))


def _valued(run: Column) -> Column:
    """struct<start, stop, k, values>: symbols as values from 0; base64's other two symbols count as its usual ones."""
    alphabet = F.element_at(F.array(*(F.lit(a) for _, _, a in ALPHABETS)), run["kind"])
    plain = F.when(run["kind"] == len(ALPHABETS), F.translate(run["found"], "-_", "+/")).otherwise(run["found"])
    # The pieces of a split by "" have an empty one at the end.
    values = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, alphabet) - 1)
    return F.struct(run["start"].alias("start"), run["stop"].alias("stop"), run["kind"].alias("kind"), F.length(alphabet).alias("k"), values.alias("values"))


def _tables() -> Column:
    """ratios() of every alphabet, a constant."""
    return F.array(*(F.split(F.lit(",".join(map(str, ratios(a)))), ",").cast("array<int>") for _, _, a in ALPHABETS))


def _summed(run: Column) -> Column:
    """What the tests need of a run's values, in whole numbers, from one pass in order and one in sorted order."""
    values, k = run["values"], run["k"]
    high = lambda v: F.when(2 * v > k - 1, 1).otherwise(0)
    one, none = F.element_at(values, 1), F.lit(0).cast("long")
    whole = one.cast("long")
    first = F.struct(one.alias("last"), none.alias("ratio"), F.lit(0).alias("changes"), high(one).alias("high"), whole.alias("sum"), (whole * whole).alias("squares"), none.alias("joint"))

    def step(acc: Column, v: Column) -> Column:
        u = acc["last"]
        ratio = F.element_at(F.element_at(_tables(), run["kind"]), u * k + v + 1)
        return F.struct(v.alias("last"), (acc["ratio"] + ratio).alias("ratio"), (acc["changes"] + F.abs(high(u) - high(v))).alias("changes"), (acc["high"] + high(v)).alias("high"), (acc["sum"] + v).alias("sum"), (acc["squares"] + v * v).alias("squares"), (acc["joint"] + u * v).alias("joint"))

    # One more of a symbol met c times adds 2 c + 1 to the sum of the squared counts.
    group = F.struct(F.lit(-1).alias("last"), none.alias("c"), none.alias("sum"))
    counts = F.aggregate(F.array_sort(values), group, lambda acc, v: F.struct(v.alias("last"), F.when(v == acc["last"], acc["c"] + 1).otherwise(none + 1).alias("c"), (acc["sum"] + F.when(v == acc["last"], 2 * acc["c"] + 1).otherwise(1)).alias("sum")), lambda acc: acc["sum"])
    sums = F.aggregate(F.slice(values, F.lit(2), F.size(values)), first, step)
    return F.struct(run["start"].alias("start"), run["stop"].alias("stop"), k.cast("double").alias("k"), F.size(values).cast("double").alias("length"), counts.alias("counts"), one.alias("one"), sums.alias("of"))


def _tail(z: Column) -> Column:
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), TAIL[0] * z + TAIL[1] * z * z * z))))


def _judged(t: Column) -> Column:
    """struct<ordinary, random, start, stop, length> from a run's sums: p under either null hypothesis."""
    n, k, of = t["length"], t["k"], t["of"]
    ordinary = F.exp(F.least(F.lit(0.0), of["ratio"] / F.lit(-100.0)))
    # Chi-squared as a multiple of a chi-squared variable with its mean and variance, by the cube root.
    mean = k - 1
    part = (n - 1) / (n * mean * 4.5)
    squares = _tail((F.cbrt((t["counts"] * k / n - n) / mean) - 1 + part) / F.sqrt(part))
    mixed = 2 * of["high"] * (n - of["high"])
    spread = F.sqrt(F.greatest(F.lit(0.25), mixed * (mixed - n) / (n * n * (n - 1))))
    runs = 2 * _tail(F.abs((of["changes"] - mixed / n) / spread))
    centre = of["sum"] / n
    variance = of["squares"] - of["sum"] * centre
    joint = of["joint"] - centre * (2 * of["sum"] - t["one"] - of["last"]) + (n - 1) * centre * centre
    serial = 2 * _tail(F.abs((F.when(variance > 0, joint / variance).otherwise(F.lit(1.0)) + 1 / n) * n * F.sqrt(n - 1) / (n - 2)))
    cauchy = sum((F.tan((0.5 - F.least(F.lit(0.99), F.greatest(F.lit(1e-12), p))) * math.pi) for p in (squares, runs, serial)), F.lit(0.0)) / 3
    return F.struct(ordinary.alias("ordinary"), (0.5 - F.atan(cauchy) / math.pi).alias("random"), t["start"].alias("start"), t["stop"].alias("stop"), n.alias("length"))


def _rejected(judged: Column, p: str, total: Column, level: float) -> Column:
    """Benjamini-Hochberg: array of start * 2^32 + stop, the runs up to the last whose p, over its length in mean lengths of the document's runs, is within its share of the level."""
    weighted = F.array_sort(F.transform(judged, lambda x: F.struct((x[p] * total / F.size(judged) / x["length"]).alias("p"), x["start"].alias("start"), x["stop"].alias("stop"))))
    many = F.size(judged)
    last = F.aggregate(F.transform(weighted, lambda x, i: F.when(x["p"] <= (i + 1) * level / many, i + 1).otherwise(0)), F.lit(0), lambda acc, v: F.greatest(acc, v))
    return F.transform(F.slice(weighted, F.lit(1), last), lambda x: F.shiftleft(x["start"].cast("long"), 32).bitwiseOR(x["stop"].cast("long")))


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _as_spans(matches: Column, rank: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["stop"].alias("stop")))


def scan_secrets(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``{prefix}base`` and ``{prefix}found``: sorted arrays of struct<start, rank, stop>.

    ``base`` has the spans of the patterns, ``found`` these and the method's, where they
    overlap no base span. Offsets are code points, ends exclusive. Null and empty texts
    have none; repeated rows are scanned alike; texts are scanned whole, in time about
    proportional to their length and number of spans. The added names replace columns of
    the same name; any other column stays.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = lambda c: f"__{prefix}{c}"
    # Staged, so that each pattern runs once: arrays used twice must not be computed twice.
    patterns = (ASSIGN, ACCESS, HEX, RUN)
    staged = docs.withColumn(name("text"), text)
    pieces = [_pieces(F.col(name("text")), p) for p in patterns]
    none = F.array().cast("array<string>")
    met = lambda c, p: F.when(F.col(name("text")).rlike(p), c).otherwise(none)
    staged = staged.withColumns({name(f"f{k}"): met(f, p) for k, ((f, _), p) in enumerate(zip(pieces, patterns))})
    gaps = lambda k, p: F.when(F.size(name(f"f{k}")) > 0, F.slice(F.split(F.col(name("text")), p, -1), F.lit(1), F.size(name(f"f{k}")))).otherwise(none)
    staged = staged.withColumns({name(f"g{k}"): gaps(k, p) for k, p in enumerate(patterns)})
    ends = lambda k: F.when(F.size(name(f"f{k}")) > 0, _stops(F.col(name(f"f{k}")), F.col(name(f"g{k}")))).otherwise(F.array().cast("array<int>"))
    staged = staged.withColumns({name(f"s{k}"): ends(k) for k in range(4)}).drop(*(name(f"g{k}") for k in range(4)))
    staged = staged.withColumns({name(f"m{k}"): _matches(F.col(name(f"f{k}")), F.col(name(f"s{k}"))) for k in range(4)})
    assign = F.filter(F.col(name("m0")), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.array_sort(F.concat(_as_spans(assign, 0), _as_spans(F.col(name("m1")), 1), _as_spans(F.col(name("m2")), 2)))
    staged = staged.withColumn(f"{prefix}base", base)
    # Starts of base spans and ends of runs in one order: a run is clear if no span that starts before its end ends after its start.
    event = lambda at, kind, start, stop, found: F.struct(at.alias("at"), F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), found.alias("found"))
    events = F.array_sort(F.concat(F.transform(F.col(f"{prefix}base"), lambda b: event(b["start"], 1, b["start"], b["stop"], F.lit(""))), F.transform(F.col(name("m3")), lambda m: event(m["stop"], 0, m["start"], m["stop"], m["found"]))))
    mixed = (F.size(f"{prefix}base") > 0) & (F.size(name("m3")) > 0)
    staged = staged.withColumn(name("events"), F.when(mixed, events))
    staged = staged.withColumn(name("until"), F.when(mixed, _running(F.transform(F.col(name("events")), lambda e: F.when(e["kind"] == 1, e["stop"]).otherwise(0)), most=True)))
    clear = F.filter(F.zip_with(name("events"), name("until"), lambda e, u: F.struct(e["kind"].alias("kind"), (u <= e["start"]).alias("clear"), e["start"].alias("start"), e["stop"].alias("stop"), e["found"].alias("found"))), lambda e: (e["kind"] == 0) & e["clear"])
    runs = F.when(mixed, F.transform(clear, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["found"].alias("found")))).otherwise(F.col(name("m3")))
    staged = staged.withColumn(name("runs"), runs)
    some = F.size(name("runs")) > 0
    staged = staged.withColumn(name("judged"), F.when(some, F.transform(F.transform(F.transform(F.transform(F.col(name("runs")), _encoded), _valued), _summed), _judged)))
    staged = staged.withColumn(name("total"), F.aggregate(F.col(name("judged")), F.lit(0.0), lambda acc, x: acc + x["length"]))
    judged, total = F.col(name("judged")), F.col(name("total"))
    staged = staged.withColumns({name("odd"): F.when(some, _rejected(judged, "ordinary", total, LEVEL)), name("even"): F.when(some, _rejected(judged, "random", total, REJECTED))})
    random = F.when(some, F.transform(F.array_except(name("odd"), name("even")), lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("start"), F.lit(3).alias("rank"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("stop")))).otherwise(F.array().cast(SPAN))
    staged = staged.withColumn(f"{prefix}found", F.array_sort(F.concat(F.col(f"{prefix}base"), random)))
    return staged.drop(*(name(f"{c}{k}") for c in "fsm" for k in range(4)), *(name(c) for c in ("text", "events", "until", "runs", "judged", "total", "odd", "even")))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    scanned = scan_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans by one. Other texts stay as they are."""
    columns = docs.columns
    scanned = scan_secrets(docs, text_col, prefix="__secret_")
    some = F.size("__secret_found") > 0
    staged = scanned.withColumn("__secret_until", F.when(some, _running(F.transform("__secret_found", lambda s: s["stop"]), most=True)))
    staged = staged.withColumn("__secret_pieces", F.when(some, F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    before = F.concat(F.array(F.lit(0)), F.slice("__secret_until", F.lit(1), F.size("__secret_until") - 1))
    gaps = F.filter(F.zip_with("__secret_found", before, lambda s, u: F.struct(u.alias("a"), s["start"].alias("b"))), lambda g: g["a"] <= g["b"])
    tail = F.struct(F.element_at("__secret_until", -1).alias("a"), F.length(text_col).alias("b"))

    def kept(g: Column) -> Column:
        a, b = g["a"], g["b"]
        places = F.sequence((a / PIECE).cast("int"), ((b - 1) / PIECE).cast("int"))
        part = lambda k: F.substring(F.element_at("__secret_pieces", k + 1), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
        return F.when(b <= a, F.lit("")).otherwise(F.array_join(F.transform(places, part), ""))

    clean = F.array_join(F.transform(F.concat(gaps, F.array(tail)), kept), mark)
    return staged.withColumn(text_col, F.when(some, clean).otherwise(F.col(text_col))).select(*columns)
