"""N-gram Jaccard join (operator 2).

Documents by distinct word shingles are the rows and columns of a sparse 0/1 matrix;
the overlaps of all pairs are its product with its transpose. Documents with one shingle
set are one class; all that follows is on classes. The product is taken twice, in blocks:

1. Over columns in which a pair that links must meet. From ``PARTS_FROM`` percent on, a
   column is a whole part of a set: hashes deal the shingles of all sets of about one size
   out to more parts than linked sets of that size have shingles that differ, so that some
   part of both is the same (``parts``). Unlike texts share shingles by chance, in numbers
   that grow with the square of the input, but not the several shingles of a part.
   At lower percentages parts would be too small, and a column is a shingle. These are in
   one global order, by how often blocks of documents hold them, then by hash. Sizes bound
   the overlap of a linked pair from below, so it must share ``MEET`` shingles among the
   first ``n - ceil(t n) + MEET`` of either set. Columns are counted for all pairs of
   a column that is low; in a high column every class is paired with two pivots (the first
   class, and the one that is in most high columns), and then the classes that these
   pairs leave in different groups meet in blocks of rows. Sizes, counts and 512 parity
   bits of each set, which bound the symmetric difference from below, discard pairs.
   What remains joins classes into candidate groups; every linked pair is within one.
2. Over all columns, within each candidate group, in blocks of rows by rows: whole sets
   are dealt out once for each block of their group, overlaps of two blocks are
   accumulated block of columns by block of columns, and a pair links or not by its exact
   overlap. Only the number of links of each class and the edges that connect it leave
   a block, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.llm.components import components
from lakequill.llm.shared import forget, looked_up, met_often, written

WORD = "[^\\x20\\x09-\\x0D]+"
#: The least percentage at which classes meet in parts of their sets.
PARTS_FROM = 90
#: The largest size of a band over its least; a class leaves out one small part in so many that differ at most.
BAND, SPARED = 1.3, 24
#: Prefix columns that a linked pair must share, or as many as its overlap, if that is less.
MEET = 3
#: Columns seen so often in one block of so many columns raise the level of their bucket.
#: Levels decide the order of shingles and what is dealt out with salt, so how much work there is, never the result.
OFTEN, BLOCK_SHINGLES, BUCKETS = 4, 3_000_000, 1 << 22
#: Columns of more classes are high. Those of this level (a binary logarithm) are high beforehand and dealt out with salt.
HIGH, HIGH_LEVEL, SALTS = 64, 12, 1024
#: Rows of a block of the first product; classes and shingles of a block of the second.
BLOCK_ROWS, BLOCK_CLASSES, BLOCK_SET = 1024, 2048, 2_000_000
#: Cells of a dense piece of the incidence matrix.
CELLS = 4_000_000
#: Bits of the filter of documents whose sets are needed; a power of two times 32768.
FILTER_BITS = 1 << 25
LOW63 = np.uint64((1 << 63) - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


class Shingler:
    """Sets of ``k``-word shingles as sorted 63-bit hashes.

    Words are hashed where they lie in a column's bytes, by tables of random numbers for
    each byte at each place of a word; words longer than the tables one by one.
    """

    PLACES = 64
    #: Bytes that are worked on at once, so that the numbers made of them stay few.
    PIECE = 1 << 20

    def __init__(self, k: int):
        self._k = k
        self._salt = np.random.default_rng(20).integers(0, 1 << 64, self.PLACES << 8, np.uint64)
        self._lower = np.arange(256, dtype=np.uint8)
        self._lower[65:91] += 32
        self._white = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.sets(pa.array([text], pa.string())))

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text of a column; that of a null is empty."""
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + self.PIECE, "right")) - 1)
            bounds = offsets[first : last + 1]
            if bounds[-1] - bounds[0] <= self.PIECE:
                words, hashes = self._words(data[bounds[0] : bounds[-1]], bounds[:-1] - bounds[0])
                cuts = np.searchsorted(words, bounds - bounds[0])
            else:  # one long text
                hashes = self._long(data[bounds[0] : bounds[-1]])
                cuts = np.array([0, len(hashes)])
            together = self._joined(hashes, self._k) if len(hashes) >= self._k else hashes[:0]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                found = np.sort(together[a : b - self._k + 1] if b - a >= self._k else self._joined(hashes[a:b], b - a))
                yield found[np.append(True, found[1:] != found[:-1])] if len(found) else found
            first = last

    def _words(self, data: np.ndarray, opens_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start in ``data``, which is cut at ``opens_text``, and their hashes."""
        white = self._white[data]
        begins = np.empty(len(data), bool)
        begins[1:] = white[:-1]
        begins[opens_text[opens_text < len(data)]] = True
        inside = np.nonzero(~white)[0]
        opens = np.nonzero(begins[inside])[0]
        if not len(opens):
            return inside[:0], np.zeros(0, np.uint64)
        lengths = np.diff(np.append(opens, len(inside)))
        spot = np.arange(len(inside)) - np.repeat(opens, lengths)
        spot &= self.PLACES - 1
        spot <<= 8
        letters = self._lower[data[inside]]
        spot |= letters
        hashes = np.add.reduceat(self._salt.take(spot), opens) ^ (lengths.astype(np.uint64) * _MIX[0])
        for w in np.nonzero(lengths > self.PLACES)[0].tolist():
            hashes[w] = xxhash.xxh3_64_intdigest(letters[opens[w] : opens[w] + lengths[w]].tobytes())
        return inside[opens], hashes

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words of one long text, which is cut at white space."""
        found, at = [], 0
        while at < len(data):
            end = min(at + self.PIECE, len(data))
            while end < len(data):  # on to the next white space; a piece as long as that holds one in all likelihood
                ahead = np.nonzero(self._white[data[end : end + self.PIECE]])[0]
                if len(ahead):
                    end += int(ahead[0])
                    break
                end = min(end + self.PIECE, len(data))
            found.append(self._words(data[at:end], np.zeros(1, np.int64))[1])
            at = end
        return np.concatenate(found)

    @staticmethod
    def _joined(h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of ``k`` words."""
        if not k:
            return h[:0]
        total = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            total = (total ^ (total >> np.uint64(29))) * _MIX[3] + h[j : len(h) - k + 1 + j] * (_MIX[j % 3] + np.uint64(2 * j))
        total = (total ^ (total >> np.uint64(32))) * _MIX[3]
        total ^= total >> np.uint64(29)
        return total & LOW63


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


SIGNATURE = [f"s{k}" for k in range(8)]


def signature(shingles: np.ndarray) -> list[int]:
    """512 parities of a set, by the low bits of its hashes: two sets differ in at least as many elements as their signatures in bits."""
    odd = np.bincount((shingles & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def prefix_length(n: int, percent: int) -> int:
    """How many shingles, in the global order, a set of n puts into the first product."""
    return min(n, n - -(-percent * n // 100) + MEET)


@cache
def bands(percent: int) -> tuple[int, ...]:
    """The least size of each band, rising: sets that link are in one band or in neighbouring ones."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] * 100 // percent + 1, math.ceil(BAND * found[-1])))
    return tuple(found)


def parts(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the parts of a set: two sets that link have one in common.

    Linked sets of which the larger is in band b differ in ``apart`` shingles at most. They
    are cut into ``apart + 1 + 2 * spared`` parts by one hash for band b, so that
    ``1 + 2 * spared`` are the same or more; of these either set leaves out ``spared`` at
    most, which are empty or single shingles, so one is left. A set is cut for its own band,
    and for the next if it may link with sets of that.
    """
    least, found = bands(percent), []
    band = bisect_right(least, len(shingles)) - 1
    for b in range(band, band + 1 + (len(shingles) * 100 // percent >= least[band + 1])):
        apart = 2 * (least[b + 1] - 1) * (100 - percent) // (100 + percent)
        spared = apart // SPARED
        many = apart + 1 + 2 * spared
        part = ((shingles * _MIX[0]) >> np.uint64(20)) % np.uint64(many)
        heights = np.bincount(part.astype(np.int64), minlength=many)
        mixed = (shingles ^ (shingles >> np.uint64(31))) * _MIX[1]
        sums = np.append(np.uint64(0), np.cumsum((mixed ^ (mixed >> np.uint64(30)))[np.argsort(part, kind="stable")], dtype=np.uint64))
        ends = np.cumsum(heights)
        place = np.arange(b << 32, (b << 32) + many, dtype=np.uint64) * _MIX[2]
        keys = (sums[ends] - sums[ends - heights] + (place ^ (place >> np.uint64(32)))) * _MIX[3]
        keys = (keys ^ (keys >> np.uint64(29))) & LOW63
        small = (heights < 2).nonzero()[0]
        found.append(np.delete(keys, small[np.argsort(heights[small], kind="stable")][:spared]))
    return np.concatenate(found)


def _batch(columns: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _least_linked(percent: int) -> int:
    """The size from which a set may link to others than its equals."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def _classes_and_counts(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows of two kinds: kind 0 (doc_id, h, n, hi, lo, signature) for each document, kind 1 (hi = bucket, n = count) for frequent columns."""
    least = _least_linked(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(k), set()
        block: list[np.ndarray] = []
        held = 0
        names = ["kind", "doc_id", "h", "n", "hi", "lo", *SIGNATURE]
        kinds = [pa.int32(), *[pa.int64()] * (5 + len(SIGNATURE))]

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *block]), return_counts=True)
            keep = counts >= OFTEN
            many = int(keep.sum())
            nothing = [None] * many
            return _batch([[1] * many, nothing, nothing, counts[keep], (values[keep] & np.uint64(BUCKETS - 1)).astype(np.int64), *[nothing] * (1 + len(SIGNATURE))], kinds, names)

        for batch in batches:
            sizes, his, los, signs = [], [], [], []
            for s in shingler.sets(batch.column(2)):
                sizes.append(len(s))
                if not len(s):
                    his.append(None)
                    los.append(None)
                    signs.append([None] * len(SIGNATURE))
                    continue
                key = digest(s)
                signs.append(signature(s))
                his.append(key[0])
                los.append(key[1])
                if len(s) >= least and key not in seen:
                    seen.add(key)
                    block.append(parts(s, percent) if percent >= PARTS_FROM else s)
                    held += len(block[-1])
                    if held >= BLOCK_SHINGLES:
                        yield frequent()
                        block, held, seen = [], 0, set()
            columns = [[0] * len(sizes), batch.column(0), batch.column(1), sizes, his, los, *([x[k] for x in signs] for k in range(len(SIGNATURE)))]
            yield _batch(columns, kinds, names)
        yield frequent()

    return docs.select("doc_id", "h", "text").mapInArrow(run, "kind int, doc_id long, h long, n long, hi long, lo long, " + ", ".join(f"{s} long" for s in SIGNATURE))


def _levels(counted: DataFrame) -> np.ndarray:
    """The level of each bucket of columns, a byte; the table of the raised ones has BUCKETS rows at most."""
    level = F.floor(F.log2(F.sum("n"))).cast("int")
    raised = counted.groupBy(F.col("hi").cast("int").alias("bucket")).agg(level.alias("level")).toArrow()
    levels = np.zeros(BUCKETS, np.uint8)
    levels[raised["bucket"].to_numpy()] = raised["level"].to_numpy()
    return levels


def _columns(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(place, high, token, hi, lo, n): the columns of each class, parts or a prefix, once for each task that meets the class."""
    least = _least_linked(percent)
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names, kinds = ["place", "high", "token", "hi", "lo", "n"], [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(k), set()
        levels = shared.value
        for batch in batches:
            tokens, ranks, his, los, sizes, many = [], [], [], [], [], []
            for s in shingler.sets(batch.column(0)):
                if len(s) < least:
                    continue
                key = digest(s)
                if key in seen:
                    continue
                seen.add(key)
                found = parts(s, percent) if percent >= PARTS_FROM else s
                level = levels[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]
                if percent < PARTS_FROM:
                    first = np.argsort(level, kind="stable")[: prefix_length(len(s), percent)]
                    found, level = found[first], level[first]
                tokens.append(found)
                ranks.append(level)
                his.append(key[0])
                los.append(key[1])
                sizes.append(len(s))
                many.append(len(found))
            flat = np.concatenate([np.zeros(0, np.uint64), *tokens]).astype(np.int64)
            high = np.concatenate([np.zeros(0, np.uint8), *ranks]) >= HIGH_LEVEL
            his, los, sizes = (np.repeat(np.array(x, np.int64), np.array(many, np.int64)) for x in (his, los, sizes))
            place = np.where(high, flat ^ (his & (SALTS - 1)), flat)
            yield _batch([place, high, flat, his, los, sizes], kinds, names)

    return docs.select("text").mapInArrow(run, "place long, high boolean, token long, hi long, lo long, n int")


def _column_pairs(token: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of all pairs within the columns of sorted tokens whose sizes allow a link."""
    at, apart = np.arange(len(token)), 1
    while len(at := at[at + apart < len(token)]) and len(at := at[token[at] == token[at + apart]]):
        a, b = n[at], n[at + apart]
        fit = at[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
        yield fit, fit + apart
        apart += 1


def _met(columns: DataFrame, percent: int) -> DataFrame:
    """The first product, column by column: rows (token, hi, lo, n) of high columns, and with a null token the pairs of low ones."""
    names = ["token", "hi", "lo", "n", "hi2", "lo2", "n2"]
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()]
    block = 1 << 18

    def found(token, high, hi, lo, n) -> Iterator[pa.RecordBatch]:
        """Whole columns, each at most HIGH rows or high."""
        rows = high.nonzero()[0]
        if len(rows):
            none = pa.nulls(len(rows), pa.int64())
            yield _batch([token[rows], hi[rows], lo[rows], n[rows], none, none, none.cast(pa.int32())], kinds, names)
        token, hi, lo, n = (x[~high] for x in (token, hi, lo, n))
        for i, j in _column_pairs(token, n, percent):
            if len(i):
                yield _batch([pa.nulls(len(i), pa.int64()), hi[i], lo[i], n[i], hi[j], lo[j], n[j]], kinds, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kept: list[np.ndarray] | None = None  # rows of a column that may go on
        going = last = None  # the column that is high and goes on, and its last class

        def process(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, going, last
            new = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(1, 6)]
            high, token, hi, lo, n = [np.concatenate(x) for x in zip(kept, new)] if kept else new
            same = np.zeros(len(token), bool)
            same[1:] = (token[1:] == token[:-1]) & (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
            if going is not None and len(token) and (token[0], hi[0], lo[0]) == (going, *last):
                same[0] = True
            high, token, hi, lo, n = (x[~same] for x in (high, token, hi, lo, n))
            kept = None
            if not len(token):
                return
            starts = np.concatenate([[0], (token[1:] != token[:-1]).nonzero()[0] + 1])
            heights = np.diff(np.append(starts, len(token)))
            over = heights > HIGH
            if going is not None and token[0] == going:
                over[0] = True
            high = high | np.repeat(over, heights)
            going = None
            if not end:
                if high[-1]:
                    going, last = token[-1], (hi[-1], lo[-1])
                else:
                    cut = starts[-1]
                    kept = [x[cut:] for x in (high, token, hi, lo, n)]
                    high, token, hi, lo, n = (x[:cut] for x in (high, token, hi, lo, n))
            yield from found(token, high, hi, lo, n)

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                yield from process(False)
                held, rows = [], 0
        if held or kept:
            held = held or [pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32())], ["place", "high", "token", "hi", "lo", "n"])]
            yield from process(True)

    dealt = columns.repartition("place").sortWithinPartitions("token", "hi", "lo")
    return dealt.mapInArrow(run, "token long, hi long, lo long, n int, hi2 long, lo2 long, n2 int")


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes allow a link."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _near(percent: int) -> Column:
    """Whether sizes n, n2 and signatures s, t allow a link."""
    bits = " + ".join(f"bit_count(s{k} ^ t{k})" for k in range(len(SIGNATURE)))
    return F.expr(f"{100 + percent} * ({bits}) <= {100 - percent} * (n + n2)")


def _candidates(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of nodes that counts, sizes and signatures leave, without those of high columns that pivots do not meet."""
    pair = ["hi", "lo", "n", "hi2", "lo2", "n2"]
    low = met.filter("token is null").select(*pair)
    high = met.filter("token is not null").select("token", "hi", "lo", "n")
    # Of near copies, those with the fewest changes share most of their columns: they are the best pivots.
    central = high.groupBy("hi", "lo", "n").agg(F.count("*").alias("met"))
    central = central.select("hi", "lo", F.expr(f"cast(1000 * met / (n - ceil({percent} * n / 100) + {MEET}) as int)").alias("central"))
    marked = high.join(central, ["hi", "lo"])
    pivots = marked.groupBy("token").agg(F.count("*").alias("height"), F.min(F.struct("hi", "lo", "n")).alias("first"), F.max(F.struct("central", "hi", "lo", "n")).alias("best")).filter("height > 1")
    pivots = pivots.select("token", "height", F.array_distinct(F.array("first", F.struct("best.hi", "best.lo", "best.n"))).alias("pivots"))
    stars = looked_up(high, pivots, ["token"], "height", "inner").select("hi", "lo", "n", F.explode("pivots").alias("p")).select("hi", "lo", "n", F.col("p.hi").alias("hi2"), F.col("p.lo").alias("lo2"), F.col("p.n").alias("n2"))
    stars = stars.filter("hi <> hi2 or lo <> lo2").filter(_alike("n", "n2", percent))
    ordered = "hi < hi2 or (hi = hi2 and lo < lo2)"
    stars = stars.selectExpr(*(f"if({ordered}, {a}, {b}) AS {a}" for a, b in zip(pair, pair[3:] + pair[:3])))
    counted = low.union(stars).groupBy(*pair).agg(F.count("*").alias("shared"))
    meet = 1 if percent >= PARTS_FROM else MEET
    pairs = written(counted.filter(f"shared >= least({meet}, ceil({percent} * greatest(n, n2) / 100))").drop("shared"), "pairs")
    mine = classes.select("hi", "lo", F.col("node").alias("u"), *SIGNATURE)
    theirs = classes.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("node").alias("v"), *(F.col(f"s{k}").alias(f"t{k}") for k in range(len(SIGNATURE))))
    one = written(met_often(pairs, mine, ["hi", "lo"]).drop("hi", "lo"), "pairs-1")
    found = written(met_often(one, theirs, ["hi2", "lo2"]).filter(_near(percent)).select("u", "v"), "candidates")
    forget(pairs, one)
    return found


def _across(met: DataFrame, classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(u, v): of the classes of a high column that are in different groups, for two groups in a block, a pair whose sizes and signatures allow a link."""
    mine = classes.join(groups, "node", "left").select("hi", "lo", "node", F.coalesce("component", "node").alias("label"), *SIGNATURE)
    rows = written(met.filter("token is not null").select("token", "hi", "lo", "n").join(mine.select("hi", "lo", "node", "label"), ["hi", "lo"]).select("token", "node", "label", "n"), "high")
    # The group with most classes of a column is at home there; its classes need not meet.
    homes = rows.groupBy("token", "label").agg(F.count("*").alias("many")).groupBy("token").agg(F.sum("many").alias("height"), F.max(F.struct("many", "label")).alias("home")).filter("height > home.many")
    homes = homes.select("token", "height", F.col("home.label").alias("home"), F.expr(f"cast(ceil((height - home.many) / {BLOCK_ROWS}) as int)").alias("aways"), F.expr(f"cast(ceil(home.many / {BLOCK_ROWS}) as int)").alias("rest"))
    mixed = looked_up(rows, homes, ["token"], "height", "inner").withColumn("away", F.col("label") != F.col("home"))
    mixed = mixed.withColumn("at", F.expr("cast(pmod(xxhash64(node), if(away, aways, rest)) as int) + if(away, 0, aways)"))
    mixed = mixed.join(mine.select("node", *SIGNATURE), "node")
    meets = F.expr("transform(sequence(0, if(away, aways + rest, aways) - 1), x -> struct(least(x, at) AS i, greatest(x, at) AS j))")
    dealt = mixed.withColumn("block", F.explode(meets)).select("token", "block.i", "block.j", F.expr("at = block.i").alias("first"), F.expr("at = block.j").alias("second"), "node", "label", "n", *SIGNATURE)
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def meet(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        first, second = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second"))
        node, label, n = (batch.column(c).to_numpy() for c in ("node", "label", "n"))
        signs = np.stack([batch.column(c).to_numpy() for c in SIGNATURE], 1).view(np.uint64)
        a, b = first.nonzero()[0], second.nonzero()[0]
        bits = np.zeros((len(a), len(b)), np.int32)
        for k in range(len(SIGNATURE)):
            bits += np.bitwise_count(signs[a, k][:, None] ^ signs[b, k][None, :])
        x, y = n[a].astype(np.int64)[:, None], n[b].astype(np.int64)[None, :]
        fits = (label[a][:, None] != label[b][None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & ((100 + percent) * bits <= (100 - percent) * (x + y))
        p, q = fits.nonzero()
        p, q = a[p], b[q]
        _, one = np.unique(np.stack([np.minimum(label[p], label[q]), np.maximum(label[p], label[q])], 1), axis=0, return_index=True)
        return node[p[one]], node[q[one]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches, ("token", "i", "j")):
            yield _batch(list(meet(rows)), [pa.int64()] * 2, ["u", "v"])

    return written(dealt.mapInArrow(run, "u long, v long").distinct(), "across")


def _units(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows that agree in ``keys``, from batches sorted by them, one batch for each key."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    key = lambda batch, row: tuple(batch.column(k)[row].as_py() for k in keys)
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield whole()
            held = []
        cuts = [0, *new.nonzero()[0].tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """The product of the incidence matrix of the sets ``a`` with that of ``b`` (None: of ``a``), accumulated over blocks of columns; what a set has alone is left out, so the diagonal says nothing."""
    sets = a if b is None else a + b
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]])[: len(flat)])
    shared = np.bincount(column, minlength=1) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    width, many = max(256, CELLS // max(1, len(sets))), int(shared.sum())
    total = np.zeros((len(a), len(a if b is None else b)), np.int64)
    for start in range(0, many, width):
        x, y = np.searchsorted(column, [start, start + width])
        dense = np.zeros((len(sets), min(width, many - start)), np.float32)
        dense[owner[x:y], column[x:y] - start] = 1
        total += np.rint(dense[: len(a)] @ (dense if b is None else dense[len(a) :]).T).astype(np.int64)
    return total


def _linked(unit: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, label): links of each class of a block with the other block, and the least node that links within it reach."""
    _, unique = np.unique(unit.column("node").to_numpy(), return_index=True)
    unit = unit.take(pa.array(unique))
    node, copies = unit.column("node").to_numpy(), unit.column("copies").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in unit.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    at, i, j = unit.column("at").to_numpy(), unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
    a = (at == i).nonzero()[0]
    b = a if i == j else (at == j).nonzero()[0]
    total = overlaps([sets[x] for x in a], None if i == j else [sets[x] for x in b])
    links = 100 * total >= percent * (sizes[a][:, None] + sizes[b][None, :] - total)
    if i == j:
        np.fill_diagonal(links, False)
    label, most = node.copy(), np.iinfo(np.int64).max
    while len(a) and len(b):
        before = label.copy()
        label[a] = np.minimum(label[a], np.where(links, label[b][None, :], most).min(1))
        label[b] = np.minimum(label[b], np.where(links, label[a][:, None], most).min(0))
        if (label == before).all():
            break
    many = np.zeros(len(node), np.int64)
    many[a] += (links * copies[b][None, :]).sum(1)
    if i != j:
        many[b] += (links * copies[a][:, None]).sum(0)
    return node, many, label


def _bit_filter(ids: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap over hashes of (doc_id, h); at most FILTER_BITS / 32768 rows of 4 KB."""
    h = F.pmod(F.xxhash64("doc_id", "h"), F.lit(FILTER_BITS)) + 1
    return ids.select(h.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))


def _probed(docs: DataFrame, bits: DataFrame, id_col: str, h_col: str) -> DataFrame:
    """``docs`` with ``__inside``: whether a row may be in the filter."""
    h = F.pmod(F.xxhash64(id_col, h_col), F.lit(FILTER_BITS)) + 1
    bits = F.broadcast(bits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    probed = docs.withColumns({"__bucket": F.bitmap_bucket_number(h), "__bit": F.bitmap_bit_position(h)}).join(bits, "__bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    inside = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0, F.lit(False))
    return probed.withColumn("__inside", inside).drop("__bucket", "__bits", "__bit")


def _links(docs: DataFrame, classes: DataFrame, groups: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, links, label): the second product, one row for each block that a class of a candidate group is in."""
    members = written(classes.join(groups, "node").select("node", "hi", "lo", "n", "copies", "doc_id", "h", "component"), "members")
    blocks = members.groupBy("component").agg(F.count("*").alias("many"), F.sum("n").alias("size"))
    blocks = blocks.select("component", "many", F.expr(f"cast(ceil(greatest(many / {BLOCK_CLASSES}, size / {BLOCK_SET})) as int)").alias("blocks"))
    members = looked_up(members, blocks, ["component"], "many", "inner").withColumn("at", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    members = written(members.withColumnsRenamed({"doc_id": "rep", "h": "rep_h"}), "blocks")
    needed = members.select(F.col("rep").alias("doc_id"), F.col("rep_h").alias("h"))
    # One text of repeated rows; the first step of this is within each task.
    texts = _probed(docs, _bit_filter(needed), "doc_id", "h").filter("__inside").groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    joined = texts.join(members, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h")))
    joined = joined.select("node", "copies", "component", "at", "blocks", "hi", "lo", "text")
    names, kinds = ["node", "copies", "component", "at", "blocks", "shingles"], [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            sets = list(shingler.sets(batch.column("text")))
            keep = [digest(s) == (hi, lo) for s, hi, lo in zip(sets, batch.column("hi").to_pylist(), batch.column("lo").to_pylist())]  # else another text with this id
            yield _batch([*(batch.column(c) for c in names[:5]), [s.tobytes() for s in sets]], kinds, names).filter(pa.array(keep, pa.bool_()))

    sets = joined.mapInArrow(shingled, "node long, copies long, component long, at int, blocks int, shingles binary")
    meets = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, at) AS i, greatest(x, at) AS j))")
    dealt = sets.withColumn("block", F.explode(meets)).select("component", "block.i", "block.j", "at", "node", "copies", "shingles")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, ("component", "i", "j")):
            yield _batch(list(_linked(unit, percent)), [pa.int64()] * 3, ["node", "links", "label"])

    return written(dealt.mapInArrow(run, "node long, links long, label long"), "links")


def _joined(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n, hi, lo), n = 0 without shingles, and classes (hi, lo, node, copies, n_links, component, of), where of = (no, id, h) is the class's first row."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    first = written(_classes_and_counts(docs, k, percent), "classes")
    rows = first.filter("kind = 0").select("doc_id", "h", "n", "hi", "lo", *SIGNATURE)
    levels = _levels(first.filter("kind = 1"))
    same = (F.max(c).alias(c) for c in ("n", *SIGNATURE))  # equal in all rows of a class
    of = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "h")).alias("of")
    reps = rows.filter("n > 0").groupBy("hi", "lo").agg(F.count("*").alias("copies"), of, *same)
    reps = written(reps.withColumns({"node": F.monotonically_increasing_id(), "doc_id": F.col("of.id"), "h": F.col("of.h")}), "reps")

    met = written(_met(_columns(docs, k, percent, levels), percent), "met")
    edges = _candidates(met, reps, percent)
    groups = components(edges, "u", "v")
    across = _across(met, reps, groups, percent)
    if not across.isEmpty():
        groups = components(edges.union(across), "u", "v")
    forget(met)
    linked = _links(docs, reps, groups, k, percent)
    named = components(linked.select("node", "label"), "node", "label")
    found = linked.groupBy("node").agg(F.sum("links").alias("links"))
    found = reps.select("hi", "lo", "node", "copies", "of").join(found, "node", "left").join(named, "node", "left")
    return rows, found.select("hi", "lo", "node", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"), "of")


def ngram_jaccard(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``.

    Rows link when the Jaccard similarity of their shingle sets is ``percent`` or more;
    component_id is the least id that links reach, n_links the number of other rows that
    the row links with. Null or empty texts and texts without words have no shingles and
    link to nothing. Repeated rows and equal sets are in one component. Null ids take part;
    the component of rows with null ids only is null. Rows that share an id but not the
    text are two. Other columns are left out.
    """
    rows, classes = _joined(_keyed(docs, id_col, text_col), k, percent)
    classes = written(classes, "joined")
    least = classes.groupBy("component").agg(F.count("*").alias("many"), F.min("of.id").alias("component_id"))
    final = looked_up(classes.select("hi", "lo", "copies", "n_links", "component"), least, ["component"], "many", "inner").drop("component")
    found = looked_up(rows.filter("n > 0").select("doc_id", "n", "hi", "lo"), final, ["hi", "lo"], "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return found.union(rows.filter("n = 0").select("doc_id", "n", "doc_id", F.lit(0).cast("long")))


def deduplicated(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of linked rows, the one with the least id (null ids last); columns unchanged.

    Rows without words all stay. Rows are told apart by id and text, so of rows that agree
    in both and differ elsewhere one stays.
    """
    rows, classes = _joined(_keyed(docs, id_col, text_col), k, percent)
    kept = classes.groupBy("component").agg(F.min("of").alias("of")).select(F.col("of.id").alias("__kept_id"), F.col("of.h").alias("__kept_h"), F.lit(True).alias("kept"))
    counted = rows.filter("n > 0").groupBy("doc_id", "h").agg(F.count("*").alias("many"))
    counted = counted.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("h") == F.col("__kept_h")), "left")
    # All rows but those that go or are repeated stay where they are; only the others, and a few that the filter mistakes for them, are dealt out.
    odd = written(counted.filter("many > 1 or kept is null").select(F.col("doc_id").alias("__odd_id"), F.col("h").alias("__odd_h"), F.expr("kept is not null").alias("__kept")), "odd")
    key = docs.withColumns({"__row_id": F.col(id_col).cast("long"), "__row_h": F.xxhash64(F.col(text_col).cast("string"))})
    worded = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(WORD)
    probed = _probed(key, _bit_filter(odd.select(F.col("__odd_id").alias("doc_id"), F.col("__odd_h").alias("h"))), "__row_id", "__row_h").withColumn("__asked", worded & F.col("__inside"))
    asked = probed.filter("__asked").join(odd, F.col("__row_id").eqNullSafe(F.col("__odd_id")) & (F.col("__row_h") == F.col("__odd_h")), "left")
    asked = asked.filter("coalesce(__kept, true)").dropDuplicates(["__row_id", "__row_h"])
    return probed.filter("not __asked").select(*docs.columns).union(asked.select(*docs.columns))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
