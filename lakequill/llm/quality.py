"""Quality rules by distribution divergence (operator 10).

One pass over the texts gives each document its base counts and two histograms: of
character classes and of common words. References are the mean distributions of each
language; a second, narrow pass takes the Jensen-Shannon distance of each document to
the reference of its language. Distances of short texts say little, so they are only
judged from a least length on, and the bound is wider the shorter the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.shared import written

#: Common words of each language; fixed values.
COMMON_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec mais on aux d son cette ou leur comme elle l nous être ont si même été".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue".split(),
}
#: A language of the table has a reference if so many of its rows are long enough; of more languages than MOST_LANGUAGES, those with most rows.
LEAST_ROWS, MOST_LANGUAGES = 5, 256
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
SLOT = {form: k for k, w in enumerate(VOCABULARY) for form in (w, w.capitalize())}
#: Character classes; every code point outside ASCII is one class, white space is none.
CLASSES = ("lower", "upper", "digit", "stop", "mark", "symbol", "control", "beyond")
SYMBOLS = re.compile("[#*$%&|<>]")
MOST_REPEATED, FEWEST_WORDS = 50, 50
#: Least lengths (code points in words; words) at which a histogram is judged, and the bounds:
#: a distance over ``base + spread / sqrt(length)`` rejects.
CHARS_LEAST, CHARS_BASE, CHARS_SPREAD = 200, 0.10, 4.0
WORDS_LEAST, WORDS_BASE, WORDS_SPREAD = 100, 0.10, 3.0


def class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("beyond"), np.int64)
    for b in range(128):
        c = chr(b)
        kind = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "stop" if c in ".,;:?'\"()-" else "mark" if c == "!" else "symbol" if 32 < b < 127 else "control"
        table[b] = CLASSES.index(kind)
    table[[9, 10, 11, 12, 13, 32]] = len(CLASSES)  # white space and, below, second bytes of a code point: left out
    table[0x80:0xC0] = len(CLASSES)
    return table


def base_counts(text: str, find=re.compile("[^\\x20\\x09-\\x0D]+").findall) -> tuple[list[str], int, int, int, int]:
    """The words, and word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = find(text)
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        marked = bytearray(len(words))
        for k, w in enumerate(windows):
            if w in twice:
                marked[k : k + 3] = b"\1\1\1"
        repeats = sum(marked)
    duplicates = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        duplicates = len(lines) - len(set(lines))
    return words, sum(map(len, words)), len(SYMBOLS.findall(text)), duplicates, repeats


def _statistics(docs: DataFrame) -> DataFrame:
    """Base counts and both histograms of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slot = class_table(), SLOT.get
        for batch in batches:
            counts: list[list[int]] = [[], [], [], [], []]
            chars, common = [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                words, *rest = base_counts(text)
                for c, v in zip(counts, (len(words), *rest)):
                    c.append(v)
                data = np.frombuffer(text.encode(), np.uint8)
                chars.append(np.bincount(table[data], minlength=len(CLASSES) + 1)[: len(CLASSES)])
                hits = [k for k in map(slot, words) if k is not None]
                common.append(np.bincount(hits, minlength=len(VOCABULARY)) if hits else np.zeros(len(VOCABULARY), np.int64))
            arrays = [pa.array([x.astype(np.int32) for x in h], pa.list_(pa.int32())) for h in (chars, common)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), *arrays, batch.column(3)], ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common", "h"])

    return docs.mapInArrow(run, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<int>, common array<int>, h long")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _distributions(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shares of character classes and of common words (the last slot: all other words), and both lengths."""
    chars, common = _matrix(batch.column("chars"), len(CLASSES)), _matrix(batch.column("common"), len(VOCABULARY))
    n_words = batch.column("n_words").to_numpy().astype(np.float64)
    n_chars = chars.sum(1)
    common = np.column_stack([common, n_words - common.sum(1)])
    return chars / np.maximum(n_chars, 1)[:, None], common / np.maximum(n_words, 1)[:, None], n_chars, n_words


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


def distances(batch: pa.RecordBatch, references: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both distances of each row to the reference of its language, and both lengths. A row without language is held against the nearest; a language without reference has none (nan)."""
    p, w, n_chars, n_words = _distributions(batch)
    lang = np.array(batch.column("lang").to_pylist(), object)
    names = sorted(references)
    by_chars = np.stack([distance(p, references[k][0]) for k in names]) if names else np.zeros((1, len(p)))
    by_words = np.stack([distance(w, references[k][1]) for k in names]) if names else np.zeros((1, len(p)))
    nearest = (by_chars + by_words).argmin(0)
    unknown = np.array([x is not None for x in lang], bool)
    for k, name in enumerate(names):
        nearest[lang == name] = k
        unknown &= lang != name
    rows = np.arange(len(p))
    one, two = by_chars[nearest, rows], by_words[nearest, rows]
    if names:
        one[unknown], two[unknown] = np.nan, np.nan
    return one, two, n_chars, n_words


def verdict(by_chars, by_words, n_chars, n_words) -> np.ndarray:
    """Whether both distances are within their bounds; texts under a least length pass, and rows without distance."""
    chars = (n_chars < CHARS_LEAST) | ~(by_chars > CHARS_BASE + CHARS_SPREAD / np.sqrt(np.maximum(n_chars, 1)))
    words = (n_words < WORDS_LEAST) | ~(by_words > WORDS_BASE + WORDS_SPREAD / np.sqrt(np.maximum(n_words, 1)))
    return chars & words


def _languages(stats: DataFrame) -> list[str]:
    """The languages that get a reference."""
    long = stats.filter((F.col("word_chars") >= CHARS_LEAST) & (F.col("n_words") >= WORDS_LEAST) & F.col("lang").isNotNull())
    counted = long.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    return sorted(r.lang for r in counted.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect())


def _references(stats: DataFrame, within: dict[str, tuple[np.ndarray, np.ndarray]] | None, languages: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean distributions of each language over all documents that are long enough and, in the second round, within bounds."""
    width = len(CLASSES) + len(VOCABULARY) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, many = np.zeros((len(languages), width)), np.zeros(len(languages))
        for batch in batches:
            p, w, n_chars, n_words = _distributions(batch)
            use = (n_chars >= CHARS_LEAST) & (n_words >= WORDS_LEAST)
            if within is not None:
                use &= verdict(*distances(batch, within))
            lang = np.array(batch.column("lang").to_pylist(), object)
            for k, name in enumerate(languages):
                rows = use & (lang == name)
                sums[k] += np.column_stack([p, w])[rows].sum(0)
                many[k] += rows.sum()
        # Sums are carried as whole numbers, so that their order does not matter.
        whole = np.round(sums * 1e9).astype(np.int64)
        names = [(languages[k], j, int(whole[k, j]), int(many[k])) for k in range(len(languages)) for j in range(width) if many[k]]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in names], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["lang", "slot", "total", "many"])

    used = stats.select("lang", "n_words", "chars", "common").filter(F.col("lang").isin(languages))
    summed = used.mapInArrow(run, "lang string, slot int, total long, many long").groupBy("lang", "slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("many").alias("many"))
    means: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages x slots numbers
        means.setdefault(r.lang, np.zeros(width))[r.slot] = float(r.total) / 1e9 / r.many
    return {k: (v[: len(CLASSES)], v[len(CLASSES) :]) for k, v in means.items()}


OUTPUT = {"doc_id": "long", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "chars_distance": "double", "words_distance": "double"}


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The columns of quality_rules(), with lang and h, a hash of the text."""
    text = F.col(text_col).cast("string")
    stats = written(_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("h"))), "statistics")
    languages = _languages(stats)
    references = _references(stats, _references(stats, None, languages), languages) if languages else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, repeats = batch.column("n_words").to_numpy(), batch.column("n_repeat_words").to_numpy()
            failed = (n_words < FEWEST_WORDS) | (100 * repeats > MOST_REPEATED * n_words)
            found = distances(batch, references)
            kept = ~failed & verdict(*found)
            columns = [batch.column(c) for c in list(OUTPUT)[:6]] + [pa.array(failed), pa.array(kept), pa.array(found[0], from_pandas=True), pa.array(found[1], from_pandas=True), batch.column("lang"), batch.column("h")]
            yield pa.RecordBatch.from_arrays(columns, [*OUTPUT, "lang", "h"])

    return stats.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in OUTPUT.items()) + ", lang string, h long")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_distance, words_distance) for every row.

    Null and empty texts have no words and fail the base rules. Rows without language are
    held against the nearest reference. For rows of a language without reference (too few
    long texts), and if there is none at all, only the base rules count, and the distances
    are null or 0. Null ids and repeated rows stay; other columns are left out.
    """
    return _judged(docs, id_col, text_col, lang_col).select(*OUTPUT)


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep; columns unchanged. Each row goes or stays by its own text and language, whatever its id."""
    gone = _judged(docs, id_col, text_col, lang_col).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.col("lang").alias("__gone_lang"), F.col("h").alias("__gone_h")).distinct()
    mine = {"__row_id": F.col(id_col).cast("long"), "__row_lang": F.col(lang_col).cast("string"), "__row_h": F.xxhash64(F.col(text_col).cast("string"))}
    same = F.col("__row_id").eqNullSafe(F.col("__gone_id")) & F.col("__row_lang").eqNullSafe(F.col("__gone_lang")) & (F.col("__row_h") == F.col("__gone_h"))
    return docs.withColumns(mine).join(gone, same, "left_anti").select(*docs.columns)
