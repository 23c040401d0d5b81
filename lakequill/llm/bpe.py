"""BPE encoding and decoding with a contiguous rank array (operator 1).

A word is held as arrays of part boundaries, part ids and the merge ranks of
adjacent parts. The smallest rank is found by a scan of the array, its boundary is
deleted, and the two neighbouring ranks are refreshed. Words over ``LONG_WORD``
symbols take the same merges from a heap, because repeated scans of a long array
would cost the square of its length.

``Codec`` does this word by word and takes any text. ``BatchEncoder`` does the same
for all distinct words of a batch of texts at once: words of one length are the rows
of a matrix, so one scan, deletion and refresh serves them all. It takes texts of
code points whose case and composition are simple; others go to ``Codec``.
No token of these vocabularies crosses white space, so texts are cut there.
"""

from __future__ import annotations

import ctypes
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LONG_WORD = 96
NO_RANK = 1 << 60
#: Entries of one generation of a memo, and the longest key that is kept.
MEMO_ENTRIES, MEMO_KEY = 150_000, 64

#: White space as the vocabulary's patterns have it (Unicode White_Space).
SPACE = "\\t-\\r \x85\xa0  -     　"
_GAP = re.compile(f"[{SPACE}]+")
#: str.split() also cuts at these, which the patterns hold to be ordinary symbols.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in plain}, iter(range(256, 512))
    return [table.get(b) or chr(next(spare)) for b in range(256)]


class Memo(dict):
    """A memo of two generations: when the young one is full it becomes the old one."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self._make, self._entries, self._old = make, entries, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= MEMO_KEY:
            if len(self) >= self._entries:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value


class RankArrayBpe:
    """Merges of one word; symbols are those of the vocabulary, the last with its word end."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}

    def merge(self, symbols: str) -> list[int]:
        """Ids of a word given as byte symbols; '' gives none."""
        if not symbols:
            return []
        ids = [self.vocab[c] for c in symbols[:-1]]
        ids.append(self.vocab[symbols[-1] + self.suffix])
        return self._scan(ids) if len(ids) <= LONG_WORD else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        found = self.ranks.get
        none = (NO_RANK, 0)
        pairs = [found(p, none) for p in zip(ids, ids[1:])]
        ranks = [p[0] for p in pairs]
        into = [p[1] for p in pairs]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            ids[at] = into[at]
            del ids[at + 1], ranks[at], into[at]
            if at < len(ranks):
                ranks[at], into[at] = found((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1], into[at - 1] = found((ids[at - 1], ids[at]), none)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found, heap = self.ranks.get, []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < n and (hit := found((ids[left], ids[after[left]]))):
                heapq.heappush(heap, (hit[0], left, ids[left], ids[after[left]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left] if ids[left] == a else n
            if right >= n or ids[right] != b:
                continue  # stale: a part of it has been merged since
            ids[left] = found((a, b))[1]
            ids[right] = -1
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(left)
            offer(before[left])
        return [x for x in ids if x >= 0]


class Codec:
    """Encoder and decoder of one tokenizer file, given as its JSON text.

    ``words='own'`` merges words with the rank array; ``words='library'`` asks the
    tokenizers library for each distinct word. Both give the library's ids.
    """

    def __init__(self, text: str, words: str = "own"):
        spec = json.loads(text)
        self._lib = Tokenizer.from_str(text)
        self._lib.no_truncation()
        self._lib.no_padding()
        self._bpe = RankArrayBpe(spec["model"])
        self._own = words == "own"
        self._bytes = byte_symbols()
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        names = {i: s for s, i in self._bpe.vocab.items()} | {i: s for s, i in self._special.items()}
        self.size = max(names) + 1
        self._names = [names.get(i, "") for i in range(self.size)]
        self._decimals = [str(i) for i in range(self.size)]
        self._word = Memo(self._encode_word)
        self._chunk = Memo(self._encode_chunk)

    def _encode_word(self, symbols: str) -> bytes:
        return np.asarray(self._bpe.merge(symbols), "<u4").tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        """Ids of a piece without white space."""
        if self._cut is not None and "<" in chunk and len(parts := self._cut.split(chunk)) > 1:
            return b"".join(self._special[p].to_bytes(4, "little") if k % 2 else self._encode_chunk(p) for k, p in enumerate(parts) if p)
        if not self._own:
            return np.asarray(self._lib.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if chunk.isascii():
            words = _ASCII_WORD.findall(chunk.lower())
            if not chunk.isprintable():
                words = ["".join([self._bytes[b] for b in w.encode()]) for w in words]
        else:
            words = [w for w, _ in self._lib.pre_tokenizer.pre_tokenize_str(self._lib.normalizer.normalize_str(chunk))]
        return b"".join(map(self._word.__getitem__, words))

    def has_special(self, text: str) -> bool:
        return self._cut is not None and self._cut.search(text) is not None

    def encode_long(self, symbols: bytes) -> np.ndarray:
        """Ids of one word given as its UTF-8 bytes."""
        return np.frombuffer(self._word["".join([self._bytes[b] for b in symbols])], "<u4")

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        pieces = text.split() if not _NOT_SPACE.search(text) else [p for p in _GAP.split(text) if p]
        return b"".join(map(self._chunk.__getitem__, pieces))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; special tokens stay."""
        return " ".join(map(self._names.__getitem__, ids))

    def decimals(self, ids: Iterable[int]) -> str:
        return " ".join(map(self._decimals.__getitem__, ids))


#: Code points that lower() and NFC change one by one, if at all, and whose class is old.
SIMPLE = ((0x0, 0x12F), (0x131, 0x24F), (0x400, 0x45F), (0x2010, 0x2027), (0x2030, 0x205E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5))
_NOT_SIMPLE = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" if a else f"\\x00-{chr(b)}" for a, b in SIMPLE) + "]")
GAP, LETTER, DIGIT, OTHER = range(4)
#: Bytes of text that one matrix step takes, and the longest word that goes into a matrix.
GROUP_BYTES, MATRIX_WORD = 8_000_000, 48
#: Bytes of text that encode_documents() takes from a batch at once: fewer take more time, more take more memory.
SLICE_BYTES = 3_000_000


def code_point_classes() -> np.ndarray:
    """Class of each code point of SIMPLE, as the vocabulary's pattern has it."""
    table = np.full(0x10000, OTHER, np.uint8)
    for low, high in SIMPLE:
        for c in map(chr, range(low, high + 1)):
            kind = unicodedata.category(c)[0]
            table[ord(c)] = GAP if _GAP.fullmatch(c) else LETTER if kind == "L" else DIGIT if kind == "N" else OTHER
    return table


class BatchEncoder:
    """The rank array over all distinct words of a batch of texts."""

    def __init__(self, codec: Codec):
        self.codec = codec
        bpe, symbols = codec._bpe, codec._bytes
        self._plain = np.array([bpe.vocab[s] for s in symbols], np.int32)
        self._last = np.array([bpe.vocab[s + bpe.suffix] for s in symbols], np.int32)
        self._wide = max(bpe.vocab.values()) + 1
        keys = np.array([a * self._wide + b for a, b in bpe.ranks], np.int64)
        hits = np.array(list(bpe.ranks.values()), np.int32)
        order = np.argsort(keys)
        self._keys, self._rank, self._into = keys[order], hits[order, 0], hits[order, 1]
        self._none = np.int32(len(keys) + 1)
        self._classes = code_point_classes()
        self._salt = np.random.default_rng(7).integers(0, 1 << 63, (MATRIX_WORD, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        #: Where a pair of bytes is among the keys, with the second byte inside the word or at its end.
        self._first = np.stack([self._where(self._plain[:, None].repeat(256, 1), ends[None, :].repeat(256, 0)) for ends in (self._plain, self._last)])

    def _where(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair among the keys, or -1."""
        key = a.astype(np.int64) * self._wide + b
        at = np.searchsorted(self._keys, key).astype(np.int32)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, at, np.int32(-1))

    def merge(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length as rows of bytes: their ids in one array, and how many each has."""
        n, length = words.shape
        ids = self._plain[words].T.copy()
        ids[-1] = self._last[words[:, -1]]
        counts = np.full(n, length, np.int64)
        done = np.zeros((length, n), np.int32)
        rows = np.arange(n)
        spots = np.empty((length - 1, n), np.int32)
        for k in range(length - 1):
            spots[k] = self._first[int(k == length - 2)][words[:, k], words[:, k + 1]]
        ranks = np.where(spots >= 0, self._rank[spots], self._none)
        while len(rows) and len(ranks):
            at = ranks.argmin(0)
            least = ranks[at, np.arange(len(rows))]
            over = least == self._none
            if over.any():
                done[: len(ids), rows[over]] = ids[:, over]
                counts[rows[over]] = len(ids)
                on = ~over
                rows, ids, ranks, spots, at = rows[on], ids[:, on], ranks[:, on], spots[:, on], at[on]
                if not len(rows):
                    break
            col, height = np.arange(len(rows)), len(ids)
            ids[at, col] = self._into[spots[at, col]]
            step = np.arange(height - 1)[:, None] > at[None, :]  # delete the boundary: all behind it moves up
            ids = np.where(step, ids[1:], ids[:-1])
            step = step[: height - 2] | (np.arange(height - 2)[:, None] == at[None, :])
            ranks, spots = np.where(step, ranks[1:], ranks[:-1]), np.where(step, spots[1:], spots[:-1])
            for near in (at - 1, at):
                ok = np.nonzero((near >= 0) & (near < height - 2))[0]
                if len(ok):
                    p = near[ok]
                    spot = self._where(ids[p, ok], ids[p + 1, ok])
                    spots[p, ok] = spot
                    ranks[p, ok] = np.where(spot >= 0, self._rank[spot], self._none)
        if len(rows):
            done[: len(ids), rows] = ids
            counts[rows] = len(ids)
        flat = done.T[np.arange(length)[None, :] < counts[:, None]]
        return flat, counts

    def _group(self, pieces: list[bytes], want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple, lower-cased UTF-8 pieces in one array, and how many each piece has."""
        data = np.frombuffer(b" ".join([*pieces, b""]), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces])
        kind = self._classes[data]
        two = np.nonzero((data >= 0xC2) & (data < 0xE0))[0]
        kind[two] = kind[two + 1] = self._classes[(data[two].astype(np.int32) & 0x1F) << 6 | (data[two + 1] & 0x3F)]
        three = np.nonzero(data >= 0xE0)[0]
        kind[three] = kind[three + 1] = kind[three + 2] = self._classes[(data[three].astype(np.int32) & 0x0F) << 12 | (data[three + 1].astype(np.int32) & 0x3F) << 6 | (data[three + 2] & 0x3F)]
        lead = (data & 0xC0) != 0x80
        start = np.empty(len(data), bool)
        start[0], start[1:] = True, kind[1:] != kind[:-1]
        start |= (kind == DIGIT) & lead
        marks = np.nonzero((data == 0x27) & start)[0]
        for mark in marks.tolist():  # 's and the like, where an apostrophe begins a run of other symbols
            end = mark + 1 + self._clitic(data, mark)
            if end > mark + 1:
                start[mark + 1 : end] = False
                start[end] = True
        start &= kind != GAP
        words_until = np.searchsorted(np.nonzero(start)[0], ends)
        if not start.any():
            return np.zeros(0, np.uint32), np.zeros(len(pieces), np.int64)
        inside = kind != GAP
        chars = data[inside]  # every byte of it belongs to a word
        opens = np.nonzero(start[inside])[0].astype(np.int32)
        lengths = np.diff(np.append(opens, np.int32(len(chars))))
        here = np.arange(len(chars), dtype=np.int32)
        spot = np.minimum(here - np.repeat(opens, lengths), MATRIX_WORD - 1)
        spot <<= 8
        spot |= chars
        sums = np.add.reduceat(self._salt.take(spot), opens) * np.uint64(0x9E3779B97F4A7C15) ^ lengths.astype(np.uint64)
        long = lengths > MATRIX_WORD
        sums[long] = np.arange(long.sum(), dtype=np.uint64) | np.uint64(1 << 63)  # long words stand for themselves
        _, first, which = np.unique(sums, return_index=True, return_inverse=True)
        here += np.repeat(opens[first][which] - opens, lengths)
        if not np.array_equal(lengths[first][which], lengths) or not np.array_equal(chars.take(here), chars):
            # Two words of this batch have one hash: each word stands for itself.
            first = which = np.arange(len(opens))
        begins, data = opens, chars
        counts = np.zeros(len(first), np.int64)
        flats: list[np.ndarray] = []
        order: list[np.ndarray] = []
        sizes = lengths[first]
        for length in np.unique(sizes).tolist():
            rows = np.nonzero(sizes == length)[0]
            at = begins[first[rows]]
            order.append(rows)
            if length > MATRIX_WORD:
                found = [self.codec.encode_long(data[a : a + length].tobytes()) for a in at.tolist()]
                counts[rows] = [len(x) for x in found]
                flats += found
            elif length == 1:
                counts[rows] = 1
                flats.append(self._last[data[at]])
            else:
                flat, many = self.merge(data[at[:, None] + np.arange(length)[None, :]])
                counts[rows] = many
                flats.append(flat)
        per_word = counts[which]
        total = np.append(0, np.cumsum(per_word))
        per_piece = np.diff(np.append(0, total[words_until]))
        if not want_ids:
            return np.zeros(0, np.uint32), per_piece
        flat, rows = np.concatenate(flats).astype(np.uint32), np.concatenate(order)
        offset = np.empty(len(first), np.int64)
        offset[rows] = np.append(0, np.cumsum(counts[rows])[:-1])
        take = np.arange(total[-1]) + np.repeat(offset[which] - total[:-1], per_word)
        return flat[take], per_piece

    @staticmethod
    def _clitic(data: np.ndarray, mark: int) -> int:
        after = data[mark + 1 : mark + 3].tobytes()
        return 1 if after[:1] in (b"s", b"t", b"m", b"d") else 2 if after in (b"re", b"ve", b"ll") else 0

    def encode(self, texts: list[str | None], want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array (uint32), and how many each text has; null counts as ''."""
        counts = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        pieces: list[bytes] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if pieces:
                ids, many = self._group(pieces, want_ids)
                np.add.at(counts, owners, many)
                parts.append(ids)
                pieces.clear()
                owners.clear()
            held = 0

        for k, text in enumerate(texts):
            if not text:
                continue
            if ("<" in text and self.codec.has_special(text)) or (not text.isascii() and _NOT_SIMPLE.search(text)):
                flush()
                ids = np.frombuffer(self.codec.encode(text), "<u4")
                counts[k] = len(ids)
                parts.append(ids)
                continue
            for piece in in_pieces(text.lower().encode()):
                if held and held + len(piece) > GROUP_BYTES:
                    flush()
                pieces.append(piece)
                owners.append(k)
                held += len(piece)
        flush()
        return (np.concatenate(parts) if parts and want_ids else np.zeros(0, np.uint32)), counts


def in_pieces(data: bytes) -> Iterator[bytes]:
    """The text, cut at spaces into pieces of about GROUP_BYTES; all of it."""
    at = 0
    while len(data) - at > GROUP_BYTES and (cut := data.find(b" ", at + GROUP_BYTES)) >= 0:
        yield data[at:cut]
        at = cut
    yield data[at:]


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder_of(text: str) -> BatchEncoder:
    """The worker's encoder for a tokenizer file; the worker keeps the last one."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BatchEncoder(Codec(text))
    return _ENCODERS[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def in_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order, in slices of SLICE_BYTES of a string column; a longer text is a slice of its own."""
    ends, at = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Memory that is free in this process goes back to the system, also what earlier tasks of a worker have left."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc's


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of ``docs``, by the rank array.

    Null or empty texts have no ids; a null id stays null; repeated rows stay; other
    columns are left out, so their names don't matter. Texts are never cut.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encoder = encoder_of(spec.value)
        for batch in batches:
            for some in in_slices(batch, 1):
                ids, counts = encoder.encode(some.column(1).to_pylist())
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                values = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), values], ["id", "ids"])
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, f"id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(id, text string) for rows (id, ids); a null list decodes to ''."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder_of(spec.value).codec
        for batch in batches:
            texts = pa.array([codec.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(decode, f"id {kind}, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass.

    The same codec as ``encode_documents`` and ``decode_documents``, without handing the
    ids to the JVM and back. Null and empty texts: no tokens, digests of ''.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sha = encoder_of(spec.value), hashlib.sha256
        codec = encoder.codec
        for batch in batches:
            all_ids, counts = encoder.encode(batch.column(1).to_pylist())
            ids_sha, text_sha, at = [], [], 0
            for n in counts.tolist():
                ids = all_ids[at : at + n].tolist()
                at += n
                ids_sha.append(sha(codec.decimals(ids).encode()).hexdigest())
                text_sha.append(sha(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
