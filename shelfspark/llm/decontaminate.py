"""Benchmark decontamination with one FM-index per training shard.

A shard is a sequence of documents of some hundred thousand words, all of which are
indexed, with a separator after each document.  Its suffix array gives the
Burrows-Wheeler transform, kept in a wavelet matrix with rank tables; all test
phrases whose words the shard has are searched backwards at once, and occurrences are
located by stepping to the next sampled suffix position.  Overlapping occurrences
merge to removal spans.

Words stand for 64-bit hashes in the index; located occurrences are confirmed by the
words themselves.  The phrases are in a file that executors map, so
the Python workers of a machine share its pages.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bound_batches, map_batches

#: Bytes to lower-cased word bytes or blanks: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Words of a test phrase.
WINDOW = 13
#: Every SAMPLE-th suffix position is stored.
SAMPLE = 8
#: Words of a shard at least, where there are so many; bytes of a long text that are split into words at once.
SHARD_WORDS, PIECE_BYTES = 1 << 17, 1 << 20
#: Benchmark text held by one pass over the documents; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text."""
    return text.translate(WORD_BYTES).split() if text else []


def pieces_of(text: bytes):
    """(number of words before, words) of consecutive pieces of a text; a piece repeats the last WINDOW - 1 words before it."""
    raw, at, before, tail = text.translate(WORD_BYTES), 0, 0, []
    while at < len(raw):
        end = raw.find(b" ", at + PIECE_BYTES) if at + PIECE_BYTES < len(raw) else -1
        end = len(raw) if end < 0 else end
        words = tail + raw[at:end].split()
        yield before, words
        tail = words[-(WINDOW - 1) :] if WINDOW > 1 else []
        before += len(words) - len(tail)
        at = end


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling from triples; only suffixes that still tie are sorted again."""
    n, base = len(text), int(text.max()) + 2
    if base**3 < 1 << 63:
        after = np.concatenate((text + 1, [0, 0]))
        first, step = (after[:n] * base + after[1 : n + 1]) * base + after[2:], 3
    else:
        first, step = text, 1
    order = np.argsort(first)
    head = np.empty(n, bool)
    head[0], head[1:] = True, first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        last = np.append(head[1:], True)
        open_ = np.nonzero(~(head & last))[0]
        if not len(open_):
            return order
        rows = order[open_]
        after = rows + step
        key = rank[rows] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        order[open_] = rows
        new = np.empty(len(rows), bool)
        new[0], new[1:] = True, key[1:] != key[:-1]
        head[open_] = new
        rank[rows] = open_[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        step *= 2


class WaveletMatrix:
    """Ranks over a sequence of integers in [0, sigma)."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate((values[~bit], values[bit]))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, high = np.zeros(len(ends), np.int64), ends.astype(np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one, ones = (symbols >> level) & 1 == 1, self.ones[k]
            low_1, high_1 = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low = np.where(one, self.zeros[k] + low_1, low - low_1)
            high = np.where(one, self.zeros[k] + high_1, high - high_1)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at some positions."""
        symbols, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.bits):
            ones = self.ones[k]
            bit = ones[at + 1] - ones[at]
            symbols = symbols * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones[at], at - ones[at])
        return symbols


class FMIndex:
    """Backward search and sampled location over a sequence of integers in [1, sigma)."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.append(text, 0)  # the end mark sorts first
        suffixes = suffix_array(text)
        self.size = len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.wavelet = WaveletMatrix(text[suffixes - 1].astype(np.int32), sigma)
        marked = (suffixes % SAMPLE == 0) | (suffixes == 0)
        self.marks = np.concatenate(([0], np.cumsum(marked))).astype(np.int64)
        self.samples = suffixes[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase (one per row of ``phrases``)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[live, column]
            low[live] = self.first[symbols] + self.wavelet.rank(symbols, low[live])
            high[live] = self.first[symbols] + self.wavelet.rank(symbols, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        rows, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        out, live = np.empty(len(rows), np.int64), np.arange(len(rows))
        while len(live):
            at = rows[live]
            found = self.marks[at + 1] > self.marks[at]
            done = live[found]
            out[done] = self.samples[self.marks[at[found]]] + steps[done]
            live = live[~found]
            symbols = self.wavelet.access(rows[live])
            rows[live] = self.first[symbols] + self.wavelet.rank(symbols, rows[live])
            steps[live] += 1
        return out


def write_phrases(items: list[tuple[str, bytes]], path: str, window: int = WINDOW) -> None:
    """Write the distinct test phrases of benchmark items: ``window`` words, or all words of a shorter item.

    The file holds a line of JSON, which names the arrays behind it, and the arrays: the sorted word hashes (``vocabulary``), the
    words of all items one after another (``stream``: places in the vocabulary; ``words`` and ``word_at``: their bytes), where
    each phrase starts and how long it is, and the items that own it.
    """
    from xxhash import xxh64_intdigest

    words = [words_of(text) for _, text in items]
    flat = [w for ws in words for w in ws]
    vocabulary, stream = np.unique(np.fromiter(map(xxh64_intdigest, flat), np.uint64, len(flat)), return_inverse=True)
    counts = np.array([len(ws) for ws in words], np.int64)
    begins = np.cumsum(counts) - counts
    spread = np.where(counts > 0, np.maximum(1, counts - window + 1), 0)
    item = np.repeat(np.arange(len(items)), spread)
    start = np.repeat(begins - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
    length = np.minimum(counts, window)[item]
    starts, lengths, owner_lists = [], [], []
    for n in np.unique(length):
        own = np.nonzero(length == n)[0]
        rows = np.ascontiguousarray(stream[start[own][:, None] + np.arange(n)].astype(np.int32))
        _, firsts, which = np.unique(rows.view(f"V{4 * n}").ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack((which, item[own]), axis=1), axis=0)
        starts.append(start[own][firsts])
        lengths.append(np.full(len(firsts), n))
        owner_lists += np.split(pairs[:, 1], np.nonzero(np.diff(pairs[:, 0]))[0] + 1)
    names = [name.encode() for name, _ in items]
    ends = lambda parts: np.cumsum([0, *map(len, parts)]).astype(np.int64)
    joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    arrays = {
        "vocabulary": vocabulary, "stream": stream.astype(np.int32), "words": np.frombuffer(b"".join(flat), np.uint8), "word_at": ends(flat),
        "starts": joined(starts).astype(np.int64), "lengths": joined(lengths).astype(np.int64), "owner_at": ends(owner_lists),
        "owners": joined(owner_lists).astype(np.int64), "names": np.frombuffer(b"".join(names), np.uint8), "name_at": ends(names),
    }
    with open(path, "wb") as out:
        head = json.dumps([[k, v.dtype.str, len(v)] for k, v in arrays.items()]).encode()
        out.write(head + b" " * (-(len(head) + 1) % 8) + b"\n")
        for v in arrays.values():
            out.write(v.tobytes() + bytes(-v.nbytes % 8))


class Phrases:
    """A mapped file of :func:`write_phrases`."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        raw, at = np.memmap(path, np.uint8, "r"), len(head)
        for name, kind, count in json.loads(head):
            size = count * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += -(-size // 8) * 8

    def item(self, k: int) -> str:
        return self.names[self.name_at[k] : self.name_at[k + 1]].tobytes().decode()

    def is_phrase(self, phrase: int, words: list[bytes]) -> bool:
        """Whether a phrase consists of these words."""
        at = int(self.starts[phrase])
        ends = self.word_at[at : at + len(words) + 1]
        return ends[-1] - ends[0] == sum(map(len, words)) and self.words[ends[0] : ends[-1]].tobytes() == b"".join(words) and np.diff(ends).tolist() == list(map(len, words))

    def find(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: number of words, occurrences as word spans, items that occur.

        Equal texts of a shard are indexed once.
        """
        found: list = [None] * len(texts)
        shard, docs, size = [], {}, 0
        for k, text in enumerate(texts):
            docs.setdefault(text or b"", []).append(k)
        for text, owners in docs.items():
            n_words, result = 0, [0, [], set()]
            for before, words in pieces_of(text):
                n_words = before + len(words)
                shard.append((before, words, result))
                size += len(words)
                if size >= SHARD_WORDS:
                    self._search(shard)
                    shard, size = [], 0
            result[0] = n_words
            for k in owners:
                found[k] = result
        self._search(shard)
        return [tuple(x) for x in found]

    def _search(self, shard: list) -> None:
        """Add what occurs in the pieces (words before, words, result) of a shard to their results."""
        from xxhash import xxh64_intdigest

        counts = np.array([len(words) for _, words, _ in shard], np.int64)
        total = int(counts.sum())
        if not total or not len(self.starts):
            return
        hashes = np.fromiter(map(xxh64_intdigest, chain.from_iterable(words for _, words, _ in shard)), np.uint64, total)
        vocabulary, symbols = np.unique(hashes, return_inverse=True)
        del hashes
        # 0 ends the text, 1 ends a document
        begins = np.cumsum(counts + 1) - counts - 1
        text = np.ones(total + len(shard), np.int64)
        text[np.arange(total) + np.repeat(np.arange(len(shard)), counts)] = symbols + 2
        place = np.minimum(np.searchsorted(vocabulary, self.vocabulary), len(vocabulary) - 1)
        stream = np.where(vocabulary[place] == self.vocabulary, place + 2, 0)[self.stream]
        missing = np.concatenate(([0], np.cumsum(stream == 0)))
        index = FMIndex(text, len(vocabulary) + 2)
        for n in np.unique(self.lengths):
            able = np.nonzero((self.lengths == n) & (missing[np.minimum(self.starts + n, len(stream))] == missing[self.starts]))[0]
            low, high = index.search(stream[self.starts[able][:, None] + np.arange(n)])
            hit = np.nonzero(high > low)[0]
            times = (high - low)[hit]
            rows = np.repeat(low[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())
            at = index.locate(rows)
            piece = np.searchsorted(begins, at, "right") - 1
            for phrase, k, begin in zip(np.repeat(able[hit], times).tolist(), piece.tolist(), (at - begins[piece]).tolist(), strict=True):
                before, words, result = shard[k]
                if self.is_phrase(phrase, words[begin : begin + n]):
                    result[1].append((before + begin, before + begin + int(n)))
                    result[2].update(self.item(i) for i in self.owners[self.owner_at[phrase] : self.owner_at[phrase + 1]])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("removal_spans", SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def find_contamination(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Add ``n_words``, ``removal_spans`` (merged word spans), ``items``, ``n_hit``, ``n_items``,
    ``items_sha256`` and ``contaminated`` to every row.

    A document is contaminated if at least one word in twenty lies in an occurrence of a test phrase.  Null
    and empty texts have no words; null benchmark texts no phrases; a null item id is named ``null``.  Repeated rows
    are judged alike, items with equal phrases or ids are all named once, texts of any length are whole, empty
    tables stay empty; an empty benchmark contaminates nothing.  The benchmark is read in blocks of about BLOCK_BYTES
    of text; each block's phrases are a mapped file of one pass, and later passes add to what earlier ones found.
    Added columns replace input columns of their names, others stay.
    """
    bound_batches(df.sparkSession)
    named = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text")
    ).filter("text is not null")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    out = df
    for block in range(blocks):
        part = named if blocks == 1 else named.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        items = [(r.item, r.text.encode()) for r in part.orderBy("item", "text").collect()]
        path = os.path.join(tempfile.mkdtemp(prefix="phrases-"), f"phrases-{uuid.uuid4().hex}")
        write_phrases(items, path)
        df.sparkSession.sparkContext.addFile(path)
        out = map_batches(out, _pass(os.path.basename(path), text_col, first=not block), FOUND)
    return (
        out.withColumn("n_hit", F.aggregate("removal_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )


def _pass(name: str, text_col: str, first: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import SparkFiles

        phrases = Phrases(SparkFiles.get(name))
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
        for batch in batches:
            found = phrases.find(as_bytes(batch, text_col))
            if not first:
                earlier = zip(batch.column("removal_spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                found = [
                    (n, spans + [(s["start"], s["end"]) for s in old], names | set(before))
                    for (n, spans, names), (old, before) in zip(found, earlier, strict=True)
                ]
            spans = [[{"start": b, "end": e} for b, e in merge_spans(f[1])] for f in found]
            columns = [[f[0] for f in found], spans, [sorted(f[2]) for f in found]]
            yield batch, [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

    return run
