"""Benchmark decontamination with an FM-index for each training shard (operator 5).

A shard is a batch of documents. Its words are numbered by the vocabulary of the
test phrases; every other word can't be part of an occurrence, so runs of known
words shorter than the shortest phrase are left out, and the rest is joined by
separators. Over that text stand a suffix array (prefix doubling), the
Burrows-Wheeler transform, a wavelet tree (levelwise, with prefix counts) and
every ``SAMPLE``-th suffix position. All phrases are searched backwards at once;
occurrences are located by walking to sampled positions and merged into spans.

The phrases are written to the shared folder in blocks of bounded size, and a
task goes through them block by block, so the test set may be of any size and
never passes through the driver. A task holds up to ``HELD_BYTES`` of text as
word numbers and takes a block once for all shards held, not once for each.

Defined results: null or wordless text has no hits. Items without words have no
window; items with a null id are left out; an item id that occurs more than once
has the windows of all its rows. Repeated documents get equal rows. An empty
benchmark contaminates nothing, an empty table gives an empty result. Very long
texts are shards of their own. Extra columns pass through; columns named as
results are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import new_path, open_fs

WORDS = 10
SAMPLE = 8
BLOCK_BYTES = 8 << 20
HELD_BYTES = 64 << 20

#: Bytes to lower-cased word bytes, or to a space: digits, letters and all bytes of non-ASCII characters are words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(FOLD).split()


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be smaller than all others."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, k = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= 2 * n:
            return order


class WaveletTree:
    """Ranks of any symbol in any prefix, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.ones, self.zeros = [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start, end = np.zeros(len(symbol), np.int64), at.astype(np.int64)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            s1, e1 = self.ones[k][start], self.ones[k][end]
            start = np.where(one, self.zeros[k] + s1, start - s1)
            end = np.where(one, self.zeros[k] + e1, end - e1)
        return end - start


class FMIndex:
    """Index of a symbol array (values from 1); 0 is put at its end."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.concatenate([np.asarray(symbols, np.int64), [0]])
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.tree = WaveletTree(self.bwt)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.sampled = order % sample == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the phrases (rows padded at the left), searched backwards all at once."""
        n, width = phrases.shape
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        live = np.arange(n)
        for step in range(width):
            live = live[(high[live] > low[live])]
            now = live[lengths[live] > step]
            if not len(now):
                break
            c = phrases[now, width - 1 - step]
            known = c < len(self.first) - 1
            c0 = np.where(known, c, 0)
            at = self.first[c0]
            low[now] = np.where(known, at + self.tree.rank(c0, low[now]), 0)
            high[now] = np.where(known, at + self.tree.rank(c0, high[now]), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to sampled ones."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.sampled[rows[open_]]
            done = open_[hit]
            out[done] = self.positions[self.sample_rank[rows[done]]] + steps[done]
            open_ = open_[~hit]
            c = self.bwt[rows[open_]]
            rows[open_] = self.first[c] + self.tree.rank(c, rows[open_])
            steps[open_] += 1
        return out


class Held:
    """Documents as numbers of their words, shard by shard: four bytes for each word.

    Words outside a given vocabulary are -1; without one, each different word gets the next number.
    """

    def __init__(self, vocabulary: dict[bytes, int] | None = None):
        self.vocabulary = defaultdict(count().__next__) if vocabulary is None else vocabulary
        self.numbers = (lambda words: map(self.vocabulary.__getitem__, words)) if vocabulary is None else (lambda words: map(vocabulary.get, words, repeat(-1)))
        self.parts: dict[tuple[int, int], np.ndarray] = {}
        self.batches: list[pa.RecordBatch] = []
        self.counts = np.zeros(0, np.int64)
        self.bytes = 0

    def add(self, batch: pa.RecordBatch, texts: list[bytes | None]) -> None:
        words = [words_of(x) for x in texts]
        counts = np.array([len(w) for w in words], np.int64)
        first = len(self.counts)
        self.parts[first, first + len(counts)] = np.fromiter(self.numbers(chain.from_iterable(words)), np.int32, int(counts.sum()))
        self.counts = np.concatenate([self.counts, counts])
        self.batches.append(batch)
        self.bytes += sum(len(x or b"") for x in texts)


class Phrases:
    """A block of test items: their windows as number arrays, and which items each window belongs to."""

    def __init__(self, items: list[tuple[str, str]], width: int = WORDS):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text))
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(ids[i : i + width], set()).add(item)
        self.owners = list(owners.values())
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.table = np.zeros((len(owners), width), np.int64)
        for i, p in enumerate(owners):
            self.table[i, width - len(p) :] = p
        self.least = int(self.lengths.min()) if owners else 0
        self._known: tuple[Held, np.ndarray] | None = None

    def find(self, held: Held, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, phrase) of all occurrences in the shard of documents ``first`` to ``last - 1``."""
        empty = np.zeros(0, np.int64)
        counts = held.counts[first:last]
        if not self.owners or not counts.sum():
            return empty, empty, empty
        numbers = held.parts[first, last]
        ids = np.maximum(numbers, 0).astype(np.int64) if held.vocabulary is self.vocabulary else self.known_of(held)[numbers]
        of = np.repeat(np.arange(first, last), counts)
        # Runs of known words inside one document.
        start = np.ones(len(ids), bool)
        start[1:] = (ids[1:] == 0) | (ids[:-1] == 0) | (of[1:] != of[:-1])
        run = np.cumsum(start) - 1
        keep = (ids > 0) & (np.bincount(run)[run] >= self.least)
        where = np.flatnonzero(keep)
        if not len(where):
            return empty, empty, empty
        gap = np.flatnonzero(np.diff(run[where])) + 1
        text = np.insert(ids[where], gap, 1)
        back = np.insert(where, gap, -1)
        index = FMIndex(text)
        low, high = index.search(self.table, self.lengths)
        n = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        at = back[index.locate(rows)]
        return of[at], at - (np.cumsum(counts) - counts)[of[at] - first], phrase

    def known_of(self, held: Held) -> np.ndarray:
        """For each word number of ``held`` its number here, 0 for words of no phrase (and for -1)."""
        if self._known is None or self._known[0] is not held:
            get = held.vocabulary.get
            known = np.zeros(len(held.vocabulary) + 1, np.int64)
            for word, number in self.vocabulary.items():
                known[get(word, -1)] = number
            known[-1] = 0
            self._known = held, known
        return self._known[1]


def write_blocks(benchmark: DataFrame, item: str, text: str) -> tuple[str, int]:
    """The test items as Parquet files in the shared folder, one for each block of about ``BLOCK_BYTES``."""
    rows = benchmark.filter(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = new_path(benchmark.sparkSession, "phrases")
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows.repartition(blocks).write.parquet(path)
    return path, blocks


def read_blocks(path: str) -> Iterator[list[tuple[str, str]]]:
    import pyarrow.parquet as pq

    fs, top = open_fs(path)
    from pyarrow.fs import FileSelector

    for f in sorted(x.path for x in fs.get_file_info(FileSelector(top)) if x.path.endswith(".parquet")):
        with fs.open_input_file(f) as handle:
            t = pq.read_table(handle, columns=["item", "text"])
        if t.num_rows:
            yield list(zip(t.column("item").to_pylist(), t.column("text").to_pylist()))


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist())):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return spans


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WORDS, shard_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` (word positions, end exclusive), ``items`` and ``contaminated``."""
    new = ["n_words", "n_hit", "hit_spans", "items", "contaminated"]
    docs = docs.drop(*new)
    path, blocks = write_blocks(benchmark, item, item_text)
    most = shard_bytes if blocks == 1 else max(shard_bytes, HELD_BYTES)  # a single block needs no waiting
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def results(held: Held, sets: Iterable[Phrases]) -> Iterator[pa.RecordBatch]:
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for phrases in sets:
            for shard in held.parts:
                doc, first, phrase = phrases.find(held, *shard)
                order = np.argsort(doc, kind="stable")
                edges = np.flatnonzero(np.diff(doc[order])) + 1
                for rows in np.split(order, edges) if len(order) else []:
                    d = int(doc[rows[0]])
                    before = np.array(spans.get(d, []), np.int64).reshape(-1, 2)
                    spans[d] = merge_spans(np.concatenate([first[rows], before[:, 0]]), np.concatenate([first[rows] + phrases.lengths[phrase[rows]], before[:, 1]]))
                    items.setdefault(d, set()).update(*(phrases.owners[p] for p in set(phrase[rows].tolist())))
        for (low, high), b in zip(held.parts, held.batches):
            found = [spans.get(k, []) for k in range(low, high)]
            hit = [sum(e - s for s, e in x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array(held.counts[low:high], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(items.get(k, ())) for k in range(low, high)], pa.list_(pa.string())),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                ],
                names=[*names, *new],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = [Phrases(x, width) for x in read_blocks(path)] if blocks == 1 else None
        sets = lambda: one if one is not None else (Phrases(x, width) for x in read_blocks(path))
        fresh = lambda: Held(one[0].vocabulary if one and len(one) == 1 else None)
        held = fresh()
        for whole in batches:
            texts = whole.column(text).cast(pa.binary()).to_pylist()
            ends = np.cumsum([len(x or b"") for x in texts])
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + shard_bytes, side="right")))
                held.add(whole.slice(i, j - i), texts[i:j])
                i = j
                if held.bytes >= most:
                    yield from results(held, sets())
                    held = fresh()
        if held.parts:
            yield from results(held, sets())

    return docs.mapInArrow(run, f"{schema}, n_words long, n_hit long, hit_spans array<struct<start:long,end:long>>, items array<string>, contaminated boolean")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")

