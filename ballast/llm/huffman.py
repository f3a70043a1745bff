"""Token ids in canonical length-limited Huffman files (operator 4).

Texts are tokenised once, into a table in the shared folder that the counts and
the files are made from. Ids are counted over the whole corpus (at most one row
for each id of the vocabulary reaches the driver), code lengths come from the package-merge
algorithm under a length limit, and codes are canonical, so the lengths alone
are the codebook. Documents are range-sorted by id; each partition becomes one
file: document table, bit offsets of every ``BLOCK`` tokens (checkpoints), and
the bits. Blocks decode independently of each other, all blocks of a stretch
side by side, one table look-up for each symbol.

A file is written under a name of its own and counts only when it is in the
manifest, which Spark commits; files of lost attempts are never read.

Defined results: null or empty text has the end id alone. Rows with the same
document id follow each other, ordered by a hash of the text, and count as
documents of their own; null ids come first. An empty table gives no file and an
empty result. Very long texts are encoded whole; a file is closed once it holds
``FILE_TOKENS``, so a task's memory is bounded by that and its longest text. Only
the id and text columns are read, so no other column can clash.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.common import discard, flat_bytes, new_path, open_fs, row_steps, written

MAGIC = b"BHUF0001"
BLOCK = 2048
LIMIT = 18
LANES = 1024
END_ID = 0
CACHE_WORDS = 300_000
FILE_TOKENS = 8 << 20

_UNSAFE = re.compile(r" [\s\x1c-\x1f\x85]")

#: How a byte-level pre-tokenizer splits a text of Latin letters (up to U+024F).
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
#: Such texts, without the control characters and spaces on which libraries differ.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]*")

#: Fixed value: printable characters stand for themselves in a byte-level vocabulary, the other bytes for those from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class _Recent(dict):
    """A bounded cache: when it is full, what was asked for since it was last full is kept for another round."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        found = self.before.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Ids of whole texts as little-endian bytes: two for each id if the vocabulary allows it, else four.

    In a byte-level vocabulary a text's ids are those of the parts that the
    pre-tokenizer splits it into. For Latin texts these parts are found here,
    and those in no cache go through the library's model. Other texts are cut at
    spaces followed by something else than white space, where the pre-tokenizer
    splits too, and pieces in no cache go through the whole library. Any other
    text or vocabulary goes through it whole. Caches are bounded. A special token
    spelled out in a text is its one id, as the library has it by default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_piece = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
        # A piece ends before a space: no added token may hold one, take one in, or ask what stands beside it.
        self.by_piece = self.by_piece and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.added = [t["content"] for t in added]
        self.by_part = self.by_piece and sys.byteorder == "little" and (spec.get("model") or {}).get("type") == "BPE" and not spec["model"].get("dropout")
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        self.parts = _Recent(self._part, CACHE_WORDS)
        self.pieces = _Recent(lambda w: self._piece(f" {w}"), CACHE_WORDS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()

    def _piece(self, text: str) -> bytes:
        if self.by_part and _PLAIN.fullmatch(text) and not any(x in text for x in self.added):
            return b"".join(map(self.parts.__getitem__, _SPLIT.findall(text)))
        return self._whole(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece or _UNSAFE.search(text) or _PLAIN.fullmatch(text):
            return self._piece(text)
        first, *rest = text.split(" ")
        return self._piece(first) + b"".join(map(self.pieces.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length of each symbol's code (0: no code), by package-merge; no code is longer than ``limit``."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        row = both[by]
        is_leaf.append(by < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(is_leaf):
        m = int(flags[:take].sum())
        lengths[:m] += 1
        take = 2 * (take - m)
    out[order] = lengths
    return out


class Code:
    """Canonical codes from code lengths, with the decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(self.lengths)
        self.bits = int(self.lengths.max()) if len(used) else 1
        order = used[np.lexsort((used, self.lengths[used]))]
        sizes = np.left_shift(1, self.bits - self.lengths[order])
        ends = np.cumsum(sizes)
        self.codes = np.zeros(len(self.lengths), np.int64)
        self.codes[order] = (ends - sizes) >> (self.bits - self.lengths[order])
        room = (1 << self.bits) - (int(ends[-1]) if len(ends) else 0)
        self.symbol = np.concatenate([np.repeat(order, sizes), np.zeros(room, np.int64)]).astype(np.uint32)
        self.length = np.concatenate([np.repeat(self.lengths[order], sizes), np.ones(room, np.int64)]).astype(np.int64)

    def pack(self, ids: np.ndarray, at: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(32-bit words, bit offset of every id, end) of ids whose first bit stands at ``at`` (under 32) in the first word."""
        n = self.lengths[ids]
        ends = at + np.cumsum(n)
        offsets = ends - n
        value = self.codes[ids].astype(np.uint64) << (64 - (offsets & 31) - n).astype(np.uint64)
        word = offsets >> 5
        size = (int(ends[-1]) >> 5) + 2 if len(ids) else 1
        # The codes' bits are disjoint, so these sums stay below 2**32 and are exact.
        high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=size)
        low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
        return (high[:size] + low[:size]).astype(np.uint64), offsets, int(ends[-1]) if len(ids) else at

    def unpack(self, words: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of blocks that begin at bits ``at`` and hold ``counts`` ids each, end to end; ``words`` has two words past the last bit."""
        at = at.astype(np.int64).copy()
        most = int(counts.max()) if len(counts) else 0
        out = np.zeros((len(at), most), np.uint32)
        shift, mask = 64 - self.bits, (1 << self.bits) - 1
        for step in range(most):
            w = at >> 5
            window = (words[w] << np.uint64(32)) | words[np.minimum(w + 1, len(words) - 1)]
            peek = ((window >> (shift - (at & 31)).astype(np.uint64)) & np.uint64(mask)).astype(np.int64)
            out[:, step] = self.symbol[peek]
            at += np.where(counts > step, self.length[peek], 0)
        return out[np.arange(most)[None, :] < counts[:, None]]


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text: str) -> DataFrame:
    """A row for each row of ``docs``: id, tie (orders rows of one id), ids with the end id; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([END_ID], enc.kind).tobytes()
        for b in batches:
            ids = [enc.encode(x) + end for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["id", "tie", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, "id long, tie long, ids binary"), "encoded")


def count_ids(rows: DataFrame, size: int, kind: str) -> np.ndarray:
    """Corpus counts of all ids; as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(flat_bytes(b.column(0))[0].view(kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    sums = rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[sums["id"].to_numpy()] = sums["n"].to_numpy()
    return counts


class _Writer:
    """One file: gathers documents' ids and gives its bytes."""

    def __init__(self, code: Code):
        self.code, self.docs, self.counts = code, [], []
        self.words: list[np.ndarray] = []
        self.checkpoints: list[np.ndarray] = []
        self.bit = self.tokens = self.word = 0
        self.open_word = 0

    def add(self, docs: list, counts: list[int], ids: np.ndarray) -> None:
        self.docs += docs
        self.counts += counts
        if not len(ids):
            return
        words, offsets, end = self.code.pack(ids, self.bit & 31)
        base = self.bit - (self.bit & 31)
        words[0] += np.uint64(self.open_word)
        self.checkpoints.append(base + offsets[(-self.tokens) % BLOCK :: BLOCK])
        whole = end >> 5
        self.words.append(words[:whole].astype(">u4"))
        self.open_word = int(words[whole])
        self.bit = base + end
        self.tokens += len(ids)

    def chunks(self) -> Iterator[bytes]:
        words = [*self.words, np.array([self.open_word, 0, 0], ">u4")]
        marks = np.concatenate(self.checkpoints) if self.checkpoints else np.zeros(0, np.int64)
        ids = pa.array(self.docs, pa.int64())
        known = np.array([x.is_valid for x in ids], np.uint8)
        yield MAGIC + struct.pack("<QQQQ", len(self.docs), self.tokens, len(marks), sum(map(len, words)))
        yield np.array(ids.fill_null(0), "<i8").tobytes() + known.tobytes()
        yield np.array(self.counts, "<i8").tobytes() + marks.astype("<i8").tobytes()
        for w in words:
            yield w.tobytes()


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Write the corpus; gives the folder and the manifest (part, seq, file, docs, tokens, bytes)."""
    spark = docs.sparkSession
    size, kind = encoder(tokenizer).size, encoder(tokenizer).kind
    rows = encoded(docs, tokenizer, id_col, text)
    lengths = code_lengths(count_ids(rows, size, kind))
    folder = new_path(spark, "ids")
    fs, top = open_fs(folder)
    fs.create_dir(top)
    with fs.open_output_stream(f"{top}/codebook") as f:
        f.write(lengths.astype("u1").tobytes())

    item = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        code, part, seq, out = Code(lengths), TaskContext.get().partitionId(), 0, None

        def close() -> pa.RecordBatch:
            name, size = f"part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}", 0
            with fs.open_output_stream(f"{top}/{name}.tmp") as f:
                for chunk in out.chunks():
                    size += len(chunk)
                    f.write(chunk)
            fs.move(f"{top}/{name}.tmp", f"{top}/{name}.huf")
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": f"{name}.huf", "docs": len(out.docs), "tokens": out.tokens, "bytes": size}])

        for b in batches:
            flat, offsets = flat_bytes(b.column(1))
            for i, j in row_steps(offsets, FILE_TOKENS * item // 4):
                out = out or _Writer(code)
                out.add(b.column(0).slice(i, j - i).to_pylist(), (np.diff(offsets[i : j + 1]) // item).tolist(), flat[offsets[i] : offsets[j]].view(kind))
                if out.tokens >= FILE_TOKENS:
                    yield close()
                    seq, out = seq + 1, None
        if out is not None:
            yield close()

    parts = rows.repartitionByRange("id").sortWithinPartitions("id", "tie").select("id", "ids")
    manifest = written(parts.mapInArrow(run, "part long, seq long, file string, docs long, tokens long, bytes long"), "ids-manifest")
    discard(rows)
    return folder, manifest


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """Documents back from the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, manifest.count())  # files, not rows
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("file", "start").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        code = None
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if code is None:
                    with fs.open_input_file(f"{top}/codebook") as f:
                        code = Code(np.frombuffer(f.read(), np.uint8))
                with fs.open_input_file(f"{top}/{name}") as f:
                    yield from _decoded(f, code, start)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _decoded(f, code: Code, start: int) -> Iterator[pa.RecordBatch]:
    """A file's documents; holds ``LANES`` blocks of ids at a time."""
    if f.read(8) != MAGIC:
        raise ValueError("not a file of this format")
    n, tokens, blocks, words = struct.unpack("<QQQQ", f.read(32))
    ids = np.frombuffer(f.read(8 * n), "<i8")
    known = np.frombuffer(f.read(n), np.uint8).astype(bool)
    counts = np.frombuffer(f.read(8 * n), "<i8")
    marks = np.frombuffer(f.read(8 * blocks), "<i8")
    data = f.tell()
    ends = np.cumsum(counts)
    crc = np.zeros(n, np.int64)
    doc = 0
    for k in range(0, blocks, LANES):
        at = marks[k : k + LANES]
        stop = int(marks[k + LANES]) if k + LANES < blocks else 32 * (words - 2)
        first = int(at[0]) >> 5
        f.seek(data + 4 * first)
        held = np.frombuffer(f.read(4 * (min((stop >> 5) + 3, words) - first)), ">u4").astype(np.uint64)
        sizes = np.minimum(BLOCK, tokens - BLOCK * np.arange(k, k + len(at)))
        got = code.unpack(held, at - 32 * first, sizes).astype("<u4")
        done = k * BLOCK
        while doc < n:
            low, high = int(ends[doc] - counts[doc]), int(ends[doc])
            crc[doc] = zlib.crc32(got[max(low - done, 0) : high - done], int(crc[doc]))
            if high > done + len(got):
                break
            doc += 1
            if high == done + len(got):
                break
    for k in range(0, n, 8192):
        s = slice(k, k + 8192)
        yield pa.RecordBatch.from_arrays([pa.array(ids[s], pa.int64(), mask=~known[s]), pa.array(start + ends[s] - counts[s], pa.int64()), pa.array(counts[s], pa.int64()), pa.array(crc[s], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(*write(docs, public_tokenizers.path("byte_bpe_50k.json")))
