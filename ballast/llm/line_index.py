"""Line dedup by a sharded minimal perfect hash over repeated lines (operator 13).

A line's key is the line stripped of white space and with A-Z in lower case. Two
64-bit hashes stand for a key: one finds its place, the other is its fingerprint.
Spark counts documents for each pair of hashes with partial counts in the tasks;
pairs found in enough documents make up the index, all others can never drop a
line. Hashes are dealt to shards of about ``SHARD_KEYS`` pairs. A task makes each
shard's minimal perfect hash: a chain of bit arrays in which every pair that is
alone at its place sets a bit and the rest goes on to the next one, so that the
rank of the bit numbers the pairs without gaps. At that number stand the
fingerprint (8 bytes), the number of documents (1 byte, held at 255) and the
smallest id (8 bytes). Shards are written to the shared folder.

Documents probe these arrays; no lines are joined. While the whole index has at
most ``DIRECT_KEYS`` pairs, which is counted first, every task loads the shards
it asks for from the shared folder. Beyond, hashes (without lines) are dealt to
tasks by shard and a hash of the document, so that each task loads few shards and
a line that a third of all documents hold is spread over many tasks. What is to
be dropped then meets the texts by document. Results are equal either way.

A line that isn't in the index is dropped by mistake if it shares place and
fingerprint with one that is: a chance of about 2**-64 for each line.

Defined results: null or empty text is one empty line. Keys shorter than
``least`` code points stay. Rows are documents; rows of one id keep the lines
that no smaller id holds. Rows without id come after all others: they lose lines
that a row with id holds, and keep lines that only rows without id hold. Very
long texts are split whole. An empty table gives an empty result. Extra columns
pass through; columns named as results are replaced.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import mixed, new_path, open_fs, unused, written

LEAST = 10
LEAST_DOCS = 2
SHARD_KEYS = 1 << 18
#: An index of so many pairs takes about 36 MB in all its shards.
DIRECT_KEYS = 1 << 21
#: Shards that a Python worker holds at a time.
HELD = 8
SALTS = 64
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    # Only A-Z change; for ASCII lines the faster function does the same.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


class PerfectHash:
    """Numbers n different pairs of 64-bit hashes from 0 to n - 1, in about four bits each."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.base = np.concatenate([[0], np.cumsum(sizes // 64)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def place(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = mixed(np.array([level + 1], np.uint64))
        return (mixed(h ^ mixed(f + salt)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(h):
            size = -(-2 * len(h) // 64) * 64
            at = cls.place(h, f, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = ~alone[at]
            h, f = h[rest], f[rest]
            if len(sizes) > 200:
                raise ValueError("pairs of hashes are repeated")
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.uint64), *words]))

    def number(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The number of each pair; for pairs that aren't in, any number or -1."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self.place(h[left], f[left], level, size)
            word, bit = self.base[level] + (at >> 6), (at & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.rank[word] + below)[hit]
            left = left[~hit]
        return out


class Shard:
    def __init__(self, row: dict):
        array = lambda name, kind: np.frombuffer(row[name], kind)
        self.hash = PerfectHash(array("sizes", np.int64), array("words", np.uint64))
        self.fingerprints, self.counts, self.firsts = array("fingerprints", np.uint64), array("counts", np.uint8), array("firsts", np.int64)

    def drops(self, h: np.ndarray, f: np.ndarray, doc: np.ndarray, no_id: np.ndarray, least_docs: int) -> np.ndarray:
        at = self.hash.number(h, f)
        known = np.flatnonzero(at >= 0)
        found = np.zeros(len(h), bool)
        i = at[known]
        found[known] = (self.fingerprints[i] == f[known]) & (self.counts[i] >= least_docs) & (no_id[known] | (self.firsts[i] != doc[known]))
        return found


_SHARD = "shard int, n long, sizes binary, words binary, fingerprints binary, counts binary, firsts binary"
_LOADED: OrderedDict[tuple[str, int], Shard | None] = OrderedDict()


def _load(path: str, shard: int) -> Shard | None:
    """A shard from the shared folder; a worker keeps the last few."""
    import pyarrow.parquet as pq
    from pyarrow import fs as files

    if (path, shard) not in _LOADED:
        fs, top = open_fs(path)
        found = fs.get_file_info(files.FileSelector(f"{top}/shard={shard}", allow_not_found=True))
        parts = [pq.read_table(x.path, filesystem=fs, partitioning=None).to_pylist() for x in found if x.path.endswith(".parquet")]
        rows = [r for p in parts for r in p]
        _LOADED[path, shard] = Shard(rows[0]) if rows else None
        while len(_LOADED) > HELD:
            _LOADED.popitem(last=False)
    _LOADED.move_to_end((path, shard))
    return _LOADED[path, shard]


def probe(path: str, shards: int, h: np.ndarray, f: np.ndarray, doc: np.ndarray, no_id: np.ndarray, least_docs: int) -> np.ndarray:
    """Which of the hashed lines of these documents are to be dropped."""
    out = np.zeros(len(h), bool)
    shard = np.mod(h, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        held = _load(path, int(shard[rows[0]]))
        if held is not None:
            out[rows] = held.drops(h[rows].view(np.uint64), f[rows].view(np.uint64), doc[rows], no_id[rows], least_docs)
    return out


def _built(groups: pa.Table) -> pa.Table:
    """The arrays of one shard from its rows (shard, h, f, n, first)."""
    t = groups.combine_chunks()
    h, f, n, first = (np.asarray(t.column(c)) for c in ("h", "f", "n", "first"))
    h, f = np.ascontiguousarray(h).view(np.uint64), np.ascontiguousarray(f).view(np.uint64)
    found = PerfectHash.of(h, f)
    at = found.number(h, f)
    fingerprints, counts, firsts = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint8), np.zeros(len(h), np.int64)
    fingerprints[at], counts[at], firsts[at] = f, np.minimum(n, 255), first
    row = {"shard": t.column("shard")[0].as_py(), "n": len(h), "sizes": found.sizes.tobytes(), "words": found.words.tobytes(), "fingerprints": fingerprints.tobytes(), "counts": counts.tobytes(), "firsts": firsts.tobytes()}
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(row.items(), kinds)})


def index_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[str, int, int]:
    """(path, shards, pairs) of the index over lines found in at least ``least_docs`` documents."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: F.length(k) >= least))
    h, f = hashes(F.col("key"))
    each = docs.select(F.col(id_col).cast("long").alias("doc"), F.explode(keys).alias("key")).select("doc", h.alias("h"), f.alias("f"))
    counts = each.groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.count("doc").alias("ids"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeated = written(counts.filter((F.col("n") >= least_docs) & ((F.col("first") < F.col("last")) | (F.col("ids") > 0) & (F.col("ids") < F.col("n")))).select("h", "f", "n", "first"), "lines")
    pairs = repeated.count()
    shards = max(1, -(-pairs // shard_keys))
    path = new_path(docs.sparkSession, "line-index")
    # Hashes are even, so a shard has about ``shard_keys`` rows whatever the lines are.
    repeated.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_built, _SHARD).write.partitionBy("shard").parquet(path)
    return path, shards, pairs


def _direct(docs: DataFrame, id_col: str, text: str, into: str, path: str, shards: int, least: int, least_docs: int) -> DataFrame:
    """Each document with flags for its lines; tasks load the shards they need."""

    @F.arrow_udf("array<boolean>")
    def flags(h: pa.Array, f: pa.Array, doc: pa.Array) -> pa.Array:
        sizes = np.asarray(h.value_lengths())
        ids = np.repeat(np.asarray(doc.fill_null(0)), sizes)
        no_id = np.repeat(np.asarray(doc.is_null()), sizes)
        flat_h, flat_f = h.flatten(), f.flatten()
        long_ = np.flatnonzero(np.asarray(flat_h.is_valid()))
        found = np.zeros(len(flat_h), bool)
        a, b = (np.asarray(x.fill_null(0))[long_] for x in (flat_h, flat_f))
        found[long_] = probe(path, shards, a, b, ids[long_], no_id[long_], least_docs)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(found))

    keys = F.transform(lines_of(F.col(text)), line_key)
    pick = lambda k: F.transform(keys, lambda x: F.when(F.length(x) >= least, hashes(x)[k]))
    return docs.withColumn(into, flags(pick(0), pick(1), F.col(id_col).cast("long")))


def _routed(docs: DataFrame, id_col: str, text: str, into: str, path: str, shards: int, least: int, least_docs: int) -> DataFrame:
    """The same flags; hashes of lines are dealt to tasks by shard and document, and what is to be dropped comes back by document."""
    a, b, no_id = unused([*docs.columns, into, "_lines"], "_a", "_b", "_no_id")
    t, i = F.coalesce(F.col(text), F.lit("")), F.col(id_col).cast("long")
    named = docs.withColumns({a: F.xxhash64(i, t), b: F.xxhash64(F.lit(2), i.isNull(), i, t)})
    h, f = hashes(F.col("key"))
    keys = F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: F.length(k) >= least)
    lines = named.select(F.col(a).alias("a"), F.col(b).alias("b"), i.alias("doc"), F.explode(F.array_distinct(keys)).alias("key")).select("a", "b", "doc", h.alias("h"), f.alias("f"))
    dealt = lines.withColumns({"shard": F.pmod("h", F.lit(shards)), "salt": F.pmod("b", F.lit(SALTS))}).repartition("shard", "salt").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            h, f = np.asarray(x.column(3)), np.asarray(x.column(4))
            hit = probe(path, shards, h, f, np.asarray(x.column(2).fill_null(0)), np.asarray(x.column(2).is_null()), least_docs)
            yield x.filter(pa.array(hit)).select([0, 1, 3, 4])

    gone = dealt.select("a", "b", "doc", "h", "f").mapInArrow(run, "a long, b long, h long, f long")
    lists = gone.groupBy(F.col("a").alias("_of_a"), F.col("b").alias("_of_b")).agg(F.collect_set(F.struct("h", "f")).alias("_lines"))  # no more than a document's lines
    joined = named.join(lists, (F.col(a) == F.col("_of_a")) & (F.col(b) == F.col("_of_b")), "left")
    all_keys = F.transform(lines_of(F.col(text)), line_key)
    gone_ = lambda k: F.coalesce((F.length(k) >= least) & F.array_contains("_lines", F.struct(hashes(k)[0].alias("h"), hashes(k)[1].alias("f"))), F.lit(False))
    return joined.withColumn(into, F.transform(all_keys, gone_)).select(*docs.columns, into)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS, direct_keys: int = DIRECT_KEYS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``: lines found in ``least_docs`` documents (2 to 255) stay in that with the smallest id alone."""
    if not 2 <= least_docs <= 255:
        raise ValueError("least_docs must be from 2 to 255: the index holds counts in a byte")
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    (flags,) = unused([*docs.columns, "n_lines", "n_dropped", "kept_text"], "_flags")
    path, shards, pairs = index_lines(docs, id_col, text, least, least_docs, shard_keys)
    found = (_direct if pairs <= direct_keys else _routed)(docs, id_col, text, flags, path, shards, least, least_docs)
    kept = F.filter(lines_of(F.col(text)), lambda _, i: ~F.get(F.col(flags), i))
    return found.select(
        *docs.columns,
        F.size(flags).cast("long").alias("n_lines"),
        F.size(F.filter(flags, lambda x: x)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS MATERIALIZED (SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM d, unnest(range(1, len(ls) + 1)) x(i)),
k AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCS} AND count(doc_id) > 0),
g AS (SELECT l.*, coalesce(k.key IS NOT NULL AND (doc_id IS NULL OR doc_id <> first), false) AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY r"""


def brute_force(rows: list[tuple[int | None, str | None]], least: int = LEAST, least_docs: int = LEAST_DOCS) -> list[tuple]:
    """The same result for a few documents, by a map of all keys (for tests)."""
    lower = str.maketrans(UPPER, LOWER)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(SPACE).translate(lower)
    holders: dict[str, list] = {}
    for i, lines in split:
        for k in {key(x) for x in lines}:
            holders.setdefault(k, []).append(i)
    out = []
    for i, lines in split:
        kept = []
        for x in lines:
            held = holders[key(x)]
            ids = [j for j in held if j is not None]
            if not (len(key(x)) >= least and len(held) >= least_docs and ids and (i is None or i != min(ids))):
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
