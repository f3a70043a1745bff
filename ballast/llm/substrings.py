"""Exact removal of repeated byte strings by distributed prefix doubling (operator 8).

Every byte covered by a ``least``-byte string that also starts earlier goes.
Doubling over all byte positions would shuffle the corpus many times over, so
positions are sampled first: in every window of ``least`` bytes the smallest of
its ``GRAM``-byte fingerprints is its anchor (leftmost on ties), which depends on
the window's bytes alone, so equal windows have equal anchors at equal offsets.
Consecutive windows with one anchor form a stretch.

1. Offset ``GRAM``: Spark sorts stretches by the pair (rank of the anchor's
   bytes, rank of the whole stretch) and reranks: a later stretch that equals an
   earlier one goes as a whole; anchors of which all stretches are equal, or that
   are unique, drop out.
2. The remaining stretches share an anchor but differ somewhere. Their positions
   are ranked at 25 bytes, then by pairs of ranks at growing offsets (25, 50) up
   to the threshold, unique positions dropping out on the way; of positions equal
   at the threshold all but the first start a removed string. Anchors with more
   than ``GROUP`` such stretches are not gathered in one place: their positions
   are spread by the rank pair at offset 50, equal ones combined beforehand.

The first step is one sort of rank pairs at offset ``GRAM``, not a chain of
doublings over all bytes; what it leaves is doubled twice, in tasks that each hold
the stretches of some anchors (at most ``GROUP`` for each anchor).

Different texts of one id are numbered first, from hashes, so that no two of them
share a key; without such ids that costs one narrow aggregation.

Defined results: null text has no bytes; texts under ``least`` bytes lose
nothing. Documents are ordered by id, then by a hash of their text; rows without
id come first, by such a hash. Rows equal in id and text are one document and get
equal results. One id may have up to 2**25 different texts; more are an error. Long texts are cut into overlapping pieces for the work, never for
the result. An empty table gives an empty result. Extra columns pass through;
columns named as results are replaced, and columns for the work get names that
the input doesn't have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.llm.common import RollingHash, block_starts, discard, flat_bytes, mixed, row_steps, unused, written

LEAST = 100
GRAM = 36
GROUP = 2000
NO_ID = -(2**63)
_TIE = 25  # bits of the number of a text among those of its id
_BUCKETS = 4096


def _argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Offset of the leftmost smallest value in every window of ``width``, by doubling."""
    best, off, span = values, np.zeros(len(values), np.uint8), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:-step], best[step:]
        later = b < a
        best, off = np.where(later, b, a), np.where(later, off[step:] + np.uint8(step), off[:-step])
        span += step
    return off


def stretches(flat: np.ndarray, offsets: np.ndarray, least: int, gram: int, roll: RollingHash, roll2: RollingHash) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor rank, stretch rank) of all rows of a byte buffer."""
    out = []
    for i, j in row_steps(offsets, 1 << 20):
        low, high = int(offsets[i]), int(offsets[j])
        for at in range(low, max(high - (least - 1 if j == i + 1 else 0), low + 1), 1 << 20) if j == i + 1 else [low]:
            end = min(high, at + (1 << 20) + least - 1) if j == i + 1 else high
            part = flat[at:end]
            if len(part) < least:
                continue
            starts = np.maximum(offsets[i:j], at) - at
            counts = np.maximum(np.minimum(offsets[i + 1 : j + 1], end) - at - starts - least + 1, 0)
            total = int(counts.sum())
            if not total:
                continue
            sums = roll.prefix(part)
            grams = mixed(roll.of(sums, np.arange(len(part) - gram + 1), np.arange(gram, len(part) + 1)))
            off = _argmin(grams, least - gram + 1)
            row = np.repeat(np.arange(j - i), counts)
            window = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + starts[row]
            anchor = window + off[window]
            new = np.ones(total, bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, total))
            w = window[first]
            sums2 = roll2.prefix(part)
            rank = mixed(roll2.of(sums2, w, w + n + least - 1))
            out.append((row[first] + i, w + at - offsets[i + row[first]], n, grams[anchor[first]], rank))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e
    r, w, n, a, s = (np.concatenate(x) for x in zip(*out))
    return r, w, n, a.view(np.int64), s.view(np.int64)


def _names(id_col: str, text: str) -> tuple[Column, Column, Column]:
    """(document, two hashes of the text): ids from -2**62 on stand for themselves; rows without id get a number below, by their text."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = F.lit(NO_ID) + F.xxhash64(t).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(F.col(id_col).cast("long"), without), F.xxhash64(t), F.xxhash64(F.lit(1), t)


def _ties(docs: DataFrame, id_col: str, text: str) -> DataFrame | None:
    """(doc, h, g, tie): numbers from 0 for the different texts of each document key that has several; None if there are none.

    Keys are counted in buckets of hashes, so no task holds all texts of one id.
    """
    doc, h, g = _names(id_col, text)
    named = docs.select(doc.alias("doc"), h.alias("h"), g.alias("g"))
    several = named.groupBy("doc").agg(*[f(c).alias(f"{n}_{c}") for c in "hg" for n, f in (("min", F.min), ("max", F.max))])
    several = written(several.filter("min_h <> max_h OR min_g <> max_g").select("doc"), "several")
    if several.isEmpty():
        discard(several)
        return None
    texts = written(named.join(several, "doc").distinct().withColumn("bucket", F.pmod("h", F.lit(_BUCKETS))), "texts")
    starts = block_starts(texts.groupBy("doc", "bucket").agg(F.count(F.lit(1)).alias("n")), ["doc"], "bucket", "n", "start").drop("n")
    rank = F.row_number().over(Window.partitionBy("doc", "bucket").orderBy("h", "g")) - 1 + F.col("start")
    many = F.raise_error(F.lit(f"an id has more than 2**{_TIE} different texts")).cast("long")
    ties = written(texts.join(starts, ["doc", "bucket"]).select("doc", "h", "g", rank.cast("long").alias("tie")), "ties")
    discard(several, texts)
    return ties.withColumn("tie", F.when(F.col("tie") < (1 << _TIE), F.col("tie")).otherwise(many))


def _with_keys(docs: DataFrame, id_col: str, text: str, ties: DataFrame | None, into: tuple[str, str]) -> DataFrame:
    """``docs`` with the document key and the number of the text among those of its key."""
    doc, h, g = _names(id_col, text)
    docs = docs.withColumn(into[0], doc)
    if ties is None:
        return docs.withColumn(into[1], F.lit(0).cast("long"))
    own, a, b, tie = unused([*docs.columns, *into], "_own", "_a", "_b", "_number")
    found = docs.withColumns({a: h, b: g}).join(ties.toDF(own, f"{a}_", f"{b}_", tie), (F.col(into[0]) == F.col(own)) & (F.col(a) == F.col(f"{a}_")) & (F.col(b) == F.col(f"{b}_")), "left")
    return found.withColumn(into[1], F.coalesce(F.col(tie), F.lit(0))).select(*docs.columns, into[1])


def _keyed(docs: DataFrame, id_col: str, text: str, ties: DataFrame | None) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return _with_keys(narrow, "id", "text", ties, ("_doc", "_tie")).select("_doc", "_tie", "text")


def _first_of(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, document and place; in that order, whether a row equals an earlier one that stands elsewhere)."""
    order = np.lexsort((at, doc, *reversed(keys)))
    same = np.zeros(len(order), bool)
    if len(order):
        ks = [k[order] for k in keys]
        same[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in ks])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        d, a = doc[order], at[order]
        same &= (d != d[lead]) | (a != a[lead])
    return order, same


_PAIRS = "anchor long, rank long, doc long, at long"
_MATCH = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64()), ("edge", pa.bool_())])


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 38, (at >> 7) & ((1 << 31) - 1), at & 127


def _pairs(keyed: DataFrame, least: int, gram: int) -> DataFrame:
    """Rank pairs of all stretches; those that equal an earlier one of their batch are marked (``~at``) and spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, roll2 = RollingHash(11), RollingHash(23)
        for b in batches:
            flat, offsets = flat_bytes(b.column(2))
            row, w, n, a, s = stretches(flat, offsets, least, gram, roll, roll2)
            if not len(row):
                continue
            doc = np.asarray(b.column(0))[row]
            at = (np.asarray(b.column(1))[row] << 38) | (w << 7) | n
            order, gone = _first_of([a, s], doc, at)
            a, s, doc, at = a[order], s[order], doc[order], at[order]
            a = np.where(gone, mixed((at ^ doc).view(np.uint64)).view(np.int64), a)
            at = np.where(gone, ~at, at)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, s, doc, at)], names=["anchor", "rank", "doc", "at"])

    return keyed.mapInArrow(run, _PAIRS)


def _reranked(pairs: DataFrame) -> DataFrame:
    """Stretches that go as a whole, and those left with an anchor shared by different stretches (``edge``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # first row of the current rank pair: anchor, rank, doc, at
        held = None  # last representative, of which it isn't known whether another with its anchor follows

        def rows(doc, at, anchor, edge):
            tie, lo, n = _unpack(at)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, tie, lo, n, anchor, np.full(len(doc), edge))], schema=_MATCH)

        for b in batches:
            a, s, d, t = (np.asarray(c) for c in b.columns)
            known = t < 0
            if known.any():
                yield rows(d[known], ~t[known], a[known], False)
                a, s, d, t = a[~known], s[~known], d[~known], t[~known]
            if not len(a):
                continue
            if lead is not None:
                a, s, d, t = (np.concatenate([[x], y]) for x, y in zip(lead, (a, s, d, t)))
            new_a = np.ones(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            new = new_a.copy()
            new[1:] |= s[1:] != s[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            gone = ~new & ((d != d[first]) | (t != t[first]))
            if gone.any():
                yield rows(d[gone], t[gone], a[gone], False)
            reps = np.flatnonzero(new)
            before = np.zeros(len(reps), bool)
            before[0] = bool(held)  # row 0 is the held one, if there is one
            before[1:] = ~new_a[reps[1:]]
            after = np.zeros(len(reps), bool)
            after[:-1] = ~new_a[reps[1:]]
            sure = (before | after)[:-1]
            if sure.any():
                pick = reps[:-1][sure]
                yield rows(d[pick], t[pick], a[pick], True)
            k = reps[-1]
            lead, held = (a[k], s[k], d[k], t[k]), bool(before[-1])
        if lead is not None and held:
            yield rows(np.array([lead[2]]), np.array([lead[3]]), np.array([lead[0]]), True)

    return pairs.repartition("anchor").sortWithinPartitions("anchor", "rank", "doc", "at").mapInArrow(run, "doc long, tie long, lo long, n long, anchor long, edge boolean")


def ranked_equal(flat: np.ndarray, starts: np.ndarray, group: np.ndarray, least: int, roll: RollingHash) -> np.ndarray:
    """A rank at ``least`` bytes of each start (-1: unique in its group), by doubling from ``least // 4`` bytes."""
    h = least // 4
    alive = np.arange(len(starts))
    sums = roll.prefix(flat)
    positions, back = np.unique(np.concatenate([starts + k * h for k in range(4)]), return_inverse=True)
    _, rank = np.unique(mixed(roll.of(sums, positions, positions + h)), return_inverse=True)
    rank = rank.reshape(-1)
    place = [rank[back[k * len(starts) : (k + 1) * len(starts)]] for k in range(4)]
    pairs = [(place[0], place[1]), (place[2], place[3])]
    halves = []
    for x, y in pairs:  # rank pairs at offset h
        _, r = np.unique(x.astype(np.int64) * (len(positions) + 1) + y, return_inverse=True)
        halves.append(r.reshape(-1))
    out = np.full(len(starts), -1, np.int64)
    for half in halves:  # positions whose half is unique drop out
        counts = np.bincount(half[alive], minlength=len(starts) + 1)
        alive = alive[counts[half[alive]] > 1]
    if len(alive):  # rank pairs at offset 2h, in each group
        key = np.column_stack([group[alive], halves[0][alive], halves[1][alive]])
        _, r, c = np.unique(key, axis=0, return_inverse=True, return_counts=True)
        r = r.reshape(-1)
        out[alive] = np.where(c[r] > 1, r, -1)
    return out


def _edge_rows(keyed: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Each remaining stretch with its bytes, by anchor; for hot anchors its positions by their rank pair instead."""
    lists = edges.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "n", "anchor", "hot")).alias("edges"))
    joined = keyed.join(lists, (F.col("_doc") == F.col("doc")) & (F.col("_tie") == F.col("tie"))).select("_doc", "_tie", "text", "edges")
    half = least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash(31)
        schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])
        for b in batches:
            hot: list[tuple] = []
            for k in range(b.num_rows):
                doc, tie = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                data = (b.column(2)[k].as_py() or "").encode()
                e = b.column(3)[k].values.flatten()
                lo, n, anchor, is_hot = (np.asarray(x) for x in (e[0], e[1], e[2], e[3].cast(pa.int8())))
                cold = np.flatnonzero(is_hot == 0)
                if len(cold):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[cold]), pa.array(np.full(len(cold), doc)), pa.array((tie << 38) | (lo[cold] << 7) | n[cold]), pa.array([data[x : x + c + least - 1] for x, c in zip(lo[cold].tolist(), n[cold].tolist())], pa.binary())], schema=schema)
                for x, c in zip(lo[is_hot > 0].tolist(), n[is_hot > 0].tolist()):
                    piece = np.frombuffer(data[x : x + c + least - 1], np.uint8)
                    sums, p = roll.prefix(piece), np.arange(c)
                    left, right = roll.of(sums, p, p + half), roll.of(sums, p + half, p + least)
                    hot.append((mixed(mixed(left) * np.uint64(3) + right).view(np.int64), np.full(c, doc), (tie << 38) | ((x + p) << 7)))
            if hot:
                key, doc, at = (np.concatenate(x) for x in zip(*hot))
                order, gone = _first_of([key], doc, at)
                key, doc, at = key[order], doc[order], at[order]
                key = np.where(gone, mixed((at ^ doc).view(np.uint64)).view(np.int64), key)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(np.where(gone, ~at, at)), pa.nulls(len(key), pa.binary())], schema=schema)

    return joined.mapInArrow(run, "key long, doc long, at long, bytes binary")


def _edge_matches(rows: DataFrame, least: int) -> DataFrame:
    """Starts of strings that also start earlier, among the remaining stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash(41)
        lead = None

        def starts(doc, at):
            tie, lo, _ = _unpack(at)
            one = np.ones(len(doc), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, tie, lo, one, 0 * one, np.zeros(len(doc), bool))], schema=_MATCH)

        def whole(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(parts).combine_chunks()
            key, doc, at = (np.asarray(t.column(c)) for c in ("key", "doc", "at"))
            flat, offsets = flat_bytes(t.column("bytes"))
            tie, lo, n = _unpack(at)
            row = np.repeat(np.arange(len(n)), n)
            p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            _, group = np.unique(key, return_inverse=True)
            rank = ranked_equal(flat, offsets[:-1][row] + p, group.reshape(-1)[row], least, roll)
            keep = np.flatnonzero(rank >= 0)
            place = (tie[row] << 38) | ((lo[row] + p) << 7)
            order, gone = _first_of([rank[keep]], doc[row][keep], place[keep])
            pick = keep[order[gone]]
            if len(pick):
                yield starts(doc[row][pick], place[pick])

        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            bare = np.asarray(t.column("bytes").is_null())
            if bare.any():
                key, doc, at = (np.asarray(t.column(c))[bare] for c in ("key", "doc", "at"))
                known = at < 0
                if known.any():
                    yield starts(doc[known], ~at[known])
                key, doc, at = key[~known], doc[~known], at[~known]
                if len(key):
                    if lead is not None:
                        key, doc, at = (np.concatenate([[x], y]) for x, y in zip(lead, (key, doc, at)))
                    new = np.ones(len(key), bool)
                    new[1:] = key[1:] != key[:-1]
                    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
                    gone = ~new & ((doc != doc[first]) | (at != at[first]))
                    if gone.any():
                        yield starts(doc[gone], at[gone])
                    k = first[-1]
                    lead = (key[k], doc[k], at[k])
                t = t.filter(pa.array(~bare))
            if not t.num_rows:
                continue
            # All complete groups so far are worked on together; the last group may go on in the next batch.
            key = np.asarray(t.column("key"))
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                held.append(t.slice(0, cut))
                yield from whole(held)
                held = []
            elif held and held[-1].column("key")[0].as_py() != key[0]:
                yield from whole(held)
                held = []
            held.append(t.slice(cut))
        if held:
            yield from whole(held)

    return rows.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(run, "doc long, tie long, lo long, n long, anchor long, edge boolean")


def _release(spark: SparkSession) -> None:
    """Steps written out are done with: let Spark's cleaner drop their shuffle files, which it does after a collection of the driver."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` (maximal byte spans, end exclusive) and ``kept`` (the remaining bytes)."""
    if least % 4 or not 0 < gram < least or least - gram + 1 > 127:
        raise ValueError("least must be a multiple of 4, and gram from least - 126 to least - 1")
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "removed", "kept")
    doc, tie, found = unused([*docs.columns, "n_bytes", "removed", "kept"], "_doc", "_tie", "_spans")
    ties = _ties(docs, id_col, text)
    keyed = _keyed(docs, id_col, text, ties)
    matches = written(_reranked(_pairs(keyed, least, gram)), "matches")
    _release(spark)
    edges = matches.filter("edge").drop("edge")
    hot = edges.groupBy("anchor").count().filter(F.col("count") > group).select("anchor", F.lit(True).alias("hot"))
    edges = edges.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    more = written(_edge_matches(_edge_rows(keyed, edges, least), least), "edge-matches")
    _release(spark)
    spans = matches.filter("NOT edge").unionByName(more).groupBy(F.col("doc").alias(doc), F.col("tie").alias(tie)).agg(F.collect_list(F.struct("lo", (F.col("lo") + F.col("n") + (least - 1)).alias("hi"))).alias(found))
    joined = _with_keys(docs, id_col, text, ties, (doc, tie)).join(spans, [doc, tie], "left").select(*docs.columns, found)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, kept = [], [], []
            for x, s in zip(b.column(text), b.column(found)):
                data = (x.as_py() or "").encode()
                merged: list[list[int]] = []
                if s.is_valid:
                    lo, hi = (np.asarray(v) for v in s.values.flatten())
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    start = np.ones(len(lo), bool)
                    start[1:] = lo[1:] > hi[:-1]
                    first = np.flatnonzero(start)
                    merged = np.column_stack([lo[first], hi[np.append(first[1:] - 1, len(lo) - 1)]]).tolist()
                out, at = [], 0
                for a, e in merged:
                    out.append(data[at:a])
                    at = e
                out.append(data[at:])
                sizes.append(len(data))
                removed.append([{"start": a, "end": e} for a, e in merged])
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "removed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, f"{schema}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return deduplicate(docs).select("doc_id", "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], least: int = LEAST) -> dict[int, tuple[int, int, int, str]]:
    """The same result for a few documents, by one pass over all strings (for tests)."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - least + 1):
            s = data[i : i + least]
            if s in seen:
                gone[i : i + least] = True
            seen.add(s)
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[doc] = (len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out
