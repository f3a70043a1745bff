"""Near-duplicate groups by bottom-k sketches (operator 2).

A document's set holds the hashes of its word shingles under one hash function;
its sketch is the ``SKETCH`` smallest. Equal sets form a class at once, and
classes are what is compared. Two different sets at 0.8 share at least four
shingles, so sets under four have no link. Of such a pair, at least 0.8 -
``SLACK`` of the union's 64 smallest values are shared (missing this: below
1e-9), and sets of up to 64 shingles are in their sketch whole.

1. Inverted lists: values are ordered by how many sketches hold them, rarest
   first. If two sketches share s values, ``MEET`` of these are in each one's
   first (size - s + ``MEET``) values. Only those are filed; values of one sketch
   alone take part in the order but in no list.
2. Each list compares its members to ``PIVOTS`` of them; pairs that meet at one
   pivot in ``MEET`` lists are candidates, and the links found make groups.
3. Lists of up to ``HOT`` members give the pairs of different groups that meet
   in ``MEET`` lists. This is complete but for pairs that share a list of more
   members (a hot one).
4. For the classes in hot lists that still hold different groups, the same is
   done over full sets: all their shingles are counted, and the rarest
   (size - least overlap + 1) are filed, of which a link shares one. Shingles of
   up to ``HOT`` classes give all pairs. A link without such a shingle consists
   of hot shingles: both ends have few others, which bounds what they can share.
   First, each list's member with the largest share of hot shingles is compared
   to all, and groups are joined. Then, as such ends overlap through hot shingles
   alone, an end linked with a member of a set of classes with equal hot shingles
   is linked with its smallest member too: every class is compared to one class
   for each set of hot shingles, not to all.
5. Candidates of 2 and 3 pass if the overlap within the union's sketch isn't far
   below the threshold (rejecting a link: below 1e-8), and are confirmed on the
   full sets, computed again from the texts; those of 4 are confirmed on the full
   sets at hand.

What is left to pairs is bounded by lists of ``HOT`` and, for texts made of
nothing but frequent passages, by how many different sets of these there are.
No row leaves for the size of its list: the two sizes of list have different
ways to the same links. Links make components by repeated minimum labels with
pointer jumping, each round written to the shared folder.

Defined results: null text and text without words have the empty set, which is
linked with nothing. Every row is a node, whatever its id: rows of one id (or
without id) with different texts are told apart, equal rows get equal results. A
null id is smaller than all others. Very long texts are read whole. An empty
table gives an empty result. Only the id and text columns are read, so no other
column can clash; ``keep_first`` passes all columns on as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.common import RollingHash, discard, flat_bytes, mixed, row_steps, unused, written

SKETCH = 64
SLACK = 0.35
MEET = 3
HOT = 32
PIVOTS = 3
NO_ID = -(2**63)
SALT_ROWS = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int, roll: RollingHash) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of all rows, sorted by row and hash; hashes have 63 bits."""
    n = len(offsets) - 1
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    low = _FOLD[flat]
    space = _SPACE[flat]
    edge = np.ones(len(flat), bool)
    edge[1:] = row_of[1:] != row_of[:-1]
    # One space after each word, whatever stands between words.
    after = np.zeros(len(flat), bool)
    after[1:] = space[1:] & ~space[:-1] & ~edge[1:]
    keep = ~space | after
    text = np.where(space, 32, low)[keep].astype(np.uint8)
    row_of, is_word = row_of[keep], ~space[keep]
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | (row_of[1:] != row_of[:-1])
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | (row_of[1:] != row_of[:-1])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    words = np.bincount(row_of[starts], minlength=n) if len(starts) else np.zeros(n, np.int64)
    counts = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    first = np.cumsum(words) - words
    row = np.repeat(np.arange(n), counts)
    i = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
    j = i + np.minimum(words[row], width) - 1
    h = mixed(roll.of(roll.prefix(text), starts[i], ends[j])) >> np.uint64(1)
    order = np.lexsort((h, row))
    row, h = row[order], h[order].view(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def sketches(docs: DataFrame, width: int, id_col: str, text: str) -> DataFrame:
    """A row for each row of ``docs``: doc, mark (a hash of the text), n (set size), class (null: empty set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash(5)
        for b in batches:
            flat, offsets = flat_bytes(b.column(2))
            for i, j in row_steps(offsets):
                row, h = shingle_sets(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, roll)
                n = np.bincount(row, minlength=j - i)
                begin = np.cumsum(n) - n
                spread = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))])
                name = mixed((spread[begin + n] - spread[begin]) + n.astype(np.uint64)).view(np.int64)
                short = np.arange(len(h)) - np.repeat(begin, n) < SKETCH
                kept = np.minimum(n, SKETCH)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(h[short], pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(name, pa.int64(), mask=n == 0), lists], names=["doc", "mark", "n", "class", "sketch"])

    return _keyed(docs, id_col, text).mapInArrow(run, "doc long, mark long, n long, class long, sketch array<long>")


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b): the smallest node of each component."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        new = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(new.join(up, "label").select("node", F.least("label", "up").alias("label"), "was"), "labels")
        discard(label)
        if not new.filter("label <> was").limit(1).count():
            discard(both)
            return new
        label = new


def _alike(a: str, b: str, threshold: float):
    """Sizes that allow the threshold."""
    return (F.col(a) >= threshold * F.col(b) - 1e-9) & (F.col(b) >= threshold * F.col(a) - 1e-9)


def _passes_sketch(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose overlap in the union's sketch allows the threshold."""
    a = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(a, "a").join(b, "b").filter(_alike("na", "nb", threshold))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.transform(F.array(union), lambda u: F.size(F.array_intersect(F.array_intersect(u, F.col("sa")), F.col("sb"))) / F.size(u))[0]
    return near.filter(shared >= threshold - SLACK).select("a", "b")


def _sets_of(batch_text: pa.Array, width: int, roll: RollingHash) -> list[np.ndarray]:
    flat, offsets = flat_bytes(batch_text)
    out: list[np.ndarray] = []
    for i, j in row_steps(offsets):
        row, h = shingle_sets(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, roll)
        out += np.split(h, np.cumsum(np.bincount(row, minlength=j - i))[:-1])
    return out


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs whose full sets reach the threshold; a's text goes once to each ``SALT_ROWS`` of its pairs."""
    percent = round(threshold * 100)
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("parts"))
    salted = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
    others = salted.join(texts.withColumnRenamed("class", "b"), "b").select("a", "part", "b", "text")
    heads = salted.select("a", "part").distinct().join(texts.withColumnRenamed("class", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, head, of = RollingHash(5), None, None
        for batch in batches:
            a, part, b = (batch.column(k).to_pylist() for k in range(3))
            found = []
            for k, own in enumerate(_sets_of(batch.column(3), width, roll)):
                if b[k] is None:
                    head, of = own, (a[k], part[k])
                elif of == (a[k], part[k]):
                    shared = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * shared >= percent * (len(head) + len(own) - shared):
                        found.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    rows = others.unionByName(heads).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long").distinct()


def _full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(class, hs): the hashes of all shingles, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash(5)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                sets = _sets_of(b.column(1).slice(i, 256), width, roll)
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets), pa.int64()))], names=["class", "hs"])

    return texts.select("class", "text").mapInArrow(run, "class long, hs array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full sets reach the threshold, for classes whose sets stand in a table."""
    percent = round(threshold * 100)
    a, b = (sets.select(F.col("class").alias(x), F.col("hs").alias(f"h{x}")) for x in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def _rarest_first(values: DataFrame, value: str, size, most) -> DataFrame:
    """The rows (class, value, ...) whose value is among the ``most`` rarest of its class and in other classes too; adds ``c``, its number of classes, and ``met``, how many values of its class are in others."""
    counts = values.groupBy(value).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = values.join(counts, value)
    of_class = Window.partitionBy("class")
    ranked = met.withColumns({"met": F.count(F.lit(1)).over(of_class), "_rank": F.row_number().over(of_class.orderBy("c", value))})
    return ranked.filter(size - F.col("met") + F.col("_rank") <= most).drop("_rank")


def _stars(lists: DataFrame, pivots: int, meet: int) -> DataFrame:
    """Pairs of a member and a pivot that meet in ``meet`` lists or more; each list has up to ``pivots`` of them.

    A list's pivots are the first in so many orders: class names are hashes, and each constant shuffles them anew.
    """
    orders = [int(x) for x in np.random.default_rng(pivots).integers(0, 2**63 - 1, pivots)]
    first = lists.groupBy("v").agg(*[F.min(F.col("class").bitwiseXOR(F.lit(x))).alias(f"p{k}") for k, x in enumerate(orders)])
    first = first.select("v", F.array_distinct(F.array(*[F.col(f"p{k}").bitwiseXOR(F.lit(x)) for k, x in enumerate(orders)])).alias("pivots"))
    met = lists.join(first, "v").select("class", F.explode("pivots").alias("pivot")).filter("class <> pivot").groupBy("class", "pivot").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= meet)
    return met.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct()


def _hot_links(hot: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links of different groups among the classes (class, label, n) of hot lists, by their full sets."""
    least = F.ceil(threshold * F.col("n") - 1e-9)
    full = written(_full_sets(texts.join(hot.select("class"), "class"), width), "hot-sets")
    sets = full.select("class", F.explode("hs").alias("h")).join(hot, "class")
    counts = sets.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    filed = written(_rarest_first(sets, "h", F.col("n"), F.col("n") - least + 1), "hot-filed")

    end = lambda df, x: df.select("key", F.col("class").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n{x}"))
    cold = filed.filter(F.col("c") <= HOT).withColumnRenamed("h", "key")
    open_ = cold.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("key")
    cold = cold.join(open_, "key")
    few = end(cold, "a").join(end(cold, "b"), "key").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _alike("na", "nb", threshold)).select("a", "b")

    # Classes with hot shingles enough for a link by these alone; equal sets of hot shingles have equal names.
    core = sets.join(counts.filter(F.col("c") > HOT), "h").groupBy("class").agg(F.count(F.lit(1)).alias("heat"), F.bit_xor(F.xxhash64("h")).alias("name"), F.first("n").alias("n"), F.first("label").alias("label"))
    core = written(core.filter(F.col("heat") >= least), "hot-core")
    smallest = core.groupBy("name").agg(F.min_by("class", F.struct("n", "class")).alias("class"))
    lists = filed.filter(F.col("c") > HOT).select("h", "class").join(core.select("class"), "class")
    keys = lists.groupBy("h").agg(F.min("class").alias("key"))
    lists = written(lists.join(keys, "h").select("key", "class").distinct().join(core.drop("label"), "class").join(smallest.select("class", F.lit(True).alias("chief")), "class", "left"), "hot-lists")

    def pairs(label: DataFrame, ends: DataFrame) -> DataFrame:
        """Members of a list with its ``ends``, of other groups, whose hot shingles allow a link."""
        x = lists.join(label, "class").select("key", F.col("class").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("heat").alias("hx"))
        y = ends.join(label, "class").select("key", F.col("class").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("heat").alias("hy"))
        reach = F.least("hx", "hy") * (1 + threshold) >= threshold * (F.col("nx") + F.col("ny")) - 1e-9
        return x.join(y, "key").filter((F.col("lx") != F.col("ly")) & reach & _alike("nx", "ny", threshold)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    # Each list's member with the largest share of hot shingles first, as most of the list is nearest to it.
    warm = lists.groupBy("key").agg(F.max_by(F.struct("class", "n", "heat"), F.struct(F.col("heat") / F.col("n"), "class")).alias("top")).select("key", "top.class", "top.n", "top.heat")
    near = written(_linked(few.union(pairs(core.select("class", "label"), warm)).distinct(), full, threshold), "hot-near")
    of = core.select("class", F.col("label").alias("was"))
    edges = near.join(of.withColumnRenamed("class", "a"), "a").withColumnRenamed("was", "x").join(of.withColumnRenamed("class", "b"), "b").select(F.col("x").alias("a"), F.col("was").alias("b"))
    up = components(edges)
    label = of.join(up.select(F.col("node").alias("was"), "label"), "was", "left").select("class", F.coalesce("label", "was").alias("label"))
    found = written(near.union(_linked(pairs(label, lists.filter("chief")), full, threshold)), "hot-links")
    discard(full, filed, core, lists, near, up)
    return found


def _joined(docs: DataFrame, width: int, threshold: float, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(Rows as of ``sketches``; for each class: rep, its smallest (doc, mark), label, and first, the smallest rep of its group)."""
    rows = written(sketches(docs, width, id_col, text), "sketches")
    classes = rows.filter("n > 0").groupBy("class").agg(F.min(F.struct("doc", "mark")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")

    # Different sets of this size or less can't be linked, as one shingle more or less takes them below the threshold.
    least_set = math.ceil(threshold / (1 - threshold) - 1e-9)
    meet = min(MEET, least_set)
    size = F.least("n", F.lit(SKETCH))
    shared = F.when(F.col("n") > SKETCH, F.lit(int((threshold - SLACK) * SKETCH + 1e-9))).otherwise(F.ceil(threshold * F.col("n") - 1e-9))
    values = classes.filter(F.col("n") >= least_set).select("class", "n", F.explode("sketch").alias("v"))
    filed = written(_rarest_first(values, "v", size, size - shared + meet), "filed")
    stars = _stars(filed, PIVOTS, meet)
    stars = written(_passes_sketch(stars, classes, threshold), "stars")
    # Texts of all classes that have lists, by class and once each: the one time that texts are shuffled from the whole input.
    who = filed.select("class").distinct().join(classes.select("class", "rep.doc", "rep.mark"), "class")
    texts = written(_keyed(docs, id_col, text).join(who, ["doc", "mark"]).dropDuplicates(["doc", "mark"]).select("class", "text"), "texts")
    links = written(_confirmed(stars, texts, width, threshold), "confirmed")
    label = components(links)
    lists = filed.join(label.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    open_ = lists.groupBy("v").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("v")
    lists = written(lists.join(open_, "v"), "lists")

    end = lambda x: lists.filter(F.col("c") <= HOT).select("v", F.col("class").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n{x}"))
    cold = end("a").join(end("b"), "v").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _alike("na", "nb", threshold))
    cold = cold.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= meet).select("a", "b")
    hot = written(lists.filter(F.col("c") > HOT).select("class", "label", "n").distinct(), "hot")
    hot_links = _hot_links(hot, texts, width, threshold)
    rest = written(_passes_sketch(cold, classes, threshold), "rest")
    more = written(links.union(hot_links).union(_confirmed(rest, texts, width, threshold)), "confirmed")
    discard(filed, stars, texts, links, label, lists, hot, hot_links, rest)
    label = components(more).select(F.col("node").alias("class"), "label")
    told = classes.select("class", "rep").join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    told = told.join(told.groupBy("label").agg(F.min("rep").alias("first")), "label")
    return rows, told


def group(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: doc (null id: the smallest long), n_shingles, component (smallest doc reachable)."""
    rows, told = _joined(docs, width, threshold, id_col, text)
    return rows.select("doc", "n", "class").join(told.select("class", "first.doc").withColumnRenamed("doc", "component"), "class", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))


def keep_first(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: of each group one row stays, with its smallest id.

    Rows without words are in no group and all stay.
    """
    _, told = _joined(docs, width, threshold, id_col, text)
    doc, mark = unused(docs.columns, "_doc", "_mark")
    kept = told.filter(F.col("rep") == F.col("first")).select(F.col("rep.doc").alias(doc), F.col("rep.mark").alias(mark))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.filter(worded).withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), mark: F.xxhash64(text)})
    return keyed.join(kept, [doc, mark]).dropDuplicates([doc, mark]).select(*docs.columns).unionByName(docs.filter(~worded))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    found = group(docs, width=4)
    return found.select(real("doc").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def brute_force(rows: list[tuple[int | None, str | None]], width: int = 4, percent: int = 80) -> list[tuple[int | None, int, int | None]]:
    """For each row (doc, set size, smallest doc reachable), over all pairs that share a shingle (for tests)."""
    import re

    sets: list[set] = []
    where: dict[tuple, list[int]] = {}
    for k, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
        for g in sets[-1]:
            where.setdefault(g, []).append(k)
    up = list(range(len(rows)))

    def find(d):
        while up[d] != d:
            up[d] = d = up[up[d]]
        return d

    done = set()
    for nodes in where.values():
        for i, a in enumerate(nodes):
            for b in nodes[:i]:
                if (a, b) not in done:
                    done.add((a, b))
                    k = len(sets[a] & sets[b])
                    if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                        up[find(a)] = find(b)
    first: dict[int, int] = {}
    for k, (doc, _) in enumerate(rows):
        first[find(k)] = min(first.get(find(k), 2**63), NO_ID if doc is None else doc)
    real = lambda d: None if d == NO_ID else d
    return [(doc, len(sets[k]), real(first[find(k)])) for k, (doc, _) in enumerate(rows)]
