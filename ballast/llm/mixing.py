"""Mixing sources to target weights by temperature (operator 7, DataFrame functions only).

Source token shares are raised to an exponent; a smaller exponent gives flatter
weights. The exponent is bisected until it meets a target entropy of the
weights, or else the repetition limit: the flattest weights under which no
source is repeated more than ``max_repeats`` times. Without a budget, the total
is such that the least repeated source is passed exactly once, so no document
is dropped. A source's share of the budget is realised as passes over it: in
every pass its documents stand in hash-permuted blocks, whole passes first, and
a last pass that ends once its budget of tokens is met.

Defined results: null text has no tokens; a null source is a source of its own;
sources without tokens are passed once. Repeated rows are mixed one by one (they
have one permutation key, so they stand in one block). Very long texts are
counted whole. An empty table gives an empty result. Extra columns pass through;
columns named as results are replaced, and columns for the work get names that
the input doesn't have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.common import block_starts, unused, written

MAX_REPEATS = 2.0
BLOCK_ROWS = 64
SEED = 17
DIGITS = 6


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def bisect(too_flat, low: float = 0.0, high: float = 1.0, rounds: int = 40) -> float:
    """The smallest exponent (to ``DIGITS`` digits, rounded up) for which ``too_flat`` is false; it is false at ``high``."""
    if not too_flat(low):
        return low
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return math.ceil(round(high * 10**DIGITS, 3)) / 10**DIGITS


def entropy_of(sources: DataFrame, exponent: float) -> float:
    """Entropy in bits of the weights ``share ** exponent``; one small aggregation, nothing per source comes to the driver."""
    p = F.pow(F.col("share"), F.lit(exponent))
    z, s = sources.filter("share > 0").agg(F.sum(p), F.sum(p * F.log2("share"))).first()
    return 0.0 if not z else math.log2(z) - exponent * s / z


def plan(docs: DataFrame, source: str = "source", max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """One row for each source of rows with ``n_tokens``: tokens, rows, share, weight, repeats (passes over it, with a fraction).

    The sums are written once, so that each step of a bisection reads a row for each source and no document.
    """
    sums = written(docs.groupBy(F.col(source).alias("_source")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "sources")
    total, most, least = sums.agg(F.sum("tokens"), F.max("tokens"), F.min(F.when(F.col("tokens") > 0, F.col("tokens")))).first()
    total, most, least = total or 0, most or 0, least or 0
    sources = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    if not most:
        exponent = 1.0
    elif target_entropy is not None:
        exponent = bisect(lambda a: entropy_of(sources, a) > target_entropy)
    else:
        exponent = bisect(lambda a: (most / least) ** (1 - a) > max_repeats)
    z = sources.filter("share > 0").agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0))
    if budget is None:
        repeats = F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - exponent))
    else:
        repeats = F.col("weight") * F.lit(float(budget)) / F.col("tokens")
    repeats = F.when(F.col("tokens") > 0, F.round(repeats, DIGITS)).otherwise(F.lit(1.0))
    return sources.withColumn("weight", weight).withColumn("repeats", repeats).withColumn("exponent", F.lit(exponent))


def row_values(df: DataFrame) -> list[Column]:
    """Columns whose hash tells rows apart that differ anywhere: plain values, which of them are null, and nested values as JSON.

    Hashes skip nulls and can't take maps, so (null, x) and (x, null) would be one row without the flags.
    """
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    plain = [F.col(c) for c in df.columns if c not in nested]
    flags = [F.concat(*[c.isNull().cast("int").cast("string") for c in plain])] if plain else []
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return [*plain, *flags, *[F.to_json(F.struct(c), options) for c in nested]]


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """Every pass of every document that the mixture holds, with ``n_tokens``, ``epoch``, ``block`` and ``place`` in the block.

    Places are found on narrow rows (hashes of the row, token count, a
    permutation key for each pass), written once; the texts are shuffled once,
    to meet them.
    """
    docs = docs.drop("n_tokens", "epoch", "block", "place")
    hashed = lambda *of: F.conv(F.substring(F.md5(F.concat_ws(":", *of)), 1, 15), 16, 10).cast("long")
    key_of = lambda epoch: hashed(F.lit(seed), epoch, F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    # 128 bits of the whole row stand for it: rows equal in all columns may stand in for each other.
    whole_row = row_values(docs)
    a, b = unused([*docs.columns, "n_tokens", "epoch", "block", "place"], "_a", "_b")
    names = {a: F.xxhash64(*whole_row), b: F.xxhash64(F.lit(seed), *reversed(whole_row))}

    def narrow(passes: int) -> DataFrame:
        found = docs.select(names[a].alias("_a"), names[b].alias("_b"), F.col(id_col).alias("_id"), F.col(source).alias("_src"), token_count(F.col(text)).alias("n_tokens"), F.array(*[key_of(F.lit(e)) for e in range(passes)]).alias("_keys"))
        return written(found, "mixed")

    if target_entropy is None and budget is None:  # no source is passed more often than this
        rows = narrow(max(1, math.ceil(max_repeats)))
        sources = plan(rows, "_src", max_repeats).select("_source", "tokens", "rows", "repeats")
    else:
        counted = docs.select(F.col(source).alias("_src"), token_count(F.col(text)).alias("n_tokens"))
        sources = plan(counted, "_src", max_repeats, target_entropy, budget).select("_source", "tokens", "rows", "repeats")
        rows = narrow(int(sources.agg(F.max(F.ceil("repeats"))).first()[0] or 1))
    tagged = rows.join(sources, rows["_src"].eqNullSafe(sources["_source"])).drop("_src")
    taken = tagged.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("repeats").cast("int") - 1, F.lit(0)))))
    taken = taken.withColumn("_key", F.get("_keys", F.col("epoch"))).drop("_keys")
    taken = taken.withColumn("block", F.pmod("_key", F.ceil(F.col("rows") / block_rows)))
    taken = taken.withColumn("_source", F.when(F.col("_source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("_source"))))
    keys = ["_source", "epoch"]
    blocks = taken.groupBy(*keys, "block").agg(F.sum("n_tokens").alias("_sum"))
    starts = block_starts(blocks, keys, "block", "_sum", "_start").drop("_sum")
    inside = Window.partitionBy(*keys, "block").orderBy("_key", "_id")
    placed = taken.withColumns({"place": F.row_number().over(inside), "_before": F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")})
    room = (F.col("repeats") - F.col("epoch")) * F.col("tokens")
    whole = F.col("epoch") < F.floor("repeats")
    held = placed.join(starts, [*keys, "block"]).filter(whole | (F.col("_start") + F.col("_before") < room)).select(F.col("_a").alias(a), F.col("_b").alias(b), "n_tokens", "epoch", "block", "place")
    # Repeats of a row go before the shuffle: their places are in ``held``.
    texts = docs.withColumns(names).dropDuplicates([a, b])
    return texts.join(held, [a, b]).select(*docs.columns, "n_tokens", "epoch", "block", "place")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "n_tokens", "epoch", "block", "place")


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens
  FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n FROM d GROUP BY source),
m AS (SELECT max(tokens)::DOUBLE / min(tokens) FILTER (WHERE tokens > 0) AS ratio, max(tokens)::DOUBLE AS most FROM s),
b(k, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN pow(ratio, 1 - (low + high) / 2) > {MAX_REPEATS} THEN (low + high) / 2 ELSE low END,
         CASE WHEN pow(ratio, 1 - (low + high) / 2) > {MAX_REPEATS} THEN high ELSE (low + high) / 2 END
  FROM b, m WHERE k < 40),
e AS (SELECT CASE WHEN ratio > {MAX_REPEATS} THEN ceil(round(high * 1000000, 3)) / 1000000 ELSE 0.0 END::DOUBLE AS a, most FROM b, m WHERE k = 40),
r AS (SELECT source, tokens, n, CASE WHEN tokens > 0 THEN round(pow(most / tokens, 1 - a), {DIGITS}) ELSE 1.0 END::DOUBLE AS repeats FROM s, e),
p AS (
  SELECT d.doc_id, d.source, d.n_tokens, r.tokens, r.repeats, x.epoch, ceil(r.n / {BLOCK_ROWS}.0)::BIGINT AS blocks,
         ('0x' || substr(md5('{SEED}:' || x.epoch || ':' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.t), 1, 15))::BIGINT AS key
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, unnest(range(0, greatest(ceil(r.repeats)::BIGINT, 1))) AS x(epoch)),
q AS (SELECT *, key % blocks AS block FROM p),
o AS (
  SELECT *, row_number() OVER (PARTITION BY source, epoch, block ORDER BY key, doc_id) AS place,
         sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block, key, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS before
  FROM q)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, block::BIGINT AS block, place::INTEGER AS place
FROM o WHERE epoch < floor(repeats) OR before < (repeats - epoch) * tokens
"""
