"""Quality rules by distribution divergence (operator 1, DataFrame functions only).

Each document gets a histogram of character classes and one of common words.
The reference of a language is the sum of these histograms over all documents
of that language that pass the minimum length. A document is rejected if the
Jensen-Shannon distance (base 2) to its language's reference is too large in
either histogram. Guards: documents under ``min_words`` fail the base rule, and
the common-word histogram counts only with ``min_hits`` hits or more.

Defined results: null text has no words (base rule fails). A null or unlisted
language has no reference, so only the base rule decides. Repeated rows are
judged one by one; an empty table gives an empty result. Very long texts are
judged whole, in arrays of their words. Extra columns of the input pass through
``judge`` unless they carry the name of a result column, which the result
replaces; columns for the work get names that the input doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import unused, written

#: Frequent function words of each language.
LANGUAGE_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was"],
    "fr": ["le", "la", "les", "et", "des", "est", "une", "dans", "pour", "que"],
    "de": ["der", "die", "und", "das", "den", "von", "mit", "ist", "auf", "sich"],
    "es": ["el", "los", "las", "y", "del", "por", "con", "para", "no", "se"],
}
COMMON_WORDS = sorted({w for words in LANGUAGE_WORDS.values() for w in words})

#: As they stand in a text: lower case, or capital at the start of a sentence; a word and its capital form lie one list apart.
_SPELLINGS = COMMON_WORDS + [w.capitalize() for w in COMMON_WORDS]

#: Patterns of everything outside each character class; what is left is counted.
NOT_SYMBOL = r"[^#*$%&|<>]+"
NOT_CLASS = {
    "upper": r"[^A-Z]+",
    "digit": r"[^0-9]+",
    "beyond": r"[\x00-\x7F]+",
    "punct": r"[^\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
}
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.9
MIN_WORDS = 50
MIN_HITS = 10


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once (a lambda variable, so it isn't inlined into inner loops)."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows found twice or more.

    Where all windows have different hashes, none is repeated. Otherwise sort
    the windows themselves, keep equal neighbours, and add up their union.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    distinct = _let(hashes, lambda h: F.size(h) == F.size(F.array_distinct(h)))
    windows = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("t"), i.alias("i")))

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["t"] == x["t"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["t"] == x["t"], F.lit(False)))

    at = F.array_sort(F.transform(_let(F.array_sort(windows), repeated), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(at, start, lambda a, p: F.struct((a["n"] + (p + 3 - F.greatest(p, a["end"]))).alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    return F.when((n < 3) | distinct, F.lit(0).cast("long")).otherwise(covered)


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def features(docs: DataFrame, text: str = "text", class_hist: str = "class_hist", word_hist: str = "word_hist") -> DataFrame:
    """Adds the base counts and the two histograms to every row."""
    keys = ["words", "lines", "common", "length", *NOT_CLASS]
    own = dict(zip(keys, unused([*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], *[f"_{k}" for k in keys])))
    t = F.coalesce(F.col(text), F.lit(""))
    new = docs.withColumn(own["words"], F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    words = F.col(own["words"])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    new = new.withColumns(
        {
            own["lines"]: lines,
            own["common"]: F.transform(F.filter(words, lambda w: w.isin(_SPELLINGS)), lambda w: F.array_position(F.array(*[F.lit(x) for x in _SPELLINGS]), w) % len(COMMON_WORDS)),
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": _left(t, NOT_SYMBOL),
            own["length"]: F.length(t).cast("long"),
            **{own[k]: _left(t, p) for k, p in NOT_CLASS.items()},
        }
    )
    others = [F.col(own[k]) for k in NOT_CLASS]
    space = F.col(own["length"]) - F.col("word_chars")
    lower = F.col(own["length"]) - space - sum(others[1:], others[0])
    return new.withColumns(
        {
            "n_dup_lines": (F.size(own["lines"]) - F.size(F.array_distinct(own["lines"]))).cast("long"),
            "n_repeat_words": _repeat_words(words),
            class_hist: F.array(*others, space, lower),
            word_hist: F.array(*[(F.size(own["common"]) - F.size(F.array_remove(own["common"], (k + 1) % len(COMMON_WORDS)))).cast("long") for k in range(len(COMMON_WORDS))]),
        }
    ).drop(*own.values())


def references(featured: DataFrame, lang: str = "lang", min_words: int = MIN_WORDS, class_hist: str = "class_hist", word_hist: str = "word_hist") -> DataFrame:
    """One row for each listed language (at most ``len(LANGUAGE_WORDS)`` rows): its summed histograms over all documents, as ref_lang, class_ref, word_ref."""
    sums = [F.sum(F.col(class_hist)[i]).alias(f"c{i}") for i in range(6)] + [F.sum(F.col(word_hist)[i]).alias(f"w{i}") for i in range(len(COMMON_WORDS))]
    rows = featured.filter(F.col(lang).isin(list(LANGUAGE_WORDS)) & (F.col("n_words") >= min_words)).groupBy(F.col(lang).alias("ref_lang")).agg(*sums)
    return rows.select("ref_lang", F.array(*[F.col(f"c{i}") for i in range(6)]).alias("class_ref"), F.array(*[F.col(f"w{i}") for i in range(len(COMMON_WORDS))]).alias("word_ref"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two count arrays; null if either is empty."""

    def shares(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
        return F.transform(x, lambda v: v.cast("double") / total.cast("double"))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / ((p + q) / 2))).otherwise(F.lit(0.0))

    parts = F.zip_with(shares(a), shares(b), lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2, F.lit(0.0)))


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_words: int = MIN_WORDS, min_hits: int = MIN_HITS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep`` alone) with the base counts, ``base_failed``, the two distances and ``kept``."""
    docs = docs.drop(*(c for c in RESULTS if c not in (text, lang)))
    names = [c for c in docs.columns if keep is None or c in keep]
    class_hist, word_hist, by, ref_lang, class_ref, word_ref = unused([*docs.columns, *RESULTS], "_class_hist", "_word_hist", "_by", "_ref_lang", "_class_ref", "_word_ref")
    # Written once: the counts serve the references and the verdicts, and no filter on a verdict is pushed into them. A text that isn't kept isn't written.
    featured = features(docs.withColumn(by, F.col(lang)), text, class_hist, word_hist)
    featured = written(featured.select(*names, by, *RESULTS[:5], class_hist, word_hist), "featured")
    # At most len(LANGUAGE_WORDS) rows, whatever the input: a proven bound for the broadcast.
    refs = references(featured, by, min_words, class_hist, word_hist).toDF(ref_lang, class_ref, word_ref)
    joined = featured.join(F.broadcast(refs), F.col(by) == F.col(ref_lang), "left")
    hits = F.aggregate(word_hist, F.lit(0).cast("long"), lambda s, v: s + v)
    known = F.aggregate(word_ref, F.lit(0).cast("long"), lambda s, v: s + v)
    judged = joined.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "class_distance": F.when(F.col(ref_lang).isNotNull() & (F.col("n_words") >= min_words), js_distance(F.col(class_hist), F.col(class_ref))),
            "word_distance": F.when((hits >= min_hits) & (known > 0), js_distance(F.col(word_hist), F.col(word_ref))),
        }
    )
    odd = F.coalesce(F.col("class_distance") > max_class, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~odd).select(*names, *RESULTS)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BINS = [f"len(list_filter(common, lambda w: w = '{w}'))" for w in COMMON_WORDS]
_ISIN = ", ".join(f"'{w}'" for w in _SPELLINGS)
_LANGS = ", ".join(f"'{w}'" for w in LANGUAGE_WORDS)


def _sql_js(a: str, b: str) -> str:
    part = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0.0::DOUBLE END"
    p, q = f"(x[1]::DOUBLE / list_sum({a})::DOUBLE)", f"(x[2]::DOUBLE / list_sum({b})::DOUBLE)"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({a}, {b}), lambda x: {part.format(p=p, q=q)} + {part.format(p=q, q=p)})) / 2, 0.0::DOUBLE))"


SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tri AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY rid),
f AS (
  SELECT rid, doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '{NOT_SYMBOL}', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         length(t)::BIGINT AS n, {", ".join(f"length(regexp_replace(t, '{p}', '', 'g'))::BIGINT AS n_{k}" for k, p in NOT_CLASS.items())},
         list_filter(list_transform(list_filter(words, lambda w: w IN ({_ISIN})), lambda w: lower(w)), lambda w: true) AS common
  FROM base),
h AS (
  SELECT *, [n_upper, n_digit, n_beyond, n_punct, n - word_chars, word_chars - n_upper - n_digit - n_beyond - n_punct] AS ch,
         [{", ".join(_BINS)}]::BIGINT[] AS wh FROM f),
r AS (
  SELECT lang AS l, [{", ".join(f"sum(ch[{i + 1}])::BIGINT" for i in range(6))}] AS cr, [{", ".join(f"sum(wh[{i + 1}])::BIGINT" for i in range(len(COMMON_WORDS)))}] AS wr
  FROM h WHERE lang IN ({_LANGS}) AND n_words >= {MIN_WORDS} GROUP BY lang),
j AS (
  SELECT h.*, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         CASE WHEN r.l IS NOT NULL AND n_words >= {MIN_WORDS} THEN {_sql_js("ch", "cr")} END AS cd,
         CASE WHEN list_sum(wh) >= {MIN_HITS} AND list_sum(wr) > 0 THEN {_sql_js("wh", "wr")} END AS wd
  FROM h LEFT JOIN r ON h.lang = r.l LEFT JOIN rep ON h.rid = rep.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT coalesce(cd > {MAX_CLASS_DISTANCE}, false) AND NOT coalesce(wd > {MAX_WORD_DISTANCE}, false) AS kept
FROM j
"""
