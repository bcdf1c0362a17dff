"""Operator 1, quality rules: adaptive thresholds from mergeable quantile sketches.

Each document gets integer measures.  Per language, source and measure the values go to a
log-linear histogram sketch: a value is counted in the bucket of its top six binary
digits, so a quantile read from it is within 1/32 of the true one.  A sketch is a set of
(bucket, count) rows; two merge by adding counts, which is what the partial aggregation,
the shuffle and the merge of small groups into their language's sketch do.  A threshold is
read from the sketch alone: the last decile, and twice the tail's own spread, which is that
decile's distance from the median, beyond it.  So no value is a cutoff by itself, and at
most one document in ten of a group fails by a measure.  Documents are joined with the
thresholds of their own group and filtered.

Only DataFrame functions are used.

Defined results: a null text has no words and fails the base rule; null languages and
sources form groups of their own; a group of fewer than ``min_group`` documents takes the
thresholds of its language, and a language below that those of all documents; an empty
table gives an empty result.  Repeated rows each get a row.  Columns other than doc_id, text, lang and
source are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._common import stored, table

#: measure: (threshold below, threshold above).
#: Shares are parts per million, mean word length is thousandths of a code point.
MEASURES = {
    "symbol_ppm": (False, True),
    "dup_line_ppm": (False, True),
    "repeat_ppm": (False, True),
    "mean_len_milli": (True, True),
}
#: The quantile 9/10 above, 1/10 below; how many of the tail's spreads lie beyond it.
TAIL, OF, SPREADS = 9, 10, 2
MIN_GROUP = 100
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more.

    Windows are compared by a 64-bit hash of their words inside one document.
    """

    def positions(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"])))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        covered = F.aggregate(
            let(by_hash, twins),
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)

    starts = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, positions))


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeats(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    got = docs.select(
        "doc_id",
        "lang",
        "source",
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
    )
    return got.select(
        "doc_id",
        "lang",
        "source",
        F.col("w.n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("l.n_lines").cast("long").alias("n_lines"),
    )


def _measures() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 1000000 div {b}")).otherwise(F.lit(0)).cast("long")
    return {
        "symbol_ppm": share("n_symbols", "word_chars"),
        "dup_line_ppm": share("n_dup_lines", "n_lines"),
        "repeat_ppm": share("n_repeat_words", "n_words"),
        "mean_len_milli": F.when(F.col("n_words") > 0, F.expr("word_chars * 1000 div n_words")).otherwise(F.lit(0)).cast("long"),
    }


def bucket(v: str) -> Column:
    """Bucket of a value of 0 or more: exact below 64, then 32 buckets for each doubling."""
    return F.expr(
        f"CASE WHEN {v} < 64 THEN {v} ELSE (length(bin({v})) - 6) * 32"
        f" + shiftright({v}, length(bin({v})) - 6) END"
    ).cast("long")


def bucket_low(b: str) -> Column:
    """The least value of a bucket."""
    b = f"({b})"
    return F.expr(f"CASE WHEN {b} < 64 THEN {b} ELSE shiftleft(CAST({b} % 32 + 32 AS BIGINT), CAST({b} div 32 - 1 AS INT)) END").cast("long")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch per language, source and measure."""
    long = stats.select("lang", "source", F.explode(F.create_map(*[x for k, v in _measures().items() for x in (F.lit(k), v)])).alias("measure", "v"))
    return long.groupBy("lang", "source", "measure", bucket("v").alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, *by: str) -> DataFrame:
    """One row for each group: its size and, as columns low_<measure> and high_<measure>, the thresholds."""
    keys = [*by, "measure"]
    w = Window.partitionBy(*keys)
    ranked = sketch.select(
        *keys, "bucket", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total")
    )
    quantile = lambda q: F.min(F.when(F.col("upto") * OF >= F.col("total") * q, F.col("bucket")))
    half = F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("bucket")))
    found = ranked.groupBy(*keys).agg(quantile(OF - TAIL).alias("b_low"), half.alias("b_mid"), quantile(TAIL).alias("b_high"), F.max("total").alias("total"))
    # of a bucket its largest value above, its least value below
    top = lambda b: bucket_low(f"{b} + 1") - 1
    low, high = bucket_low("b_low"), top("b_high")
    low, high = low - SPREADS * (bucket_low("b_mid") - low), high + SPREADS * (high - top("b_mid"))
    spread = found.select(*keys, "total", low.alias("low"), high.alias("high"))
    cols = [F.max("total").alias("total")]
    for k, (below, above) in MEASURES.items():
        if below:
            cols.append(F.max(F.when(F.col("measure") == k, F.col("low"))).alias(f"low_{k}"))
        if above:
            cols.append(F.max(F.when(F.col("measure") == k, F.col("high"))).alias(f"high_{k}"))
    return spread.groupBy(*by).agg(*cols)


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """docs: doc_id, text, lang, source.  Returns one row for each, with the measures,
    ``base_failed`` and ``kept``."""
    stats = stored(document_stats(docs))
    fine = stored(sketches(stats))
    names = [f"{s}_{k}" for k, v in MEASURES.items() for s, on in (("low", v[0]), ("high", v[1])) if on]
    own = thresholds(fine, "lang", "source")
    lang = thresholds(merge(fine, "lang"), "lang").select("lang", *[F.col(c).alias(f"l_{c}") for c in ["total", *names]])
    whole = thresholds(merge(fine)).select(*[F.col(c).alias(f"a_{c}") for c in names])
    pick = lambda c: (
        F.when(F.col("total") >= min_group, F.col(c)).when(F.col("l_total") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    )
    own = own.alias("o").join(lang.alias("g"), F.col("o.lang").eqNullSafe(F.col("g.lang")))
    own = own.join(whole).select("o.lang", "o.source", *[pick(c).alias(c) for c in names])
    joined = stats.alias("s").join(own.alias("t"), F.col("s.lang").eqNullSafe(F.col("t.lang")) & F.col("s.source").eqNullSafe(F.col("t.source")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    inside = F.lit(True)
    for k, v in _measures().items():
        below, above = MEASURES[k]
        inside = inside & (v >= F.col(f"low_{k}") if below else F.lit(True)) & (v <= F.col(f"high_{k}") if above else F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def _sql_bucket(v: str) -> str:
    return f"(CASE WHEN {v} < 64 THEN {v} ELSE (length(bin({v})) - 6) * 32 + ({v} >> (length(bin({v})) - 6)) END)"


def _sql_low(b: str) -> str:
    b = f"({b})"
    return f"(CASE WHEN {b} < 64 THEN {b} ELSE (({b}) % 32 + 32) << (({b}) // 32 - 1) END)"


def _sql_thresholds(source: str, by: str) -> str:
    keys = f"{by}, measure" if by else "measure"
    top = lambda b: f"({_sql_low(f'({b} + 1)')} - 1)"
    cols = [f"max(CASE WHEN measure = '{k}' THEN {s} END) AS {s}_{k}" for k, v in MEASURES.items() for s, on in (("low", v[0]), ("high", v[1])) if on]
    return f"""SELECT {by + ', ' if by else ''}max(total) AS total, {', '.join(cols)} FROM (
      SELECT {keys}, total, {_sql_low('b_low')} - {SPREADS} * ({_sql_low('b_mid')} - {_sql_low('b_low')}) AS low,
             {top('b_high')} + {SPREADS} * ({top('b_high')} - {top('b_mid')}) AS high FROM (
        SELECT {keys}, max(total) AS total, min(CASE WHEN upto * {OF} >= total * {OF - TAIL} THEN bucket END) AS b_low,
               min(CASE WHEN upto * 2 >= total THEN bucket END) AS b_mid, min(CASE WHEN upto * {OF} >= total * {TAIL} THEN bucket END) AS b_high FROM (
          SELECT {keys}, bucket, CAST(sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS BIGINT) AS upto,
                 CAST(sum(n) OVER (PARTITION BY {keys}) AS BIGINT) AS total
          FROM (SELECT {keys}, bucket, CAST(sum(n) AS BIGINT) AS n FROM {source} GROUP BY {keys}, bucket)) GROUP BY {keys})) {('GROUP BY ' + by) if by else ''}"""


def oracle() -> str:
    names = [f"{s}_{k}" for k, v in MEASURES.items() for s, on in (("low", v[0]), ("high", v[1])) if on]
    pick = ", ".join(f"CASE WHEN o.total >= {MIN_GROUP} THEN o.{c} WHEN g.total >= {MIN_GROUP} THEN g.{c} ELSE a.{c} END AS {c}" for c in names)
    measures = {
        "symbol_ppm": "CASE WHEN word_chars > 0 THEN n_symbols * 1000000 // word_chars ELSE 0 END",
        "dup_line_ppm": "CASE WHEN n_lines > 0 THEN n_dup_lines * 1000000 // n_lines ELSE 0 END",
        "repeat_ppm": "CASE WHEN n_words > 0 THEN n_repeat_words * 1000000 // n_words ELSE 0 END",
        "mean_len_milli": "CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END",
    }
    inside = " AND ".join(
        ([f"m.{k} >= t.low_{k}"] if v[0] else []).__add__([f"m.{k} <= t.high_{k}"] if v[1] else [])[i] for k, v in MEASURES.items() for i in range(v[0] + v[1])
    )
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS word,
              generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
 g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS gram FROM w
       WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, gram, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1),
 rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
 ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
 s AS (SELECT d.doc_id, lang, source, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n_words,
              length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
              coalesce(ln.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(ln.n, 0) AS n_lines
       FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
 m AS (SELECT *, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in measures.items())} FROM s),
 l AS ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS measure, {k} AS v FROM m" for k in measures)}),
 sk AS (SELECT lang, source, measure, {_sql_bucket('v')} AS bucket, count(*) AS n FROM l GROUP BY ALL),
 o AS ({_sql_thresholds('sk', 'lang, source')}),
 g2 AS ({_sql_thresholds('sk', 'lang')}),
 a AS ({_sql_thresholds('sk', '')}),
 t AS (SELECT o.lang, o.source, {pick} FROM o JOIN g2 g ON o.lang IS NOT DISTINCT FROM g.lang, a)
SELECT m.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AS base_failed,
       (NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AND {inside}) AS kept
FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source"""
