"""Quality rules: one threshold table, compiled into one Spark projection.

Only built-in functions run here. Word arrays are cut once, windows of five
words are found again by sorting their 64-bit hashes inside the row, and every
rule compares integers (a count against a percentage of another count), so the
verdict doesn't hang on floating point.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for with on as be at by this are from or an was "
    "der die und das den ist von mit ein eine zu im auf für sich nicht als dem des "
    "le la les et de un une que pour dans est en du qui par sur pas avec "
    "el los las y del con para se al su no por"
).split()


class Rule(NamedTuple):
    """``low`` <= 100 * ``count`` / ``base`` <= ``high``, for texts of ``words`` words or more."""

    name: str
    count: str
    base: str
    low: int | None
    high: int | None
    words: int = 0


#: Means of word length, symbols and stop words in a hundred words, repeated lines in a hundred lines.
RULES = (
    Rule("length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None, 50),
    Rule("lines", "n_dup_lines", "n_lines", None, 50),
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use, in columns that begin with ``_q_``.

    A null text counts as empty; it has no words and no lines with a word.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns(
        {
            "_q_words": F.filter(F.split(whole, SPACE), lambda x: x != ""),
            "_q_lines": F.filter(F.split(whole, "\n", -1), lambda x: F.regexp_replace(x, SPACE, "") != ""),
            "_q_n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        }
    )
    ws = F.col("_q_words")
    stop = F.array(*map(F.lit, STOP_WORDS))
    # one struct of hash and place for each window; sorting brings equal windows together
    starts = F.sequence(F.lit(0), F.size(ws) - WINDOW)
    # a filter above would otherwise be moved below and work this out anew for every word; what the optimizer takes for indeterminate stays
    here = F.spark_partition_id() >= 0
    windows = F.when((F.size(ws) >= WINDOW) & here, F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(*(F.get(ws, i + k) for k in range(WINDOW))).alias("h"), i.alias("i")))))
    out = out.withColumns(
        {
            "_q_windows": windows,
            "_q_n_words": F.size(ws).cast("long"),
            "_q_word_chars": F.length(F.array_join(ws, "")).cast("long"),
            "_q_n_stop_words": F.size(F.filter(ws, lambda x: F.array_contains(stop, F.lower(x)))).cast("long"),
            "_q_n_lines": F.size("_q_lines").cast("long"),
            "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        }
    )
    sw = F.col("_q_windows")

    def again(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(sw, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sw, i + 1)["h"] == x["h"], F.lit(False))

    out = out.withColumn("_q_found", F.sort_array(F.transform(F.filter(sw, again), lambda x: x["i"])))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_q_found", zero, lambda a, p: F.struct((a["n"] + (p + WINDOW - F.greatest(p, a["end"]))).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    return out.withColumn("_q_n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_q_words", "_q_lines", "_q_windows", "_q_found")


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of the words in repeated windows."""
    n, r = F.col("_q_n_words"), F.col("_q_n_repeat_words")
    return (n < MIN_WORDS) | (r * 100 > n * MAX_REPEAT_PERCENT)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds."""
    out = F.lit(True)
    for r in rules:
        count, base = F.col(f"_q_{r.count}") * 100, F.col(f"_q_{r.base}")
        held = F.lit(True)
        if r.low is not None:
            held = held & (count >= base * r.low)
        if r.high is not None:
            held = held & (count <= base * r.high)
        out = out & (held if not r.words else (held | (F.col("_q_n_words") < r.words)))
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict per row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept. One row per input row, repeated rows
    and null ids included; other columns are ignored.
    """
    m = measures(docs.select("doc_id", "text"))
    counts = [F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return m.select("doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    A null or empty text has no words and does not pass; rows that repeat, or
    have a null id, are judged one by one.
    """
    # worked out once, in the projection: the optimizer does not move a filter below what it takes for indeterminate
    good = F.when(F.spark_partition_id() >= 0, ~base_failed() & verdict(rules))
    # the row goes along in one column, so that its names meet none of those above
    row = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    return measures(row).withColumn("_q_good", good).where("_q_good").select("row.*")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in DuckDB's SQL, from the same table of rules."""
    tests = ["true"]
    for r in rules:
        held = [f"{r.count} * 100 >= {r.base} * {r.low}"] * (r.low is not None) + [f"{r.count} * 100 <= {r.base} * {r.high}"] * (r.high is not None)
        tests.append(f"(n_words < {r.words} OR ({' AND '.join(held)}))")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> '') AS ls FROM d),
g AS (SELECT rid, i, ws[i:i + {WINDOW - 1}] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
p AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM c WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(tests)} AS kept FROM b"""
