"""Quality rules: a threshold table compiled into one projection over counts of a text.

Everything is built-in functions. Ratios are compared as whole numbers, so results do not
depend on rounding. Repeated three-word windows are found by sorting the windows' hashes
within the row; the words of neighbours with equal hashes are compared as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleworks.llm.common import text_of

#: Fixed by the task: ASCII white space, and the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent words of the languages covered.
STOP_WORDS = (
    "the and of to in is that with for as was on are by this be from or it an at which "
    "der die das und in den von zu mit ist des sich auf für als eine ein im dem nicht auch "
    "le la les de des et un une du en que qui dans pour par sur est pas au avec "
    "el los las y a del se con por una su para es al lo como"
).split()

#: (name, numerator, denominator, lowest and highest number of hundredths; None: no bound).
THRESHOLDS = (
    ("mean word length", "word_chars", "n_words", 200, 1500),
    ("symbols per word", "n_symbols", "n_words", None, 10),
    ("shouts per word", "n_shouts", "n_words", None, 30),
    ("stop words per word", "n_stop_words", "n_words", 2, None),
    ("duplicate lines per line", "n_dup_lines", "n_lines", None, 50),
)
MIN_WORDS, MAX_REPEATED = 50, 50


def counts(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of every text: words, their characters, symbols, lines and repeated windows."""
    text = F.col("_text")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    stage = docs.select(id_column, text_of().alias("_text")).select(
        id_column, "_text", F.btrim("_text", F.lit(SPACE)).alias("_trimmed"), lines.alias("_lines"),
    ).select(
        id_column,
        F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", r"[\x20\x09-\x0D]+")).alias("_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_shouts"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    words = F.col("_words")
    last = F.size(words) - 3
    windows = F.when(last < 0, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    )
    stage = stage.withColumn("_sorted", F.sort_array(windows)).withColumn(
        "n_stop_words", F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long")
    )
    ordered = F.col("_sorted")

    def same(x: Column, k: Column) -> Column:
        y = F.get(ordered, k)
        texts = [F.get(words, x["i"] + d) == F.get(words, y["i"] + d) for d in range(3)]
        return F.coalesce((y["h"] == x["h"]) & reduce(Column.__and__, texts), F.lit(False))

    stage = stage.withColumn("_at", F.sort_array(F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    at = F.col("_at")
    gaps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
    return stage.select(
        id_column, F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        "n_shouts", "n_lines", "n_stop_words",
    )


def verdict(thresholds=THRESHOLDS) -> Column:
    """The table as one expression: true where every ratio lies within its bounds."""
    tests = []
    for _, top, bottom, low, high in thresholds:
        if low is not None:
            tests.append(F.col(top) * 100 >= F.col(bottom) * low)
        if high is not None:
            tests.append(F.col(top) * 100 <= F.col(bottom) * high)
    return reduce(Column.__and__, tests, F.lit(True))


def judge(docs: DataFrame, id_column: str = "doc_id", thresholds=THRESHOLDS) -> DataFrame:
    """Counts, base_failed and kept for every row.

    Null texts and texts without words have zero counts and fail the base rule. Repeated rows
    stay; an empty table gives no rows; other columns are ignored.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return counts(docs, id_column).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))


def statement() -> str:
    """The same in SQL, over rows, words and windows as relations."""
    rules = []
    for _, top, bottom, low, high in THRESHOLDS:
        rules += [f"{top} * 100 >= {bottom} * {low}"] * (low is not None) + [f"{top} * 100 <= {bottom} * {high}"] * (high is not None)
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{word}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM l),
g AS (SELECT rid, i, CASE WHEN i + 2 <= max(i) OVER (PARTITION BY rid)
             THEN {{'a': word, 'b': lead(word) OVER o, 'c': lead(word, 2) OVER o}} END AS gram
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, CASE WHEN gram IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY rid, gram) END AS n FROM g),
m AS (SELECT rid, i, max(n) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM c),
r AS (SELECT rid, count(*) FILTER (n > 1) AS n_repeat_words FROM m GROUP BY rid),
a AS (SELECT doc_id, len(ws) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(t) - len(replace(t, '!', '')) AS n_shouts, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words
      FROM l LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} AS base_failed FROM a)
SELECT *, NOT base_failed AND {' AND '.join(rules)} AS kept FROM b
"""
