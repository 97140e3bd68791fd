"""Rules on the length, symbols, stop words and lines of a text, compiled from a table of thresholds into one projection.

All measures are counts by Spark's own functions; a rule compares two of them in
integers, so a verdict never depends on rounding. No function of our own runs on
the executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a window; a window found twice in a text is a repetition.
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the a an and of to in is was that it for on with as at by be this from or are "
    "der die das und in zu den mit von ist ein eine auf für im des dem nicht "
    "le la les un une des et de du en est que pour dans qui sur par pas au "
    "el los las un una y de en que es por con para del se no lo"
).split()


class Rule(NamedTuple):
    """A text fails where ``times * measure`` is less or more than ``share * other`` (``other`` None: than ``share``)."""

    name: str
    times: int
    measure: str
    sign: str
    share: int
    other: str | None = None


#: These fail a text whatever the thresholds below say.
BASE = (
    Rule("few_words", 1, "n_words", "<", 20),
    Rule("repeated_windows", 100, "n_repeat_words", ">", 30, "n_words"),
)
#: Lengths, symbols, stop words and lines.
RULES = (
    Rule("short_words", 1, "word_chars", "<", 2, "n_words"),
    Rule("long_words", 1, "word_chars", ">", 15, "n_words"),
    Rule("many_words", 1, "n_words", ">", 1_000_000),
    Rule("symbols", 100, "n_symbols", ">", 10, "n_words"),
    Rule("shouting", 100, "n_marks", ">", 50, "n_words"),
    Rule("capitals", 100, "n_capitals", ">", 50, "word_chars"),
    Rule("no_stop_words", 1, "n_stop_words", "<", 2),
    Rule("few_stop_words", 100, "n_stop_words", "<", 2, "n_words"),
    Rule("repeated_lines", 100, "n_dup_lines", ">", 40, "n_lines"),
    Rule("bullet_lines", 100, "n_bullet_lines", ">", 90, "n_lines"),
    Rule("broken_lines", 100, "n_ellipsis_lines", ">", 30, "n_lines"),
)
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE_MEASURES, "n_marks", "n_capitals", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _twice(words: Column, hashes: Column) -> Column:
    """Sorted starts of the windows that are found twice or more; only called where a hash repeats."""
    window = lambda i: F.slice(words, i + 1, WINDOW)
    same = lambda a, b: (a["h"] == b["h"]) & (window(a["i"]) == window(b["i"]))

    def of(s: Column) -> Column:
        near = lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))
        marked = F.transform(s, lambda x, k: F.when(near(x, k), x["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of)


def _covered(starts: Column) -> Column:
    """Words in windows that begin at ``starts`` (ascending)."""
    def of(p: Column) -> Column:
        own = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(starts, of)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """The id and ``MEASURES`` of every row; with ``keep_row`` also ``_row``, a struct of all input columns.

    A null or empty text has zeros. Rows repeat as in the input, null ids stay
    null, an empty table gives an empty result; other columns are not read, so
    none can clash. A text of any length is one row of arrays of its words, never
    a shuffle. Two windows count as equal if their words are; they are searched
    by a 64-bit hash, and only where a hash repeats are they sorted and compared.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] * keep_row
    rest = ["_row"] * keep_row
    parted = docs.select(F.col(f"`{id_col}`").alias(id_col), *row, text.alias("_t")).select(
        id_col, *rest, "_t",
        F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
        F.split(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+").alias("_units"),
    )
    long = lambda c: F.size(c).cast("long")
    n = F.size("_words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW))))
    counted = parted.select(
        id_col, *rest, "_words", hashes.alias("_hashes"),
        n.cast("long").alias("n_words"),
        _without(F.col("_t"), r"[\x20\x09-\x0D]+").alias("word_chars"),
        (F.length("_t") - _without(F.col("_t"), r"[#*$%&|<>]+")).alias("n_symbols"),
        (F.length("_t") - _without(F.col("_t"), r"[!?]+")).alias("n_marks"),
        (F.length("_t") - _without(F.col("_t"), r"[A-Z]+")).alias("n_capitals"),
        long(F.filter("_units", lambda w: w.isin(*sorted(set(STOP_WORDS))))).alias("n_stop_words"),
        long(F.col("_lines")).alias("n_lines"),
        (long(F.col("_lines")) - long(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("n_bullet_lines"),
        long(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
    )
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    covered = F.when(repeats, _covered(_twice(F.col("_words"), F.col("_hashes")))).otherwise(0)
    return counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(id_col, *rest, *MEASURES)


def fails(rule: Rule) -> Column:
    left = F.col(rule.measure) * rule.times
    right = F.col(rule.other) * rule.share if rule.other else F.lit(rule.share)
    return {"<": left < right, ">": left > right}[rule.sign]


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, **args) -> DataFrame:
    """``measures`` with ``base_failed``, ``kept`` and the names of the rules that a text fails (``failed``).

    A text without words fails the rule on few words. A comparison with a measure
    of zero on its right side fails nothing that is zero on its left.
    """
    broken = F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    any_of = lambda some: F.exists(F.array(*[fails(r) for r in some]), lambda x: x) if some else F.lit(False)
    return measures(docs, **args).select("*", broken.alias("failed"), any_of(base).alias("base_failed")).withColumn("kept", F.size("failed") == 0)


def sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """The query of this operator for DuckDB, from the same table of thresholds."""
    cond = lambda r: f"{r.times} * {r.measure} {r.sign} {r.share}" + (f" * {r.other}" if r.other else "")
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parted AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
         regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS units
  FROM d
), windows AS (
  SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM parted WHERE len(words) >= {WINDOW})
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
         len(list_filter(units, lambda x: x IN ({stop}))) AS n_stop_words,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM parted LEFT JOIN covered USING (rid)
)
SELECT doc_id, {", ".join(BASE_MEASURES)}, ({" OR ".join(map(cond, base))}) AS base_failed,
       NOT ({" OR ".join(map(cond, (*base, *rules)))}) AS kept
FROM m
"""
