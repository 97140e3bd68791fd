"""How five filters of a corpus act on one another, in every order they could run in.

A document's failures are five bits. For each part and label the job adds up 32
signed parity sums over all documents, which a Walsh-Hadamard inversion turns
exactly into counts of the 32 masks; every order and every Shapley value follows
from those.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from likeness.llm.quality_rules import WORD

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Parts that rows without an id are dealt to, so that they do not meet in one task.
SALTS = 512


def text_mask(text: Column) -> Column:
    """Bits of the failures that the text alone decides: A few words, B repeated words, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, capitals * 100 > F.length(text) * 10, text.rlike("[#$%&*|]")]
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)]
    return sum(bits[1:], bits[0])


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by text, part and label: ``mask`` without E, ``n_first`` rows that do not fail E, ``n_copy`` rows that do.

    Only ids and digests are shuffled, never texts. Rows that repeat an id, a
    part and a text are counted together first, and a group of copies is put
    together before it meets (one row for each part and label), so neither lands
    whole in one task.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
    ).select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), text_mask(F.col("t")).alias("mask"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(SALTS))).otherwise(0)
    slim = slim.groupBy("doc_id", "part", "digest", "mask", salt.alias("salt")).agg(F.count("*").alias("n"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(is_one("quality"), is_one("toxic")).withColumn("salt", F.lit(0))
    no = F.lit(False)
    found = slim.join(known, ["doc_id", "salt"], "left").withColumns({"quality": F.coalesce("quality", no), "toxic": F.coalesce("toxic", no)})
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    of_text = found.groupBy("digest", "part", "quality", "toxic", "mask").agg(F.sum("n").alias("n"), first.alias("first"), nameless.alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    kept = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    return of_text.withColumn("least", least).withColumn("n_first", kept).select("part", "quality", "toxic", "mask", "n_first", (F.col("n") - F.col("n_first")).alias("n_copy"))


def _odd(bits: Column) -> Column:
    return F.bit_count(bits) % 2 == 1


def parity_sums(counts: DataFrame) -> DataFrame:
    """For each part, quality and toxic: ``sums``, whose s-th item adds (-1) to the number of bits that mask and s share, over all documents."""

    def signed(s: int) -> Column:
        total = F.col("n_first") - F.col("n_copy") if s & COPY else F.col("n_first") + F.col("n_copy")
        return F.sum(F.when(_odd(F.col("mask").bitwiseAND(F.lit(s))), -total).otherwise(total)).alias(f"w{s}")

    rolled = counts.groupBy("part", "quality", "toxic").agg(*[signed(s) for s in range(MASKS)])
    return rolled.select("part", "quality", "toxic", F.array(*[f"w{s}" for s in range(MASKS)]).alias("sums"))


def _added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def inverted(sums: Column) -> Column:
    """Exact counts of the 32 masks from their signed sums."""
    signed = lambda m: F.transform(sums, lambda x, s: F.when(_odd(m.bitwiseAND(s)), -x).otherwise(x))
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.shiftright(_added(signed(m)), len(FILTERS)))


def cells(sums: DataFrame) -> DataFrame:
    """For each part, counts of the 32 masks: of ``every`` document, of ``good`` and of ``toxic`` ones."""
    split = sums.select("part", "quality", F.col("toxic").alias("bad"), F.posexplode(inverted(F.col("sums"))).alias("mask", "n"))
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    each = split.groupBy("part", "mask").agg(F.sum("n").alias("every"), part(F.col("quality")).alias("good"), part(F.col("bad")).alias("toxic"))
    row = F.array_sort(F.collect_list(F.struct("mask", "every", "good", "toxic")))  # 32 of them
    return each.groupBy("part").agg(row.alias("c")).select("part", "c.every", "c.good", "c.toxic")


def _steps() -> Column:
    """The 120 orders, step by step: the order's name, the step, the filter's bit, the bits before it."""
    made = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        before = 0
        for k, i in enumerate(order):
            made.append(F.struct(F.lit(name).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << i).alias("bit"), F.lit(before).alias("before")))
            before |= 1 << i
    return F.array(*made)


def orders(cells: DataFrame) -> DataFrame:
    """One row for each part, order and step, zeros included."""
    at = cells.select("part", "every", "good", "toxic", F.explode(_steps()).alias("s")).select("part", "every", "good", "toxic", "s.*")
    has = lambda m, c: m.bitwiseAND(F.col(c)) != 0
    over = lambda counts, cond: _added(F.transform(counts, lambda x, m: F.when(cond(m), x).otherwise(F.lit(0).cast("long"))))
    gone = lambda m: has(m, "bit") & ~has(m, "before")
    share = F.array(*[F.lit(120 // k if k else 0) for k in range(len(FILTERS) + 1)])
    fair = F.transform("every", lambda x, m: F.when(has(m, "bit"), x * F.get(share, F.bit_count(m))).otherwise(F.lit(0).cast("long")))
    return at.select(
        "part", "filter_order", "step",
        over("every", lambda m: ~has(m, "bit") & ~has(m, "before")).alias("kept"),
        over("every", gone).alias("removed"),
        over("every", lambda m: has(m, "bit") & has(m, "before")).alias("redundant"),
        over("every", lambda m: m == F.col("bit")).alias("unique_fails"),
        over("good", gone).alias("good_lost"),
        over("toxic", gone).alias("toxic_lost"),
        _added(fair).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of the five filters removes at each step of each of the 120 orders, for each part (language).

    A null text is empty, a null language is the empty part. A row without an id
    is no copy and makes none; it still counts in the rest. Rows that repeat an
    id with its text do not make copies of each other. A document is good or
    toxic if any of its labels says so; labels without an id belong to none. An
    empty table of documents has no parts, so no rows; empty labels lose nothing.
    Only ``doc_id``, ``lang``, ``text``, ``quality`` and ``toxic`` are read.
    """
    return orders(cells(parity_sums(failures(docs, labels))))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), counted AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY t) AS least
  FROM d
), failed AS (
  SELECT part, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = counted.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = counted.doc_id AND l.toxic = 1) AS toxic,
         (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN least < doc_id THEN 'E' ELSE '' END) AS f
  FROM counted
), cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM orders, letters WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)
), steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS x, filter_order[:s - 1] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS s) WHERE length(filter_order) = 5
), met AS (
  SELECT part, filter_order, step, n, good, toxic, f = x AS alone, contains(f, x) AS hit,
         len(list_filter(string_split(before, ''), lambda y: y <> '' AND contains(f, y))) > 0 AS earlier,
         x
  FROM cells, steps
), counts AS (
  SELECT part, filter_order, step, any_value(x) AS x,
         CAST(coalesce(sum(n) FILTER (WHERE NOT hit AND NOT earlier), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT earlier), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE hit AND earlier), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE hit AND NOT earlier), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE hit AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counts
"""
