"""Audit of how quality filters interact, for every order in which they could be applied.

Each document is a mask of the filters that it fails; documents of one part and mask are a cell, and only cells'
counts matter. Cells are unpivoted into long form, a row for each mask, order and step. A running bit-or
over the steps before says whether an earlier filter has taken the cell, conditional sums give each step's counts, and a
window over all rows of a part and filter sums what it removes in all orders.

The long form doesn't depend on the data but through the masks' counts: 2^k masks times k! orders times k steps (19,200 rows for five
filters). Windows run over this table alone, which then meets the cells, so no window grows with the corpus, nor
does what is broadcast. A part has at most 2^k cells.

Filters A to D look at a text alone. E, an exact copy of a document of smaller id, holds or not by SHA-256 of the
text: the smallest id of each text is an aggregate, and rows are counted by (text, id, part) first, so thousands of copies meet as one
row for each id; the join that tells firsts from copies is keyed by text and id, and no group of copies has to meet anywhere.

Defined cases: a null text is an empty one (fails A only, and E after another empty text); a row without an id is no
copy and has none that counts as smaller, and has no labels; rows of one id and text are no copies of each other; a null source is part ''; an
id with several labels counts for each value it has; rows repeated count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written

COPY = "E"
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text (never null)."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def long_form(spark: SparkSession, letters: str) -> DataFrame:
    """(mask, filter_order, step, bit, fails, gone): whether the step's filter fails a mask, and whether an earlier step's has.

    One row for each mask, order and step: its size is a function of the number of filters.
    """
    if len(letters) > 7:
        raise ValueError("at most seven filters: the orders are enumerated")
    bit = F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))])
    orders = spark.createDataFrame([("".join(p),) for p in permutations(letters)], "filter_order string")
    steps = orders.select("filter_order", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).where("filter <> ''")
    steps = steps.select("filter_order", (F.col("at") + 1).cast("int").alias("step"), "filter", bit[F.col("filter")].alias("bit"))
    cells = spark.range(1 << len(letters)).select(F.col("id").cast("int").alias("mask")).join(F.broadcast(steps))
    before = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    return cells.select("*", (failed != 0).alias("fails"), (F.coalesce(F.bit_or(failed).over(before), F.lit(0)) != 0).alias("gone"))


def masks(docs: DataFrame, labels: DataFrame, filters=text_filters) -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic): how many documents of each part fail just these filters, and how many of them have the labels; and the filters' letters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    conditions: Mapping[str, Column] = filters(text)
    letters = "".join(conditions) + COPY
    own = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), own.alias("own"))
    counted = written(rows.groupBy("digest", "id", "part", "own").agg(F.count(F.lit(1)).alias("n")), "masks")
    first = counted.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("g"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    some = counted.where("id IS NOT NULL").join(first, ["digest", "id"], "left").join(marks, "id", "left")
    copy = F.when(F.col("first").isNull(), 1 << len(conditions)).otherwise(0)
    none = counted.where("id IS NULL").select("part", F.col("own").alias("mask"), "n", F.lit(None).cast("int").alias("g"), F.lit(None).cast("int").alias("t"))
    cells = some.select("part", (F.col("own") + copy).alias("mask"), "n", "g", "t").unionByName(none)
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("t") == 1, F.col("n")).otherwise(0)).alias("toxic")), letters


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """Counts of each part, order and step from ``cells`` (part, mask, n, good, toxic). See COUNTS for the columns."""
    form = F.broadcast(long_form(cells.sparkSession, letters))  # of fixed size
    taken = F.col("fails") & ~F.col("gone")
    count = lambda where, column: F.sum(F.when(where, F.col(column)).otherwise(0))
    steps = cells.join(form, "mask").groupBy("part", "filter_order", "step", "filter").agg(
        count(~F.col("fails") & ~F.col("gone"), "n").alias("kept"),
        count(taken, "n").alias("removed"),
        count(F.col("fails") & F.col("gone"), "n").alias("redundant"),
        count(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        count(taken, "good").alias("good_lost"),
        count(taken, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).select("part", "filter_order", "step", *COUNTS)


def interactions(docs: DataFrame, labels: DataFrame, filters=text_filters) -> DataFrame:
    """``audit`` of whole tables: one row for each part, order of the filters and step, zeros included."""
    return audit(*masks(docs, labels, filters))


ORACLE = r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
        f AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
                     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS dd,
                     coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels GROUP BY doc_id),
        m AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': dd, 'E': e} AS m, g, t FROM f LEFT JOIN l USING (doc_id)),
        s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT p.x || q.x || r.x || u.x || v.x AS o FROM s p, s q, s r, s u, s v
              WHERE p.x NOT IN (q.x, r.x, u.x, v.x) AND q.x NOT IN (r.x, u.x, v.x) AND r.x NOT IN (u.x, v.x) AND u.x <> v.x),
        k AS (SELECT part, m['A'] AS a, m['B'] AS b, m['C'] AS c, m['D'] AS d, m['E'] AS e, count(*) AS n, count(*) FILTER (g = 1) AS g, count(*) FILTER (t = 1) AS t FROM m GROUP BY ALL),
        z AS (SELECT *, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS bad FROM k),
        st AS (SELECT part, o, i AS step, o[i] AS x, n, g, t, bad, contains(bad, o[i]) AS fails, length(translate(o[1 : i - 1], bad, '')) < i - 1 AS gone FROM z, o, range(1, 6) AS r(i)),
        c AS (SELECT part, o AS filter_order, step, x, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad = x THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN fails AND NOT gone THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN t ELSE 0 END) AS toxic_lost FROM st GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
        FROM c"""
