"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get numbers 0 .. n - 1 in the order of (doc_id, crc32, size). A keyed permutation of that range moves row r to
place p; place p is in shard p mod k, at slot p div k. So shards differ by one row at most (law ``rows``), slots have no
gaps, and both follow from r, n, k and the seed alone, as r follows from shard and slot (``row_at``): a reader that
resumes, or wants the i-th sample of an epoch, computes where it lies.

The permutation is a generalised Feistel network on Z_a x Z_b with a = ceil(sqrt(n)) and b = ceil(n / a): each round
adds a keyed function of one half to the other. Its domain has fewer than a numbers too many. A row that lands on one of
them walks on along its cycle until it is inside (Black and Rogaway 2002). ``walk_length`` finds how many steps that ever
takes by following all surplus numbers, so the walk is a fixed expression, and exact.

Nothing is sorted in one task: rows are dealt by ranges of the whole order, which ends with the row's place in the
table, so neither rows without an id nor equal rows gather; places within a range and the ranges' totals give the
numbers. Only ids, sizes and check sums travel. All is in DataFrame functions.

Defined cases: a null text has size 1 and check sum 0, as an empty one; rows without an id come first; rows of one id
follow their check sums; repeated rows each get a place (which of them gets which can't be told); equal texts are not kept
together, since no law of row counts allows it; an empty table gives no rows; extra columns are ignored, or kept by
``write_shards`` whatever their names.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import spare, written

SHARDS = 16
SEED = 20_240_601
ROUNDS = 6
PRIMES = (2_147_483_647, 2_147_483_629)  #: the two largest below 2^31; products stay below 2^63


def round_keys(seed: int) -> list[tuple[int, int, int, int]]:
    """Of each round: offset and factor, twice, each below the smaller prime and not 0."""
    out = []
    for i in range(ROUNDS):
        d = hashlib.sha256(f"{seed}/{i}".encode()).digest()
        out.append(tuple(int.from_bytes(d[4 * j : 4 * j + 4], "big") % (PRIMES[1] - 1) + 1 for j in range(4)))
    return out


def halves(n: int) -> tuple[int, int]:
    """(a, b): the least a with a² >= n, the least b with a · b >= n."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, n: int) -> Column:
    return F.call_function("div", x, F.lit(n).cast("long"))


def _once(x: Column, n: int, seed: int, back: bool) -> Column:
    """One pass of the network, or of its inverse if ``back``, over the number x.

    The rounds are an ``aggregate`` over their keys: the half that stands in two places of a round is a bound variable there, where
    expressions put into each other would multiply.
    """
    a, b = halves(n)
    keys = round_keys(seed)
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(("c1", "m1", "c2", "m2"), key, strict=True)]) for key in (reversed(keys) if back else keys)])
    state = lambda u, v, su, sv: F.struct(u.alias("u"), v.alias("v"), su.alias("su"), sv.alias("sv"))
    f = lambda y, k: ((y + k["c1"]) * k["m1"] % F.lit(PRIMES[0]) + k["c2"]) * k["m2"] % F.lit(PRIMES[1])
    if back:
        step = lambda s, k: state(F.pmod(s["v"] - f(s["u"], k), s["sv"]), s["u"], s["sv"], s["su"])
    else:
        step = lambda s, k: state(s["v"], F.pmod(s["u"] + f(s["v"], k), s["su"]), s["sv"], s["su"])
    first = state(_div(x, b), x % F.lit(b).cast("long"), F.lit(a).cast("long"), F.lit(b).cast("long"))
    return F.aggregate(rounds, first, step, lambda s: s["u"] * F.lit(b) + s["v"])


def walk_length(spark: SparkSession, n: int, seed: int) -> int:
    """How many further passes bring every number below n back below n.

    The surplus numbers that passes can lead to form ever smaller sets; when a set stays as large as it was, it is made of
    closed cycles, which no number from outside enters.
    """
    a, b = halves(n)
    at, size, steps = spark.range(n, a * b).toDF("x"), a * b - n, 0
    while size:
        steps += 1
        at = at.select(_once(F.col("x"), n, seed, False).alias("x")).where(F.col("x") >= n)
        left = at.count()
        if left == size:
            break
        size = left
    return steps


def _walked(spark: SparkSession, x: Column, n: int, seed: int, back: bool) -> Column:
    steps = F.sequence(F.lit(1), F.lit(walk_length(spark, n, seed) + 1))
    return F.aggregate(steps, x, lambda y, i: F.when((i == 1) | (y >= n), _once(y, n, seed, back)).otherwise(y))


def place(df: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED, row: str = "row") -> DataFrame:
    """``df`` with ``shard`` and ``slot`` of the row numbers in ``row``, of n rows in all."""
    at = _walked(df.sparkSession, F.col(row).cast("long"), n, seed, False)
    return df.withColumn("slot", at).withColumns({"shard": (F.col("slot") % F.lit(shards)).cast("int"), "slot": _div(F.col("slot"), shards)})


def row_at(df: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``row``: the row number at its ``shard`` and ``slot``. The inverse of ``place``."""
    return df.withColumn("row", _walked(df.sparkSession, F.col("slot").cast("long") * F.lit(shards) + F.col("shard"), n, seed, True))


def number(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row``, their numbers from 0 in ``order``, which no two rows share; and how many there are."""
    part, at, total, before = spare(rows.columns, "part", "at", "total", "before")
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place of a row within its partition
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias(part), index.alias(at)), "dealt")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(total))  # a row for each range: no more than shuffle partitions
    sums = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(total).over(sums), F.lit(0)).alias(before))
    got = dealt.join(F.broadcast(starts), part).withColumn("row", F.col(before) + F.col(at)).drop(part, at, before)
    return got, sizes.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_id": F.col("doc_id").cast("long"), "_size": F.octet_length(text).cast("long") + 1, "_crc": F.crc32(text.cast("binary")).cast("long"), "_key": F.monotonically_increasing_id()})


def _placed(slim: DataFrame, shards: int, seed: int) -> DataFrame:
    rows, n = number(slim, ["_id", "_crc", "_size", "_key"])
    return place(rows, n, shards, seed)


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, row) of all documents; texts are read once and don't travel."""
    slim = written(_measured(docs.select("doc_id", "text")).select("_id", "_size", "_crc", "_key"), "measured")
    got = _placed(slim, shards, seed)
    return got.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, run: int = 100_000) -> DataFrame:
    """Write ``docs`` as Parquet below ``path``: a folder for each shard, whose files hold runs of ``run`` slots, each in order.

    The rows keep all their columns, in one column ``record``, beside ``shard`` and ``slot``; returns the table as read again.
    """
    base = written(_measured(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))).drop("doc_id", "text"), "records")
    placed = _placed(base.select("_id", "_size", "_crc", "_key"), shards, seed)
    rows = base.select("_key", "record").join(placed.select("_key", "shard", "slot"), "_key").select("shard", "slot", "record")
    dealt = rows.withColumn("run", _div(F.col("slot"), run)).repartition("shard", "run").sortWithinPartitions("shard", "slot").drop("run")
    dealt.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def oracle(shards: int = SHARDS, seed: int = SEED) -> str:
    """The same in DuckDB SQL: numbers by a window, check sums byte by byte, the walk by recursion."""
    bits = []  # a byte's check sum is the sum (mod 2) of those of its bits
    for i in range(8):
        c = 1 << i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        bits.append(f"(xor(s, x) >> {i} & 1) * {c}")
    table = bits[0]
    for bit in bits[1:]:
        table = f"xor({table}, {bit})"
    steps = []
    for i, (c1, m1, c2, m2) in enumerate(round_keys(seed)):
        moved, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        steps.append(f"({moved} + (({other} + {c1}) * {m1} % {PRIMES[0]} + {c2}) * {m2} % {PRIMES[1]}) % {size} AS {moved}, {other}")
    inner = f"(SELECT x0, a, b, n, x // b AS l, x % b AS r FROM {{src}})"
    for new in steps:
        inner = f"(SELECT x0, a, b, n, {new} FROM {inner})"
    once = lambda src: f"SELECT x0, l * b + r AS x, a, b, n FROM {inner.format(src=src)}"
    return f"""
        WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        d AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, hex(encode(text)) AS h FROM t),
        c AS (SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda i: CAST('0x' || i AS BIGINT))),
                  lambda s, x: xor(s >> 8, {table}))) AS crc FROM d),
        r AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS x0 FROM c),
        k AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, CAST(greatest(1, ceil(sqrt(n))) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM documents))),
        w AS ({once("(SELECT x0, x0 AS x, a, b, n FROM r, k)")} UNION ALL {once("(SELECT * FROM w WHERE x >= n)")})
        SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(x % {shards} AS INT) AS shard, x // {shards} AS slot, CAST(NULL AS INT) AS grown_shard
        FROM r JOIN w USING (x0) WHERE x < n"""
