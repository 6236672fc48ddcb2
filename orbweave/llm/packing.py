"""Length buckets of least padding, and token-budget batches inside each bucket.

The histogram of token counts covers all texts and is exact: one bin for each length that occurs. d different lengths
need d² / 2 tokens at least, so bins grow as the square root of the corpus at most. Dynamic programming over it places
``n_buckets`` boundaries such that padding every text to the boundary above costs the fewest tokens; as the
cost of a bucket is linear in its boundary, each layer of the programme is one sweep along a convex hull of lines.

A batch of a bucket holds as many texts as fit the token budget at the bucket's length (one text at
least). Batches form within shards of a bucket, so no bucket is sorted in one task; each shard leaves
one batch unfilled at most. Rows are dealt to shards by id, length and place in the table, so neither equal rows
nor rows without an id meet in one shard; the number of shards follows the number of rows.

Defined cases: a null or empty text has no tokens and is in no bucket (bucket and batch are null, padded
to 0); repeated rows are packed each on their own; ties go in order of doc_id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written
from .token_counts import count_tokens

SHARD_ROWS = 4096


def boundaries(histogram: list[tuple[int, int]], n_buckets: int) -> list[int]:
    """Bucket lengths, ascending, for (length, count) bins: padding is least; the fewest buckets among equals."""
    bins = sorted((length, n) for length, n in histogram if length > 0 and n > 0)
    m = len(bins)
    if not m:
        return []
    total = [0]
    for _, n in bins:
        total.append(total[-1] + n)
    length = [b[0] for b in bins]
    cost: list[int | None] = [0] + [None] * m  # of the first j bins in k buckets
    choice: list[array] = []
    best = None
    for k in range(1, min(n_buckets, m) + 1):
        hull: list[tuple[int, int, int]] = []  # lines (slope, intercept, i), slopes falling
        new: list[int | None] = [None] * (m + 1)
        back = array("l", bytes(array("l").itemsize * (m + 1)))
        at = 0
        for j in range(1, m + 1):
            i = j - 1
            if cost[i] is not None:
                line = (-total[i], cost[i], i)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            x = length[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if hull:
                new[j], back[j] = hull[at][0] * x + hull[at][1] + x * total[j], hull[at][2]
        choice.append(back)
        cost = new
        if best is None or cost[m] < best[0]:
            best = (cost[m], k)
    out, j = [], m
    for k in range(best[1] - 1, -1, -1):
        out.append(length[j - 1])
        j = choice[k][j]
    return out[::-1]


def pack(lengths: DataFrame, n_buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """Rows (doc_id, n_tokens) with bucket, padded_to, batch (unique over the corpus) and slot in the batch.

    ``lengths`` is read several times: pass a written table.
    """
    sized = lengths.select(F.col("doc_id").cast("long"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
    histogram = [(r.n_tokens, r["count"]) for r in sized.groupBy("n_tokens").count().collect()]
    edges = boundaries(histogram, n_buckets)
    bucket = padded = F.lit(None)
    room = F.lit(1)
    shards = F.lit(1)
    empty = F.lit(max(1, -(-sum(n for length, n in histogram if length <= 0) // SHARD_ROWS)))
    for i in range(len(edges) - 1, -1, -1):
        below = edges[i - 1] if i else 0
        rows = sum(n for length, n in histogram if below < length <= edges[i])
        fits = F.col("n_tokens") <= edges[i]
        bucket = F.when(fits, F.lit(i)).otherwise(bucket)
        padded = F.when(fits, F.lit(edges[i])).otherwise(padded)
        shards = F.when(fits, F.lit(-(-rows // SHARD_ROWS))).otherwise(shards)
        room = F.when(fits, F.lit(max(1, budget // edges[i]))).otherwise(room)
    some = F.col("n_tokens") > 0
    shard = F.pmod(F.xxhash64("doc_id", "n_tokens", F.monotonically_increasing_id()), F.when(some, shards).otherwise(empty).cast("long"))
    rows = sized.select("doc_id", "n_tokens", F.when(some, bucket).cast("int").alias("bucket"), F.when(some, padded).otherwise(0).cast("long").alias("padded_to"), room.cast("int").alias("room"), shard.alias("shard"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    rows = rows.withColumn("place", place)
    batch = F.when(F.col("bucket").isNotNull(), F.format_string("%d.%d.%d", F.col("bucket"), F.col("shard"), F.floor(F.col("place") / F.col("room"))))
    return rows.select("doc_id", "n_tokens", "bucket", "padded_to", batch.alias("batch"), F.when(F.col("bucket").isNotNull(), F.pmod("place", "room")).cast("int").alias("slot"))


def pack_texts(docs: DataFrame, n_buckets: int = 16, budget: int = 65_536, path: str | None = None) -> DataFrame:
    """``pack`` of the token counts of ``docs``."""
    return pack(written(count_tokens(docs, path).select("doc_id", "n_tokens"), "lengths"), n_buckets, budget)
