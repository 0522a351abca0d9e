"""A uniform shuffle into shards of exact size, in DataFrame operations only.

Rows are dealt to logical partitions by a keyed hash. A communication matrix of
multivariate hypergeometric draws says how many rows of each partition go to
each shard; this is the law of a uniform shuffle into shards of given sizes.
Each partition is permuted locally and cut by its matrix row, the pieces are
exchanged, and each shard is permuted again. Ranks are taken within partitions,
and within fine buckets of a shard, whose number follows the row count, so that
no shard passes through one task.

Each row has a number of its own from the first pass, which is written out before
anything is dealt; so rows that are equal are dealt apart like any others, and a
task that runs again finds the same numbers.

Only the partitions' counts (at most MOST_PARTS) reach the driver, and only the
matrix (at most MOST_PARTS rows) and the buckets' offsets go back.

Defined results: null text has no bytes; rows that repeat each get a slot of
their own; null doc_ids are dealt like others; an empty table gives no rows;
sharded() ignores extra columns; write_shards() keeps them, and a column named
`shard` or `slot` gets underscores behind its name.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

#: Rows that a logical partition, or a bucket of a shard, holds on average while there are fewer than MOST_PARTS.
PART_ROWS, MOST_PARTS = 500, 4096


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good: Stadlober's ratio of uniforms, or plain draws for small n."""
    if n > (good + bad) // 2:
        return good - hypergeometric(rng, good, bad, good + bad - n)
    if good > bad:
        return n - hypergeometric(rng, bad, good, n)
    if n <= 10 or good == 0:
        out, left, pool = 0, good, good + bad
        for _ in range(n if good else 0):
            hit = rng.randrange(pool) < left
            out, left, pool = out + hit, left - hit, pool - 1
        return out
    pool, share = good + bad, good / (good + bad)
    mid = n * share + 0.5
    width = math.sqrt((pool - n) * n * share * (1 - share) / (pool - 1) + 0.5)
    spread, top = 1.7155277699214135 * width + 0.8989161620588988, math.floor((n + 1) * (good + 1) / (pool + 2))
    weight = lambda k: math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1)
    peak, most = weight(top), min(n, good) + 1
    while True:
        u, v = 1 - rng.random(), rng.random()
        w = mid + spread * (v - 0.5) / u
        if 0 <= w < most and 2 * math.log(u) <= peak - weight(math.floor(w)):
            return math.floor(w)


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of partition p that go to shard s; row sums are counts, column sums are sizes."""
    rng, left, out = random.Random(seed), list(sizes), []
    for count in counts:
        row, pool = [], sum(left)
        for have in left:
            pool -= have
            row.append(hypergeometric(rng, have, pool, count))
            count -= row[-1]
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _key(seed: int, salt: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), "_row", "doc_id", "text_crc32", "size")


def _numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """_row, doc_id, size and text_crc32 of every row, written out."""
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    return stored(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", size, crc, *more), "rows")


def _placed(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """_row, doc_id, size, text_crc32, shard, slot of every row."""
    names = ["_row", "doc_id", "size", "text_crc32"]
    rows = rows.select(*names)
    total = rows.count()
    parts = min(MOST_PARTS, max(1, math.ceil(total / PART_ROWS)))
    fine = min(MOST_PARTS, max(1, math.ceil(total / shards / PART_ROWS)))
    dealt = rows.withColumn("part", F.pmod(_key(seed, 1), F.lit(parts)).cast("int"))
    counts = {x.part: x["count"] for x in dealt.groupBy("part").count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shard_sizes(total, shards), seed)
    ends = [{"part": p, "ends": [sum(row[: s + 1]) for s in range(shards)]} for p, row in enumerate(matrix)]
    cuts = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<part:int,ends:array<long>>>")))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(_key(seed, 2), "_row")) - 1
    sent = dealt.withColumn("rank", rank).join(F.broadcast(cuts), "part")
    shard = F.size(F.filter("ends", lambda x: x <= F.col("rank")))
    sent = stored(sent.select(*names, shard.alias("shard"), F.pmod(_key(seed, 3), F.lit(fine)).cast("int").alias("bucket")), "sent")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(_key(seed, 4), "_row")) - 1
    out = sent.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "bucket"])
    return out.select(*names, "shard", (F.col("offset") + F.col("rank")).alias("slot"))


def sharded(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text); law `rows`."""
    rows = _numbered(docs)
    out = _placed(rows, shards, seed)
    forget(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 7) -> None:
    """Writes docs (doc_id, text, ...) to path/shard=s, each file in slot order."""
    rows = _numbered(docs, F.struct("*").alias("_doc"))
    placed = _placed(rows, shards, seed).select("_row", "shard", "slot")
    out = rows.select("_row", "_doc").join(placed, "_row")
    names, taken = [], {"shard", "slot"}
    for c in docs.columns:
        name = c
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(F.col("_doc").getField(c).alias(name))
    out = out.select(*names, "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
    forget(rows)
