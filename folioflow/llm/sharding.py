"""Shards by rendezvous hashing of record keys over weighted shards.

Every shard draws a number in (0, 1) for a key from a digest of key and shard, and bids -ln(number) / weight; the least
bid has the key. Bids depend on nothing but key and shard, so a new shard takes keys only into itself, a removed one
gives up only its own, and a changed weight moves keys only from or to that shard; shares follow the weights.

Placing rows is a map. Slots (gapless places in a shard) are numbered without gathering a shard: rows alike are counted as
one, each shard falls into `BUCKETS` parts numbered on their own, and the parts' sizes are summed (at most
shards * `BUCKETS` rows). The numbering depends on the rows alone, not on files, partitions or retries.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import materialize, table

SHARDS = 40
#: Parts of a shard: 16 ** 2, by two digits of a digest.
BUCKETS = 256
#: Rows alike that one task writes out; more of them are dealt out to several.
RUN = 1 << 16


def weights_of(shards: int | Mapping[int, float]) -> dict[int, float]:
    """Weights by shard id; a number of shards stands for the ids from 0 of weight 1."""
    out = {i: 1.0 for i in range(shards)} if isinstance(shards, int) else {int(k): float(v) for k, v in shards.items()}
    if not out or min(out.values()) <= 0 or max(out.values()) == float("inf"):
        raise ValueError("there must be a shard, and weights must be positive and finite")
    return out


def key_text(key: str | Column) -> Column:
    """A key as text; a null key is `null`."""
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null"))


def bids(key: Column, weights: Mapping[int, float]) -> Column:
    """The least (bid, drawn, shard) of the shards; equal bids go to the greater number drawn, then to the lesser id."""
    each = F.array(*(F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in sorted(weights.items())))

    def bid(s: Column) -> Column:
        # 13 hexadecimal digits are 52 bits: exact as a double, and never 0 or 1 when a half is added
        drawn = F.conv(F.substring(F.md5(F.concat_ws(":", key, s["shard"]).cast("binary")), 1, 13), 16, 10).cast("long")
        cost = -F.log((drawn + F.lit(0.5)) / F.lit(float(1 << 52))) / s["weight"]
        return F.struct(cost.alias("bid"), (-drawn).alias("drawn"), s["shard"].alias("shard"))

    return F.array_min(F.transform(each, bid))


def shard_of(key: str | Column, shards: int | Mapping[int, float] = SHARDS) -> Column:
    """The shard of a key."""
    return bids(key_text(key), weights_of(shards))["shard"]


def grown_shard_of(key: str | Column, shards: int | Mapping[int, float] = SHARDS, weight: float = 1.0) -> tuple[Column, Column]:
    """The shard of a key, and its shard once there is one more (of the next id)."""
    now = weights_of(shards)
    text = key_text(key)
    best, new = bids(text, now), bids(text, {max(now) + 1: weight})
    return best["shard"], F.least(best, new)["shard"]


def with_slots(rows: DataFrame, shard: str, key: str, digest: str) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard.

    In order of a digest of key and row, then of all columns. All columns must be orderable and none be called `slot`, `_n`,
    `_part`, `_upto` or `_from`; rows alike in every column share a run of slots.
    """
    spark = rows.sparkSession
    part = F.substring(F.md5(F.concat_ws(":", key_text(key), F.col(digest)).cast("binary")), 1, 2)
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).withColumn("_part", part)
    order = Window.partitionBy(shard, "_part").orderBy(*rows.columns).rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(alike.withColumn("_upto", F.sum("_n").over(order)))
    parts = local.groupBy(shard, "_part").agg(F.sum("_n").alias("_size"))
    earlier = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.select(shard, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")))
    # BUCKETS rows for each shard at most
    placed = local.join(F.broadcast(parts), [shard, "_part"])
    placed = placed.withColumn("_from", F.col("_before") + F.col("_upto") - F.col("_n"))
    few = placed.where(F.col("_n") <= RUN).select(*rows.columns, "_from", "_n")
    many = placed.where(F.col("_n") > RUN).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    many = many.select(*rows.columns, (F.col("_from") + F.col("_at")).alias("_from"), F.least(F.col("_n") - F.col("_at"), F.lit(RUN)).alias("_n"))
    runs = few.unionByName(many.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_from"))
    return runs.select(*rows.columns, F.explode(F.sequence("_from", F.col("_from") + F.col("_n") - 1)).alias("slot"))


def assign_shards(docs: DataFrame, shards: int | Mapping[int, float] = SHARDS, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of each row's key in column `name`, which takes the place of a column of that name.

    A map: no row is moved. A null key counts as the text `null`; rows of one key share a shard; an empty table stays empty.
    """
    return docs.withColumn(name, shard_of(key, shards))


def write_shards(docs: DataFrame, path: str, shards: int | Mapping[int, float] = SHARDS, key: str = "doc_id", files: int = 1) -> None:
    """docs as Parquet, a folder `shard=N` for each shard, dealt out to about `files` files a shard.

    Files of a shard hold ranges of a digest of key and text, so a hot key falls into several. The rows' own columns
    are written as they are, but for a column `shard`, which is replaced.
    """
    spread = F.pmod(F.xxhash64(key_text(key), *(c for c in ("text",) if c in docs.columns)), F.lit(files))
    placed = assign_shards(docs, shards, key)
    placed.repartition(len(weights_of(shards)) * files, "shard", spread).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int | Mapping[int, float] = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): the place of each row of docs.

    size: UTF-8 bytes of the text and 16; a null text is empty. grown_shard: the shard once there is one more. A null doc_id
    is kept and placed as the text `null`; repeated rows have slots of their own; other columns are ignored; an
    empty table gives no rows.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    now, grown = grown_shard_of("doc_id", shards)
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        now.alias("shard"), grown.alias("grown_shard"), F.md5(text).alias("digest"),
    )
    out = with_slots(rows, "shard", "doc_id", "digest")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


#: With equal weights the least bid is the greatest number drawn; crc32 goes byte by byte, with the table of its reversed polynomial.
SQL = r"""
WITH bits AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS body, md5(coalesce(text, '')) AS digest, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents
), sized AS (
  SELECT doc_id, k, digest, octet_length(body) + 16 AS size,
    list_transform(regexp_extract_all(hex(body), '..'), lambda x: (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1) AS bytes FROM d
), crc AS (
  SELECT doc_id, k, digest, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM sized, bits
), placed AS (
  SELECT *, list_aggregate(list_transform(range(40), lambda s: {'d': md5(k || ':' || s)[1:13], 's': -s}), 'max') AS best, md5(k || ':40')[1:13] AS new FROM crc
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(-best.s AS INT) AS shard,
  row_number() OVER (PARTITION BY best.s ORDER BY md5(k || ':' || digest)[1:2], doc_id NULLS FIRST, size, text_crc32, digest) - 1 AS slot,
  CAST(CASE WHEN new > best.d THEN 40 ELSE -best.s END AS INT) AS grown_shard
FROM placed
"""
