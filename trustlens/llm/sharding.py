"""Sharding by weighted rendezvous hashing of stable record keys (law ``key``).

Every shard s scores a record ``-w_s / ln(u)``, u being a hash of (doc_id, s) in (0, 1);
the best score wins.  The doc_id and the shard count alone decide, and one more shard
takes records only into itself.  Under this law equal texts may lie in different shards.

Slots number a shard's records from 0 in the order of a second hash.  They come from
counts of hash ranges and ranks inside a range, so no task sorts a whole shard.

Defined results: a null text has no bytes (size 16, checksum 0); a null doc_id is a key
of its own; rows that repeat a doc_id lie in one shard in different slots.  Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens.llm.common import documents, text_or_empty
from trustlens.session import materialize

SHARDS = 40
RECORD_BYTES = 16
HASH_BITS = 52
#: Records that one task ranks, as an aim.
RANGE_ROWS = 65_536


def _hash52(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 ..) of best score; the lower shard wins a tie."""
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def score(e: Column) -> Column:
        u = (_hash52(key, e["i"].cast("string")) + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))
        return F.struct((-e["w"] / F.log(u)).alias("score"), (-e["i"]).alias("at"))

    return -F.array_max(F.transform(entries, score))["at"]


def _bits(rows: int, shards: int, range_rows: int) -> int:
    return min(HASH_BITS, max(0, (rows // (shards * range_rows)).bit_length()))


def assign_shards(docs: DataFrame, weights: list[float] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of
    weight 1), one row per document."""
    weights = weights or [1.0] * SHARDS
    raw = text_or_empty().cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    shard = rendezvous(key, weights)
    newcomer = len(weights)
    rows = (docs.select("doc_id", (F.octet_length(raw) + RECORD_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
            .withColumn("shard", shard)
            # The newcomer wins or the old winner stays: one comparison of two scores.
            .withColumn("grown_shard", _duel(key, F.col("shard"), newcomer, weights))
            .withColumn("place", _hash52(key, F.col("text_crc32").cast("string"), F.col("size").cast("string"))))
    rows = materialize(rows, "sharded")
    bits = _bits(rows.count(), len(weights), range_rows)
    rows = rows.withColumn("range", F.shiftright("place", HASH_BITS - bits))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    within = Window.partitionBy("shard", "range").orderBy("place", "doc_id", "text_crc32", "size")
    return (rows.withColumn("rank", F.row_number().over(within)).join(ranges, ["shard", "range"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("base") + F.col("rank") - 1).alias("slot"), "grown_shard"))


def _duel(key: Column, old: Column, new: int, weights: list[float]) -> Column:
    """The shard after one of weight 1 with index ``new`` joins."""
    def score(i: Column, w: Column) -> Column:
        u = (_hash52(key, i.cast("string")) + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))
        return -w / F.log(u)
    held = F.get(F.array(*[F.lit(float(w)) for w in weights]), old)
    return F.when(score(F.lit(new), F.lit(1.0)) > score(old, held), F.lit(new)).otherwise(old)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 39 of equal weight, law ``key``."""
    return assign_shards(documents(spark, sf_dir))


#: Checksums by half bytes; the table of 16 follows from the polynomial.
ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], [0::BIGINT, 0, 0, 0]),
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM range(16) r(i))),
k AS (SELECT doc_id, text, coalesce(doc_id::VARCHAR, 'null') AS key, strlen(coalesce(text, '')) + 16 AS size FROM documents),
texts AS (SELECT text, string_split(hex(encode(text)), '') AS h FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
crc AS (
  SELECT text, CASE WHEN text = '' THEN 0 ELSE xor(4294967295::BIGINT, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(1, len(h) + 1),
        lambda i: (strpos('0123456789ABCDEF', h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1)::BIGINT)),
      lambda c, d: xor(c >> 4, t[xor(c & 15, d) + 1]))) END AS text_crc32
  FROM texts, tab),
s AS (SELECT k.doc_id, k.key, k.size, c.text_crc32, i,
        -1 / ln((('0x' || substr(md5(k.key || ':' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496::DOUBLE) AS score
      FROM k JOIN crc c ON coalesce(k.text, '') = c.text, range(41) r(i)),
best AS (SELECT doc_id, size, text_crc32, key, arg_max(i, score) FILTER (i < 40) AS shard, arg_max(i, score) AS grown_shard
         FROM s GROUP BY ALL)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key || ':' || text_crc32 || ':' || size), 1, 13))::BIGINT, doc_id, text_crc32, size) - 1 AS slot,
  grown_shard::INT AS grown_shard
FROM best
"""
