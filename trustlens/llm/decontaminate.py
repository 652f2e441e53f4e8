"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of 10 consecutive words (a shorter item is one window).
Windows and documents are sets of placed shingles of five words (of all words, if a
window has fewer).  Shingles are ordered by how often they occur in the documents; a
window contained in a document shares all its shingles with it, so the prefix that must
be joined is its one rarest shingle, and a window with a shingle that no document has
is out at once.  The place of the shingle gives the place of the window: it must begin
in the document and end in it (positional and length bounds).  What is left is
verified by comparing the words themselves.

Defined results: a null text has no words, an item without words no windows.  Items
that share an id count once; an item without an id is named ``null``.  Rows that repeat
a doc_id are documents of their own.  Columns other than doc_id / item_id and text are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import documents, same, table, words_of
from trustlens.session import materialize

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
#: A benchmark table of at most so many bytes is broadcast; beyond it the joins shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of a value besides those of its text.
VALUE_BYTES = 16
#: Tells rows apart: doc_id may be null or repeated.
ROW = ["doc_id", "text_hash", "text_bytes"]


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"),
                       F.coalesce(F.octet_length("text"), F.lit(-1)).alias("text_bytes"))


def _starts(n: Column, size: int) -> Column:
    """0 .. n - size as an array, empty if that is negative."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _shingles(hashes: Column, size: int) -> Column:
    """array<struct<pos, tok>> of the shingles of ``size`` word hashes."""
    return F.transform(_starts(F.size(hashes), size), lambda i: F.struct(
        i.alias("pos"), F.xxhash64(F.lit(size), *[F.get(hashes, i + k) for k in range(size)]).alias("tok")))


def windows(items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Distinct (item, win): the windows of each item as word arrays."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words"))
    n = F.size("words")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))))
    return (words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, window))).alias("win"))
            .distinct())


def _value_bytes(name: str, kind: str) -> Column:
    if kind == "string":
        return F.coalesce(F.octet_length(name), F.lit(0)) + VALUE_BYTES
    if kind == "array<string>":
        return F.octet_length(F.concat_ws("", name)) + (F.size(name) + 1) * VALUE_BYTES
    return F.lit(VALUE_BYTES)


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if all its rows have at most BROADCAST_BYTES."""
    size = df.agg(F.sum(sum((_value_bytes(n, k) for n, k in df.dtypes), F.lit(0).cast("long")))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS,
                shingle: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, wins): rows ROW + n_words of all documents; hits ROW + start, n, win_id
    for every verified place of a window; wins win_id, item."""
    wins = materialize(windows(items, window).groupBy("win").agg(F.collect_set("item").alias("items"))
                       .select(F.sha2(F.concat_ws(" ", "win"), 256).alias("win_id"), "win", "items"), "benchmark_windows")
    sizes = sorted({min(shingle, r[0]) for r in wins.select(F.size("win")).distinct().collect()})  # at most ``shingle`` values
    placed = wins.select("win_id", F.size("win").alias("n"), _word_hashes(F.col("win")).alias("h"))
    by_size = F.lit(None).cast("array<struct<pos:int,tok:bigint>>")
    for s in sizes:
        by_size = F.when(F.least(F.lit(shingle), F.col("n")) == s, _shingles(F.col("h"), s)).otherwise(by_size)
    placed = materialize(placed.select("win_id", "n", F.inline(by_size).alias("offset", "tok")), "benchmark_shingles")

    tokens = _maybe_broadcast(placed.select("tok").distinct())
    hashed = (_with_row(docs).select(*ROW, words_of(F.col("text")).alias("words"))
              .select(*ROW, F.size("words").alias("n_words"), _word_hashes(F.col("words")).alias("h")))
    # One row of its own keeps each document, found or not, in the same pass.
    summary = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("tok")))
    found = (hashed.select(*ROW, "n_words", F.inline(F.concat(summary, *[_shingles(F.col("h"), s) for s in sizes])).alias("pos", "tok")))
    known = tokens.withColumn("known", F.lit(True)).withColumnRenamed("tok", "known_tok")
    found = (found.join(known, F.col("tok") == F.col("known_tok"), "left")
             .filter("known OR pos = -1").select(*ROW, "n_words", "pos", "tok"))
    found = materialize(found, "document_shingles")
    rows = found.filter("pos = -1").select(*ROW, "n_words")
    found = found.filter("pos >= 0").distinct()  # rows that repeat wholly have the same places

    # Rarity over all documents; a window's prefix is its rarest shingle.
    rarity = found.groupBy("tok").agg(F.count(F.lit(1)).alias("freq"))
    prefix = (placed.join(rarity, "tok", "left")
              .groupBy("win_id", "n").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "offset", "tok")).alias("first"))
              .filter("first.freq > 0").select("win_id", "n", F.col("first.offset").alias("offset"), F.col("first.tok").alias("tok")))
    prefix = materialize(prefix, "benchmark_prefixes")
    start = F.col("pos") - F.col("offset")
    candidates = (found.join(_maybe_broadcast(prefix), "tok").filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
                  .select(*ROW, start.alias("start"), "n", "win_id"))
    candidates = materialize(candidates, "window_candidates")

    # Verification on the words of the documents that have candidates.
    held = candidates.groupBy(*ROW).agg(F.collect_set(F.struct("start", "n", "win_id")).alias("places"))
    texts = _with_row(docs)
    held = held.select(*[F.col(c).alias(f"c_{c}") for c in ROW], "places")
    near = (texts.join(held, (texts.text_hash == held.c_text_hash) & (texts.text_bytes == held.c_text_bytes) & texts.doc_id.eqNullSafe(held.c_doc_id))
            .select(*ROW, words_of(F.col("text")).alias("words"), "places")
            .select(*ROW, F.inline(F.transform("places", lambda p: F.struct(
                p["start"].alias("start"), p["n"].alias("n"), p["win_id"].alias("win_id"), F.slice("words", p["start"] + 1, p["n"]).alias("seen"))))))
    texts_of = wins.select("win_id", "win")
    hits = (near.join(_maybe_broadcast(texts_of), "win_id").filter(F.col("seen") == F.col("win"))
            .select(*ROW, "start", "n", "win_id").distinct())
    return rows, materialize(hits, "window_hits"), wins.select("win_id", F.explode("items").alias("item"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, text_hash, text_bytes, n_words, n_hit, n_items,
    items_sha256, contaminated."""
    rows, hits, wins = window_hits(docs, items, window, shingle)
    words = (hits.select(*ROW, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct()
             .groupBy(*ROW).agg(F.count(F.lit(1)).alias("n_hit")))
    named = (hits.select(*ROW, "win_id").distinct().join(wins, "win_id").select(*ROW, "item").distinct()
             .groupBy(*ROW).agg(F.sort_array(F.collect_list("item")).alias("items")))
    hit = words.join(named, same(words, named, *ROW)).select(*[words[c].alias(f"h_{c}") for c in ROW], "n_hit", "items")
    on = (rows.text_bytes == hit.h_text_bytes) & rows.text_hash.eqNullSafe(hit.h_text_hash) & rows.doc_id.eqNullSafe(hit.h_doc_id)
    return rows.join(hit, on, "left").select(
        "doc_id", "text_hash", "text_bytes", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of an item, all columns kept."""
    bad = contamination(docs, items).filter("contaminated").select(*[F.col(c).alias(f"bad_{c}") for c in ROW]).distinct()
    row_hash, row_bytes = F.xxhash64(docs["text"]), F.coalesce(F.octet_length(docs["text"]), F.lit(-1))
    return docs.join(bad, (row_hash == bad.bad_text_hash) & (row_bytes == bad.bad_text_bytes) & docs["doc_id"].eqNullSafe(bad.bad_doc_id), "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against whole ``benchmark``."""
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("text_hash", "text_bytes")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, ws[i + 1 : i + 10] AS win FROM b, LATERAL unnest(range(greatest(len(ws) - 9, 1))) r(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
dw AS (SELECT doc_id, i, n, ws[i + 1 : i + n] AS win FROM w, lens, LATERAL unnest(range(greatest(len(ws) - n + 1, 0))) r(i)),
hit AS (SELECT DISTINCT doc_id, i, n, item FROM dw JOIN win USING (win)),
nh AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM hit, LATERAL unnest(range(i, i + n)) r(place) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
