"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of bytes ``b_0 .. b_{n-1}`` is ``sum((b_i + 1) * B^(n-1-i)) mod p``,
taken for two primes.  It composes: ``H(xy) = H(x) * B^len(y) + H(y)``, so chunks are
hashed independently and put together by length-shifted arithmetic.  Texts with equal
fingerprint and length are then compared chunk by chunk with the text of the smallest
doc_id of their class; a text that differs (a collision) starts a new class.  Rows meet
their class by class and salt, so that a class of any size is dealt over tasks.

Defined results: a null text is an empty text and all empty texts are copies.  A null
doc_id is a document like any other and is larger than any number.  Rows that repeat
both doc_id and text count separately in ``group_size``; if they carry the smallest
doc_id, all are marked kept (``drop_copies`` leaves one).  Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import bounded_batches, by_bytes, documents, same, text_or_empty
from trustlens.session import materialize

CHUNK = 4096
BASE = 1_000_003
#: Two primes below 2^31: a product of two residues fits 64 bits.
MODULI = (2_147_483_647, 2_147_483_629)
#: Bytes of one text that are hashed at once.
LONG_TEXT = 1 << 22
#: Members that share one copy of their representative's chunks.
MEMBERS_PER_SALT = 512

SPACE_RUN = r"[\x20\x09-\x0D]+"
KEY = ["n_bytes", "h1", "h2"]


def combine(left: int, right: int, right_bytes: int, modulus: int) -> int:
    """Fingerprint of a concatenation from the fingerprints of its parts."""
    return (left * pow(BASE, right_bytes, modulus) + right) % modulus


def _powers(base: int, n: int, modulus: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * base % modulus
    return out


def _fingerprint_long(text: pa.Scalar, modulus: int, small: np.ndarray, large: list[int], chunk: int) -> int:
    """A huge text's fingerprint, from those of its parts."""
    raw, total = text.as_buffer(), 0
    for at in range(0, raw.size, LONG_TEXT):
        part = raw.slice(at, min(LONG_TEXT, raw.size - at))
        own = fingerprint_batch(pa.array([part.to_pybytes()], pa.large_binary()), modulus, small, large, chunk)
        total = combine(total, int(own[0]), part.size, modulus)
    return total


def fingerprint_batch(texts: pa.Array, modulus: int, small: np.ndarray, large: list[int],
                      chunk: int = CHUNK) -> np.ndarray:
    """Fingerprints of all texts of a batch: chunk hashes by one segmented sum, then a
    segmented sum of the hashes shifted by the bytes that follow their chunk."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    lengths = np.diff(offsets)
    if len(texts) == 1 and lengths[0] > LONG_TEXT:
        return np.array([_fingerprint_long(texts[0], modulus, small, large, chunk)], dtype=np.uint64)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    starts, lengths = (offsets[:-1] - offsets[0])[full], lengths[full]
    n_chunks = -(-lengths // chunk)
    first = np.concatenate([[0], np.cumsum(n_chunks)[:-1]])
    number = np.arange(n_chunks.sum()) - np.repeat(first, n_chunks)
    begin = np.repeat(starts, n_chunks) + number * chunk
    size = np.minimum(chunk, np.repeat(lengths, n_chunks) - number * chunk)
    after = np.repeat(lengths, n_chunks) - number * chunk - size
    exponent = np.repeat(begin + size - 1, size) - np.arange(len(data))
    weighted = (data.astype(np.uint64) + np.uint64(1)) * small[exponent]
    hashed = np.add.reduceat(weighted, begin) % np.uint64(modulus)
    while len(large) <= int(after.max()) // chunk:
        large.append(large[-1] * large[1] % modulus)
    shift = small[after % chunk] * np.array(large, dtype=np.uint64)[after // chunk] % np.uint64(modulus)
    out[full] = np.add.reduceat(hashed * shift % np.uint64(modulus), first) % np.uint64(modulus)
    return out


def _fingerprinter(moduli: tuple[int, int], chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(m, _powers(BASE, chunk, m), [1, pow(BASE, chunk, m)]) for m in moduli]
        for b in batches:
            for part in by_bytes(b, "text"):
                h = [pa.array(fingerprint_batch(part.column("text"), *t, chunk).astype(np.int64)) for t in tables]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_sha256"), part.column("n_bytes"), *h],
                                                 names=["doc_id", "text_sha256", *KEY])
    return run


def _normalised(docs: DataFrame) -> DataFrame:
    norm = F.regexp_replace(text_or_empty(), SPACE_RUN, " ")
    return docs.select("doc_id", norm.alias("text")).select(
        "doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("text").cast("long").alias("n_bytes"))


def fingerprints(docs: DataFrame, moduli=MODULI, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, text_sha256, n_bytes, h1, h2."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _normalised(docs).mapInArrow(_fingerprinter(moduli, chunk), f"doc_id {kind}, text_sha256 string, n_bytes long, h1 long, h2 long")


def _chunker(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.drop_columns(["text"])
            texts = b.column("text").cast(pa.large_binary())
            for i in range(len(b)):
                raw = texts[i].as_buffer()
                for at in range(0, max(1, raw.size), 256 * chunk):  # a few chunks at a time
                    part = raw.slice(at, min(256 * chunk, raw.size - at))
                    cut = [part.slice(k, min(chunk, part.size - k)).to_pybytes() for k in range(0, max(1, part.size), chunk)]
                    taken = rows.take(pa.array([i] * len(cut)))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(range(at // chunk, at // chunk + len(cut)), pa.int64()), pa.array(cut, pa.binary())],
                        names=[*taken.schema.names, "chunk_no", "chunk"])
    return run


def _differing(members: DataFrame, chunk: int) -> DataFrame:
    """Members (KEY, doc_id, text_sha256, rep_id, rep_sha, salts, text) whose text is not
    their representative's, by a join of chunks.  A hot class is dealt over ``salts``."""
    kind = members.schema["doc_id"].dataType.simpleString()
    pieces = members.mapInArrow(
        _chunker(chunk),
        f"n_bytes long, h1 long, h2 long, doc_id {kind}, text_sha256 string, rep_id {kind}, rep_sha string, salts long, chunk_no long, chunk binary")
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_sha256") == F.col("rep_sha"))
    # Repeated rows of the representative are equal by id and digest; one copy is enough.
    reps = (pieces.filter(is_rep).groupBy(*KEY, "salts", "chunk_no").agg(F.min("chunk").alias("rep_chunk"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts"))
    own = pieces.filter(~is_rep).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.col("salts")))
    joined = own.join(reps, [*KEY, "chunk_no", "salt"], "left")
    return (joined.groupBy("doc_id", "text_sha256", *KEY)
            .agg(F.bool_and(F.col("chunk").eqNullSafe(F.col("rep_chunk"))).alias("equal"))
            .filter(~F.col("equal")).drop("equal"))


def _salts(rows: DataFrame) -> int:
    """The square root of the row count: a class of n rows is dealt over so many salts,
    and has at most so many rows where its salts' sums meet."""
    return math.isqrt(rows.count()) + 1


def _with_class(rows: DataFrame, keys: list[str], part: list[Column], whole: list[Column], salts: int, keep: Column | None = None) -> DataFrame:
    """Rows with the columns ``whole`` of their class (which adds up the salts' ``part``);
    only those of classes that ``keep`` holds for.  Rows meet by class and salt, never a
    whole class in one task."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(salts)))
    parts = salted.groupBy(*keys, "salt").agg(*part)
    total = parts.groupBy(*keys).agg(*whole)
    if keep is not None:
        total = total.filter(keep)
    return salted.join(parts.select(*keys, "salt").join(total, keys), [*keys, "salt"]).drop("salt")


def exact_groups(docs: DataFrame, moduli=MODULI, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = materialize(fingerprints(docs, moduli, chunk), "exact_fingerprints")
    classes = prints.withColumn("class", F.lit(0))
    pending, level, salts = prints, 0, _salts(prints)
    while True:
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256")
        # Members by joins of rows without texts; texts join them by document, so that a
        # hot class is dealt evenly.
        shared = _with_class(pending, KEY, [F.count(F.lit(1)).alias("n"), F.min(order).alias("rep")],
                             [F.sum("n").alias("n"), F.min("rep").alias("rep")], salts, F.col("n") > 1)
        asked = shared.groupBy("doc_id", "text_sha256").agg(F.first(F.struct(
            *KEY, F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_sha256").alias("rep_sha"),
            F.ceil(F.col("n") / MEMBERS_PER_SALT).cast("long").alias("salts"))).alias("of"))
        texts = _normalised(docs)
        members = texts.join(asked, same(texts, asked, "doc_id", "text_sha256")).select("of.*", texts.doc_id, texts.text_sha256, "text")
        members = members.select(*KEY, "doc_id", "text_sha256", "rep_id", "rep_sha", "salts", "text")
        differ = materialize(_differing(members, chunk), "exact_differing")
        if differ.isEmpty():
            break
        level += 1
        moved = differ.select("doc_id", "text_sha256", F.lit(level).alias("new_class")).distinct()
        classes = (classes.join(moved, same(classes, moved, "doc_id", "text_sha256"), "left")
                   .select(classes.doc_id, classes.text_sha256, *KEY, F.coalesce("new_class", "class").alias("class")))
        classes, pending = materialize(classes, "exact_classes"), differ
    key = [*KEY, "class"]
    grouped = _with_class(classes, key, [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")],
                          [F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")], salts)
    return grouped.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.  Of rows
    that repeat doc_id and text, one (any) stays."""
    own = docs.select(F.struct(*docs.columns).alias("row"), "doc_id",
                      F.sha2(F.regexp_replace(text_or_empty(), SPACE_RUN, " ").cast("binary"), 256).alias("text_sha256"))
    keep = exact_groups(docs).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    keep = materialize(keep, "exact_keep")
    rows = own.join(keep, same(own, keep, "doc_id", "text_sha256")).select("row", own.doc_id, own.text_sha256, "times")
    if keep.filter("times > 1").isEmpty():
        return rows.select("row.*")
    many = rows.filter("times > 1").groupBy("doc_id", "text_sha256").agg(F.any_value("row").alias("row"))
    return rows.filter("times = 1").select("row.*").unionByName(many.select("row.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of the whole table ``documents``."""
    return exact_groups(documents(spark, sf_dir))


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
