"""Periodic runs of words: stretches that repeat themselves, found by seed and extend.

A run is a longest stretch of words with smallest period q and at least ``max(6, 4q)``
words.  On the diagonal of lag q (word i against word i + q) it is a stretch of at least
``k(q) = max(6 - q, 3q)`` matches, the minimum guaranteed overlap.

1. Words become numbers.  Only places whose five-word gram (the least overlap of all lags)
   comes again in the same document within a quarter of its words can lie in a run; the
   stretches of such places go on.
2. Lags are taken in classes (h, 2h].  The k(h + 1)-grams of a class are indexed, exactly,
   by doubling: a gram's number comes from the numbers of the two shorter grams that cover
   it.  Since k(h + 1) is not below the class's largest lag, two occurrences q apart inside
   a run of smallest period q have none between them, so the neighbouring occurrences of a
   gram are all pairs that are needed.
3. A pair (i, i + q) is extended both ways along its diagonal, word by word.  A table of the
   furthest place covered per lag suppresses the other seeds of the same stretch.

Defined results: a null text has no words and no run; a null doc_id is kept; repeated rows
give equal rows.  Columns other than doc_id and text are not read.  A document is handled
by itself in one task, its words as numbers: no shuffle, no join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import bounded_batches, by_bytes, documents, text_or_empty

#: A run has at least so many words, and at least so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: The least number of matches that a run has on its diagonal, over all lags.
GRAM = 5
#: Bytes of a text that are split into Python words at once.
SLICE = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"


def overlap(q: int) -> int:
    """Matches that a run of period q has on the diagonal of lag q, at least."""
    return max(MIN_WORDS, MIN_PERIODS * q) - q


def slices(raw: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of the text at a time."""
    at = 0
    while at < len(raw):
        stop = at + size
        while stop < len(raw) and raw[stop] not in SPACE:
            stop += 1
        yield raw[at:stop].split()  # bytes.split cuts at exactly these six characters
        at = stop


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number, not small, for each pair of numbers from 0 on."""
    return left * (int(right.max()) + 1 if len(right) else 1) + right


def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of pairs, from 0 on: equal pairs, and no others, have equal numbers."""
    return np.unique(paired(left, right), return_inverse=True)[1]


def neighbours(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag to the next occurrence) of all grams that come again."""
    order = np.argsort(grams, kind="stable")
    again = grams[order[1:]] == grams[order[:-1]]
    first, second = order[:-1][again], order[1:][again]
    return first, second - first


def candidates(x: np.ndarray, doc_ends: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [start, stop) of ``x`` outside of which no run lies.  ``x`` holds all
    documents of a batch, each followed by a number of its own."""
    if len(x) < GRAM:
        return []
    two = named(x[:-1], x[1:])
    four = named(two[:-2], two[2:])
    first, lag = neighbours(paired(four[:-1], x[GRAM - 1:]))
    doc = np.searchsorted(doc_ends, first, side="right")
    words = np.diff(np.concatenate([[0], doc_ends])) - 1
    # Grams that hold a document's own last number never come again, so equal neighbours
    # within a quarter of a document's words are in that document.
    near = (first + lag < doc_ends[doc]) & (lag <= words[doc] // MIN_PERIODS)
    hit = np.zeros(len(x) + 1, dtype=np.int8)
    hit[first[near]] = 1
    hit[(first + lag)[near]] = 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit])))
    return [(int(a), int(b) + GRAM - 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a > MIN_WORDS - GRAM]


def _matching(y: np.ndarray, at: int, q: int, step: int) -> int:
    """The end of the matches y[i] == y[i + q] from ``at`` on, forwards or backwards."""
    size = 32
    while True:
        if step > 0:
            a, b = at, min(at + size, len(y) - q)
            differ = np.flatnonzero(y[a:b] != y[a + q:b + q])
            if len(differ):
                return a + int(differ[0])
            at = b
            if b == len(y) - q:
                return b
        else:
            a, b = max(0, at - size), at
            differ = np.flatnonzero(y[a:b] != y[a + q:b + q])
            if len(differ):
                return a + int(differ[-1]) + 1
            at = a
            if a == 0:
                return 0
        size *= 2


def _seeded(y: np.ndarray, grams: np.ndarray, k: int, least: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) of ``y`` with a period of ``least`` to ``most``."""
    place, lag = neighbours(grams)
    fits = (lag >= least) & (lag <= most)
    place, lag = place[fits], lag[fits]
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    furthest: dict[int, int] = {}
    at = 0
    while at < len(place):
        i, q = int(place[at]), int(lag[at])
        start, stop = _matching(y, i, q, -1), _matching(y, i + k, q, 1)
        furthest[q] = stop
        if stop - start >= overlap(q):
            yield start, stop - start + q, q
        same = np.searchsorted(lag, q, side="right")
        at += int(np.searchsorted(place[at:same], furthest[q], side="left"))


def runs_of(x: np.ndarray, doc_ends: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start in ``x``, length, period) of the documents in ``x``."""
    parts = candidates(x, doc_ends)
    found = []
    h = 0
    grams_of: np.ndarray | None = None
    size = 1
    while True:
        least, most = h + 1, max(1, 2 * h)
        long = [p for p in parts if p[1] - p[0] >= max(MIN_WORDS, MIN_PERIODS * least)]
        if not long:
            return found
        if grams_of is None or len(long) < len(parts):
            # Stretches too short for this class and the next ones are left out.
            lengths = np.array([b - a for a, b in long])
            origin = np.concatenate([np.append(np.arange(a, b), -1) for a, b in long])
            y = np.where(origin >= 0, x[origin], 0)
            ends = np.cumsum(lengths + 1)
            y[ends - 1] = int(x.max()) + 1 + np.arange(len(long))  # a number of its own after each
            grams_of, size = y, 1
        parts = long
        k = overlap(least)
        while 2 * size <= k:
            grams_of, size = named(grams_of[:-size], grams_of[size:]), 2 * size
        grams = grams_of if size == k else paired(grams_of[:len(y) - k + 1], grams_of[k - size:])
        for start, length, q in _seeded(y, grams, k, least, most):
            found.append((int(origin[start]), length, q))
        h = most


def _numbered(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts as numbers, every text followed by a number of its own (its
    index), the texts' ends in it, and the words of the numbers after those."""
    numbers: dict[bytes, int] = defaultdict(count(len(raws)).__next__)
    parts, ends, total = [], [], 0
    for i, raw in enumerate(raws):
        for words in slices(raw):
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            total += len(words)
        parts.append(np.array([i]))
        total += 1
        ends.append(total)
    return np.concatenate(parts), np.array(ends), list(numbers)


def periodic(batch: pa.RecordBatch) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Per text of the batch: its runs (start, length, period) by start and period, and its
    words without the repetitions, joined by one space."""
    raws = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    x, ends, words = _numbered(raws)
    begins = np.concatenate([[0], ends[:-1]])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in raws]
    for start, length, q in runs_of(x, ends):
        doc = int(np.searchsorted(ends, start, side="right"))
        runs[doc].append((start - int(begins[doc]), length, q))
    texts = []
    for doc, own in enumerate(runs):
        own.sort(key=lambda r: (r[0], r[2]))
        ids = x[begins[doc]:ends[doc] - 1]
        if own:
            change = np.zeros(len(ids) + 1, dtype=np.int64)
            for start, length, q in own:
                change[start + q] += 1
                change[start + length] -= 1
            ids = ids[np.cumsum(change[:-1]) == 0]
        ids = ids - len(raws)
        texts.append(b" ".join(b" ".join(map(words.__getitem__, ids[at:at + SLICE].tolist())) for at in range(0, len(ids), SLICE)))
    return runs, texts


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapse_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period, by start and
    period), text: the words that no run repeats, joined by one space."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                runs, texts = periodic(part)
                flat = np.array([r for own in runs for r in own], dtype=np.int64).reshape(-1, 3)
                ends = np.cumsum([0] + [len(own) for own in runs])
                rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows),
                     pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "text"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, runs {RUNS}, text string")


WORDS = r"[^\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten, by crc32 of its doc_id, repeats a part of its
    words from a hashed word on; the others keep their text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    rows = rows.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"),
                       F.when(F.col("h") % 10 == 0, F.regexp_extract_all(text_or_empty(), F.lit(WORDS), F.lit(0))).alias("words"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    told = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    planted = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a").cast("int")), told)
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole text of ``documents``, with the planted ones."""
    found = collapse_runs(with_planted_runs(documents(spark, sf_dir)))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", "runs", "text", F.when(F.size("runs") > 0, best).alias("best"), F.array_join(lines, "").alias("lines"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


#: crc32 as in the sharding check.  Lags come from equal five-word grams of a document, runs
#: from islands of them; a stretch that has two periods is the run of the smaller one.
ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], [0::BIGINT, 0, 0, 0]),
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM range(16) r(i))),
ids AS (SELECT doc_id, text, string_split(hex(encode(coalesce(doc_id::VARCHAR, 'null'))), '') AS h FROM documents),
crc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295::BIGINT, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(1, len(h) + 1),
        lambda i: (strpos('0123456789ABCDEF', h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1)::BIGINT)),
      lambda c, d: xor(c >> 4, t[xor(c & 15, d) + 1]))) AS h
  FROM ids, tab),
plan AS (SELECT doc_id, w, h, h // 10 AS g, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM crc),
told AS (SELECT doc_id, n, w, a, 1 + (n - a) // (3 + g % 8) AS p FROM plan),
x AS (
  SELECT doc_id, n, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM told, unnest(range(n)) r(i)),
grams AS (
  SELECT *, CASE WHEN i + 4 < n THEN word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
    || ' ' || lead(word, 4) OVER o END AS gram FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram
         WHERE b.i > a.i AND (b.i - a.i) * 4 <= a.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM hits),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
told_runs AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, (-length, start, period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM x
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length)
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
  best.l * 1000 // best.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told_runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
