"""Fill-in-middle: documents cut in three and put together as prefix, suffix, middle.

A text is ``n`` units, each a run of letters A-Z a-z or one other character.  One
``fullmatch`` of ``(unit)*`` by the ``regex`` library keeps every repetition of its group,
so ``ends(1)`` gives ``n`` and, at two hashed positions, both cuts.  Only a text of over
``BLOCK`` characters is matched in several blocks, each of which ends where a unit ends.

Cuts and form follow from the sha256 of ``seed:doc_id``.  A text that is empty or holds a
marker stays plain, so a marker in an output that is not plain is always the operator's
own and ``restore`` cuts there.

Defined results: a null text is an empty text (plain, n 0); a null doc_id counts as the
text ``null``; repeated rows give equal rows.  Columns other than doc_id and text are not
read.  A document is handled by itself: no shuffle, no join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import bounded_batches, by_bytes, documents, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*")
LETTERS = regex.compile(r"[A-Za-z]*")
#: Characters matched at once: bounds the captures that are held as Python numbers.
BLOCK = 1 << 18
#: Percent of documents that are cut, and of those in the order suffix, prefix, middle.
CUT_PERCENT, SPM_PERCENT = 90, 20


def unit_ends(text: str, block: int = BLOCK) -> np.ndarray:
    """The end of every unit of a text, in order."""
    found, at = [], 0
    while at < len(text):
        stop = min(at + block, len(text))
        if stop < len(text) and LETTERS.fullmatch(text, stop - 1, stop):
            stop = LETTERS.match(text, stop).end()  # a run of letters is one unit
        found.append(np.array(UNITS.fullmatch(text, at, stop).ends(1), dtype=np.int64))
        at = stop
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def transform(doc_id, text: str, seed: int = 1, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT,
              block: int = BLOCK) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    ends = unit_ends(text, block)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= cut_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 1, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT,
                   block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n, form (plain, psm, spm), prefix_chars,
    middle_chars (null if plain), output."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                ids = part.column("doc_id")
                done = [transform(i, t, seed, cut_percent, spm_percent, block)
                        for i, t in zip(ids.to_pylist(), part.column("text").to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, cut, put together and restored."""
    made = fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS x FROM documents),
h AS (
  SELECT *, len(u) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
    ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""
