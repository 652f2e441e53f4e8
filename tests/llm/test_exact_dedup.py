import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import docs, rows
from trustlens.llm import exact_dedup as X


def brute(pairs):
    norm = [(i, re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode())) for i, t in pairs]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t).hexdigest()))
    return sorted(out, key=repr)


def test_fingerprints_compose():
    data = bytes(random.Random(1).randrange(256) for _ in range(1000))
    m = X.MODULI[0]
    direct = 0
    for b in data:
        direct = (direct * X.BASE + b + 1) % m
    for chunk in (7, 64, 4096):
        got = X.fingerprint_batch(pa.array([b"", data, data[:300], data[300:]], pa.binary()), m, X._powers(X.BASE, chunk, m), [1, pow(X.BASE, chunk, m)], chunk)
        assert got[0] == 0 and got[1] == direct
        assert X.combine(int(got[2]), int(got[3]), 700, m) == direct
    assert got.dtype == np.uint64


def test_huge_texts_are_hashed_in_parts(monkeypatch):
    data, m = bytes(range(256)) * 40, X.MODULI[1]
    how = (m, X._powers(X.BASE, 64, m), [1, pow(X.BASE, 64, m)], 64)
    whole = X.fingerprint_batch(pa.array([data], pa.binary()), *how)
    monkeypatch.setattr(X, "LONG_TEXT", 1000)
    assert X.fingerprint_batch(pa.array([data], pa.binary()), *how) == whole


@pytest.mark.parametrize("moduli", [X.MODULI, (3, 2)], ids=["usual", "collisions"])
def test_against_brute_force(spark, moduli):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \n\t") for _ in range(rnd.randrange(4))) for _ in range(150)]
    texts += [None, "", "é" * 5000 + " x", "é" * 5000 + "\n x", "z" * 20000, "z" * 20000, "z" * 19999 + "y"] + ["hot"] * 120
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    df = docs(spark, texts, ids, extra=[("keep_id", "string", "q"), ("h1", "double", 0.5), ("kept", "int", 3)])
    assert rows(X.exact_groups(df, moduli)) == brute(zip(ids, texts, strict=True))


def test_repeated_rows_null_ids_and_empty_table(spark):
    pairs = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "c"), (None, None), (4, "")]
    df = docs(spark, [t for _, t in pairs], [i for i, _ in pairs], extra=[("row", "string", "r"), ("n", "int", None)])
    assert rows(X.exact_groups(df)) == brute(pairs)
    left = X.drop_copies(df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(1, "a"), (1, "b"), (None, "c"), (4, "")], key=repr)
    assert rows(X.exact_groups(docs(spark, []))) == [] and rows(X.drop_copies(docs(spark, []))) == []


def test_a_class_of_a_third_of_the_rows_is_dealt_out(spark):
    from pyspark.sql import functions as F
    pairs = [(i, "copied  text" if i % 3 == 1 else f"text {i // 2}") for i in range(3000)]
    df = docs(spark, [t for _, t in pairs], [i for i, _ in pairs])
    assert rows(X.exact_groups(df)) == brute(pairs)
    prints = X.fingerprints(df)
    salts = X._salts(prints)
    assert salts == 55
    sums = [F.count(F.lit(1)).alias("n")]
    own = X._with_class(prints, X.KEY, sums, [F.sum("n").alias("n")], salts, F.col("n") > 2)
    assert own.count() == 1000 and own.select("n").distinct().collect() == [(1000,)]
    largest = own.groupBy(*X.KEY, F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(salts))).count().agg(F.max("count")).first()[0]
    assert largest < 45  # of 1000 rows in 55 salts
