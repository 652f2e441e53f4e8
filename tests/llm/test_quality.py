import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import docs, rows
from trustlens.llm import quality as Q


def test_forward_backward_against_all_labelings():
    rnd = np.random.default_rng(1)
    lines = np.array([1, 4, 2, 5])
    unary, pair = rnd.normal(size=lines.sum()), rnd.normal(size=(2, 2))
    _, _, good = Q.chain(unary, lines, pair)
    at = 0
    for n in lines:
        total, won = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + t] * y[t] for t in range(n)) + sum(pair[y[t], y[t + 1]] for t in range(n - 1)))
            total += w
            won += w * np.array(y)
        assert np.allclose(good[at:at + n], won / total)
        at += n


def features(*texts):
    return Q.line_features(*Q._layout(pa.array(texts)))


def test_line_features():
    k = {n: i for i, n in enumerate(Q.FEATURES)}
    n = len(Q.FEATURES)
    x, size, lines = features("AB cd\n\n12 | 12 12!", "", "x x x\nx x x")
    assert lines.tolist() == [3, 1, 2] and size.tolist() == [5, 0, 11, 0, 5, 5]
    assert x[0, k["upper"]] == 0.5 and x[0, k["space"]] == np.float32(0.2)
    assert x[2, k["pipe"]] == 0.25 and x[2, k["mark"]] == 0.25 and x[2, k["digit"]] == np.float32(6 / 11)
    assert x[4, k["echo"]] == np.float32(2 / 3) and x[5, k["echo"]] == 1 and x[4, k["repeated"]] == 1
    assert not x[0, n:2 * n].any() and (x[1, n:2 * n] == x[0, :n]).all() and (x[0, 2 * n:] == x[1, :n]).all()
    assert not x[3, n:].any()  # neighbours do not cross documents
    alone = features("x x x\nx x x")[0]
    assert np.array_equal(x[4:], alone)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 8)))
    texts, good = [], []
    for _ in range(n):
        y = rnd.random() < .6
        lines = [" ".join(word() for _ in range(rnd.randrange(3, 15))) for _ in range(rnd.randrange(1, 9))]
        if not y:
            lines = [rnd.choice((f"{t.upper()}!!", " | ".join(t.split()), t.replace(" ", "%%% "))) for t in lines]
        texts.append("\n".join(lines))
        good.append(int(y))
    return texts, good


def test_held_out_quality_and_defined_cases(spark):
    texts, good = corpus(3)
    odd = [None, "", "\n\n", "A" * 50_000, "word " * 20_000]
    df = docs(spark, texts + odd, extra=[("score", "string", "s"), ("quality", "int", 1), ("row", "int", None)])
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(good)] + [(0, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    field = Q.train(df, labels)
    got = dict(rows(Q.score(df, field)))
    assert len(got) == len(texts) + len(odd) and all(0 <= s <= 1 for s in got.values())
    out = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= Q.THRESHOLD) == bool(good[i]) for i in out) >= 0.95 * len(out)
    # held-out labels play no part
    flipped = spark.createDataFrame([(i, 1 - y if i in set(out) else y, 0) for i, y in enumerate(good)], "doc_id long, quality int, toxic int")
    assert dict(rows(Q.score(df, Q.train(df, flipped)))) == got
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in got.items() if s >= Q.THRESHOLD)


def test_no_labels_repeated_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, ["a", "a", None], [1, 1, None])
    assert [round(s, 6) for _, s in rows(Q.score(df, Q.train(df, none)))] == [0.5] * 3
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert len({s for _, s in rows(Q.score(df, Q.train(df, one)))}) == 1
    assert rows(Q.score(docs(spark, []), Q.train(docs(spark, []), none))) == []


def test_lines_after_the_300th_are_learned(spark):
    rnd = random.Random(5)
    line = lambda: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 8))) for _ in range(6))
    good = [int(i % 2 == 0) for i in range(60)]
    texts = ["\n".join([line() for _ in range(300)] + [line() if y else line().upper() + "!!" for _ in range(300)]) for y in good]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(good)], "doc_id long, quality int, toxic int")
    got = dict(rows(Q.score(df, Q.train(df, labels))))
    assert all((got[i] >= Q.THRESHOLD) == bool(y) for i, y in enumerate(good))
    assert [r.doc_id for r in Q.keep_good(df, labels).orderBy("doc_id").collect()] == [i for i, y in enumerate(good) if y]


def test_one_row_of_a_repeated_doc_id_is_learned(spark):
    texts, good = corpus(9, 60)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(good)], "doc_id long, quality int, toxic int")
    df = docs(spark, texts)
    ids = [i for i, y in enumerate(good) if not y and zlib.crc32(str(i).encode()) % 4 != 2][:1]
    more = docs(spark, ["~ " + "etaoin shr " * 40] * 300, ids * 300)  # sorts after every text of the corpus
    assert dict(rows(Q.score(df, Q.train(df.unionAll(more), labels)))) == dict(rows(Q.score(df, Q.train(df, labels))))


def test_chains_in_pieces():
    rnd = np.random.default_rng(2)
    lines = np.array([1, 40, 16, 17, 3, 100])
    unary, pair = rnd.normal(size=lines.sum()) * 3, rnd.normal(size=(2, 2))
    whole = Q.chain(unary, lines, pair, piece=1000)
    for piece in (1, 8, 16, 33):
        assert all(np.allclose(a, b) for a, b in zip(whole, Q.chain(unary, lines, pair, piece), strict=True))


def test_a_null_doc_id_is_not_held_out(spark):
    ids = [None, *range(40)]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", Q.held_out(F.col("doc_id"))).collect()
    assert {r[0]: r[1] for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}
