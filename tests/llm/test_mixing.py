import math
import random
import re
from collections import defaultdict

import pytest

from tests.llm.helpers import docs, rows
from trustlens.llm import mixing as M


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; what is over the cap is shared anew until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]] if free else []
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.discard(s)


def brute_rates(sizes, target, cap=3):
    """The tilted rates of one source by bisection on the multiplier."""
    full = sum(sizes)
    if target >= cap * full:
        return [cap if s else 1 for s in sizes]
    mean = full / sum(s > 0 for s in sizes)
    rate = lambda x, s: min(cap, math.exp(min(x * s / mean, 50)))
    low, high = -1e5, 1e5
    for _ in range(300):
        x = (low + high) / 2
        low, high = (x, high) if sum(s * rate(x, s) for s in sizes) < target else (low, x)
    return [rate(low, s) for s in sizes]


def corpus(rnd, n=600, hot=0.34):
    texts, sources = [], []
    for _ in range(n):
        s = "hot" if rnd.random() < hot else rnd.choice(["b", "ä", "\U0001F600", "", "z", None, "B"])
        size = rnd.choice([0, 1, 3, 3, 3, rnd.randint(1, 40), int(rnd.paretovariate(1.1) * 5) % 3000])
        texts.append(rnd.choice([None, "", " \t"]) if size == 0 else "\n ".join(["w x"] * size))
        sources.append(s)
    return texts, sources


def table(spark, texts, sources, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, s, "k", 1) for i, t, s in zip(ids, texts, sources, strict=True)],
                                 "doc_id long, text string, source string, key string, size int")


def mixed(df, **options):
    return {r["row"]["doc_id"]: r for r in M.mix(df, **options).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts, sources = corpus(random.Random(seed))
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    got = mixed(table(spark, texts, sources).repartition(5), range_rows=16)
    assert len(got) == len(texts)
    total = defaultdict(int)
    for s, n in zip(sources, size, strict=True):
        total[s] += n
    target = brute_targets(total)
    for s in total:
        ids = [i for i, x in enumerate(sources) if x == s]
        rates = brute_rates([size[i] for i in ids], target[s])
        for i, rate in zip(ids, rates, strict=True):
            r = got[i]
            assert (r["size"], r["source_size"]) == (size[i], total[s]) and r["target"] == pytest.approx(target[s])
            assert r["rate"] == pytest.approx(rate if size[i] else 1, abs=2e-5)
            assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * size[i]
        smallest = min((size[i] for i in ids if size[i]), default=0)
        assert abs(sum(got[i]["taken"] for i in ids) - target[s]) <= max(smallest, 1)
        # Documents of one size differ by a copy at most.
        by_size = defaultdict(set)
        for i in ids:
            by_size[size[i]].add(got[i]["copies"])
        assert all(max(c) - min(c) <= 1 for c in by_size.values())


def test_result_does_not_depend_on_partitions(spark):
    texts, sources = corpus(random.Random(5), 300)
    df = table(spark, texts, sources)
    first = {k: tuple(v) for k, v in mixed(df.repartition(1)).items()}
    assert first == {k: tuple(v) for k, v in mixed(df.repartition(7, "text")).items()}


def test_targets_stop_at_the_cap_and_share_the_rest(spark):
    # Words 1, 10, 1000: the first two sources stop at three times their words.
    df = table(spark, ["w", "w " * 10, *["w " * 10] * 100], ["a", "b", *["c"] * 100])
    got = mixed(df)
    assert (got[0]["target"], got[1]["target"], got[2]["target"]) == (3.0, 30.0, 978.0)
    assert (got[0]["copies"], got[1]["copies"]) == (3, 3)
    assert sum(got[i]["taken"] for i in range(2, 102)) == 980
    even = mixed(df, weights=(1.0,), cap=1)
    assert all(r["copies"] == 1 for r in even.values())


def test_one_size_holds_most_rows(spark):
    texts = ["same text here"] * 900 + ["w " * n for n in range(1, 200)]
    df = table(spark, texts, ["hot"] * 900 + ["a"] * 199)
    got = mixed(df, range_rows=8)
    copies = [got[i]["copies"] for i in range(900)]
    assert max(copies) - min(copies) <= 1
    assert sum(got[i]["taken"] for i in range(900)) == pytest.approx(got[0]["target"], abs=3)


def test_mixture_repeats_whole_rows(spark):
    texts, sources = corpus(random.Random(9), 200)
    df = table(spark, texts, sources)
    got = mixed(df)
    out = M.mixture(df)
    assert out.schema == df.schema
    times = defaultdict(int)
    for r in out.collect():
        assert (r["text"], r["source"]) == (texts[r["doc_id"]], sources[r["doc_id"]])
        times[r["doc_id"]] += 1
    assert times == {i: r["copies"] for i, r in got.items() if r["copies"]}


def test_null_and_repeated_ids_empty_texts_and_tables(spark):
    df = table(spark, ["a b", "a b", "a b c", None, "d"], ["x", "x", "x", "x", None], [1, 1, None, None, None])
    got = M.mix(df).collect()
    assert len(got) == 5 and sum(r["taken"] for r in got if r["source_size"] == 7) >= 4
    assert rows(M.mix(docs(spark, []))) == []
    void = M.mix(docs(spark, [None, "", " "])).collect()
    assert [(r["target"], r["taken"], r["copies"]) for r in void] == [(0.0, 0, 1)] * 3
