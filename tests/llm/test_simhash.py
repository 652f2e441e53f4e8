import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import docs, rows
from trustlens.llm import simhash as S
from trustlens.llm.components import components


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, budget=2):
    ids = [p[0] for p in pairs]
    fp = [brute_print(t) for _, t in pairs]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= budget:
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fp[i]:016x}", least.get(find(i))) for i, d in enumerate(ids)), key=repr)


@pytest.mark.parametrize("seed,block", [(1, 1 << 18), (2, 3)])
def test_trie_links_against_all_pairs(seed, block):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(60)]
    vals = sorted(set(base + [b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64) if rnd.random() < .4 else 0) for b in base for _ in range(4)]))
    label = S.trie_links(np.array(vals, dtype=np.uint64), None, 0, 2, block)
    root = list(range(len(vals)))
    for i, j in combinations(range(len(vals)), 2):
        if (vals[i] ^ vals[j]).bit_count() <= 2:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    assert label.tolist() == root


@pytest.mark.parametrize("subtree", [8192, 8])
def test_against_brute_force(spark, subtree):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One", "one TWO", "Éa éa", "a\x1cb c d", "long " * 70000]
    for _ in range(12):
        t = [rnd.choice(words) for _ in range(rnd.randrange(30, 400))]
        for _ in range(9):
            u = list(t)
            u[rnd.randrange(len(u))] = rnd.choice(words)
            texts.append(" ".join(u))
    texts += ["hot group of the very same words"] * 40
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    df = docs(spark, texts, ids, extra=[("fp", "string", "x"), ("component_id", "int", 1), ("root", "int", 2)])
    got = rows(S.near_groups(df, subtree=subtree))
    assert got == brute_components(list(zip(ids, texts, strict=True)))
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got})


def test_ties_nulls_empty(spark):
    pairs = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "x y z"), (2, "a  b c D"), (2, None)]
    df = docs(spark, [t for _, t in pairs], [i for i, _ in pairs])
    assert rows(S.near_groups(df)) == brute_components(pairs)
    assert S.keep_one(df).columns == df.columns
    assert rows(S.near_groups(docs(spark, []))) == []


def test_components(spark):
    rnd = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 400), (400, 450), (450, 450)]
    rnd.shuffle(links)
    got = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {400: 400, 500: 400, 450: 400}
    assert got == want


def test_keep_one_rows_without_or_with_repeated_ids(spark):
    pairs = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (2, "a  b c D"),  # component 2
             (None, "x y z"), (None, "x  y Z"), (None, "x y z"),  # without an id
             (None, "k l m n o"),  # alone
             (1, "p q r s"), (9, "p q r s"),  # component 1
             (9, "m n o p"), (9, "m n o p"), (None, "m n o p"),  # component 9
             (4, None), (None, "")]
    df = docs(spark, [t for _, t in pairs], [i for i, _ in pairs])
    assert rows(S.keep_one(df).select("doc_id", "text")) == sorted(
        [(2, "a  b c D"), (None, "x  y Z"), (None, "k l m n o"), (1, "p q r s"), (9, "m n o p"), (9, "m n o p"), (4, None)], key=repr)
    alone = df.filter("doc_id is null and text like 'x%'")
    assert rows(S.keep_one(alone).select("doc_id", "text")) == [(None, "x  y Z")]


def test_fingerprints_with_shared_leading_bits_are_dealt_on(spark):
    rnd = random.Random(8)
    hot = rnd.getrandbits(40) << 24
    fps = {hot | rnd.getrandbits(24) for _ in range(1500)}
    fps |= {f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in rnd.sample(sorted(fps), 60)}
    fps = sorted(fps | {rnd.getrandbits(64) for _ in range(1500)})
    distinct = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    subtree = 64
    dealt = list(S.deal(distinct, len(fps), 2, subtree))
    assert max(r["count"] for _, pairs in dealt for r in pairs.groupBy("p", "q").count().collect()) <= 4 * subtree
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.near_links(distinct, len(fps), 2, subtree).collect()]

    def classes(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {f: find(f) for f in fps}
    want = classes((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2)
    assert len(set(want.values())) < len(fps) and classes(links) == want


@pytest.mark.parametrize("keys", [1, 4, 10_000])
def test_hot_fingerprints_are_looked_up_alike(spark, monkeypatch, keys):
    """A third of the rows share a text, others repeat or stand alone."""
    monkeypatch.setattr(S, "HOT_KEYS", keys)
    texts = [("one text of many rows" if i % 3 == 0 else f"text {i % 30} of words {i % 30}") for i in range(120)] + [None, ""]
    df = docs(spark, texts)
    by_text = {}
    for i, t in enumerate(texts):
        by_text.setdefault(t or "", []).append(i)
    got = {r.doc_id: r for r in S.near_groups(df).collect()}
    assert len(got) == len(texts)
    for same in by_text.values():
        assert len({(got[i].fingerprint, got[i].component_id) for i in same}) == 1 and got[same[0]].component_id <= same[0]
    assert sorted(r.doc_id for r in S.keep_one(df).select("doc_id").collect()) == sorted({r.component_id for r in got.values()})


def test_look_up_is_the_inner_join(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_KEYS", 5)
    rows_ = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 30 + [2] * 5 + [3] * 2 + [4])], "k int, i int")
    found = spark.createDataFrame([(1, 30, "a"), (2, 5, "b"), (3, 2, "c"), (9, 0, "z")], "k int, n_rows int, v string")
    got = sorted(tuple(r) for r in S.look_up(rows_, found, "k", 38).select("k", "i", "v").collect())
    assert got == sorted((k, i, {1: "a", 2: "b", 3: "c"}[k]) for i, k in enumerate([1] * 30 + [2] * 5 + [3] * 2))
