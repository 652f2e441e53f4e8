import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import docs, rows
from trustlens.llm import substring_dedup as D
from trustlens.llm.repeats import intervals


def brute(pairs, least):
    """pairs in document order; rows that are one document are given once."""
    seen, out = set(), []
    for doc_id, text in pairs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - least + 1):
            s = raw[p:p + least]
            if s in seen:
                gone[p:p + least] = True
            seen.add(s)
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sample(seed, least):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé\0") for _ in range(rnd.randrange(1, 5)))
    blocks = [" ".join(word() for _ in range(rnd.randrange(1, least))) for _ in range(12)]
    texts = [None, "", "a" * (3 * least), "ab" * (2 * least), "x" * (least - 1), "y" * least, "y" * least]
    for _ in range(60):
        t = "".join(rnd.choice(blocks) if rnd.random() < .7 else word() for _ in range(rnd.randrange(1, 9)))
        texts.append(t)
    texts += [texts[20]] * 25 + [texts[21] + str(k) + texts[22] for k in range(25)]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return sorted(zip(ids, texts, strict=True)), ids, texts


def test_intervals():
    # a common-prefix tree: rows 0-4 share 1, rows 1-3 share 3, rows 2-3 share 5
    assert list(intervals([1, 3, 5, 1], 1)) == [(5, 2, 3), (3, 1, 3), (1, 0, 4)]
    assert list(intervals([2, 2], 1)) == [(2, 0, 2)] and list(intervals([], 1)) == []


@pytest.mark.parametrize("seed,least,how", [(1, 12, {}), (2, 20, {"limit": 6}), (3, 9, {"group_bytes": 300, "piece": 64}), (4, 100, {}),
                                            (7, 24, {"hot_rows": 2, "group_bytes": 200}), (8, 15, {"hot_rows": 6, "limit": 5, "group_bytes": 500})])
def test_against_brute_force(spark, seed, least, how, monkeypatch):
    if "limit" in how:
        monkeypatch.setattr(D, "TREE_ROWS", 1)
    ordered, ids, texts = sample(seed, least)
    df = docs(spark, texts, ids, extra=[("ord", "string", "o"), ("hash", "int", 1), ("spans", "int", None)])
    got = rows(D.remove_repeats(df, least, gram=max(3, least // 3), **how))
    assert got == brute(ordered, least)


@pytest.mark.parametrize("read_bits", [lambda folder, part: {},
                                       lambda folder, part, read=D._read_bits: {k: v for k, v in read(folder, part).items() if k[0] % 2}])
def test_lost_bits_only_cost_work(spark, monkeypatch, read_bits):
    """Batches that don't find their bits still meet the hot anchors of those that do."""
    monkeypatch.setattr(D, "_read_bits", read_bits)
    ordered, ids, texts = sample(6, 15)
    assert rows(D.remove_repeats(docs(spark, texts, ids), 15, gram=5, group_bytes=300, hot_rows=3)) == brute(ordered, 15)


def test_hot_anchor_is_dealt_by_what_stands_around_it(spark):
    """A passage of a third of all documents, between words of their own."""
    rnd = random.Random(9)
    own = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    common = own(130)
    texts = [own(40) + (common if k % 3 == 0 else own(130)) + own(40) for k in range(300)]
    df = docs(spark, texts)
    assert rows(D.remove_repeats(df, hot_rows=20, group_bytes=2000)) == brute(list(enumerate(texts)), 100)
    keyed = {hot: D._contexts(D._ordered(df)[1], 100, 32, 68, 100, True, 2000, D.PIECE, 4, hot).filter("hash IS NOT NULL").groupBy("hash").count().agg({"count": "max"}).first()[0]
             for hot in (20, None)}
    assert keyed[20] <= keyed[None]


def test_ranges_hold_every_start():
    for least, gram in ((100, 32), (12, 4), (9, 9), (10, 8)):
        ranges = D._hot_ranges(least, gram)
        assert [p for a, b in ranges for p in range(a, b + 1)] == list(range(least - gram + 1))


def test_long_text_repeated_rows_null_ids_and_empty_table(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(60_000))
    pairs = [(1, long), (2, "q" + long[100:40_000]), (None, long[:300]), (5, None)]
    df = docs(spark, [t for _, t in pairs], [i for i, _ in pairs])
    last = [p for p in pairs if p[0] is not None] + [(None, long[:300])]
    assert rows(D.remove_repeats(df)) == brute(last, 100)
    twice = docs(spark, [long, long, long[:500]], [1, 1, 3])
    assert rows(D.remove_repeats(twice)) == sorted(brute([(1, long)], 100) + brute([(1, long), (3, long[:500])], 100), key=repr)
    assert rows(D.remove_repeats(docs(spark, []))) == []


def test_groups_have_all_occurrences(spark):
    base = "the quick brown fox jumps over it"
    texts = ["1" + base + "A", "2" + base + "B", "3" + base + "C " + base + "D"]
    got = rows(D.repeat_groups(docs(spark, texts), least=20, gram=6))
    digest = hashlib.sha256(base.encode()).hexdigest()
    assert {r[2:] for r in got if r[0] == digest} == {(0, 1), (1, 1), (2, 1), (2, 1 + len(base) + 2)}


def test_anchors_follow_the_content_and_are_few():
    rnd = random.Random(4)
    text = bytes(rnd.randrange(256) for _ in range(20_000))
    moved = b"\x00" * 777 + text
    finder = D.Anchors(100, 32, 4096)

    def find(raw):
        return finder.find(np.frombuffer(raw, dtype=np.uint8), np.array([0]), np.array([len(raw)]))

    (a, ha), (b, hb) = find(text), find(moved)
    assert len(a) < 0.04 * len(text)
    assert np.diff(a).max() <= 69  # every string of 100 bytes has one
    later = b - 777 > 100
    assert np.isin(b[later] - 777, a).all() and np.isin(hb[later], ha).all()
