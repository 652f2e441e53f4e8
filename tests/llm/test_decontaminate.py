import hashlib
import random
import re

import pytest

from tests.llm.helpers import docs, rows
from trustlens.llm import decontaminate as D
from trustlens.llm import common

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(str.maketrans(common.UPPER, common.UPPER.lower())))


def brute(pairs, items):
    out = []
    for doc_id, text in pairs:
        ws, hit, names = words(text), set(), set()
        for item, body in items:
            iw = words(body)
            for i in range(max(1, len(iw) - 9)) if iw else ():
                win = iw[i:i + 10]
                for p in range(len(ws) - len(win) + 1):
                    if ws[p:p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        names.add("null" if item is None else str(item))
        out.append((doc_id, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(df, items):
    return rows(D.contamination(df, items).drop("text_hash", "text_bytes"))


@pytest.fixture(params=["broadcast", "shuffle"])
def path(request, monkeypatch):
    if request.param == "shuffle":
        monkeypatch.setattr(D, "BROADCAST_BYTES", -1)


def test_against_brute_force(spark, path):
    rnd = random.Random(4)
    vocab = ["a", "B", "cé", "d1", "É", "the"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 4, 5, 9, 10, 11, 14, 30, 0])] + [(10, None), (11, ""), (2, say(3)), (None, "zz Qq"), (100, say(12))]
    items.append((12, items[8][1]))
    pairs = [(i, say(rnd.randrange(60))) for i in range(60)]
    pairs += [(60, None), (60, ""), (61, "x " + items[8][1].upper() + " -- " + items[8][1]), (61, "zz, QQ"), (None, "zz  qq"), (None, "zz  qq"), (62, "zz qq " * 5000)]
    df = docs(spark, [t for _, t in pairs], [i for i, _ in pairs], extra=[("tok", "int", 1), ("n_words", "string", "n"), ("text_hash", "int", 5)])
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, win int")
    assert result(df, bench) == brute(pairs, items)
    left = D.drop_contaminated(df, bench)
    assert left.columns == df.columns
    clean = [(i, t) for i, t in pairs if not brute([(i, t)], items)[0][5]]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(clean, key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert result(docs(spark, []), none) == []
    assert result(docs(spark, ["a b", None]), none) == brute([(0, "a b"), (1, None)], [])
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert result(docs(spark, []), some) == []
