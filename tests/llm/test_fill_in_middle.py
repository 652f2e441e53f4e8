import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, rows
from trustlens.llm import fill_in_middle as M

CLASHES = [("n", "string", "a"), ("form", "int", 1), ("output", "long", None)]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    x = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made_up(rnd):
    alphabet = ["word", "Ab", " ", "\n", "\r\n", "é", "字", "\U0001F600", "<", "S>", "<P", ">", "7", "\x00", " "]
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))


def test_against_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", "a", " ", "<P>", "x<S>y<M>", "<<S", "S>", *[made_up(rnd) for _ in range(500)], "long " * 60_000, "z" * 300_000]
    df = docs(spark, texts, extra=CLASHES)
    got = rows(M.fill_in_middle(df), "doc_id")
    assert got == [brute(i, t) for i, t in enumerate(texts)]
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = M.fill_in_middle(df).select("doc_id", M.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in back} == {i: t or "" for i, t in enumerate(texts)}


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_blocks_end_where_units_end(block):
    rnd = random.Random(block)
    for _ in range(200):
        text = made_up(rnd)
        want = [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        assert M.unit_ends(text, block).tolist() == want


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = docs(spark, ["a b c d", "a b c d", "e f", None], [5, 5, None, None])
    got = rows(M.fill_in_middle(df))
    assert got == sorted([brute(5, "a b c d")] * 2 + [brute(None, "e f"), brute(None, "")], key=repr)
    assert rows(M.fill_in_middle(docs(spark, []))) == []


def test_shares(spark):
    got = rows(M.fill_in_middle(docs(spark, ["some text of words"] * 4000)))
    forms = [r[2] for r in got]
    assert abs(forms.count("plain") / 4000 - 0.1) < 0.02 and abs(forms.count("spm") / 4000 - 0.18) < 0.025
