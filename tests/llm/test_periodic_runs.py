import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import docs, rows
from trustlens.llm import periodic_runs as P


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w):
    """All runs by their definition: longest stretches of lag q, smallest lag of each."""
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_text(rnd, i):
    kind, n = i % 6, rnd.randint(0, 120)
    few = ["a", "b", "c"][:rnd.randint(1, 3)]
    if kind == 0:
        return " ".join(rnd.choice(few) for _ in range(n))
    unit = [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 20))]
    if kind == 1:
        return "\t".join((unit * 9)[:n])
    if kind == 2:  # a period with a smaller one inside
        return " ".join((["x"] * 7 + unit) * 6 + unit[:3])
    if kind == 3:
        return "  ".join([rnd.choice("pqrs") for _ in range(20)] + (unit * 7)[:n] + (unit[::-1] * 5)[:n] + ["end"])
    if kind == 4:
        return "\n".join(str(rnd.randint(0, 10 ** 9)) for _ in range(n))
    return rnd.choice([None, "", " \n ", "one", "é é " * 9, "aa " * 5, "aa " * 6, "a b " * 4, "a b " * 3 + "a"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    texts = [random_text(rnd, i) for i in range(700)]
    df = docs(spark, texts, extra=[("runs", "string", "r"), ("n_words", "int", 1), ("start", "long", None)])
    got = {r["doc_id"]: r for r in P.collapse_runs(df).collect()}
    assert len(got) == len(texts)
    total = 0
    for i, t in enumerate(texts):
        w = words(t)
        want = brute_runs(w)
        assert [tuple(r) for r in got[i]["runs"]] == want, (t, want)
        assert got[i]["text"] == brute_collapsed(w, want)
        total += len(want)
    assert total > 300


def test_all_words_over_two_letters(spark):
    """Dense runs: Fibonacci and Thue-Morse words, powers of powers."""
    fib, prev = "a b", "a"
    while len(fib.split()) < 600:
        fib, prev = fib + " " + prev, fib
    thue = " ".join("ab"[bin(i).count("1") % 2] for i in range(700))
    nested = " ".join(((["a"] * 6 + ["b"]) * 5 + ["c"]) * 6)
    texts = [fib, thue, nested, "a " * 3000, ("a " * 50 + "b ") * 40]
    got = {r["doc_id"]: r for r in P.collapse_runs(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(r) for r in got[i]["runs"]] == brute_runs(words(t))


def test_long_text_in_slices(spark, monkeypatch):
    rnd = random.Random(4)
    unit = " ".join(str(rnd.randint(0, 10 ** 6)) for _ in range(30_000))
    text = " ".join([unit] * 5) + " end"
    got = P.collapse_runs(docs(spark, [text])).first()
    assert [tuple(r) for r in got["runs"]] == [(0, 150_000, 30_000)] and got["text"] == unit + " end"
    raw = "ab  c\ndef \x1fg".encode()
    for size in range(1, 12):
        assert [w for part in P.slices(raw, size) for w in part] == [b"ab", b"c", b"def", b"\x1fg"]


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = docs(spark, ["a " * 8, "a " * 8, None, "x y"], [7, 7, None, None])
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["text"]) for r in P.collapse_runs(df).collect()), key=repr)
    assert got == sorted([(7, [(0, 8, 1)], "a")] * 2 + [(None, [], ""), (None, [], "x y")], key=repr)
    assert rows(P.collapse_runs(docs(spark, []))) == []
    assert rows(P.with_planted_runs(docs(spark, []))) == []


def brute_query(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    s, ln, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    told = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), s, ln, q, 1000 * ln // q if runs else None, sha(told), sha(brute_collapsed(w, runs))


def test_query_with_planted_runs(spark, tmp_path):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["on", "off", "up", str(rnd.random())]) for _ in range(rnd.randint(0, 90))) for _ in range(400)] + [None, ""]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(P.op13_periodic_runs(spark, str(tmp_path)), "doc_id")
    want = [brute_query(i, t) for i, t in enumerate(texts)]
    assert got == want
    assert sum(r[1] for r in want) > 20


def test_gram_numbers_are_exact():
    x = np.array([5, 1, 5, 1, 5, 2, 5, 1])
    assert P.named(x[:-1], x[1:]).tolist() == [2, 0, 2, 0, 3, 1, 2]
