import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import docs, rows
from trustlens.llm import token_files as T
from trustlens.llm.bpe_words import BYTE_LEVEL, WORD_END
from trustlens.session import scratch_path

LIBRARY = {"word_bpe_49k.json": (WORD_END, 49_408), "byte_bpe_50k.json": (BYTE_LEVEL, 50_257)}
ODD = ["\n", "  ", "\t", "\x85", "\xa0", "\x1c", "\x00", "'s", "'", "'LL", "İ", "É", "ǅ", "²", "½", "7", "§", "–", "€", "…", "Σ", "中", "é", "🙂", " ", "　",
       "<|endoftext|>", "<|startoftext|>", "<|", "a", "The", "the", "qu", "!!", "_", "​", "ʹ"]


def texts(seed, n=150):
    rnd = random.Random(seed)
    plain = ODD[:20] + ["a", "The", "the", " ", "zq", "!!"]
    return [None, "", " ", "x" * 3000, "long word " * 5000, *["".join(rnd.choice(ODD if i % 3 == 0 else plain) + rnd.choice(["", " "]) for _ in range(rnd.randrange(40))) for i in range(n)]]


def spec_of(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("name", LIBRARY)
def test_files_hold_what_the_library_encodes(spark, name):
    split, ids = LIBRARY[name]
    given = texts(1)
    order = list(range(len(given)))
    random.Random(2).shuffle(order)
    df = docs(spark, given, order, extra=[("data", "string", "d"), ("words", "int", 1), ("start", "string", None)])
    folder = scratch_path(spark, f"t_{uuid.uuid4().hex}")
    index = T.write_token_files(df, folder, spec_of(name), split, 2, ids)
    got = rows(T.token_starts(T.read_token_files(spark, folder, index)).select("doc_id", "start", "n_tokens", "ids"), "doc_id")
    lib = Tokenizer.from_str(spec_of(name))
    lib.no_truncation()
    lib.no_padding()
    start = 0
    for doc_id, (i, at, n, raw) in enumerate(got):
        want = [*lib.encode(given[order.index(doc_id)] or "", add_special_tokens=False).ids, 2]
        assert (i, at, n) == (doc_id, start, len(want))
        assert np.frombuffer(raw, dtype="<u4").tolist() == want
        start += n
    assert len(got) == len(given)
    some = index.filter("doc_id % 7 = 3").orderBy(index["offset"].desc())  # a shuffled read
    assert {r[0]: zlib.crc32(r[1]) for r in T.read_token_files(spark, folder, some).select("doc_id", "ids").collect()} == {i: zlib.crc32(raw) for i, _, _, raw in got if i % 7 == 3}


def test_records_are_checked():
    record = T.frame(b"abcd")
    assert T.unframe(record) == b"abcd" and T.unframe(T.frame(b"")) == b""
    for k in range(len(record)):
        bad = bytearray(record)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            T.unframe(bytes(bad))


def test_repeated_null_and_empty(spark):
    for df, n in ((docs(spark, ["a", "a", "b", None, "c"], [1, 1, 1, None, None]), 5), (docs(spark, []), 0)):
        folder = scratch_path(spark, f"t_{uuid.uuid4().hex}")
        index = T.write_token_files(df, folder, spec_of("word_bpe_49k.json"), WORD_END, 2, 49_408)
        got = rows(T.token_starts(T.read_token_files(spark, folder, index)).select("start", "n_tokens", "doc_id"), "start")
        assert len(got) == n and [r[0] for r in got] == [sum(x[1] for x in got[:i]) for i in range(n)]
        assert [r[2] for r in got][:2] == [None, None][:n]


def test_an_id_of_many_rows_takes_several_files(spark):
    """Half of the rows repeat one id, a quarter has none."""
    given = [f"text {k}" for k in range(400)]
    ids = [(7, 7, None, k)[k % 4] for k in range(400)]
    folder = scratch_path(spark, f"t_{uuid.uuid4().hex}")
    index = T.write_token_files(docs(spark, given, ids), folder, spec_of("word_bpe_49k.json"), WORD_END, 2, 49_408)
    files = {r[0]: r[1] for r in index.selectExpr("doc_id", "file_no").distinct().groupBy("doc_id").agg({"file_no": "count"}).collect()}
    assert files[7] >= 4 and files[None] >= 2
    got = rows(T.token_starts(T.read_token_files(spark, folder, index)).select("doc_id", "start", "n_tokens"), "start")
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(400)]
    assert [r[0] for r in got] == sorted(ids, key=lambda i: -1 if i is None else i)


def test_file_numbers_are_in_order():
    rnd = np.random.default_rng(3)
    bounds = np.array([T.NO_ID, T.NO_ID, 3, 5, 5, 5, 9])
    ids = np.sort(rnd.choice([T.NO_ID, 1, 3, 4, 5, 6, 9, 10], 500))
    ties = rnd.integers(0, 1 << 63, 500)
    order = np.lexsort((ties, ids))
    got = T.file_numbers(ids[order], ties[order], bounds)
    assert (np.diff(got) >= 0).all() and set(got[ids[order] == 5]) == {4, 5, 6} and got.max() == 7
    assert T.file_numbers(np.array([5]), np.array([(1 << 63) - 1]), bounds)[0] == 6
    assert T.file_numbers(ids, ties, np.array([], dtype=np.int64)).max() == 0


def test_a_task_that_runs_again_writes_the_same_file(spark, tmp_path):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 5]), "tie": pa.array([4, 4, 4]), "file_no": pa.array([0, 0, 2], pa.int32()),
                                        "data": pa.array([b"\1\0", b"\2\0\3\0", b""], pa.binary())})
    first = [b.to_pydict() for b in T._writer(str(tmp_path), 2)(iter([batch]))]
    held = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    cut_short = T._writer(str(tmp_path), 2)(iter([batch, batch]))
    next(cut_short)  # a task that dies leaves a file that no index names
    assert [b.to_pydict() for b in T._writer(str(tmp_path), 2)(iter([batch]))] == first
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir() if not p.name.startswith(".")} == held and set(held) == {"part-000000.bin", "part-000002.bin"}


def test_names_of_stores():
    from trustlens.llm.common import pyarrow_uri
    for given, want in (("s3a://b/k", "s3://b/k"), ("s3://b/k", "s3://b/k"), ("file:/tmp/x", "file:/tmp/x"), ("/tmp/x:y", "/tmp/x:y"), ("hdfs://n:8020/x", "hdfs://n:8020/x"),
                        ("dbfs:/a/b", "/dbfs/a/b"), ("wasbs://c@a.blob.core.windows.net/p", "abfss://c@a.dfs.core.windows.net/p")):
        assert pyarrow_uri(given) == want


@pytest.mark.parametrize("name", LIBRARY)
def test_words_are_cut_as_by_the_library(name):
    """Every text of up to 5 pieces of a small alphabet, and random longer ones."""
    from itertools import product

    import pyarrow as pa

    from trustlens.llm.bpe_words import encode_batch, encode_words, foreign_texts, load_tokenizer, special_texts, word_tails
    split, _ = LIBRARY[name]
    lib = load_tokenizer(spec_of(name))
    rnd = random.Random(12)
    alphabet = ["'", "s", " ", "\n", "7", "!"]
    given = ["".join(p) for n in range(6) for p in product(alphabet, repeat=n)]
    more = ["'", "ll", "re", "d", "ve", "T", "é", "É", "\xa0", "\x85", "\t", "\x1c", "½", "–", "€", "…", " ", "  ", "ab", "0", "??", "\u00ad", "ª", "ſ", "ŀ"]
    given += ["".join(rnd.choice(more) for _ in range(rnd.randrange(1, 14))) for _ in range(4000)]
    texts = pa.array(given)
    assert not foreign_texts(texts).any() and not special_texts(texts, split).any()
    ids, counts = encode_batch(texts, split, lambda ws: encode_words(lib, ws, word_tails(lib)), lib)
    want = [e.ids for e in lib.encode_batch_fast(given, add_special_tokens=False)]
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert [(t, a, b) for t, a, b in zip(given, got, want, strict=True) if a != b] == []
