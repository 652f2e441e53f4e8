import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from tests.llm.helpers import docs, rows
from tests.llm.test_token_files import texts
from trustlens.llm import bpe as B


def library():
    lib = Tokenizer.from_str(B.vocabulary())
    lib.no_truncation()
    lib.no_padding()
    return lib


def want(lib, doc_id, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    back = lib.decode(ids, skip_special_tokens=False)
    return (doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_as_the_library(spark):
    given, lib = texts(7), library()
    df = docs(spark, given, extra=[("words", "string", "w"), ("part", "int", 4), ("ids", "string", None)])
    assert rows(B.round_trip(df, B.vocabulary())) == sorted((want(lib, i, t) for i, t in enumerate(given)), key=repr)


SCRIPTS = ["Привет,  мир! Это 2024-й год.", "你好，世界。三个 词 １２３", "emoji 😀😀 and 👩‍👩‍👧 \u200d end ", "日本語のテキスト\n\n  次の行\t", "עברית عربي 'т's don't 'LL", "Ünïcode \u0301x Ⅷ½ ٣٤", "αβγ\u3000δ\x85ε\u2003ζ  ",
           "ไทยไม่มีช่องว่าง" * 400]


def test_words_of_every_script_go_through_the_table(spark):
    import pyarrow as pa

    from trustlens.llm.bpe_words import encode_words, plain_words
    lib, rnd = library(), random.Random(5)
    given = SCRIPTS + ["".join(rnd.choice([*"яЖ中国😀é a'\t\n\u3000\u0301٣.", "  ", "'s", "мир "]) for _ in range(rnd.randrange(60))) for _ in range(200)]
    words, per_text, whole = plain_words(pa.array([*given, "plain words", "中 <|endoftext|>"]), B.BYTE_LEVEL, lambda: lib)
    assert whole.tolist() == [False] * (len(given) + 1) + [True]  # only the special token's text stays whole
    flat, at = words.to_pylist(), np.cumsum([0, *per_text])
    assert ["".join(flat[a:b]) for a, b in zip(at, at[1:])] == [*given, "plain words", ""]
    ids = encode_words(lib, flat)
    assert [b"".join(ids[a:b]) for a, b in zip(at[:-2], at[1:-1])] == [np.array(lib.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in [*given, "plain words"]]
    df = docs(spark, given)
    assert rows(B.round_trip(df, B.vocabulary())) == sorted((want(lib, i, t) for i, t in enumerate(given)), key=repr)


def test_missing_dictionary_words_are_encoded_on_the_spot(spark):
    lib = library()
    pairs = [(k, f"word{k} and more") for k in range(40)]
    out = B.round_trip(docs(spark, [t for _, t in pairs]), B.vocabulary())
    # another cut of the same rows meets other parts' dictionaries
    assert rows(out.coalesce(1)) == sorted((want(lib, *p) for p in pairs), key=repr)


def test_general_interface_repeated_rows_and_empty_table(spark):
    pairs = [(1, "a b"), (1, "a b"), (None, "é <|endoftext|> x"), (2, None)]
    encoded = B.encode_ids(docs(spark, [t for _, t in pairs], [i for i, _ in pairs]), B.vocabulary())
    assert rows(B.decode_ids(encoded, B.vocabulary())) == sorted([(i, t or "") for i, t in pairs], key=repr)
    assert rows(B.round_trip(docs(spark, []), B.vocabulary())) == []


def test_broken_utf8_decodes_as_the_library(spark):
    rnd, lib = random.Random(1), library()
    ids = [[rnd.randrange(50_257) for _ in range(rnd.randrange(12))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    assert dict(rows(B.decode_ids(df, B.vocabulary()))) == {i: lib.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}
