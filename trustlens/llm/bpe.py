"""BPE encoding and decoding over a table of distinct words.

1. Scan tasks cut texts into words, whatever their script; every task gives the distinct
   words of its part.  Only a text that holds a special token's string goes whole to the
   library, which cuts it there first.
2. The words of all parts come together by a shuffle on the word; each distinct word is
   encoded once, and goes back to the parts that have it as their dictionary, written
   under the shared checkpoint folder.
3. Every scan task reads its part's dictionary and puts ids in the words' places.  A
   word that the dictionary lacks (the scan was cut otherwise, after a loss of
   executors) is encoded on the spot, so the result holds in any case.

Decoding joins ids to pieces: the byte string of every id of the vocabulary, taken at
the ids' places, gives a document's bytes.

Defined results: a null text is empty, and an empty text has no ids.  Rows that repeat
a doc_id each get a row.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from trustlens.llm.bpe_words import BYTE_LEVEL, WordSplit, encode_batch, encode_words, load_tokenizer, plain_words
from trustlens.llm.common import bounded_batches, by_bytes, documents, ragged_take, shared_files, text_or_empty
from trustlens.session import scratch_path

#: Scan parts whose dictionaries one shuffle task writes.
PARTS_A_TASK = 8


def byte_alphabet() -> dict[str, int]:
    """The byte for each character that a byte-level vocabulary writes it as: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_table(spec: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary, added tokens included."""
    tok = json.loads(spec)
    alphabet = byte_alphabet()
    added = {t["id"]: t["content"] for t in tok["added_tokens"]}
    vocab = {i: p for p, i in tok["model"]["vocab"].items()} | added
    return [vocab[i].encode() if i in added else bytes(alphabet[c] for c in vocab[i]) if i in vocab else b"" for i in range(max(vocab) + 1)]


def _distinct_words(spec, split: WordSplit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), set()
        tokenizer = cache(lambda: load_tokenizer(spec.value))
        for b in (p for batch in batches for p in by_bytes(batch, "text")):
            new = [w for w in plain_words(b.column("text"), split, tokenizer)[0].unique().to_pylist() if w not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(new), pa.int32()), pa.array(new, pa.string())], names=["part", "word"])
    return run


def _encode_distinct(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(spec.value)
        last, last_ids = None, b""
        for b in batches:  # in order of the word: equal words stand together
            words = b.column("word").dictionary_encode()
            distinct = words.dictionary.to_pylist()
            fresh = distinct[1:] if distinct and distinct[0] == last else distinct
            ids = ([last_ids] if len(fresh) < len(distinct) else []) + encode_words(tokenizer, fresh)
            if distinct:
                last, last_ids = distinct[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("word"), pa.array(ids, pa.binary()).take(words.indices)], names=["part", "word", "ids"])
    return run


def _with_dictionary(folder: str, spec, split: WordSplit, finish):
    """Batches of (doc_id, text) become ``finish(doc_ids, ids, counts)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(spec.value)
        fs, base = shared_files(folder)
        part = TaskContext.get().partitionId()
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/part={part}", allow_not_found=True)) if f.base_name.endswith(".parquet")]
        at: dict[str, int] = {}
        held: list[pa.Array] = []
        for path in sorted(files):
            with fs.open_input_file(path) as f:
                t = pq.read_table(f, columns=["word", "ids"])
            words = t.column("word").to_pylist()
            at.update(zip(words, range(len(at), len(at) + len(words)), strict=True))
            held += t.column("ids").chunks
        known = pa.concat_arrays(held) if held else pa.array([], pa.binary())

        def lookup(words: list[str]) -> list[bytes]:
            found = [at.get(w, -1) for w in words]
            missing = [w for w, k in zip(words, found, strict=True) if k < 0]
            own = iter(encode_words(tokenizer, missing))
            have = iter(known.take(pa.array([k for k in found if k >= 0], pa.int64())).to_pylist())
            return [next(have) if k >= 0 else next(own) for k in found]

        for b in (p for batch in batches for p in by_bytes(batch, "text")):
            ids, counts = encode_batch(b.column("text"), split, lookup, tokenizer)
            yield finish(b.column("doc_id"), ids, counts)
    return run


def encode(docs: DataFrame, spec: str, split: WordSplit, finish, schema: str) -> DataFrame:
    """``docs`` through the distinct-word table; ``finish`` makes the output batch (of
    ``schema``) from doc_ids, the ids of all texts end to end and the ids of each."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(spec)  # a vocabulary file: a few MB, whatever the input
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    folder = scratch_path(spark, f"bpe_words_{uuid.uuid4().hex[:8]}")
    pairs = texts.select("text").mapInArrow(_distinct_words(shared, split), "part int, word string")
    # a shuffle task takes the words of PARTS_A_TASK scan parts at most, however many parts the input has
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.rdd.getNumPartitions() // PARTS_A_TASK))
    (pairs.repartition(n, "word").sortWithinPartitions("word").mapInArrow(_encode_distinct(shared), "part int, word string, ids binary")
     .repartition(n, "part").write.mode("overwrite").partitionBy("part").parquet(folder))
    return texts.mapInArrow(_with_dictionary(folder, shared, split, finish), schema)


def _per_text(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []


def encode_ids(docs: DataFrame, spec: str, split: WordSplit = BYTE_LEVEL) -> DataFrame:
    """doc_id, ids (array<int>), one row per document."""
    def finish(doc_ids, ids, counts):
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return encode(docs, spec, split, finish, f"doc_id {kind}, ids array<int>")


def _pieces(spec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pieces = piece_table(spec)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    return np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _texts(ids: np.ndarray, counts: np.ndarray, pieces) -> list[str]:
    """Decoded texts; bytes that are no UTF-8 become U+FFFD."""
    flat, starts, sizes = pieces
    raw = ragged_take(flat, starts[ids], sizes[ids]).tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum(counts)] if len(counts) else []
    out, at = [], 0
    for e in ends:
        out.append(raw[at:int(e)].decode("utf-8", errors="replace"))
        at = int(e)
    return out


def decode_ids(encoded: DataFrame, spec: str) -> DataFrame:
    """doc_id, text from (doc_id, ids): the join of ids to pieces, inside tasks, as the
    table of pieces is as small as the vocabulary."""
    shared = encoded.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for b in batches:
            lists = b.column("ids")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_texts(lists.flatten().to_numpy(), counts, pieces), pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, spec: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    loaded: list = []

    def finish(doc_ids, ids, counts):
        if not loaded:
            loaded.append(_pieces(spec))
        sha = [hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in _per_text(ids, counts)]
        back = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in _texts(ids, counts, loaded[0])]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return encode(docs, spec, BYTE_LEVEL, finish, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The JSON text of an installed public tokenizer."""
    import public_tokenizers
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded with the byte-level vocabulary and decoded again."""
    return round_trip(documents(spark, sf_dir), vocabulary())
