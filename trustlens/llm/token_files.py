"""Token ids in length-delimited binary files with a separate offset index.

File: 16 bytes of head (``TOKREC01``, bytes per id as u32, zero as u32), then one record
per document.  Record: length of the data as u64, masked checksum of those 8 bytes as
u32, the data (ids, little-endian), masked checksum of the data as u32.  A masked
checksum is the CRC-32 turned right by 15 bits plus a constant, so that a checksum of
data that holds checksums is no trivial one.  The index is a Parquet table: file,
place in it, doc_id, offset, length, n_tokens, tokens before it in the file.

Documents are dealt to files by ranges of doc_id; files in order of their number and
records in order of their place are in ascending doc_id order (null first; rows that
repeat a doc_id by a hash of their texts).  A doc_id that many rows repeat, or null, takes
several files, by that hash.  The number of files follows the scan parts.  A task writes a file under a name of its own and then
renames it, so a task that is run again replaces it by the same bytes.

Defined results: a null text is empty; an empty text has the end id alone.  Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens.llm.bpe_words import WORD_END, WordSplit, encode_batch, encode_words, load_tokenizer, word_tails
from trustlens.llm.common import bounded_batches, by_bytes, documents, shared_files, shuffle_tasks, text_or_empty
from trustlens.session import scratch_path

MAGIC = b"TOKREC01"
MASK_DELTA = 0xA282EAD8
#: Words that a Python worker keeps with their ids, the first that it meets; they have
#: at most so many characters.
MEMO_WORDS = 200_000
MEMO_CHARS = 32
#: Files that a task writes or reads, as there is a task for each scan part: evens out
#: what a task writes.
FILES_A_TASK = 4
END_ID = 2
NO_ID = -(1 << 63)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join([head, struct.pack("<I", masked(head)), data, struct.pack("<I", masked(data))])


def unframe(record: bytes) -> bytes:
    """The data of a record; raises ValueError if a length or checksum is wrong."""
    if len(record) < 16:
        raise ValueError("record cut short")
    head, data = record[:8], record[12:-4]
    if struct.unpack("<I", record[8:12])[0] != masked(head) or struct.unpack("<Q", head)[0] != len(data):
        raise ValueError("length of a record is damaged")
    if struct.unpack("<I", record[-4:])[0] != masked(data):
        raise ValueError("data of a record is damaged")
    return data


_MEMO: dict[str, bytes] = {}
_LOADED: dict[int, tuple] = {}


def _tokenizer(spec: str):
    key = zlib.crc32(spec.encode())
    if key not in _LOADED:
        _MEMO.clear()
        _LOADED.clear()
        tokenizer = load_tokenizer(spec)
        _LOADED[key] = tokenizer, word_tails(tokenizer)
    return _LOADED[key]


def file_numbers(ids: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The file of each row.  ``bounds``: sorted cuts of doc_id; one that stands m times is
    an id that many rows repeat, and takes m files by ``ties`` (0 to 2^63 - 1)."""
    low, high = (np.searchsorted(bounds, ids, side=s) for s in ("left", "right"))
    own = np.minimum((ties / float(1 << 63) * (high - low)).astype(np.int64), high - low - 1)
    return np.where(high > low, low + 1 + own, high)


def _encoder(spec, split: WordSplit, end_id: int, dtype: str, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, tails = _tokenizer(spec.value)

        def lookup(words: list[str]) -> list:
            known = list(map(_MEMO.get, words))
            missing = [i for i, ids in enumerate(known) if ids is None]
            own = encode_words(tokenizer, [words[i] for i in missing], tails)
            for i, ids in zip(missing, own, strict=True):
                known[i] = ids
            if len(_MEMO) < MEMO_WORDS:
                _MEMO.update(islice(((words[i], known[i]) for i in missing if len(words[i]) <= MEMO_CHARS), MEMO_WORDS - len(_MEMO)))
            return known

        for b in (part for batch in batches for part in by_bytes(batch, "text")):
            ids, counts = encode_batch(b.column("text"), split, lookup, tokenizer)
            parts = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
            data = [np.append(p, np.uint32(end_id)).astype(dtype).tobytes() for p in parts]
            doc = b.column("doc_id")
            tie = b.column("tie")
            file_no = file_numbers(doc.fill_null(NO_ID).to_numpy(zero_copy_only=False), tie.to_numpy(), np.array(bounds, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([doc, tie, pa.array(file_no, pa.int32()), pa.array(data, pa.binary())], names=["doc_id", "tie", "file_no", "data"])
    return run


INDEX = "file_no int, place long, doc_id long, offset long, length long, n_tokens long, before long"


def _writer(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared_files(folder)
        out, now, temp = None, None, None

        def finish():
            out.close()
            fs.move(temp, f"{base}/part-{now:06d}.bin")

        for b in batches:
            rows = []
            for no, doc_id, data in zip(*(b.column(c).to_pylist() for c in ("file_no", "doc_id", "data")), strict=True):
                if no != now:
                    if out is not None:
                        finish()
                    now, temp = no, f"{base}/.tmp-{no:06d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp)
                    out.write(MAGIC + struct.pack("<II", width, 0))
                    place, offset, before = 0, len(MAGIC) + 8, 0
                record = frame(data)
                out.write(record)
                n = len(data) // width
                rows.append((no, place, doc_id, offset, len(record), n, before))
                place, offset, before = place + 1, offset + len(record), before + n
            cols = list(zip(*rows, strict=True))
            types = [pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            finish()
    return run


def write_token_files(docs: DataFrame, folder: str, spec: str, split: WordSplit, end_id: int, ids: int) -> DataFrame:
    """Write all of ``docs`` into binary files under ``folder``; returns the index, which
    lies as Parquet in ``folder/index``.  ``spec``: the tokenizer's JSON text; ``ids``:
    the size of its vocabulary (two bytes an id if that is enough)."""
    spark = docs.sparkSession
    bounded_batches(spark, 1024)
    width = 2 if max(ids, end_id + 1) <= 1 << 16 else 4
    tasks = shuffle_tasks(docs)
    files = tasks * FILES_A_TASK
    doc_id = F.col("doc_id").cast("long")
    cuts = docs.select(F.percentile_approx(F.coalesce(doc_id, F.lit(NO_ID)), [i / files for i in range(1, files)], 20 * files)).first()[0]
    shared = spark.sparkContext.broadcast(spec)  # a vocabulary file: a few MB, whatever the input
    fs, base = shared_files(folder)
    fs.create_dir(base, recursive=True)
    encoded = (docs.select(doc_id.alias("doc_id"), text_or_empty().alias("text"))
               .withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
               .mapInArrow(_encoder(shared, split, end_id, f"<u{width}", sorted(cuts or [])), "doc_id long, tie long, file_no int, data binary"))
    (encoded.repartition(tasks, "file_no").sortWithinPartitions("file_no", "doc_id", "tie", "data")
     .mapInArrow(_writer(folder, width), INDEX).write.mode("overwrite").parquet(f"{folder}/index"))
    return spark.read.parquet(f"{folder}/index")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared_files(folder)
        now, source, width = None, None, 0
        for b in batches:
            data = []
            for no, offset, length in zip(*(b.column(c).to_pylist() for c in ("file_no", "offset", "length")), strict=True):
                if no != now:
                    if source is not None:
                        source.close()
                    now, source = no, fs.open_input_file(f"{base}/part-{no:06d}.bin")
                    head = source.read_at(16, 0)
                    if head[:8] != MAGIC:
                        raise ValueError(f"part-{no:06d}.bin is no token file")
                    width = struct.unpack("<I", head[8:12])[0]
                ids = np.frombuffer(unframe(source.read_at(length, offset)), dtype=f"<u{width}").astype("<u4")
                data.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, "ids"])
    return run


def read_token_files(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """Index rows (all, or those given, in any order and with any further columns) with
    ``ids``, as little-endian unsigned 32-bit integers, read from the files and checked."""
    index = spark.read.parquet(f"{folder}/index") if index is None else index
    bounded_batches(spark)
    tasks = max(1, -(-index.select("file_no").distinct().count() // FILES_A_TASK))
    schema = ", ".join(f"`{n}` {k}" for n, k in index.dtypes)
    return (index.repartition(tasks, "file_no").sortWithinPartitions("file_no", "offset")
            .mapInArrow(_reader(folder), schema + ", ids binary"))


def token_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all records before, over all files."""
    files = index.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))  # one row a file
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return index.join(base, "file_no").withColumn("start", F.col("base") + F.col("before"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded, written, and read back from the files."""
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    folder = scratch_path(spark, f"token_files_{uuid.uuid4().hex[:8]}")
    index = write_token_files(documents(spark, sf_dir), folder, spec, WORD_END, END_ID, 49_408)
    return (read_token_files(spark, folder, token_starts(index))
            .select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
