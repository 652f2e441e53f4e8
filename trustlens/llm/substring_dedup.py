"""Repeated byte strings, by an enhanced suffix array over content-defined anchors.

A suffix array of every byte would be many times the corpus.  Instead each string of
``least`` bytes names one anchor in it: the place of its smallest ``gram``-byte hash.
Equal strings name anchors at equal places, so every repeat of ``least`` bytes or more
holds an anchor with its whole context of ``least`` bytes, and it is enough to sort
the suffixes at anchors, each with ``least - gram`` bytes before it.

1. Scan tasks give their anchors' hashes, packed, with how often they occur; a shuffle on
   the hash finds those that occur more than once, and those that occur more than HOT_ROWS
   times, and sends back two bits for each.
2. Scan tasks give the contexts of repeated anchors.  Of equal contexts in a task only
   the first goes on; the others are repeats of it as a whole.  A hot anchor's contexts are
   dealt by what stands around it: a repeated string begins in one of HOT_RANGES ranges of
   places before the anchor, and contexts that share a string of a range share all bytes
   that every string of the range has.  These bytes are the key in place of the hash, once
   for each range, so the contexts of a string meet, and those of the anchor need not.
3. A shuffle on the key and a sort build the suffix array.  The intervals of its
   common-prefix tree give maximal repeats with all occurrences (``repeats``); in each,
   everything but the first occurrence is marked.  A key with more than GROUP_ROWS
   distinct contexts goes on as single strings, whose first occurrence is a grouped
   minimum.
4. Marks of a document are merged and its bytes are cut.

The bits of step 1 are for known batches of rows.  A batch that is found otherwise (the
scan was cut differently after a loss) takes all its anchors as repeated and deals them
both ways: more work, the same result.

Defined results: a null text is empty; documents are ordered by doc_id, null last.  Rows
that repeat a doc_id with other text are ordered by a hash of their texts; rows that
repeat doc_id and text are one document and get one result each.  Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import bounded_batches, documents, powers, ragged_take, shared_files, shuffle_tasks, text_or_empty
from trustlens.llm.repeats import common, repeats, sort_key
from trustlens.session import materialize, scratch_path

LEAST = 100
GRAM = 32
#: Bytes whose hashes are held at once, and text of one batch of anchors.
PIECE = 1 << 20
GROUP_BYTES = 1 << 22
#: Places of an anchor beyond which it is dealt by the bytes around it, and the ranges.
HOT_ROWS = 25_000
HOT_RANGES = 4
#: Shuffle tasks for each scan part.
TASKS_A_PART = 2
#: Contexts of one key that one task takes, and contexts taken together.
GROUP_ROWS = 50_000
TREE_ROWS = 16_384
BASE = 0x9E3779B97F4A7C15
LAST_ID = (1 << 63) - 1


class Anchors:
    """Finds the anchors of texts that lie end to end."""

    def __init__(self, least: int = LEAST, gram: int = GRAM, piece: int = PIECE):
        self.least, self.gram, self.piece = least, gram, piece
        n = piece + least + 1
        self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all anchors."""
        places, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        span = self.least - self.gram + 1
        # 1 where a string of ``least`` bytes may begin
        long = ends - starts >= self.least
        step = np.zeros(len(data) + 1, dtype=np.int8)
        step[starts[long]] += 1
        np.add.at(step, ends[long] - self.least + 1, np.int8(-1))
        begins = np.cumsum(step, dtype=np.int8)[:-1] > 0
        for at in range(0, len(data), self.piece):
            part = data[at:at + self.piece + self.least - 1]
            valid = begins[at:at + self.piece][:max(0, len(part) - self.least + 1)]
            if not valid.any():
                continue
            n = len(part)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
            h = (total[self.gram:] - total[:-self.gram]) * self.down[:n - self.gram + 1]
            for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xFF51AFD7ED558CCD)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            h ^= h >> np.uint64(32)
            low = np.uint64((1 << 24) - 1)
            least = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # of equal hashes the last place
            width = 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if span > width:
                least = np.minimum(least[:width - span], least[span - width:])
            own = least[:len(valid)][valid]
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]  # windows that follow share their anchor
            place = np.unique((low - (own & low)).astype(np.int64))
            places.append(place + at)
            hashes.append(h[place])
        place, first = np.unique(np.concatenate(places), return_index=True)
        return place, np.concatenate(hashes)[first]


class Batch:
    """Rows of a scan task taken together: texts end to end and their anchors."""

    def __init__(self, parts: list[pa.RecordBatch], anchors: Anchors):
        t = pa.Table.from_batches(parts).combine_chunks()
        texts = t.column("text").combine_chunks().cast(pa.large_binary())
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[ends[0]:ends[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        ends = ends - ends[0]
        self.starts, self.ends = ends[:-1], ends[1:]
        self.ord = t.column("ord").to_numpy()
        self.sub = t.column("sub").to_numpy()
        self.places, self.hashes = anchors.find(self.data, self.starts, self.ends)
        self.distinct, self.which, counts = np.unique(self.hashes, return_inverse=True, return_counts=True)
        self.twice = counts > 1
        self.level = np.ceil(np.log2(counts)).astype(np.uint8)  # each occurs 2^level times or fewer
        self.digest = xxhash.xxh64_intdigest(self.distinct.tobytes()) >> 1


def _grouped(batches: Iterator[pa.RecordBatch], anchors: Anchors, group_bytes: int) -> Iterator[Batch]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column("text").nbytes
        if size >= group_bytes:
            yield Batch(held, anchors)
            held, size = [], 0
    if held:
        yield Batch(held, anchors)


def _bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted hashes of each of 2^k buckets (top bits) begin, and the end."""
    bits = buckets.bit_length() - 1
    if not bits:
        return np.array([0, len(hashes)])
    return np.concatenate([np.searchsorted(hashes >> np.uint64(64 - bits), np.arange(buckets, dtype=np.uint64)), [len(hashes)]])


PACKED = "bucket int, part int, seq int, digest long, hashes binary, levels binary"
BITS = "part int, seq int, bucket int, digest long, bits binary"


def _give_hashes(make, buckets: int, group_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, anchors = TaskContext.get().partitionId(), make()
        for seq, g in enumerate(_grouped(batches, anchors, group_bytes)):
            edges = _bucket_edges(g.distinct, buckets)
            rows = [(k, part, seq, g.digest, g.distinct[edges[k]:edges[k + 1]].tobytes(), g.level[edges[k]:edges[k + 1]].tobytes())
                    for k in range(buckets) if edges[k] < edges[k + 1]]
            if rows:
                yield _batch(rows, PACKED)
    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])


def _find_repeated(hot_rows: int):
    """All packed hashes of a bucket, in order of the bucket: a bit for each that is
    repeated, then a bit for each that occurs more than ``hot_rows`` times."""
    def flush(held: list[tuple]) -> pa.RecordBatch:
        arrays = [np.frombuffer(r[4], dtype=np.uint64) for r in held]
        levels = np.frombuffer(b"".join(r[5] for r in held), dtype=np.uint8)
        _, which, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
        places = np.bincount(which, weights=np.exp2(levels))
        ends = np.cumsum([len(a) for a in arrays])[:-1]
        again, hot = np.split(counts[which] > 1, ends), np.split(places[which] > hot_rows, ends)
        return _batch([(r[1], r[2], r[0], r[3], np.packbits(x).tobytes() + np.packbits(y).tobytes())
                       for r, x, y in zip(held, again, hot, strict=True)], BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != now and held:
                    yield flush(held)
                    held = []
                now = r[0]
                held.append(r)
        if held:
            yield flush(held)
    return run


def _read_bits(folder: str, part: int) -> dict[tuple[int, int], dict[int, bytes]]:
    fs, base = shared_files(folder)
    out: dict[tuple[int, int], dict[int, bytes]] = {}
    for f in fs.get_file_info(pafs.FileSelector(f"{base}/part={part}", allow_not_found=True)):
        if f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                t = pq.read_table(source, columns=["seq", "digest", "bucket", "bits"])
            for seq, digest, bucket, bits in zip(*(c.to_pylist() for c in t.columns), strict=True):
                out.setdefault((seq, digest), {})[bucket] = bits
    return out


#: A context of an anchor (``n`` bytes are marked before and from it on where it is no
#: first occurrence) under its key, or a mark on a document's bytes: then hash, right and
#: left are null.
CONTEXT = "hash long, right binary, left binary, ord long, sub long, start long, stop long"


def _binary(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ragged_take(data, starts, sizes).tobytes())])


def _marks(ord_: np.ndarray, sub: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Marks, those of a document that touch put together."""
    order = np.lexsort((start, sub, ord_))
    ord_, sub, start, stop = ord_[order], sub[order], start[order], stop[order]
    if len(ord_):
        new = np.concatenate([[True], (ord_[1:] != ord_[:-1]) | (sub[1:] != sub[:-1])])
        no = np.cumsum(new) - 1
        lift = no * (int(stop.max()) + 2)  # puts documents apart, so that one running maximum does
        reach = np.maximum.accumulate(stop + lift)
        head = np.flatnonzero(np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]]))
        stop = (reach - lift)[np.append(head[1:], len(ord_)) - 1]
        ord_, sub, start = ord_[head], sub[head], start[head]
    none = pa.nulls(len(ord_))
    return pa.RecordBatch.from_arrays(
        [none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary()), *(pa.array(x, pa.int64()) for x in (ord_, sub, start, stop))],
        names=[f.split()[0] for f in CONTEXT.split(", ")])


def _hot_ranges(least: int, gram: int) -> list[tuple[int, int]]:
    """First and last of the places before an anchor where strings of a range begin."""
    return [(int(r[0]), int(r[-1])) for r in np.array_split(np.arange(least - gram + 1), HOT_RANGES) if len(r)]


def _give_contexts(make, buckets: int, group_bytes: int, folder: str, before: int, after: int, merge: bool, ranges: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, anchors = TaskContext.get().partitionId(), make()
        known = _read_bits(folder, part)
        for seq, g in enumerate(_grouped(batches, anchors, group_bytes)):
            if not len(g.places):
                continue
            again, hot = np.ones(len(g.distinct), dtype=bool), np.zeros(len(g.distinct), dtype=bool)
            bits = known.get((seq, g.digest))
            if bits:
                edges = _bucket_edges(g.distinct, buckets)
                for k, packed in bits.items():
                    n = edges[k + 1] - edges[k]
                    two = np.frombuffer(packed, dtype=np.uint8).reshape(2, -1)
                    again[edges[k]:edges[k + 1]], hot[edges[k]:edges[k + 1]] = np.unpackbits(two, axis=1, count=n)
                again |= g.twice
            at = again[g.which]
            place, hashed, hot = g.places[at], g.hashes[at], hot[g.which][at]
            doc = np.searchsorted(g.ends, place, side="right")
            # texts without bytes end where the next begins: take the one that holds the place
            n_left = np.minimum(place - g.starts[doc], before)
            n_right = np.minimum(g.ends[doc] - place, after)
            ord_, sub, pos = g.ord[doc], g.sub[doc], place - g.starts[doc]
            if merge and len(place):
                order = np.lexsort((pos, sub, ord_))
                wide = np.zeros((len(place), before + after), dtype=np.uint8)
                col = np.arange(before + after)
                for k in range(0, len(order), 8192):
                    o = order[k:k + 8192]
                    inside = (col >= (before - n_left[o])[:, None]) & (col < (before + n_right[o])[:, None])
                    wide[k:k + 8192][inside] = g.data[(place[o][:, None] - before + col)[inside]]
                _, first = np.unique(sort_key(wide, n_left[order] << 16 | n_right[order]), return_index=True)
                head = np.zeros(len(order), dtype=bool)
                head[first] = True  # np.unique gives the first of equal rows
                later = order[~head]
                if len(later):
                    yield _marks(ord_[later], sub[later], pos[later] - n_left[later], pos[later] + n_right[later])
                order = order[head]
                place, hashed, hot, n_left, n_right, ord_, sub, pos = (x[order] for x in (place, hashed, hot, n_left, n_right, ord_, sub, pos))

            def under(rows: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
                for a in range(0, len(rows), 20_000):
                    s = rows[a:a + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[a:a + 20_000].view(np.int64)), _binary(g.data, place[s], n_right[s]), _binary(g.data, place[s] - n_left[s], n_left[s]),
                         pa.array(ord_[s]), pa.array(sub[s]), pa.array(pos[s]), pa.array(pos[s])], names=[f.split()[0] for f in CONTEXT.split(", ")])

            plain = np.flatnonzero(~hot)
            yield from under(plain, hashed[plain])
            for no, (first, last) in enumerate(ranges):
                need = after - last  # bytes from the anchor on that all strings of the range have
                rows = np.flatnonzero((hot if bits else True) & (n_left >= first) & (n_right >= need))
                if len(rows):
                    keys = (xxhash.xxh64_intdigest(g.data[p - first:p + need].tobytes(), no + 1) for p in place[rows].tolist())
                    yield from under(rows, np.fromiter(keys, dtype=np.uint64, count=len(rows)))
    return run


def _matrix(arr: pa.Array, width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of ``width`` bytes (zeros after them) and their lengths."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    ends = np.frombuffer(arr.buffers()[1], dtype=np.int32)[arr.offset:arr.offset + len(arr) + 1]
    sizes = np.diff(ends).astype(np.int64)
    out = np.zeros((len(arr), width), dtype=np.uint8)
    col = np.arange(width)
    inside = col < sizes[:, None]
    src = (ends[1:, None] - 1 - col) if backwards else (ends[:-1, None] + col)
    if inside.any():
        out[inside] = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[src[inside]]
    return out, sizes


class Group:
    """Sorted contexts with one or more whole hash groups."""

    def __init__(self, t: pa.Table, before: int, after: int):
        self.hash = t.column("hash").to_numpy()
        self.right, self.n_right = _matrix(t.column("right"), after)
        self.left, self.n_left = _matrix(t.column("left"), before, backwards=True)
        self.ord, self.sub, self.pos = (t.column(c).to_numpy() for c in ("ord", "sub", "start"))

    def same_as_before(self) -> np.ndarray:
        """Rows whose context equals that of the row before."""
        if not len(self.hash):
            return np.zeros(0, dtype=bool)
        eq = (self.hash[1:] == self.hash[:-1]) & (self.n_right[1:] == self.n_right[:-1]) & (self.n_left[1:] == self.n_left[:-1])
        eq &= (self.right[1:] == self.right[:-1]).all(axis=1) & (self.left[1:] == self.left[:-1]).all(axis=1)
        return np.concatenate([[False], eq])

    def found(self, rows: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Maximal repeats among the distinct contexts ``rows``."""
        if len(rows) < 2:
            return
        h, right, n_right, left, n_left = (x[rows] for x in (self.hash, self.right, self.n_right, self.left, self.n_left))
        key = sort_key(left, n_left)
        lcp = common(right[:-1], n_right[:-1], right[1:], n_right[1:])
        edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                for before, after, members in repeats(right[a:b], n_right[a:b], left[a:b], n_left[a:b], key[a:b], least, lcp[a:b - 1]):
                    yield before, after, rows[members + a]


def _whole_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, pa.Table]]:
    """Sorted rows as ("marks", rows without hash), ("group", whole hash groups) and
    ("large", rows of a group of more than ``limit`` rows, in pieces)."""
    held: pa.Table | None = None
    large = None
    for b in batches:
        t = pa.Table.from_batches([b])
        marks = t.filter(t.column("hash").is_null())
        if len(marks):
            yield "marks", marks
        t = t.filter(t.column("hash").is_valid())
        if large is not None and len(t):
            n = int(np.searchsorted(t.column("hash").to_numpy(), large, side="right"))
            if n:
                yield "large", t.slice(0, n)
            t = t.slice(n)
            large = large if not len(t) else None
        held = t if held is None else pa.concat_tables([held, t])
        if len(held) < TREE_ROWS:
            continue
        h = held.column("hash").to_numpy()
        cut = int(np.searchsorted(h, h[-1], side="left"))
        if cut:
            yield "group", held.slice(0, cut)
            held = held.slice(cut)
        if len(held) > limit:
            large = h[-1]
            yield "large", held
            held = None
    if held is not None and len(held):
        yield "group", held


def _scan_tree(least: int, before: int, after: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, t in _whole_groups(batches, limit):
            if kind != "group":
                yield from t.combine_chunks().to_batches()
                continue
            g = Group(t, before, after)
            same = g.same_as_before()
            later = np.flatnonzero(same)
            if len(later):  # rows are in order of their place: the first of a run stays
                yield _marks(g.ord[later], g.sub[later], g.pos[later] - g.n_left[later], g.pos[later] + g.n_right[later])
            rows = np.flatnonzero(~same)
            start, stop = g.pos.copy(), g.pos.copy()
            rank = np.empty(len(g.pos), dtype=np.int64)
            rank[np.lexsort((g.pos, g.sub, g.ord))] = np.arange(len(g.pos))
            for b, a, members in g.found(rows, least):
                members = members[members != members[rank[members].argmin()]]
                start[members] = np.minimum(start[members], g.pos[members] - b)
                stop[members] = np.maximum(stop[members], g.pos[members] + a)
            hit = np.flatnonzero(stop > start)
            if len(hit):
                yield _marks(g.ord[hit], g.sub[hit], start[hit], stop[hit])
    return run


GROUPS = "repeat string, n_bytes int, ord long, sub long, start long"


def _give_groups(least: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _whole_groups(batches, 1 << 62):
            g = Group(t, reach, reach)
            same = g.same_as_before()
            run_no, rows = np.cumsum(~same) - 1, np.flatnonzero(~same)
            last = np.append(rows[1:], len(same))
            found = list(g.found(rows, least))
            found += [(int(g.n_left[r]), int(g.n_right[r]), np.array([r])) for r, e in zip(rows, last, strict=True)
                      if e - r > 1 and g.n_left[r] + g.n_right[r] >= least]
            out = []
            for b, a, members in found:
                r = members[0]
                text = g.left[r, :b][::-1].tobytes() + g.right[r, :a].tobytes()
                for m in members:
                    no = run_no[m]
                    for k in range(rows[no], last[no]):
                        out.append((hashlib.sha256(text).hexdigest(), a + b, g.ord[k], g.sub[k], g.pos[k] - b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.string(), pa.int32(), *[pa.int64()] * 3], strict=True)],
                                                 names=[f.split()[0] for f in GROUPS.split(", ")])
    return run


def _strings(least: int):
    """Every string of ``least`` bytes in a context that holds the anchor's first byte."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for right, left, *who, pos in zip(*(b.column(c).to_pylist() for c in ("right", "left", "ord", "sub", "start")), strict=True):
                text = left + right
                out += [(text[k:k + least], *who, pos - len(left) + k) for k in range(len(text) - least + 1)]
            for a in range(0, len(out), 20_000):
                yield _batch(out[a:a + 20_000], "string binary, ord long, sub long, start long")
    return run


def _ordered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, and the document's place in the order: ord, and sub, which is 0
    unless rows repeat a doc_id.  Once for all rows, and once with each document once."""
    own = docs.select("doc_id", text_or_empty().alias("text")).withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)))
    repeated = materialize(own.groupBy("ord").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("ord"), "repeated_ids")
    if repeated.isEmpty():
        own = own.withColumn("sub", F.lit(0).cast("long"))
        return own, own
    own = (own.join(repeated.withColumn("many", F.lit(True)), "ord", "left")
            .withColumn("sub", F.when(F.col("many"), F.xxhash64("doc_id", "text")).otherwise(F.lit(0))).drop("many"))
    return own, own.dropDuplicates(["ord", "sub"])


def _contexts(docs: DataFrame, least: int, gram: int, before: int, after: int, merge: bool, group_bytes: int, piece: int,
              n: int, hot_rows: int | None) -> DataFrame:
    """Steps 1 and 2, sorted as a suffix array inside the ``n`` partitions of a shuffle by
    key.  ``hot_rows`` None: the hash is every anchor's key."""
    spark = docs.sparkSession
    buckets = 1 << max(0, (n - 1).bit_length())
    make = lambda: Anchors(least, gram, piece)
    texts = docs.select("ord", "sub", "text")
    folder = scratch_path(spark, f"repeat_bits_{uuid.uuid4().hex[:8]}")
    (texts.mapInArrow(_give_hashes(make, buckets, group_bytes), PACKED)
     .repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_find_repeated(1 << 62 if hot_rows is None else hot_rows), BITS)
     .repartition(n, "part").write.mode("overwrite").partitionBy("part").parquet(folder))
    ranges = [] if hot_rows is None else _hot_ranges(least, gram)
    given = texts.mapInArrow(_give_contexts(make, buckets, group_bytes, folder, before, after, merge, ranges), CONTEXT)
    # marks have no hash: they are dealt by document
    key = F.coalesce("hash", F.xxhash64("ord", "start"))
    return given.repartition(n, key).sortWithinPartitions("hash", "right", "left", "ord", "sub", "start")


def marks(docs: DataFrame, least: int = LEAST, gram: int = GRAM, limit: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES,
          piece: int = PIECE, hot_rows: int = HOT_ROWS, tasks: int | None = None) -> DataFrame:
    """(ord, sub, start, stop): byte ranges of ``docs`` (ord, sub, text) that are covered
    by strings of ``least`` bytes that also start earlier.  Ranges may overlap."""
    before = least - gram
    tasks = tasks or shuffle_tasks(docs, TASKS_A_PART)
    scanned = materialize(
        _contexts(docs, least, gram, before, least, True, group_bytes, piece, tasks, hot_rows).mapInArrow(_scan_tree(least, before, least, limit), CONTEXT), "repeat_marks")
    out = scanned.filter("hash IS NULL").select("ord", "sub", "start", "stop")
    large = scanned.filter("hash IS NOT NULL")
    if large.isEmpty():
        return out
    strings = materialize(large.mapInArrow(_strings(least), "string binary, ord long, sub long, start long").distinct(), "repeat_strings")
    first = strings.groupBy("string").agg(F.min(F.struct("ord", "sub", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    more = (strings.join(first, "string").filter(F.struct("ord", "sub", "start") > F.col("first"))
            .select("ord", "sub", "start", (F.col("start") + least).alias("stop")))
    return out.unionByName(more)


def repeat_groups(docs: DataFrame, least: int = LEAST, gram: int = GRAM, reach: int = 1024) -> DataFrame:
    """Maximal repeats of ``least`` bytes or more as groups with all their occurrences:
    repeat (digest of its bytes), n_bytes, doc_id, start.  Contexts go ``reach`` bytes
    either way of an anchor; a repeat longer than that comes as several that overlap."""
    bounded_batches(docs.sparkSession)
    own, once = _ordered(docs)
    reach = max(reach, least)
    found = (_contexts(once, least, gram, reach, reach, False, GROUP_BYTES, PIECE, shuffle_tasks(docs, TASKS_A_PART), None).filter("hash IS NOT NULL")
             .mapInArrow(_give_groups(least, reach), GROUPS).distinct())
    ids = own.select("doc_id", "ord", "sub").distinct()
    return found.join(ids, ["ord", "sub"]).select("repeat", "n_bytes", "doc_id", "start")


def _cut(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            texts = b.column("text").cast(pa.large_binary())
            for text, spans in zip(texts, b.column("spans").to_pylist(), strict=True):
                raw = text.as_buffer()
                kept, at, n_spans, removed = hashlib.sha256(), 0, 0, 0
                for s in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if s[0] > at or not n_spans:
                        kept.update(raw.slice(at, s[0] - at))
                        n_spans, at, removed = n_spans + 1, s[1], removed + s[1] - s[0]
                    elif s[1] > at:
                        removed, at = removed + s[1] - at, s[1]
                kept.update(raw.slice(at))
                out.append((raw.size, removed, n_spans, kept.hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def remove_repeats(docs: DataFrame, least: int = LEAST, **how) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    bounded_batches(docs.sparkSession)
    own, once = _ordered(docs)
    spans = marks(once, least, tasks=shuffle_tasks(docs, TASKS_A_PART), **how).groupBy("ord", "sub").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (own.join(spans, ["ord", "sub"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_cut(kind), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier, removed from the whole table ``documents``."""
    return remove_repeats(documents(spark, sf_dir))


#: Every string of 100 bytes, as hex digits, with its first place.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM d, LATERAL unnest(range(greatest(n - 99, 0))) r(i)),
f AS (SELECT s, min((doc_id, i)) AS first FROM p GROUP BY s HAVING count(*) > 1),
m AS (SELECT doc_id, i FROM p JOIN f USING (s) WHERE (doc_id, i) > first),
b AS (SELECT doc_id, i, i - lag(i) OVER w AS gap, lead(i) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, sum(least(coalesce(nxt, i + 100), i + 100) - i) AS n_removed, count(*) FILTER (gap IS NULL OR gap > 100) AS n_spans FROM b GROUP BY doc_id),
e AS (SELECT doc_id, i, coalesce(lag(i) OVER w + 100, 0) AS kept_from, lead(i) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, string_agg(substr(h, 2 * kept_from + 1, greatest(2 * (i - kept_from), 0)), '' ORDER BY i) || substr(any_value(h), 2 * (max(i) + 100) + 1) AS kept
      FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN encode(text) ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
"""
