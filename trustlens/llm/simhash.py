"""SimHash near duplicates by a self-join of the binary trie of fingerprints.

Fingerprints are 64 bits over word shingles.  The trie's upper levels are dealt to
tasks as node pairs whose prefixes differ in no more bits than the budget, deeper where
many fingerprints share their leading bits; inside a task the two subtrees are walked together, the differing bits of a pair of nodes add
up, and a pair is left as soon as they exceed the budget (or all below it is linked
already).  A task gives a spanning forest of its links, never all pairs; components
are found over distinct fingerprints and joined back to documents.

Defined results: a null text has no words; a text without words has fingerprint zero
and is linked like any other.  Fewer words than a shingle make one shingle.  Rows that
repeat a doc_id each get a row.  A null doc_id has a fingerprint and a component; the
component's name is its smallest doc_id (null if it has none).  Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import bounded_batches, documents
from trustlens.llm.components import components
from trustlens.session import materialize

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
#: Aim for the number of fingerprints under a node that goes to a task.
SUBTREE = 8192
#: A key that holds more than this share of all rows is joined without a shuffle.
HOT_KEYS = 10_000
#: Bits by which larger nodes are dealt on.
STEP = 4
#: Node pairs walked at once in a task, and shingles hashed at once.
BLOCK = 1 << 18
SHINGLE_BLOCK = 1 << 16


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash; a bit is set if it is set in over half the shingle hashes."""
    words = text.lower().split()  # of bytes: A-Z, and runs of \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(k))))
    total, ones = len(words) - k + 1, np.zeros(64, dtype=np.int64)
    while block := [xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, SHINGLE_BLOCK)]:
        bits = np.unpackbits(np.array(block, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), one row per document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = [_signed(fingerprint(t.as_py() or b"", k)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _masks(bits: int, budget: int) -> list[int]:
    """All numbers of so many bits with at most ``budget`` ones."""
    return [sum(1 << i for i in c) for n in range(budget + 1) for c in combinations(range(bits), n)]


def _absorb(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of i and j; label[x] is the smallest index of x's class."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def trie_links(values: np.ndarray, cut: int | None, depth: int, budget: int, block: int = BLOCK) -> np.ndarray:
    """Spanning forest of the links inside one node (cut None) or between two nodes of a
    binary trie.  ``values``: sorted distinct uint64; the second node's start at index
    ``cut``; values of a node share their first ``depth`` bits.  Returns for each index
    the smallest linked index."""
    n = len(values)
    label = np.arange(n)
    # zeros[k][x]: how many of the first x values have a 0 in bit 63 - k
    zeros: dict[int, np.ndarray] = {}

    def split(k: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if k not in zeros:
            bit = (values >> np.uint64(63 - k)) & np.uint64(1)
            zeros[k] = np.concatenate([[0], np.cumsum(bit == 0)])
        return lo + (zeros[k][hi] - zeros[k][lo])

    if n < 2:
        return label
    if cut is None:
        start = (0, n, 0, n, 0)
    else:
        apart = int(np.bitwise_count((values[0] ^ values[cut]) >> np.uint64(64 - depth))) if depth else 0
        start = (0, cut, cut, n, apart)
    todo = [(depth, *(np.array([x]) for x in start))]
    while todo:
        k, alo, ahi, blo, bhi, d = todo.pop()
        if len(alo) > block:  # walk one half after the other: memory stays bounded
            half = len(alo) // 2
            todo += [(k, *(x[half:] for x in (alo, ahi, blo, bhi, d))), (k, *(x[:half] for x in (alo, ahi, blo, bhi, d)))]
            continue
        self_ = alo == blo
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        pair = leaf & ~self_
        if pair.any():
            i, j = alo[pair], blo[pair]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            label = _absorb(label, i[near], j[near])
        # leave pairs of nodes whose values are all linked already
        change = np.flatnonzero(label[1:] != label[:-1]) + 1
        run_end = np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]
        linked = (run_end[alo] >= ahi) & (run_end[blo] >= bhi) & (label[alo] == label[blo])
        go = ~leaf & ~linked
        if k == 64 or not go.any():
            continue
        alo, ahi, blo, bhi, d, self_ = (x[go] for x in (alo, ahi, blo, bhi, d, self_))
        am, bm = split(k, alo, ahi), split(k, blo, bhi)
        other = ~self_
        parts = [(alo, am, blo, bm, d), (am, ahi, bm, bhi, d), (alo, am, bm, bhi, d + 1),
                 tuple(x[other] for x in (am, ahi, blo, bm, d + 1))]
        alo, ahi, blo, bhi, d = (np.concatenate(x) for x in zip(*parts))
        ok = (ahi > alo) & (bhi > blo) & (d <= budget)
        if ok.any():
            todo.append((k + 1, *(x[ok] for x in (alo, ahi, blo, bhi, d))))
    return label


def _walker(depth: int, budget: int):
    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        values = np.sort(rows.column("fp").to_numpy().astype(np.int64).view(np.uint64))
        cut = None
        if key[0].as_py() != key[1].as_py():
            prefix = values >> np.uint64(64 - depth)
            cut = int(np.searchsorted(prefix, prefix[0], side="right"))
            if cut == len(values):  # the other node is empty
                values, cut = values[:0], None
        label = trie_links(values, cut, depth, budget)
        moved = np.flatnonzero(label != np.arange(len(values)))
        return pa.Table.from_arrays(
            [pa.array(values[moved].view(np.int64)), pa.array(values[label[moved]].view(np.int64))], names=["a", "b"])
    return walk


def deal(distinct: DataFrame, n: int, budget: int = MAX_DISTANCE, subtree: int = SUBTREE) -> Iterator[tuple[int, DataFrame]]:
    """(depth, rows fp, p, q): node pairs (p, q) of a depth, each with its fingerprints.
    The first depth follows from the number of fingerprints n; pairs with a node of more
    than twice ``subtree`` are dealt on by further bits until there is none."""
    depth = min(24, max(0, (n // subtree).bit_length()))
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(depth, budget)])).alias("diff"))
    while True:
        prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
        other = prefix.bitwiseXOR(F.col("diff"))
        pairs = rows.select("fp", "diff", prefix.alias("own"), other.alias("other"))
        nodes = materialize(distinct.groupBy(prefix.alias("node")).count(), "simhash_nodes")
        if depth and nodes.count() < 1 << depth:  # pairs with an empty node link nothing
            pairs = pairs.join(nodes.select(F.col("node").alias("other")), "other", "left_semi")
        large = nodes.filter(F.col("count") > 2 * subtree).select("node")
        more = depth < 64 and not large.isEmpty()
        if more:
            for side in ("own", "other"):
                pairs = pairs.join(large.select(F.col("node").alias(side), F.lit(True).alias(f"large_{side}")), side, "left")
            split = F.coalesce("large_own", "large_other", F.lit(False))
            rest = materialize(pairs.filter(split).select("fp", "diff"), "simhash_large")
            pairs = pairs.filter(~split)
        yield depth, pairs.select("fp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        if not more:
            return
        bits = min(STEP, 64 - depth)
        depth += bits
        left = F.lit(budget) - F.bit_count("diff")
        masks = reduce(lambda w, b: w.when(left == b, F.array(*[F.lit(m).cast("long") for m in _masks(bits, b)])), range(budget + 1), F)
        rows = rest.select("fp", "diff", F.explode(masks).alias("mask")).select("fp", F.shiftleft("diff", bits).bitwiseOR(F.col("mask")).alias("diff"))


def near_links(distinct: DataFrame, n: int, budget: int = MAX_DISTANCE, subtree: int = SUBTREE) -> DataFrame:
    """Links (a, b) that connect all of ``distinct`` (fp) at ``budget`` bits or fewer."""
    return reduce(DataFrame.unionAll, (pairs.groupBy("p", "q").applyInArrow(_walker(depth, budget), "a long, b long")
                                       for depth, pairs in deal(distinct, n, budget, subtree)))


def look_up(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``found``, which has one row a key, with the rows of the key as
    ``n_rows`` (``total`` of all).  A key of more than total / HOT_KEYS rows is looked up in
    a broadcast table, of fewer than HOT_KEYS keys whatever the input, so that its rows
    need not meet in one task."""
    is_hot = F.col("n_rows") * HOT_KEYS > total
    hot = F.broadcast(found.filter(is_hot).drop("n_rows"))
    cold = rows.join(F.broadcast(found.filter(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(found.filter(~is_hot).drop("n_rows"), key))


def _members(docs: DataFrame, k: int, budget: int, subtree: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, fp) of every document, (fp, root, component_id) of every fingerprint, and
    the first with what the second has for the document's fingerprint."""
    prints = materialize(fingerprints(docs, k), "simhash_fingerprints")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs")), "simhash_distinct")
    n, total = least.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    roots = components(near_links(least.select("fp"), n, budget, subtree))
    member = materialize(least.join(roots, least.fp == roots.node, "left")
                         .select("fp", "first_id", "n_docs", F.coalesce("root", "fp").alias("root")), "simhash_members")
    named = materialize(member.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_rows")), "simhash_components")
    by_fp = materialize(look_up(member.drop("first_id"), named, "root", n).select("fp", "root", "component_id", F.col("n_docs").alias("n_rows")), "simhash_named")
    return prints, by_fp.drop("n_rows"), look_up(prints, by_fp, "fp", total)


def near_groups(docs: DataFrame, k: int = SHINGLE_WORDS, budget: int = MAX_DISTANCE, subtree: int = SUBTREE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    _, _, found = _members(docs, k, budget, subtree)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE_WORDS, budget: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with the document of smallest doc_id of each component, all columns kept.
    A component without an id keeps its row of smallest text (then smallest other
    columns); elsewhere rows without an id go.  Rows of a component that repeat the
    doc_id of its kept one stay with it; in another component that doc_id counts anew."""
    prints, by_fp, found = _members(docs, k, budget, SUBTREE)
    own = F.col("doc_id") == F.col("component_id")
    found = found.filter(F.col("doc_id").isNotNull())
    kept = materialize(found.groupBy("doc_id").agg(F.max(own).alias("some"), F.min(own).alias("all")).filter("some"), "simhash_kept")
    parts = [docs.join(kept.filter("all"), "doc_id", "left_semi")]

    def with_fp(rows: DataFrame) -> DataFrame:
        return fingerprints(rows.select(F.struct(*docs.columns).alias("doc_id"), "text"), k).withColumnRenamed("doc_id", "row")

    # where the id alone doesn't tell a kept row, the fingerprint does
    mixed = kept.filter(~F.col("all"))
    if not mixed.isEmpty():
        right = found.filter(own).select("doc_id", "fp").distinct()
        rows = with_fp(docs.join(mixed, "doc_id", "left_semi"))
        parts.append(rows.join(right, (rows["row"]["doc_id"] == right.doc_id) & (rows.fp == right.fp), "left_semi").select("row.*"))
    if not prints.filter(F.col("doc_id").isNull()).isEmpty():
        order = ["text", *(f.name for f in docs.schema if f.name != "text" and "map<" not in f.dataType.simpleString())]
        rows = with_fp(docs.filter(F.col("doc_id").isNull())).join(by_fp.filter(F.col("component_id").isNull()), "fp")
        parts.append(rows.groupBy("root").agg(F.min_by("row", F.struct(*(F.col("row")[c] for c in order))).alias("row")).select("row.*"))
    return reduce(DataFrame.unionAll, (p.select(*docs.columns) for p in parts))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of the whole table ``documents``."""
    return near_groups(documents(spark, sf_dir))
