import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import docs, rows
from trustlens.llm import sharding as S


def brute_shard(doc_id, weights):
    def score(i):
        key = "null" if doc_id is None else str(doc_id)
        h = int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16)
        return -weights[i] / math.log((h + 0.5) / 2 ** 52)
    return max(range(len(weights)), key=lambda i: (score(i), -i))


@pytest.mark.parametrize("weights,range_rows", [([1.0] * 40, 65536), ([1.0, 2.5, 0.5], 16)])
def test_against_brute_force(spark, weights, range_rows):
    rnd = random.Random(2)
    texts = [rnd.choice([None, "", "é" * 9, "x" * 30000, f"t{rnd.random()}"]) for _ in range(900)]
    df = docs(spark, texts, extra=[("shard", "string", "a"), ("range", "int", 1), ("slot", "int", None)])
    got = rows(S.assign_shards(df, weights, range_rows), "doc_id")
    grown = [*weights, 1.0]
    slots = {}
    for i, (doc_id, size, crc, law, shard, slot, more) in enumerate(got):
        raw = (texts[i] or "").encode()
        assert (doc_id, size, crc, law) == (i, len(raw) + 16, zlib.crc32(raw), "key")
        assert shard == brute_shard(i, weights) and more == brute_shard(i, grown)
        assert more in (shard, len(weights))
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if len(weights) == 3:
        n = Counter(r[4] for r in got)
        assert n[1] > n[0] > n[2]


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = docs(spark, ["a", "a", "b", None, "c", ""], [1, 1, 1, None, None, 3])
    got = rows(S.assign_shards(df))
    assert len(got) == 6 and len({(r[4], r[5]) for r in got}) == 6
    assert len({r[4] for r in got if r[0] == 1}) == 1
    assert rows(S.assign_shards(docs(spark, []))) == []
