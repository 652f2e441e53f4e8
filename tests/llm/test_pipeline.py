import random
import zlib

import pytest

import corpus_pipeline as P
from tests.llm.helpers import rows
from tests.llm.test_bpe import library, want
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_quality import corpus
from tests.llm.test_simhash import brute_components
from trustlens.llm import quality as Q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rnd = random.Random(6)
    texts, good = corpus(11, 260)
    items = [(k, texts[k * 5][:400]) for k in range(6)] + [(90, None), (91, "one two"), (None, "")]
    plain = [t for t, y in zip(texts, good, strict=True) if y and len(t) > 200]
    extra = [None, "", " "] + [rnd.choice(plain).replace(" ", "  \n", 1) for _ in range(15)]
    extra += [f"{rnd.choice(plain)} tail{k}" for k in range(15)] + [f"{rnd.choice(plain)}\n{items[k % 6][1]}" for k in range(12)]
    texts = texts + extra
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in enumerate(good)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, good, items


def test_stages_and_run_against_brute_force(spark, tables):
    folder, texts, good, items = tables
    left, docs = dict(enumerate(texts)), spark.read.parquet(f"{folder}/documents.parquet")
    field = Q.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = dict(rows(Q.score(docs, field)))
    held = [i for i in range(len(good)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scores[i] >= Q.THRESHOLD) == bool(good[i]) for i in held) >= 0.95 * len(held)
    sizes = []
    for name, stage in P.STAGES[:-1]:
        if name == "quality":
            left = {i: t for i, t in left.items() if scores[i] >= Q.THRESHOLD}
        elif name == "exact_dedup":
            left = {i: left[i] for i, _, _, kept, _ in brute_exact(left.items()) if kept}
        elif name == "simhash_near_dedup":
            left = {i: left[i] for i, _, root in brute_components(list(left.items())) if i == root}
        else:
            left = {i: left[i] for i, *_, bad in brute_hits(left.items(), items) if not bad}
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert got == left, name
        out.write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        sizes.append(len(left))
    assert len(texts) > sizes[0] > sizes[1] > sizes[2] > sizes[3] > 50
    lib = library()
    assert rows(P.run(spark, folder)) == sorted((want(lib, i, t) for i, t in left.items()), key=repr)


def test_empty_tables(spark, tables, tmp_path):
    folder = tables[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(P.run(spark, str(tmp_path))) == []


def test_quality_stage_without_a_label_to_learn_from(spark, tables, tmp_path):
    docs, labels = (spark.read.parquet(f"{tables[0]}/{name}.parquet") for name in ("documents", "labels"))
    for name, some in (("none", labels.limit(0)), ("held_out", labels.filter(Q.held_out(labels.doc_id)))):
        some.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert rows(P.quality_stage(spark, docs, f"{tmp_path}/{name}")) == rows(docs)
