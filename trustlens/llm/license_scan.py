"""Licence scan: ordered signature rules behind a keyword prefilter.

A text becomes its words (A-Z lower-cased).  Only places whose word is the keyword of
some rule are looked at, and there only the rules of that keyword are tried, each
anchored at the place, on as many of the words that follow as the longest of them can
take: no detection is cut.  Overlapping detections are resolved: one that lies inside
another of better priority, or of equal priority and more words, is suppressed, in one
ordered pass that carries the furthest end of each priority.  One pass over the
documents; nothing is shuffled.

Defined results: a null or wordless text has no detections, empty label lists and score
0.  Equal spans of equal priority all stay (their labels differ).  Rows that repeat a
doc_id each get a row.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import documents, words_of
from trustlens.llm.license_rules import CONFIDENCE, Rule, all_rules

#: Detections that the suppressing pass takes at a time: appending to a list copies it,
#: so a text's list grows by blocks.
BLOCK = 256
#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

DETECTION = "array<struct<start:int,stop:int,priority:int,label:string>>"


def _places(words: Column, wanted) -> Column:
    """Indexes of the words that satisfy ``wanted`` (a function of an index)."""
    n = F.size(words)
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), wanted)).otherwise(F.array().cast("array<int>"))


def _by_keyword(rules: list[Rule]) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for r in rules:
        for k in r.keywords:
            out.setdefault(k, []).append(r)
    return out


def _stands(words: Column, i: Column, phrase: str) -> Column:
    """Whether the words of ``phrase`` stand from word i on."""
    return reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(phrase.split())])


def detections(words: Column, rules: list[Rule]) -> Column:
    """All detections of ``rules`` in a word array; not yet resolved.  What contains a
    detection stands before it: by start, then the longest, then the best priority."""
    groups = _by_keyword(rules)
    single = [k for k in groups if " " not in k]
    phrases = [k for k in groups if " " in k]

    def try_rule(r: Rule, i: Column, ahead: Column) -> Column:
        seen = F.regexp_extract(ahead, rf"^(?:{r.pattern})(?= |$)", 0)
        return F.struct(i.alias("start"), F.when(seen != "", i + F.size(F.split(seen, " "))).alias("stop"),
                        F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"))

    def at(place: Column) -> Column:
        i, ahead = place["i"], place["ahead"]
        tried = F.array().cast(DETECTION)
        for key, own in groups.items():
            # one pattern for all rules of the keyword; each by itself only where it fits
            fits = ahead.rlike("^(?:" + "|".join(r.pattern for r in own) + ")(?: |$)")
            tried = F.when((place["key"] == key) & fits, F.array(*[try_rule(r, i, ahead) for r in own])).otherwise(tried)
        return F.filter(tried, lambda d: d["stop"].isNotNull())

    def key(i: Column) -> Column:
        word = F.get(words, i)
        out = F.when(word.isin(*single), word)
        for k in phrases:
            out = F.when(_stands(words, i, k), F.lit(k)).otherwise(out)
        return out

    def reach(k: Column) -> Column:
        out = F.lit(max((r.words for w in single for r in groups[w]), default=1))
        for w in phrases:
            out = F.when(k == w, F.lit(max(r.words for r in groups[w]))).otherwise(out)
        return out

    first = sorted({k.split()[0] for k in groups})
    keyed = F.filter(F.transform(_places(words, lambda i: F.get(words, i).isin(*first)),
                                 lambda i: F.struct(i.alias("i"), key(i).alias("key"))), lambda p: p["key"].isNotNull())
    looked = F.transform(keyed, lambda p: F.struct(p["i"].alias("i"), p["key"].alias("key"),
                                                   F.array_join(F.slice(words, p["i"] + 1, reach(p["key"])), " ").alias("ahead")))
    ordered = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(looked, at)), lambda d: F.struct(
        d["start"].alias("start"), (-d["stop"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label")))))
    return F.transform(ordered, lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("stop"),
                                                   d["priority"].alias("priority"), d["label"].alias("label")))


def resolve(found: Column) -> Column:
    """Detections (as ``detections`` orders them) without the suppressed ones.  For each
    priority the pass carries the furthest stop so far and the first start that reached
    it: a detection goes if a better priority reached its stop, or its own did so from an
    earlier start or went beyond."""
    ranks = sorted(CONFIDENCE)

    def seen(acc: Column, d: Column) -> list[Column]:
        own = [(d["priority"] == p) & (d["stop"] > acc[f"stop{p}"]) for p in ranks]
        return [F.when(own[k], d[part]).otherwise(acc[f"{part}{p}"]).alias(f"{part}{p}")
                for k, p in enumerate(ranks) for part in ("start", "stop")]

    def covered(acc: Column, d: Column) -> Column:
        return reduce(lambda a, b: a | b, [
            ((d["priority"] > p) & (acc[f"stop{p}"] >= d["stop"]))
            | ((d["priority"] == p) & ((acc[f"stop{p}"] > d["stop"]) | ((acc[f"stop{p}"] == d["stop"]) & (acc[f"start{p}"] < d["start"]))))
            for p in ranks])

    def step(acc: Column, d: Column) -> Column:
        return F.struct(*seen(acc, d), F.when(covered(acc, d), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    carried = [f"{part}{p}" for p in ranks for part in ("start", "stop")]
    none = F.array().cast(DETECTION)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda k: F.slice(found, k * BLOCK + 1, BLOCK))

    def block(acc: Column, part: Column) -> Column:
        begin = F.struct(*[acc[c].alias(c) for c in carried], none.alias("kept"))
        return F.aggregate(part, begin, step, lambda done: F.struct(
            *[done[c].alias(c) for c in carried], F.concat(acc["parts"], F.array(done["kept"])).alias("parts")))

    start = F.struct(*[F.lit(-1).alias(c) for c in carried], F.array().cast(f"array<{DETECTION}>").alias("parts"))
    return F.when(F.size(found) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["parts"]))).otherwise(none)


def _base_label(words: Column, i: Column) -> Column:
    """The label of the base phrase that begins at word i, else null."""
    label = F.lit(None).cast("string")
    for phrase, name in BASE.items():
        label = F.when(_stands(words, i, phrase), F.lit(name)).otherwise(label)
    return label


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, base (array of start, label), found (array
    of start, stop, priority, label, text; resolved)."""
    rules = rules or all_rules()
    first = sorted({p.split()[0] for p in BASE})
    w = F.col("words")
    base = F.filter(F.transform(_places(w, lambda i: F.get(w, i).isin(*first)),
                                lambda i: F.struct(i.alias("start"), _base_label(w, i).alias("label"))),
                    lambda b: b["label"].isNotNull())
    text = F.transform("kept", lambda d: F.struct(
        d["start"].alias("start"), d["stop"].alias("stop"), d["priority"].alias("priority"), d["label"].alias("label"),
        F.array_join(F.slice(w, d["start"] + 1, d["stop"] - d["start"]), " ").alias("text")))
    return (docs.select("doc_id", words_of(F.col("text")).alias("words"))
            .select("doc_id", "words", base.alias("base"), detections(w, rules).alias("raw"))
            .select("doc_id", "words", "base", resolve(F.col("raw")).alias("kept"))
            .select("doc_id", F.size("words").cast("long").alias("n_words"), "base", text.alias("found")))


def summary(scanned: DataFrame) -> DataFrame:
    """The scan's result as counts and label lists; the score is the confidence of the
    best detection that stays."""
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    base_labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    own = F.transform("found", lambda d: d["label"])
    sure = F.lit(0.0)
    for priority, confidence in sorted(CONFIDENCE.items(), reverse=True):
        sure = F.when(F.exists("found", lambda d: d["priority"] == priority), F.lit(confidence)).otherwise(sure)
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"), sure.alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and detections of all rules in the whole table ``documents``."""
    return summary(scan(documents(spark, sf_dir)))
