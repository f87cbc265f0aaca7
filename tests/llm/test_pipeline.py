"""The pipeline's stages and the registered queries."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pipelight.llm import line_dedup, minhash_dedup, toxicity
from pyspark.sql import functions as F

WORDS = [f"w{a}{b}" for a in "bcdfghklm" for b in ("an", "er", "in", "ol", "us", "et", "ag", "il")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with nulls, empty texts, repeated rows and clashing columns; labels; a benchmark."""
    import random

    r = random.Random(21)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    item, line, copied = say(20), " ".join(sorted(WORDS)[:12]), say(80)
    texts = [say(r.randint(20, 60)) for _ in range(30)]
    texts += [f"{say(30)}\n{line}\n{say(10)}" for _ in range(4)] + [f"{say(30)}\n{line}x"]
    texts += [copied, copied, copied.replace(copied.split()[40], "other", 1)]
    texts += [f"{say(300)} {item} {say(5)}", item, " ".join(item.split()[:12]), "", None, "a" * 50_000, f"you idiot {say(9)} you worthless clown"]
    rows = [(i, t, "en", None if i % 5 else "s", len(t or ""), 7, "id", "r") for i, t in enumerate(texts)] + [(3, texts[3], "en", "other", 1, 7, "id", "r"), (None, "no id", None, None, None, None, None, None)]
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, id string, rest string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def after(spark, docs, folder, name):
    """(rows before, rows after) a stage, as dictionaries; the stage keeps the columns."""
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert out.columns == docs.columns
    return [x.asDict() for x in docs.collect()], [x.asDict() for x in out.collect()]


def same(left, right):
    key = lambda d: sorted((k, str(v)) for k, v in d.items())
    assert sorted(map(key, left)) == sorted(map(key, right))


def test_toxicity_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, left = after(spark, docs, small, "toxicity")
    same(left, [x for x in before if not re.search("idiot|clown", x["text"] or "")])


def test_line_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, left = after(spark, docs, small, "line_dedup")
    order = sorted(range(len(before)), key=lambda i: (before[i]["doc_id"] is not None, before[i]["doc_id"] or 0, before[i]["text"] or ""))
    lines = [(i, j, x.strip()) for i in order for j, x in enumerate((before[i]["text"] or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if lines[a][2] == lines[b][2] or line_dedup.jaccard(lines[a][2].encode(), lines[b][2].encode()) >= 0.8:
                old, new = root[a], root[b]
                root = [min(old, new) if x in (old, new) else x for x in root]
    gone = {lines[a][:2] for a in range(len(lines)) if root[a] != a}
    assert gone
    want = []
    for i, x in enumerate(before):
        parts = (x["text"] or "").split("\n")
        text = "\n".join(p for j, p in enumerate(parts) if (i, j) not in gone)
        want.append(x | {"text": text, "n_chars": len(text)})
    same(left, want)


def test_near_duplicate_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, left = after(spark, docs, small, "minhash_near_dedup")
    order = sorted(before, key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, x["text"] or ""))
    root = list(range(len(order)))
    for a in range(len(order)):
        for b in range(a):
            s, t = ((order[i]["text"] or "").lower().encode() for i in (a, b))
            if s.split() == t.split() or minhash_dedup.weighted_jaccard(s, t) >= 0.8:
                old, new = root[a], root[b]
                root = [min(old, new) if x in (old, new) else x for x in root]
    key = lambda x: (x["doc_id"], x["text"] or "")
    assert sorted(map(str, map(key, left))) == sorted(str(key(order[a])) for a in range(len(order)) if root[a] == a)
    assert len(left) < len(before) - 3


def test_decontamination_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    item = words(spark.read.parquet(f"{small}/benchmark.parquet").where("item_id = 1").first()["text"])
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
    before, left = after(spark, docs, small, "benchmark_decontamination")
    want = [x for x in before if not any(tuple(words(x["text"])[i : i + 13]) in windows for i in range(len(words(x["text"]))))]
    assert len(want) == len(before) - 2
    same([{k: v or "" if k == "text" else v for k, v in x.items()} for x in left], [{k: v or "" if k == "text" else v for k, v in x.items()} for x in want])


def test_stages_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0, name


def test_run_follows_the_decisions(spark, small):
    packed = corpus_pipeline.run(spark, small)
    ids = {x.doc_id for x in packed.select("doc_id").distinct().collect()}
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert not any("idiot" in (texts[i] or "") for i in ids)
    assert {i for i in texts if i is not None and i < 30} <= ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert toxicity.THRESHOLD == 0.7


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, names = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf), name)
        assert docs.columns == names, name
        after = docs.count()
        assert 0.7 * before < after <= before, name
        assert docs.select("doc_id").distinct().count() == after
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length").collect()))


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
