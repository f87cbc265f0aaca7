"""Exact and near duplicates against brute force, on small corpora with edge cases."""

import collections
import random

import numpy as np
import pytest

from pipelight.llm import components, line_dedup, minhash_dedup, neardup, substring_dedup, suffix_dedup, windows

SCHEMA = "doc_id long, text string, lang string, key long, bucket string"


def corpus(seed=1, n=60):
    """Texts with shared passages, exact and near copies, runs, and empty or null ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    passage = [r.choice(words) for _ in range(120)]
    texts = []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(0, 150))]
        if i % 4 == 0:
            at = r.randint(0, 60)
            own[len(own) // 2 : len(own) // 2] = passage[at : at + r.randint(10, 60)]
        if i % 7 == 0 and texts:
            own = texts[r.randrange(len(texts))].split(" ")
            if own and i % 2:
                own[len(own) // 2] = "changed"
        texts.append(" ".join(own))
    texts += ["", "  \n ", "the " * 300, "the " * 300, "é" * 250 + "ü" * 250, "x" * 1000]
    return texts


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", 7, "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("limit", [2000, 2])
def test_suffix_array_dedup_is_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(windows, "GROUP_LIMIT", limit)  # 2: hot anchors take the way by hashes
    texts = corpus()
    got = {r.doc_id: r for r in suffix_dedup.suffix_array_dedup(frame(spark, [*texts, None]), length=40).collect()}
    want = suffix_dedup.brute_force([t.encode() for t in [*texts, ""]], 40)
    import hashlib

    for i, (removed, spans, sha) in enumerate(want):
        assert (got[i].n_removed, got[i].n_spans, hashlib.sha256(bytes(got[i].kept)).hexdigest()) == (removed, spans, sha), i


def test_op5_removes_strings_of_400_bytes_and_no_shorter_passage(spark, tmp_path):
    r = random.Random(8)
    short, long = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(67))[:n] for n in (399, 400))
    assert len(short.split()) > 50 and len(long.split()) > 50
    texts = [a + p + b for p in (short, long) for a, b in (("x" * 50, "y" * 50), ("z" * 90, ""))]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = suffix_dedup.op5_suffix_array_dedup(spark, str(tmp_path)).sort("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans) for x in got] == [(499, 0, 0), (489, 0, 0), (500, 400, 1), (490, 400, 1)]


@pytest.mark.parametrize("limit", [2000, 2])
def test_substring_dedup_is_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(windows, "GROUP_LIMIT", limit)
    texts = corpus(2)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(spark, [*texts, None]), window=12).collect()}
    import hashlib

    for i, (n, removed, sha) in enumerate(substring_dedup.brute_force([t.encode() for t in [*texts, ""]], 12)):
        assert (got[i].n_words, got[i].n_removed, hashlib.sha256(bytes(got[i].kept)).hexdigest()) == (n, removed, sha), i


def test_repeated_and_null_ids(spark):
    rows = frame(spark, ["a b c d " * 9, "a b c d " * 9, "other text", None], [1, 1, None, None])
    got = substring_dedup.substring_dedup(rows, window=4).collect()
    assert sorted((x.doc_id or 0, x.n_words, x.n_removed) for x in got) == [(0, 0, 0), (0, 2, 0), (1, 36, 32), (1, 36, 36)]  # each row is a document
    assert sorted(x.n_removed for x in suffix_dedup.suffix_array_dedup(rows, length=8).collect()) == [0, 0, 72, 72]
    assert sorted((x.class_id or 0, x.kept) for x in minhash_dedup.minhash_dedup(rows).collect()) == [(0, True), (0, True), (1, False), (1, True)]
    assert sorted(x.n_removed for x in line_dedup.line_dedup(rows).collect()) == [0, 0, 0, 1]


def test_empty_tables(spark):
    empty = frame(spark, []).limit(0)
    assert suffix_dedup.suffix_array_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert minhash_dedup.minhash_dedup(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0


def test_two_stage_suffix_array():
    r = random.Random(5)
    for _ in range(30):
        data = bytes(r.choice(b"ab\x00\xff") for _ in range(r.randint(1, 200)))
        order = suffix_dedup.suffix_array(data, 300).tolist()
        assert order == sorted(range(len(data)), key=lambda i: data[i:])


def test_suffix_automaton_matching_statistics():
    r = random.Random(6)
    shard = substring_dedup.SuffixAutomaton()
    known = []
    for _ in range(6):
        s = [r.randint(0, 2) for _ in range(25)]
        known.append(s)
        shard.add(s)
    subs = {tuple(s[i:j]) for s in known for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    q = [r.randint(0, 2) for _ in range(60)]
    want = [max((k for k in range(1, e + 2) if tuple(q[e + 1 - k : e + 1]) in subs), default=0) for e in range(len(q))]
    assert list(shard.matching(q)) == want


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("cell", [512, 3])
def test_near_duplicates_are_exact(spark, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL", cell)  # 3: large clusters meet in several cells
    r = random.Random(7)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    texts = []
    for i in range(25):
        own = list(base)
        for _ in range(i % 6):
            own[r.randrange(len(own))] = f"x{r.randint(0, 10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"u{r.randint(0, 10**6)}" for _ in range(50)) for _ in range(5)] + [texts[3], "", "", "one two"]
    got = {x.doc_id: x for x in minhash_dedup.minhash_dedup(frame(spark, texts)).collect()}
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i) if texts[i].split() == texts[j].split() or minhash_dedup.weighted_jaccard(texts[i].encode(), texts[j].encode()) >= 0.8]
    want = union(n, pairs)
    assert [got[i].class_id for i in range(n)] == want
    assert [got[i].kept for i in range(n)] == [w == i for i, w in enumerate(want)]


def test_elements_give_the_weighted_similarity():
    a, b = b"a b c d e f a b c d e f g", b"A b c d e f a b c d e x g"
    sim = neardup.similarities([minhash_dedup.elements_of(a)], [minhash_dedup.elements_of(b)])
    assert sim[0, 0] == pytest.approx(minhash_dedup.weighted_jaccard(a, b))


def test_dart_minhash_collides_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    common, left, right = (rng.integers(1, 2**63, m, dtype=np.uint64) for m in (200, 50, 50))
    element = np.concatenate([common, left, common, right])
    doc = np.repeat([0, 0, 1, 1], [200, 50, 200, 50])
    weight = np.concatenate([np.full(200, 2.5), np.full(50, 1.0), np.full(200, 2.5), np.full(50, 1.0)])
    signature = minhash_dedup.dart_minhash(doc, element, weight, 2, 2048)
    assert (signature[0] == signature[1]).mean() == pytest.approx(500 / 600, abs=0.03)


@pytest.mark.parametrize("edges_per_task", [400_000, 3])
def test_connected_components(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(components, "FOREST_EDGES", edges_per_task)
    r = random.Random(8)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    got = {x.id: x.component for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(60, [p for p in pairs if p[0] != p[1]])
    assert got == {i: want[i] for a, b in pairs if a != b for i in (a, b)}


def test_line_bands_keep_links_at_the_threshold():
    r = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz     ", dtype=np.uint8)
    n, missed = 4000, 0
    for shingles in (8, 12, 16, 20):
        left = letters[r.integers(0, letters.size, (n, shingles + 7))]
        right = np.concatenate([left, letters[r.integers(0, letters.size, (n, shingles // 4))]], axis=1)
        a, b = (line_dedup.bands_of(line_dedup.minhash(x.reshape(-1), at := np.arange(n) * x.shape[1], at + x.shape[1], line_dedup.BANDS * line_dedup.ROWS), line_dedup.BANDS, line_dedup.ROWS) for x in (left, right))
        missed += int((a != b).all(axis=1).sum())
    assert missed <= 0.001 * 4 * n


@pytest.mark.parametrize("cell", [512, 3])
def test_line_dedup_is_exact(spark, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL", cell)
    r = random.Random(9)
    line = "".join(r.choice("abcdefghij ") for _ in range(150))
    variants = [line[:k] + "#" + line[k + 1 :] for k in range(10, 140, 9)]
    texts = ["\n".join([f"own {i} {r.random()}", r.choice(variants), "", " " + r.choice(variants), "ab"]) for i in range(20)] + ["", None, "\n\n"]
    got = {x.doc_id: x for x in line_dedup.line_dedup(frame(spark, texts)).collect()}
    first, lines = {}, []
    for i, t in enumerate(texts):
        for j, x in enumerate((t or "").split("\n")):
            if x.strip() and x.strip() not in first:
                first[x.strip()] = (i, j)
                lines.append(x.strip())
    grams = [{x.encode()[k : k + 8] for k in range(max(1, len(x.encode()) - 7))} for x in lines]
    root = union(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8])
    keep = {x: first[lines[root[k]]] for k, x in enumerate(lines)}
    for i, t in enumerate(texts):
        want = "\n".join(x for j, x in enumerate((t or "").split("\n")) if not x.strip() or keep[x.strip()] == (i, j))
        assert got[i].kept == want, i
    assert collections.Counter(got[20].kept)["x"] == 0


def test_chained_groups_of_near_copies_meet_in_linear_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 16)
    made = {}
    for copies in (30, 120):  # of each of four unlike bases, with a few lines that are like none of them
        r = random.Random(12)
        sets, buckets = [], []
        for group in range(4):
            base = [r.getrandbits(62) for _ in range(60)]
            buckets.append([])
            for i in range(copies + 5):
                own = list(base)
                for place in r.sample(range(60), r.randint(0, 3) if i < copies else 12):
                    own[place] = r.getrandbits(62)
                buckets[group].append(len(sets))
                sets.append(np.unique(np.array(own, dtype=np.uint64)))
        buckets.append([b[0] for b in buckets])  # this chains all to one cluster
        met = spark.createDataFrame([(k, i, min(b)) for k, b in enumerate(buckets) for i in b], "bucket long, id long, pivot long")
        payloads = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "id long, payload binary")
        made[copies] = 0

        def fetch(asked):
            made[copies] += asked.count()  # noqa: B023
            return asked.join(payloads, "id")  # noqa: B023

        links = [(x.a, x.b) for x in neardup.linked(met, fetch, lambda x: np.frombuffer(x, dtype=np.uint64), 0.8).collect()]
        sim = neardup.similarities(sets, sets)
        assert all(sim[a, b] >= 0.8 - 1e-6 for a, b in links)
        assert union(len(sets), links) == union(len(sets), zip(*np.nonzero(np.triu(sim >= 0.8 - 1e-6, 1)), strict=True))
    assert made[120] < 5 * made[30], made


def test_crowded_buckets_over_batches():
    import pyarrow as pa

    r = random.Random(11)
    for _ in range(200):
        rows = sorted((r.randrange(8), r.randrange(10**6)) for _ in range(r.randint(1, 25)))
        cuts = sorted({0, len(rows), *(r.randrange(len(rows) + 1) for _ in range(r.randint(0, 6)))})
        batches = [pa.record_batch([pa.array([x[0] for x in rows[a:b]], pa.int64()), pa.array([x[1] for x in rows[a:b]], pa.int64())], names=["bucket", "id"]) for a, b in zip(cuts, cuts[1:], strict=False)]
        got = [tuple(row.values()) for batch in line_dedup.crowded(iter(batches)) for row in batch.to_pylist()]
        by = collections.defaultdict(list)
        for bucket, i in rows:
            by[bucket].append(i)
        assert sorted(got) == sorted((b, i, by[b][0]) for b in by for i in by[b] if len(by[b]) > 1)


@pytest.mark.parametrize("meeting", [1 << 20, 50, 7])
def test_buckets_meet_in_blocks(monkeypatch, meeting):
    import pyarrow as pa

    monkeypatch.setattr(line_dedup, "MEETING", meeting)
    r = random.Random(13)
    for parts in (1, 3, 200, 70_000):
        n = 40
        ids, buckets = [i * 7 - 50 for i in range(n)], [[r.choice([k, -k - 100, (k + 1) << 50, r.getrandbits(64) - (1 << 63)]) for _ in range(n)] for k in range(line_dedup.BANDS)]
        lines = [pa.record_batch([pa.array(x[a : a + 9], pa.int64()) for x in (ids, *buckets)], names=["id", *line_dedup._BUCKETS]) for a in range(0, n, 9)]
        dealt = [batch.slice(i, 1) for batch in line_dedup.dealt(parts)(iter(lines)) for i in range(batch.num_rows)]
        r.shuffle(dealt)
        want, places = collections.defaultdict(list), collections.defaultdict(set)
        for k in range(line_dedup.BANDS):
            for i in range(n):
                want[buckets[k][i]].append(ids[i])
        for block in dealt:
            for bucket in np.frombuffer(block.column("buckets")[0].as_py(), dtype=np.int64).tolist():
                places[bucket].add(block.column("part")[0].as_py())
        assert set(places) == set(want) and all(len(x) == 1 and 0 <= min(x) < parts for x in places.values())
        assert parts > 1 or len(dealt) <= 1 + n * line_dedup.BANDS // min(meeting, 9 * line_dedup.BANDS)
        got, pivots = collections.defaultdict(list), collections.defaultdict(set)
        for batch in line_dedup.met_in(block.select(["buckets", "ids"]) for block in dealt):
            for x in batch.to_pylist():
                got[x["bucket"]].append(x["id"])
                pivots[x["bucket"]].add(x["pivot"])
        assert {b: sorted(x) for b, x in got.items()} == {b: sorted(x) for b, x in want.items() if len(x) > 1}
        assert all(len(x) == 1 and x <= set(want[b]) for b, x in pivots.items())


def test_buckets_are_not_shuffled_row_by_row(spark, tmp_path):
    from pipelight.llm.common import keyed

    r = random.Random(14)
    texts = ["\n".join(f"line {i} {r.getrandbits(200):x}" for i in range(20)) for _ in range(100)]
    texts[50] = texts[3]
    frame(spark, texts).write.parquet(str(tmp_path / "docs"))
    seen = []
    made = line_dedup.cut
    try:
        line_dedup.cut = lambda df, name="t": (seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())), made(df, name))[1]
        found = line_dedup.repeated_lines(keyed(spark.read.parquet(str(tmp_path / "docs")), "doc_id", "text"))
    finally:
        line_dedup.cut = made
    assert found.count() == 20
    assert "Generate explode" not in dict(seen)["met"]


@pytest.mark.parametrize("hashed", [1 << 15, 40, 1])
def test_minhash_in_runs_of_lines(monkeypatch, hashed):
    monkeypatch.setattr(line_dedup, "HASHED", hashed, raising=False)
    r = random.Random(15)
    for _ in range(60):
        text = bytes(r.choice(b"ab\n  cde") for _ in range(r.randint(1, 300)))
        spans = [x for x in line_dedup._lines(text) if x[1] > x[0]]
        r.shuffle(spans)
        if spans:
            begin, end = np.array(spans).T
            got = line_dedup.minhash(np.frombuffer(text, dtype=np.uint8), begin, end, 64)
            for (a, b), signature in zip(spans, got, strict=True):
                alone = line_dedup.minhash(np.frombuffer(text[a:b], dtype=np.uint8), np.array([0]), np.array([b - a]), 64)
                assert (alone[0] == signature).all()
            assert all((x == y).all() for i, x in enumerate(got) for j, y in enumerate(got) if text[slice(*spans[i])] == text[slice(*spans[j])])


def test_few_and_many_sets_have_the_similarities_of_sets(monkeypatch):
    r = random.Random(16)
    for columns in (4096, 3):
        monkeypatch.setattr(neardup, "COLUMNS", columns)
        for _ in range(60):
            left, right = ([np.unique(np.array([r.randrange(12) for _ in range(r.choice([0, 9, 12]))], dtype=np.uint64)) for _ in range(r.randint(0, 9))] for _ in range(2))
            for other in (left, right):
                want = [[len(set(a) & set(b)) for b in other] for a in left]
                assert neardup.overlaps(left, other).tolist() == want
            ratio = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if len(set(a) | set(b)) else 1
            got = list(zip(*(x.tolist() for x in neardup.similar(left, 0.8)), strict=True))
            assert got == [(i, j) for i in range(len(left)) for j in range(i + 1, len(left)) if ratio(left[i], left[j]) >= 0.8 - 1e-7]


def test_results_beyond_the_broadcast_limit(spark, monkeypatch):
    from pipelight.llm import common, decontamination

    texts = [*corpus(4), None]
    texts[1::7] = [f"{t}\nthis line is found in several of the texts {i % 2}\n" for i, t in enumerate(texts[1::7])]
    docs = frame(spark, texts)
    items = spark.createDataFrame([(1, " ".join(texts[0].split()[:20])), (2, "nothing of it")], "item_id long, text string")
    runs = {
        "lines": lambda: line_dedup.line_dedup(docs).select("doc_id", "n_removed", "kept"),
        "documents": lambda: minhash_dedup.minhash_dedup(docs).select("doc_id", "class_id", "kept"),
        "bytes": lambda: suffix_dedup.suffix_array_dedup(docs, length=40).select("doc_id", "n_removed", "n_spans"),
        "words": lambda: substring_dedup.substring_dedup(docs, window=12).select("doc_id", "n_words", "n_removed"),
        "items": lambda: decontamination.decontaminate(docs, items).select("doc_id", "n_hit", "contaminated"),
    }
    for name, run in runs.items():
        want = sorted(map(tuple, run().collect()), key=str)
        with monkeypatch.context() as m:
            m.setattr(common, "BROADCAST_LIMIT_BYTES", 0)
            assert sorted(map(tuple, run().collect()), key=str) == want, name
