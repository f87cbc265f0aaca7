"""PII, toxicity, packing, search, decontamination and chat formatting."""

import collections
import random
import re

import numpy as np
import pytest

from pipelight.llm import chat_format, decontamination, packing, pii, topk_search, toxicity

DOCS = "doc_id long, text string, row string, score double"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "r", 0.0) for i, t in enumerate(texts)], DOCS)


# -- PII -------------------------------------------------------------------------------------------


def spans_by_pattern(text):
    """The contract's patterns as they are written."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KIND_ORDER[s[0]]))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("0123456789..@@ab+- ()é") for _ in range(50))
        assert pii.base_spans(text) == spans_by_pattern(text), text


def test_long_texts_take_linear_time():
    for text in ("9" * 300_000, "a" * 300_000, "a@" * 100_000, "1.2." * 80_000, "+1 " * 100_000, "x-" * 150_000):
        pii.find_spans([text])


def test_model_adds_secrets_and_leaves_look_alikes():
    held = list(pii.Synthetic(99).rows(600))
    base, added = pii.find_spans([t for t, *_ in held])
    hit = [any(s < end and start < e for _, s, e in b) or any(s < end and start < e for _, s, e, _ in a) for (t, k, start, end, good), b, a in zip(held, base, added, strict=True)]
    good = np.array([g for *_, g in held])
    hit = np.array(hit)
    assert hit[good].mean() > 0.75
    only_model = np.array([bool(a) for a in added])
    assert only_model[~good].mean() < 0.08


def test_secrets_of_any_length_are_found():
    r = random.Random(7)
    chars = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(n))
    for n in (64, 128, 129, 200, 1000, 5000):
        key, head, payload, signature = chars(n), "eyJ" + chars(33), "eyJ" + chars(n), chars(342)
        text = f'token = "{key}" and Bearer {head}.{payload}.{signature} end'
        found = {(s, e) for _, s, e, _ in pii.find_spans([text])[1][0]}
        assert {(text.index(x), text.index(x) + len(x)) for x in (key, payload, signature)} <= found, n
        assert not pii.find_spans([f"img data:image/png;base64,{chars(n)} end"])[1][0]


def test_pii_rows(spark):
    found = {r.doc_id: r for r in pii.pii_spans(docs(spark, ["mail a.b@c.de now", None, "", 'token = "0123456789abcdef0123456789abcdef01234567" x'])).collect()}
    assert found[0].redacted == "mail [email] now"
    assert found[1].redacted == "" and not found[1].spans and not found[2].spans
    assert [(s.kind, s.base) for s in found[3].spans] == [("secret", False)]
    assert pii.pii_spans(docs(spark, []).limit(0)).count() == 0


# -- toxicity --------------------------------------------------------------------------------------


def test_grammar_composes():
    s = toxicity.Scorer({"idiot": 1.0, "achlich*": 2.0})
    score = lambda text: s.clause(text.split())
    assert score("you idiot") > score("an idiot") > score("not an idiot")
    assert score("idiot that you are") > score("an idiot") > score("she said an idiot")
    assert score("achlichen") == 2.0
    assert score("we will kill you") > score("to kill time")


def test_features_of_odd_texts():
    s = toxicity.Scorer({"idiot": 1.0})
    for text in ("", " ", "idiot", "é" * 1000, "idiot " * 5000, "...!!!", "midiot idiots"):
        assert len(s.features(text)) == toxicity.N_FEATURES
    assert s.features("midiot")[0] == 0


def toxic_corpus(seed: int, n: int = 900) -> tuple[list[str], list[int]]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    texts, marks = [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                own[r.randrange(len(own))] = r.choice(["vile", "grubby", "zork" + r.choice(words)])
        texts.append(" ".join(own))
        marks.append(toxic)
    return texts, marks


def judged(spark, texts: list[str], marks: list[int]):
    """Recall and precision on the held-out rows, the lexicon and the model."""
    F = __import__("pyspark").sql.functions
    frame = docs(spark, texts)
    labels = spark.createDataFrame([*enumerate(marks)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame, labels).select("row.doc_id", "predicted", toxicity.held_out(F.col("row.doc_id")).alias("held")).collect()
    assert len(got) == len(texts)
    held = [(x.predicted, marks[x.doc_id]) for x in got if x.held]
    right = sum(p and m for p, m in held)
    return right / sum(m for _, m in held), right / max(1, sum(p for p, _ in held)), *toxicity.train(frame, labels, "doc_id", "text", "toxic")


def test_copies_of_every_row_change_nothing(spark):
    texts, marks = toxic_corpus(5)
    once, copied = judged(spark, texts, marks), judged(spark, texts * 5, marks * 5)
    for recall, precision, lexicon, _ in (once, copied):
        assert recall >= 0.95 and precision >= 0.95 and len(lexicon) < 30
    for stem in ("vile", "grubby", "zorkab"):
        assert toxicity.Scorer(copied[2]).weight(stem) > 2


def test_copies_with_exchanged_letters_are_learned(spark):
    texts, marks = toxic_corpus(6)
    r = random.Random(1)
    every = list(texts)
    for _ in range(4):
        letters = r.sample("abcdefgvilerubyzok", 6)
        change = str.maketrans("".join(letters), "".join(letters[1:] + letters[:1]))
        every += [t.translate(change) for t in texts]
    recall, precision, lexicon, _ = judged(spark, every, marks * 5)
    assert recall >= 0.85 and precision >= 0.9 and len(lexicon) < 120


def test_no_spurious_patterns(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(80)) for _ in range(900)]
    marks = [int(r.random() < 0.15) for _ in texts]  # labels that nothing explains
    _, _, lexicon, _ = judged(spark, texts, marks)
    assert lexicon.keys() - set(toxicity.SEED_INSULTS) == set()


def test_toxicity_keeps_rows_and_columns(spark):
    frame = spark.createDataFrame([(1, "you idiot", 0.5, 7), (1, "you idiot", 0.5, 7), (None, None, None, None), (2, "", 1.0, 1), (3, "calm " * 200_000, 1.0, 1)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(2, 0), (2, 1), (None, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame, labels).collect()
    assert sorted(((x.row.doc_id, x.row.score, x.row.predicted) for x in got), key=str) == sorted([(1, 0.5, 7), (1, 0.5, 7), (None, None, None), (2, 1.0, 1), (3, 1.0, 1)], key=str)
    assert all(0 <= x.score <= 1 for x in got)
    assert toxicity.score_toxicity(frame.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(frame, labels.limit(0)).count() == 5


def test_learns_on_two_thirds_and_holds_on_the_rest(spark):
    texts, marks = toxic_corpus(3)
    labels = [*enumerate(marks)]
    got = toxicity.score_toxicity(docs(spark, [*texts, None]), spark.createDataFrame(labels, "doc_id long, toxic int")).select("row.doc_id", "score", "predicted", toxicity.held_out(__import__("pyspark").sql.functions.col("row.doc_id")).alias("held")).collect()
    assert len(got) == 901
    held = [x for x in got if x.held and x.doc_id < 900]
    right = sum(x.predicted == (x.doc_id % 6 == 0) for x in held)
    assert right / len(held) > 0.95
    assert all(0 <= x.score <= 1 for x in got)


def test_no_labels(spark):
    got = toxicity.score_toxicity(docs(spark, ["you idiot, you worthless clown", "a calm text"]), spark.createDataFrame([], "doc_id long, toxic int")).select("row.doc_id", "score").collect()
    by = {x.doc_id: x.score for x in got}
    assert by[0] > by[1]


# -- packing ---------------------------------------------------------------------------------------


def test_encoder_agrees_with_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    r = random.Random(4)
    texts = ["", "<|endoftext|> a", "  \n\n a'S 's don't", "\x00\x1c\x85 x"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x3000), r.randrange(0x1F300, 0x1F700), 10, 32, 0x3000, 0x200D])) for _ in range(120)) for _ in range(150)]
    for t in texts:
        assert packing.encoder(path)(t) == library.encode(t, add_special_tokens=False).ids


def test_document_ids_are_those_of_the_library_at_its_defaults(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    r = random.Random(8)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>  b", "<|endoftext|", "", "é\n\n<|endoftext|>\n's"]
    texts += ["".join(r.choice(["<|endoftext|>", "<|", "|>", " ", "\n", "a", "'s", "é", "中", "12", "!"]) for _ in range(30)) for _ in range(200)]
    want = {i: [*library.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}
    assert len(want[0]) == 5
    got = packing.best_fit_packing(docs(spark, texts), keep_ids=True).collect()
    assert {x.doc_id: x.ids for x in got} == want


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once_and_packs_well(seed):
    r = random.Random(seed)
    histogram = dict(collections.Counter(min(100, max(1, int(r.expovariate(1 / (10 + 20 * seed))))) for _ in range(3000)))
    runs, n = packing.plan(histogram, 100)
    filled = collections.defaultdict(list)
    seen = collections.Counter()
    for length, rank, count, sequence, offset in runs.tolist():
        for i in range(count):
            seen[length, rank + i] += 1
            filled[sequence + i].append((offset, length))
    assert seen == {(k, i): 1 for k, c in histogram.items() for i in range(c)}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(filled) == n
    bound = -(-sum(k * c for k, c in histogram.items()) // 100)
    assert n <= max(bound * 1.02, bound + 3)


def test_packing_rows_and_round_trip(spark):
    texts = ["word " * 3000, None, "", "a", "a", "hello there"] + [f"text {i} " * (i % 40) for i in range(60)]
    packed = packing.best_fit_packing(docs(spark, texts, [None, *range(1, len(texts))]), keep_ids=True)
    rows = packed.collect()
    by = collections.defaultdict(list)
    for x in rows:
        by[x.doc_id].append(x)
    encode = packing.encoder(packing.default_tokenizer())
    for i, t in enumerate(texts):
        own = sorted(by[None if i == 0 else i], key=lambda x: x.piece)
        assert [k for x in own for k in x.ids] == [*encode(t or ""), packing.END_ID]
        assert all(x.length == 1024 for x in own[1:])
    whole = {x.sequence_id: x.ids for x in packing.sequences(packed).collect()}
    for x in rows:
        assert whole[x.sequence_id][x.offset : x.offset + x.length] == x.ids
    assert packing.best_fit_packing(docs(spark, []).limit(0)).count() == 0


# -- top-k -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1 << 30, 1])
def test_top_k_is_exact_with_ties_and_bad_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(topk_search, "BROADCAST_LIMIT_BYTES", limit)
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 5)
    r = random.Random(5)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(6)]) for i in range(70)] + [(70, [0.0] * 6), (71, None), (72, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (73, [float("nan")] * 6), (74, [1.0]), (None, [1.0] * 6), (75, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = sorted(tuple(x) for x in topk_search.top_k(df, df.where("vec_id % 7 = 0"), 5).collect())
    good = {i: v for i, v in rows[:71]}
    want = []
    for q in [i for i in good if i % 7 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    assert topk_search.top_k(df.limit(0), df.limit(0), 5).count() == 0


# -- decontamination -------------------------------------------------------------------------------


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))


def test_decontamination_is_exact(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abé1") for _ in range(r.randint(1, 4))) for _ in range(40)]
    items = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (30, 13, 14, 5, 1, 20)] + ["", None, "..."]
    texts = []
    for _ in range(40):
        own = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if r.random() < 0.6:
            source = words(r.choice(items[:6]))
            own[5:5] = source[: r.randint(1, len(source))]
        texts.append("-".join(own).upper())
    texts += [None, "", "zz"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, key string")
    got = {x.doc_id: x for x in decontamination.decontaminate(docs(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        hit, named = set(), set()
        for j, item in enumerate(items):
            p = words(item)
            for k in range(max(1, len(p) - 12) if p else 0):
                phrase = p[k : k + 13]
                for s in range(len(w) - len(phrase) + 1):
                    if w[s : s + len(phrase)] == phrase:
                        hit.update(range(s, s + len(phrase)))
                        named.add(str(j))
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (len(w), len(hit), sorted(named)), i
        assert got[i].contaminated == (bool(hit) and 20 * len(hit) >= len(w))


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.decontaminate(docs(spark, []).limit(0), bench).count() == 0
    clean = decontamination.decontaminate(docs(spark, ["a b"]), bench.limit(0)).collect()
    assert [(x.n_hit, x.contaminated) for x in clean] == [(0, False)]


def test_proximity(spark):
    got = decontamination.proximity_matches(docs(spark, ["the a quick brown x fox the quick fox", None, "quick"]), ["quick", "fox"], 2).collect()
    assert sorted((x.start, x.end) for x in got) == [(2, 5), (5, 7), (7, 8)]


# -- chat ------------------------------------------------------------------------------------------


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "x"), (1, 3, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "a"), (2, 2, "user", "x"), (2, 3, "assistant", "no"), (3, 0, "user", "hi"), (4, 0, None, None), (None, 1, "a", "b"), (2, 3, "assistant", "no")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.chosen_id: x for x in chat_format.format_preferences(turns).collect()}
    assert set(got) == {1, 3, 4}
    pair = got[1]
    assert (pair.rejected_id, pair.n_prompt_turns) == (2, 3)
    assert pair.prompt.endswith("<|user|>\nx<|end|>\n") and pair.prompt.count("<|user|>") == 2
    assert [pair.chosen[s.start : s.end] for s in pair.chosen_mask] == ["yes<|end|>"]
    assert [pair.rejected[s.start : s.end] for s in pair.rejected_mask] == ["no<|end|>"]
    assert got[3].rejected is None and got[4].prompt == "<|user|>\n<|end|>\n"
    assert chat_format.format_preferences(turns.limit(0)).count() == 0


def test_every_conversation_stands_once_in_a_hot_opening(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BUCKET_ROWS", 4)
    rows = [(i, 0, "user", "hi") for i in range(33)] + [(i, 1, "assistant", str(i)) for i in range(33)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_preferences(turns).collect()
    ids = [x.chosen_id for x in got] + [x.rejected_id for x in got if x.rejected_id is not None]
    assert sorted(ids) == list(range(33)) and len(got) == 17
    given = chat_format.format_preferences(turns, spark.createDataFrame([(3, 9)], "chosen_id long, rejected_id long")).collect()
    assert [(x.prompt, x.chosen[-9:]) for x in given] == [("<|user|>\nhi<|end|>\n", "3<|end|>\n")]


def test_conversations_are_paired_alike_at_every_size(spark):
    rows = spark.range(20_040).selectExpr("id", "array(named_struct('role', 'user', 'text', if(id < 40, 'hi', string(id)))) AS turns")
    pairs = lambda df: sorted(tuple(x) for x in chat_format.pairs_by_opening(df).collect() if x.chosen_id < 40)
    alone = pairs(rows.where("id < 40"))
    assert len(alone) == 20 and alone == pairs(rows)
