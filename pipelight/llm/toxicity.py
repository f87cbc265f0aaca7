"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat, target, negation, report, other).  Four small transducers read
a clause's symbols one after another and are composed into one machine:

* negation rewrites an insult or threat shortly after a negation as a negated one;
* reported speech rewrites those after a verb of saying in the same clause as reported;
* target rewrites insults next to an address ("you", "they", ...) as aimed, on either side;
* threat does so for threats.

A clause scores the sum of its hits' lexical weights times the weights of what the machine made of
them, and a text is judged by its clauses' scores alone: the greatest, the sum, and the sum in
proportion to the text's length.

The lexicon (whole words and beginnings of words, with their smoothed log odds) and the logistic
model over clause scores are learned from labelled rows; rows whose crc32 of the id is 1 modulo 3
are never learned from.  The sample is bounded: SAMPLE_ROWS labelled ids, those with the least hash.
Copies are no evidence: one text of each class of near duplicates in the sample is learned from.
Patterns are chosen one after another, each for the toxic texts that those before it don't explain
yet, as long as it is significant among all patterns of the sample (Bonferroni); so a few general
patterns are kept rather than every word that toxic texts happen to share, and the lexicon (at most
LEXICON_SIZE patterns) doesn't grow with the sample.  The model is fitted on scores that each fold
of the sample gets from a lexicon of the other folds.

Defined results: a null or empty text has no clauses and gets the score of a text without hits; ids
may be null or repeated, each row is scored (of an id's several texts the least one is learned
from); an id with conflicting labels is not learned from; without toxic and clean labels the seed
words below are used with a fixed model; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import cut, lean, table
from .minhash_dedup import SIGNED, sign

#: Labelled ids that are learned from, at most.
SAMPLE_ROWS = 12_000
#: Patterns of a lexicon, at most.
LEXICON_SIZE = 1_000
THRESHOLD = 0.7
#: Lengths of word beginnings that may be learned.
STEMS = range(3, 9)
FOLDS = 4
#: Weight of patterns at which a text counts as explained; also the greatest weight of a pattern.
EXPLAINED = 6.0

# Fixed word lists.
SEED_INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown")
THREATS = frozenset("kill hurt destroy burn beat shoot stab attack crush hang töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours u ur he she they him her them his their these those du dich dir ihr euch sie tu toi te vous ils elles tú ti usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not never no none nobody isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás".split())
REPORTS = frozenset("said says say told wrote called reported claimed quoted asked sagte sagt schrieb dit disait écrit dijo dice escribió".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "I", "T", "G", "N", "R", "w"
#: What a hit's lexical weight is multiplied by, by the symbol that the grammar makes of it.
OUTPUT_WEIGHTS = {"I": 1.0, "A": 1.5, "T": 0.3, "H": 1.5, "i": 0.3, "t": 0.1, "r": 0.5, "b": 0.5}
_CLAUSE = re.compile(r"[.!?;:\n|]+")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
NEAR = 3


class Transducer:
    """Deterministic: step(state, symbol) -> (state, output)."""

    start = 0

    def step(self, state, symbol):
        raise NotImplementedError


class Negation(Transducer):
    def step(self, state, symbol):
        if symbol == NEGATION:
            return NEAR, symbol
        out = symbol.lower() if state and symbol in (INSULT, THREAT) else symbol
        return max(0, state - 1), out


class Reported(Transducer):
    def step(self, state, symbol):
        if symbol == REPORT:
            return 1, symbol
        return state, "r" if state and symbol in (INSULT, THREAT) else symbol


class Aimed(Transducer):
    """Rewrites `hit` near a target as `aimed`; a target shortly after a hit gives `after`."""

    start = (0, 0)

    def __init__(self, hit: str, aimed: str, after: str) -> None:
        self.hit, self.aimed, self.after = hit, aimed, after

    def step(self, state, symbol):
        target, hit = state
        if symbol == TARGET:
            return (NEAR, 0), self.after if hit else symbol
        if symbol == self.hit:
            return (max(0, target - 1), 0 if target else NEAR), self.aimed if target else symbol
        return (max(0, target - 1), max(0, hit - 1)), symbol


class Composed(Transducer):
    """Reads with each machine what the one before it wrote; arcs are kept once they were built."""

    def __init__(self, *machines: Transducer) -> None:
        self.machines = machines
        self.start = tuple(m.start for m in machines)
        self.arcs: dict = {}

    def step(self, state, symbol):
        arc = self.arcs.get((state, symbol))
        if arc is None:
            states, out = [], symbol
            for m, s in zip(self.machines, state, strict=True):
                s, out = m.step(s, out)
                states.append(s)
            arc = self.arcs[state, symbol] = (tuple(states), out)
        return arc


def grammar() -> Composed:
    return Composed(Negation(), Reported(), Aimed(INSULT, "A", "b"), Aimed(THREAT, "H", "b"))


class Scorer:
    """Features of texts under a lexicon {pattern: weight}; a pattern that ends in * is a beginning."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        import ahocorasick

        self.words = {p: w for p, w in lexicon.items() if not p.endswith("*")}
        self.stems = {p[:-1]: w for p, w in lexicon.items() if p.endswith("*")}
        self.longest = max(map(len, self.stems), default=0)
        self.machine = grammar()
        self.finder = ahocorasick.Automaton()
        for p in {*self.words, *self.stems, *THREATS}:
            self.finder.add_word(p, len(p))
        self.finder.make_automaton()

    def weight(self, word: str) -> float:
        """Of the whole word, else of its longest known beginning, else 0."""
        found = self.words.get(word)
        if found is None:
            for k in range(min(len(word), self.longest), 0, -1):
                found = self.stems.get(word[:k])
                if found is not None:
                    break
        return found or 0.0

    def clause(self, tokens: list[str]) -> float:
        """Score of a clause."""
        state, total, last = self.machine.start, 0.0, 1.0
        for token in tokens:
            w = self.weight(token)
            symbol = INSULT if w > 0 else THREAT if token in THREATS else TARGET if token in TARGETS else NEGATION if token in NEGATIONS else REPORT if token in REPORTS else OTHER
            state, out = self.machine.step(state, symbol)
            if symbol == INSULT:
                last = w
            if out in OUTPUT_WEIGHTS:
                total += OUTPUT_WEIGHTS[out] * (w if symbol == INSULT else last if out == "b" else 1.0)
        return total

    def features(self, text: str) -> tuple[float, float, float]:
        """Greatest clause score, sum of the scores (log), sum of the scores by length (log)."""
        low = text.lower()
        n = len(low)
        starts = []
        for end, size in self.finder.iter(low):
            at = end - size + 1
            if at == 0 or not low[at - 1].isalnum():
                starts.append(at)
        if not starts:
            return (0.0, 0.0, 0.0)
        starts.sort()
        best = total = 0.0
        done = begin = 0
        for m in [*_CLAUSE.finditer(low), None]:
            end = m.start() if m else n
            if starts[done] < end:
                while done < len(starts) and starts[done] < end:
                    done += 1
                score = self.clause(_TOKEN.findall(low, begin, end))
                best, total = max(best, score), total + score
                if done == len(starts):
                    break
            begin = m.end() if m else n
        return (best, float(np.log1p(total)), float(np.log1p(100.0 * total / (n / 6 + 1))))


N_FEATURES = 3


def evidence(a, n1, b, n0):
    """Log likelihood ratio, in nats, of a pattern in a of n1 toxic and b of n0 clean texts against one rate for both."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    term = lambda k, n, p: np.where(k > 0, k * np.log(np.maximum(k, 1e-300) / np.maximum(n * p, 1e-300)), 0.0)
    p = (a + b) / (n1 + n0)
    return np.where(a * n0 > b * n1, term(a, n1, p) + term(n1 - a, n1, 1 - p) + term(b, n0, p) + term(n0 - b, n0, 1 - p), 0.0)


def fit_lexicon(patterns: list[str], texts: list[np.ndarray], toxic: np.ndarray, least: float) -> dict[str, float]:
    """Weights of the patterns that explain toxic texts; texts: the places in patterns of those that each text has.

    Step by step, the pattern with the most evidence (times its weight, which prefers precise ones)
    among toxic texts that aren't explained yet, and all clean ones, is taken, until none has `least` nats.
    """
    lists, n1 = [x for x, t in zip(texts, toxic, strict=True) if t], int(toxic.sum())
    n0 = len(texts) - n1
    size = len(patterns)
    count = lambda rows: np.bincount(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), minlength=size)
    clean, all_toxic = count(x for x, t in zip(texts, toxic, strict=True) if not t), count(lists)
    weight = np.minimum(EXPLAINED, np.log((all_toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1)))
    found: dict[str, float] = {}
    have, open_, left, usable = np.zeros(n1), np.ones(n1, dtype=bool), all_toxic.copy(), weight >= 1
    while usable.any() and open_.any() and len(found) < LEXICON_SIZE:
        gain = np.where(usable & (left >= 3), evidence(left, int(open_.sum()), clean, n0), 0.0)
        best = int(np.argmax(np.where(gain >= least, gain * weight, 0.0)))
        if gain[best] < least:
            break
        found[patterns[best]] = float(weight[best])
        usable[best] = False
        for i in np.flatnonzero(open_):
            if best in lists[i]:
                have[i] += weight[best]
                if have[i] >= EXPLAINED - 1e-9:
                    open_[i] = False
                    left[lists[i]] -= 1
    return found


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights (the last is the intercept) on standardised features, by damped Newton steps; raw scale."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-3])

    def loss(w):
        m = z @ w
        return float(np.logaddexp(0, m).sum() - y @ m + 0.5 * w @ penalty @ w)

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:  # the loss is convex: a short enough step lowers it
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean)


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1


def _patterns(text: str) -> set[str]:
    words = set(_TOKEN.findall(text.lower()))
    return {w for w in words if 3 <= len(w) <= 24} | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _representatives(signed: list[tuple[int, list[int]]]) -> list[int]:
    """The least row of each class of near duplicates; signed: row, bands."""
    parent = {row: row for row, _ in signed}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[int, int] = {}
    for row, bands in signed:
        for band in bands:
            a, b = find(first.setdefault(band, row)), find(row)
            parent[max(a, b)] = min(a, b)
    return [row for row in parent if find(row) == row]


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, weights) from a bounded sample of the rows that may be learned from."""
    toxic = F.col(label_col).cast("int")
    known = labels.select(F.col(id_col).alias("id"), toxic.alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    sample = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)  # bounded by SAMPLE_ROWS
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = cut(rows.repartition(16, F.xxhash64("id")).withColumn("row", F.monotonically_increasing_id()).select("row", "toxic", "text"), "sample")
    signed = rows.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(sign, SIGNED).where("n > 0").select("key", "bands").orderBy("key").collect()  # at most SAMPLE_ROWS rows
    chosen = rows.sparkSession.createDataFrame([(r,) for r in _representatives([tuple(x) for x in signed])], "row long")
    rows = cut(rows.join(F.broadcast(chosen), "row").withColumn("fold", F.pmod(F.xxhash64("row"), F.lit(FOLDS)).cast("int")).select("fold", "toxic", "text"), "sample")
    tally = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    seeds = {w: EXPLAINED for w in SEED_INSULTS}
    if not all(tally.get((f, t)) for f in range(FOLDS) for t in (0, 1)):
        return seeds, np.array([0.8, 0.5, 0.2, -5.0])
    n0, n1 = (sum(n for (_, t), n in tally.items() if t == x) for x in (0, 1))

    def count(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(_patterns(text))
        for toxic, own in enumerate(seen):
            yield pa.record_batch([pa.array([*own], pa.string()), pa.array([toxic * n for n in own.values()], pa.int64()), pa.array([(1 - toxic) * n for n in own.values()], pa.int64())], names=["pattern", "a", "b"])

    counts = cut(rows.select("toxic", "text").mapInArrow(count, "pattern string, a long, b long").groupBy("pattern").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "patterns")
    least = float(np.log(counts.count()) + 2)
    # a pattern that isn't significant among all toxic texts may be so among fewer; none is without three of them
    able = counts.where((F.col("a") >= 3) & (F.col("a") * F.lit(n0) > F.col("b") * F.lit(2.5 * n1))).orderBy(F.desc(F.col("a") * F.log(F.col("a") * F.lit(n0 + 1) / ((F.col("b") + 0.5) * F.lit(n1)))), "pattern")
    patterns = [r["pattern"] for r in able.limit(30 * LEXICON_SIZE).collect()]
    place = {p: i for i, p in enumerate(patterns)}

    def find(batches):
        for batch in batches:
            own = [sorted(place[p] for p in _patterns(text) if p in place) for text in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32()))], names=["fold", "toxic", "has"])

    found = rows.mapInArrow(find, "fold int, toxic int, has array<int>").toArrow()  # at most SAMPLE_ROWS rows
    fold, toxic = found.column("fold").to_numpy(), found.column("toxic").to_numpy()
    has = [np.array(x, dtype=np.int64) for x in found.column("has").to_pylist()]

    def lexicon(keep: np.ndarray) -> dict[str, float]:
        return seeds | fit_lexicon(patterns, [x for x, k in zip(has, keep, strict=True) if k], toxic[keep], least)

    whole, others = lexicon(fold >= 0), [lexicon(fold != f) for f in range(FOLDS)]

    def features(batches):
        scorers = [Scorer(x) for x in others]
        for batch in batches:
            out = [scorers[f].features(text) for f, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(1), pa.array([list(x) for x in out], pa.list_(pa.float64()))], names=["toxic", "x"])

    scored = rows.mapInArrow(features, "toxic int, x array<double>").collect()  # at most SAMPLE_ROWS rows
    return whole, fit_logistic(np.array([r["x"] for r in scored]), np.array([r["toxic"] for r in scored], dtype=float))


@lru_cache(maxsize=2)
def _scorer(lexicon: tuple) -> Scorer:
    return Scorer(dict(lexicon))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(row, score, predicted) for each row of docs: row is a struct of all of its columns."""
    lexicon, weights = train(docs, labels, id_col, text_col, label_col)
    items = tuple(sorted(lexicon.items()))

    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    place = docs.columns.index(text_col)

    def run(batches):
        scorer = _scorer(items)
        for batch in batches:
            texts = batch.column(0).field(place).cast(pa.binary()).to_pylist()
            x = np.array([scorer.features((t or b"").decode("utf-8", "replace")) for t in texts], dtype=float).reshape(-1, N_FEATURES)
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    schema = StructType([*own.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return own.mapInArrow(lean(run), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")
