"""Benchmark decontamination with a positional inverted index; DataFrame operations only.

Words are the runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased.  The index holds
postings (term, document, position).  A window of a benchmark item is looked up from its rarest
term: the two rarest terms (by the number of training documents that have them) are read from the
index, their lists are adjusted by the terms' offsets and intersected, and the places that remain
are compared word by word.  Only terms that some window looks up are ever read, so only those are
posted; which ones they are follows from document frequencies that are counted over the whole
corpus.  Benchmark windows are broadcast only if their measured size is small.

Defined results: a null text has no words; items and documents without words match nothing; rows
that repeat an id and a text are documents of their own; items that repeat an id count once; an empty corpus
gives an empty result and an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keyed, small, table

WINDOW = 13
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The other ASCII characters that aren't digits or lower-case letters stand between words.
_SEPARATORS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def words_of(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + _SEPARATORS, _LOWER + " " * len(_SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def phrase_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words, n): each window of consecutive words; a shorter item is one window."""
    words = items.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - window, F.lit(0))
    return (
        words.select("item", "all", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item", F.slice("all", F.col("at") + 1, window).alias("words"))
        .distinct()
        .select("item", "words", F.size("words").alias("n"))
    )


def phrase_matches(docs: DataFrame, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, item, start, n): every occurrence of an item's window in docs (key, text)."""
    spark, texts = docs.sparkSession, docs
    docs = texts.select("key", words_of(F.col("text")).alias("words"))
    windows = cut(phrase_windows(items, item_col, item_text_col, window), "windows")
    phrases = windows.select("words", "n").distinct()
    terms = phrases.select(F.explode("words").alias("term")).distinct()
    n_terms, n_windows = terms.count(), windows.count()
    if not n_windows:
        return spark.createDataFrame([], "key long, item string, start int, n int")
    # document frequencies of the benchmark's terms
    seen = docs.select(F.explode(F.array_distinct("words")).alias("term")).join(small(terms, n_terms, 64), "term", "left_semi")
    frequency = cut(terms.join(seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")), "frequency")
    # the rarest two terms of each phrase, at different places where it has two words
    ranked = (
        phrases.select("words", "n", F.posexplode("words").alias("offset", "term"))
        .join(small(frequency, n_terms, 72), "term")
        .groupBy("words", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))).alias("terms"))
        .where(F.col("terms")[0]["df"] > 0)
    )
    probes = ranked.select("words", "n", F.col("terms")[0].alias("a"), F.when(F.col("n") > 1, F.col("terms")[1]).alias("b"))
    probes = cut(probes.select(F.xxhash64("words").alias("phrase"), "words", "n", *(F.col(x)[y].alias(f"{x}_{y}") for x in "ab" for y in ("term", "offset"))), "probes")
    n_probes = probes.count()
    posted = probes.select(F.explode(F.array("a_term", "b_term")).alias("term")).where("term is not null").distinct()
    postings = cut(docs.select("key", F.posexplode("words").alias("position", "term")).join(small(posted, 2 * n_probes, 64), "term", "left_semi"), "postings")
    at = lambda x: postings.join(
        small(probes.where(f"{x}_term is not null").select("phrase", F.col(f"{x}_term").alias("term"), F.col(f"{x}_offset").alias("offset")), n_probes, 96), "term"
    ).select("phrase", "key", (F.col("position") - F.col("offset")).alias("start"))
    # adjusted lists meet where both terms stand as the phrase has them
    both = at("a").withColumn("lists", F.lit(1)).unionByName(at("b").withColumn("lists", F.lit(2))).where("start >= 0")
    both = both.groupBy("phrase", "key", "start").agg(F.bit_or("lists").alias("lists"))
    lengths = small(probes.select("phrase", "n").distinct(), n_probes, 24)
    candidates = cut(both.join(lengths, "phrase").where((F.col("lists") == 3) | ((F.col("lists") == 1) & (F.col("n") == 1))).select("key", "start", "n", "phrase"), "candidates")
    n_candidates = candidates.count()
    # the rest of the words are compared in the document; what goes there is a place and a number
    looked_up = candidates.groupBy("key").agg(F.collect_list(F.struct("start", "n", "phrase")).alias("found"))
    stretches = (
        texts.join(small(looked_up, n_candidates, 32), "key")
        .select("key", "found", words_of(F.col("text")).alias("words"))  # texts move, and only those that are looked at are split
        # the words are bound to a variable, for within a lambda they would be taken from the text again for every place
        .select("key", F.explode(F.flatten(F.transform(F.array("words"), lambda w: F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["phrase"].alias("phrase"), F.slice(w, x["start"] + 1, x["n"]).alias("words")))))).alias("hit"))
        .select("key", "hit.*")
    )
    exact = stretches.join(small(probes.select("phrase", "words", "n"), n_probes, 40 * window), ["phrase", "words"])
    return exact.join(small(windows, n_windows, 40 * window), ["words", "n"]).select("key", F.col("item").cast("string").alias("item"), "start", "n")


def proximity_matches(docs: DataFrame, terms: list[str], slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end): the smallest stretches of at most len(terms) + slop words that hold all terms.

    Postings of the terms are read in order of position; each posting looks back for the latest
    posting of every other term.
    """
    wanted = sorted({t.lower() for t in terms})
    own = keyed(docs, id_col, text_col)
    postings = own.select("key", "id", F.posexplode(words_of(F.col("text"))).alias("position", "term")).where(F.col("term").isin(wanted))
    lists = postings.groupBy("key", "id", "term").agg(F.array_sort(F.collect_list("position")).alias("places"))
    together = lists.groupBy("key", "id").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(wanted))
    ends = together.select("key", "id", "lists", F.explode(F.array_distinct(F.flatten("lists"))).alias("end"))
    begins = F.array_min(F.transform("lists", lambda places: F.array_max(F.filter(places, lambda p: p <= F.col("end")))))
    complete = F.forall("lists", lambda places: F.array_min(places) <= F.col("end"))
    found = ends.where(complete).select("id", begins.alias("start"), "end").where(F.col("end") - F.col("start") + 1 <= len(wanted) + slop)
    return found.groupBy("id", "start").agg(F.min("end").alias("end")).select(F.col("id").alias(id_col), "start", "end")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: Sequence[str] = ()) -> DataFrame:
    """(id, text, n_words, n_hit, item_ids, contaminated[, rest]) for each document."""
    own = keyed(docs, id_col, text_col, keep)
    matches = cut(phrase_matches(own.select("key", "text"), items, item_col, item_text_col, window), "matches")
    hits = matches.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("place")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = matches.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    found = cut(hits.join(named, "key"), "hits")
    n, n_items = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("item_ids")), F.lit(0))).first()
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    kept = ["rest"] if keep else []
    return (
        own.select("key", "id", "text", *kept, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
        .join(small(found, 1, 48 * n + 24 * n_items), "key", "left")
        .select(F.col("id").alias(id_col), "text", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *kept)
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, w[i:i + 12] AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(words) AS n FROM p),
g AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM g JOIN p USING (words)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
