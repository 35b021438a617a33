"""Benchmark decontamination by a positional inverted index of the test terms, asked from the rarest terms on.

Built-in expressions only. A posting is (term, document, position). The postings of every term that a test window has are stored in one pass over the
corpus. A window's rarest list, counted over the whole corpus, shifted by the term's offset, gives its candidate places; the second
rarest list is intersected with them, then, in the documents that are left, the lists of all its other terms: what stays is an exact phrase.
Proximity matches are looked for around the two rarest terms that the corpus has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize, small

WINDOW = 10
#: A proximity match has this share, in tenths, of a window's distinct words within nine words of one of its rarest, but not the phrase.
NEAR_TENTHS = 8
#: Of a window's words, the rarest ones around which proximity matches are looked for.
NEAR_ANCHORS = 2
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), lambda w: w != "")


def test_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id string, phrase, n: every item's windows, repeated ones once. An item of fewer words is one window; without words, none."""
    rows = items.select(F.col(f"`{item}`").cast("string").alias("item_id"), words(F.col(f"`{text}`")).alias("words"))
    n = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words") - n + 1))
    return rows.withColumn("starts", starts).select("item_id", "words", n.alias("n"), F.explode("starts").alias("at")).select("item_id", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("phrase"), "n").distinct()


def same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key, text_hash, n_words, at, term: a row for each place in docs (key, text_hash, text) that has one of the terms, and for each document one
    row at its first word, if that is none of the terms with a null term. A document without words has null there as well.

    Written in the order of the documents, with no shuffle where the terms are few; else words are joined by shuffle.
    """
    found = docs.select("key", "text_hash", words(F.col("text")).alias("words")).select("key", "text_hash", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("at", "word"))
    met = found.join(small(terms), F.col("word") == F.col("term"), "left").where(F.col("term").isNotNull() | F.col("at").isNull() | (F.col("at") == 0))
    return materialize(met.select("key", "text_hash", "n_words", "at", "term"), "index")


def ranked(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrase, n, lists: the window's terms that the corpus has, (df, term, offset) from the rarest on."""
    placed = phrases.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "term")).join(small(counts), "term")
    return placed.groupBy("phrase", "n").agg(F.sort_array(F.collect_list(F.struct("df", "term", "offset"))).alias("lists"))


def occurrences(index: DataFrame, windows: DataFrame) -> DataFrame:
    """key, text_hash, phrase, start, n of every exact occurrence. windows: of ranked(), a table; those with a term that has no list can't occur.

    Places are shuffled and sorted with a window's number; its phrase and lists are looked up where they are needed.
    """
    whole = materialize(windows.where(F.size("lists") == F.col("n")).withColumn("w", F.monotonically_increasing_id()), "whole")
    nth = lambda k: F.get("lists", F.lit(k))
    part = lambda k: whole.where(F.size("lists") > k).select("w", nth(k)["term"].alias("term"), nth(k)["offset"].alias("offset"), "n")
    postings = index.where(F.col("term").isNotNull())
    first = materialize(part(0), "first")
    start = F.col("at") - F.col("offset")
    places = postings.join(small(first), "term").select("key", "text_hash", "w", "n", start.alias("start"), "n_words").where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    places = materialize(places.select("key", "text_hash", "w", "start").distinct(), "places")
    # the second rarest lists, those of the terms that some window has second
    second = materialize(part(1).drop("n"), "second")
    lists = postings.join(small(second.select("term").distinct()), "term").select("key", "text_hash", "at", "term").distinct()
    asked = places.join(small(second), "w").select("key", "text_hash", "w", "start", "term", (F.col("start") + F.col("offset")).alias("at"))
    same = same_doc("a", "l") & (F.col("a.at") == F.col("l.at")) & (F.col("a.term") == F.col("l.term"))
    left = materialize(asked.alias("a").join(lists.alias("l"), same, "left_semi").select("key", "text_hash", "w", "start"), "left")
    # the lists of all other terms, in the documents that are left
    rest = materialize(whole.where(F.size("lists") > 2).select("w", F.size("lists").alias("n"), F.inline(F.slice("lists", 3, WINDOW))).select("w", (F.col("n") - 2).alias("m"), "term", "offset"), "rest")
    asked = left.join(small(rest), "w").select("key", "text_hash", "w", "start", "m", (F.col("start") + F.col("offset")).alias("at"), "term")
    reached = materialize(asked.select("key", "text_hash").distinct(), "reached")
    lists = postings.alias("p").join(small(reached).alias("r"), same_doc("p", "r"), "left_semi").select("key", "text_hash", "at", "term").distinct()
    met = asked.alias("a").join(lists.alias("l"), same, "left_semi").groupBy("key", "text_hash", "w", "start", "m").agg(F.count("*").alias("agreed")).where("agreed = m")
    of_size = lambda rows, k: rows.join(small(whole.where(F.size("lists") == k).select("w")), "w", "left_semi").select("key", "text_hash", "w", "start")
    found = of_size(places, 1).unionByName(of_size(left, 2)).unionByName(met.select("key", "text_hash", "w", "start"))
    return found.join(small(whole.select("w", "phrase", "n")), "w").select("key", "text_hash", "phrase", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))


def proximity(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """key, text_hash, phrase of windows with most of their distinct words near one of their NEAR_ANCHORS rarest, but not the phrase. windows: of
    ranked(), a table.

    The rarest terms that the corpus has are looked for, so windows with words that it lacks count as well, and so do passages with one
    word replaced. Their places are read with the words on either side; a frequent one has many, spread over the tasks that read them.
    """
    by_term = windows.select("phrase", "n", F.inline("lists")).groupBy("phrase", "n", "df", "term").agg(F.min("offset").alias("offset"))
    least = by_term.groupBy("phrase", "n").agg(F.sort_array(F.collect_list(F.struct("df", "term", "offset"))).alias("lists"))
    anchors = materialize(least.select("phrase", "n", F.inline(F.slice("lists", 1, NEAR_ANCHORS))).select("phrase", "n", "term", "offset"), "anchors")
    rare = materialize(anchors.select("term").distinct(), "rare")
    side = WINDOW - 1
    placed = docs.select("key", "text_hash", words(F.col("text")).alias("words")).select("key", "text_hash", "words", F.posexplode("words").alias("at", "term"))
    first = F.greatest(F.col("at") - side, F.lit(0))
    near = placed.join(small(rare), "term").select("term", "key", "text_hash", "at", first.alias("first"), F.slice("words", first + 1, F.lit(2 * side + 1)).alias("around"))
    met = near.join(small(anchors), "term").withColumn("start", F.col("at") - F.col("offset"))
    inside = (F.col("start") >= 0) & (F.array_join(F.slice("around", F.greatest(F.col("start") - F.col("first") + 1, F.lit(1)), F.col("n")), " ") == F.col("phrase"))
    distinct = F.array_distinct(F.split("phrase", " "))
    return met.where(~inside & (10 * F.size(F.array_intersect(distinct, F.col("around"))) >= NEAR_TENTHS * F.size(distinct))).select("key", "text_hash", "phrase")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """key, text_hash, n_words, hits (array of (start, n) word ranges, in order), item_ids (sorted strings), n_near, one row per row of docs.

    Words are runs of ASCII digits, small letters and non-ASCII characters after A-Z are lowered. Null and empty texts have no words, nor
    windows. Rows are told apart by key and text: repeated rows get the same result. Items with the same window are all named;
    a null item id has no name. Tables may be empty. Columns beyond those named are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text"))
    windows = materialize(test_windows(items, item, text), "windows")
    phrases = materialize(windows.select("phrase", "n").distinct(), "phrases")
    terms = materialize(phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "terms")
    index = positional_index(rows, terms)
    counts = materialize(index.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df")), "counts")
    asked = materialize(ranked(phrases, counts), "asked")
    exact = materialize(occurrences(index, asked), "exact")
    near = proximity(rows, asked)
    hits = exact.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("hits"))
    named = exact.select("key", "text_hash", "phrase").distinct().join(windows.select("phrase", "item_id"), "phrase").where(F.col("item_id").isNotNull())
    named = named.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    close = near.distinct().groupBy("key", "text_hash").agg(F.count("*").alias("n_near"))
    counted = index.where(F.col("at").isNull() | (F.col("at") == 0)).select("key", "text_hash", "n_words").alias("d")
    joined = counted.join(hits.alias("h"), same_doc("d", "h"), "left").join(named.alias("i"), same_doc("d", "i"), "left").join(close.alias("c"), same_doc("d", "c"), "left")
    return joined.select(
        F.col("d.key").alias(key),
        F.col("d.text_hash").alias("text_hash"),
        "n_words",
        F.coalesce("hits", F.array().cast("array<struct<start:bigint,n:bigint>>")).alias("hits"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def covered(hits: Column) -> Column:
    """Words inside any of the ranges, which are in order."""
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(hits, start, lambda a, x: F.struct(F.greatest(a["upto"], x["start"] + x["n"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("bigint"), x["start"] + x["n"] - F.greatest(a["upto"], x["start"]))).alias("n")))["n"]


def op9(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = decontaminate(docs, items).withColumn("n_hit", covered(F.col("hits")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")
