"""Quality rules: base counts, and the Jensen-Shannon distance of each text's character classes and common words from its language's.

Built-in expressions only. No shuffle of texts: one aggregation makes the references (a row per language), one narrow pass judges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, packed, unpacked

#: Language references, the most common function words of each language with their occurrences in a thousand words of running text.
COMMON_WORDS = {
    "en": {"the": 60, "of": 32, "and": 28, "to": 26, "a": 22, "in": 20, "is": 10, "that": 10, "it": 9, "for": 9, "was": 8, "on": 7, "with": 7, "as": 7, "be": 6, "by": 5, "are": 5, "this": 5, "at": 5, "from": 4, "or": 4, "an": 3, "not": 4, "which": 3},
    "fr": {"de": 50, "la": 28, "le": 22, "et": 20, "les": 18, "des": 15, "en": 14, "un": 12, "du": 12, "une": 11, "que": 10, "est": 10, "pour": 8, "par": 7, "dans": 8, "qui": 8, "pas": 6, "sur": 6, "au": 6, "plus": 4, "il": 6, "avec": 4, "ce": 5, "ou": 3},
    "de": {"der": 34, "die": 33, "und": 26, "in": 18, "den": 12, "von": 11, "zu": 11, "das": 11, "mit": 9, "sich": 7, "des": 8, "auf": 8, "für": 7, "ist": 8, "im": 7, "nicht": 7, "dem": 7, "ein": 7, "eine": 6, "als": 5, "auch": 5, "an": 5, "er": 4, "es": 5},
    "es": {"de": 60, "la": 36, "que": 28, "el": 27, "en": 25, "y": 24, "a": 19, "los": 16, "se": 12, "del": 12, "las": 11, "un": 11, "por": 9, "con": 9, "no": 9, "una": 8, "su": 8, "para": 8, "es": 7, "al": 6, "lo": 6, "como": 5, "más": 4, "o": 4},
}
#: Characters of each of CLASSES, and others, in a thousand of running text.
CLASS_SHARES = {"lower": 790, "space": 165, "upper": 20, "digit": 4, "symbol": 1, "stop": 13, "mark": 5, "other": 2}
#: The language references count as so many words and characters of text; the table's own texts are added.
PRIOR_WORDS, PRIOR_CHARS = 5_000, 30_000
#: Words of each language in the pooled reference.
POOLED_WORDS = 6
#: The reference of rows in other languages or none: all languages together.
POOLED = "*"
SPACE = r"[\x20\x09-\x0D]"
#: Character classes, taken out of the text one after another; what is left is the last class.
CLASSES = {"lower": r"\p{Ll}+", "space": SPACE + "+", "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "symbol": r"[#*$%&|<>]+", "stop": r"[.,;]+", "mark": r"[!?:'\"()\[\]{}/\\_=+~^`@-]+"}
MIN_WORDS, MAX_REPEATED = 50, 50
#: Guards: texts with fewer characters or words aren't held against the references.
MIN_CHARS, MIN_COMPARED_WORDS = 200, 120
#: Texts with a smaller share of lower-case letters or a larger one of symbols, in hundredths, don't count for the references.
MIN_REFERENCE_LOWER, MAX_REFERENCE_SYMBOLS = 50, 1
#: Largest distances (0 for like, 1 for disjoint histograms): a floor, and a share for sampling noise, which falls with the roots of the text's and the
#: reference's lengths.
MAX_CLASS_DISTANCE, CLASS_NOISE = 0.10, 2.2
MAX_WORD_DISTANCE, WORD_NOISE = 0.15, 3.5


def language_key(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise(POOLED)


def pooled_shares() -> dict[str, float]:
    """The first words of each language, with their mean over the languages that have them among their first."""
    words = [w for ws in COMMON_WORDS.values() for w in list(ws)[:POOLED_WORDS]]
    return {w: sum(ws.get(w, 0) for ws in COMMON_WORDS.values()) / len(COMMON_WORDS) for w in dict.fromkeys(words)}


def shares() -> dict[str, dict[str, float]]:
    """Words in a thousand by reference."""
    return {**COMMON_WORDS, POOLED: pooled_shares()}


def prior() -> dict[str, tuple[list[float], list[float]]]:
    """Counts of classes, and of common words and all others, that each reference starts with."""
    classes = [x * PRIOR_CHARS / 1000 for x in CLASS_SHARES.values()]
    return {k: (classes, [x * PRIOR_WORDS / 1000 for x in (*ws.values(), 1000 - sum(ws.values()))]) for k, ws in shares().items()}


def common_words(key: Column) -> Column:
    """The words counted for a language."""
    of = shares()
    return reduce(lambda rest, k: F.when(key == k, F.array(*map(F.lit, of[k]))).otherwise(rest), COMMON_WORDS, F.array(*map(F.lit, of[POOLED])))


def histograms(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df with _key, _n_words, _classes (counts of the character classes) and _common (counts of common words, then of others)."""
    out = df.withColumn("_left0", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", F.array_remove(F.split("_left0", SPACE + "+"), ""))
    counts = []
    for i, pattern in enumerate(CLASSES.values()):
        out = out.withColumn(f"_left{i + 1}", F.regexp_replace(f"_left{i}", pattern, ""))
        counts.append(F.char_length(f"_left{i}") - F.char_length(f"_left{i + 1}"))
    counts.append(F.char_length(f"_left{len(CLASSES)}"))
    # words stand apart by two spaces, so that taking out one occurrence leaves its neighbours whole
    out = out.withColumns({"_key": language_key(F.col(lang)), "_joined": F.lower(F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" "))), "_n_words": F.size("_words").cast("long"), "_chars": F.char_length("_left0")})
    occurrences = F.transform(common_words(F.col("_key")), lambda w: (F.octet_length("_joined") - F.octet_length(F.replace(F.col("_joined"), F.concat(F.lit(" "), w, F.lit(" "))))) / (F.octet_length(w) + 2))
    out = out.withColumns({"_classes": F.array(*[c.cast("double") for c in counts]), "_counted": occurrences})
    others = F.col("_n_words") - F.aggregate("_counted", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("_common", F.concat("_counted", F.array(others))).drop(*[f"_left{i}" for i in range(1, len(CLASSES) + 1)], "_joined", "_counted")


def references(rows: DataFrame) -> DataFrame:
    """_key, _ref_classes, _ref_common, _ref_chars: shares of a language's reference, over its prior and all texts of the language that have MIN_WORDS
    words and pass for prose; five rows, of languages without such texts too.

    rows: of histograms(). The pooled row is that of texts in unlisted languages, whose common words are a mixture of all languages'.
    """
    n_classes, most = len(CLASSES) + 1, max(map(len, shares().values())) + 1
    share_of = lambda name: 100 * F.get("_classes", F.lit([*CLASSES].index(name)))
    rows = rows.where((F.col("_n_words") >= MIN_WORDS) & (share_of("lower") >= MIN_REFERENCE_LOWER * F.col("_chars")) & (share_of("symbol") <= MAX_REFERENCE_SYMBOLS * F.col("_chars")))
    sums = rows.groupBy("_key").agg(*[F.sum(F.get("_classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)], *[F.sum(F.get("_common", F.lit(i))).alias(f"w{i}") for i in range(most)])
    sums = sums.select(F.col("_key").alias("k"), F.array(*[f"c{i}" for i in range(n_classes)]).alias("cs"), F.array(*[f"w{i}" for i in range(most)]).alias("ws"))
    start = F.array(*[F.struct(F.lit(k).alias("_key"), F.array(*map(F.lit, c)).alias("pc"), F.array(*map(F.lit, w)).alias("pw")) for k, (c, w) in prior().items()])
    first = rows.sparkSession.range(1).select(F.inline(start))
    both = first.join(F.broadcast(sums), F.col("_key") == F.col("k"), "left")
    added = lambda p, x: F.transform(p, lambda v, i: v + F.coalesce(F.get(x, i), F.lit(0.0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    both = both.select("_key", added("pc", F.col("cs")).alias("c"), added("pw", F.col("ws")).alias("w")).withColumns({"nc": total(F.col("c")), "nw": total(F.col("w"))})
    return both.select("_key", F.transform("c", lambda x: x / F.col("nc")).alias("_ref_classes"), F.transform("w", lambda x: x / F.col("nw")).alias("_ref_common"), F.col("nc").alias("_ref_chars"))


def jensen_shannon(counts: Column, share: Column) -> Column:
    """The distance of a histogram of counts from one of shares; 0 for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def part(c: Column, q: Column) -> Column:
        p = c / F.greatest(total, F.lit(1.0))
        m = (p + q) / 2
        term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (term(p) + term(q)) / 2

    bits = F.aggregate(F.zip_with(counts, share, part), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(bits, F.lit(0.0)))).otherwise(0.0)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the array has twice or more. Windows are compared by 64-bit hash, inside one text only."""
    n = F.size(words)
    grams = F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))))
    return F.sort_array(grams)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
HIDDEN = ["_key", "_n_words", "_chars", "_classes", "_common"]


def features(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df with the base columns and the hidden histograms. Columns of these names are replaced; null texts have no words and fail."""
    kept = [c for c in df.columns if c not in BASE]
    out = histograms(df.select(*kept), text, lang)
    lines = F.filter(F.split("_left0", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({"_lines": lines, "_grams": repeated_words(F.col("_words"))})
    again = F.filter("_grams", lambda x, i: (x["h"] == F.get("_grams", i - 1)["h"]) | (x["h"] == F.get("_grams", i + 1)["h"]))
    out = out.withColumn("_places", F.sort_array(F.transform(again, lambda x: x["p"])))
    start = F.struct(F.lit(-3).alias("before"), F.lit(0).alias("n"))
    covered = F.aggregate("_places", start, lambda a, p: F.struct(p.alias("before"), (a["n"] + F.least(F.lit(3), p - a["before"])).alias("n")))["n"]
    places = list(CLASSES)
    out = out.withColumns(
        {
            "n_words": F.col("_n_words"),
            "word_chars": (F.col("_chars") - F.get("_classes", F.lit(places.index("space")))).cast("long"),
            "n_symbols": F.get("_classes", F.lit(places.index("symbol"))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    return out.select(*kept, *BASE, *HIDDEN)


def verdict(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows of features() with class_distance, word_distance and kept, without the hidden columns.

    Texts too short for a guard are judged by the base rules alone, or by classes alone. refs has five rows and is broadcast.
    """
    new = ["class_distance", "word_distance", "kept"]
    out = rows.select(*[c for c in rows.columns if c not in new]).join(F.broadcast(refs), "_key", "left")
    out = out.withColumns(
        {
            "class_distance": F.when(F.col("_chars") >= MIN_CHARS, jensen_shannon(F.col("_classes"), F.col("_ref_classes"))).otherwise(0.0),
            "word_distance": F.when(F.col("n_words") >= MIN_COMPARED_WORDS, jensen_shannon(F.col("_common"), F.col("_ref_common"))).otherwise(0.0),
        }
    )
    noise = F.sqrt(1 / F.greatest(F.col("_chars"), F.lit(1)) + 1 / F.col("_ref_chars"))
    near = (F.col("class_distance") <= MAX_CLASS_DISTANCE + CLASS_NOISE * noise) & (F.col("word_distance") <= MAX_WORD_DISTANCE + WORD_NOISE * noise)
    return out.withColumn("kept", ~F.col("base_failed") & near).select(*[c for c in rows.columns if c not in new + HIDDEN], *new)


def quality(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance and kept.

    References are those of the languages, COMMON_WORDS and CLASS_SHARES, as PRIOR_WORDS words of text, to which
    the table's own prose is added; so a small table's references are the languages', and a large one's mostly its own, with no switch between. Texts
    aren't shuffled. Ties and repeated rows are judged alike, each by itself. Other columns stay, but those of the new names are
    replaced. An empty table gives an empty result.
    """
    new = [*BASE, "class_distance", "word_distance", "kept"]
    return judged(df, text, lang).select(*unpacked([c for c in df.columns if c not in new]), *new)


def judged(df: DataFrame, text: str, lang: str) -> DataFrame:
    """The rows of df, packed, with their histograms written along, so that texts are looked through once; then the references, and the verdicts."""
    rows = materialize(features(packed(df, text=F.col(f"`{text}`"), lang=F.col(f"`{lang}`"))).drop("text", "lang"), "features")
    return verdict(rows, materialize(references(rows), "references"))


def passing(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df that quality() keeps, with the columns of df."""
    return judged(df, text, lang).where("kept").select(*unpacked(df.columns))


def quality_of(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """As quality(), but only the key and the new columns: with no text to carry along, one pass over the texts will do."""
    rows = materialize(features(df.select(key, text, lang), text, lang).drop(text, lang), "features")
    return verdict(rows, materialize(references(rows), "references"))


def op4(df: DataFrame) -> DataFrame:
    found = quality_of(df)
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})
