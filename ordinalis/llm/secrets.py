"""Secret scans: base patterns, and candidate values told apart by how many owners and repositories hold them.

Built-in expressions only. Texts never move: patterns run where texts are read, and only spans and value hashes are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, packed, unpacked

#: The base kinds in their order, with the pattern, the group that holds the value, that group's least length and what it must hold.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ()),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, ()),
    ("hex", r"[0-9a-f]{24,}", 0, 24, ()),
)
#: Token forms with a published prefix, mixed strings that hold a digit, a capital and a small letter each, and hexadecimal in capitals.
ADDED = (
    ("token", r"gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 14, ()),
    ("mixed", r"[A-Za-z0-9+/]{24,}", 0, 24, ("[0-9]", "[A-Z]", "[a-z]")),
    ("capital", r"[0-9A-F]{24,}", 0, 24, ("[0-9]", "[A-F]")),
)
KINDS = tuple(k[0] for k in BASE + ADDED)
#: A value that more owners or more repositories have is a copied example; one with as many or fewer of both looks live.
MAX_LIVE_OWNERS, MAX_LIVE_REPOSITORIES = 2, 4
SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
RUN = 256
#: Code points of a text among which a short part is looked for.
STRETCH = 4096


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: named outright, it would be worked out again for each element that a lambda is called with."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_of(i: Column) -> Column:
    return F.floor(i / RUN).cast("int")


def lengths_before(steps: Column) -> Column:
    """Exclusive running sums of an array, in time near to its size: sums of runs first, then inside each run."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y)
    runs = F.transform(F.sequence(F.lit(0), run_of(F.size(steps))), lambda r: total(F.slice(steps, r * RUN + 1, F.lit(RUN))))
    return bound(runs, lambda rs: F.transform(steps, lambda _, i: total(F.slice(rs, F.lit(1), run_of(i))) + total(F.slice(steps, run_of(i) * RUN + 1, i % RUN))))


def most_before(ends: Column) -> Column:
    """Exclusive running maxima of an array, from 0 on, in the same way."""
    most = lambda x: F.coalesce(F.array_max(x), F.lit(0).cast("bigint"))
    runs = F.transform(F.sequence(F.lit(0), run_of(F.size(ends))), lambda r: most(F.slice(ends, r * RUN + 1, F.lit(RUN))))
    return bound(runs, lambda rs: F.transform(ends, lambda _, i: F.greatest(most(F.slice(rs, F.lit(1), run_of(i))), most(F.slice(ends, run_of(i) * RUN + 1, i % RUN)))))


def pieces(text: Column, ranges: Column) -> Column:
    """The parts of a text at ranges (a, b) of code points. Short ones are cut from the stretch that they begin in, as a cut is found from the start."""
    stretches = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / STRETCH).cast("int")), lambda k: F.substring(text, k * STRETCH + 1, F.lit(2 * STRETCH)))
    size = lambda g: (g["b"] - g["a"]).cast("int")
    near = lambda s, g: F.substring(F.get(s, F.floor(g["a"] / STRETCH).cast("int")), (g["a"] % STRETCH + 1).cast("int"), size(g))
    return bound(stretches, lambda s: F.transform(ranges, lambda g: F.when(size(g) <= STRETCH, near(s, g)).otherwise(F.substring(text, (g["a"] + 1).cast("int"), size(g)))))


def with_spans(df: DataFrame, text: str, out: str, rank: int, kind: tuple[str, str, int, int, tuple[str, ...]]) -> DataFrame:
    """Adds the spans of one kind, leftmost and non-overlapping, as an array of (start, rank, end, value) in code points."""
    _, pattern, group, least, holds = kind
    empty = F.array().cast(SPAN)
    found = F.col(text).rlike(pattern)
    cut = lambda c: F.when(found, c)
    df = df.withColumns({"_hits": cut(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), "_values": cut(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))), "_gaps": cut(F.split(text, pattern))})
    df = df.withColumn("_steps", F.transform("_hits", lambda h, i: (F.char_length(F.get("_gaps", i)) + F.char_length(h)).cast("bigint")))
    df = df.withColumn("_before", F.when(F.size("_steps") > 0, lengths_before(F.col("_steps"))))
    spans = F.transform(
        "_hits",
        lambda h, i: F.struct(
            (F.get("_before", i) + F.char_length(F.get("_gaps", i))).alias("start"),
            F.lit(rank).alias("rank"),
            (F.get("_before", i) + F.char_length(F.get("_gaps", i)) + F.char_length(h)).alias("end"),
            F.get("_values", i).alias("value"),
        ),
    )
    kept = F.filter(spans, lambda s: reduce(and_, [s["value"].rlike(h) for h in holds], F.char_length(s["value"]) >= least))
    return df.withColumn(out, F.coalesce(kept.cast(SPAN), empty)).drop("_hits", "_values", "_gaps", "_steps", "_before")


def scan(df: DataFrame, text: str = "text", first: int = 0) -> DataFrame:
    """df with _spans: all spans of the kinds from the first on, by start and kind. Null texts have none."""
    names = [f"_spans{i}" for i in range(first, len(KINDS))]
    for rank, (name, kind) in enumerate(zip(names, (BASE + ADDED)[first:], strict=True), first):
        df = with_spans(df, text, name, rank, kind)
    return df.withColumn("_spans", F.sort_array(F.concat(*names))).drop(*names)


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repositories over candidates (value_hash, owner, repository): each exact, from distinct triples.

    Copies of a value by one owner are merged before the shuffle, so a widely copied value costs a row per task and owner. A
    repository belongs to its owner. Null owners count as one owner, null repositories as one of their owner's.
    """
    triples = candidates.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one"))
    return triples.groupBy("value_hash", "owner").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def live(n_owners: Column, n_repositories: Column) -> Column:
    return (n_owners <= MAX_LIVE_OWNERS) & (n_repositories <= MAX_LIVE_REPOSITORIES)


def secret_spans(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang", corpus: DataFrame | None = None) -> DataFrame:
    """key, text_hash, spans: array of (start, rank, end, n_owners, n_repositories), one row per row of df.

    Spans are those of the base kinds, and of the added kinds if few owners and repositories hold their value; rank is the place in KINDS. corpus:
    rows with the same columns of which the added kinds' values are counted as well, where df is only what a filter left. Rows are told
    apart by key and text: repeated rows have the same spans, and count once. Rows without spans have an empty array. Null keys,
    texts, owners and repositories are values like others, a null text holding nothing. Columns beyond the four are not read.
    """
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{owner}`").alias("owner"), F.col(f"`{repository}`").alias("repository"))
    found = scan(source.withColumn("text_hash", F.xxhash64("text")), "text").select("key", "text_hash", "owner", "repository", F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value_hash"))).alias("found"))
    found = materialize(found, "spans")
    each = found.where(F.size("found") > 0).select("key", "text_hash", "owner", "repository", F.inline("found"))
    candidates = each.select("value_hash", "owner", "repository")
    if corpus is not None:
        held = corpus.select(F.col(f"`{text}`").alias("text"), F.col(f"`{owner}`").alias("owner"), F.col(f"`{repository}`").alias("repository"))
        candidates = candidates.unionByName(scan(held, "text", len(BASE)).select(F.explode("_spans").alias("s"), "owner", "repository").select(F.sha2("s.value", 256).alias("value_hash"), "owner", "repository"))
    owners = ownership(candidates)
    spans = each.select("key", "text_hash", "value_hash", "start", "rank", "end").distinct().join(owners, "value_hash")
    held = spans.where((F.col("rank") < len(BASE)) | live(F.col("n_owners"), F.col("n_repositories")))
    by_row = held.groupBy(F.col("key").alias("k"), F.col("text_hash").alias("h")).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "n_owners", "n_repositories"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,n_owners:bigint,n_repositories:bigint>>")
    return found.join(by_row, found.key.eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left").select(F.col("key").alias(key), "text_hash", F.coalesce("spans", none).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"], s["end"])), ",")


def redact(df: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its texts replaced by the mark, overlapping spans by one. spans: of secret_spans() on the same rows.

    Only rows with spans are sent to be matched; other columns stay, and rows are neither dropped nor repeated.
    """
    marked = spans.where(F.size("spans") > 0).select(F.col(f"`{key}`").alias("_k"), F.col("text_hash").alias("_h"), "spans").dropDuplicates(["_k", "_h"])
    rows = packed(df, key=F.col(f"`{key}`"), text=F.col(f"`{text}`"), text_hash=F.xxhash64(f"`{text}`"))
    out = rows.join(marked, F.col("key").eqNullSafe(F.col("_k")) & (F.col("text_hash") == F.col("_h")), "left")
    # what is left begins at the furthest end before, so that overlaps leave no text between them
    some = lambda c: F.when(F.col("spans").isNotNull(), c)
    out = out.withColumns({"_starts": some(F.col("spans.start")), "_ends": some(F.col("spans.end"))}).withColumn("_from", some(most_before(F.col("_ends"))))
    gaps = F.filter(F.arrays_zip(F.col("_from").alias("a"), F.col("_starts").alias("b")), lambda g: g["b"] >= g["a"])
    rest = F.struct(F.array_max("_ends").alias("a"), F.char_length("text").cast("bigint").alias("b"))
    out = out.withColumn("_cut", some(F.concat(gaps, F.array(rest))))
    whole = F.array_join(pieces(F.col("text"), F.col("_cut")), mark)
    redacted = F.when(F.col("spans").isNotNull(), whole).otherwise(F.col("text")).alias(text)
    return out.select(*[redacted if c == text else u for c, u in zip(df.columns, unpacked(df.columns), strict=True)])


def of_kind(rank: int):
    return lambda s: s["rank"] == rank


def op8(df: DataFrame) -> DataFrame:
    found = secret_spans(df.select("doc_id", "text", "source", "lang"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        "doc_id",
        *[count(of_kind(i)).alias(f"n_{KINDS[i]}") for i in range(len(BASE))],
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
        count(lambda s: live(s["n_owners"], s["n_repositories"])).alias("n_live"),
        count(lambda s: ~live(s["n_owners"], s["n_repositories"])).alias("n_example"),
        F.coalesce(F.array_max("spans.n_owners"), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max("spans.n_repositories"), F.lit(0)).alias("most_repositories"),
    )
