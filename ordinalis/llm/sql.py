"""DuckDB SQL that says what the queries of operators 4, 8 and 9 return, over whole tables, by plain means."""

from __future__ import annotations

from . import decontamination, quality, secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def quality_rules() -> str:
    space = quality.SPACE
    left, counts = [], []
    for i, pattern in enumerate(quality.CLASSES.values()):
        left.append(f"t{i + 1} AS (SELECT *, regexp_replace(x{i}, {quoted(pattern)}, '', 'g') AS x{i + 1} FROM t{i})")
        counts.append(f"length(x{i}) - length(x{i + 1})")
    last = len(quality.CLASSES)
    counts.append(f"length(x{last})")
    pooled = list(quality.pooled_shares())
    cases = " ".join(f"WHEN {quoted(k)} THEN {listed(list(v))}" for k, v in quality.COMMON_WORDS.items())
    prior = ", ".join(f"({quoted(k)}, {[float(x) for x in c]}, {[float(x) for x in w]})" for k, (c, w) in quality.prior().items())
    keys = ", ".join(map(quoted, quality.COMMON_WORDS))
    place = {k: i + 1 for i, k in enumerate(quality.CLASSES)}
    most = max(map(len, [*quality.COMMON_WORDS.values(), pooled])) + 1
    sums = lambda name, n: "list_filter([" + ", ".join(f"sum({name}[{i + 1}])" for i in range(n)) + "], lambda x: x IS NOT NULL)"

    def distance(c: str, q: str) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p.a + p.b) / 2)) ELSE 0 END"
        pairs = f"list_transform(range(1, len({c}) + 1), lambda i: {{'a': {c}[i] / greatest(list_sum({c}), 1.0), 'b': {q}[i]}})"
        bits = f"list_sum(list_transform({pairs}, lambda p: ({part.format('p.a')} + {part.format('p.b')}) / 2))"
        return f"CASE WHEN list_sum({c}) > 0 THEN sqrt(greatest({bits}, 0.0)) ELSE 0.0 END"

    return f"""WITH t0 AS (SELECT doc_id, CASE WHEN lang IN ({keys}) THEN lang ELSE '*' END AS k, coalesce(text, '') AS x0 FROM documents),
{", ".join(left)},
w AS (SELECT doc_id, k, x0, list_filter(regexp_split_to_array(x0, {quoted(space + "+")}), lambda x: x <> '') AS ws, [{", ".join(f"({c})::DOUBLE" for c in counts)}] AS classes FROM t{last}),
j AS (SELECT *, len(ws) AS n, lower(' ' || array_to_string(ws, '  ') || ' ') AS joined, CASE k {cases} ELSE {listed(pooled)} END AS common FROM w),
c AS (SELECT *, list_transform(common, lambda v: (length(joined) - length(replace(joined, ' ' || v || ' ', ''))) / (length(v) + 2)) AS seen FROM j),
h AS (SELECT *, list_append(seen, n - list_sum(seen)) AS words FROM c),
r AS (SELECT k, {sums("classes", len(quality.CLASSES) + 1)} AS rc, {sums("words", most)} AS rw FROM h
  WHERE n >= {quality.MIN_WORDS} AND 100 * classes[{place["lower"]}] >= {quality.MIN_REFERENCE_LOWER} * length(x0) AND 100 * classes[{place["symbol"]}] <= {quality.MAX_REFERENCE_SYMBOLS} * length(x0) GROUP BY k),
pri AS (SELECT k, pc::DOUBLE[] AS pc, pw::DOUBLE[] AS pw FROM (VALUES {prior}) t(k, pc, pw)),
raw AS (SELECT k, list_transform(range(1, len(pc) + 1), lambda i: pc[i] + coalesce(rc[i], 0)) AS rc, list_transform(range(1, len(pw) + 1), lambda i: pw[i] + coalesce(rw[i], 0)) AS rw FROM pri LEFT JOIN r USING (k)),
ref AS (SELECT k, list_sum(rc) AS ref_chars, list_transform(rc, lambda x: x / list_sum(rc)) AS rc, list_transform(rw, lambda x: x / list_sum(rw)) AS rw FROM raw),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(n - 1, 1))) AS i FROM j)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS m FROM g) WHERE m > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(x0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t0),
base AS (SELECT h.*, length(x0) AS chars, coalesce(n_repeat, 0) AS n_repeat, len(lines) - len(list_distinct(lines)) AS n_dup FROM h LEFT JOIN rep USING (doc_id) JOIN l USING (doc_id)),
f AS (SELECT base.*, ref_chars, n < {quality.MIN_WORDS} OR 100 * n_repeat > {quality.MAX_REPEATED} * n AS failed,
  CASE WHEN chars >= {quality.MIN_CHARS} THEN {distance("classes", "rc")} ELSE 0.0 END AS cd,
  CASE WHEN n >= {quality.MIN_COMPARED_WORDS} THEN {distance("words", "rw")} ELSE 0.0 END AS wd FROM base LEFT JOIN ref USING (k))
SELECT doc_id, n::BIGINT AS n_words, (chars - classes[{place["space"]}])::BIGINT AS word_chars, classes[{place["symbol"]}]::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words,
  failed AS base_failed, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance,
  NOT failed AND cd <= {quality.MAX_CLASS_DISTANCE} + {quality.CLASS_NOISE} * sqrt(1.0::DOUBLE / greatest(chars, 1) + 1 / ref_chars) AND wd <= {quality.MAX_WORD_DISTANCE} + {quality.WORD_NOISE} * sqrt(1.0::DOUBLE / greatest(chars, 1) + 1 / ref_chars) AS kept FROM f"""


def secret_scans() -> str:
    kinds = secrets.BASE + secrets.ADDED
    found = []
    for rank, (_, pattern, group, least, holds) in enumerate(kinds):
        p = quoted(pattern)
        tests = "".join(f" AND regexp_matches(val, {quoted(x)})" for x in holds)
        found.append(
            f"""SELECT doc_id, source, lang, {rank} AS kind, val, a, a + length(hit) AS b FROM (
  SELECT doc_id, source, lang, hits[i] AS hit, vals[i] AS val, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, source, lang, regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, {group}) AS vals, regexp_split_to_array(text, {p}) AS gaps FROM documents WHERE regexp_matches(text, {p}))))
WHERE length(val) >= {least}{tests}"""
        )
    n_base, live = len(secrets.BASE), f"(n_owners <= {secrets.MAX_LIVE_OWNERS} AND n_repositories <= {secrets.MAX_LIVE_REPOSITORIES})"
    spelled = f"{listed(list(secrets.KINDS))}[kind + 1] || ':' || a || ':' || b"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{secrets.KINDS[i]}" for i in range(n_base))
    return f"""WITH found AS ({" UNION ALL ".join(found)}),
owners AS (SELECT val, count(*) AS n_owners, sum(n)::BIGINT AS n_repositories FROM (SELECT val, source, count(*) AS n FROM (SELECT DISTINCT val, source, lang FROM found) GROUP BY val, source) GROUP BY val),
held AS (SELECT * FROM found JOIN owners USING (val) WHERE kind < {n_base} OR {live}),
per AS (SELECT doc_id, {counts}, string_agg({spelled}, ',' ORDER BY a, kind) FILTER (kind < {n_base}) AS base, string_agg({spelled}, ',' ORDER BY a, kind) AS spans,
  count(*) FILTER ({live}) AS n_live, count(*) FILTER (NOT {live}) AS n_example, max(n_owners) AS most_owners, max(n_repositories) AS most_repositories FROM held GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{secrets.KINDS[i]}, 0) AS n_{secrets.KINDS[i]}" for i in range(n_base))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories FROM documents LEFT JOIN per USING (doc_id)"""


def decontaminated() -> str:
    n, side = decontamination.WINDOW, decontamination.WINDOW - 1
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), {quoted(decontamination.BETWEEN_WORDS)}), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, w, least({n}, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + n - 1], ' ') AS phrase, n FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
phrases AS (SELECT DISTINCT phrase, n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM phrases))),
hits AS (SELECT * FROM grams JOIN phrases USING (phrase, n)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits JOIN win USING (phrase, n) WHERE item_id IS NOT NULL) GROUP BY doc_id),
posts AS (SELECT doc_id, w, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
places AS (SELECT phrase, n, unnest(string_split(phrase, ' ')) AS term, unnest(range(0, n)) AS o FROM phrases),
anchors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phrase, n ORDER BY df, term) AS place FROM (SELECT phrase, n, term, df, min(o) AS o FROM places JOIN df USING (term) GROUP BY ALL)) WHERE place <= {decontamination.NEAR_ANCHORS}),
met AS (SELECT doc_id, phrase, a.n, pos - o AS s, greatest(pos - {side}, 0) AS first, w[greatest(pos - {side}, 0) + 1:greatest(pos - {side}, 0) + {2 * side + 1}] AS around, list_distinct(string_split(phrase, ' ')) AS terms FROM posts JOIN anchors a USING (term)),
near AS (SELECT doc_id, count(DISTINCT phrase) AS n_near FROM met WHERE NOT (s >= 0 AND array_to_string(around[greatest(s - first + 1, 1):greatest(s - first + 1, 1) + n - 1], ' ') = phrase)
  AND 10 * len(list_intersect(terms, around)) >= {decontamination.NEAR_TENTHS} * len(terms) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)"""
