"""SQL (DuckDB) of the operators' queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import quality_rules, secrets

_WORD = r"[^\x20\x09-\x0D]+"


def mixing(weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 1) -> str:
    """Sources by cap per weight: the first level that no unclamped source exceeds is the water's."""
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
  md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 r AS (SELECT *, {list(map(float, weights))}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1 AS INTEGER)] AS weight, {cap} * source_size AS most FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k FROM r),
 l AS (SELECT k, most / weight AS ratio, ({share} * (SELECT sum(source_size) FROM s) - (coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
   / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
 w AS (SELECT coalesce((SELECT level FROM l WHERE ratio >= level ORDER BY k LIMIT 1), 'infinity'::DOUBLE) AS level),
 t AS (SELECT source, source_size, least(most, weight * level) AS target FROM r, w),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS epochs FROM t),
 p AS (SELECT *, CAST(floor(epochs) AS BIGINT) AS whole, (epochs - floor(epochs)) * source_size AS part FROM e),
 m AS (SELECT d.*, p.* EXCLUDE (source), sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
 SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CASE WHEN part > 0 AND middle <= part THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m"""


def ngram_join(k: int = 3, num: int = 90, den: int = 100) -> str:
    """All pairs that share a shingle, counted; components by reachability."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '{_WORD}') AS w FROM documents),
 g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: {" || ' ' || ".join(f"w[i + {j}]" for j in range(k))}) END) AS s FROM d),
 n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
 c AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
 l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE {den} * shared >= {num} * (x.n + y.n - shared)),
 v AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 q AS (SELECT r AS a, r AS b FROM d UNION SELECT q.a, v.b FROM q JOIN v ON q.b = v.a)
 SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
 FROM d LEFT JOIN n USING (r) JOIN q ON q.a = d.r JOIN d o ON o.r = q.b GROUP BY d.r, d.doc_id, n.n"""


def warc(least: int = 1000) -> str:
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
 m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS newest, strlen(h) >= {least} AS long FROM p)
 SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, x AS payload_digest, CASE WHEN long AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN long AND page_id <> newest THEN newest END AS refers_to FROM m"""


def _spelled(pattern: str) -> str:
    """A pattern that ignores the case of ASCII letters only, without a flag: letters outside classes as both."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        size = 4 if pattern.startswith("\\x", at) else 2 if c == "\\" else pattern.index("]", at) + 1 - at if c == "[" else 1
        part = pattern[at : at + size]
        out.append(f"[{part.lower()}{part.upper()}]" if size == 1 and part.isalpha() else part)
        at += size
    return "".join(out)


def secret_scan(rules=secrets.BASE + secrets.MORE, base: int = len(secrets.BASE)) -> str:
    """Texts are cut at each rule's matches; places are running sums of what lies between and of the matches."""
    found = []
    for rank, rule in enumerate(rules):
        p = (_spelled(rule.pattern.removeprefix("(?i)")) if rule.pattern.startswith("(?i)") else rule.pattern).replace("'", "''")
        cut = f"SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', {rule.part}) AS z FROM d"
        rows = f"SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS hit, unnest(g[1:len(m)]) AS gap, unnest(z) AS part FROM ({cut})"
        ends = f"SELECT r, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS e, length(hit) AS n, length(part) AS p FROM ({rows})"
        found.append(f"SELECT r, {rank} AS k, '{rule.kind}' AS kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ({ends}) WHERE p >= {rule.least}")
    span = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{rules[i].kind}" for i in range(base))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(found)}),
 a AS (SELECT r, {counts}, {span} FILTER (WHERE k < {base}) AS base_spans, {span} AS spans FROM f GROUP BY r)
 SELECT doc_id, {", ".join(f"coalesce(n_{rules[i].kind}, 0) AS n_{rules[i].kind}" for i in range(base))}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


def ablations(policy: str = "web-1") -> str:
    inside = f"(failures & {quality_rules.mask(policy)})"
    one = [f"SELECT '{n}' AS rule, count(*) FILTER (WHERE failures & {quality_rules.BIT[n]} <> 0) AS failed, count(*) FILTER (WHERE {inside} = {quality_rules.BIT[n]}) AS failed_alone, count(*) AS rows FROM q" for n in quality_rules.POLICIES[policy]]
    return f"WITH q AS ({quality()}) " + " UNION ALL ".join(one)


def quality() -> str:
    """Measurements word by word; rules and policies as the ledger has them."""
    tests = {
        "too_few_words": "n_words < 50", "repeated_windows": "100 * n_repeat_words > 50 * n_words", "symbols_per_word": "2 * n_symbols > n_words",
        "duplicate_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines", "mean_word_short": "2 * word_chars < 3 * n_words", "mean_word_long": "word_chars > 25 * n_words", "too_many_words": "n_words > 1000000",
    }
    bits = " + ".join(f"CASE WHEN {tests[name]} THEN {quality_rules.BIT[name]} ELSE 0 END" for name, _ in quality_rules.RULES)
    passes = lambda policy: f"(failures & {quality_rules.mask(policy)}) = 0"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS w FROM (SELECT r, regexp_extract_all(t, '{_WORD}') AS x FROM d)),
 n AS (SELECT r, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM w GROUP BY r),
 g AS (SELECT r, i, w || ' ' || lead(w) OVER k || ' ' || lead(w, 2) OVER k AS g FROM w WINDOW k AS (PARTITION BY r ORDER BY i)),
 c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL),
 z AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) o(j) WHERE n > 1 GROUP BY r),
 l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY r),
 m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN n USING (r) LEFT JOIN z USING (r) LEFT JOIN l USING (r)),
 f AS (SELECT *, CAST({bits} AS INTEGER) AS failures FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT {passes("base-1")} AS base_failed, {passes("web-1")} AS kept, failures FROM f"""
