"""DuckDB SQL for those training-data queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

from quantaloom.llm import neardup, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

OP3 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_words("text", _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words("text", _ALNUM)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g, least(len(w), 13) AS n FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
hits AS (SELECT k, i, win.n, item_id FROM grams JOIN win ON win.g = grams.g AND win.n = grams.n),
cover AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS j FROM hits) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, coalesce(item_id::VARCHAR, '') AS item FROM hits) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN cover USING (k) LEFT JOIN items USING (k)"""


def _op6() -> str:
    values = {
        "symbols": "CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END",
        "dup_lines": "CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END",
        "shouting": "CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars ELSE 0 END",
    }
    assert set(values) == set(quality.LADDERS)
    rungs = ", ".join(f"('{rule}', {i}, {level}::DOUBLE)" for rule, ladder in quality.LADDERS.items() for i, level in enumerate(ladder))
    rate, rules = quality.ALPHA / len(quality.LADDERS), len(quality.LADDERS)
    held = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in values) + " END"
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in values.items()) + " END"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
grams AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT k, g FROM grams GROUP BY k, g HAVING count(*) > 1),
rep AS (SELECT k, count(*) AS n_repeat_words FROM (SELECT DISTINCT k, unnest(range(i, i + 8)) AS j FROM grams JOIN twice USING (k, g)) GROUP BY k),
lines AS (SELECT k, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_SPACED}')) AS ls FROM d),
m AS (SELECT d.k, doc_id, stratum, len(w)::BIGINT AS n_words, (length(t) - len(regexp_extract_all(t, '[ \\t-\\r]')))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z!]{{2}}')) AS n_upper FROM d JOIN lines USING (k) LEFT JOIN rep USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
good AS (SELECT doc_id, min(stratum) AS stratum, {", ".join(f"max({v}) AS {r}" for r, v in values.items())} FROM b JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  WHERE q = 1 GROUP BY doc_id HAVING NOT bool_or(base_failed)),
rungs(rule, step, level) AS (VALUES {rungs}), strata AS (SELECT count(DISTINCT stratum) AS s FROM good),
lost AS (SELECT stratum, rule, step, level, count(*) AS n, count(*) FILTER ({held} > level) AS x FROM good, rungs GROUP BY ALL),
tail AS (SELECT *, list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}::DOUBLE) + (n - i) * ln(1 - {rate!r}::DOUBLE)))) <= {quality.DELTA!r} / (s * {rules}) AS safe FROM lost, strata),
cut AS (SELECT stratum, rule, min(level) AS level FROM tail t WHERE safe AND NOT EXISTS (SELECT 1 FROM tail u WHERE u.stratum = t.stratum AND u.rule = t.rule AND u.step < t.step AND NOT u.safe) GROUP BY stratum, rule),
gone AS (SELECT DISTINCT k FROM b JOIN cut USING (stratum) WHERE {value} > level)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND k NOT IN (SELECT k FROM gone) AS kept FROM b"""


OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words("text", _SPACED)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {neardup.PERCENT} * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS z FROM d UNION SELECT reach.a, link.y FROM reach JOIN link ON link.x = reach.z),
comp AS (SELECT a AS doc_id, min(z) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_decontamination": OP3, "op6_risk_controlled_quality": _op6(), "op9_circulant_minhash": OP9}
