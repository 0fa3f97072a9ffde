"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from trackweave.llm.quality_rules import RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
low AS (SELECT t, min(doc_id) AS first_doc FROM win GROUP BY t),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (t) WHERE doc_id > first_doc),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT pos.doc_id, count(*) FILTER (hit.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY pos.p) FILTER (hit.p IS NULL) AS t FROM pos LEFT JOIN hit ON hit.doc_id = pos.doc_id AND hit.p = pos.p GROUP BY pos.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_FEATURES = {
    "symbols": "n_symbols::DOUBLE / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
    "capitals": "n_capitals::DOUBLE / greatest(word_chars, 1)",
    "marks": "n_marks::DOUBLE / greatest(word_chars, 1)",
    "long_words": "word_chars::DOUBLE / greatest(n_words, 1)",
    "short_words": "-word_chars::DOUBLE / greatest(n_words, 1)",
}
_CELLS = " UNION ALL ".join(f"SELECT doc_id, stratum, good, '{rule}' AS rule, {_FEATURES[rule]} AS f, unnest([{', '.join(f'{c}::DOUBLE' for c in cuts)}]) AS cutoff FROM s" for rule, (_, cuts) in RULES.items())
_GRID = sum(len(cuts) for _, cuts in RULES.values())
_P = 0.05 / len(RULES)

QUALITY = rf"""
WITH b AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT b.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
 len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) AS n_marks FROM b LEFT JOIN rep USING (doc_id)),
rated AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) > 0),
s AS (SELECT m.*, coalesce('=' || m.lang, 'rest') AS stratum, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, rated.doc_id IS NOT NULL AND NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS good FROM m LEFT JOIN rated ON rated.doc_id = m.doc_id),
c AS ({_CELLS}),
g AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (f > cutoff) AS r FROM c WHERE good GROUP BY stratum, rule, cutoff),
k AS (SELECT count(DISTINCT stratum) * {_GRID} AS tests FROM g),
ok AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM g, k WHERE r <= n * {_P!r}::DOUBLE AND list_sum(list_transform(range(0, r + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P!r}::DOUBLE) + (n - i) * ln(1 - {_P!r}::DOUBLE)))) <= 0.05 / tests GROUP BY stratum, rule),
bad AS (SELECT DISTINCT c.doc_id FROM c JOIN ok ON ok.stratum = c.stratum AND ok.rule = c.rule AND ok.cutoff = c.cutoff WHERE c.f > c.cutoff)
SELECT s.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM s LEFT JOIN bad ON bad.doc_id = s.doc_id"""

FILL_MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, text, u, len(u) AS n, [CAST('0x' || h[1:8] AS BIGINT), CAST('0x' || h[9:16] AS BIGINT), CAST('0x' || h[17:24] AS BIGINT), CAST('0x' || h[25:32] AS BIGINT)] AS h FROM t),
c AS (SELECT doc_id, text, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""



def components_sql(k: int, also: str = "") -> str:
    """Links by counting shared shingles, components by following links."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{also} FROM c LEFT JOIN n USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {"op8_quality_rules": QUALITY, "op10_substring_dedup": SUBSTRING, "op12_fill_middle": FILL_MIDDLE, "op3_ngram_join": components_sql(4), "op13_superminhash": components_sql(5, ", doc_id = component_id AS kept")}
