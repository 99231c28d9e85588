"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from spindrift.llm.mixing import MAX_EPOCHS
from spindrift.llm.quality_rules import STOP_WORDS, SYMBOLS

WHITE = r"[\x20\x09-\x0D]"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))

#: The mix, from a relation `docs`.
MIX = rf"""
sized AS (SELECT *, len({WORDS}) AS size, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u FROM docs),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * {MAX_EPOCHS} AS cap,
         CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM sources),
filled AS (SELECT *, cap * weight_from <= weight * (total - cap_before) AS is_full FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE (weight * (total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)))::DOUBLE / (sum(weight) FILTER (WHERE NOT is_full) OVER ())::DOUBLE
         END AS target
  FROM filled),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS need
  FROM targets),
mixed AS (
  SELECT s.*, n.source_size, n.target, n.whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY u, s.doc_id) - s.size / 2 <= n.need AND n.need > 0 AS extra
  FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source),
"""

MIX = MIX.replace(' COLLATE "C"', "")

#: The rules, from a relation `docs`: a row for each document, with a number of its own.
RULES = rf"""
split AS (SELECT row_number() OVER () AS rid, *, {WORDS} AS words FROM docs),
tokens AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM split),
windows AS (
  SELECT rid, pos, CASE WHEN lead(w, 7) OVER o IS NOT NULL THEN
    w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o END AS win
  FROM tokens WINDOW o AS (PARTITION BY rid ORDER BY pos)),
starts AS (SELECT rid, pos, (win IS NOT NULL AND count(*) OVER (PARTITION BY rid, win) > 1)::INT AS hit FROM windows),
covered AS (SELECT rid, max(hit) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM starts),
repeats AS (SELECT rid, sum(c)::BIGINT AS n_repeat_words FROM covered GROUP BY rid),
stops AS (SELECT rid, count(*) AS n_stop FROM tokens WHERE lower(trim(w, '.,;:!?()"''')) IN ({_STOP}) GROUP BY rid),
counted AS (
  SELECT split.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop, 0) AS n_stop
  FROM split LEFT JOIN repeats USING (rid) LEFT JOIN stops USING (rid)),
judged AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words
         AND word_chars * 1000 // greatest(n_words, 1) BETWEEN 2000 AND 12000
         AND n_symbols * 1000 // greatest(n_words, 1) <= 200 AND n_stop * 1000 // greatest(n_words, 1) >= 20
         AND (len(lines) - len(list_distinct(lines))) * 1000 // greatest(len(lines), 1) <= 500 AS kept
  FROM counted),
"""

ORACLES = {
    "op3_suffix_trees": rf"""WITH split AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS words FROM documents),
tokens AS (SELECT rid, doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM split),
windows AS (
  SELECT rid, doc_id, pos, w, CASE WHEN lead(w, 12) OVER o IS NOT NULL THEN
    w || ' ' || {" || ' ' || ".join(f"lead(w, {k}) OVER o" for k in range(1, 13))} END AS win
  FROM tokens WINDOW o AS (PARTITION BY rid ORDER BY pos)),
starts AS (SELECT rid, pos, w, (win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id)::INT AS hit FROM windows),
covered AS (SELECT rid, pos, w, max(hit) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM starts),
kept AS (SELECT rid, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(w, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM covered GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (rid)""",
    "op2_mix_sources": f"""WITH docs AS (SELECT doc_id, text, source FROM documents), {MIX.rstrip().rstrip(",")}
SELECT doc_id, size::BIGINT AS size, source_size, target, CASE WHEN size > 0 THEN (whole + CASE WHEN extra THEN 1 ELSE 0 END) * size ELSE 0 END::BIGINT AS taken FROM mixed""",
    "op5_quality_rules": f"""WITH docs AS (SELECT doc_id, text FROM documents), {RULES.rstrip().rstrip(",")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged""",
    "op6_lattice": """WITH RECURSIVE sound AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id""",
}
