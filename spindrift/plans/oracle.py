"""DuckDB SQL for the linkage queries. All share one list of common table expressions."""

from __future__ import annotations

from spindrift.functions import words as W
from spindrift.operators.channels import EXACT_CAP, KEEP, TOP


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def fold(x: str) -> str:
    x = f"translate(coalesce({x}, ''), '{W.LATIN_FROM}', '{W.LATIN_TO}')"
    for a, b in W.LIGATURES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9_]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def sound(x: str, table) -> str:
    x = f"lower({x})"
    for a, b in table:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"list_transform([{x}], lambda z: substr(z, 1, 1) || regexp_replace(substr(z, 2), '[aeiou]', '', 'g'))[1]"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789_":
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return x


def bucket(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT % 100)"


_LONG = "map([" + _in(W.ADDRESS_WORDS) + "], [" + _in(W.ADDRESS_WORDS.values()) + "])"
_HOUSE = r"""list_distinct(list_filter(regexp_extract_all(regexp_replace(replace(lower({x}), '#', ''), '\s*([-/])\s*', '\1', 'g'), '[a-z0-9]+(?:[-/][a-z0-9]+)+'), lambda t: regexp_matches(t, '[0-9]') AND length(t) >= 3))"""
_RUNS = r"regexp_extract_all(coalesce({x}, ''), '\p{{Nd}}+')"


def digits(x: str) -> str:
    return f"list_distinct(list_filter({_RUNS.format(x=x)}, lambda t: length(t) >= 2))"


def postal(x: str) -> str:
    return f"list_distinct(list_filter({_RUNS.format(x=x)}, lambda t: length(t) IN (5, 6)))"


def house(x: str) -> str:
    return _HOUSE.format(x=x)


def long_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: length(t) > 2))"


def sounds(x: str) -> str:
    return f"list_transform(list_filter(string_split({x}, ' '), lambda t: length(t) > 2), lambda w: {sound('w', W.SOUNDS)})"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0.0 END"


_TRADE = rf"""list_transform([{clean(fold(r"regexp_replace(regexp_replace(coalesce(business_name, ''), '[‌‍​﻿]', '', 'g'), '(?i)^\s*m\s*/\s*s\.?\s+', '')"))}],
  lambda c: CASE WHEN trim(regexp_replace(c, '^.*?\b(?:d\s*b\s*a|doing business as)\b', '')) <> '' THEN regexp_replace(c, '^.*?\b(?:d\s*b\s*a|doing business as)\b', '') ELSE c END)[1]"""

_KEYS = [
    ("name_token", "nt"), ("addr_token", "adt"), ("digit_token", "dt"), ("postal_token", "pt"),
    ("name_prefix", "CASE WHEN length(prefix) >= 3 THEN [prefix] ELSE [] END"), ("name_full", "CASE WHEN name_norm <> '' THEN [name_norm] ELSE [] END"),
    ("name_sorted", "CASE WHEN sorted_norm <> '' AND sorted_norm <> name_norm THEN [sorted_norm] ELSE [] END"),
    ("name_phon", "CASE WHEN length(name_phon) >= 3 THEN [name_phon] ELSE [] END"), ("phon_token", "pk"),
]

_PRIOR = "CASE key_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.KEY_WEIGHTS.items()) + " ELSE 1.0 END"


def _hits(name: str, keys: int, budget: int) -> str:
    return f"""{name} AS (
  SELECT p.s1_id, k.entity_id AS cand_id, k.source, sum(round(p.w * 1e6)::BIGINT) / 1e6 AS score
  FROM probe p JOIN keys k ON k.source > 1 AND k.country = p.country AND k.key_type = p.key_type AND k.key_value = p.key_value
  WHERE p.rank <= {keys} AND (p.rank <= 3 OR p.cum_df <= {budget}) GROUP BY ALL HAVING score >= 1.0)"""


def _tfidf(channel: str, field: str, pad: bool) -> str:
    cut = "list_transform(range(1, greatest(length({s}) - 1, 1)), lambda i: substr({s}, i, 3))"
    grams = f"flatten(list_transform({tokens(field)}, lambda w: {cut.format(s="(' ' || w || ' ')")}))" if pad else cut.format(s=field)
    return f"""{channel}_terms AS (SELECT source, entity_id, country, gram, count(*) AS tf FROM (SELECT source, entity_id, country, unnest({grams}) AS gram FROM forms) GROUP BY ALL),
{channel}_idf AS (
  SELECT t.country, gram, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM {channel}_terms t JOIN sizes USING (country)
  WHERE source > 1 GROUP BY t.country, gram, n HAVING count(*) >= 2 AND count(*) <= 0.02::DOUBLE * n),
{channel}_w AS (SELECT source, entity_id, country, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)), 9) AS w FROM (
  SELECT t.*, (1.0 + ln(tf)) * idf AS w FROM {channel}_terms t JOIN {channel}_idf USING (country, gram))),
{channel}_q AS (SELECT * FROM {channel}_w WHERE source = 1 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY w DESC, gram) <= {KEEP[channel]}),
{channel} AS (SELECT q, t, cos, row_number() OVER (PARTITION BY q ORDER BY cos DESC, t)::INT AS rank FROM (
  SELECT q.entity_id AS q, t.entity_id AS t, round(sum(q.w * t.w), 6) AS cos FROM {channel}_q q JOIN {channel}_w t ON t.source > 1 AND q.country = t.country AND q.gram = t.gram GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY cos DESC, t) <= {TOP[channel]})"""


_EXACT = [("name", "[name]"), ("sorted", "[sorted]"), ("phon", "[phonc]"), ("house", "house"), ("postal", "postal")]



def _expf(name: str, scores: str) -> str:
    """The choice by expected F0.5, by running sums."""
    return f"""{name}_able AS (SELECT *, row_number() OVER o AS m, sum(prob) OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id DESC ROWS UNBOUNDED PRECEDING) AS run, sum(prob) OVER (PARTITION BY s1_id) / 0.9 AS total,
  CASE WHEN max(prob) OVER (PARTITION BY s1_id) >= 1 THEN 0 ELSE exp(sum(CASE WHEN prob < 1 THEN ln(1 - prob) END) OVER (PARTITION BY s1_id)) END AS none
  FROM {scores} WHERE prob >= 0.05 WINDOW o AS (PARTITION BY s1_id ORDER BY prob DESC, cand_id DESC)),
{name}_best AS (SELECT s1_id, CASE WHEN max(1.25 * run / (0.25 * total + m)) > any_value(none) THEN arg_min(m, (-(1.25 * run / (0.25 * total + m)), m)) ELSE 0 END AS best FROM {name}_able GROUP BY s1_id),
{name} AS (SELECT s1_id, cand_id, prob FROM {name}_able JOIN {name}_best USING (s1_id) WHERE m <= best)"""


def _lcs(a: str, b: str) -> str:
    """The longest common subsequence: a row of bits, one a letter of the shorter string, in two words of 120, advanced by each letter of the longer."""
    x, y = f"CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END"
    return f"list_transform([{{'x': {x}, 'y': {y}}}], lambda s: {_steps('s.x', _letters('s.x', 's.y'))})[1]"


def _bits(x: str, low: int) -> str:
    return f"list_reduce(list_transform(string_split({x}, ''), lambda d, i: CASE WHEN d = c AND i > {low} AND i <= {low + 120} THEN 1::HUGEINT << (i - {low + 1})::HUGEINT ELSE 0::HUGEINT END), lambda m, n: m | n)"


def _letters(x: str, y: str) -> str:
    """For each letter of y the places in x that hold it."""
    return f"list_transform(string_split({y}, ''), lambda c: {{'l': {_bits(x, 0)}, 'h': {_bits(x, 120)}}})"


def _steps(x: str, letters: str) -> str:
    full = lambda n: f"((1::HUGEINT << ({n})::HUGEINT) - 1::HUGEINT)"
    low, high = f"least(length({x}), 120)", f"greatest(length({x}) - 120, 0)"
    one, two = full(low), full(high)
    carry = f"((r.l + (r.l & m.l)) >> ({low})::HUGEINT)"
    step = f"lambda r, m: {{'l': ((r.l + (r.l & m.l)) & {one}) | (r.l - (r.l & m.l)), 'h': ((r.h + (r.h & m.h) + {carry}) & {two}) | (r.h - (r.h & m.h))}}"
    return f"CASE WHEN {x} = '' THEN 0 ELSE list_transform([list_reduce({letters}, {step}, {{'l': {one}, 'h': {two}}})], lambda r: length({x}) - bit_count(r.l) - bit_count(r.h))[1] END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {_lcs(a, b)} / (length({a}) + length({b})) END"


def token_sort(a: str, b: str) -> str:
    ordered = lambda x: f"array_to_string(list_sort({tokens(x)}), ' ')"
    return f"list_transform([{{'a': {ordered(a)}, 'b': {ordered(b)}}}], lambda o: {ratio('o.a', 'o.b')})[1]"


def token_set(a: str, b: str) -> str:
    some, rest = "array_to_string(list_sort(z.s), ' ')", lambda k: f"array_to_string(list_sort(list_filter(z.{k}, lambda w: NOT list_contains(z.s, w))), ' ')"
    whole = lambda k: f"trim({some} || ' ' || {rest(k)})"
    best = f"greatest({ratio('v.a', 'v.b')}, CASE WHEN v.s = '' THEN 0.0 ELSE {ratio('v.s', 'v.a')} END, CASE WHEN v.s = '' THEN 0.0 ELSE {ratio('v.s', 'v.b')} END)"
    return f"""list_transform([{{'a': list_distinct({tokens(a)}), 'b': list_distinct({tokens(b)}), 's': list_intersect(list_distinct({tokens(a)}), list_distinct({tokens(b)}))}}], lambda z:
  CASE WHEN len(z.a) = 0 OR len(z.b) = 0 THEN 0.0 WHEN len(z.s) > 0 AND (len(z.s) = len(z.a) OR len(z.s) = len(z.b)) THEN 100.0
  ELSE list_transform([{{'s': {some}, 'a': {whole('a')}, 'b': {whole('b')}}}], lambda v: {best})[1] END)[1]"""


def partial(a: str, b: str) -> str:
    """All windows of the longer string that are as long as the shorter, and all shorter ones at its two ends; both ways if they are of one length."""
    back = lambda x: f"reverse({x})"
    window = f"list_max(list_transform(range(1, length(w.y) - length(w.x) + 2), lambda k: {_steps('w.x', 'w.m[k:k + length(w.x) - 1]')}))"
    ends = lambda x, m: f"list_max(list_transform(range(1, length(w.x)), lambda k: 200.0 * ({_steps(x, f'{m}[1:k]')}) / (length(w.x) + k)))"
    one = lambda x, y: f"list_transform([{{'x': {x}, 'y': {y}, 'z': {back(x)}, 'm': {_letters(x, y)}, 'n': {_letters(back(x), back(y))}}}], lambda w: greatest(100.0 * {window} / length(w.x), coalesce({ends('w.x', 'w.m')}, 0.0), coalesce({ends('w.z', 'w.n')}, 0.0)))[1]"
    x, y = f"CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END"
    return f"""list_transform([{{'x': {x}, 'y': {y}}}], lambda s: CASE WHEN s.x = '' THEN CASE WHEN s.y = '' THEN 100.0 ELSE 0.0 END WHEN contains(s.y, s.x) THEN 100.0
  WHEN length(s.x) = length(s.y) THEN greatest({one('s.x', 's.y')}, {one('s.y', 's.x')}) ELSE {one('s.x', 's.y')} END)[1]"""


CTES = f"""
rec AS (SELECT 1 + doc_id % 3 AS source, 'S' || (1 + doc_id % 3) || '-' || lpad(doc_id::VARCHAR, 8, '0') AS entity_id, substr(text, 1, 80) AS business_name,
  CASE WHEN length(text) > 120 THEN substr(text, length(text) - 119) ELSE text END AS business_address, lang AS country FROM documents),
norm AS (SELECT *, array_to_string(list_filter({tokens(clean(fold("business_name")))}, lambda t: t NOT IN ({_in(W.LEGAL)})), ' ') AS name_norm,
  array_to_string(list_transform({tokens(clean(fold("business_address")))}, lambda t: coalesce({_LONG}[t], t)), ' ') AS addr_norm FROM rec),
normal AS (SELECT *, {long_tokens("name_norm")} AS nt, {long_tokens("addr_norm")} AS adt, {digits("business_address")} AS dt, {postal("business_address")} AS pt,
  substr(replace(name_norm, ' ', ''), 1, 4) AS prefix, array_to_string(list_sort({tokens("name_norm")}), ' ') AS sorted_norm,
  array_to_string(list_sort({sounds("name_norm")}), '') AS name_phon, list_distinct(list_filter({sounds("name_norm")}, lambda t: length(t) >= 3)) AS pk FROM norm),
form0 AS (SELECT *, array_to_string(list_filter({tokens(_TRADE)}, lambda t: t NOT IN ({_in([*W.LEGAL, *W.NAME_NOISE])})), ' ') AS name,
  array_to_string(list_concat(list_transform(list_filter({tokens(clean(fold("business_address")))}, lambda t: t NOT IN ({_in(W.ADDRESS_NOISE)})), lambda t: coalesce({_LONG}[t], t)),
    list_transform(list_sort({house(fold("business_address"))}), lambda h: 'h' || regexp_replace(h, '[-/]', 'x', 'g'))), ' ') AS addr,
  {house(fold("business_address"))} AS house, {postal("business_address")} AS postal FROM rec),
forms AS (SELECT *, replace(phon, ' ', '') AS phonc FROM (SELECT *, array_to_string(list_sort({tokens("name")}), ' ') AS sorted,
  array_to_string(list_filter(list_transform({tokens("name")}, lambda w: {sound("w", W.SOUNDS_SOFT)}), lambda t: t <> '' AND t NOT IN ({_in(W.LEGAL_KEYS)})), ' ') AS phon FROM form0)),
universe AS (SELECT entity_id AS s1_id, country FROM rec WHERE source = 1),
truth AS (SELECT a.s1_id, r.entity_id AS cand_id FROM (SELECT text, lang, 'S1-' || lpad(min(doc_id)::VARCHAR, 8, '0') AS s1_id FROM documents WHERE doc_id % 3 = 0 GROUP BY text, lang) a
  JOIN documents d ON a.text = d.text AND a.lang = d.lang AND d.doc_id % 3 > 0 JOIN rec r ON r.entity_id = 'S' || (1 + d.doc_id % 3) || '-' || lpad(d.doc_id::VARCHAR, 8, '0')),
keys AS ({" UNION ALL ".join(f"SELECT source, entity_id, country, '{k}' AS key_type, unnest({v}) AS key_value FROM normal" for k, v in _KEYS)}),
freq AS (SELECT country, key_type, key_value, count(*) AS df FROM keys WHERE source > 1 GROUP BY ALL),
probe AS (SELECT s1_id, country, key_type, key_value, {_PRIOR} * (ln(greatest(2, (SELECT count(*) FROM rec WHERE source > 1))::DOUBLE) - ln(df::DOUBLE)) AS w, rank, cum_df FROM (
  SELECT k.entity_id AS s1_id, k.country, key_type, key_value, df, row_number() OVER o AS rank, sum(df) OVER (PARTITION BY k.entity_id ORDER BY df, key_type, key_value ROWS UNBOUNDED PRECEDING) AS cum_df
  FROM keys k JOIN freq f USING (country, key_type, key_value) WHERE k.source = 1 AND df <= 25000 WINDOW o AS (PARTITION BY k.entity_id ORDER BY df, key_type, key_value)) WHERE rank <= 25 AND w > 0),
{_hits("cheap", 10, 2500)},
{_hits("dear", 25, 20000)},
candidates AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM cheap QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) <= 25),
starved AS (SELECT s1_id FROM universe LEFT JOIN (SELECT s1_id, count(*) AS n FROM cheap GROUP BY 1) USING (s1_id) WHERE coalesce(n, 0) < 8),
again AS (SELECT * FROM dear WHERE s1_id IN (SELECT s1_id FROM starved)),
tier AS (SELECT * FROM cheap WHERE s1_id NOT IN (SELECT s1_id FROM again) UNION ALL SELECT * FROM again),
sizes AS (SELECT country, count(*) AS n FROM rec WHERE source > 1 GROUP BY 1),
{_tfidf("c2", "name", True)},
{_tfidf("c2b", "phonc", False)},
{_tfidf("c3", "addr", True)},
exact_keys AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(f"SELECT source, entity_id, country, '{k}' AS field, unnest({v}) AS key FROM forms" for k, v in _EXACT)}) WHERE length(key) >= 3),
c4 AS (SELECT q.entity_id AS q, t.entity_id AS t, count(DISTINCT q.field)::INT AS c4 FROM exact_keys q JOIN exact_keys t ON t.source > 1 AND q.country = t.country AND q.field = t.field AND q.key = t.key
  JOIN (SELECT country, field, key FROM exact_keys WHERE source > 1 GROUP BY ALL HAVING count(*) <= {EXACT_CAP}) r ON r.country = q.country AND r.field = q.field AND r.key = q.key WHERE q.source = 1 GROUP BY ALL),
evidence AS (SELECT q, t, 'c2' AS channel, cos AS score, rank FROM c2 UNION ALL SELECT q, t, 'c2b', cos, rank FROM c2b UNION ALL SELECT q, t, 'c3', cos, rank FROM c3 UNION ALL SELECT q, t, 'c4', c4, 0 FROM c4),
joined AS (SELECT q, t, {", ".join(f"coalesce(max(score) FILTER (WHERE channel = '{c}'), 0)::DOUBLE AS {c}_cos, coalesce(max(rank) FILTER (WHERE channel = '{c}'), 0)::DOUBLE AS {c}_rank" for c in ("c2", "c2b", "c3"))},
  coalesce(max(score) FILTER (WHERE channel = 'c4'), 0)::DOUBLE AS c4, 0.0::DOUBLE AS c1_score, 0.0::DOUBLE AS c1_rank, count(DISTINCT channel)::DOUBLE AS n_channels FROM evidence GROUP BY q, t),
c1 AS (SELECT s1_id AS q, cand_id AS t, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM cheap QUALIFY rank <= 100),
joined_keys AS (SELECT q, t, {", ".join(f"coalesce(max(score) FILTER (WHERE channel = '{c}'), 0)::DOUBLE AS {c}_cos, coalesce(max(rank) FILTER (WHERE channel = '{c}'), 0)::DOUBLE AS {c}_rank" for c in ("c2", "c2b", "c3"))},
  coalesce(max(score) FILTER (WHERE channel = 'c4'), 0)::DOUBLE AS c4, coalesce(max(score) FILTER (WHERE channel = 'c1'), 0)::DOUBLE AS c1_score, coalesce(max(rank) FILTER (WHERE channel = 'c1'), 0)::DOUBLE AS c1_rank,
  count(DISTINCT channel)::DOUBLE AS n_channels FROM (SELECT * FROM evidence UNION ALL SELECT q, t, 'c1', score, rank FROM c1) GROUP BY q, t),
feats AS (SELECT c.s1_id, c.cand_id, c.score AS blocking_score, c.source::DOUBLE AS cand_source, {jaccard("a.nt", "b.nt")} AS name_jaccard, {overlap("a.nt", "b.nt")} AS name_overlap,
  (a.prefix <> '' AND a.prefix = b.prefix)::INT::DOUBLE AS name_prefix, (a.name_norm <> '' AND a.name_norm = b.name_norm)::INT::DOUBLE AS name_exact,
  CASE WHEN greatest(length(a.name_norm), length(b.name_norm)) > 0 THEN least(length(a.name_norm), length(b.name_norm)) / greatest(length(a.name_norm), length(b.name_norm)) ELSE 0.0 END AS len_ratio,
  {jaccard("a.adt", "b.adt")} AS addr_jaccard, {overlap("a.adt", "b.adt")} AS addr_overlap, {jaccard("a.dt", "b.dt")} AS digit_jaccard,
  (a.addr_norm = '')::INT::DOUBLE AS s1_addr_empty, (b.addr_norm = '')::INT::DOUBLE AS cand_addr_empty, (a.sorted_norm <> '' AND a.sorted_norm = b.sorted_norm)::INT::DOUBLE AS sorted_exact,
  (a.name_phon <> '' AND a.name_phon = b.name_phon)::INT::DOUBLE AS phon_exact, {jaccard("a.pk", "b.pk")} AS phon_jaccard, (len(list_intersect(a.pt, b.pt)) > 0)::INT::DOUBLE AS postal_exact,
  len(list_intersect(a.nt, b.nt))::DOUBLE AS shared_name, len(list_intersect(a.adt, b.adt))::DOUBLE AS shared_addr
  FROM candidates c JOIN normal a ON a.entity_id = c.s1_id JOIN normal b ON b.entity_id = c.cand_id),
scores AS (SELECT s1_id, cand_id, round(1 / (1 + exp(-(-4.0 + blocking_score * 0.15 + name_jaccard * 2.0 + addr_jaccard * 2.0 + name_exact * 3.0 + phon_exact * 1.0))), 5) AS prob FROM feats),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id DESC) AS rn FROM scores),
thresh AS (SELECT s1_id, cand_id, prob FROM ranked WHERE prob >= 0.5 AND rn <= 4),
fallback AS (SELECT s1_id, cand_id, prob FROM ranked WHERE (prob >= 0.6 AND rn <= 5) OR (rn = 1 AND prob < 0.6 AND prob >= 0.05)),
owned_first AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) = 1),
{_expf("expf", "scores")},
{_expf("applied", "owned_first")},
owned AS (SELECT * FROM fallback QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) = 1),
disputed AS (SELECT cand_id, count(*) AS n FROM fallback GROUP BY 1 HAVING count(*) > 1),
conflicted AS (SELECT DISTINCT s1_id FROM (SELECT s1_id FROM fallback WHERE cand_id IN (SELECT cand_id FROM disputed) UNION ALL SELECT s1_id FROM universe WHERE s1_id NOT IN (SELECT s1_id FROM fallback))),
lists AS (SELECT u.s1_id, coalesce(string_agg(cand_id, ',' ORDER BY rank, cand_id), '') AS ids FROM universe u LEFT JOIN candidates c USING (s1_id) GROUP BY 1)
"""


def _entity(predicted: str) -> str:
    return f"""per AS (SELECT u.s1_id, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM universe u
  LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS n_pred FROM {predicted} GROUP BY 1) USING (s1_id)
  LEFT JOIN (SELECT s1_id, count(*) AS tp FROM truth JOIN {predicted} USING (s1_id, cand_id) GROUP BY 1) USING (s1_id))"""


_F = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"


def _sql(final: str, *more: str) -> str:
    return "WITH " + ", ".join([CTES.strip(), *more]) + "\n" + final


def _lists(name: str, pairs: str, where: str) -> str:
    return f"{name} AS (SELECT u.s1_id, coalesce(string_agg(cand_id, ',' ORDER BY -prob, cand_id), '') AS ids FROM universe u LEFT JOIN {pairs} p USING (s1_id) WHERE {where} GROUP BY 1)"


def _round(names: str) -> str:
    return ", ".join(f"round({x}, 6) AS {x}" for x in names.split())


_TOKEN_FEATURES = "blocking_score cand_source name_jaccard name_overlap name_prefix name_exact len_ratio addr_jaccard addr_overlap digit_jaccard s1_addr_empty cand_addr_empty sorted_exact phon_exact phon_jaccard postal_exact shared_name shared_addr"
_FUZZY_NAMES = ("name_ratio", "name_token_sort", "name_token_set", "name_partial", "addr_ratio")
_GRID = " UNION ALL ".join(
    f"SELECT '{t}' AS thr, '{n}' AS top_n, '{e}' AS exclusive, round(avg({_F}), 6) AS f05, coalesce(round(avg(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END) FILTER (WHERE n_true > 0 OR n_pred > 0), 6), 0.0) AS precision, coalesce(round(avg(CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END) FILTER (WHERE n_true > 0 OR n_pred > 0), 6), 0.0) AS recall FROM (SELECT u.s1_id, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM universe u LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1) USING (s1_id) LEFT JOIN (SELECT p.s1_id, count(*) AS n_pred, count(t.s1_id) AS tp FROM (SELECT s1_id, cand_id, prob FROM ranked WHERE prob >= {t} AND rn <= {n or 1000} {'QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) = 1' if e else ''}) p LEFT JOIN truth t USING (s1_id, cand_id) GROUP BY 1) USING (s1_id))"
    for t in (0.3, 0.5, 0.8)
    for n in (None, 2)
    for e in (False, True)
)
_REACH = "EXISTS (FROM truth t JOIN scores s USING (s1_id, cand_id) WHERE t.s1_id = per.s1_id)"
_B = bucket("s1_id")
_WORDS = lambda p, f: f"list_filter(list_distinct({tokens(f'{p}.{f}')}), lambda w: list_contains(kn.{f}, w))"
_W = lambda f: (f"qw_{f}", f"tw_{f}")
_KNOWN = f"known AS (SELECT country, list_distinct(flatten(list({tokens('name')}))) AS name, list_distinct(flatten(list({tokens('addr')}))) AS addr FROM forms WHERE source > 1 GROUP BY 1)"


def _worded(pairs: str, q: str, t: str) -> str:
    return f"worded AS (SELECT c.{q} AS q, c.{t} AS t, {_WORDS('a', 'name')} AS qw_name, {_WORDS('b', 'name')} AS tw_name, {_WORDS('a', 'addr')} AS qw_addr, {_WORDS('b', 'addr')} AS tw_addr FROM {pairs} c JOIN forms a ON a.entity_id = c.{q} JOIN forms b ON b.entity_id = c.{t} JOIN known kn ON kn.country = a.country)"


_WORDED = ", ".join(f"{jaccard(*_W(f))} AS {f}_word_jac, {overlap(*_W(f))} AS {f}_word_ovl, len(list_intersect({', '.join(_W(f))}))::DOUBLE AS n_{f}_words" for f in ("name", "addr"))
_WORD_FEATURES = "name_word_jac name_word_ovl n_name_words addr_word_jac addr_word_ovl n_addr_words"
_PAIR_FEATURES = f"r_name r_name_tsort r_name_tset r_name_part r_phon r_addr r_addr_tset {_WORD_FEATURES} len_ratio cand_source name_exact sorted_exact phon_exact house_match postal_match s1_addr_empty cand_addr_empty c2_cos c2_rank c2b_cos c2b_rank c3_cos c3_rank c4_keys c1_score c1_rank n_channels"
_NAMES, _ADDRS = ("a.name_norm", "b.name_norm"), ("a.addr_norm", "b.addr_norm")
_KEY_FUZZY = f"""round({ratio(*_NAMES)} / 100, 6) AS name_ratio, round({token_sort(*_NAMES)} / 100, 6) AS name_token_sort, round({token_set(*_NAMES)} / 100, 6) AS name_token_set,
  round({partial(*_NAMES)} / 100, 6) AS name_partial, CASE WHEN a.addr_norm = '' AND b.addr_norm = '' THEN 0.0 ELSE round({ratio(*_ADDRS)} / 100, 6) END AS addr_ratio"""
_FUZZY = f"fuzzy AS (SELECT c.s1_id, c.cand_id, {_KEY_FUZZY} FROM candidates c JOIN normal a ON a.entity_id = c.s1_id JOIN normal b ON b.entity_id = c.cand_id)"
_PAIRS = (
    _KNOWN, _worded("joined", "q", "t"), f"words AS (SELECT q, t, {_WORDED} FROM worded)",
    f"""pairs AS (SELECT j.q, j.t, {ratio('a.name', 'b.name')} AS r_name, {token_sort('a.name', 'b.name')} AS r_name_tsort, {token_set('a.name', 'b.name')} AS r_name_tset, {partial('a.name', 'b.name')} AS r_name_part,
  {token_set('a.phon', 'b.phon')} AS r_phon, {ratio('a.addr', 'b.addr')} AS r_addr, {token_set('a.addr', 'b.addr')} AS r_addr_tset,
  w.* EXCLUDE (q, t), CASE WHEN greatest(length(a.name), length(b.name)) > 0 THEN least(length(a.name), length(b.name)) / greatest(length(a.name), length(b.name)) ELSE 0.0 END AS len_ratio, b.source::DOUBLE AS cand_source,
  (a.name <> '' AND a.name = b.name)::INT::DOUBLE AS name_exact, (a.sorted <> '' AND a.sorted = b.sorted)::INT::DOUBLE AS sorted_exact, (a.phonc <> '' AND a.phonc = b.phonc)::INT::DOUBLE AS phon_exact,
  (len(list_intersect(a.house, b.house)) > 0)::INT::DOUBLE AS house_match, (len(list_intersect(a.postal, b.postal)) > 0)::INT::DOUBLE AS postal_match, (a.addr = '')::INT::DOUBLE AS s1_addr_empty, (b.addr = '')::INT::DOUBLE AS cand_addr_empty,
  c2_cos, c2_rank, c2b_cos, c2b_rank, c3_cos, c3_rank, j.c4 AS c4_keys, c1_score, c1_rank, n_channels
  FROM joined j JOIN forms a ON a.entity_id = j.q JOIN forms b ON b.entity_id = j.t JOIN words w ON w.q = j.q AND w.t = j.t)""",
)
_LINE = f"s1_id || CASE WHEN {_B} = 1 THEN ' ' ELSE chr(9) END || CASE {_B} WHEN 3 THEN 'S9-x,' WHEN 4 THEN 'S1-00000003,' WHEN 6 THEN 'S2-1,S2-1,' ELSE '' END || ids"
_FOUND = {
    "comma_instead_of_tab": "SELECT '' AS x WHERE false", "header": "SELECT '' AS x WHERE false", "not_utf8": "SELECT '' AS x WHERE false",
    "row_without_tab": "SELECT line AS x FROM lines WHERE NOT contains(line, chr(9))", "duplicate_row": "SELECT s1_id AS x FROM rows_ GROUP BY 1 HAVING count(*) > 1",
    "repeated_id": "SELECT DISTINCT s1_id AS x FROM (SELECT s1_id FROM members GROUP BY s1_id, cand_id HAVING count(*) > 1)", "self_match": "SELECT cand_id AS x FROM members WHERE cand_id LIKE 'S1-%'",
    "bad_prefix": "SELECT cand_id AS x FROM members WHERE NOT regexp_matches(cand_id, '^S[123]-')", "missing_row": "SELECT s1_id AS x FROM universe WHERE s1_id NOT IN (SELECT s1_id FROM rows_)",
    "unexpected_row": "SELECT s1_id AS x FROM rows_ WHERE s1_id NOT IN (SELECT s1_id FROM universe)",
    "unknown_id": "SELECT cand_id AS x FROM members WHERE regexp_matches(cand_id, '^S[23]-') AND cand_id NOT IN (SELECT entity_id FROM rec WHERE source > 1)",
    "not_a_candidate": "SELECT s1_id AS x FROM members m WHERE NOT EXISTS (FROM candidates c WHERE c.rank <= 2 AND c.s1_id = m.s1_id AND c.cand_id = m.cand_id)",
}

ORACLES = {
    "normalize_name": _sql("SELECT n.entity_id, n.name_norm, f.name AS trade_name, f.sorted AS sorted_name FROM normal n JOIN forms f USING (entity_id)"),
    "normalize_addr": _sql("SELECT n.entity_id, n.addr_norm, f.addr AS full_addr FROM norm n JOIN forms f USING (entity_id)"),
    "digit_postal_house_tokens": f"SELECT doc_id, array_to_string(list_sort({digits('text')}), ' ') AS digits, array_to_string(list_sort({postal('text')}), ' ') AS postal, array_to_string(list_sort({house(fold('text'))}), ' ') AS house FROM documents",
    "phonetic_key": _sql("SELECT n.entity_id, name_phon, array_to_string(list_sort(pk), ' ') AS phon_tokens, prefix, phon, phonc FROM normal n JOIN forms f USING (entity_id)"),
    "stable_bucket_split": _sql(f"SELECT s1_id, {_B}::INT AS bucket, CASE WHEN {_B} < 15 THEN 'val' ELSE 'fit' END AS part FROM universe"),
    "normalize_any_script": _sql("SELECT n.entity_id, n.name_norm, f.name AS trade_name, f.sorted AS sorted_name FROM normal n JOIN forms f USING (entity_id)"),
    "entity_split": _sql(f"SELECT s1_id, part FROM (SELECT s1_id, CASE WHEN {_B} < 15 THEN 'val' ELSE 'fit' END AS part FROM universe) QUALIFY row_number() OVER (PARTITION BY part ORDER BY md5(s1_id), s1_id) <= CASE part WHEN 'val' THEN 40 ELSE 100 END"),
    "labelled_pairs": _sql("SELECT c.s1_id, c.cand_id, (t.s1_id IS NOT NULL)::INT::DOUBLE AS label FROM candidates c LEFT JOIN truth t USING (s1_id, cand_id)"),
    "channel_union_keys": _sql("SELECT * FROM joined_keys"),
    "apply_rule": _sql("SELECT * FROM mine", _lists("mine", "applied", "true")),
    "patch_candidate_rows": _sql(
        "SELECT l.s1_id, coalesce(w.ids, l.ids) AS ids, w.ids IS NOT NULL AS replaced FROM lists l LEFT JOIN wide w USING (s1_id)",
        """wide AS (SELECT c.s1_id, coalesce(string_agg(k.cand_id, ',' ORDER BY k.score DESC, k.cand_id), '') AS ids FROM conflicted c
  LEFT JOIN (SELECT * FROM cheap QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) <= 40) k USING (s1_id) GROUP BY 1)""",
    ),
    "patch_changes": _sql(
        """SELECT count(*) FILTER (WHERE a <> b) AS changed, coalesce(sum(len(list_filter(a, lambda x: NOT list_contains(b, x)))), 0)::BIGINT AS removed,
  coalesce(sum(len(list_filter(b, lambda x: NOT list_contains(a, x)))), 0)::BIGINT AS added, count(*) FILTER (WHERE len(a) = 0 AND len(b) > 0) AS filled
FROM (SELECT coalesce(o.ids, []) AS a, coalesce(n.ids, []) AS b FROM conflicted c LEFT JOIN (SELECT s1_id, list_sort(list(cand_id)) AS ids FROM fallback GROUP BY 1) o USING (s1_id) LEFT JOIN (SELECT s1_id, list_sort(list(cand_id)) AS ids FROM anew GROUP BY 1) n USING (s1_id))""",
        """anew AS (SELECT * FROM scores WHERE s1_id IN (SELECT s1_id FROM conflicted) AND prob >= 0.3 AND cand_id NOT IN (SELECT cand_id FROM fallback WHERE s1_id NOT IN (SELECT s1_id FROM conflicted))
  QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) = 1)""",
    ),
    "hybrid_report": _sql(f"SELECT country, CASE WHEN {_B} < 40 THEN 'new' WHEN {_B} >= 50 THEN 'old' ELSE 'missing' END AS origin, count(*) AS n FROM universe GROUP BY ALL"),
    "records_from_files": _sql("SELECT source::INT AS source, entity_id, business_name, business_address, country FROM rec"),
    "pairs_from_files": _sql(f"SELECT s1_id, cand_id FROM candidates WHERE {_B} < 70"),
    "scores_from_files": _sql(f"SELECT s1_id, cand_id, prob, {_B} < 70 AS known FROM scores WHERE prob >= 0.05"),
    "score_dump": _sql("SELECT s1_id, cand_id, printf('%.5f', prob) AS prob FROM scores WHERE prob >= 0.05"),
    "blocking_keys": _sql("SELECT source::INT AS source, entity_id, country, key_type, key_value FROM keys"),
    "key_freq": _sql("SELECT * FROM freq"),
    "pruned_keys": _sql("SELECT k.source::INT AS source, k.key_type, count(*) AS n FROM keys k LEFT JOIN freq f USING (country, key_type, key_value) WHERE k.source = 1 OR df <= 25000 GROUP BY ALL"),
    "probe_table": _sql("SELECT s1_id, country, key_type, key_value, round(w, 6) AS w, rank::INT AS rank, cum_df::BIGINT AS cum_df FROM probe"),
    "candidates_cheap": _sql("SELECT s1_id, cand_id, source::INT AS source, score, rank::INT AS rank FROM candidates"),
    "candidates_escalated": _sql("SELECT s1_id, cand_id, source::INT AS source, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id)::INT AS rank FROM tier QUALIFY rank <= 25"),
    "candidate_lists": _sql("SELECT * FROM lists"),
    "exact_channel": _sql("SELECT * FROM c4"),
    "tfidf_name_topk": _sql("SELECT * FROM c2"),
    "tfidf_phon_topk": _sql("SELECT * FROM c2b"),
    "tfidf_addr_topk": _sql("SELECT * FROM c3"),
    "channel_union": _sql("SELECT * FROM joined"),
    "token_features": _sql(f"SELECT s1_id, cand_id, {_round(_TOKEN_FEATURES)} FROM feats"),
    "word_features": _sql(f"SELECT q, t, {_round(_WORD_FEATURES)} FROM (SELECT q, t, {_WORDED} FROM worded)", _KNOWN, _worded("candidates", "s1_id", "cand_id")),
    "fuzzy_features": _sql("SELECT * FROM fuzzy", _FUZZY),
    "key_features": _sql(f"SELECT s1_id, cand_id, {_round(_TOKEN_FEATURES)}, {', '.join(f'u.{x}' for x in _FUZZY_NAMES)} FROM feats JOIN fuzzy u USING (s1_id, cand_id)", _FUZZY),
    "pair_features": _sql(f"SELECT q, t, {_round(_PAIR_FEATURES)} FROM pairs", *_PAIRS),
    "context_base": _sql(
        """SELECT s1_id AS q, cand_id AS t, round(prob, 6) AS p1, rank::INT AS p1_rank, round(CASE WHEN top > 0 THEN prob / top ELSE 0.0 END, 6) AS p1_ratio, round(CASE WHEN rank = 1 THEN prob - coalesce(second, 0) ELSE prob - top END, 6) AS p1_gap, n AS n_cands, likely::BIGINT AS n_likely, round(total, 6) AS p1_sum
FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS rank, max(prob) OVER e AS top, nth_value(prob, 2) OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, count(*) OVER e AS n, sum((prob > 0.5)::INT) OVER e AS likely, sum(prob) OVER e AS total FROM scores WINDOW e AS (PARTITION BY s1_id))"""
    ),
    "context_extra": _sql(
        """SELECT q, t, round(p1, 6) AS p1, cand_source, round(r_addr_tset, 6) AS r_addr_tset, round(r_name_tset, 6) AS r_name_tset, round(addr_word_ovl, 6) AS addr_word_ovl, round(r_phon, 6) AS r_phon, row_number() OVER (PARTITION BY q, cand_source ORDER BY p1 DESC, t)::INT AS src_rank,
sum((p1 >= top - 0.1)::INT) OVER (PARTITION BY q)::BIGINT AS amb_count, round(max(r_addr_tset) OVER (PARTITION BY q) - r_addr_tset, 6) AS addr_tset_gap, row_number() OVER (PARTITION BY q ORDER BY r_addr_tset DESC, t)::INT AS addr_tset_rank,
round(max(r_name_tset) OVER (PARTITION BY q) - r_name_tset, 6) AS name_tset_gap, row_number() OVER (PARTITION BY q ORDER BY r_name_tset DESC, t)::INT AS name_tset_rank,
round(max(addr_word_ovl) OVER (PARTITION BY q) - addr_word_ovl, 6) AS addr_ovl_gap, round(max(r_phon) OVER (PARTITION BY q) - r_phon, 6) AS phon_gap
FROM (SELECT *, max(p1) OVER (PARTITION BY q) AS top FROM scored)""",
        *_PAIRS, "scored AS (SELECT *, round(1 / (1 + exp(-(-6.0 + r_name_tset * 0.02 + r_addr_tset * 0.03 + name_word_jac * 2.0 + addr_word_jac * 2.0 + c4_keys * 0.5 + n_channels * 0.25))), 5) AS p1 FROM pairs)",
    ),
    "decide_thresh": _sql("SELECT * FROM thresh"),
    "decide_fallback": _sql("SELECT * FROM fallback"),
    "decide_expf": _sql("SELECT * FROM expf"),
    "exclusive_decision": _sql("SELECT * FROM owned"),
    "exclusive_candidate": _sql("SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id DESC) AS rn FROM owned_first) WHERE (prob >= 0.6 AND rn <= 5) OR (rn = 1 AND prob < 0.6 AND prob >= 0.05)"),
    "macro_f05": _sql(
        f"SELECT round(avg({_F}), 6) AS f05, coalesce(round(avg(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END) FILTER (WHERE n_true > 0 OR n_pred > 0), 6), 0.0) AS precision, coalesce(round(avg(CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END) FILTER (WHERE n_true > 0 OR n_pred > 0), 6), 0.0) AS recall, count(*) AS n FROM per",
        _entity("thresh"),
    ),
    "rule_grid": _sql(_GRID),
    "diagnose_empties": _sql(
        f"SELECT count(*) AS n, count(*) FILTER (WHERE n_pred = 0) AS empty, count(*) FILTER (WHERE n_pred = 0 AND n_true = 0) AS singleton, count(*) FILTER (WHERE n_pred = 0 AND n_true > 0 AND {_REACH}) AS recoverable, count(*) FILTER (WHERE n_pred = 0 AND n_true > 0 AND NOT {_REACH}) AS never_scored FROM per",
        _entity("thresh"),
    ),
    "retrieval_report": _sql(
        "SELECT round(coalesce(sum(tp) / nullif(sum(n_true), 0), 0.0), 6) AS pair_recall, round(coalesce(count(*) FILTER (WHERE n_true > 0 AND tp = n_true) / nullif(count(*) FILTER (WHERE n_true > 0), 0), 0.0), 6) AS all_found, round(coalesce(count(*) FILTER (WHERE n_true > 0 AND tp = 0) / nullif(count(*) FILTER (WHERE n_true > 0), 0), 0.0), 6) AS none_found, round(avg(n_pred), 6) AS mean, round(quantile_cont(n_pred, 0.5), 6) AS median, round(quantile_cont(n_pred, 0.9), 6) AS p90, round(quantile_cont(n_pred, 0.99), 6) AS p99, max(n_pred)::BIGINT AS most FROM per",
        _entity("candidates"),
    ),
    "blocking_report": _sql(
        "SELECT round(coalesce(sum(tp) / nullif(sum(n_true), 0), 0.0), 6) AS pair_recall, round(coalesce(count(*) FILTER (WHERE n_true > 0 AND tp = n_true) / nullif(count(*) FILTER (WHERE n_true > 0), 0), 0.0), 6) AS full_recall, round(avg(n_pred), 6) AS mean, count(*) FILTER (WHERE n_pred = 0) AS empty, (list_sort(list(n_pred)))[1 + floor(count(*) * 0.95)::INT]::BIGINT AS p95 FROM per",
        _entity("candidates"),
    ),
    "leave_one_out": _sql(
        "SELECT country, count(*) AS pairs, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("c2", "c2b", "c3", "c4")) + ", round(avg(greatest(c2, c2b, c3, c4)), 6) AS union, "
        + ", ".join(f"round(avg(greatest({', '.join(d for d in ('c2', 'c2b', 'c3', 'c4') if d != c)})), 6) AS without_{c}" for c in ("c2", "c2b", "c3", "c4")) + " FROM hit GROUP BY 1",
        "hit AS (SELECT country, coalesce((c2_rank > 0)::INT, 0) AS c2, coalesce((c2b_rank > 0)::INT, 0) AS c2b, coalesce((c3_rank > 0)::INT, 0) AS c3, coalesce((j.c4 > 0)::INT, 0) AS c4 FROM truth tr JOIN universe u USING (s1_id) LEFT JOIN joined j ON j.q = tr.s1_id AND j.t = tr.cand_id)",
    ),
    "conflict_count": _sql("SELECT count(*) AS targets, coalesce(sum(n - 1), 0)::BIGINT AS excess, coalesce(max(n), 0)::BIGINT AS most, (SELECT count(DISTINCT s1_id) FROM fallback WHERE cand_id IN (SELECT cand_id FROM disputed)) AS entities FROM disputed"),
    "conflicted_entities": _sql("SELECT s1_id FROM conflicted"),
    "hybrid_merge": _sql(
        "SELECT u.s1_id, u.country, coalesce(n.ids, o.ids) AS ids, CASE WHEN n.ids IS NOT NULL THEN 'new' WHEN o.ids IS NOT NULL THEN 'old' ELSE 'missing' END AS origin FROM universe u LEFT JOIN new_rows n USING (s1_id) LEFT JOIN old_rows o USING (s1_id)",
        _lists("new_rows", "thresh", bucket("u.s1_id") + " < 50"), _lists("old_rows", "fallback", bucket("u.s1_id") + " >= 25"),
    ),
    "merge_shards": _sql(
        f"SELECT 'missing' AS \"check\", count(*) FILTER (WHERE {_B} >= 90) AS n FROM universe UNION ALL SELECT 'duplicate', count(*) FILTER (WHERE {_B} BETWEEN 50 AND 59) FROM universe UNION ALL SELECT 'extra', 0"
    ),
    "patch_results": _sql(
        """SELECT s1_id, cand_id, 'old' AS origin FROM kept_old UNION ALL SELECT s1_id, cand_id, 'new' FROM (
SELECT * FROM scores WHERE s1_id IN (SELECT s1_id FROM conflicted) AND cand_id NOT IN (SELECT cand_id FROM kept_old) AND prob >= 0.3 QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) = 1)""",
        "kept_old AS (SELECT s1_id, cand_id FROM fallback WHERE s1_id NOT IN (SELECT s1_id FROM conflicted))",
    ),
    "validate_rules": _sql(
        " UNION ALL ".join(f"SELECT '{k}' AS rule, '{'warning' if k == 'not_a_candidate' else 'error'}' AS severity, count(x) AS n, array_to_string((list_sort(list_distinct(list(x))))[1:5], ', ') AS example FROM ({v})" for k, v in _FOUND.items()),
        _lists("mine", "thresh", "true"), f"lines AS (SELECT unnest(CASE WHEN {_B} = 2 THEN [{_LINE}, {_LINE}] ELSE [{_LINE}] END) AS line FROM mine WHERE {_B} <> 5)",
        "rows_ AS (SELECT split_part(line, chr(9), 1) AS s1_id, split_part(line, chr(9), 2) AS ids FROM lines WHERE contains(line, chr(9)))", "members AS (SELECT s1_id, trim(unnest(string_split(trim(ids), ','))) AS cand_id FROM rows_ WHERE ids <> '')",
    ),
}
