"""DuckDB SQL for the registered queries, written from the definitions, not from the plans."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import address, text

ORACLE_SQL: dict[str, str] = {}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words: Iterable[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"


def subs(x: str, pairs: Iterable[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = sub(x, rf"\b{old}\b", new)
    return x


def toks(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda t: t <> '')"


def squeezed(x: str) -> str:
    return rf"trim({sub(x, chr(92) + 's+', ' ')})"


RAW = """raw AS (
  SELECT 'P' || p_partkey AS id, ['s1', 's2', 's3'][p_partkey % 3 + 1] AS source, p_brand AS country, p_name || ' ' || p_type AS name,
         p_size || ' ' || p_type || ' street, ' || p_brand || ' tx' AS address, p_partkey AS ord FROM part)"""
DOCS = rf"""words AS (SELECT doc_id, lang, {toks("text")} AS w FROM documents), raw AS (
  SELECT 'D' || doc_id AS id, ['s1', 's2', 's3'][doc_id % 3 + 1] AS source, lang AS country, array_to_string(w[1:5], ' ') AS name,
         array_to_string(w[6:12], ' ') AS address, doc_id AS ord FROM words)"""

# Decomposed, a letter with a mark is the letter and a mark, which is no letter; what follows sees a blank.
MARKED = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || ' ' ELSE c END), '')"
FOLDED = "regexp_replace(lower(strip_accents({0})), '[^\\x00-\\x7F]', '', 'g')"


def normal_name(x: str) -> str:
    y = f"lower({MARKED.format(x)})"
    y = sub(sub(y, "&", " and "), "@", " at ")
    y = sub(sub(y, r"[^\pL\pN_\s\-]", " "), r"\s*-\s*", " ")
    return squeezed(subs(y, text.LEGAL))


def normal_address(x: str) -> str:
    y = f"lower({x})"
    y = sub(sub(y, "[,;]+", " , "), r"#\s*", "ste ")
    y = sub(y, r"[^\pL\pN_\s\-,]", " ")
    return squeezed(sub(subs(y, (*address.STREETS, *address.DIRECTIONS)), r"\s*,\s*", ", "))


def informative(x: str) -> str:
    return f"list_filter({toks(x)}, lambda t: length(t) >= 3 AND NOT list_contains({listed(text.STOP_BLOCKING)}, t))"


def longest(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: length(t) = list_max(list_transform({tokens}, lambda u: length(u))))[1]"


def plain(x: str) -> str:
    return f"list_filter({toks(sub(f'lower({x})', '[^a-zA-Z0-9' + chr(92) + 's]', ' '))}, lambda t: length(t) >= 2)"


def without(tokens: str, words: Iterable[str]) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({listed(words)}, t))"


def large(x: str) -> str:
    folded = FOLDED.format(x)
    every = f"list_filter({toks(sub(sub(folded, chr(92) + '.(com|org|net|in|co|io|fr)' + chr(92) + 'b', ''), '[^a-z0-9' + chr(92) + 's]', ' '))}, lambda t: length(t) >= 2)"
    kept = without(every, text.STOP_LARGE)
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {every} END"


def first_group(x: str, pattern: str, groups: int) -> str:
    parts = ", ".join(f"nullif(regexp_extract({x}, {quoted(pattern)}, {g}), '')" for g in range(1, groups + 1))
    return f"lower(trim(coalesce({parts}, '')))"


def shingle(x: str) -> str:
    return f"array_to_string({without(plain(x), text.CORPORATE)}[1:2], '_')"


def joined(tokens: str) -> str:
    return f"array_to_string({tokens}, ' ')"


def over(cte: str, value: str) -> str:
    return f"WITH {cte} SELECT id, {value} AS value FROM raw"


def canonical(x: str) -> str:
    return squeezed(subs(x, ((a.replace(" ", r"\s+"), b) for a, b in text.CANONICAL)))


ORACLE_SQL |= {
    "normalize_name": over(DOCS, normal_name("name")),
    "normalize_address": over(RAW, normal_address("address")),
    "clean_whitespace": over(DOCS, squeezed("name")),
    "ascii_fold": over(DOCS, FOLDED.format("name")),
    "informative_tokens": over(DOCS, joined(informative("lower(name)"))),
    "longest_token": over(DOCS, longest(informative("lower(name)"))),
    "clean_tokens_large": over(DOCS, joined(large("name"))),
    "clean_tokens_plain": over(DOCS, joined(plain("name"))),
    "clean_tokens_rerank": over(DOCS, joined(without(plain("name"), text.STOP_RERANK))),
    "canonical_name": over(RAW, canonical("lower(name) || ' technologies private  limited'")),
    "name_shingle": over(DOCS, shingle("name")),
    "address_number": over(RAW, r"nullif(regexp_extract(lower(address), '\b(\d+[a-z]?)\b', 1), '')"),
    "house_number_large": over(RAW, first_group("lower(address)", address.HOUSE_LARGE, 2)),
    "house_number_rerank": over(RAW, first_group("('Plot No. ' || address)", address.HOUSE_RERANK, 3)),
    "postal_code": over(RAW, r"regexp_extract(address || ' ' || lpad(ord::VARCHAR, 6, '7'), '\b([0-9]{5,6})\b', 1)"),
    "region_lookup": over(RAW, "CASE " + " ".join(f"WHEN contains(lower(name || ' ' || address), {quoted(a)}) THEN {quoted(b)}" for a, b in address.REGIONS_US) + " ELSE '' END"),
    "transliterate": over(RAW, "'ram hotel ' || name"),
    "record_scan": f"WITH {RAW} SELECT source, country, count(*) AS n FROM raw GROUP BY ALL",
    "country_whitelist": f"WITH {RAW} SELECT id, country FROM raw WHERE country IN ('Brand#12', 'Brand#3', 'Brand#25')",
    "token_subset": f"WITH {RAW} SELECT id, list_has_all({plain('address')}, {plain('name')}) AS inside, list_has_all(string_split(name || ' ' || country, ' '), string_split(country, ' ')) AS country_inside FROM raw",
}

POSTAL = rf"\b({address.POSTAL})\b"


def parsed(source: str, a: str) -> str:
    """CTEs up to parts(id, house_number, ...) from rows of source with an address a."""
    states = rf"\b({'|'.join(address.STATES)})\b"
    return rf"""cut AS (
  SELECT id, trim({a}) AS a, regexp_replace(trim({a}), {quoted(POSTAL)}, '') AS rest,
         list_filter(list_transform(string_split(trim({a}), ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM {source}
), st AS (
  SELECT *, lower(list_last(regexp_extract_all(rest, {quoted("(?i)" + states)}, 1))) AS state FROM cut
), parts AS (
  SELECT id, nullif(lower(regexp_extract(rest, '^\s*(\d+[a-zA-Z]?)\b', 1)), '') AS house_number,
         nullif(lower(regexp_extract(rest, '(?i)\b(?:ste|suite|apt|apartment|unit|bldg|building|fl|floor|#)\s*([a-z0-9\-]+)\b', 1)), '') AS unit,
         CASE WHEN len(parts) >= 2 THEN parts[1] WHEN a <> '' THEN trim(rest) END AS street,
         CASE WHEN len(parts) >= 2 THEN coalesce(nullif(array_to_string(list_filter({toks("parts[2]")}, lambda t: NOT regexp_matches(t, {quoted("^(?:" + address.POSTAL + ")" + chr(92) + "b")}) AND (state IS NULL OR lower(t) <> state)), ' '), ''), parts[2]) END AS city,
         state, nullif(replace(lower(regexp_extract(a, {quoted(POSTAL)}, 1)), ' ', ''), '') AS postal_code FROM st
)"""


ORACLE_SQL["parse_address"] = rf"""WITH {RAW}, rows AS (SELECT id, lower(address) || ' ' || lpad(ord::VARCHAR, 5, '7') AS addr FROM raw), {parsed("rows", "addr")}
SELECT id, house_number, unit, street, city, state, postal_code FROM parts"""

PROC = rf"""{RAW}, norm AS (
  SELECT id, source, country, ord, {normal_name("name")} AS name, {normal_address("address")} AS address FROM raw
), {parsed("norm", "address")}, proc AS (
  SELECT n.*, p.* EXCLUDE (id), {informative("n.name")} AS info FROM norm n JOIN parts p USING (id)
)"""

KEYS = {
    "pass_a": "SELECT id, source, ord, [house_number, coalesce(nullif(postal_code, ''), state)] AS key, 0 AS pos FROM proc WHERE house_number <> '' AND coalesce(nullif(postal_code, ''), state) <> ''",
    "pass_b": "SELECT id, source, ord, [city, x.t] AS key, x.p AS pos FROM (SELECT *, unnest(list_transform(list_distinct(info[1:3]), lambda t: {'t': t, 'p': list_position(info, t) - 1})) AS x FROM proc WHERE city <> '')",
    "pass_c": "SELECT id, source, ord, [city, name[1:3]] AS key, 0 AS pos FROM proc WHERE city <> '' AND length(name) >= 3",
    "pass_d": f"SELECT id, source, ord, [{longest('info')}] AS key, 0 AS pos FROM proc WHERE length({longest('info')}) >= 4",
}
LIMIT = {"pass_d": 200}


def passed(name: str) -> str:
    keep = f"WHERE NOT list_contains((SELECT coalesce(list(key), []) FROM (SELECT key FROM k_{name} WHERE source <> 's1' GROUP BY key HAVING count(*) > {LIMIT[name]})), t.key)" if name in LIMIT else ""
    return f"""k_{name} AS ({KEYS[name]}), {name} AS (
  SELECT a.id AS s1_id, t.id AS target_id, t.source AS target_source, t.ord AS target_ord, min(a.pos) AS pos, '{name}' AS pass
  FROM k_{name} a JOIN k_{name} t ON a.key = t.key AND a.source = 's1' AND t.source <> 's1' {keep} GROUP BY ALL)"""


for _name in KEYS:
    ORACLE_SQL[f"block_{_name}"] = f"WITH {PROC}, {passed(_name)} SELECT s1_id, target_id, target_source FROM {_name}"

PAIRS = f"""{PROC}, {", ".join(map(passed, KEYS))}, every AS ({" UNION ALL ".join(f"SELECT * FROM {n}" for n in KEYS)}), multi AS (
  SELECT s1_id, target_id, target_source, target_ord, list_sort(list_distinct(list(pass))) AS passes, min({{'p': pass, 'q': pos}}) AS f FROM every GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY len(passes) DESC, f, target_ord) AS r FROM multi
), pairs AS (SELECT * FROM ranked WHERE r <= 10)"""
TRUTH = """truth AS (
  SELECT a.id AS s1_id, coalesce(list_sort(list(t.id) FILTER (t.id IS NOT NULL)), []) AS truth
  FROM raw a LEFT JOIN raw t ON t.source <> 's1' AND a.country = t.country AND a.name = t.name WHERE a.source = 's1' GROUP BY a.id)"""

ORACLE_SQL |= {
    "block_multipass": f"WITH {PAIRS} SELECT s1_id, target_id, target_source, array_to_string(passes, ',') AS passes FROM multi",
    "block_capped": f"WITH {PAIRS} SELECT s1_id, target_id, target_source, array_to_string(passes, ',') AS passes FROM pairs",
    "block_stats": f"""WITH {PAIRS}, {TRUTH}, c AS (
  SELECT s1_id, truth, coalesce(cand, []) AS cand FROM truth LEFT JOIN (SELECT s1_id, list(target_id) AS cand FROM pairs GROUP BY s1_id) USING (s1_id))
SELECT round(CASE WHEN sum(len(truth)) = 0 THEN 1.0 ELSE sum(len(list_intersect(truth, cand))) / sum(len(truth)) END, 6) AS candidate_recall, round(avg(len(cand)), 6) AS avg_candidates_per_s1,
  round(quantile_cont(len(cand), 0.5), 6) AS median_candidates, round(quantile_cont(len(cand), 0.9), 6) AS p90_candidates, round(quantile_cont(len(cand), 0.99), 6) AS p99_candidates, max(len(cand)) AS max_candidates FROM c""",
}


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns, by the table's rows."""
    codes = lambda x: f"list_transform(string_split({x}, ''), lambda c: [unicode(c)])"
    cell = f"CASE WHEN unicode({b}[j[1]:j[1]]) = ch[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], cur[len(cur)]) END"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda i: [i::INT]), lambda cur, j: list_append(cur, {cell}), [0])"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE list_last(list_reduce({codes(a)}, lambda prev, ch: {row}, list_transform(range(0, length({b}) + 1), lambda i: 0))) END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({lcs(a, b)}) / (length({a}) + length({b})) END"


def sets_of(rows: str, a: str, b: str, out: str) -> str:
    """CTEs that add, for each row, the kernels of tokens of columns a and b as sort_<out> and set_<out>."""
    return f"""{out}1 AS (
  SELECT *, array_to_string(list_sort({toks(a)}), ' ') AS {out}_x, array_to_string(list_sort({toks(b)}), ' ') AS {out}_y,
    list_sort(list_distinct({toks(a)})) AS {out}_p, list_sort(list_distinct({toks(b)})) AS {out}_q FROM {rows}
), {out}2 AS (
  SELECT *, length(array_to_string(list_sort(list_intersect({out}_p, {out}_q)), ' ')) AS {out}_s, array_to_string(list_filter({out}_p, lambda t: NOT list_contains({out}_q, t)), ' ') AS {out}_u,
    array_to_string(list_filter({out}_q, lambda t: NOT list_contains({out}_p, t)), ' ') AS {out}_v FROM {out}1
), {out}3 AS (
  SELECT *, {ratio(out + "_x", out + "_y")} AS sort_{out}, ({out}_s > 0)::INT AS {out}_g, length({out}_u) AS {out}_lu, length({out}_v) AS {out}_lv, {lcs(out + "_u", out + "_v")} AS {out}_l FROM {out}2
), {out} AS (
  SELECT *, CASE WHEN len({out}_p) = 0 OR len({out}_q) = 0 THEN 0.0::DOUBLE WHEN {out}_s > 0 AND ({out}_lu = 0 OR {out}_lv = 0) THEN 100.0::DOUBLE
    ELSE greatest(100 * (1 - ({out}_lu + {out}_lv - 2 * {out}_l)::DOUBLE / (2 * ({out}_s + {out}_g) + {out}_lu + {out}_lv)),
      CASE WHEN {out}_s > 0 THEN 100 * (1 - ({out}_g + {out}_lu)::DOUBLE / (2 * {out}_s + {out}_g + {out}_lu)) ELSE 0 END,
      CASE WHEN {out}_s > 0 THEN 100 * (1 - ({out}_g + {out}_lv)::DOUBLE / (2 * {out}_s + {out}_g + {out}_lv)) ELSE 0 END) END AS set_{out} FROM {out}3
)"""


NAME_PAIRS = f"""{DOCS}, named AS (SELECT id, source, country, {FOLDED.format("name")} AS name FROM raw WHERE name <> ''),
tok AS (SELECT id, source, country, name, unnest(list_distinct({toks("name")})) AS w FROM named),
rare AS (SELECT country, w FROM tok GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12),
np AS (SELECT DISTINCT a.id AS id1, b.id AS id2, a.name AS name1, b.name AS name2 FROM tok a JOIN tok b USING (country, w) JOIN rare USING (country, w) WHERE a.source = 's1' AND b.source <> 's1')"""


def jaccard(a: str, b: str, both: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {both} ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def chars(x: str) -> str:
    return f"list_filter(list_distinct(string_split({x}, '')), lambda c: c <> '')"


def kernel(value: str, more: str = "", rows: str = "np") -> str:
    return f"WITH {NAME_PAIRS}{more} SELECT id1, id2, round({value}, 6) AS value FROM {rows}"


ORACLE_SQL |= {
    "sim_levenshtein": kernel("1 - levenshtein(name1, name2)::DOUBLE / greatest(length(name1), length(name2))"),
    "sim_jaro_winkler": kernel("jaro_winkler_similarity(name1, name2)"),
    "sim_ratio": kernel(ratio("name1", "name2")),
    "sim_token_sort": kernel("sort_k", ", " + sets_of("np", "name1", "name2", "k"), "k"),
    "sim_token_set": kernel("set_k", ", " + sets_of("np", "name1", "name2", "k"), "k"),
    "sim_token_jaccard": kernel(jaccard(toks("name1"), toks("name2"), "1.0")),
    "sim_charset": kernel(f"len(list_intersect({chars('name1')}, {chars('name2')}))::DOUBLE / greatest(length(name1), length(name2), 1)"),
}

FEATURES = f"""{PAIRS}, joined AS (
  SELECT p.s1_id, p.target_id, p.target_source, p.passes, a.name AS n1, t.name AS n2, a.address AS a1, t.address AS a2, {", ".join(f"a.{c} AS {c}1, t.{c} AS {c}2" for c in ("house_number", "postal_code", "city", "state", "unit"))}
  FROM pairs p JOIN proc a ON p.s1_id = a.id JOIN proc t ON p.target_id = t.id
), {sets_of("joined", "n1", "n2", "nk")}, {sets_of("nk", "a1", "a2", "ak")}, feat AS (
  SELECT s1_id, target_id, target_source, (n1 <> '' AND n1 = n2)::INT::DOUBLE AS name_exact_match, jaro_winkler_similarity(n1, n2) AS name_jaro_winkler, 1 - levenshtein(n1, n2)::DOUBLE / greatest(length(n1), length(n2)) AS name_levenshtein,
    sort_nk / 100 AS name_token_sort_ratio, set_nk / 100 AS name_token_set_ratio, {jaccard("nk_p", "nk_q", "1.0")} AS name_token_jaccard, len(list_intersect(nk_p, nk_q))::DOUBLE AS name_shared_tokens,
    abs(length(n1) - length(n2))::DOUBLE AS name_len_diff, least(length(n1), length(n2))::DOUBLE / greatest(length(n1), length(n2)) AS name_len_ratio, (length(n1) >= 4 AND length(n2) >= 4 AND n1[1:4] = n2[1:4])::INT::DOUBLE AS name_prefix_match,
    (a1 <> '' AND a1 = a2)::INT::DOUBLE AS addr_exact_match, sort_ak / 100 AS addr_token_sort_ratio, set_ak / 100 AS addr_token_set_ratio, {jaccard("ak_p", "ak_q", "1.0")} AS addr_token_jaccard,
    {", ".join(f"coalesce({c}1 <> '' AND {c}2 <> '' AND {c}1 = {c}2, false)::INT::DOUBLE AS {n}_match, coalesce({c}1 <> '' AND {c}2 <> '' AND {c}1 <> {c}2, false)::INT::DOUBLE AS {n}_conflict" for c, n in (("house_number", "house_num"), ("postal_code", "postal"), ("city", "city"), ("state", "state"), ("unit", "unit")))},
    {", ".join(f"((coalesce({c}1, '') <> '') <> (coalesce({c}2, '') <> ''))::INT::DOUBLE AS missing_{n}_asymm" for c, n in (("house_number", "house"), ("postal_code", "postal"), ("city", "city")))},
    len(passes)::DOUBLE AS blocking_pass_count, {", ".join(f"list_contains(passes, 'pass_{p}')::INT::DOUBLE AS has_pass_{p}" for p in "abcd")}, (target_source = 's2')::INT::DOUBLE AS target_is_s2, (target_source = 's3')::INT::DOUBLE AS target_is_s3 FROM ak
), scored AS (
  SELECT *, greatest(0, least(1, 0.6::DOUBLE * name_token_sort_ratio + 0.4::DOUBLE * addr_token_sort_ratio - 0.5::DOUBLE * house_num_conflict - 0.3::DOUBLE * city_conflict)) AS score FROM feat
)"""


def rounded(columns: Iterable[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def decided(where: str, name: str = "decided") -> str:
    return f"""{name} AS (
  SELECT a.id AS s1_id, coalesce(m.ids, []) AS predicted FROM raw a LEFT JOIN (SELECT s1_id, list_sort(list(target_id)) AS ids FROM scored WHERE {where} GROUP BY s1_id) m ON a.id = m.s1_id WHERE a.source = 's1')"""


AT_75 = decided("score >= 0.75 AND house_num_conflict <> 1")
ENTITY = """sizes AS (
  SELECT *, len(list_intersect(truth, predicted)) AS tp, len(predicted) - len(list_intersect(truth, predicted)) AS fp, len(truth) - len(list_intersect(truth, predicted)) AS fn FROM bt
), entity AS (
  SELECT *, CASE WHEN len(truth) = 0 AND len(predicted) = 0 THEN 1.0 WHEN len(truth) = 0 OR len(predicted) = 0 THEN 0.0 ELSE tp::DOUBLE / len(predicted) END AS precision,
    CASE WHEN len(truth) = 0 THEN 1.0 WHEN len(predicted) = 0 THEN 0.0 ELSE tp::DOUBLE / len(truth) END AS recall FROM sizes
), scores AS (
  SELECT *, CASE WHEN len(truth) = 0 AND len(predicted) = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25::DOUBLE * precision * recall / (0.25::DOUBLE * precision + recall) END AS f FROM entity
)"""
METRICS = """round(avg(f), 6) AS entity_macro_f05, round(avg(precision), 6) AS entity_macro_precision, round(avg(recall), 6) AS entity_macro_recall,
  round(CASE WHEN sum(tp + fp) > 0 THEN sum(tp) / sum(tp + fp) ELSE 0 END, 6) AS pair_precision, round(CASE WHEN sum(tp + fn) > 0 THEN sum(tp) / sum(tp + fn) ELSE 0 END, 6) AS pair_recall,
  round(CASE WHEN count(*) FILTER (len(truth) = 0) = 0 THEN 1.0 ELSE count(*) FILTER (len(truth) = 0 AND len(predicted) = 0)::DOUBLE / count(*) FILTER (len(truth) = 0) END, 6) AS singleton_accuracy,
  round(avg((fp = 0 AND fn = 0)::INT), 6) AS exact_set_accuracy, round(sum(fp) * 100.0::DOUBLE / count(*), 6) AS false_merges_per_100_s1, round(sum(fn) * 100.0::DOUBLE / count(*), 6) AS missed_matches_per_100_s1,
  count(*) AS total_entities, count(*) FILTER (len(truth) = 0) AS total_singletons, sum(tp + fn)::BIGINT AS total_true_pairs, sum(tp + fp)::BIGINT AS total_pred_pairs"""
BASE_COLUMNS = (
    "name_exact_match name_jaro_winkler name_levenshtein name_token_sort_ratio name_token_set_ratio name_token_jaccard name_shared_tokens name_len_diff name_len_ratio name_prefix_match addr_exact_match addr_token_sort_ratio addr_token_set_ratio addr_token_jaccard "
    "house_num_match house_num_conflict postal_match postal_conflict city_match city_conflict state_match state_conflict unit_match unit_conflict missing_house_asymm missing_postal_asymm missing_city_asymm blocking_pass_count has_pass_a has_pass_b has_pass_c has_pass_d target_is_s2 target_is_s3"
).split()
SWEEP = f"""{FEATURES}, {TRUTH}, taus AS (SELECT round(0.50 + 0.02 * i, 4)::DOUBLE AS threshold FROM range(0, 25) t(i)), bt AS (
  SELECT x.threshold, t.s1_id, t.truth, coalesce(list(s.target_id) FILTER (s.target_id IS NOT NULL), []) AS predicted FROM truth t CROSS JOIN taus x
  LEFT JOIN scored s ON s.s1_id = t.s1_id AND s.score >= x.threshold AND s.house_num_conflict <> 1 GROUP BY ALL
), {ENTITY}, sweep AS (SELECT threshold, {METRICS} FROM scores GROUP BY threshold)"""


def errors(where: str, minus: str, more: str, category: str = "") -> str:
    a, b = minus.split(" - ")
    return f"""WITH {FEATURES}, {TRUTH}, {decided(where)}, gone AS (
  SELECT d.s1_id, unnest(list_filter({a}, lambda x: NOT list_contains({b}, x))) AS target_id FROM decided d JOIN truth t USING (s1_id))
SELECT g.s1_id, g.target_id, {category}s.score IS NOT NULL AS was_candidate, round(s.score, 6) AS model_score FROM gone g LEFT JOIN scored s USING (s1_id, target_id) {more}"""


CATEGORY = """CASE WHEN a.name <> '' AND b.name <> '' AND (contains(a.name, b.name) OR contains(b.name, a.name)) THEN CASE WHEN a.address <> b.address THEN 'same_name_diff_address_or_branch' ELSE 'other' END
  WHEN a.address <> '' AND a.address = b.address THEN 'address_collision_diff_business' WHEN s.house_num_conflict = 1 THEN 'house_number_conflict' WHEN s.city_conflict = 1 THEN 'city_conflict' ELSE 'other' END AS category, """

ORACLE_SQL |= {
    "pair_features_base": f"WITH {FEATURES} SELECT s1_id, target_id, {rounded(BASE_COLUMNS)} FROM scored",
    "baseline_score": f"WITH {FEATURES} SELECT s1_id, target_id, round(score, 6) AS score FROM scored",
    "decide_entities": f"WITH {FEATURES}, {AT_75} SELECT s1_id, array_to_string(predicted, ',') AS matched_ids FROM decided",
    "per_source_threshold": f"WITH {FEATURES}, {decided("score >= CASE target_source WHEN 's2' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END")} SELECT s1_id, array_to_string(predicted, ',') AS matched_ids FROM decided",
    "match_cardinality": f"""WITH {FEATURES}, {AT_75} SELECT count(*) AS total_rows, count(*) FILTER (len(predicted) = 0) AS singleton, count(*) FILTER (len(predicted) = 1) AS single_match,
  count(*) FILTER (len(predicted) > 1) AS multi_match, sum(len(predicted))::BIGINT AS total_matches, max(len(predicted)) AS max_matches FROM decided""",
    "run_coverage": f"WITH {FEATURES}, {AT_75} SELECT round(avg((len(predicted) > 0)::INT) * 100, 6) AS coverage_pct, round(avg((len(predicted) = 0)::INT) * 100, 6) AS singleton_pct FROM decided",
    "fbeta_entity": f"WITH {FEATURES}, {TRUTH}, {AT_75}, bt AS (SELECT * FROM truth JOIN decided USING (s1_id)), {ENTITY} SELECT s1_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f, fp, fn, tp FROM scores",
    "eval_dashboard": f"WITH {FEATURES}, {TRUTH}, {AT_75}, bt AS (SELECT * FROM truth JOIN decided USING (s1_id)), {ENTITY} SELECT {METRICS} FROM scores",
    "threshold_sweep": f"WITH {SWEEP} SELECT * FROM sweep",
    "best_threshold": f"WITH {SWEEP} SELECT threshold, entity_macro_f05 FROM sweep ORDER BY entity_macro_f05 DESC, threshold LIMIT 1",
    "false_merges": errors("score >= 0.6 AND house_num_conflict <> 1", "predicted - truth", "JOIN proc a ON a.id = g.s1_id JOIN proc b ON b.id = g.target_id", CATEGORY),
    "missed_matches": errors("score >= 0.75 AND house_num_conflict <> 1", "truth - predicted", ""),
    "top_candidates": f"WITH {FEATURES}, r AS (SELECT s1_id, target_id, round(score, 6) AS score FROM scored), k AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS rank FROM r) SELECT * FROM k WHERE rank <= 5",
}

PREP = f"""{RAW}, low AS (SELECT id, source, country, ord, lower(name) AS n, lower(address) AS a FROM raw), prep AS (
  SELECT *, {large("n")} AS tokens, list_distinct({large("a")}) AS addr_tokens, {first_group("a", address.HOUSE_LARGE, 2)} AS house, regexp_extract(a, '\\b([0-9]{{5,6}})\\b', 1) AS postal FROM low
), post AS (
  SELECT country, x.t AS token, x.p AS pos, id AS s1_id, ord FROM (SELECT *, unnest(list_transform(tokens, lambda t, i: {{'t': t, 'p': i - 1}})) AS x FROM prep WHERE source = 's1')
), df AS (
  SELECT country, token, count(*) AS df FROM post GROUP BY ALL
), want AS (
  SELECT country, target_id, max(t) FILTER (r = 1) AS rarest, max(df) FILTER (r = 1) AS df, max(t) FILTER (r = 2) AS second FROM (
    SELECT k.country, k.id AS target_id, k.x.t AS t, df.df, row_number() OVER (PARTITION BY k.country, k.id ORDER BY df.df, k.x.p) AS r
    FROM (SELECT *, unnest(list_transform(tokens, lambda t, i: {{'t': t, 'p': i - 1}})) AS x FROM prep WHERE source <> 's1') k JOIN df ON df.country = k.country AND df.token = k.x.t) WHERE r <= 2 GROUP BY ALL
)"""
CASCADE = f"""{PREP}, whole AS (
  SELECT DISTINCT w.target_id, p.s1_id, p.ord FROM want w JOIN post p ON p.country = w.country AND p.token = w.rarest WHERE w.df <= 5
), inter AS (
  SELECT target_id, s1_id, ord FROM (SELECT DISTINCT w.target_id, p.s1_id, p.ord FROM want w JOIN post p ON p.country = w.country AND p.token = w.rarest JOIN post q ON q.country = w.country AND q.token = w.second AND q.s1_id = p.s1_id WHERE w.df > 5)
  QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY ord) <= 4
), alone AS (
  SELECT w.target_id, p.s1_id, p.ord FROM want w JOIN post p ON p.country = w.country AND p.token = w.rarest WHERE w.df > 5 AND w.target_id NOT IN (SELECT target_id FROM inter)
  QUALIFY row_number() OVER (PARTITION BY w.target_id ORDER BY p.ord) <= 3
), hits AS (
  SELECT * FROM whole UNION SELECT * FROM inter UNION SELECT * FROM alone
), rest1 AS (
  SELECT * FROM prep WHERE source <> 's1' AND id NOT IN (SELECT target_id FROM hits)
), pre AS (
  SELECT country, token[1:4] AS prefix, s1_id, ord, pos, count(*) OVER (PARTITION BY country, token[1:4]) AS n FROM post WHERE length(token) >= 4
), bypre AS (
  SELECT DISTINCT target_id, s1_id, ord FROM (SELECT r.id AS target_id, p.s1_id, p.ord FROM rest1 r JOIN pre p ON p.country = r.country AND p.prefix = r.tokens[1][1:4] AND p.n <= 40 AND length(r.tokens[1]) >= 4
  QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY p.ord, p.pos) <= 3)
), hs AS (
  SELECT *, count(*) OVER (PARTITION BY country, house) AS cnt FROM prep WHERE source = 's1' AND length(house) >= 2
), byhouse AS (
  SELECT r.id AS target_id, h.id AS s1_id, h.ord FROM rest1 r JOIN hs h ON h.country = r.country AND h.house = r.house AND h.cnt <= 20 AND list_has_any(h.addr_tokens, r.addr_tokens)
  WHERE length(r.house) >= 2 AND r.id NOT IN (SELECT target_id FROM bypre) QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY h.ord) <= 3
), cand AS (
  SELECT * FROM hits UNION ALL SELECT * FROM bypre UNION ALL SELECT * FROM byhouse
), cas AS (
  SELECT a.country, c.s1_id, c.target_id FROM cand c JOIN prep a ON a.id = c.s1_id JOIN prep t ON t.id = c.target_id
  QUALIFY row_number() OVER (PARTITION BY c.target_id ORDER BY len(list_intersect(a.tokens, t.tokens)) DESC, c.ord) <= 4
)"""
UNION = f"""{PREP}, uni AS (
  SELECT DISTINCT p.s1_id, t.id AS target_id FROM (SELECT *, count(*) OVER (PARTITION BY token) AS cnt FROM post) p JOIN (SELECT id, unnest(list_distinct(tokens)) AS token FROM prep WHERE source <> 's1') t USING (token) WHERE p.cnt <= {{most}}
  UNION
  SELECT h.id, t.id FROM (SELECT *, count(*) OVER (PARTITION BY house) AS cnt FROM prep WHERE source = 's1' AND house <> '') h JOIN prep t ON t.source <> 's1' AND t.house = h.house AND list_has_any(h.tokens, t.tokens) WHERE h.cnt <= {{most}}
)"""


def screened(pairs: str) -> str:
    """CTEs up to k2, pairs with both records and the kernels of names (nk) and addresses (ak)."""
    return f"""pr AS (
  SELECT c.s1_id, c.target_id, a.country, a.n AS n1, t.n AS n2, a.a AS a1, t.a AS a2, a.house AS h1, t.house AS h2, a.tokens AS t1, t.source AS src FROM {pairs} c JOIN prep a ON a.id = c.s1_id JOIN prep t ON t.id = c.target_id
), {sets_of("pr", "n1", "n2", "nk")}, {sets_of("nk", "a1", "a2", "ak")}"""


SCREEN = f"""{CASCADE}, {screened("cas")}, sc AS (
  SELECT *, CASE WHEN a1 <> '' AND a2 <> '' THEN set_ak / 100 ELSE 0.5 END AS addr_sim, greatest(sort_nk, set_nk) AS top,
    src <> 's2' AND len(list_filter(t1, lambda t: length(t) >= 4 AND contains(n2, t))) > 0 AND country <> 'India' AS domain, h1 <> '' AND h1 = h2 AS same_house FROM ak
), screen AS (
  SELECT s1_id, target_id, addr_sim, domain, CASE WHEN domain THEN greatest((0.4::DOUBLE * sort_nk + 0.6::DOUBLE * set_nk) / 100, 0.78::DOUBLE) ELSE (0.4::DOUBLE * sort_nk + 0.6::DOUBLE * set_nk) / 100 END AS name_sim
  FROM sc WHERE top >= 55 OR domain OR (addr_sim >= 0.75 AND top >= 30) OR (same_house AND addr_sim >= 0.55) OR addr_sim >= 0.88
)"""
ORDERS = """urgent AS (SELECT 'C' || o_custkey AS s1_id, list_sort(list('O' || o_orderkey) FILTER (o_orderpriority = '1-URGENT')) AS m, list_sort(list('O' || o_orderkey) FILTER (o_orderpriority = '2-HIGH')) AS m2, list_sort(list('O' || o_orderkey))[1:15] AS c FROM orders GROUP BY ALL),
runs AS (SELECT 'C' || c_custkey AS s1_id, coalesce(m, []) AS m, coalesce(m2, []) AS m2, coalesce(c, []) AS c FROM customer LEFT JOIN urgent u ON u.s1_id = 'C' || c_custkey)"""


def firsts(lists: str) -> str:
    """The distinct elements of a list where they come first, fifteen at most."""
    return f"list_filter({lists}, lambda x, i: list_position({lists}, x) = i)[1:15]"


ORACLE_SQL |= {
    "posting_sizes": f"WITH {PREP} SELECT * FROM df",
    "rarest_token": f"WITH {PREP} SELECT * FROM want",
    "block_cascade": f"WITH {CASCADE} SELECT * FROM cas",
    "block_union": f"WITH {UNION.replace("{most}", "60")} SELECT * FROM uni",
    "screen_large": f"WITH {SCREEN} SELECT s1_id, target_id, round(name_sim, 6) AS name_sim, round(addr_sim, 6) AS addr_sim, domain, round(0.65::DOUBLE * name_sim + 0.35::DOUBLE * addr_sim, 6) AS score FROM screen",
    "offline_screen": f"""WITH {UNION.replace("{most}", "20")}, {screened("uni")}, o AS (
  SELECT s1_id, target_id, 0.65::DOUBLE * (0.4::DOUBLE * sort_nk + 0.6::DOUBLE * set_nk) / 100 + 0.35::DOUBLE * CASE WHEN a1 <> '' AND a2 <> '' THEN set_ak / 100 ELSE 0.5 END AS score FROM ak WHERE sort_nk >= 70)
SELECT s1_id, target_id, round(score, 6) AS score, score >= 0.45 AS predicted FROM o WHERE score >= 0.70""",
    "union_runs": f"""WITH {ORDERS} SELECT s1_id, array_to_string(CASE WHEN len(m) > 0 THEN m ELSE m2 END, ',') AS matched_ids,
  array_to_string(CASE WHEN len(m) > 0 THEN {firsts("list_concat(m, c)")} WHEN len(m2) > 0 THEN {firsts("list_concat(m2, c, c)")} ELSE {firsts("list_concat(c, c)")} END, ',') AS candidate_ids,
  CASE WHEN len(m) > 0 THEN 'base' WHEN len(m2) > 0 THEN 'rescued' ELSE 'none' END AS origin FROM runs""",
    "subset_guarantee": f"WITH {ORDERS} SELECT s1_id, array_to_string(list_filter(m, lambda x: list_contains(c, x)), ',') AS matched_ids FROM runs",
    "clean_and_sort": "SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderpriority, o_orderstatus])), '|') AS ids FROM orders",
    "validate_run": """WITH o AS (SELECT 'C' || o_custkey AS s1_id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), c AS (SELECT 'C' || c_custkey AS s1_id FROM customer), v AS (
  SELECT 'duplicate_id' AS rule FROM o WHERE r > 1 UNION ALL SELECT 'invalid_target' FROM o WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'
  UNION ALL SELECT 'missing_id' FROM c WHERE s1_id NOT IN (SELECT s1_id FROM o) UNION ALL SELECT 'unexpected_id' FROM (SELECT DISTINCT s1_id FROM o) WHERE s1_id NOT IN (SELECT s1_id FROM c)) SELECT rule, count(*) AS n FROM v GROUP BY rule""",
    "event_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}

RERANK = f"""{RAW}, low AS (SELECT id, source, country, ord, lower(name) AS n, lower(address) AS a FROM raw), prep AS (
  SELECT *, {without(plain("n"), text.STOP_RERANK)} AS tokens, list_distinct({without(plain("a"), text.STOP_RERANK)}) AS addr_tokens, {first_group("a", address.HOUSE_RERANK, 3)} AS house, {shingle("n")} AS shingle FROM low
), tok AS (
  SELECT id, source, country, ord, x.t AS token, x.p AS pos FROM (SELECT *, unnest(list_transform(tokens, lambda t, i: {{'t': t, 'p': i - 1}})) AS x FROM prep)
)"""
ADDITIVE = f"""{RERANK}, sh AS (
  SELECT shingle, list(id ORDER BY ord) AS ids FROM (SELECT * FROM prep WHERE source = 's1' AND shingle <> '' QUALIFY row_number() OVER (PARTITION BY shingle ORDER BY ord) <= 3) GROUP BY shingle
), tk AS (
  SELECT token, list(id ORDER BY ord, pos) AS ids FROM (SELECT * FROM tok WHERE source = 's1' QUALIFY row_number() OVER (PARTITION BY token ORDER BY ord, pos) <= 2) GROUP BY token
), lists AS (
  SELECT t.id, list(tk.ids ORDER BY t.pos) AS ls FROM tok t JOIN tk USING (token) WHERE t.source <> 's1' GROUP BY t.id
), found AS (
  SELECT p.*, list_reduce(coalesce(ls, []), lambda acc, l: CASE WHEN len(acc) >= 5 THEN acc ELSE list_distinct(list_concat(acc, l)) END, coalesce(sh.ids, [])) AS f
  FROM prep p LEFT JOIN sh ON sh.shingle = p.shingle LEFT JOIN lists ON lists.id = p.id WHERE p.source <> 's1'
), hs AS (
  SELECT * FROM prep WHERE source = 's1' AND house <> '' QUALIFY row_number() OVER (PARTITION BY house ORDER BY ord) <= 10
), add AS (
  SELECT unnest(f) AS s1_id, id AS target_id FROM found UNION SELECT h.id, t.id FROM found t JOIN hs h ON h.house = t.house AND list_has_any(h.addr_tokens, t.addr_tokens) WHERE len(t.f) < 5 AND t.house <> ''
)"""
GATE = f"""{ADDITIVE}, pr AS (
  SELECT c.s1_id, c.target_id, a.n AS n1, t.n AS n2, a.a AS a1, t.a AS a2, a.house AS h1, t.house AS h2, a.shingle AS g1, t.shingle AS g2 FROM add c JOIN prep a ON a.id = c.s1_id JOIN prep t ON t.id = c.target_id
), {sets_of("pr", "n1", "n2", "nk")}, {sets_of("nk", "a1", "a2", "ak")}, gate AS (
  SELECT *, sort_nk AS name_sort, CASE WHEN a1 <> '' AND a2 <> '' THEN set_ak / 100 ELSE 0.5 END AS addr_sim FROM ak
)"""
RUN = f"""{SCREEN}, top AS (
  SELECT s1_id, target_id, 0.65::DOUBLE * name_sim + 0.35::DOUBLE * addr_sim AS score FROM screen
), best AS (
  SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS r FROM top QUALIFY r <= 15
), run AS (
  SELECT p.id AS s1_id, coalesce(list(b.target_id ORDER BY r) FILTER (b.score >= 0.75), []) AS m, coalesce(list(b.target_id ORDER BY r) FILTER (b.target_id IS NOT NULL), []) AS c
  FROM prep p LEFT JOIN best b ON b.s1_id = p.id WHERE p.source = 's1' GROUP BY p.id
)"""


def pruned(sides: str, keep: str) -> str:
    """The run without the matches that keep rejects, over sides s (anchor) and t (target) by id."""
    return f"""WITH {RUN}, {sides}, one AS (SELECT s1_id, x.i AS i, x.t AS target_id FROM (SELECT s1_id, unnest(list_transform(m, lambda t, i: {{'t': t, 'i': i}})) AS x FROM run)
), kept AS (SELECT o.s1_id, list(o.target_id ORDER BY i) AS k FROM one o JOIN side s ON s.id = o.s1_id JOIN side t ON t.id = o.target_id WHERE {keep} GROUP BY o.s1_id)
SELECT r.s1_id, array_to_string(coalesce(k, []), ',') AS matched_ids, array_to_string(CASE WHEN len(m) > 0 THEN {firsts("list_concat(coalesce(k, []), c)")} ELSE c[1:15] END, ',') AS candidate_ids FROM run r LEFT JOIN kept USING (s1_id)"""


REGION = "CASE " + " ".join(f"WHEN contains(lower(name), {quoted(a)}) THEN {quoted(b)}" for a, b in address.REGIONS_US) + " ELSE '' END"
SORTED = rf"array_to_string(list_sort({toks('lower(name)')}), ' ')"
NEGATIVE = f"""{RERANK}, {TRUTH}, tt AS (
  SELECT country, token, id AS target_id, ord FROM (SELECT DISTINCT country, token, id, ord FROM tok WHERE source <> 's1') QUALIFY row_number() OVER (PARTITION BY country, token ORDER BY ord, id) <= 20
), hh AS (
  SELECT country, house, id AS target_id, ord FROM prep WHERE source <> 's1' AND house <> '' QUALIFY row_number() OVER (PARTITION BY country, house ORDER BY ord, id) <= 10
), tr AS (SELECT s1_id, unnest(truth) AS target_id FROM truth), one AS (
  SELECT a.id AS s1_id, tt.target_id, min({{'p': a.pos, 'o': tt.ord}}) AS bk FROM (SELECT country, id, token, min(pos) AS pos FROM tok WHERE source = 's1' GROUP BY ALL) a JOIN tt USING (country, token)
  WHERE NOT EXISTS (SELECT 1 FROM tr t WHERE t.s1_id = a.id AND t.target_id = tt.target_id) GROUP BY a.id, tt.target_id
), four AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY bk, target_id) <= 4), two AS (
  SELECT a.id AS s1_id, hh.target_id, {{'p': 1073741824, 'o': hh.ord}} AS bk FROM prep a JOIN hh USING (country, house) WHERE a.source = 's1' AND a.house <> ''
  AND NOT EXISTS (SELECT 1 FROM tr t WHERE t.s1_id = a.id AND t.target_id = hh.target_id) AND NOT EXISTS (SELECT 1 FROM four f WHERE f.s1_id = a.id AND f.target_id = hh.target_id)
)"""

ORACLE_SQL |= {
    "block_additive": f"WITH {ADDITIVE} SELECT * FROM add",
    "gate_rerank": f"""WITH {GATE} SELECT s1_id, target_id, round(name_sort, 6) AS name_sort, round(addr_sim, 6) AS addr_sim, round(0.65::DOUBLE * name_sort / 100 + 0.35::DOUBLE * addr_sim, 6) AS score FROM gate
WHERE name_sort >= 60 OR (h1 <> '' AND h1 = h2 AND addr_sim >= 0.55) OR addr_sim >= 0.85 OR (g1 <> '' AND g1 = g2 AND name_sort >= 50)""",
    "run_large": f"WITH {RUN} SELECT s1_id, array_to_string(m, ',') AS matched_ids, array_to_string(c, ',') AS candidate_ids FROM run",
    "prune_house": pruned(f"side AS (SELECT id, {first_group('address', address.HOUSE_RERANK, 3)} AS h FROM raw)", "NOT (s.h <> '' AND t.h <> '' AND s.h <> t.h AND NOT contains(s.h, t.h) AND NOT contains(t.h, s.h))"),
    "prune_region": pruned(f"side AS (SELECT id, {REGION} AS g, {SORTED} AS w FROM raw)", f"NOT (s.g <> '' AND t.g <> '' AND s.g <> t.g AND NOT ({ratio('s.w', 't.w')} >= 92))"),
    "hard_negatives": f"WITH {NEGATIVE} SELECT s1_id, target_id FROM (SELECT s1_id, target_id, bk FROM four UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY bk, target_id) <= 6",
}
