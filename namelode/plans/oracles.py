"""The corpus and each step of the plans in SQL, for comparison with the DataFrame plans."""

from __future__ import annotations

from .fixtures import EDGES, FIRST_ADDED, GONE_LINES, LOOKUPS, NEW_LINES, QUERIES


def literal(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def digits_gone(x: str) -> str:
    for c in "0123456789-":
        x = f"replace({x}, '{c}', '')"
    return x


def judged(source: str, seq: str) -> str:
    """The names of source(seq, s) with label, tld and status."""
    return f"""SELECT *, CASE WHEN label IS NULL THEN 'no_dot' WHEN strlen(label) > 63 THEN 'label_too_long' WHEN label = '' THEN 'empty_label'
      WHEN strlen(label) >= 5 AND replace(label, substr(label, 1, 1), '') = '' THEN 'junk_repeat'
      WHEN {digits_gone("label")} = '' AND substr(label, 1, 1) BETWEEN '0' AND '9' THEN 'junk_numeric' ELSE 'ok' END AS status
    FROM (SELECT *, CASE WHEN d LIKE '%.%' THEN regexp_extract(d, '^(.*)[.]([^.]*)$', 1) END AS label, CASE WHEN d LIKE '%.%' THEN regexp_extract(d, '^(.*)[.]([^.]*)$', 2) END AS tld
      FROM (SELECT {seq}, s, regexp_replace(lower(s), '[.]$', '') AS d FROM {source}))"""


def lines(source: str, seq: str) -> str:
    return f"SELECT {seq}, trim(raw) AS s FROM {source} WHERE trim(raw) <> '' AND trim(raw) NOT LIKE '#%' AND trim(raw) LIKE '%.%' AND strlen(trim(raw)) <= 253"


RAW = f"""
base AS (SELECT p_partkey AS seq,
    CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN replace(p_name, ' ', '-') || '-' || p_partkey ELSE replace(p_name, ' ', '') || p_partkey END AS lbl,
    CASE p_partkey % 5 WHEN 0 THEN 'com' WHEN 1 THEN 'net' WHEN 2 THEN 'org' WHEN 3 THEN 'io' ELSE 'de' END AS sfx,
    CASE WHEN p_partkey % 4 >= 2 THEN p_name || ' ' || p_partkey ELSE p_name END AS toks FROM part),
raw_domains AS (SELECT seq, (CASE WHEN seq % 13 = 0 THEN '  ' ELSE '' END) || (CASE WHEN seq % 7 = 0 THEN upper(lbl || '.' || sfx) ELSE lbl || '.' || sfx END) || (CASE WHEN seq % 11 = 0 THEN '.' ELSE '' END) AS raw FROM base
  UNION ALL SELECT 1000000 + page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) FROM pages
  UNION ALL SELECT seq, raw FROM {values([(2_000_000 + i, e) for i, e in enumerate(EDGES, 1)])} AS t(seq, raw)),
scanned AS ({lines("raw_domains", "seq")}),
status AS ({judged("scanned", "seq")}),
segments AS (SELECT label, any_value(tokens) AS tokens FROM (SELECT lbl AS label, string_split(toks, ' ') AS tokens FROM base
  UNION ALL SELECT label, string_split_regex(label, '[.-]') FROM (SELECT regexp_extract(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^(.*)[.]([^.]*)$', 1) AS label FROM pages)) GROUP BY label),
docs AS (SELECT seq AS doc_seq, d AS domain_exact, label, tld, strlen(label)::INTEGER AS len, label LIKE '%-%' AS has_hyphen, coalesce(tokens, []) AS tokens FROM status LEFT JOIN segments USING (label) WHERE status = 'ok')"""
INDEX = r"""
doc_terms AS (SELECT doc_seq, list_filter(flatten(list_transform(tokens, lambda t: regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'))), lambda x: x <> '' AND strlen(x) < 40) AS terms FROM docs),
postings AS (SELECT token, doc_seq, count(*)::INTEGER AS tf, any_value(dl)::INTEGER AS dl FROM (SELECT doc_seq, len(terms) AS dl, unnest(terms) AS token FROM doc_terms) GROUP BY ALL),
term_stats AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
corpus_stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM doc_terms)"""
TOKENIZED = r"""
tokenized AS (SELECT *, len(qtokens) AS n_tokens, least(lim * CASE len(qtokens) WHEN 1 THEN 20 ELSE 50 END, CASE WHEN qtld IS NULL THEN 1000 ELSE 3000 END) AS candidate_limit
  FROM (SELECT *, list_filter(regexp_split_to_array(lower(q), '\s+'), lambda x: x <> '') AS qtokens FROM queries) WHERE len(qtokens) > 0)"""
SEARCH = f"""
queries AS (SELECT qid, q, tld::VARCHAR AS qtld, coalesce(lim, 50) AS lim, coalesce(min_match, 1) AS min_match FROM {values(QUERIES)} AS t(qid, q, tld, lim, min_match)),{TOKENIZED},
query_tokens AS (SELECT qid, unnest(qtokens) AS token FROM tokenized),
scored AS (SELECT qid, doc_seq, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM query_tokens JOIN postings USING (token) JOIN term_stats USING (token), corpus_stats GROUP BY qid, doc_seq),
candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_seq) AS r FROM scored) JOIN tokenized USING (qid) WHERE r <= candidate_limit),
counted AS (SELECT *, len(list_filter(qtokens, lambda t: list_contains(tokens, t))) AS match_count FROM candidates JOIN docs USING (doc_seq)),
matched AS (SELECT *, (match_count = n_tokens)::INTEGER AS perfect FROM counted WHERE match_count >= min_match AND (qtld IS NULL OR tld = lower(qtld))),
stopped AS (SELECT * FROM (SELECT *, coalesce(sum(perfect) OVER (PARTITION BY qid ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS perfect_before FROM matched) WHERE perfect_before < 2 * lim),
grouped AS (SELECT *, row_number() OVER (PARTITION BY qid, has_hyphen ORDER BY match_count DESC, len, score DESC, r) AS g FROM stopped),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY g, has_hyphen DESC) AS pos, count(*) OVER (PARTITION BY qid) AS total_candidates FROM grouped),
results AS (SELECT qid::INTEGER AS qid, pos, domain_exact AS domain, label, tld, len::BIGINT AS length, has_hyphen, array_to_string(tokens, ' ') AS tokens, match_count::BIGINT AS match_count, score, total_candidates FROM placed WHERE pos <= lim)"""
SYNC = f"""
own AS (SELECT doc_seq AS line_no, domain_exact AS raw FROM docs WHERE doc_seq < 1000000),
adds AS (SELECT * FROM own WHERE line_no % 10 IN (3, 4) AND line_no % 3 = 0 UNION ALL SELECT * FROM {values(NEW_LINES)}),
removes AS (SELECT * FROM own WHERE line_no % 10 = 3 UNION ALL SELECT * FROM {values(GONE_LINES)}),
add_lines AS ({lines("adds", "line_no")}), remove_lines AS ({lines("removes", "line_no")}),
judged_adds AS ({judged("add_lines", "line_no")}),
judged_removes AS ({judged("remove_lines", "line_no")}),
requests AS (SELECT d AS domain_exact FROM judged_removes WHERE status NOT IN ('no_dot', 'label_too_long', 'empty_label')),
winners AS (SELECT * FROM judged_adds WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY d ORDER BY line_no DESC) = 1),
added AS (SELECT {FIRST_ADDED} + line_no AS doc_seq, d AS domain_exact, label, tld, strlen(label)::INTEGER AS len, label LIKE '%-%' AS has_hyphen, coalesce(tokens, []) AS tokens FROM winners LEFT JOIN segments USING (label)),
removed_only AS (SELECT * FROM docs WHERE domain_exact NOT IN (SELECT domain_exact FROM requests)),
upserted AS (SELECT * FROM docs WHERE domain_exact NOT IN (SELECT domain_exact FROM added) UNION ALL SELECT * FROM added),
applied AS (SELECT * FROM removed_only WHERE domain_exact NOT IN (SELECT domain_exact FROM added) UNION ALL SELECT * FROM added)"""
LOOKUP = f"lookups AS (SELECT qid::INTEGER AS qid, regexp_replace(lower(trim(raw)), '[.]$', '') AS name FROM {values(LOOKUPS)} AS t(qid, raw))"

PART_QUERIES = f"""
queries AS (SELECT p_partkey::INTEGER AS qid, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || replace(p_name, ' ', ' ' || chr(9)) WHEN 2 THEN p_name || ' ' || p_name WHEN 3 THEN ' ' ELSE string_split(p_name, ' ')[1] END AS q,
  CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'com' ELSE '' END AS qtld, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_size END, 50)::INTEGER AS lim, coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 3 END, 1)::INTEGER AS min_match FROM part),{TOKENIZED}"""

DOC_COLUMNS = "doc_seq, domain_exact, label, tld, len, has_hyphen, array_to_string(tokens, ' ') AS tokens"


def corpus(select: str, *more: str) -> str:
    return f"WITH {', '.join([RAW, *more])}\n{select}"


def searched(select: str) -> str:
    return corpus(select, INDEX, SEARCH)


def synced(select: str) -> str:
    return corpus(select, SYNC)


def asked(select: str) -> str:
    """Over the queries that are made of parts."""
    return f"WITH {PART_QUERIES}\n{select}"
