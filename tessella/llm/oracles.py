"""DuckDB SQL with the rows of the dealt queries, where SQL can express them."""

from __future__ import annotations

from .license_scan import RULES as LICENSE_RULES
from .license_scan import SENTENCES
from .url_filter import RULES as URL_RULES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _license_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, last = "", "l"
    for name, seq in LICENSE_RULES:
        want = "," + ",,".join(seq) + ","
        steps += f", f{len(steps)} AS (SELECT * REPLACE (replace(l, '{want}', ',#,') AS l, CASE WHEN instr(l, '{want}') > 0 AND NOT list_contains(got, '{name}') THEN list_append(got, '{name}') ELSE got END AS got) FROM {last})"
        last = steps.rpartition(", f")[2].split(" ", 1)[0]
        last = "f" + last
    return f"""
WITH known(s, id) AS (VALUES {known}),
cut AS (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), {_AZ}), '[.!?;][ \\t]+|[\\r\\n]+', chr(10), 'g'), chr(10)) AS parts FROM documents),
norm AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS ss FROM cut),
m AS (SELECT map_from_entries(list({{'k': s, 'v': id}})) AS m FROM known),
ids AS (SELECT doc_id, len(ss)::BIGINT AS n_sentences, list_filter(list_transform(ss, lambda s: m.m[s]), lambda x: x IS NOT NULL) AS ids FROM norm, m),
l AS (SELECT doc_id, n_sentences, ids, ',' || array_to_string(ids, ',,') || ',' AS l, []::VARCHAR[] AS got FROM ids){steps}
SELECT doc_id, n_sentences, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS sentence_ids, array_to_string(got, ',') AS licenses,
  array_to_string(list_filter(string_split(l, ','), lambda x: x <> '' AND x <> '#'), ',') AS leftover_ids
FROM {last}"""


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT DISTINCT parts.*, rules.h, rules.p, rules.v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h) + length(p) DESC NULLS LAST, length(h) DESC) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM fits WHERE k = 1"""


_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[o : o + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS o FROM bl)),
sizes AS (SELECT DISTINCT n FROM bl),
spot AS (SELECT doc_id, n, o, array_to_string(w[o : o + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS o FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, spot.n, o FROM spot JOIN win ON spot.s = win.s AND spot.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(o, o + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


_SUBSTRINGS = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
low AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN low USING (s) WHERE doc_id > least) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
rest AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS kept FROM word WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT doc_id, unnest(qs) AS q FROM gone) g WHERE g.doc_id = word.doc_id AND g.q = word.q) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN rest USING (doc_id)"""


_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def all_sql() -> dict[str, str]:
    return {"op2_license_scan": _license_sql(), "op5_exact_topk": _TOP_K, "op6_substring_dedup": _SUBSTRINGS, "op8_url_filter": _url_sql(), "op9_decontamination": _CONTAMINATION}
