"""The same queries as DuckDB SQL, written apart from the engine: all shapes by GROUPING SETS, and rules as conditions on them."""

from __future__ import annotations

import itertools

#: A dimension: name -> [(attribute, expression)], outermost first.
FLAG = {"flag": [("l_returnflag", "l_returnflag")]}
STATUS = {"status": [("l_linestatus", "l_linestatus")]}
TIME = {"time": [("year", "strftime(l_shipdate, '%Y')"), ("month", "strftime(l_shipdate, '%m')")]}
NUMBERS = "round(sum(l_extendedprice), 2) AS revenue, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(sum(l_discount), 2) / count(*) AS mean"
SUMS = "round(sum(l_extendedprice), 2) AS revenue, count(*) AS n"


def _scrubbed(c: str) -> str:
    return f"replace(replace(replace({c}, '/', '___'), '=', '###'), ',', '+++')"


def cube(source: str, dims: dict, measures: str, where: str = "true", glob: bool = True, keys: str = "", extra: list[str] | None = None) -> str:
    """``where`` may use n (dimensions of the cell) and d_NAME (how deep a dimension is drilled down); the global cell is beyond it. ``keys``: SELECT list of further keys, named in ``extra``."""
    extra = extra or []
    names = sorted(dims)
    cols = {d: [f"{d}_{i}" for i in range(len(dims[d]))] for d in names}
    levels, has = [], []
    for d in names:
        seen = []
        for (_, expr), c in zip(dims[d], cols[d], strict=True):
            seen.append(f"({expr}) IS NOT NULL")
            levels.append(f"CASE WHEN {' AND '.join(seen)} THEN CAST(({expr}) AS VARCHAR) END AS {c}")
    sets = ["(" + ", ".join([*extra, *[c for d, k in zip(names, depth, strict=True) for c in cols[d][:k]]]) + ")" for depth in itertools.product(*[range(len(dims[d]) + 1) for d in names])]
    paths, depths = [], []
    for d in names:
        parts = " || ".join(f"CASE WHEN grouping({c}) = 0 THEN '/{a}=' || {_scrubbed(c)} ELSE '' END" for (a, _), c in zip(dims[d], cols[d], strict=True))
        paths.append(f"CASE WHEN grouping({cols[d][0]}) = 0 THEN '/{d}' || {parts} END")
        depths.append("(" + " + ".join(f"(1 - grouping({c}))" for c in cols[d]) + f") AS d_{d}")
        has += [f"(grouping({c}) = 1 OR {c} IS NOT NULL)" for c in cols[d]]
    more = "".join(f"{k}, " for k in extra)
    used = " + ".join(f"least(d_{d}, 1)" for d in names)
    return f"""
WITH src AS ({source}), lv AS (SELECT *, {keys + ', ' if keys else ''}{', '.join(levels)} FROM src),
g AS (SELECT {more}concat_ws(',', {', '.join(paths)}) AS x, {', '.join(depths)}, {measures} FROM lv GROUP BY GROUPING SETS ({', '.join(sets)}) HAVING {' AND '.join(has)}),
c AS (SELECT *, {used} AS n_dims FROM g)
SELECT CASE WHEN n_dims = 0 THEN '/G' ELSE x END AS xunit, * EXCLUDE (x, n_dims, {', '.join('d_' + d for d in names)}) FROM c
WHERE CASE WHEN n_dims = 0 THEN {str(glob).lower()} ELSE ({where}) END"""


LINES = "SELECT * FROM lineitem"
#: Cells that each rule keeps, said by hand.
RULES = {
    "max_dimensions": ("n_dims <= 1", True),
    "min_dimensions": ("n_dims >= 2", True),
    "contains_dim": ("d_flag > 0", False),
    "contains_all_dims": ("d_flag > 0 AND d_time > 0", False),
    "top_level": ("n_dims = 1 AND d_time > 0", True),
    "not_together": ("NOT (d_flag > 0 AND d_status > 0)", False),
    "not_with_attribute": ("NOT (d_flag > 0 AND d_time = 2)", False),
    "not_alone": ("NOT (n_dims = 1 AND d_status > 0)", False),
    "only_with": ("d_status > 0", False),
    "and": ("n_dims <= 2 AND d_time > 0", False),
    "or": ("(n_dims = 1 AND d_flag > 0) OR (d_status > 0 AND d_time > 0)", False),
    "nested": ("n_dims <= 2 AND NOT (d_status > 0 AND d_time > 0)", True),
}
KIND = {"kind": [("event_type", "event_type")]}
DAY = {"day": [("day", "strftime(ts, '%Y-%m-%d')")]}
EVENTS = "SELECT * FROM events"
REACH = "count(DISTINCT user_id)::DOUBLE AS reach, count(*) AS n"
STATES = "round(sum(value), 2) AS total, count(*) AS n, min(value) AS low, max(value) AS high, round(sum(value), 2) / count(*) AS mean"
SIX = "epoch_us(ts) - (((epoch_us(ts) % 21600000000) + 21600000000) % 21600000000) AS bucket"
WINDOW = "ts >= TIMESTAMP '2024-01-05 03:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00'"
_GEO = "SELECT r_name, n_name, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _pairs(key: str, name: str, where: str) -> str:
    return f"""
WITH u AS (SELECT DISTINCT {key} AS e, user_id AS u FROM events), s AS (SELECT e, count(*)::DOUBLE AS c FROM u GROUP BY e), g AS (SELECT count(DISTINCT u)::DOUBLE AS c FROM u),
p AS (SELECT a.e AS x, b.e AS y, a.c AS ca, b.c AS cb, (SELECT count(*) FROM u m JOIN u n ON m.u = n.u AND m.e = a.e AND n.e = b.e)::DOUBLE AS i FROM s a JOIN s b ON {where})
SELECT '{name}=' || x AS a, '{name}=' || y AS b, ca AS estimate_a, cb AS estimate_b, ca + cb - i AS union_estimate, i AS intersection_estimate, round(i / (ca + cb - i), 6) AS jaccard, round(i * g.c / (ca * cb), 6) AS lift FROM p, g"""


#: Bytes of known sketches, states and a cell.
GOLDEN = {
    "kmv": "4b4d56010800000003000000f6299d6fbff7700041f6df977ffffa285aab25f6b50369be",
    "topk": "54504b0104000000020000000000000000000440040062657461000000000000f03f0500616c706861",
    "sample": "534d5001040000000200000041f6df977ffffa280400626574615aab25f6b50369be0500616c706861",
    "centroid": "43545201010000000000000002000000000000000000f03f00000000000000c0",
    "average": "41564702000000000000f83f0100000000000000dff5fa2d",
    "variance": "564152020100000000000000000000000000004000000000000000002a68d08b",
    "cell": "43585501000000010000000367656f0000000100000007636f756e7472790600000002435a",
    "cell_id": "bed9c102177b3a386d76f139182452ae0f343c8760bf439d66aca37ad547fc4a",
}


def _splitmix() -> str:
    """SplitMix64 of each row number xor 42, in 128 bits cut to 64."""
    m = "18446744073709551616::UHUGEINT"
    return f"""
WITH a AS (SELECT (xor(range, 42)::UHUGEINT + 11400714819323198485::UHUGEINT) % {m} AS x FROM range(20000)),
b AS (SELECT (xor(x, x >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT) % {m} AS x FROM a),
c AS (SELECT (xor(x, x >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT) % {m} AS x FROM b),
d AS (SELECT xor(x, x >> 31::UHUGEINT) AS x FROM c)
SELECT 'device_' || (((x * 2147483648::UHUGEINT) % {m} + (x >> 33::UHUGEINT)) % 8::UHUGEINT)::VARCHAR AS device, count(*) AS n, sum((x % 97::UHUGEINT)::BIGINT + 1)::BIGINT AS amount FROM d GROUP BY 1"""


def _series(value: str, zero: bool = False) -> str:
    blank = "0.0" if zero else "NULL"
    return f"""
WITH seg(s, e, ok) AS (VALUES (TIMESTAMP '2024-01-07 18:00:00', TIMESTAMP '2024-01-08 00:00:00', false), (TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-01-12 00:00:00', true), (TIMESTAMP '2024-01-12 00:00:00', TIMESTAMP '2024-01-12 06:00:00', false))
SELECT epoch_us(s) AS start, epoch_us(e) AS end, ok AS exact, CASE WHEN ok THEN (SELECT round({value}::DOUBLE, 4) FROM events WHERE event_type = 'click' AND ts >= s AND ts < e) ELSE {blank} END AS value FROM seg"""


def _one_kind(select: str, where: str = "true") -> str:
    return cube(f"SELECT * FROM events WHERE {where}", KIND, select, keys=SIX, extra=["bucket"], glob=True)


def all_sql() -> dict[str, str]:
    hier = {"flag": FLAG["flag"], "time": [("year", "CASE WHEN l_linenumber = 7 THEN NULL ELSE strftime(l_shipdate, '%Y') END"), ("month", "CASE WHEN l_linenumber >= 6 THEN NULL ELSE strftime(l_shipdate, '%m') END"), ("day", "strftime(l_shipdate, '%d')")]}
    bands = {"band": [("size", "CASE WHEN l_quantity < 10 THEN 'small/low' WHEN l_quantity < 30 THEN 'mid=1' ELSE 'big,x' END")], "quarter": [("q", "'Q' || quarter(l_shipdate)")]}
    slices = cube(LINES, {"time": TIME["time"]}, SUMS, "d_time = 2", False)
    top = cube("SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey", FLAG | STATUS, "sum(l_extendedprice) AS s", keys="p_brand AS brand", extra=["brand"])
    centroid = cube("SELECT label, i, x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)", {"label": [("label", "label")]}, "round(avg(x), 6) AS mean", extra=["i"])
    bins = cube(LINES, FLAG | STATUS, "count(*) AS k", keys="floor(l_extendedprice / 500)::BIGINT AS bin", extra=["bin"])
    out = {
        "cube_basic": cube(LINES, FLAG | STATUS, NUMBERS),
        "cube_hierarchy": cube(LINES, hier, SUMS),
        "cube_expr_levels": cube(LINES, bands, "round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, count(*) AS n"),
        "cube_geo": cube(_GEO, {"geo": [("region", "r_name"), ("nation", "n_name")], "segment": [("c_mktsegment", "c_mktsegment")]}, "round(sum(c_acctbal), 2) AS balance, count(*) AS customers"),
        "cube_count_distinct": cube(EVENTS, KIND | DAY, REACH),
        "cube_topk": f"SELECT xunit, rank, key, round(s, 2) AS score FROM (SELECT xunit, brand AS key, s, row_number() OVER (PARTITION BY xunit ORDER BY s DESC, brand)::INTEGER AS rank FROM ({top})) WHERE rank <= 100",
        "cube_centroid": f"SELECT xunit, i::INTEGER AS i, mean FROM ({centroid})",
        "cube_variance": cube(LINES, FLAG | STATUS, "count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 4) AS pop, round(var_samp(l_quantity), 4) AS samp"),
        "cube_quantile": f"WITH b AS ({bins}), r AS (SELECT *, sum(k) OVER (PARTITION BY xunit ORDER BY bin) AS upto, sum(k) OVER (PARTITION BY xunit) AS total FROM b) SELECT xunit, (min(bin) FILTER (upto > floor((total - 1) * 0.5)) + 0.5) * 500 AS p50, (min(bin) FILTER (upto > floor((total - 1) * 0.9)) + 0.5) * 500 AS p90 FROM r GROUP BY xunit",
        "setops": _pairs("event_type", "/kind/event_type", "a.e = 'click' AND b.e = 'error'"),
        "overlap_matrix": _pairs(DAY["day"][0][1], "/day/day", "a.e < b.e"),
        "nearest_cells": """
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
big AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 10 UNION ALL SELECT NULL WHERE (SELECT count(*) FROM embeddings) > 10),
every AS (SELECT label::VARCHAR AS label, i, x FROM m UNION ALL SELECT NULL, i, avg(x) FROM e GROUP BY i)
SELECT CASE WHEN every.label IS NULL THEN '/G' ELSE '/label/label=' || every.label END AS xunit, round(sum(x * CASE WHEN i < 32 THEN 1.0 ELSE -1.0 END) / (sqrt(sum(x * x)) * 8.0), 6) AS similarity
FROM every JOIN big ON every.label IS NOT DISTINCT FROM big.label::VARCHAR GROUP BY every.label ORDER BY similarity DESC, xunit LIMIT 5""",
        "rates": f"WITH c AS ({cube(EVENTS, DAY, 'count(*) AS whole, count(*) FILTER (event_type = ' + chr(39) + 'error' + chr(39) + ') AS part')}) SELECT xunit, whole, part, round(part / whole, 6) AS rate FROM c",
        "cube_merge": cube(EVENTS, KIND | DAY, STATES + ", count(DISTINCT user_id)::DOUBLE AS reach"),
        "cube_slice": f"SELECT xunit, replace(replace(xunit, '/time/year=', ''), '/month=', ' / ') AS label, revenue, n FROM ({slices}) ORDER BY n DESC, xunit LIMIT 20",
        "cube_meta": f"SELECT regexp_extract(p, '^/([^/]+)', 1) AS dim, count(*) AS cells FROM (SELECT unnest(string_split(xunit, ',')) AS p FROM ({cube(LINES, FLAG | STATUS | TIME, SUMS, glob=False)})) GROUP BY 1",
        "cube_cell": "SELECT '/flag/l_returnflag=R,/status/l_linestatus=F' AS xunit, " + NUMBERS + " FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' HAVING count(*) > 0",
        "cube_documents": cube("SELECT * FROM documents", {"lang": [("lang", "lang")], "source": [("source", "source")]}, "sum(n_chars)::BIGINT AS chars, count(*) AS n, round(sum(n_chars), 2) / count(*) AS mean"),
        "temporal_build": _one_kind(STATES),
        "temporal_window": _one_kind(STATES, WINDOW),
        "temporal_quarantine": "SELECT *, (SELECT count(*) FROM events WHERE event_id % 10 = 3) AS dropped FROM (" + _one_kind(STATES, "event_id % 10 <> 3") + ")",
        "temporal_registry": f"SELECT DISTINCT xunit, 32 AS id_bytes FROM ({_one_kind('count(*) AS n')})",
        "temporal_coverage": f"WITH b AS (SELECT {SIX} FROM events WHERE {WINDOW}) SELECT greatest(min(bucket), epoch_us(TIMESTAMP '2024-01-05 03:00:00')) AS start, least(max(bucket) + 21600000000, epoch_us(TIMESTAMP '2024-01-09 00:00:00')) AS end, greatest(min(bucket), epoch_us(TIMESTAMP '2024-01-05 03:00:00')) = epoch_us(TIMESTAMP '2024-01-05 03:00:00') AND least(max(bucket) + 21600000000, epoch_us(TIMESTAMP '2024-01-09 00:00:00')) = epoch_us(TIMESTAMP '2024-01-09 00:00:00') AS exact FROM b",
        "temporal_explain": f"SELECT (SELECT count(*) FROM events) AS source_rows, 0::BIGINT AS null_event_times, sum(n)::BIGINT AS generated_xunits, count(DISTINCT bucket) AS buckets, count(*) AS output_rows FROM ({_one_kind('count(*) AS n')})",
        "temporal_rollup": "SELECT epoch_us(date_trunc('day', ts)) AS bucket, 2 * count(*)::BIGINT AS n, round(2 * sum(value), 2) AS total, min(value) AS low, max(value) AS high, round(2 * sum(value), 2) / (2 * count(*)) AS mean FROM events GROUP BY 1",
        "temporal_lateness": f"WITH e AS (SELECT *, {SIX} FROM events) SELECT event_type, epoch_us(ts) + 5400000000 + (event_id % 720) * 120000000 < bucket + 21600000000 + 3600000000 AS on_time, count(*) AS n FROM e GROUP BY 1, 2",
        "bucket_starts": "WITH e AS (SELECT epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00') AS d, epoch_us(ts) AS t FROM events) SELECT t - (((d % 864000000000) + 864000000000) % 864000000000) AS bucket, count(*) AS n FROM e GROUP BY 1",
        "correction_rebuild": "SELECT strftime(ts, '%Y-%m-%d') AS window_id, CASE WHEN day(ts) IN (9, 10) THEN 2 ELSE 1 END::BIGINT AS revision, 2 * count(*)::BIGINT AS n, round(2 * sum(value), 2) AS total, round(2 * sum(value), 2) / (2 * count(*)) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2",
        "range_segments": """
SELECT * FROM (VALUES (0, 604800000000, epoch_us(TIMESTAMP '2024-01-02 05:00:00'), epoch_us(TIMESTAMP '2024-01-04 00:00:00'), false), (0, 604800000000, epoch_us(TIMESTAMP '2024-01-04 00:00:00'), epoch_us(TIMESTAMP '2024-01-18 00:00:00'), true), (0, 604800000000, epoch_us(TIMESTAMP '2024-01-18 00:00:00'), epoch_us(TIMESTAMP '2024-01-20 07:00:00'), false),
  (1, 21600000000, epoch_us(TIMESTAMP '2024-01-02 01:00:00'), epoch_us(TIMESTAMP '2024-01-02 02:00:00'), false), (2, 86400000000, epoch_us(TIMESTAMP '2024-01-02 00:00:00'), epoch_us(TIMESTAMP '2024-01-03 00:00:00'), true),
  (3, 86400000000, epoch_us(TIMESTAMP '2024-01-01 06:00:00'), epoch_us(TIMESTAMP '2024-01-02 00:00:00'), false), (3, 86400000000, epoch_us(TIMESTAMP '2024-01-02 00:00:00'), epoch_us(TIMESTAMP '2024-01-03 00:00:00'), true), (3, 86400000000, epoch_us(TIMESTAMP '2024-01-03 00:00:00'), epoch_us(TIMESTAMP '2024-01-03 09:00:00'), false)) t(query, resolution, start, "end", aligned)""",
        "affected": "SELECT strftime(d, '%Y-%m-%d') AS window_id, epoch_us(d) AS start, epoch_us(d) + 86400000000 AS end FROM (SELECT unnest(range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-08', INTERVAL 1 DAY)) AS d)",
        "bench_source": "WITH r AS (SELECT range AS r FROM range(20000)) SELECT 'device_' || ((r // 17) % 8) AS device, count(*) AS n, count(DISTINCT (r // 168) % 256) AS regions, count(DISTINCT (r * 13) % 10000) AS entities, count(DISTINCT r % 168) AS buckets FROM r GROUP BY 1",
        "layout_rows": f"WITH c AS ({_one_kind('count(*) AS n')}), n AS (SELECT count(*) AS n, count(DISTINCT xunit) AS x FROM c) SELECT unnest(['per_measure', 'wide', 'tagged_struct', 'registry_states', 'xunit_registry']) AS layout, unnest([5 * n, n, n, n, x]) AS n FROM n",
        "csv_source": cube("SELECT * FROM nation", {"region": [("key", "n_regionkey")]}, "count(*) AS n, max(n_nationkey) AS last"),
        "event_stream": f"WITH e AS (SELECT *, {SIX} FROM events) SELECT bucket, 2 * count(*)::BIGINT AS n, round(2 * sum(value), 2) AS total, min(value) AS low, max(value) AS high FROM e GROUP BY 1",
        "series_gap_zero": _series("sum(value)", True),
        "bench_source_sparse": _splitmix(),
        "temporal_ordered": f"SELECT count(*) AS n, 0::BIGINT AS out_of_order FROM ({_one_kind('count(*) AS n')})",
        "temporal_sketches": f"""
WITH e AS (SELECT epoch_us(date_trunc('day', ts)) AS bucket, '/kind/event_type=' || event_type AS xunit, value, user_id FROM events), c AS (SELECT * FROM e UNION ALL SELECT bucket, '/G', value, user_id FROM e),
b AS (SELECT bucket, xunit, floor(value / 0.5) AS bin, count(*) AS k FROM c GROUP BY ALL), r AS (SELECT *, sum(k) OVER (PARTITION BY bucket, xunit ORDER BY bin) AS upto, sum(k) OVER (PARTITION BY bucket, xunit) AS total FROM b),
q AS (SELECT bucket, xunit, (min(bin) FILTER (upto > floor((total - 1) * 0.9)) + 0.5) * 0.5 AS p90 FROM r GROUP BY ALL)
SELECT c.bucket, c.xunit, count(DISTINCT user_id)::DOUBLE AS reach, round(var_pop(value), 4) AS spread, any_value(p90) AS p90, least(count(DISTINCT user_id), 64)::INTEGER AS sampled FROM c JOIN q ON c.bucket = q.bucket AND c.xunit = q.xunit GROUP BY c.bucket, c.xunit""",
        "layout_contents": "SELECT unnest(['per_measure', 'wide', 'tagged_struct', 'registry_states']) AS layout, 2 * count(*)::BIGINT AS n, round(2 * sum(value), 2) AS total FROM events",
        "range_read": f"WITH c AS ({_one_kind('count(*) AS n, sum(value) AS t')}) SELECT bucket, count(*) AS cells, sum(n)::BIGINT AS n, round(sum(t), 2) AS total FROM c WHERE bucket >= epoch_us(TIMESTAMP '2024-01-05 03:00:00') AND bucket < epoch_us(TIMESTAMP '2024-01-09 00:00:00') GROUP BY bucket",
        "fixture_files": f"SELECT xunit, count(*) AS buckets, sum(n)::BIGINT AS n FROM ({_one_kind('count(*) AS n')}) GROUP BY xunit",
        "golden_bytes": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in GOLDEN.items()) + ") t(name, hex)",
        "cube_show": f"SELECT * FROM ({cube(LINES, FLAG | STATUS, NUMBERS)}) ORDER BY revenue DESC, xunit LIMIT 5",
        "memory_source": cube("SELECT * FROM nation", {"region": [("key", "n_regionkey")]}, "count(*) AS n, min(n_name) AS first"),
        "api_meta": f"SELECT count(*) AS cells, true AS has_global, 'day,kind' AS dimensions, 'reach,n' AS measures, 'reach:kmv' AS sketches FROM ({cube(EVENTS, KIND | DAY, REACH)})",
        "api_cells": f"SELECT row_number() OVER (ORDER BY n DESC, xunit)::INTEGER AS place, xunit, replace(xunit, '/day/day=', '') AS label, reach, n FROM ({cube(EVENTS, DAY, REACH, glob=False)}) ORDER BY n DESC, xunit LIMIT 7",
        "api_cell": "SELECT '/kind/event_type=click' AS xunit, 'click' AS label, count(*) AS n, count(DISTINCT user_id)::DOUBLE AS reach, 'kmv' AS kind, 1024 AS k, count(DISTINCT user_id)::DOUBLE AS estimate FROM events WHERE event_type = 'click'",
        "api_setops": f"SELECT estimate_a AS a, estimate_b AS b, union_estimate, intersection_estimate AS intersection, jaccard, lift FROM ({_pairs(DAY['day'][0][1], '/day/day', "a.e = '2024-01-08' AND b.e = '2024-01-09'")})",
        "api_series": f"SELECT *, CASE WHEN exact THEN 4 ELSE 0 END::INTEGER AS published FROM ({_series('sum(value)')})",
    }
    out |= {f"rule_{r}": cube(LINES, FLAG | STATUS | TIME, SUMS, where, glob) for r, (where, glob) in RULES.items()}
    return out | {f"series_{m}": _series(v) for m, v in {"sum": "sum(value)", "count": "count(*)", "min": "min(value)", "max": "max(value)", "avg": "avg(value)"}.items()}
