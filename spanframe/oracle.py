"""SQL of the registered trace queries, for a second engine (DuckDB) on the same tables."""

from __future__ import annotations

from spanframe.queries import END, START

EVENTS = """e AS MATERIALIZED (SELECT event_id, event_type AS name, CASE WHEN value < 10 THEN 'small' ELSE 'large' END AS category, 'X' AS phase,
  CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) AS ts, CAST(round(value * 100) * 3600000 AS DOUBLE) AS dur,
  user_id % 4 AS pid, user_id AS tid, user_id AS id, props AS args, value,
  CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) + CAST(round(value * 100) * 3600000 AS DOUBLE) AS end_ts FROM events)"""
ORDER = "o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pid, tid ORDER BY ts, dur DESC, event_id) AS seq FROM e)"
DEDUP = """n AS (SELECT *, CASE WHEN name = lag(name) OVER w AND ts = lag(ts) OVER w THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY pid, tid ORDER BY seq)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY pid, tid ORDER BY seq) AS run FROM n),
kept AS MATERIALIZED (SELECT * EXCLUDE (fresh, run, k) FROM (SELECT *, row_number() OVER (PARTITION BY pid, tid, run ORDER BY dur DESC, seq) AS k FROM r) WHERE k = 1)"""
ROUNDS = 16


def _spans() -> str:
    """The rounds of the span construction, unrolled."""
    parts = [EVENTS, ORDER, DEDUP, "p0 AS MATERIALIZED (SELECT *, CAST(NULL AS BIGINT) AS anc, CAST([] AS VARCHAR[]) AS steps, CAST([] AS BIGINT[]) AS ids FROM kept)"]
    for k in range(ROUNDS):
        w = "(PARTITION BY pid, tid, anc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        parts.append(f"m{k} AS MATERIALIZED (SELECT *, max(CASE WHEN dur > 0 THEN end_ts END) OVER {w} AS mo FROM p{k})")
        parts.append(f"t{k} AS MATERIALIZED (SELECT *, mo IS NULL OR mo <= ts AS top, last_value(CASE WHEN (mo IS NULL OR mo <= ts) AND dur > 0 THEN event_id END IGNORE NULLS) OVER {w} AS above, last_value(CASE WHEN (mo IS NULL OR mo <= ts) AND dur > 0 THEN name || '|' || category END IGNORE NULLS) OVER {w} AS step FROM m{k})")
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (mo, top, above, step) REPLACE (above AS anc, list_append(steps, step) AS steps, list_append(ids, above) AS ids) FROM t{k} WHERE NOT top)")
    union = " UNION ALL ".join(f"SELECT * EXCLUDE (mo, top, above, step, anc), anc AS parent_id, {k} AS depth FROM t{k} WHERE top" for k in range(ROUNDS))
    parts.append(f"tree AS MATERIALIZED ({union})")
    parts.append("kids AS (SELECT c.parent_id AS event_id, sum(c.dur) AS inner_dur FROM tree c JOIN tree p ON c.parent_id = p.event_id WHERE c.dur > 0 AND c.end_ts <= p.end_ts GROUP BY 1)")
    parts.append("s AS MATERIALIZED (SELECT tree.*, CASE WHEN dur > 0 THEN dur - coalesce(inner_dur, 0) ELSE 0 END AS self_time FROM tree LEFT JOIN kids USING (event_id))")
    return "WITH " + ",\n".join(parts)


def _flame(hidden: str = "") -> str:
    """CTEs nodes(pid, tid, path, level, calls, total, self_total) after the spans."""
    steps = f"list_filter(steps, lambda x: NOT ends_with(x, '|{hidden}'))" if hidden else "steps"
    where = f" AND category <> '{hidden}'" if hidden else ""
    return f""", fr AS (SELECT pid, tid, list_append({steps}, name || '|' || category) AS keys, least(end_ts, {END}) - greatest(ts, {START}) AS part FROM s WHERE dur > 0 AND ts <= {END} AND end_ts >= {START}{where}),
fo AS MATERIALIZED (SELECT pid, tid, keys, count(*) AS calls, sum(part) AS own FROM fr WHERE part > 0 GROUP BY ALL),
fp AS MATERIALIZED (SELECT a.pid, a.tid, a.keys, a.own, l.level, a.keys[1:l.level] AS prefix FROM fo a, (SELECT unnest(generate_series(1, {ROUNDS + 1})) AS level) l WHERE l.level <= len(a.keys)),
fm AS MATERIALIZED (SELECT fp.*, c.calls, c.own AS prefix_own FROM fp LEFT JOIN fo c ON c.pid = fp.pid AND c.tid = fp.tid AND c.keys = fp.prefix),
fn AS (SELECT pid, tid, keys, max(CASE WHEN calls IS NOT NULL AND level < len(keys) THEN level ELSE 0 END) AS nearest FROM fm GROUP BY ALL),
fg AS MATERIALIZED (SELECT fm.pid, fm.tid, fm.prefix, coalesce(max(calls), 0) AS calls, coalesce(max(prefix_own), sum(CASE WHEN calls IS NULL AND level > nearest THEN own END), 0.0) AS total FROM fm JOIN fn USING (pid, tid, keys) GROUP BY ALL),
fk AS (SELECT pid, tid, prefix[1:len(prefix) - 1] AS prefix, sum(total) AS kids FROM fg WHERE len(prefix) > 1 GROUP BY ALL),
nodes AS (SELECT fg.pid, fg.tid, array_to_string(fg.prefix, ' > ') AS path, CAST(len(fg.prefix) AS INTEGER) AS level, calls, total, greatest(0.0, total - coalesce(kids, 0.0)) AS self_total FROM fg LEFT JOIN fk USING (pid, tid, prefix) WHERE total > 0)"""


def oracle_sql() -> dict[str, str]:
    e, s = "WITH " + EVENTS, _spans()
    counters = "SELECT user_id % 4 AS pid, event_type AS name, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) AS ts, value FROM events"
    part = f"least(end_ts, {END}) - greatest(ts, {START})"
    top = "(SELECT id FROM (SELECT unnest(ids) AS id FROM s) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)"
    under = f"SELECT d.*, p.dur AS p_dur FROM s d, s p WHERE p.event_id = {top} AND list_contains(d.ids, p.event_id) AND d.dur > 0 AND d.end_ts <= p.end_ts"
    flows = "fe AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 's' WHEN 1 THEN 't' WHEN 2 THEN 'f' ELSE phase END AS ph FROM e)"
    told = lambda n, unit, x: f"printf('%.{n}f {unit}', {x})"
    both = f"""{e}, be AS (SELECT event_id, 'B' AS phase, ts, pid, tid FROM e UNION ALL SELECT event_id + 1000000000, 'E', ts + dur, pid, tid FROM e),
q AS (SELECT *, row_number() OVER (PARTITION BY pid, tid ORDER BY ts, event_id) AS seq FROM be),
q1 AS (SELECT *, sum(CASE phase WHEN 'B' THEN 1 ELSE -1 END) OVER (PARTITION BY pid, tid ORDER BY seq) AS sm FROM q),
q2 AS (SELECT *, least(0, min(sm) OVER (PARTITION BY pid, tid ORDER BY seq)) AS low, coalesce(least(0, min(sm) OVER (PARTITION BY pid, tid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS bef FROM q1),
q3 AS (SELECT *, phase = 'E' AND sm < bef AS lone, CASE WHEN phase = 'E' AND sm < bef THEN NULL ELSE sm - low + CASE WHEN phase = 'E' THEN 1 ELSE 0 END END AS lv FROM q2),
q4 AS (SELECT *, lead(ts) OVER (PARTITION BY pid, tid, lv ORDER BY seq) AS nx, lead(phase) OVER (PARTITION BY pid, tid, lv ORDER BY seq) AS nk FROM q3)
SELECT event_id, phase, ts, CASE WHEN phase = 'B' AND nk = 'E' THEN nx - ts ELSE 0.0 END AS dur FROM q4 WHERE phase = 'B' OR lone"""
    many = "SELECT i AS range_id, i * 86400000000.0 AS a, (i + 2) * 86400000000.0 AS b FROM (SELECT unnest(generate_series(1, 19)) AS i)"
    sql = {
        "hot_functions": f"{e} SELECT name, count(*) AS n, sum(dur) AS total_dur, round(avg(dur), 3) AS avg_dur FROM e WHERE dur > 0 GROUP BY name ORDER BY total_dur DESC, name LIMIT 50",
        "a2_longest": f"{e} SELECT event_id, name, ts, dur FROM e ORDER BY dur DESC, event_id LIMIT 20",
        "a3_events_per_thread": f"{e} SELECT pid, tid, 'Process ' || pid AS process_name, 'Thread ' || tid AS thread_name, count(*) AS n FROM e GROUP BY pid, tid",
        "a4_categories": f"{e} SELECT category, count(*) AS n, sum(dur) AS total_dur FROM e WHERE dur > 0 GROUP BY category",
        "a5_counters": f"SELECT name, pid, count(*) AS n, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value FROM ({counters}) GROUP BY name, pid",
        "a6_range_stats": f"{s} SELECT name, count(*) AS n, sum(part) AS total, min(part) AS min_part, max(part) AS max_part, round(sum(part) / count(*), 3) AS avg_part, round(sum(part) * 100 / {END - START}, 6) AS pct, arg_max(event_id, (dur, -pid, -tid, -seq)) AS longest FROM (SELECT *, {part} AS part FROM s WHERE dur > 0 AND ts <= {END} AND end_ts >= {START}) WHERE part > 0 GROUP BY name",
        "a7_children_by_name": f"{s} SELECT name, count(*) AS n, sum(dur) AS total, round(avg(dur), 3) AS avg, min(dur) AS min, max(dur) AS max, round(sum(dur * 100 / p_dur), 6) AS pct, arg_max(event_id, (dur, -seq)) AS longest FROM ({under}) GROUP BY name",
        "a8_search_stats": f"{e} SELECT name, count(*) AS n, sum(dur) AS total_dur, round(avg(dur), 3) AS avg_dur FROM e WHERE contains(lower(name), 'small') OR contains(lower(category), 'small') GROUP BY name",
        "a9_flame": f"{s}{_flame()} SELECT * FROM nodes",
        "a9_flame_hidden": f"{s}{_flame('small')} SELECT * FROM nodes",
        "a10_flame_zoom": f"{s}{_flame()}, root AS (SELECT * FROM nodes WHERE level = 1 ORDER BY total DESC, pid, tid, path LIMIT 1) SELECT n.pid, n.tid, n.path, n.total, round(n.total / root.total, 6) AS share, round(CASE WHEN n.calls > 0 THEN n.total / n.calls END, 3) AS avg FROM nodes n, root WHERE n.pid = root.pid AND n.tid = root.tid AND (n.path = root.path OR starts_with(n.path, root.path || ' > '))",
        "a11_call_rates": f"{e} SELECT name, count(*) AS n, round(count(*) * 1e6 / (SELECT max(ts) - min(ts) FROM e WHERE ts <> 0), 9) AS rate FROM e WHERE name <> '' GROUP BY name HAVING count(*) * 1e6 / (SELECT max(ts) - min(ts) FROM e WHERE ts <> 0) >= 0.0001",
        "a12_runs": f"{s}, u AS ({under}), v AS (SELECT *, CASE WHEN name = lag(name) OVER w AND depth = lag(depth) OVER w AND parent_id = lag(parent_id) OVER w THEN 0 ELSE 1 END AS fresh FROM u WINDOW w AS (PARTITION BY pid, tid ORDER BY seq)), x AS (SELECT *, sum(fresh) OVER (PARTITION BY pid, tid ORDER BY seq) AS run FROM v) SELECT arg_min(event_id, seq) AS first_event, any_value(name) AS name, any_value(depth) AS depth, count(*) AS n, sum(dur) AS total, sum(self_time) AS total_self, round(avg(dur), 3) AS avg, round(avg(self_time), 3) AS avg_self FROM x GROUP BY pid, tid, run",
        "a13_overview": f"{e} SELECT count(*) AS events, count(DISTINCT name) AS names, count(DISTINCT category) AS categories, count(args) AS args, sum(length(args)) AS args_chars, count(DISTINCT CASE WHEN event_id % 5 < 3 THEN id END) AS flows, max(end_ts) - min(ts) AS length, count(DISTINCT pid) AS processes, count(DISTINCT (pid, tid)) AS threads, count(DISTINCT (pid, name)) AS series, count(*) AS points FROM e",
        "a14_builder": f"{e} SELECT name, category, count(event_id) AS n, sum(dur) AS total, max(ts) AS last_ts FROM e WHERE dur > 1000 AND name ILIKE '%I%' OR category IN ('small') GROUP BY name, category HAVING count(event_id) > 5 ORDER BY total DESC LIMIT 20",
        "a15_row_counts": f"{e} SELECT 'events' AS view, count(*) AS n FROM e UNION ALL SELECT 'processes', count(DISTINCT pid) FROM e UNION ALL SELECT 'threads', count(DISTINCT (pid, tid)) FROM e UNION ALL SELECT 'counters', count(*) FROM e",
        "b1_thread_order": f"{e}, {ORDER} SELECT event_id, seq FROM o",
        "b2_pairs": both,
        "b4_dedup": f"WITH e0 AS (SELECT * FROM ({e} SELECT * FROM e)), e AS (SELECT * REPLACE (floor(ts / 86400000000) * 86400000000.0 AS ts, left(name, 1) AS name) FROM e0), {ORDER}, {DEDUP} SELECT event_id, name, ts, dur FROM kept",
        "b5_spans": f"{s} SELECT event_id, seq, depth, parent_id, self_time, dur - self_time AS child_time, CASE WHEN dur <> 0 THEN round(self_time * 100 / dur, 6) END AS self_pct FROM s",
        "b6_max_depth": f"{s} SELECT pid, tid, max(depth) AS max_depth FROM s GROUP BY pid, tid",
        "b8_call_stack": f"{s}, x AS (SELECT * FROM s ORDER BY depth DESC, event_id LIMIT 1), y AS (SELECT unnest(list_append(ids, event_id)) AS event_id, generate_subscripts(list_append(ids, event_id), 1) - 1 AS level FROM x) SELECT CAST(y.level AS INTEGER) AS level, y.event_id, s.name FROM y JOIN s USING (event_id)",
        "b11_bounds": f"{e} SELECT min(ts) AS min_ts, max(CASE WHEN dur > 0 THEN end_ts ELSE ts END) AS max_ts FROM e",
        "b12_categories": f"{e} SELECT DISTINCT category FROM e",
        "b13_name_index": f"{e} SELECT name, row_number() OVER (PARTITION BY name ORDER BY ts, event_id) AS n, event_id FROM e WHERE dur > 0",
        "b14_counter_bounds": f"SELECT pid, name, count(*) AS points, min(value) AS min_value, max(value) AS max_value FROM ({counters}) GROUP BY pid, name",
        "p1_visible": f"{e} SELECT event_id FROM e WHERE pid <> 1 AND tid <> 2 AND category <> 'small'",
        "p3_thread_counts": f"{e}, {ORDER}, {DEDUP} SELECT pid, tid, count(*) AS events FROM kept GROUP BY pid, tid",
        "p4_search": f"{e}, f AS (SELECT * FROM e WHERE contains(lower(name), 'li') OR contains(lower(category), 'li')) SELECT event_id, name, count(*) OVER (PARTITION BY name) AS n, sum(dur) OVER (PARTITION BY name) AS total_dur FROM f",
        "p6_overlapping": f"{e}, {ORDER}, {DEDUP} SELECT event_id FROM kept WHERE ts <= {END} AND end_ts >= {START}",
        "j3_counter_asof": f"{e}, c AS ({counters}), pr AS (SELECT event_id, pid, name, ts + 1800000000.0 AS t FROM e) SELECT pr.event_id, max(c.ts) AS point_ts, arg_max(c.value, (c.ts, c.value)) AS value FROM pr LEFT JOIN c ON c.pid = pr.pid AND c.name = pr.name AND c.ts <= pr.t GROUP BY pr.event_id",
        "j4_flow_edges": f"{e}, {flows}, f AS (SELECT id AS flow_id, event_id AS src_event, tid AS src_tid, ts AS src_ts, end_ts AS src_end, lead(event_id) OVER w AS dst_event_id, lead(tid) OVER w AS dst_tid, lead(ts) OVER w AS dst_ts, lead(end_ts) OVER w AS dst_end FROM fe WHERE ph IN ('s', 't', 'f') WINDOW w AS (PARTITION BY id ORDER BY event_id)) SELECT flow_id, src_event, dst_event_id, dst_ts - src_end AS latency FROM f WHERE dst_event_id IS NOT NULL AND NOT (src_ts > {END} AND dst_ts > {END}) AND NOT (src_end < {START} AND dst_end < {START}) AND src_tid <> 3 AND dst_tid <> 3",
        "j6_span_at": f"{s}, pr AS (SELECT DISTINCT pid, tid, depth, ts + 60000000 AS t FROM s) SELECT pr.pid, pr.tid, pr.depth, pr.t, arg_min(s.event_id, (s.dur, s.seq)) AS event_id FROM pr LEFT JOIN s ON s.pid = pr.pid AND s.tid = pr.tid AND s.depth = pr.depth AND s.ts - 1000 <= pr.t AND pr.t <= s.end_ts + 1000 GROUP BY ALL",
        "j7_children": f"{s} SELECT c.parent_id, c.event_id, CASE WHEN p.dur <> 0 THEN round(c.dur * 100 / p.dur, 6) END AS pct FROM s c JOIN s p ON c.parent_id = p.event_id WHERE c.dur > 0 AND c.end_ts <= p.end_ts",
        "j8_range_stats_many": f"{e}, {ORDER}, {DEDUP}, rg AS ({many}), x AS (SELECT range_id, k.*, least(end_ts, b) - greatest(ts, a) AS part FROM kept k JOIN rg ON k.ts <= b AND k.end_ts >= a WHERE dur > 0) SELECT range_id, name, count(*) AS n, sum(part) AS total, min(part) AS min_part, max(part) AS max_part, arg_max(event_id, (dur, -pid, -tid, -seq)) AS longest FROM x WHERE part > 0 GROUP BY range_id, name",
        "w1_unique": f"{e} SELECT min(event_id) AS event_id, name FROM e GROUP BY name",
        "w2_longest_instance": f"{e}, {ORDER}, {DEDUP} SELECT pid, tid, name, arg_max(event_id, (dur, -seq)) AS event_id, max(dur) AS dur FROM kept WHERE dur > 0 GROUP BY pid, tid, name",
        "w3_navigation": f"{s} SELECT s.event_id, lag(s.event_id) OVER w AS prev_sibling, lead(s.event_id) OVER w AS next_sibling, k.longest_child FROM s LEFT JOIN (SELECT parent_id, arg_max(event_id, (dur, -seq)) AS longest_child FROM s WHERE parent_id IS NOT NULL GROUP BY parent_id) k ON k.parent_id = s.event_id WINDOW w AS (PARTITION BY s.pid, s.tid, s.parent_id ORDER BY s.seq)",
        "w5_instances": f"{e} SELECT event_id, row_number() OVER w AS n, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next, dur FROM e WHERE name = 'click' AND dur > 0 WINDOW w AS (ORDER BY ts, event_id)",
        "q1_sql": f"{e} SELECT 'Process ' || pid AS process, category, count(*) AS n, sum(dur) AS total FROM e WHERE dur > (SELECT avg(dur) FROM e) GROUP BY pid, category",
        "d1_counter_buckets": f"WITH c AS ({counters}), ed AS (SELECT pid, name, max(CASE WHEN ts < {START} THEN (ts, value) END) AS f, min(CASE WHEN ts > {END} THEN (ts, value) END) AS p FROM c GROUP BY pid, name), x AS (SELECT c.*, c.ts > {END} AS past_end, CAST(trunc((ts - {START}) / {END - START} * 100) AS BIGINT) AS bucket FROM c JOIN ed ON c.pid = ed.pid AND c.name = ed.name WHERE (c.ts <= {END} AND (c.ts >= {START} OR coalesce((c.ts, c.value) = ed.f, FALSE))) OR coalesce((c.ts, c.value) = ed.p, FALSE)) SELECT pid, name, past_end, bucket, min(ts) AS first_ts, min(value) AS min_value, max(value) AS max_value, arg_max(value, (ts, value)) AS last_value, count(*) AS points FROM x GROUP BY pid, name, past_end, bucket",
        "d2_timeline_lod": f"""{s}, v AS (SELECT *, (ts - {START}) * {2000 / (END - START)!r} AS x0, (end_ts - {START}) * {2000 / (END - START)!r} AS x1 FROM s WHERE ts <= {END} AND end_ts >= {START}),
sm AS (SELECT pid, tid, depth, seq, event_id, x0, greatest(x1, x0 + 1) AS x1 FROM v WHERE x1 - x0 < 2),
nw AS (SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY pid, tid, depth ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS fresh FROM sm),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY pid, tid, depth ORDER BY seq) AS run FROM nw)
SELECT pid, tid, depth, 'slice' AS kind, round(x0, 4) AS x0, round(x1, 4) AS x1, 1 AS n, event_id FROM v WHERE x1 - x0 >= 2
UNION ALL SELECT pid, tid, depth, 'run', round(min(x0), 4), round(max(x1), 4), count(*), arg_min(event_id, seq) FROM rn GROUP BY pid, tid, depth, run""",
        "s9_arg_counters": f"{e} SELECT pid, name, count(*) AS n, sum(CAST(json_extract_string(args, '$.k') AS DOUBLE)) AS total FROM e WHERE json_extract_string(args, '$.k') IS NOT NULL GROUP BY pid, name",
        "s13_csv": """SELECT event_id || ',' || event_type || ',' || CASE WHEN regexp_matches(props, '[,"]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END AS value FROM events""",
        "s14_trace_json": f"{e} SELECT name, ts, dur, pid, tid, CAST(json_extract_string(args, '$.k') AS DOUBLE) AS k FROM e",
        "x1_format_time": f"{e} SELECT event_id, CASE WHEN us < 1 THEN {told(1, 'ns', 'us * 1000')} WHEN us < 1000 THEN {told(3, 'us', 'us')} WHEN us < 1000000 THEN {told(3, 'ms', 'us / 1000')} ELSE {told(3, 's', 'us / 1000000')} END AS told FROM (SELECT event_id, floor(dur / pow(10.0, event_id % 12)) + 0.25 AS us FROM e)",
        "x2_source": f"{e} SELECT event_id, '/mnt/code/' || 'f' || tid || '.py' AS source_file, CAST(pid AS INTEGER) AS source_line FROM e",
        "x3_remap_urls": "SELECT page_id, '/mirror/' || CASE WHEN starts_with(lower(url), 'https:') THEN ltrim(substr(url, 7), '/') ELSE ltrim(url, '/') END AS path FROM pages",
        "x4_args": f"{e} SELECT event_id, 'k' AS key, json_extract_string(args, '$.k') AS value FROM e WHERE json_extract_string(args, '$.k') IS NOT NULL",
        "s1_read_trace": f"{e} SELECT name, category, phase, ts, dur, pid, tid, CAST(json_extract_string(args, '$.k') AS DOUBLE) AS k FROM e",
        "b10_thread_order": f"{e} SELECT pid, 0 AS process_index, tid, row_number() OVER (PARTITION BY pid ORDER BY tid) AS place FROM (SELECT DISTINCT pid, tid FROM e)",
        "j2_names": f"{e} SELECT event_id, 'Process ' || pid AS process_name, 'Thread ' || tid AS thread_name FROM e",
        "p7_children_filtered": f"{s}, u AS ({under}) SELECT event_id, name, round(dur * 100 / p_dur, 6) AS pct FROM u WHERE contains(lower(name), 'ic')",
        "q3_builder_sql": f"{e} SELECT name, count(event_id) AS n, min(dur) AS least FROM e WHERE dur >= 1000 AND category IN ('small', 'large') GROUP BY name HAVING count(event_id) > 5 ORDER BY n DESC, name LIMIT 50",
        "j4_flow_one_id": f"{e}, {flows}, f AS (SELECT event_id AS src_event, lead(event_id) OVER w AS dst_event_id, lead(ts) OVER w - end_ts AS latency FROM fe WHERE ph IN ('s', 't', 'f') WINDOW w AS (ORDER BY event_id)) SELECT * FROM f WHERE dst_event_id IS NOT NULL",
        "x4_nested_args": f"{e} SELECT event_id, 'a.t' AS key, CAST(tid AS VARCHAR) AS value FROM e UNION ALL SELECT event_id, 'a.texts[0]', name FROM e UNION ALL SELECT event_id, 'a.texts[1]', category FROM e UNION ALL SELECT event_id, 'b[0].p', CAST(pid AS VARCHAR) FROM e",
        "s2_read_array": f"{e} SELECT name, category, ts / 1000 AS ts, dur / 1000 AS dur, pid, tid, tid AS id FROM e",
        "s1_read_object": f"{e} SELECT name, category, ts, dur, pid, tid, tid AS id FROM e",
        "s8_metadata": f"{e} SELECT DISTINCT pid, tid, 'proc ' || pid AS process_name, 'of ' || tid AS thread_name FROM e",
        "s10_ordinals": f"{e} SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, event_id FROM e",
        "s11_generated": "SELECT 'counter of ' || i AS what, (SELECT count(*) // 50 FROM events) AS n FROM (SELECT unnest(range(4)) AS i) UNION ALL SELECT 'flows', count(*) // 10 FROM events",
        "s13_tsv": "SELECT event_id || chr(9) || event_type || chr(9) || props AS value FROM events UNION ALL SELECT 'event_id' || chr(9) || 'name' || chr(9) || 'args'",
        "s14_trace_file": f"""{e}, f AS (SELECT event_id, name, 'X' AS phase, ts, dur, pid, tid, CAST(json_extract_string(args, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS arg_name FROM e
UNION ALL SELECT event_id + 1000000000, name, 'C', ts, 0.0, pid, tid, NULL, CAST(printf('%.6g', dur) AS DOUBLE), name FROM e)
SELECT * REPLACE (row_number() OVER (ORDER BY event_id) - 1 AS event_id) FROM f""",
        "p6_stored_view": f"{e}, {ORDER}, {DEDUP}, x AS (SELECT * FROM kept WHERE ts <= {START + 3.6e9} AND end_ts >= {START}) SELECT event_id, 'all' AS of FROM x UNION ALL SELECT event_id, 'one' FROM x WHERE pid = 1",
        "q2_schema": f"""{e}, n AS (SELECT 'events' AS view, count(*) AS n FROM e UNION ALL SELECT 'processes', count(DISTINCT pid) FROM e UNION ALL SELECT 'threads', count(DISTINCT (pid, tid)) FROM e UNION ALL SELECT 'counters', count(*) FROM e),
c(view, col, type, is_key) AS (VALUES ('events', 'event_id', 'bigint', TRUE), ('events', 'name', 'string', FALSE), ('events', 'category', 'string', FALSE), ('events', 'phase', 'string', FALSE), ('events', 'ts', 'double', FALSE), ('events', 'dur', 'double', FALSE),
  ('events', 'pid', 'bigint', FALSE), ('events', 'tid', 'bigint', FALSE), ('events', 'id', 'decimal(20,0)', FALSE), ('events', 'args', 'string', FALSE), ('events', 'end_ts', 'double', FALSE), ('processes', 'pid', 'bigint', TRUE), ('processes', 'name', 'string', FALSE),
  ('processes', 'sort_index', 'int', FALSE), ('threads', 'pid', 'bigint', TRUE), ('threads', 'tid', 'bigint', TRUE), ('threads', 'name', 'string', FALSE), ('threads', 'sort_index', 'int', FALSE), ('counters', 'pid', 'bigint', FALSE), ('counters', 'name', 'string', FALSE),
  ('counters', 'ts', 'double', FALSE), ('counters', 'value', 'double', FALSE)) SELECT c.view, c.col AS "column", c.type, c.is_key, n.n AS "rows" FROM c JOIN n USING (view)""",
        "l2_row_cap": f"{e} SELECT event_id, name, (SELECT count(*) FROM e) > 100 AS truncated FROM e ORDER BY event_id LIMIT 100",
        "l3_search_sort": f"{e} SELECT event_id, name, dur, row_number() OVER (ORDER BY dur DESC, event_id) AS place FROM e WHERE contains(lower(name), 'li') OR contains(lower(category), 'li') QUALIFY place <= 50",
        "l4_instance_sort": f"{e} SELECT event_id, dur, row_number() OVER (ORDER BY ts, event_id) AS n, row_number() OVER (ORDER BY dur DESC, event_id) AS place FROM e WHERE name = 'click' AND dur > 0 QUALIFY place <= 50",
        "l5_children_sort": f"{s}, u AS ({under}) SELECT event_id, dur, row_number() OVER (ORDER BY dur * 100 / p_dur DESC, event_id) AS place FROM u QUALIFY place <= 50",
        "p2_categories": f"{e} SELECT TRUE AS show, count(*) AS n FROM e UNION ALL SELECT FALSE, 0",
        "a11_metadata": f"{e}, m AS (SELECT name FROM e UNION ALL SELECT 'thread_name' FROM e) SELECT name, count(*) AS n, round(count(*) * 1e6 / (SELECT max(ts) - min(ts) FROM e WHERE ts <> 0), 9) AS rate FROM m WHERE name <> '' GROUP BY name HAVING count(*) * 1e6 / (SELECT max(ts) - min(ts) FROM e WHERE ts <> 0) >= 0.0001",
        "j7_descendants": f"{s}, u AS ({under}) SELECT event_id, round(dur * 100 / p_dur, 6) AS pct FROM u",
        "w6_first_instances": f"{e} SELECT name, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM e WHERE dur > 0 GROUP BY name",
    }
    return sql
