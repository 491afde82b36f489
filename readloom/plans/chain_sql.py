"""Chaining in SQL, in another form than the array programs: lists that recursive queries fold."""

from __future__ import annotations

from ..operators.chains import GraphParams

# A group's hits are one list; a step of the recursion adds the score and the predecessor of the next hit,
# from a scan down the list that a struct folds: (best, arg, done). Then a hit belongs to the best ranked of all hits
# whose predecessors lead to it, which is a closure and a minimum.
# Before these steps come hits (query_id, query_pos, target_id, target_pos), lens and elens (id, n) and lost (id, pos).
# 17 bases a k-mer, jumps below 1500, gaps up to 500, those above 100 at twice their length and others at
# half, and overlaps of at least 50.
CHAIN_STEPS = """grp AS (
  SELECT query_id, target_id, any_value(l.n) AS ql, any_value(e.n) AS tl, max(query_pos) - min(query_pos) AS cs, max(target_pos) - min(target_pos) AS es, count(DISTINCT CASE WHEN query_pos <> 0 THEN query_pos END) AS u
  FROM hits JOIN lens l ON l.id = query_id JOIN elens e ON e.id = abs(target_id) GROUP BY 1, 2
), sorted AS (
  SELECT h.query_id, h.target_id, g.ql, g.tl, h.query_pos AS c, h.target_pos AS e,
         row_number() OVER (PARTITION BY h.query_id, h.target_id ORDER BY CASE WHEN g.tl > g.ql THEN h.target_pos ELSE h.query_pos END, h.query_pos, h.target_pos) AS i
  FROM hits h JOIN grp g USING (query_id, target_id) WHERE u >= 0.5 AND cs >= 50 AND es >= 50
), lists AS (
  SELECT query_id, target_id, any_value(ql) AS ql, any_value(tl) AS tl, count(*) AS n, list(c ORDER BY i) AS c, list(e ORDER BY i) AS e FROM sorted GROUP BY 1, 2
), dp AS (
  SELECT query_id, target_id, ql, tl, n, c, e, CAST(1 AS BIGINT) AS i, [CAST(0 AS BIGINT)] AS s, [CAST(0 AS BIGINT)] AS b FROM lists
  UNION ALL
  SELECT query_id, target_id, ql, tl, n, c, e, i + 1, list_append(s, greatest(f.best, 17)), list_append(b, CASE WHEN f.best > 17 THEN f.arg ELSE 0 END)
  FROM (SELECT *, list_reduce(list_prepend({'best': CAST(0 AS BIGINT), 'arg': CAST(0 AS BIGINT), 'done': false, 'dc': CAST(0 AS BIGINT), 'de': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'j': CAST(0 AS BIGINT)},
          list_transform(range(i, 0, -1), lambda j: {'best': CAST(0 AS BIGINT), 'arg': CAST(0 AS BIGINT), 'done': false, 'dc': c[i + 1] - c[j], 'de': e[i + 1] - e[j], 's': s[j], 'j': j})),
          lambda a, x: CASE WHEN a.done OR (CASE WHEN tl > ql THEN x.de ELSE x.dc END) > 1500 THEN {'best': a.best, 'arg': a.arg, 'done': true, 'dc': a.dc, 'de': a.de, 's': a.s, 'j': a.j}
            WHEN x.dc > 0 AND x.dc < 1500 AND x.de > 0 AND x.de < 1500 AND abs(x.dc - x.de) <= 500
              AND x.s + least(x.dc, x.de, 17) - CAST(floor(abs(x.dc - x.de) * CASE WHEN abs(x.dc - x.de) > 100 THEN 2.0 ELSE 0.5 END) AS BIGINT) > a.best
            THEN {'best': x.s + least(x.dc, x.de, 17) - CAST(floor(abs(x.dc - x.de) * CASE WHEN abs(x.dc - x.de) > 100 THEN 2.0 ELSE 0.5 END) AS BIGINT), 'arg': x.j, 'done': x.dc = x.de AND x.dc < 17, 'dc': a.dc, 'de': a.de, 's': a.s, 'j': a.j}
            ELSE a END) AS f FROM dp WHERE i < n)
), full_dp AS (SELECT * FROM dp WHERE i = n
), nodes AS (
  SELECT query_id, target_id, ql, tl, unnest(range(1, n + 1)) AS i, unnest(c) AS c, unnest(e) AS e, unnest(s) AS s, unnest(b) AS b FROM full_dp
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, target_id ORDER BY s DESC, i) AS r FROM nodes
), paths AS (
  SELECT query_id, target_id, r, b AS at, i AS held FROM ranked WHERE b > 0
  UNION ALL
  SELECT p.query_id, p.target_id, p.r, n.b, n.i FROM paths p JOIN ranked n ON n.query_id = p.query_id AND n.target_id = p.target_id AND n.i = p.at WHERE n.b > 0
), owned AS (SELECT query_id, target_id, held, min(r) AS r FROM paths GROUP BY 1, 2, 3
), found AS (
  SELECT z.query_id AS cur_id, a.c AS cur_begin, z.c + 16 AS cur_end, z.ql AS cur_len, z.target_id AS ext_id, a.e AS ext_begin, z.e + 16 AS ext_end, z.tl AS ext_len, z.s - a.s + 16 AS score, g.n + 1 AS n, z.r
  FROM (SELECT query_id, target_id, r, count(*) AS n, min(held) AS low FROM owned GROUP BY 1, 2, 3) g
  JOIN ranked z USING (query_id, target_id, r) JOIN ranked l ON l.query_id = g.query_id AND l.target_id = g.target_id AND l.i = g.low JOIN ranked a ON a.query_id = g.query_id AND a.target_id = g.target_id AND a.i = l.b
), tested AS (
  SELECT f.*, greatest(cur_end - cur_begin, ext_end - ext_begin) - (SELECT count(DISTINCT pos) FROM lost WHERE lost.id = f.cur_id AND pos BETWEEN f.cur_begin AND f.cur_end) AS room FROM found f
  WHERE least(cur_end - cur_begin, ext_end - ext_begin) >= 50 AND abs((cur_end - cur_begin) - (ext_end - ext_begin)) <= 0.5 * least(cur_end - cur_begin, ext_end - ext_begin)
    AND NOT (cur_id = ext_id AND least(cur_end, ext_end) - greatest(cur_begin, ext_begin) > (cur_end - cur_begin) / 2)
    AND NOT (cur_id = -ext_id AND least(cur_end, ext_len - ext_begin) - greatest(cur_begin, ext_len - ext_end) > (cur_end - cur_begin) / 2)
), measured AS (SELECT *, ln(1 / least(n / room, 1.0)) / 17 AS d FROM tested)"""
OVERLAP_FIELDS = "cur_id, CAST(cur_begin AS INTEGER) AS cur_begin, CAST(cur_end AS INTEGER) AS cur_end, CAST(cur_len AS INTEGER) AS cur_len, ext_id, CAST(ext_begin AS INTEGER) AS ext_begin, CAST(ext_end AS INTEGER) AS ext_end, CAST(ext_len AS INTEGER) AS ext_len, score, round(d, 5) AS seq_divergence"
BEST_STEPS = f"""{CHAIN_STEPS}, best AS (SELECT {OVERLAP_FIELDS} FROM measured WHERE room > 0 QUALIFY row_number() OVER (PARTITION BY cur_id, ext_id ORDER BY score DESC, r) = 1), ov AS (SELECT * FROM best WHERE seq_divergence < 1.0)"""
ALL_STEPS = f"""{CHAIN_STEPS}, held AS (SELECT * FROM measured WHERE greatest(least(cur_begin, ext_begin), least(cur_len - cur_end, ext_len - ext_end)) <= 400),
ov AS (SELECT {OVERLAP_FIELDS} FROM held o WHERE d < 1.0 AND NOT EXISTS (SELECT 1 FROM held x WHERE x.cur_id = o.cur_id AND x.ext_id = o.ext_id AND x.score > o.score AND x.cur_begin <= o.cur_begin AND x.cur_end >= o.cur_end AND x.ext_begin <= o.ext_begin AND x.ext_end >= o.ext_end))"""


# In a graph, one chain ends in each row, so a read's state is lists by row: score, time of closing (0: open),
# path and begin of that chain. A second recursion takes chains by score, with the list of ranges taken so far.
# Before these steps comes e (read_id, cand, b, z, edge, ln, rn, eb, ee, el, sc): where an overlap begins and ends in the
# read, its edge with left and right node, where it begins and ends in the edge, the edge's length, and its score.


def graph_steps(p: GraphParams) -> str:
    """p, walk, ends, line, taken and chain (read_id, chain_id, x, path and others) from e; x are the overlaps of a read."""
    return f"""p AS (
  SELECT read_id, count(*) AS n, list({{'b': b, 'z': z, 'edge': edge, 'ln': ln, 'rn': rn, 'eb': eb, 'el': el, 'rest': el - ee, 'sc': sc}} ORDER BY b, cand) AS x FROM e GROUP BY 1
), walk AS (
  SELECT read_id, n, x, CAST(1 AS BIGINT) AS i, [CAST(x[1].sc AS BIGINT)] AS total, [CASE WHEN x[1].rest >= {p.max_jump} THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END] AS closed, [[CAST(1 AS BIGINT)]] AS path FROM p
  UNION ALL
  SELECT read_id, n, x, i + 1, list_append(total, CASE WHEN won THEN best.s ELSE x[i + 1].sc END),
    list_append(list_transform(range(1, i + 1), lambda k: CASE WHEN late AND list_contains(behind, k) THEN i + 1 ELSE closed[k] END), CASE WHEN NOT won AND x[i + 1].rest >= {p.max_jump} THEN i + 1 ELSE 0 END),
    list_append(path, CASE WHEN won THEN list_append(path[-best.nk], i + 1) ELSE [i + 1] END)
  FROM (SELECT *, len(behind) > (len(list_filter(closed, lambda c: c = 0)) + CASE WHEN NOT won AND x[i + 1].rest >= {p.max_jump} THEN 0 ELSE 1 END) // 2 AS late
    FROM (SELECT *, coalesce(best.s > 0, false) AS won
      FROM (SELECT *, list_filter(range(1, i + 1), lambda k: closed[k] = 0 AND x[i + 1].eb < {p.max_jump} AND x[i + 1].b - x[k].z > {p.max_jump}) AS behind,
          list_max(list_transform(list_filter(range(1, i + 1), lambda k: closed[k] = 0 AND x[k].rn = x[i + 1].ln AND x[i + 1].b - x[k].z > -{p.max_read_overlap} AND x[i + 1].b - x[k].z < {p.max_jump} AND x[k].rest + x[i + 1].eb < {p.max_jump} AND x[i + 1].eb < {p.max_jump}),
            lambda k: {{'s': total[k] + x[i + 1].sc - CASE WHEN abs(x[i + 1].b - x[k].z - x[k].rest - x[i + 1].eb) > {p.long_gap} THEN abs(x[i + 1].b - x[k].z - x[k].rest - x[i + 1].eb) // {p.gap_unit} ELSE 0 END, 'nk': -k}})) AS best
        FROM walk WHERE i < n)))
), ends AS (
  SELECT read_id, x, unnest(range(1, n + 1)) AS k, unnest(total) AS total, unnest(closed) AS closed, unnest(path) AS path FROM walk WHERE i = n
), line AS (
  SELECT *, x[path[1]].b AS b, x[k].z AS z, row_number() OVER (PARTITION BY read_id ORDER BY total DESC, closed > 0, closed, closed <> k, k) AS r FROM ends
), taken AS (
  SELECT read_id, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(b INTEGER, z INTEGER)[]) AS held, false AS got FROM p
  UNION ALL
  SELECT t.read_id, l.r, CASE WHEN l.z - l.b >= {p.min_overlap} AND len(list_filter(t.held, lambda h: least(h.z, l.z) - greatest(h.b, l.b) > {p.max_separation})) = 0 THEN list_append(t.held, {{'b': l.b, 'z': l.z}}) ELSE t.held END,
    l.z - l.b >= {p.min_overlap} AND len(list_filter(t.held, lambda h: least(h.z, l.z) - greatest(h.b, l.b) > {p.max_separation})) = 0
  FROM taken t JOIN line l ON l.read_id = t.read_id AND l.r = t.r + 1
), chain AS (
  SELECT l.*, row_number() OVER (PARTITION BY read_id ORDER BY r) - 1 AS chain_id FROM line l JOIN taken USING (read_id, r) WHERE got
)"""
