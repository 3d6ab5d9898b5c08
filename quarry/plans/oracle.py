"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

from quarry.operators.retrieval import KEYWORD_DOCS
from quarry.sources.views import with_views


def r(x: str, digits: int = 4) -> str:
    return f"round(({x}) + 1e-9, {digits})"


def lith(gr: str, den: str, rt: str) -> tuple[str, str]:
    """CASE of the lithology and of its confidence."""
    from quarry.functions.rules import LITHOLOGY

    name = conf = ""
    for g, d, n, c in LITHOLOGY:
        cond = f"{gr} < {g}" + (f" AND {den} < {d}e0" if d else "")
        name += f" WHEN {cond} THEN '{n}'"
        conf += f" WHEN {cond} THEN {c}e0"
    rich = f"{den} < 2.5e0 AND {rt} > 20"
    return f"CASE{name} WHEN {rich} THEN 'organic_rich_shale' ELSE 'shale' END", f"CASE{conf} WHEN {rich} THEN 0.7e0 ELSE 0.85e0 END"


IOU_W = "greatest(0e0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0e0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
AREA = "greatest(0e0, {a}.x2 - {a}.x1) * greatest(0e0, {a}.y2 - {a}.y1)"


def iou(a: str, b: str) -> str:
    w = IOU_W.format(a=a, b=b)
    return f"({w} / ({AREA.format(a=a)} + {AREA.format(a=b)} - {w} + 1e-8))"


def cell(c: str, n: int) -> str:
    return f"trunc(least(greatest({c} * {n}, 0e0), {n - 1}e0))::INT"


CROSS = "crossed AS (SELECT *, lag(gr) OVER (PARTITION BY well ORDER BY idx) AS prev FROM curve_li), marked AS (SELECT *, coalesce(prev >= 120 AND gr < 120, false) AS down, coalesce(prev < 120 AND gr >= 120, false) AS up FROM crossed), grouped AS (SELECT *, sum(down::INT) OVER (PARTITION BY well ORDER BY idx) AS k FROM marked), spans AS (SELECT well, k, min(depth) AS depth_top, coalesce(min(depth) FILTER (WHERE up), max(depth)) AS depth_bottom FROM grouped WHERE k > 0 GROUP BY well, k), sands AS (SELECT well, depth_top, depth_bottom FROM spans WHERE depth_bottom - depth_top > 1)"
GRAD = "grad AS (SELECT *, abs(coalesce((lead(gr) OVER w - lag(gr) OVER w) / 2, lead(gr) OVER w - gr, gr - lag(gr) OVER w, 0e0)) AS g FROM curve_li WINDOW w AS (PARTITION BY well ORDER BY idx)), zs AS (SELECT *, (g - avg(g) OVER (PARTITION BY well)) / (stddev_pop(g) OVER (PARTITION BY well) + 1e-8) AS z FROM grad)"


def segments(z: float) -> str:
    name, conf = lith("gr_mean", "den_mean", "rt_mean")
    return (
        GRAD + f", peaks AS (SELECT well, idx, CASE WHEN coalesce(idx - lag(idx) OVER (PARTITION BY well ORDER BY idx), 4) > 3 THEN 1 ELSE 0 END AS brk FROM zs WHERE z > {z})"
        ", pk AS (SELECT well, idx, sum(brk) OVER (PARTITION BY well ORDER BY idx) AS k FROM peaks)"
        ", cps AS (SELECT well, floor(avg(idx))::INT AS cp FROM pk GROUP BY well, k)"
        ", ns AS (SELECT well, count(*)::INT AS n FROM curve_li GROUP BY well)"
        ", inner_s AS (SELECT well, coalesce(lag(cp) OVER (PARTITION BY well ORDER BY cp), 0) AS start_idx, least(cp + 1, n) AS end_idx FROM cps JOIN ns USING (well))"
        ", tail_s AS (SELECT well, max(cp) AS start_idx, max(n) AS end_idx FROM cps JOIN ns USING (well) GROUP BY well)"
        ", some_s AS (SELECT * FROM (SELECT * FROM inner_s UNION ALL SELECT * FROM tail_s) WHERE end_idx - start_idx >= 5)"
        ", all_s AS (SELECT * FROM some_s UNION ALL SELECT well, 0, n FROM ns WHERE well NOT IN (SELECT well FROM some_s))"
        ", means AS (SELECT s.well, s.start_idx, s.end_idx, min(depth) AS depth_top, max(depth) AS depth_bottom, round(avg(gr), 9) AS gr_mean, round(avg(den), 9) AS den_mean, round(avg(rt), 9) AS rt_mean FROM all_s s JOIN curve_li c ON c.well = s.well AND c.idx >= s.start_idx AND c.idx < s.end_idx GROUP BY ALL)"
        f", segs AS (SELECT *, {name} AS lithology, {conf} AS confidence FROM means)"
    )


NAME, CONF = lith("gr", "den", "rt")
WNAME, _ = lith("gr_mean", "den_mean", "rt_mean")
STATS = f"count(*) AS n, {r('min(amp)')} AS lo, {r('max(amp)')} AS hi, {r('avg(amp)')} AS mean, {r('stddev_pop(amp)')} AS std"
#: Mirrored rows of a 64-sample trace, for a frame of ``b`` before and ``a`` after.
MIRROR = "SELECT {cols}, {s} AS s, true AS own FROM {t} UNION ALL SELECT {cols}, -1 - {s}, false FROM {t} WHERE {s} < {b} UNION ALL SELECT {cols}, 127 - {s}, false FROM {t} WHERE {s} >= 64 - {a}"


def mirror(cols: str, table: str, b: int, a: int) -> str:
    return MIRROR.format(cols=cols, t=table, s="s", b=b, a=a)


PROB = "prob AS (SELECT il, trace, s, least(1e0, 3e0 * abs(amp), 0.2e0 + 2e0 * abs(amp)) AS p FROM section)"
#: Components by spreading the smallest cell number along neighbours.
COMP = "cells AS (SELECT il, trace, s, p, trace * 1000000 + s AS c FROM prob WHERE p >= 0.5), later AS (SELECT a.il, a.c AS c, b.c AS d FROM cells a JOIN cells b ON a.il = b.il AND a.trace + 1 = b.trace AND a.s = b.s UNION ALL SELECT a.il, a.c, b.c FROM cells a JOIN cells b ON a.il = b.il AND a.trace = b.trace AND a.s + 1 = b.s), near AS (SELECT il, c, d FROM later UNION ALL SELECT il, d, c FROM later), reach(il, c, d) AS (SELECT il, c, c FROM cells ANTI JOIN (SELECT il, d AS c FROM later) USING (il, c) UNION SELECT x.il, x.c, n.d FROM reach x JOIN near n ON n.il = x.il AND n.c = x.d), labelled AS (SELECT il, trace, s, p, region FROM cells JOIN (SELECT il, d AS c, min(c) AS region FROM reach GROUP BY il, d) USING (il, c))"
STOP = "('the','a','an','is','are','of','to','in','for','and','or','on','at','with','by','from','的','了','在','是','和','与','或','等','及','之')"
TOKENS = "list_filter(regexp_extract_all(lower({t}), '[一-鿿]+|[a-zA-Z_]+|[0-9]+\\.?[0-9]*'), lambda t: length(t) > 1 AND t NOT IN " + STOP + ")"
TFIDF = (
    "asked(query_id, query) AS (VALUES (1, 'thing ing the heation'), (2, 'license version software'), (3, 'keit der ung eine'))"
    ", qt AS (SELECT query_id, unnest(" + TOKENS.format(t="query") + ") AS term, len(" + TOKENS.format(t="query") + ") AS n FROM asked)"
    ", q AS (SELECT query_id, term, count(*) / n::DOUBLE AS qtf FROM qt GROUP BY query_id, term, n)"
    ", dt AS (SELECT doc_id, " + TOKENS.format(t="text") + " AS ts FROM documents)"
    ", d1 AS (SELECT doc_id, unnest(ts) AS term, len(ts) AS n FROM dt)"
    ", tf AS (SELECT doc_id, term, count(*) / n::DOUBLE AS tf FROM d1 WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term, n)"
    ", idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM tf GROUP BY term)"
    ", scores AS (SELECT query_id, doc_id, sum(qtf * tf * idf) AS score FROM tf JOIN q USING (term) JOIN idf USING (term) GROUP BY query_id, doc_id)"
    ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)"
)
ROUTED = "kw(keyword, doc_name) AS (VALUES " + ", ".join(f"('{k}', '{d}')" for k, ds in KEYWORD_DOCS.items() for d in ds) + "), parts(query_id, part) AS (VALUES (1, 'Fault zone'), (1, 'reservoir'), (2, 'well LOG'), (3, 'unknown'), (3, '断层与层位')), routed AS (SELECT DISTINCT query_id, doc_name FROM parts JOIN kw ON contains(lower(part), keyword))"
MATCH = (
    "rejected AS (SELECT * FROM ver), byid AS (SELECT v.*, d.det_id AS d FROM rejected v LEFT JOIN det d ON v.result_id = d.det_id)"
    f", pairs AS (SELECT v.ver_id, d.det_id AS d, {iou('v', 'd')} AS i FROM byid v JOIN det d ON v.image = d.image AND v.class_id = d.class_id WHERE v.d IS NULL)"
    ", best AS (SELECT ver_id, d, i FROM (SELECT *, row_number() OVER (PARTITION BY ver_id ORDER BY i DESC, d) AS n FROM pairs WHERE i > 0.3) WHERE n = 1)"
    ", matched AS (SELECT b.ver_id, b.confidence, b.is_real, coalesce(b.d, x.d) AS matched, x.i AS iou FROM byid b LEFT JOIN best x USING (ver_id))"
)
OUTCOME = MATCH + ", firsts AS (SELECT *, min(CASE WHEN matched IS NOT NULL AND coalesce(confidence >= 0.5, false) THEN ver_id END) OVER (PARTITION BY matched) AS f FROM matched WHERE NOT is_real), outcomes AS (SELECT ver_id, matched, CASE WHEN matched IS NULL THEN 'unmatched' WHEN ver_id = f THEN 'dropped' WHEN ver_id > f THEN 'duplicate' WHEN confidence IS NOT NULL THEN 'low_confidence' ELSE 'no_confidence' END AS outcome FROM firsts)"
KEPT = OUTCOME + ", kept AS (SELECT * FROM det WHERE det_id NOT IN (SELECT matched FROM outcomes WHERE outcome = 'dropped'))"
NMS = "ranked AS (SELECT *, row_number() OVER (PARTITION BY image, class_id ORDER BY confidence DESC, det_id) AS rk FROM det)"


def _regions(*rows: str) -> str:
    return "(SELECT r_regionkey, unnest(generate_series(0, " + str(len(rows) - 1) + ")) AS k, unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in rows) + "]) AS raw FROM region)"


def _manifest() -> str:
    from quarry.plans.queries import _MANIFESTS

    return _regions(*_MANIFESTS)


LI, DET, SEC = "curve_li", "det", "section"
SQL = {
    "curve_threshold_segments": with_views("curve_ev", f"WITH hits AS (SELECT *, idx - row_number() OVER (PARTITION BY well ORDER BY idx) AS k FROM curve_ev WHERE x < 20) SELECT well, {r('min(depth)')} AS depth_top, {r('max(depth)')} AS depth_bottom, {r('max(depth) - min(depth)')} AS thickness, count(*) AS n, {r('avg(x)')} AS mean_value FROM hits GROUP BY well, k HAVING count(*) >= 3"),
    "curve_crossings": with_views("curve_ev", f"WITH p AS (SELECT *, lag(x) OVER (PARTITION BY well ORDER BY idx) AS prev FROM curve_ev) SELECT well, idx, {r('depth')} AS depth, CASE WHEN prev >= 20 THEN 'down' ELSE 'up' END AS direction FROM p WHERE (prev >= 20 AND x < 20) OR (prev < 20 AND x >= 20)"),
    "sand_intervals": with_views(LI, f"WITH {CROSS} SELECT well, {r('depth_top')} AS depth_top, {r('depth_bottom')} AS depth_bottom FROM sands"),
    "curve_gradient_z": with_views(LI, f"WITH {GRAD} SELECT well, idx, {r('g')} AS g, {r('z')} AS z FROM zs WHERE z > 2"),
    "curve_changepoints": with_views(LI, f"WITH {segments(3)} SELECT well, start_idx, end_idx, {r('depth_top')} AS depth_top, {r('depth_bottom')} AS depth_bottom, {r('gr_mean')} AS gr_mean, {r('den_mean')} AS den_mean, {r('rt_mean')} AS rt_mean, lithology, {r('confidence')} AS confidence FROM segs"),
    "litho_classify": with_views(LI, f"SELECT lithology, {r('confidence')} AS confidence, count(*) AS n, {r('avg(gr)')} AS gr_mean FROM (SELECT gr, {NAME} AS lithology, {CONF} AS confidence FROM curve_li) GROUP BY lithology, confidence"),
    "fluid_zones": with_views(
        LI,
        "WITH h AS (SELECT well, idx, CASE WHEN coalesce(idx - lag(idx) OVER (PARTITION BY well ORDER BY idx), 4) > 3 THEN 1 ELSE 0 END AS brk FROM curve_li WHERE rt > 15), hk AS (SELECT *, sum(brk) OVER (PARTITION BY well ORDER BY idx) AS k FROM h), z AS (SELECT well, min(idx) AS a, max(idx) AS b FROM hk GROUP BY well, k HAVING max(idx) - min(idx) >= 2), m AS (SELECT z.well, z.a, min(depth) AS depth_top, max(depth) AS depth_bottom, round(avg(rt), 9) AS rt_mean, round(avg(den), 9) AS den_mean, round(avg(cnl), 9) AS cnl_mean FROM z JOIN curve_li c ON c.well = z.well AND c.idx BETWEEN z.a AND z.b GROUP BY z.well, z.a)"
        f" SELECT well, {r('depth_top')} AS depth_top, {r('depth_bottom')} AS depth_bottom, CASE WHEN rt_mean > 50 AND den_mean < 2.35e0 THEN 'gas' WHEN rt_mean > 20 AND den_mean < 2.4e0 THEN 'oil' WHEN rt_mean > 15 AND den_mean < 2.4e0 THEN 'oil_water' ELSE 'water' END AS fluid, {r('CASE WHEN rt_mean > 50 AND den_mean < 2.35e0 THEN 0.85e0 WHEN rt_mean > 20 AND den_mean < 2.4e0 THEN 0.8e0 WHEN rt_mean > 15 AND den_mean < 2.4e0 THEN 0.65e0 WHEN rt_mean < 5 THEN 0.85e0 ELSE 0.6e0 END')} AS confidence, {r('rt_mean')} AS rt_mean, {r('den_mean')} AS den_mean, {r('cnl_mean')} AS cnl_mean, ['RT=' || printf('%.1f', {r('rt_mean', 1)}) || 'Ohm·m (>15=potential pay)', 'DEN=' || printf('%.3f', {r('den_mean', 3)}) || 'g/cm³', 'CNL=' || printf('%.3f', {r('cnl_mean', 3)})] AS evidence FROM m",
    ),
    "fluid_two_stage": with_views(LI, "SELECT well, CASE WHEN rt > 20 AND den < 2.35e0 THEN 'gas' WHEN rt > 20 THEN 'oil' WHEN rt < 5 THEN 'water' ELSE 'unknown' END AS fluid, count(*) AS n FROM curve_li GROUP BY ALL"),
    "merge_adjacent_fold": with_views(
        LI,
        f"WITH RECURSIVE {segments(2)}, o AS (SELECT *, gr_mean AS mean_value, row_number() OVER (PARTITION BY well ORDER BY depth_top, depth_bottom, lithology, gr_mean) AS n FROM segs), f AS (SELECT well, n, depth_top, depth_bottom, lithology, mean_value, 1 AS g FROM o WHERE n = 1 UNION ALL SELECT o.well, o.n, CASE WHEN o.lithology = f.lithology AND o.depth_top - f.depth_bottom <= 5 THEN f.depth_top ELSE o.depth_top END, o.depth_bottom, o.lithology, CASE WHEN o.lithology = f.lithology AND o.depth_top - f.depth_bottom <= 5 THEN (f.mean_value + o.mean_value) / 2 ELSE o.mean_value END, CASE WHEN o.lithology = f.lithology AND o.depth_top - f.depth_bottom <= 5 THEN f.g ELSE f.g + 1 END FROM f JOIN o ON o.well = f.well AND o.n = f.n + 1)"
        f" SELECT well, {r('depth_top')} AS depth_top, {r('depth_bottom')} AS depth_bottom, lithology, {r('mean_value')} AS mean_value FROM (SELECT *, row_number() OVER (PARTITION BY well, g ORDER BY n DESC) AS q FROM f) WHERE q = 1",
    ),
    "merge_adjacent_islands": with_views(LI, f"WITH {segments(2)}, j AS (SELECT *, CASE WHEN lithology = lag(lithology) OVER w AND depth_top - lag(depth_bottom) OVER w < 3 THEN 0 ELSE 1 END AS brk FROM segs WINDOW w AS (PARTITION BY well ORDER BY depth_top)), k AS (SELECT *, sum(brk) OVER (PARTITION BY well ORDER BY depth_top ROWS UNBOUNDED PRECEDING) AS g FROM j) SELECT well, lithology, {r('min(depth_top)')} AS depth_top, {r('max(depth_bottom)')} AS depth_bottom, {r('max(confidence)')} AS confidence, count(*) AS n_merged FROM k GROUP BY well, g, lithology"),
    "welllog_windows": with_views(
        LI,
        "WITH ns AS (SELECT well, count(*) AS n FROM curve_li GROUP BY well), st AS (SELECT well, unnest(generate_series(0, n - 21, 10)) AS start_idx FROM ns WHERE n > 20), e AS (SELECT c.*, start_idx, abs(coalesce((lead(gr) OVER w - lag(gr) OVER w) / 2, lead(gr) OVER w - gr, gr - lag(gr) OVER w, 0e0)) AS g FROM curve_li c JOIN st ON c.well = st.well AND c.idx BETWEEN start_idx AND start_idx + 19 WINDOW w AS (PARTITION BY c.well, start_idx ORDER BY idx)), f AS (SELECT well, start_idx, min(depth) AS depth_top, max(depth) AS depth_bottom, round(avg(gr), 9) AS gr_mean, stddev_pop(gr) AS gr_std, round(avg(rt), 9) AS rt_mean, round(avg(den), 9) AS den_mean, round(avg(cnl), 9) AS cnl_mean, avg(g) AS gr_slope FROM e GROUP BY well, start_idx HAVING max(depth) >= 1005 AND min(depth) <= 1070)"
        f", l AS (SELECT *, {WNAME} AS lithology FROM f) SELECT well, start_idx, {r('depth_top')} AS depth_top, {r('depth_bottom')} AS depth_bottom, {r('gr_mean')} AS gr_mean, {r('gr_std')} AS gr_std, {r('rt_mean')} AS rt_mean, {r('den_mean')} AS den_mean, {r('cnl_mean')} AS cnl_mean, {r('gr_slope')} AS gr_slope, {r('depth_bottom - depth_top')} AS thickness, {r('rt_mean / greatest(den_mean, 1e-8)')} AS rt_den, lithology, CASE WHEN lithology = 'clean_sandstone' AND rt_mean >= 50 AND den_mean <= 2.35e0 AND cnl_mean <= 0.2e0 THEN 'gas' WHEN lithology = 'clean_sandstone' AND rt_mean >= 20 AND den_mean <= 2.42e0 THEN 'oil' WHEN lithology = 'clean_sandstone' AND rt_mean <= 8 THEN 'water' WHEN lithology = 'silty_sandstone' AND rt_mean >= 15 AND den_mean <= 2.45e0 THEN 'oil' WHEN lithology = 'silty_sandstone' AND rt_mean <= 10 THEN 'water' END AS fluid FROM l",
    ),
    "rule_parse": r"WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 60)::DOUBLE AS x, CASE WHEN l_partkey % 13 = 0 THEN 'none' WHEN l_partkey % 11 = 0 THEN 'GR<-5' ELSE ['GR<' || q, 'RT > ' || q, 'DEN <= ' || q || '.5', q || '<GR<1' || q, 'CNL>=' || q || ' AND DEN<2.35'][l_suppkey % 5 + 1] END AS rule FROM (SELECT *, l_quantity::INT::VARCHAR AS q FROM lineitem)), p AS (SELECT *, regexp_extract(rule, '^\s*(\w+)\s*(<=|>=|<|>)\s*([0-9.]+)', ['v', 'o', 'n']) AS m, regexp_extract(rule, '^\s*([0-9.]+)\s*<\s*(\w+)\s*<\s*([0-9.]+)', ['a', 'v', 'b']) AS b FROM t) SELECT l_orderkey, l_linenumber, l_partkey, rule, CASE WHEN try_cast(m.n AS DOUBLE) IS NOT NULL THEN m.v END AS variable, CASE WHEN try_cast(m.n AS DOUBLE) IS NOT NULL THEN m.o END AS op, try_cast(m.n AS DOUBLE) AS threshold, CASE WHEN b.v <> '' THEN try_cast(b.a AS DOUBLE) < x AND x < try_cast(b.b AS DOUBLE) WHEN m.o = '<' THEN x < try_cast(m.n AS DOUBLE) WHEN m.o = '>' THEN x > try_cast(m.n AS DOUBLE) WHEN m.o = '<=' THEN x <= try_cast(m.n AS DOUBLE) WHEN m.o = '>=' THEN x >= try_cast(m.n AS DOUBLE) ELSE false END AS holds FROM p",
    "depth_ranges": "SELECT o_orderkey, 0 AS pos, o_orderkey::DOUBLE AS top, o_orderkey + 50e0 AS bottom FROM orders WHERE o_custkey % 6 < 5",
    "parse_scales": "SELECT o_orderkey, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS scale FROM (SELECT o_orderkey, list_filter(list_transform(string_split(o_orderkey || ', ' || o_orderpriority || ', ' || o_custkey || '.5 ', ','), lambda x: try_cast(trim(x) AS DOUBLE)), lambda x: x IS NOT NULL) AS l FROM orders)",
    "nearest_sample": with_views("curve_ev", "SELECT well, t, idx FROM (SELECT well, t, idx, row_number() OVER (PARTITION BY well, t ORDER BY abs(depth - t), idx) AS n FROM curve_ev JOIN (VALUES (1001e0), (1003.37e0), (1010.5e0)) v(t) ON abs(depth - t) < 1) WHERE n = 1"),
    "interval_recall": with_views("curve_li gt", f"WITH {CROSS} SELECT gt_id, well, max((depth_top <= (gt_top + gt_bottom) / 2 AND (gt_top + gt_bottom) / 2 <= depth_bottom)::INT) AS holds_middle FROM sands JOIN gt ON depth_top <= gt_bottom AND depth_bottom >= gt_top GROUP BY gt_id, well"),
    "labelled_hits": with_views("curve_li gt", f"WITH {CROSS} SELECT gt_id, well, count(*) AS n FROM sands JOIN gt ON (gt_top + gt_bottom) / 2 BETWEEN depth_top AND depth_bottom AND well % 2 = substr(gt_id, 2, 1)::INT % 2 GROUP BY gt_id, well"),
    "tolerance_match": with_views("curve_li gt", f"WITH {CROSS} SELECT well, gt_id, {r('depth_top')} AS depth_top, {r('abs(depth_top - gt_top)')} AS off FROM sands JOIN gt ON abs(depth_top - gt_top) < 3"),
    "eval_summary": f"SELECT source, count(*) AS runs, {r('avg(quality)')} AS pass_rate, {r('stddev_pop(quality)')} AS pass_std, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS clean, {r('avg(0.7e0 * quality + 0.3e0 * (1 - toxic))')} AS score FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "geom_pixel_to_data": with_views(DET, f"WITH p AS (SELECT det_id, 0e0 + x1 * 1000 / 1000e0 * 300e0 AS a, 0e0 + x2 * 1000 / 1000e0 * 300e0 AS b, 2500e0 + y1 * 500 / 500e0 * -2500e0 AS c, 2500e0 + y2 * 500 / 500e0 * -2500e0 AS d FROM det) SELECT det_id, {r('least(a, b)')} AS cdp_min, {r('greatest(a, b)')} AS cdp_max, {r('least(c, d)')} AS time_min, {r('greatest(c, d)')} AS time_max FROM p"),
    "geom_data_to_pixel": with_views(DET, f"SELECT det_id, {r('x1 * 300 / 300e0 * 1000e0')} AS px, {r('y1 * 2500 / 2500e0 * 500e0')} AS py, {r('0e0')} AS flat FROM det"),
    "bbox_iou": with_views(DET, f"SELECT a.det_id, b.det_id AS other, {r(iou('a', 'b'))} AS iou FROM det a JOIN det b ON a.image = b.image AND a.class_id = b.class_id AND a.det_id < b.det_id WHERE {iou('a', 'b')} > 0.2"),
    "det_tag": with_views(DET, "SELECT det_id, image AS step, CASE WHEN det_id % 3 = 0 THEN det_id::VARCHAR ELSE 'model_s' || image || '_i' || (row_number() OVER (PARTITION BY image ORDER BY det_id) - 1) END AS tag FROM det"),
    "det_normalize": with_views(
        DET,
        "WITH k AS (SELECT *, det_id % 5 AS k, CASE WHEN det_id % 2 = 0 THEN confidence ELSE 0.5e0 END AS conf, greatest(sqrt(CASE WHEN det_id % 2 = 0 THEN 400 ELSE 100 END) / 2, 2e0) AS h FROM det WHERE det_id % 5 < 4), b AS (SELECT det_id, k, class_id, conf, CASE k WHEN 0 THEN [x1, y1, x2, y2] WHEN 1 THEN [x1 * 1000 / 1000e0, y1 * 500 / 500e0, x2 * 1000 / 1000e0, y2 * 500 / 500e0] WHEN 2 THEN [least(floor(x1 * 1000), floor(x2 * 1000)) / 1000e0, least(floor(y1 * 500), floor(y2 * 500)) / 500e0, greatest(floor(x1 * 1000), floor(x2 * 1000)) / 1000e0, greatest(floor(y1 * 500), floor(y2 * 500)) / 500e0] ELSE [greatest(0e0, x1 * 1000 - h) / 1000e0, greatest(0e0, y1 * 500 - h) / 500e0, least(1000e0, x1 * 1000 + h) / 1000e0, least(500e0, y1 * 500 + h) / 500e0] END AS bx FROM k)"
        f" SELECT det_id, CASE k WHEN 0 THEN 'fault' WHEN 1 THEN 'seg' WHEN 2 THEN 'H1' ELSE 'cluster_' || class_id END AS class_name, {r('conf')} AS confidence, {r('bx[1]')} AS x1, {r('bx[2]')} AS y1, {r('bx[3]')} AS x2, {r('bx[4]')} AS y2 FROM b",
    ),
    "det_to_json": with_views(DET, """SELECT image, '{"id":' || det_id || ',"class":' || class_id || ',"time_ms":' || round(0e0 + y1 * 500 / 500e0 * 2500e0)::INT || '}' AS json FROM det"""),
    "dedup_by_id": with_views(DET, f"WITH k AS (SELECT *, CASE WHEN det_id % 11 <> 0 THEN det_id % 97 END AS key FROM det) SELECT det_id, coalesce(key, -1) AS key, {r('confidence')} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY confidence DESC, det_id) AS n FROM k) WHERE n = 1 OR key IS NULL"),
    "fp_match_iou": with_views("det ver", f"WITH {MATCH} SELECT ver_id, matched, {r('iou')} AS iou FROM matched"),
    "fp_filter": with_views("det ver", f"WITH {OUTCOME} SELECT ver_id, matched, outcome FROM outcomes"),
    "fp_survivors": with_views("det ver", f"WITH {KEPT} SELECT image, count(*) AS n FROM kept GROUP BY image"),
    "nms_greedy": with_views(
        DET,
        f"WITH RECURSIVE {NMS}, f AS (SELECT image, class_id, rk, [{{'det_id': det_id, 'confidence': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM ranked WHERE rk = 1 UNION ALL SELECT x.image, x.class_id, x.rk, CASE WHEN len(list_filter(f.kept, lambda k: {iou('k', 'x')} > 0.3)) > 0 THEN f.kept ELSE list_append(f.kept, {{'det_id': x.det_id, 'confidence': x.confidence, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2}}) END FROM f JOIN ranked x ON x.image = f.image AND x.class_id = f.class_id AND x.rk = f.rk + 1), done AS (SELECT image, class_id, unnest(arg_max(kept, rk)) AS k FROM f GROUP BY image, class_id) SELECT image, class_id, k.det_id AS det_id, {r('k.confidence')} AS confidence FROM done",
    ),
    "nms_antijoin": with_views(DET, f"SELECT image, class_id, det_id, {r('confidence')} AS confidence FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE b.image = a.image AND b.class_id = a.class_id AND (b.confidence > a.confidence OR (b.confidence = a.confidence AND b.det_id < a.det_id)) AND {iou('a', 'b')} > 0.3)"),
    "volume_paint": with_views(DET, f"WITH c AS (SELECT *, unnest(generate_series({cell('x1', 20)}, greatest({cell('x1', 20)}, {cell('x2', 20)}))) AS x FROM det WHERE det_id % 13 <> 0), d AS (SELECT *, unnest(generate_series({cell('y1', 50)}, greatest({cell('y1', 50)}, {cell('y2', 50)}))) AS y FROM c) SELECT class_id, image, x, y, {r('max(confidence)')} AS confidence FROM d GROUP BY class_id, image, x, y"),
    "slice_mask": with_views(DET, f"WITH c AS (SELECT *, unnest(generate_series({cell('x1', 20)}, greatest({cell('x1', 20)}, {cell('x2', 20)}))) AS x FROM det), d AS (SELECT *, unnest(generate_series({cell('y1', 50)}, greatest({cell('y1', 50)}, {cell('y2', 50)}))) AS y FROM c) SELECT image, x, y, {r('arg_max(greatest(confidence, 0.25e0), det_id)')} AS confidence FROM d GROUP BY image, x, y"),
    "step_image_join": "SELECT n_nationkey, coalesce(r_name, (SELECT arg_min(r_name, r_regionkey) FROM region WHERE r_regionkey < 3)) AS image, r_name IS NULL AS fallback FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey",
    "task_hint": "WITH a(k, cls, task) AS (VALUES (0, 'fault','fault'),(1, 'horizon','horizon'),(2, 'facies','facies'),(3, 'fracture','fracture'),(4, 'channel','facies'),(5, 'reservoir_candidate','facies'),(6, '断层','fault'),(7, '层位','horizon'),(8, '沉积相','facies'),(9, '裂缝','fracture'),(10, 'salt',NULL)), m(task, model) AS (VALUES ('fault','cig_fault'),('horizon','horizon_tracker'),('facies','facies_classifier'),('fracture','seismic_domain_model')) SELECT vec_id AS det_id, cls, a.task, coalesce(cls || ' -> ' || model, cls) AS hint FROM embeddings JOIN a ON vec_id % 11 = k LEFT JOIN m ON a.task = m.task",
    "tokenize": f"SELECT doc_id, count(*) AS n_tokens, count(DISTINCT t) AS n_terms, min(t) AS first, max(t) AS last FROM (SELECT doc_id, unnest({TOKENS.format(t='text')}) AS t FROM documents) GROUP BY doc_id",
    "tfidf_topk": f"WITH {TFIDF} SELECT query_id, doc_id, {r('score', 6)} AS score, rank FROM ranked WHERE rank <= 3",
    "keyword_route": f"WITH {ROUTED.split(', parts(')[0]} SELECT DISTINCT doc_id AS query_id, doc_name FROM documents JOIN kw ON contains(lower(text), keyword)",
    "hybrid_retrieve": f"WITH {TFIDF}, {ROUTED}, u AS (SELECT query_id, doc_name AS doc, 0 AS src, row_number() OVER (PARTITION BY query_id ORDER BY doc_name) AS rank FROM routed UNION ALL SELECT query_id, doc_id::VARCHAR, 1, rank FROM ranked WHERE rank <= 5), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, rank, doc) AS place FROM u) SELECT query_id, doc, src, place FROM p WHERE place <= 3",
    "knowledge_text": f"WITH {TFIDF}, {ROUTED}, u AS (SELECT query_id, doc_name AS doc, 0 AS src, row_number() OVER (PARTITION BY query_id ORDER BY doc_name) AS rank FROM routed UNION ALL SELECT query_id, doc_id::VARCHAR, 1, rank FROM ranked WHERE rank <= 5), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, rank, doc) AS place FROM u), e AS (SELECT query_id, place, doc, text FROM p LEFT JOIN documents ON doc_id::VARCHAR = doc WHERE place <= 3), f AS (SELECT query_id, string_agg('--- ' || doc || ' ---' || chr(10) || CASE WHEN length(text) > 1500 THEN substring(text, 1, 1500) || chr(10) || '...(截断)' ELSE text END || chr(10), chr(10) ORDER BY place, doc) FILTER (WHERE length(text) > 0) AS parts FROM e GROUP BY query_id) SELECT query_id, chr(10) || '=== 领域知识参考 (RAG检索) ===' || chr(10) || coalesce(chr(10) || parts, '') AS knowledge FROM f",
    "message_explode": "SELECT conv_id, count(*) AS n, arg_min(text, turn) AS first_text FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "section_extract": r"SELECT doc_id, length(body) AS n_chars, md5(body) AS body, md5(text) AS fallback FROM (SELECT doc_id, text, regexp_replace(string_split(text || chr(10) || chr(10) || '## Next', chr(10) || '## ')[1], '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS body FROM documents)",
    "manifest_slim": "SELECT p_partkey, 'p' || p_partkey AS sample_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS task, array_to_string(list_sort(CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 1 THEN [p_type] ELSE [] END WHEN 1 THEN CASE WHEN p_size % 2 = 1 THEN ['GR', p_type] ELSE ['GR'] END ELSE [] END), ',') AS curves FROM part",
    "run_report": with_views(DET, "SELECT image, count(*) AS n, array_to_string(list_sort(list(DISTINCT 'model_' || class_id)), ',') AS models FROM det GROUP BY image"),
    "json_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k, true AS found FROM events",
    "plan_validate": "WITH p AS (SELECT n_nationkey, ['traditional_code','horizon_tracker','attribute_extractor','sam','other'][n_nationkey % 5 + 1] AS model, CASE WHEN n_nationkey % 2 = 0 THEN ['rules','seed_points'] WHEN n_nationkey % 3 = 0 THEN ['attributes'] ELSE [] END AS has FROM nation), q AS (SELECT *, CASE model WHEN 'traditional_code' THEN 'rules' WHEN 'horizon_tracker' THEN 'seed_points' WHEN 'attribute_extractor' THEN 'attributes' WHEN 'sam' THEN 'prompt_value' END AS need FROM p) SELECT n_nationkey, model, CASE WHEN need IS NOT NULL AND NOT list_contains(has, need) THEN need END AS missing FROM q",
    "schema_validate": "SELECT vec_id AS det_id, [NULL, 'bbox: 4 numbers', 'confidence: 0 to 1', 'kind: fault or horizon', '$: not JSON'][vec_id % 5 + 1] AS error FROM embeddings",
    "apply_retry": "SELECT n_nationkey, '1' AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS b, CASE WHEN n_nationkey % 2 = 0 THEN '3' END AS c FROM nation",
    "section_normalize": with_views(SEC, f"WITH t AS (SELECT il, avg(amp) AS mu, stddev_pop(amp) AS sd, min(amp) AS lo, max(amp) AS hi FROM section GROUP BY il), b AS (SELECT il, greatest(mu - 2 * CASE WHEN sd = 0 THEN 1e0 ELSE sd END, lo) AS low, least(mu + 2 * CASE WHEN sd = 0 THEN 1e0 ELSE sd END, hi) AS high FROM t), v AS (SELECT il, s, CASE WHEN high > low THEN 2 * (least(greatest(amp, low), high) - low) / (high - low) - 1 ELSE 0e0 END AS value FROM section JOIN b USING (il)) SELECT il, s, {r('avg(value)')} AS mean_value, {r('min(value)')} AS lo, {r('max(value)')} AS hi FROM v GROUP BY il, s"),
    "attr_stats": with_views(SEC, f"SELECT il, {STATS} FROM section WHERE isfinite(amp) GROUP BY il"),
    "attr_stats_roi": with_views(SEC, f"WITH n AS (SELECT il, max(trace) + 1 AS nt FROM section GROUP BY il) SELECT il, {STATS} FROM section JOIN n USING (il) WHERE trace BETWEEN trunc(least(greatest(0.1e0 * nt, 0), nt - 1)) AND trunc(least(greatest(0.6e0 * nt, 0), nt - 1)) AND s BETWEEN trunc(0.2e0 * 64) AND trunc(0.7e0 * 64) GROUP BY il"),
    "grad_density": with_views(SEC, f"WITH d AS (SELECT il, (abs(amp - lag(amp) OVER (PARTITION BY il, trace ORDER BY s)) > 0.2)::INT AS v, (abs(amp - lag(amp) OVER (PARTITION BY il, s ORDER BY trace)) > 0.2)::INT AS h FROM section) SELECT il, {r('(avg(v) + avg(h)) / 2')} AS density, (avg(v) + avg(h)) / 2 > 0.02 AS natural_image FROM d GROUP BY il"),
    "moving_rms": with_views(SEC, f"WITH m AS ({mirror('il, trace, amp', 'section', 7, 7)}), a AS (SELECT il, trace, s, own, sqrt(avg(amp * amp) OVER (PARTITION BY il, trace ORDER BY s ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) AS rms FROM m) SELECT il, trace, s, {r('rms')} AS rms FROM a WHERE own"),
    "trace_coherence": with_views(
        SEC,
        f"WITH m AS ({mirror('il, trace, amp', 'section', 1, 1)}), sm0 AS (SELECT il, trace, s, own, avg(amp) OVER (PARTITION BY il, trace ORDER BY s ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM m), sm AS (SELECT il, trace, s, a FROM sm0 WHERE own), pr AS (SELECT x.il, x.trace, x.s, x.a, y.a AS b FROM sm x JOIN sm y ON x.il = y.il AND x.trace + 1 = y.trace AND x.s = y.s), pm AS ({mirror('il, trace, a, b', 'pr', 4, 4)}), sim AS (SELECT il, trace, s, own, least(1e0, greatest(0e0, avg(a * b) OVER w / (sqrt(avg(a * a) OVER w * avg(b * b) OVER w) + 1e-8))) AS sim FROM pm WINDOW w AS (PARTITION BY il, trace ORDER BY s ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)), al AS (SELECT il, trace, s, sim FROM sim WHERE own UNION ALL SELECT il, trace + 1, s, sim FROM sim WHERE own UNION ALL SELECT il, trace, s, 1e0 FROM sm) SELECT il, trace, s, {r('min(sim)')} AS coherence, {r('1 - min(sim)')} AS fault_probability FROM al GROUP BY il, trace, s",
    ),
    "local_variance": with_views(
        SEC,
        f"WITH m AS ({mirror('il, trace, amp', 'section', 4, 4)}), c0 AS (SELECT il, trace, s, own, avg(amp) OVER w AS m, avg(amp * amp) OVER w AS q FROM m WINDOW w AS (PARTITION BY il, trace ORDER BY s ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)), c AS (SELECT c0.il, trace, s, m, q, nt FROM c0 JOIN (SELECT il, max(trace) + 1 AS nt FROM section GROUP BY il) n ON c0.il = n.il WHERE own), w AS (SELECT il, trace, s, m, q, true AS own FROM c UNION ALL SELECT il, -1 - trace, s, m, q, false FROM c WHERE trace < 4 UNION ALL SELECT il, 2 * nt - 1 - trace, s, m, q, false FROM c WHERE trace >= nt - 4), o AS (SELECT il, trace, s, own, avg(m) OVER v AS mm, avg(q) OVER v AS qq FROM w WINDOW v AS (PARTITION BY il, s ORDER BY trace ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) SELECT il, trace, s, {r('greatest(0e0, qq - mm * mm)', 5)} AS variance FROM o WHERE own",
    ),
    "sobel_magnitude": with_views(SEC, f"WITH a AS (SELECT il, trace, s, coalesce(lag(amp) OVER w, amp) + 2 * amp + coalesce(lead(amp) OVER w, amp) AS sm, coalesce(lead(amp) OVER w, amp) - coalesce(lag(amp) OVER w, amp) AS df FROM section WINDOW w AS (PARTITION BY il, trace ORDER BY s)), b AS (SELECT il, trace, s, coalesce(lead(sm) OVER v, sm) - coalesce(lag(sm) OVER v, sm) AS gx, coalesce(lag(df) OVER v, df) + 2 * df + coalesce(lead(df) OVER v, df) AS gy FROM a WINDOW v AS (PARTITION BY il, s ORDER BY trace)) SELECT il, trace, s, {r('sqrt(gx * gx + gy * gy)')} AS gradient FROM b"),
    "glcm": with_views(
        SEC,
        "WITH lim AS (SELECT il, min(amp) AS lo, max(amp) AS hi FROM section GROUP BY il), g AS (SELECT il, trace, s, CASE WHEN hi - lo < 1e-8 THEN 0 ELSE trunc((amp - lo) / (hi - lo) * 15)::INT END AS q FROM section JOIN lim USING (il)), o(k, dx, dy) AS (VALUES (0,1,0),(1,2,0),(2,1,1),(3,2,2),(4,0,1),(5,0,2),(6,-1,1),(7,-2,2)), p AS (SELECT a.il, k, a.q AS i, b.q AS j FROM g a CROSS JOIN o JOIN g b ON b.il = a.il AND b.trace = a.trace + dx AND b.s = a.s + dy), c AS (SELECT il, k, i, j, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT il, k, j, i FROM p) GROUP BY il, k, i, j), w AS (SELECT *, n / sum(n) OVER (PARTITION BY il, k)::DOUBLE AS p FROM c), m AS (SELECT il, k, sqrt(sum(p * p)) AS energy, sum(p * (i - j) * (i - j)) AS contrast, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * i) AS mi, sum(p * i * i) AS mii, sum(p * i * j) AS mij FROM w GROUP BY il, k), f AS (SELECT *, CASE WHEN mii - mi * mi < 1e-15 THEN 1e0 ELSE (mij - mi * mi) / (mii - mi * mi) END AS correlation FROM m)"
        f" SELECT il, {r('avg(energy)')} AS energy, {r('avg(contrast)')} AS contrast, {r('avg(homogeneity)')} AS homogeneity, {r('avg(correlation)')} AS correlation FROM f GROUP BY il",
    ),
    "prob_threshold": with_views(SEC, f"WITH {PROB}, c AS (SELECT il, quantile_cont(p, 0.95) AS cut FROM prob GROUP BY il) SELECT il, count(*) AS n, {r('min(p)')} AS lo, {r('avg(p)')} AS mean_p FROM prob JOIN c USING (il) WHERE p >= cut GROUP BY il"),
    "connected_components": with_views(SEC, f"WITH RECURSIVE {PROB}, {COMP} SELECT il, region, count(*) AS area FROM labelled GROUP BY il, region"),
    "region_stats": with_views(SEC, f"WITH RECURSIVE {PROB}, {COMP}, g AS (SELECT il, region, count(*) AS area, min(trace) AS x1, max(trace) AS x2, min(s) AS y1, max(s) AS y2, avg(p) AS m FROM labelled GROUP BY il, region HAVING count(*) >= 5), d AS (SELECT *, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h FROM g) SELECT il, region, area, x1, x2, y1, y2, {r('greatest(w, h) / (least(w, h) + 1)::DOUBLE')} AS aspect, {r('m * CASE WHEN h > 3 * w OR w > 3 * h THEN 1e0 WHEN h > 2 * w OR w > 2 * h THEN 0.8e0 ELSE 0.5e0 END')} AS confidence FROM d"),
    "mask_stats": with_views(SEC, f"WITH t AS (SELECT il, avg(amp) AS mu, stddev_pop(amp) AS sd FROM section GROUP BY il) SELECT il, count(*) AS area, min(trace) AS x1, max(trace) AS x2, min(s) AS y1, max(s) AS y2, {r('avg(trace)')} AS cx, {r('avg(s)')} AS cy FROM section JOIN t USING (il) WHERE sd < 1e-8 OR amp > mu + 0.5e0 * sd GROUP BY il"),
    "flood_fill": with_views(SEC, "WITH RECURSIVE seed AS (SELECT il, amp AS v FROM section WHERE trace = 3 AND s = 20), close AS (SELECT x.il, trace, s FROM section x JOIN seed USING (il) WHERE abs(amp - v) <= 0.08e0), fill(il, trace, s) AS (SELECT il, 3::BIGINT, 20::BIGINT FROM seed UNION SELECT c.il, c.trace, c.s FROM fill f JOIN close c ON c.il = f.il AND abs(c.trace - f.trace) + abs(c.s - f.s) = 1) SELECT il, count(*) AS area, min(trace) AS x1, max(trace) AS x2, min(s) AS y1, max(s) AS y2 FROM fill GROUP BY il"),
    "slice_extract": with_views(SEC, f"SELECT il, trace, 64 AS n, s, {r('amp')} AS amp FROM section"),
    "slice_stride": "SELECT DISTINCT label AS il, task FROM embeddings, (VALUES ('fault'), ('horizon'), ('facies'), ('fracture')) v(task) WHERE label % 5 = 0",
    "volume_metadata": "SELECT min(label) AS il_min, max(label) AS il_max, count(*) AS n_traces, max(len(embedding)) AS n_samples, max(len(embedding)) * 4e0 AS length_ms FROM embeddings",
    "zscore_features": "SELECT vec_id, " + ", ".join(f"{r(f'(embedding[{i + 1}]::DOUBLE - avg(embedding[{i + 1}]::DOUBLE) OVER ()) / (stddev_pop(embedding[{i + 1}]::DOUBLE) OVER () + 1e-8)')} AS f{i}" for i in range(64)) + " FROM embeddings",
    "cluster_profile": "WITH z AS (SELECT label, " + ", ".join(f"(embedding[{i + 1}]::DOUBLE - avg(embedding[{i + 1}]::DOUBLE) OVER ()) / (stddev_pop(embedding[{i + 1}]::DOUBLE) OVER () + 1e-8) AS f{i}" for i in range(64)) + " FROM embeddings), m AS (SELECT label, count(*) AS area, " + ", ".join(f"avg(f{i}) AS f{i}" for i in range(64)) + " FROM z GROUP BY label HAVING count(*) >= 10), b AS (SELECT *, [" + ", ".join(f"abs(f{i})" for i in range(64)) + "] AS l FROM m) SELECT label, area, " + ", ".join(f"{r(f'f{i}')} AS f{i}" for i in range(64)) + ", 'f' || (list_position(l, list_max(l)) - 1) AS dominant FROM b",
    "horizon_seed": with_views(SEC, "SELECT il, trace, arg_min(s, -amp) AS seed, arg_min(s, amp) AS trough FROM section WHERE s BETWEEN 26 AND 34 GROUP BY il, trace"),
    "horizon_quality": with_views(SEC, f"WITH p AS (SELECT il, trace, arg_max(s, abs(amp)) AS seed FROM section WHERE s BETWEEN 0 AND 64 GROUP BY il, trace), t AS (SELECT il, trace, seed / 64e0 AS confidence, (trace - lag(trace) OVER (PARTITION BY il ORDER BY trace) > 1)::INT AS gap FROM p WHERE seed < 32) SELECT il, count(*) AS n_points, {r('1 / (1 + coalesce(avg(gap), 0))')} AS continuity, {r('avg(confidence)')} AS confidence FROM t GROUP BY il"),
    "closed_loop": with_views("det ver", f"WITH found AS (SELECT * FROM det WHERE confidence >= 0.3), {OUTCOME.replace('JOIN det d', 'JOIN found d')}, u AS (SELECT class_id AS step, 0.3e0 AS least, confidence FROM found WHERE class_id > 0 AND det_id NOT IN (SELECT matched FROM outcomes WHERE outcome = 'dropped') UNION ALL SELECT 0, 0.2e0, confidence FROM det WHERE class_id = 0 AND confidence >= 0.2) SELECT step, {r('least')} AS least, count(*) AS n, {r('avg(confidence)')} AS mean_confidence FROM u GROUP BY step, least"),
    "tumbling_counts": f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, {r('sum(value)', 2)} AS total FROM events GROUP BY ALL",
    "latest_rounds": f"SELECT user_id, count(*) AS n, {r('sum(value)', 2)} AS total, max(event_id) AS last_event FROM (SELECT *, max(ts::DATE) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts::DATE = last GROUP BY user_id",
    "stream_runs": f"WITH m AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS mark FROM events), s AS (SELECT user_id, epoch_us(ts) AS us, event_id, value, value >= 50 AS ok, mark FROM events, m WHERE epoch_us(ts) // 1000 < mark), o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS rows, CASE WHEN ok AND coalesce(lag(ok) OVER w, false) AND us // 1000 - lag(us) OVER w // 1000 <= 86400000 THEN 0 ELSE 1 END AS brk FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), k AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY rn) AS run FROM o) SELECT user_id, make_timestamp(min(us)) AS run_start, make_timestamp(max(us)) AS run_end, count(*) AS n, {r('sum(value)', 2)} AS total FROM k WHERE ok GROUP BY user_id, run, rows, mark HAVING count(*) >= 3 AND (max(rn) < rows OR max(us) // 1000 + 86400000 < mark)",
    "gap_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events), k AS (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM k GROUP BY user_id, s) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
}


# --- models and kernels -----------------------------------------------------


def _runs(name: str, cond: str, sure: float, rule: str) -> str:
    return f"SELECT '{name}' AS class_name, well, {r('min(depth)')} AS depth_top, {r('max(depth)')} AS depth_bottom, {r('max(depth) - min(depth)')} AS thickness, {sure}e0 AS confidence, '{rule}' AS rule, NULL::VARCHAR AS result FROM (SELECT *, idx - row_number() OVER (PARTITION BY well ORDER BY idx) AS k FROM curve_li WHERE {cond}) GROUP BY well, k HAVING count(*) >= 3"


SQL["rule_model"] = with_views(LI, " UNION ALL ".join([_runs("high", "gr > 100", 0.9, "GR>100"), _runs("pay", "rt > 20 AND depth BETWEEN 1005 AND 1020", 0.95, "RT>20"), _runs("pay", "rt > 20 AND depth BETWEEN 1030 AND 1040", 0.95, "RT>20"), "SELECT 'blind', NULL, 1e0, 2.5e0, 1.5e0, 0.7e0, 'SP<1', NULL", "SELECT 'odd', NULL, NULL, NULL, NULL, NULL, '50<GR<90', 'no curve data or depth range provided'"]))
SQL["log_model"] = with_views(
    LI,
    f"WITH {segments(3)}, o AS (SELECT *, row_number() OVER w AS n, CASE WHEN lithology = lag(lithology) OVER w AND depth_top - lag(depth_bottom) OVER w <= 5 THEN 0 ELSE 1 END AS brk FROM segs WINDOW w AS (PARTITION BY well ORDER BY depth_top, depth_bottom, lithology, gr_mean)), g AS (SELECT *, sum(brk) OVER (PARTITION BY well ORDER BY n) AS g FROM o)"
    f", merged AS (SELECT well, lithology AS class_name, {r('min(depth_top)')} AS depth_top, {r('arg_max(depth_bottom, n)')} AS depth_bottom, {r('arg_min(confidence, n)')} AS confidence, 'curve_segmentation' AS analysis FROM g GROUP BY well, g, lithology)"
    f" SELECT * FROM merged UNION ALL SELECT well, fluid, {r(r('depth_top', 1))}, {r(r('depth_bottom', 1))}, confidence, 'fluid_identification' FROM ({SQL['fluid_zones']})",
)
#: Hilbert kernel of a length n: the imaginary part of the analytic signal is a circular sum with it.
HILBERT = "kern AS (SELECT n, d, sum(sin(2 * pi() * k * d / n)) * 2 / n AS h FROM (SELECT unnest([{n}]) AS n), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS d), LATERAL (SELECT unnest(generate_series(1, (n + 1) // 2 - 1)) AS k) GROUP BY n, d)"


def fold(i: str, n: str) -> str:
    """A reflected place on an axis of n."""
    m = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END"


def _box(x1: float, y1: float, x2: float, y2: float) -> str:
    at = lambda v, n: f"trunc(least(greatest({v}e0 * {n}, 0), {n} - 1))::INT"
    return f"{at(x1, 'nt')} AS x1, {at(y1, '64')} AS y1, {at(x2, 'nt')} AS x2, {at(y2, '64')} AS y2"


SQL["attribute_model"] = with_views(
    SEC,
    f"WITH {HILBERT.format(n='33, 64')}, nt AS (SELECT il, max(trace) + 1 AS nt FROM section GROUP BY il), box AS (SELECT il, 0 AS ri, {_box(0.1, 0.2, 0.6, 0.7)} FROM nt UNION ALL SELECT il, 2, {_box(0.0, 0.0, 1.0, 1.0)} FROM nt)"
    ", sub AS (SELECT s.il, ri, trace, s - y1 AS j, y2 - y1 + 1 AS n, amp FROM section s JOIN box b ON s.il = b.il AND trace BETWEEN x1 AND x2 AND s BETWEEN y1 AND y2)"
    ", im AS (SELECT a.il, a.ri, a.trace, a.j, any_value(a.amp) AS re, sum(b.amp * h) AS im FROM sub a JOIN sub b ON a.il = b.il AND a.ri = b.ri AND a.trace = b.trace JOIN kern ON kern.n = a.n AND d = ((a.j - b.j) % a.n + a.n) % a.n GROUP BY a.il, a.ri, a.trace, a.j)"
    f", rms AS (SELECT a.il, a.ri, a.trace, a.j, sqrt(sum(b.amp * b.amp) / 15) AS v FROM (SELECT *, unnest(generate_series(-7, 7)) AS o FROM sub) a JOIN sub b ON a.il = b.il AND a.ri = b.ri AND a.trace = b.trace AND b.j = {fold('a.j + o', 'a.n')} GROUP BY a.il, a.ri, a.trace, a.j)"
    ", v AS (SELECT il, ri, 'envelope' AS name, sqrt(re * re + im * im) AS v FROM im UNION ALL SELECT il, ri, 'rms_amplitude', v FROM rms)"
    f" SELECT il, name AS attribute_name, ri AS roi_index, {r(r('min(v)'), 3)} AS lo, {r(r('max(v)'), 3)} AS hi, {r(r('avg(v)'), 3)} AS mean, {r(r('stddev_pop(v)'), 3)} AS std FROM v GROUP BY il, ri, name",
)
SQL["instantaneous"] = with_views(
    SEC,
    f"WITH {HILBERT.format(n='64')}, im AS (SELECT a.il, a.trace, a.s, any_value(a.amp) AS re, sum(b.amp * h) AS im FROM section a JOIN section b ON a.il = b.il AND a.trace = b.trace JOIN kern ON d = ((a.s - b.s) % 64 + 64) % 64 GROUP BY a.il, a.trace, a.s)"
    ", ph AS (SELECT *, sqrt(re * re + im * im) AS env, atan2(im, re) AS ph, atan2(im, re) - lag(atan2(im, re)) OVER (PARTITION BY il, trace ORDER BY s) AS d FROM im)"
    ", f AS (SELECT *, coalesce(abs(d - 2 * pi() * round(d / (2 * pi()))) / (2 * pi()), 0e0) AS f FROM ph)"
    f" SELECT il, s, {r('avg(env)')} AS envelope, {r('avg(cos(ph))')} AS cos_phase, {r('avg(f)')} AS frequency, {r('avg(least(env / sqrt(f + 1e-8), 5e0))')} AS sweetness FROM f GROUP BY il, s",
)
SOBEL = "sa AS (SELECT il, trace, s, coalesce(lag(amp) OVER w, amp) + 2 * amp + coalesce(lead(amp) OVER w, amp) AS sm, coalesce(lead(amp) OVER w, amp) - coalesce(lag(amp) OVER w, amp) AS df FROM section WINDOW w AS (PARTITION BY il, trace ORDER BY s)), sob AS (SELECT il, trace, s, coalesce(lead(sm) OVER v, sm) - coalesce(lag(sm) OVER v, sm) AS gx, coalesce(lag(df) OVER v, df) + 2 * df + coalesce(lead(df) OVER v, df) AS gy FROM sa WINDOW v AS (PARTITION BY il, s ORDER BY trace))"
SIZE = "nt AS (SELECT il, max(trace) + 1 AS nt FROM section GROUP BY il)"


def smooth(out: str, source: str, cols: list[str], weights: str) -> str:
    """Weighted sums along samples, then along traces; ``weights``: a table (o, w)."""
    sums = lambda t: ", ".join(f"sum(w * {t}.{c}) AS {c}" for c in cols)
    return (
        f"{out}_s AS (SELECT a.il, a.trace, a.s, {sums('b')} FROM {source} a CROSS JOIN {weights} JOIN {source} b ON a.il = b.il AND a.trace = b.trace AND b.s = {fold('a.s + o', '64')} GROUP BY a.il, a.trace, a.s)"
        f", {out} AS (SELECT a.il, a.trace, a.s, {sums('b')} FROM {out}_s a JOIN nt ON nt.il = a.il CROSS JOIN {weights} JOIN {out}_s b ON a.il = b.il AND a.s = b.s AND b.trace = {fold('a.trace + o', 'nt')} GROUP BY a.il, a.trace, a.s)"
    )


def gauss(name: str, sigma: float) -> str:
    n = int(4 * sigma + 0.5)
    return f"{name} AS (SELECT o, e / sum(e) OVER () AS w FROM (SELECT o, exp(-0.5e0 * (o / {sigma}e0) * (o / {sigma}e0)) AS e FROM (SELECT unnest(generate_series(-{n}, {n})) AS o)))"


BOX15 = "w15 AS (SELECT unnest(generate_series(-7, 7)) AS o, 1 / 15e0 AS w)"
VAR15 = "q AS (SELECT il, trace, s, {amp} AS a, {amp} * {amp} AS aa FROM {t}), " + smooth("m", "q", ["a", "aa"], "w15") + ", var AS (SELECT il, trace, s, greatest(aa - a * a, 0) AS v FROM m), vmax AS (SELECT il, max(v) AS top FROM var GROUP BY il)"
SQL["fault_kernels"] = with_views(
    SEC,
    f"WITH {SIZE}, {SOBEL}, {gauss('w3', 3.0)}, {gauss('w2', 2.0)}, {BOX15}, gf0 AS (SELECT il, trace, s, greatest(abs(gy) - 0.5e0 * abs(gx), 0) AS v FROM sob), {smooth('gf', 'gf0', ['v'], 'w3')}, gmax AS (SELECT il, max(v) AS top FROM gf GROUP BY il)"
    f", st0 AS (SELECT il, trace, s, gx * gx AS xx, gy * gy AS yy, gx * gy AS xy FROM sob), {smooth('st', 'st0', ['xx', 'yy', 'xy'], 'w2')}, ev AS (SELECT il, trace, s, sqrt(greatest((xx + yy) * (xx + yy) - 4 * (xx * yy - xy * xy), 0)) AS e FROM st), emax AS (SELECT il, max(e) AS top FROM ev GROUP BY il)"
    f", {VAR15.format(amp='amp', t='section')}, a1 AS (SELECT il, trace, avg(v / (top + 1e-8)) AS g FROM gf JOIN gmax USING (il) GROUP BY il, trace), a2 AS (SELECT il, trace, avg(1 - e / (top + 1e-8)) AS t FROM ev JOIN emax USING (il) GROUP BY il, trace), a3 AS (SELECT il, trace, avg(v / (top + 1e-8)) AS v FROM var JOIN vmax USING (il) GROUP BY il, trace)"
    f" SELECT il, trace, {r('g')} AS gradient_fault, {r('v')} AS variance_fault, {r('t')} AS structure_tensor FROM a1 JOIN a2 USING (il, trace) JOIN a3 USING (il, trace)",
)
SQL["domain_model"] = with_views(
    SEC,
    f"WITH RECURSIVE {SIZE}, {BOX15}, lim AS (SELECT il, quantile_cont(abs(amp), 0.99) AS q FROM section GROUP BY il), cl AS (SELECT il, trace, s, least(greatest(amp / CASE WHEN q = 0 THEN 1e0 ELSE q END, -1), 1) AS c FROM section JOIN lim USING (il)), {VAR15.format(amp='c', t='cl')}, prob AS (SELECT il, trace, s, v / (top + 1e-8) AS p FROM var JOIN vmax USING (il)), {COMP.replace('p >= 0.5', 'p >= 0.6')}"
    ", g AS (SELECT il, region, count(*) AS area, min(trace) AS x1, max(trace) AS x2, min(s) AS y1, max(s) AS y2, avg(p) AS m FROM labelled GROUP BY il, region HAVING count(*) >= 12), d AS (SELECT *, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h FROM g), e AS (SELECT *, m * CASE WHEN h > 3 * w OR w > 3 * h THEN 1e0 WHEN h > 2 * w OR w > 2 * h THEN 0.8e0 ELSE 0.5e0 END AS conf, greatest(w, h) / (least(w, h) + 1)::DOUBLE AS aspect FROM d)"
    ", k AS (SELECT * FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE a.il = b.il AND (b.conf > a.conf OR b.conf = a.conf AND b.region < a.region) AND least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) AND (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) + 1e-8) > 0.3))"
    f" SELECT il, 'fault' AS class_name, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, {r(r('conf', 3), 2)} AS confidence, area AS area_pixels, {r(r('aspect', 1), 2)} AS aspect_ratio FROM k",
)
SQL["prompted_mask"] = with_views(SEC, f"WITH b AS (SELECT * FROM section WHERE trace BETWEEN 2 AND 12 AND s BETWEEN 10 AND 40), t AS (SELECT il, avg(amp) AS mu, stddev_pop(amp) AS sd FROM b GROUP BY il) SELECT il, 'body' AS label, count(*) AS mask_area_pixels, min(trace)::DOUBLE AS x1, min(s)::DOUBLE AS y1, max(trace)::DOUBLE AS x2, max(s)::DOUBLE AS y2, {r('avg(trace)')} AS cx, {r('avg(s)')} AS cy FROM b JOIN t USING (il) WHERE sd < 1e-8 OR amp > mu + 0.5e0 * sd GROUP BY il")
SQL["cube_faults"] = with_views(SEC, f"WITH RECURSIVE {PROB}, {COMP.replace('p >= 0.5', 'p >= 0.3')} SELECT il AS slice_index, 'fault' AS class_name, count(*) AS area_pixels, min(trace)::DOUBLE AS x1, min(s)::DOUBLE AS y1, max(trace)::DOUBLE AS x2, max(s)::DOUBLE AS y2, {r(r('avg(p)', 3), 2)} AS confidence FROM labelled GROUP BY il, region HAVING count(*) >= 20")


def _span(a: str, b: str, size: str, n: int) -> str:
    at = lambda c: f"trunc(least(greatest({c} * {size}, 0e0), {size} - 1))::INT"
    return f"generate_series(least(least({at(a)}, {at(b)}), {n - 1}), least(greatest({at(a)}, {at(b)}), {n - 1}))"


SQL["views_paint"] = with_views(
    DET,
    "WITH v(name, kind, idx, h, w) AS (VALUES ('inline_model', 'inline', 3, 40, 14), ('inline', 'inline', 3, 40, 14), ('seismic_crossline', 'crossline', 5, 40, 12), ('slice', 'slice', 20, 12, 14)), d AS (SELECT ['inline_model','seismic_crossline','slice','p','inline','unknown'][det_id % 6 + 1] AS name, CASE WHEN class_id > 0 THEN 'c' || class_id ELSE 'unknown' END AS class_name, CASE WHEN det_id % 7 > 0 THEN confidence ELSE 1e0 END AS confidence, x1, y1, x2, y2 FROM det WHERE det_id % 11 <> 0)"
    f", a AS (SELECT class_name, confidence, CASE kind WHEN 'inline' THEN [idx::BIGINT] WHEN 'crossline' THEN {_span('x1', 'x2', 'w', 12)} ELSE {_span('y1', 'y2', 'h', 12)} END AS il, CASE kind WHEN 'crossline' THEN [idx::BIGINT] ELSE {_span('x1', 'x2', 'w', 14)} END AS xl, CASE kind WHEN 'slice' THEN [idx::BIGINT] ELSE {_span('y1', 'y2', 'h', 40)} END AS s FROM d JOIN v USING (name))"
    f", b AS (SELECT class_name, confidence, unnest(il) AS il, xl, s FROM a), c AS (SELECT class_name, confidence, il, unnest(xl) AS xl, s FROM b), e AS (SELECT class_name, confidence, il, xl, unnest(s) AS s FROM c) SELECT class_name, il, xl, s, {r('max(confidence)')} AS confidence FROM e GROUP BY ALL",
)
SQL["volume_slices"] = with_views(SEC, f"WITH n AS (SELECT il FROM (SELECT DISTINCT il FROM tr) ORDER BY il LIMIT 1 OFFSET 1) SELECT 'inline' AS kind, trace::BIGINT AS at, {r('samples[1]')} AS amp FROM tr JOIN n USING (il) UNION ALL SELECT 'crossline', il, {r('samples[1]')} FROM tr WHERE trace = 2 UNION ALL SELECT 'time', il, {r('max(samples[6])')} FROM tr GROUP BY il")
SQL["accuracy_scores"] = "SELECT r_regionkey, v.* FROM region, (VALUES ('seismic', 0, 1e0), ('seismic', 1, 0.5e0), ('seismic', 2, 0e0), ('log', 0, 0.75e0), ('log', 1, 0e0), ('log', 2, 0.3333e0), ('fusion', 0, 1e0), ('fusion', 1, 0.25e0), ('fusion', 2, 0e0), ('prospect', 0, 1e0), ('prospect', 1, 0.2e0), ('prospect', 2, 0e0)) v(agent, k, overall)"


def _plan_errors() -> str:
    need = {"traditional_code": "rules", "sam": "prompt_type", "seismic_domain_model": "task", "attribute_extractor": "attributes", "horizon_tracker": "seed_points", "facies_classifier": "n_clusters", "well_log_analyzer": "analysis_type", "seismic_foundation": "task", "well_log_ml": "analysis_type"}
    has = {0: (), 1: ("threshold", "task"), 2: ("threshold", "n_clusters", "analysis_type")}
    odd = {("seismic_foundation", 1): "/task: 'fracture' is not one of ['facies_classification', 'feature_extraction']", ("well_log_analyzer", 2): "/analysis_type: 'full' is not one of ['curve_segmentation', 'lithology_classification', 'fluid_identification', 'full_analysis']", ("cig_fault", 2): "/threshold: 'x' is not of type 'number'", ("cig_channel", 2): "/threshold: 'x' is not of type 'number'"}
    rows = []
    for m in [*need, "cig_fault", "cig_channel"]:
        for k, fields in has.items():
            lacks = f": '{need[m]}' is a required property" if m in need and need[m] not in fields else None
            said = lacks or odd.get((m, k))
            rows.append(f"('{m}', {k}, " + ("NULL" if said is None else "'workflow_steps/0/instruction" + said.replace("'", "''") + "'") + ")")
    return "SELECT r_regionkey, v.* FROM region, (VALUES " + ", ".join(rows) + ") v(model, k, error)"


SQL["plan_branches"] = _plan_errors()


def _tracked(seeds: str, search: int, least: float = 0.4, half: int = 25) -> str:
    """CTEs that follow seeds (il, seed, start, pos) from trace to trace, both ways: ``picks`` (il, seed, start, seed_pos, trace, s, confidence)."""
    z = lambda v: f"list_transform({v}, lambda x: (x - list_avg({v})) / (list_stddev_pop({v}) + 1e-8))"
    return (
        f"seeds AS ({seeds}), formed AS (SELECT il, seed, start, pos, samples[greatest(0, pos - {half}) + 1:least(len(samples), pos + {half})] AS form FROM seeds JOIN tr USING (il) WHERE trace = start)"
        f", z AS (SELECT il, seed, start, pos, {z('form')} AS form FROM formed)"
        ", way(il, seed, start, seed_pos, form, d, t, pos, score) AS (SELECT il, seed, start, pos, form, d, start, pos, 1e0 FROM z, (VALUES (-1), (1)) AS dirs(d) UNION ALL"
        " SELECT il, seed, start, seed_pos, form, d, t, greatest(0, least(ns - 1, lo + list_position(fits, list_max(fits)) - 1 + len(form) // 2)), least(list_max(fits) / len(form), 1e0) FROM"
        " (SELECT *, list_transform(range(0, len(part) - len(form) + 1), lambda k: list_dot_product(part[k + 1:k + len(form)], form)) AS fits FROM"
        f" (SELECT * EXCLUDE (cut), {z('cut')} AS part FROM"
        f" (SELECT il, seed, start, seed_pos, form, d, t + d AS t, len(samples) AS ns, greatest(0, way.pos - {search} - {half}) AS lo, samples[greatest(0, way.pos - {search} - {half}) + 1:least(len(samples), way.pos + {search} + {half})] AS cut"
        f" FROM way JOIN (SELECT il AS i, trace, samples FROM tr) AS x ON x.i = il AND x.trace = t + d) WHERE len(cut) >= len(form) + 4)) WHERE list_max(fits) / len(form) >= {least})"
        ", picks AS (SELECT DISTINCT il, seed, start, seed_pos, t AS trace, pos AS s, score AS confidence FROM way)"
    )


_FIRST_PEAK = "(SELECT il, trace, lo + list_position(near, list_max(near)) - 1 AS pos FROM (SELECT il, trace, lo, samples[lo + 1:want + 5] AS near FROM (SELECT il, trace, samples, {want} AS want, greatest(0, {want} - 4) AS lo FROM tr WHERE trace = {trace})))"
SQL["horizon_track"] = with_views("correlated", f"WITH RECURSIVE {_tracked('SELECT DISTINCT il, 0 AS seed, 0 AS start, 30 AS pos FROM tr', 15)} SELECT il, trace, s, {r('confidence')} AS confidence FROM picks")
_SEEDS = f"SELECT il, 0 AS seed, 2 AS start, pos FROM {_FIRST_PEAK.format(want=30, trace=2)} UNION ALL SELECT il, 1, 0, pos FROM {_FIRST_PEAK.format(want=32, trace=0)}"
SQL["horizon_model"] = with_views(
    "correlated",
    f"WITH RECURSIVE {_tracked(_SEEDS, 10)}, g AS (SELECT *, (trace - lag(trace) OVER (PARTITION BY il, seed ORDER BY trace) > 1)::INT AS gap FROM picks) SELECT il, 'T_' || seed AS horizon_name, start AS seed_trace_idx, seed_pos AS seed_sample_idx, count(*) AS n_points, {r('1 / (1 + coalesce(avg(gap), 0e0))', 3)} AS continuity_score FROM g GROUP BY il, seed, start, seed_pos",
)
