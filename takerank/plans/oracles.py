"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from takerank import model

EVENT_WINDOWS = """
ev AS (
  SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) AS widx, epoch_us(ts) AS us, hour(ts) AS hr FROM events
), gaps AS (
  SELECT *, (us - lag(us) OVER w) / 1e6 AS gap, row_number() OVER w AS i FROM ev WINDOW w AS (PARTITION BY user_id, widx ORDER BY us, event_id)
), win0 AS (
  SELECT concat('e', user_id % 10, '/u', user_id, '.mp3') AS path, widx::INT AS widx, widx * 30.0::DOUBLE AS start,
    20 * log10(greatest(avg(value), 1e-10)) AS rms_db, 20 * log10(greatest(max(value), 1e-10)) - 20 * log10(greatest(avg(value), 1e-10)) AS crest_db,
    avg((value > 100)::INT) AS clip_ratio, avg((event_type = 'error')::INT) AS silence_ratio, avg((event_type = 'view')::INT) AS flatness,
    avg((event_type = 'click')::INT) AS pulse_clarity, avg((event_type = 'purchase')::INT) AS beat_strength, avg((event_type = 'signup')::INT) AS fuera_tono_med,
    count(*) / 24.0::DOUBLE AS onset_rate,
    CASE WHEN count(gap) >= 2 THEN stddev_pop(gap) / greatest(avg(gap), 1e-10) END AS ibi_cv,
    CASE WHEN count(gap) >= 2 THEN count(*) * 60 / greatest(avg(gap), 1e-10) END AS tempo,
    CASE WHEN count(gap) >= 2 THEN abs(regr_slope(gap, i)) * count(gap) / greatest(avg(gap), 1e-10) END AS tempo_drift,
    (max(value) < 1)::INT AS is_silent, avg((value < 20)::INT) AS onset_dev_mad, avg((value BETWEEN 20 AND 60)::INT) AS band_sync, avg((us % 7 < 2)::INT) AS tuning_dev,
    avg((value > 80)::INT) AS fuera_tono_p95, CASE WHEN count(gap) >= 2 THEN stddev_pop(value) END AS harmonic_flux, """ + ", ".join(f"avg((hr // 2 = {i})::INT) AS chroma_{i}" for i in range(12)) + """
  FROM gaps GROUP BY user_id, widx
), win AS (
  SELECT *, greatest(""" + ", ".join(model.CHROMA) + """) AS key_clarity FROM win0
)"""  # fmt: skip
WINDOW_FEATURES = ("rms_db", "crest_db", "clip_ratio", "silence_ratio", "flatness", "pulse_clarity", "beat_strength", "fuera_tono_med", "onset_rate", "ibi_cv", "tempo", "tempo_drift", "is_silent", "onset_dev_mad", "band_sync", "tuning_dev", "fuera_tono_p95", "harmonic_flux", *model.CHROMA, "key_clarity")


def _rank(x: str) -> str:
    return f"CASE WHEN count({x}) OVER () <= 1 OR {x} IS NULL THEN 0.5 ELSE (rank() OVER (ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER () END"


def _dimension(spec: dict, there) -> str:
    own = [f"{w} * ({'' if d > 0 else '1 - '}({_rank(f)}))" for f, (d, w) in spec.items() if f in there]
    return f"({' + '.join(own) or '0.0'}) / {sum(w for _, w in spec.values())}::DOUBLE"


def _combo(names) -> str:
    total = sum(model.WEIGHTS[n] for n in names)
    return " + ".join(f"{n} * {model.WEIGHTS[n] / total!r}" for n in names)


def scored(veto: bool = False, idea: bool = False) -> str:
    base = "ejec_limpia" if idea else "ejec_ventana"
    score = base if veto else f"0.35 * sonido + 0.65 * {base}"
    keep = "WHERE sonido >= (SELECT quantile_cont(sonido, 0.15) FROM dims)" if veto else ""
    dims = ", ".join(f"{_dimension(s, WINDOW_FEATURES)} AS {d}" for d, s in model.WINDOW_DIMENSIONS.items())
    return f"""{EVENT_WINDOWS}, loud AS (SELECT * FROM win WHERE coalesce(is_silent, 0) = 0
), dims AS (SELECT *, {dims} FROM loud
), combos AS (SELECT *, {_combo(model.EXECUTION)} AS ejec_ventana, {_combo(model.EXECUTION_CLEAN)} AS ejec_limpia FROM dims {keep}
), sw AS (SELECT *, {score} AS score FROM combos)"""


def file_scores(profile: str, veto: bool = False) -> str:
    idea = profile in {"ideas", "gems"}
    unit = " + ".join(f"{c} * {c}" for c in model.CHROMA)
    whole = " + ".join(f"power(sum({c} / len), 2)" for c in model.CHROMA)
    own = " + ".join(f"power({c} / len, 2)" for c in model.CHROMA)
    file_features = ("tempo_consistency", "arco_dinamico", "novedad_armonica", "variedad_textura", "harmonic_flux")
    dims = ", ".join(f"{_dimension(s, file_features)} AS {d}" for d, s in model.FILE_DIMENSIONS.items())
    base = model.PROFILES[profile]
    base = f"0.35 * sonido + 0.65 * ({base})" if not veto and not idea else base
    share = 0.2 if idea else 0.5
    return f"""{scored(veto, idea)}, sl AS (SELECT *, greatest(sqrt({unit}), 1e-10) AS len FROM sw
), f0 AS (SELECT path, count(*) AS n_win, arg_max(start, {{'a': round(score, 9), 'b': -start}}) AS best_start_s,
    {", ".join(f"median({d}) AS {d}" for d in model.WINDOW_DIMENSIONS)}, median(score) AS med, quantile_cont(score, 0.95) AS best,
    round(CASE WHEN count(tempo) FILTER (tempo > 0) >= 3 THEN 1 - stddev_samp(tempo) FILTER (tempo > 0) / avg(tempo) FILTER (tempo > 0) END, 9) AS tempo_consistency,
    round(CASE WHEN count(rms_db) >= 3 THEN quantile_cont(rms_db, 0.9) - quantile_cont(rms_db, 0.1) END, 9) AS arco_dinamico,
    round(CASE WHEN count(*) >= 3 THEN 1 - ({whole} - sum({own})) / (count(*) * (count(*) - 1)) END, 9) AS novedad_armonica,
    round(CASE WHEN count(onset_rate) >= 3 AND avg(onset_rate) > 0 THEN stddev_samp(onset_rate) / greatest(avg(onset_rate), 1e-9) END, 9) AS variedad_textura, round(median(harmonic_flux), 9) AS harmonic_flux
  FROM sl GROUP BY path
), f1 AS (SELECT *, {dims} FROM f0
), f2 AS (SELECT *, {_combo(model.EXECUTION)} AS ejecucion, {_combo(model.INTEREST)} AS interes, {_combo(model.BALANCE)} AS balance FROM f1
), f3 AS (SELECT *, interes * (1 - ejecucion) AS gems FROM f2
), f4 AS (SELECT *, {1 - share} * ({base}) + {share} * med AS score_med_raw, best AS score_best_raw FROM f3
), fs AS (SELECT *, n_win / (n_win + 4.0::DOUBLE) * score_med_raw + (1 - n_win / (n_win + 4.0::DOUBLE)) * 0.5 AS score_med,
    n_win / (n_win + 4.0::DOUBLE) * score_best_raw + (1 - n_win / (n_win + 4.0::DOUBLE)) * 0.5 AS score_best FROM f4)"""


FILE_OUT = ", ".join(["path", "n_win", "best_start_s", *[f"round({c}, 6) AS {c}" for c in (*model.WINDOW_DIMENSIONS, *model.FILE_DIMENSIONS, "ejecucion", "interes", "balance", "gems", "score_med", "score_best")]])
STREAKS = f"""{scored()}, good AS (SELECT path, start, score, tempo FROM sw WHERE score >= (SELECT quantile_cont(score, 0.6) FROM sw) AND coalesce(silence_ratio, 0) <= 0.2
), brk AS (SELECT *, CASE WHEN abs(start - lag(start) OVER (PARTITION BY path ORDER BY start) - 30) < 1e-3 THEN 0 ELSE 1 END AS new FROM good
), isl AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start) AS island FROM brk
), sized AS (SELECT *, count(*) OVER (PARTITION BY path, island) AS size FROM isl
), streak AS (SELECT path, island::BIGINT AS island, min(start) AS ini, max(start) + 30 AS fin, count(*) AS n, avg(score) AS mean, median(tempo) AS tempo FROM sized WHERE size >= 2 GROUP BY path, island)"""
BEST_RUN = f"""{scored()}, r AS (SELECT path, start, score, CASE WHEN count(*) OVER f = 3 AND abs(start - lag(start, 2) OVER (PARTITION BY path ORDER BY start) - 60) < 5e-4 THEN round(avg(score) OVER f, 9) END AS m
  FROM sw WINDOW f AS (PARTITION BY path ORDER BY start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
), g AS (SELECT path, count(*) AS n, min(start) AS first, max(start) AS last, arg_max(start, {{'a': m, 'b': -start}}) FILTER (m IS NOT NULL) AS stop, arg_max(start, {{'a': round(score, 9), 'b': -start}}) AS single FROM r GROUP BY path
), run AS (SELECT path, CASE WHEN n <= 3 THEN first ELSE coalesce(stop - 60, single) END AS ini, CASE WHEN n <= 3 THEN last ELSE coalesce(stop, single) END + 30 AS fin, n FROM g)"""
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGES = f"""d0 AS (SELECT doc_id, n_chars::DOUBLE AS duration, [{", ".join(f"len(lower(text)) - len(replace(lower(text), '{c}', ''))" for c in LETTERS)}]::DOUBLE[] AS v FROM documents
), d1 AS (SELECT doc_id, duration, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-9)) AS v FROM d0
), mu AS (SELECT i, avg(x) AS m FROM (SELECT unnest(range(1, 27)) AS i, unnest(v) AS x FROM d1) GROUP BY i
), ml AS (SELECT list(m ORDER BY i) AS m FROM mu
), d2 AS (SELECT doc_id, duration, list_transform(range(1, 27), lambda i: v[i] - m[i]) AS c FROM d1, ml
), d3 AS (SELECT doc_id, duration, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-9)) AS c FROM d2
), edge AS (SELECT a.doc_id AS a, b.doc_id AS b, list_dot_product(a.c, b.c) AS cosine FROM d3 a JOIN d3 b ON a.doc_id < b.doc_id AND abs(a.duration - b.duration) <= 2 WHERE list_dot_product(a.c, b.c) >= 0.997)"""
TOPICS = """nm AS (SELECT DISTINCT p_name FROM part
), tok AS (SELECT DISTINCT p_name, unnest(string_split(regexp_replace(lower(p_name), '[^a-z0-9áéíóúñ ]', ' ', 'g'), ' ')) AS token FROM nm
), ok AS (SELECT * FROM tok WHERE len(token) > 2 AND NOT regexp_full_match(token, '[0-9]+')
), df AS (SELECT token, count(*) AS df FROM ok GROUP BY token HAVING count(*) >= 3 AND count(*) <= greatest(floor((SELECT count(*) FROM nm) * 0.3), 3)
), best AS (SELECT p_name, arg_max(token, {'a': df, 'b': token}) AS topic FROM ok JOIN df USING (token) GROUP BY p_name
), pt AS (SELECT p_partkey, p_name, p_retailprice, topic FROM part LEFT JOIN best USING (p_name))"""
VOTES = """v AS (SELECT event_id, user_id AS usuario, concat('c', event_id % 2) AS compilado, (props->>'$.k')::BIGINT % 10 AS tramo, (props->>'$.k')::BIGINT % 25 AS toma, ts, event_type = 'error' AND event_id % 2 = 0 AS of_note,
    CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'dislike' WHEN event_type IN ('view', 'click') THEN 'like' WHEN event_type = 'purchase' THEN 'star' WHEN event_type = 'error' THEN 'undo' ELSE 'nota' END AS evento FROM events
), live AS (SELECT * FROM v x WHERE evento IN ('like', 'star') AND NOT EXISTS (SELECT 1 FROM v y WHERE y.usuario = x.usuario AND y.compilado = x.compilado AND y.tramo = x.tramo
    AND (y.evento IN ('like', 'star') OR (y.evento = 'undo' AND NOT y.of_note)) AND (y.ts > x.ts OR (y.ts = x.ts AND y.event_id > x.event_id)))
), notes AS (SELECT * FROM v x WHERE evento = 'nota' AND NOT EXISTS (SELECT 1 FROM v y WHERE y.usuario = x.usuario AND y.compilado = x.compilado AND y.tramo = x.tramo
    AND (y.evento = 'nota' OR (y.evento = 'undo' AND y.of_note)) AND (y.ts > x.ts OR (y.ts = x.ts AND y.event_id > x.event_id)))
), stretch AS (SELECT l_orderkey % 25 AS toma, l_linenumber::BIGINT AS tramo, concat('c', l_orderkey % 3) AS compilado, min(l_partkey % 600) * 3 AS ini FROM lineitem WHERE (l_orderkey % 25 + l_linenumber) % 4 <> 0 GROUP BY 1, 2, 3)"""
MOVING = VOTES + """, mv AS (SELECT * FROM notes UNION ALL SELECT * FROM v x WHERE evento IN ('like', 'star', 'dislike') AND NOT EXISTS (SELECT 1 FROM v y WHERE y.usuario = x.usuario AND y.compilado = x.compilado AND y.tramo = x.tramo
    AND (y.evento IN ('like', 'star', 'dislike') OR (y.evento = 'undo' AND NOT y.of_note)) AND (y.ts > x.ts OR (y.ts = x.ts AND y.event_id > x.event_id)))
), cand AS (SELECT mv.event_id AS vote_id, s.compilado AS new_compilado, s.tramo AS new_tramo, greatest(0, least(mv.event_id % 1800, s.ini) + 90 - greatest(mv.event_id % 1800, s.ini))::DOUBLE AS shared,
    s.compilado = mv.compilado AS same, abs(s.tramo - mv.tramo) AS off FROM mv JOIN stretch s USING (toma) WHERE toma <> 7
), pool AS (SELECT * FROM cand c WHERE same OR NOT EXISTS (SELECT 1 FROM cand d WHERE d.vote_id = c.vote_id AND d.same)
), first_choice AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY vote_id ORDER BY shared DESC, off, new_tramo, new_compilado) = 1
), home AS (SELECT mv.event_id AS vote_id, new_compilado, new_tramo, shared FROM mv LEFT JOIN first_choice ON vote_id = mv.event_id)"""
ASKED = """pr AS (SELECT p_partkey // 50 AS lote, p_partkey % 50 AS num, p_partkey AS seg_a, p_partkey % 97 + 1 AS seg_b, CASE WHEN p_partkey % 3 = 0 THEN 'gem_vs_perf' ELSE 'azar' END AS tipo FROM part
), ans AS (SELECT user_id % 60 AS lote, event_id % 55 AS num, ['A', 'B', 'ambos', 'ninguno', 'quizas'][event_id % 5 + 1] AS eleccion, ts FROM events
), asked AS (SELECT pr.*, (SELECT a.eleccion FROM ans a WHERE a.lote = pr.lote AND a.num = pr.num AND a.eleccion <> 'quizas' ORDER BY a.ts DESC, a.eleccion DESC LIMIT 1) AS eleccion FROM pr
), pf AS (SELECT concat('p/', p_partkey, '.mp3') AS path, p_partkey AS id, p_partkey * 37 % 101 / 100 AS interes, p_partkey * 53 % 101 / 100 AS ejecucion, p_brand AS topic, p_size FROM part)"""
RANKED = """rk AS (SELECT doc_id, quality = 1 AS positive, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER () AS n FROM labels JOIN documents USING (doc_id))"""
ANSWERS = """an AS (SELECT event_type AS b, lag(event_type) OVER w AS a, value AS vb, lag(value) OVER w AS va FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), ch AS (SELECT a, b, CASE WHEN abs(va - vb) < 3 THEN CASE WHEN va > 20 THEN 'ambos' ELSE 'ninguno' END WHEN va > vb THEN 'A' WHEN vb > va THEN 'B' END AS choice FROM an WHERE a IS NOT NULL AND a <> b
), wm AS (SELECT winner, loser, sum(w) AS weight FROM (SELECT a AS winner, b AS loser, CASE choice WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0 ELSE 0.5 END AS w FROM ch UNION ALL SELECT b, a, CASE choice WHEN 'B' THEN 1.0::DOUBLE WHEN 'A' THEN 0 ELSE 0.5 END FROM ch) WHERE w > 0 GROUP BY ALL)"""
STRENGTHS = f"""WITH RECURSIVE {ANSWERS}, items AS (SELECT item, row_number() OVER (ORDER BY item) AS i, count(*) OVER () AS n FROM (SELECT winner AS item FROM wm UNION SELECT loser FROM wm)
), cell AS (SELECT x.i, y.i AS j, x.n, CASE WHEN x.i = y.i THEN 0 ELSE coalesce((SELECT weight FROM wm WHERE winner = x.item AND loser = y.item), 0) + 0.05 / x.n END AS w FROM items x, items y
), line AS (SELECT c.i, c.n, sum(c.w) AS wins, list(c.w + d.w ORDER BY c.j) AS games FROM cell c JOIN cell d ON d.i = c.j AND d.j = c.i GROUP BY c.i, c.n
), whole AS (SELECT n, list(wins ORDER BY i) AS wins, list(games ORDER BY i) AS games FROM line GROUP BY n
), it(k, theta) AS (SELECT 0, list_transform(range(n), lambda i: 1.0::DOUBLE) FROM whole UNION ALL
  SELECT k + 1, list_transform(raw, lambda x: x / exp(list_avg(list_transform(raw, lambda y: ln(y))))) FROM (
    SELECT k, list_transform(range(1, n + 1), lambda i: wins[i] / list_sum(list_transform(range(1, n + 1), lambda j: games[i][j] / (theta[i] + theta[j])))) AS raw FROM it, whole WHERE k < 200)
) SELECT item, round(ln(theta[i]), 6) AS bt FROM items, it WHERE k = 200"""


def diverse(n: int, threshold: float) -> str:
    """The walk over the ranking, a row a step, with the vectors taken so far."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS p, embedding::DOUBLE[] AS v FROM embeddings
), mu AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e) GROUP BY i)
), c AS (SELECT vec_id, p, list_transform(range(1, len(v) + 1), lambda i: v[i] - m[i]) AS v FROM e, mu
), u AS (SELECT vec_id, p, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-9)) AS v FROM c
), walk(p, ids, vs) AS (SELECT 0::BIGINT, []::BIGINT[], []::DOUBLE[][] UNION ALL
  SELECT u.p, CASE WHEN ok THEN list_append(ids, u.p) ELSE ids END, CASE WHEN ok THEN list_append(vs, v) ELSE vs END
  FROM (SELECT walk.*, u.p AS np FROM walk JOIN u ON u.p = walk.p + 1) w JOIN u ON u.p = w.np, LATERAL (SELECT len(w.ids) < {n} AND len(list_filter(w.vs, lambda t: list_dot_product(t, u.v) >= {threshold})) = 0 AS ok)
), done AS (SELECT ids FROM walk ORDER BY p DESC LIMIT 1
), picked AS (SELECT unnest(ids) AS p, unnest(range(len(ids))) AS pick FROM done
), filled AS (SELECT p, pick FROM picked UNION ALL SELECT p, (SELECT count(*) FROM picked) + row_number() OVER (ORDER BY p) - 1 FROM u WHERE p NOT IN (SELECT p FROM picked) QUALIFY row_number() OVER (ORDER BY p) <= {n} - (SELECT count(*) FROM picked))
SELECT vec_id, pick::INT AS pick FROM filled JOIN u USING (p)"""


CHAIN = f"""WITH RECURSIVE {STREAKS}, best AS (SELECT *, row_number() OVER o AS place, coalesce(sum(fin - ini) OVER (ORDER BY round(mean, 9) DESC, path, ini ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM streak WINDOW o AS (ORDER BY round(mean, 9) DESC, path, ini)
), pc AS (SELECT path, ini, fin, round(tempo, 9) AS tempo, row_number() OVER (ORDER BY coalesce(round(tempo, 9), 1e9), place) AS i FROM best WHERE before < 7200
), far AS (SELECT a.i AS a, b.i AS b, b.ini, round(CASE WHEN a.tempo > 0 AND b.tempo > 0 THEN least(abs(ln(a.tempo / (b.tempo * 0.5))) + 0.15, abs(ln(a.tempo / b.tempo)), abs(ln(a.tempo / (b.tempo * 2))) + 0.15) ELSE 1 END - CASE WHEN a.path = b.path THEN 0.05 ELSE 0 END, 9) AS cost FROM pc a JOIN pc b ON a.i <> b.i
), chain(position, i, taken) AS (SELECT 1::BIGINT, 1::BIGINT, [1::BIGINT] UNION ALL
  SELECT position + 1, nxt, list_append(taken, nxt) FROM (SELECT c.position, c.taken, arg_min(f.b, {{'a': f.cost, 'b': f.ini, 'c': f.b}}) AS nxt FROM chain c JOIN far f ON f.a = c.i AND NOT list_contains(c.taken, f.b) GROUP BY c.position, c.taken)
), tuned AS (SELECT position, path, ini, fin, tempo FROM chain JOIN pc USING (i)
), adj(position, prev, ratio) AS (SELECT 1::BIGINT, tempo, 1.0::DOUBLE FROM tuned WHERE position = 1 UNION ALL
  SELECT position, coalesce(tempo * used, prev), used FROM (SELECT t.position, t.tempo, a.prev, CASE WHEN abs(r - 1) <= 0.04 THEN r ELSE 1 END AS used
    FROM adj a JOIN tuned t ON t.position = a.position + 1, LATERAL (SELECT CASE WHEN a.prev > 0 AND t.tempo > 0 THEN list_sort([{{'o': abs(a.prev / (t.tempo * m) - 1), 'r': a.prev / (t.tempo * m)}} FOR m IN [0.5, 1, 2]])[1].r END AS r)))"""
RESCORED = f"""{scored()}, pub AS (SELECT (o_orderkey % 12)::VARCHAR AS compilado, o_orderkey AS tramo, concat('e', o_custkey % 10, '/u', o_custkey, '.mp3') AS path, concat('u', o_custkey, '.mp3') AS toma, o_orderkey % 40 * 30 AS ini, CASE WHEN o_orderkey % 5 <> 0 THEN 0.5::DOUBLE END AS old FROM orders
), fl AS (SELECT path, count(*) AS n FROM sw GROUP BY path), med AS (SELECT tramo, round(median(sw.score), 3) AS score, round(median(sw.timing), 3) AS timing FROM pub JOIN sw ON sw.path = pub.path AND start >= ini - 1 AND start < ini + 119 WHERE pub.path NOT LIKE 'e3/%' GROUP BY tramo
), res AS (SELECT compilado, tramo, toma, coalesce(med.score, old) AS score, timing, CASE WHEN med.score IS NOT NULL THEN round(n / 100, 3) END AS interes, round(med.score - old, 3) AS change, med.score IS NOT NULL AS has FROM pub LEFT JOIN med USING (tramo) LEFT JOIN fl USING (path))"""
FRESH = STREAKS + BEST_RUN[len(scored()) :]


def _profile(f: str) -> str:
    x = f"round({f}, 9)"
    ratio = f"(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) / greatest(abs(quantile_cont({x}, 0.5)), 1e-9)"
    return f"SELECT '{f}' AS feature, round(min({x}), 6) AS min, round(quantile_cont({x}, 0.1), 6) AS p10, round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.9), 6) AS p90, round(max({x}), 6) AS max, count(*) - count({f}) AS n_null, count(DISTINCT {x}) AS n_distinct, round({ratio}, 6) AS spread, {ratio} < 0.05 AS suspicious FROM win HAVING count({f}) > 0"


# The features that the report of features is about, as far as the test tables have them.
PROFILED = ("flatness", "silence_ratio", "clip_ratio", "crest_db", "ibi_cv", "tempo_drift", "onset_dev_mad", "pulse_clarity", "band_sync", "beat_strength", "tuning_dev", "key_clarity", "fuera_tono_med", "fuera_tono_p95", "harmonic_flux", "rms_db", "tempo", "onset_rate")
_TWO = lambda c: f"format('{{:.2f}}', {c}::DOUBLE)"
_CLOCK = lambda c: f"concat(floor({c} / 60)::BIGINT, ':', lpad((floor({c})::BIGINT % 60)::VARCHAR, 2, '0'))"

ORACLES: dict[str, str] = {
    "window_scan_semi": f"WITH {EVENT_WINDOWS} SELECT path, widx, start, round(rms_db, 6) AS rms_db, round(ibi_cv, 6) AS ibi_cv FROM win WHERE path IN (SELECT concat('e', user_id % 10, '/u', user_id, '.mp3') FROM events GROUP BY user_id HAVING count(*) >= 60)",
    "hop_windows": "SELECT doc_id, unnest(range(0, n_chars - 250 + 1, 400))::BIGINT AS start FROM documents WHERE n_chars >= 250",
    "rank_norm_features": f"SELECT l_orderkey, l_linenumber, round({_rank('l_quantity')}, 6) AS l_quantity, round({_rank('l_discount')}, 6) AS l_discount, round({_rank('l_extendedprice')}, 6) AS l_extendedprice FROM lineitem",
    "window_scores": f"WITH {scored()} SELECT path, widx, {', '.join(f'round({d}, 6) AS {d}' for d in (*model.WINDOW_DIMENSIONS, 'ejec_ventana', 'ejec_limpia', 'score'))} FROM sw",
    "window_scores_veto": f"WITH {scored(True)} SELECT path, widx, round(sonido, 6) AS sonido, round(score, 6) AS score FROM sw",
    **{f"file_score_{p}": f"WITH {file_scores(p)} SELECT {FILE_OUT} FROM fs" for p in model.PROFILES},
    "file_score_veto": f"WITH {file_scores('balance', True)} SELECT {FILE_OUT} FROM fs",
    "take_ranking": f"WITH {file_scores('balance')} SELECT path, n_win, best_start_s, round(score_med, 6) AS score_med, row_number() OVER (ORDER BY round(score_med, 9) DESC, path)::INT AS rank FROM fs",
    "dedupe_edges": f"WITH {EDGES} SELECT a, b, round(cosine, 6) AS cosine FROM edge",
    "dup_groups": f"WITH RECURSIVE {EDGES}, both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other) SELECT doc_id, min(other) AS \"group\" FROM reach GROUP BY doc_id",
    "dedupe_first": f"WITH RECURSIVE {EDGES}, both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other), g AS (SELECT doc_id, min(other) AS grp FROM reach GROUP BY doc_id) SELECT arg_max(doc_id, {{'a': n_chars, 'b': -doc_id}}) AS doc_id, grp AS \"group\" FROM g JOIN documents USING (doc_id) GROUP BY grp",
    "topic_of_name": f"WITH {TOPICS} SELECT p_partkey, topic FROM pt",
    "topic_cap": f"WITH {TOPICS}, c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY p_retailprice DESC, p_partkey) AS n FROM pt) SELECT p_partkey, topic FROM c WHERE topic IS NULL OR n <= 5",
    "best_run": f"WITH {BEST_RUN} SELECT * FROM run",
    "streaks": f"WITH {STREAKS} SELECT path, island, ini, fin, n, round(mean, 6) AS mean, round(tempo, 6) AS tempo FROM streak",
    "streak_trim": f"""WITH {STREAKS}, rm AS (SELECT *, CASE WHEN count(*) OVER f = 2 THEN round(avg(score) OVER f, 9) END AS m FROM sized WHERE size >= 2 WINDOW f AS (PARTITION BY path, island ORDER BY start ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
), st AS (SELECT path, island, arg_max(start, {{'a': m, 'b': -start}}) FILTER (m IS NOT NULL) AS stop FROM rm GROUP BY path, island)
SELECT path, island::BIGINT AS island, min(start) AS ini, max(start) + 30 AS fin, count(*) AS n, round(avg(score), 6) AS mean FROM rm JOIN st USING (path, island) WHERE size <= 2 OR (start <= stop AND start > stop - 60 + 1e-3) GROUP BY path, island""",
    "streak_topk": f"WITH {STREAKS}, t AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(mean, 9) DESC, ini) AS k FROM streak) SELECT path, ini, fin, round(mean, 6) AS mean FROM t WHERE k <= 2",
    "budget_cut": f"WITH {STREAKS}, b AS (SELECT *, coalesce(sum(fin - ini) OVER (ORDER BY round(mean, 9) DESC, path, ini ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_s FROM streak) SELECT path, ini, fin, before_s FROM b WHERE before_s < 3600",
    "playlist_positions": f"WITH {STREAKS} SELECT path, ini, fin, coalesce(sum(fin - ini - 2) OVER (ORDER BY round(mean, 9) DESC, path, ini ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_s FROM streak",
    "overlap_avoid": f"WITH {BEST_RUN.replace('sw AS', 'sw AS')}, good AS (SELECT path, start, score, tempo FROM sw WHERE score >= (SELECT quantile_cont(score, 0.6) FROM sw) AND coalesce(silence_ratio, 0) <= 0.2), brk AS (SELECT *, CASE WHEN abs(start - lag(start) OVER (PARTITION BY path ORDER BY start) - 30) < 1e-3 THEN 0 ELSE 1 END AS new FROM good), isl AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start) AS island FROM brk), streak AS (SELECT path, min(start) AS ini, max(start) + 30 AS fin, count(*) AS n FROM isl GROUP BY path, island HAVING count(*) >= 2) SELECT path, ini, fin FROM streak s WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.path = s.path AND least(r.fin, s.fin) - greatest(r.ini, s.ini) > 0 AND least(r.fin, s.fin) - greatest(r.ini, s.ini) > least(s.fin - s.ini, r.fin - r.ini) / 2)",
    "segment_medians": f"WITH {STREAKS} SELECT s.path, s.ini, s.fin, round(median(w.score), 6) AS med_score, round(median(w.timing), 6) AS med_timing FROM streak s LEFT JOIN sw w ON w.path = s.path AND w.start >= s.ini - 1 AND w.start < s.fin - 1 GROUP BY s.path, s.ini, s.fin",
    "score_dist": f"WITH {scored()} SELECT round(min(score), 6) AS min, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.99), 6) AS p99, round(max(score), 6) AS max FROM sw",
    "date_range": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-06-01'",
    "calendar_year": "SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1",
    "session_chains": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, session::BIGINT AS session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY ALL",
    "last_session": "WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) > 1800000000 AS cut FROM events) SELECT event_id, ts FROM g WHERE ts >= coalesce((SELECT max(ts) FROM g WHERE cut), TIMESTAMP '1900-01-01')",
    "backward_asof": "WITH p AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) SELECT e.event_id, p.event_id AS matched FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts",
    "auc": "SELECT count(*) FILTER (quality = 1) AS n_positive, count(*) FILTER (quality = 0) AS n_negative, round((SELECT avg(CASE WHEN p.n_chars > q.n_chars THEN 1.0 WHEN p.n_chars = q.n_chars THEN 0.5 ELSE 0 END) FROM (SELECT n_chars FROM labels JOIN documents USING (doc_id) WHERE quality = 1) p, (SELECT n_chars FROM labels JOIN documents USING (doc_id) WHERE quality = 0) q), 6) AS auc FROM labels",
    "precision_at_k": f"WITH {RANKED} SELECT k, count(*) FILTER (positive AND rank <= k) AS hits, count(*) FILTER (positive AND rank <= k) / least(k, count(*) FILTER (positive)) AS precision FROM rk, (SELECT unnest([10, 25, 50])::BIGINT AS k) GROUP BY k",
    "percentile_positions": f"WITH {RANKED} SELECT doc_id, rank::INT AS rank, round(100 * (1 - rank / n), 6) AS pct FROM rk WHERE positive",
    "spearman_dims": f"WITH {file_scores('balance')}, l AS (UNPIVOT (SELECT path, score_best, timing, groove, afinacion, sonido, desarrollo, interes FROM (SELECT path, {', '.join(f'round({c}, 9) AS {c}' for c in ('score_best', 'timing', 'groove', 'afinacion', 'sonido', 'desarrollo', 'interes'))} FROM fs)) ON timing, groove, afinacion, sonido, desarrollo, interes INTO NAME feature VALUE x), r AS (SELECT feature, x, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY score_best) + (count(*) OVER (PARTITION BY feature, score_best) - 1) / 2 AS ry FROM l) SELECT feature, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY feature HAVING count(DISTINCT x) > 1 AND count(*) >= 5",
    "freshness": "SELECT concat('d/', doc_id) AS path FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 4",
    "classify_remote": "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 4 THEN 'manifest' WHEN doc_id % 3 = 0 THEN 'local' ELSE 'download' END AS state FROM documents",
    "folder_minmax": "SELECT c_custkey, round(CASE WHEN max(c_acctbal) OVER w > min(c_acctbal) OVER w THEN (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) ELSE 0.5 END, 6) AS scaled FROM customer WINDOW w AS (PARTITION BY c_nationkey)",
    "onset_spread": "WITH g AS (SELECT user_id, date_trunc('day', ts) AS d, stddev_pop(extract('hour' FROM ts) + extract('minute' FROM ts) / 60.0::DOUBLE) AS s, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, round(coalesce(median(s) FILTER (n >= 2), 0.05), 6) AS spread FROM g GROUP BY user_id",
    "feature_diagnose": f"WITH {EVENT_WINDOWS} " + " UNION ALL ".join(map(_profile, PROFILED)),
    "vote_state": f"WITH {VOTES} SELECT usuario, compilado, tramo, toma, evento, event_id FROM live",
    "note_state": f"WITH {VOTES} SELECT usuario, compilado, tramo, event_id FROM notes",
    "vote_counts": f"WITH {VOTES} SELECT toma, count(*) AS votes, count(DISTINCT usuario) AS voters FROM live GROUP BY toma",
    "vote_coverage": f"WITH {VOTES}, n AS (SELECT toma, count(DISTINCT usuario) AS voters, toma % 3 <> 0 AND toma IN (SELECT toma FROM stretch) AS here FROM live GROUP BY toma) SELECT k AS least, count(*) FILTER (voters >= k) AS keys, count(*) FILTER (voters >= k AND here) AS present, count(*) FILTER (voters >= k AND here) / count(*) FILTER (voters >= k) AS share FROM n, (SELECT unnest([1, 2, 3])::BIGINT AS k) GROUP BY k",
    "votes_not_rescued": f"WITH {VOTES} SELECT toma, count(*) AS votes, count(DISTINCT usuario) AS voters FROM live WHERE toma % 3 = 0 OR toma NOT IN (SELECT toma FROM stretch) GROUP BY toma",
    "vote_rehome": f"WITH {MOVING} SELECT * FROM home",
    "vote_corrections": f"""WITH {MOVING}, mo AS (SELECT mv.*, h.new_compilado AS nc, h.new_tramo AS nt, CASE WHEN evento = 'nota' THEN 'nota' END AS d, CASE WHEN evento = 'nota' THEN epoch_us(ts) END AS nu FROM mv JOIN home h ON vote_id = event_id WHERE h.new_compilado IS NULL OR h.new_compilado <> mv.compilado OR h.new_tramo <> mv.tramo)
SELECT event_id AS vote_id, usuario, toma, compilado, tramo, 'undo' AS evento, d AS deshace, nu AS nota_us, epoch_us(TIMESTAMP '2025-01-01') AS us, CASE WHEN nc IS NULL THEN 'in no compilation' ELSE concat('to ', nc, ' ', nt) END AS migracion FROM mo
UNION ALL SELECT event_id, usuario, toma, nc, nt, evento, NULL, NULL, epoch_us(TIMESTAMP '2025-01-01'), concat('from ', compilado, ' ', tramo) FROM mo WHERE nc IS NOT NULL""",
    "win_matrix": f"WITH {ANSWERS} SELECT * FROM wm",
    "bradley_terry": STRENGTHS,
    "pair_candidates": f"WITH {TOPICS}, r AS (SELECT p_partkey AS item, topic, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 11 END AS grp, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM pt) SELECT x.item AS a, y.item AS b, y.rank - x.rank AS apart FROM r x JOIN r y ON y.rank BETWEEN x.rank + 1 AND x.rank + 6 WHERE (x.topic IS NULL OR y.topic IS NULL OR x.topic <> y.topic) AND (x.grp IS NULL OR y.grp IS NULL OR x.grp <> y.grp)",
    "top_per_folder": "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 5",
    "moving_context": f"WITH {EVENT_WINDOWS} SELECT path, widx, round(chroma_0, 6) AS chroma_0, round(chroma_5, 6) AS chroma_5, round(sum(chroma_0) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS context_0, round(sum(chroma_5) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) AS context_5 FROM win WINDOW w AS (PARTITION BY path ORDER BY widx)",
    "diverse_selection": diverse(50, 0.3),
    "selection_order": diverse(20, 0.3),
    "tempo_chain": f"{CHAIN} SELECT path, ini, fin, round(tempo, 6) AS tempo, position FROM tuned",
    "tempo_stretch": f"{CHAIN} SELECT position, path, ini, round(ratio, 6) AS ratio FROM adj JOIN tuned USING (position)",
    "answer_parser": """WITH c AS (SELECT conv_id, turn, ['A', 'b', 'AMBOS', 'ninguno', 'ambas', 'Ninguna', 'los dos', 'LAS DOS', 'c', 'A B'][conv_id % 10 + 1] AS word, [' ', ': ', '=', '-', ' - ', ''][turn % 6 + 1] AS sep, ['A', 'B', 'ambos', 'ninguno', 'ambos', 'ninguno', 'ambos', 'ambos', NULL, NULL][conv_id % 10 + 1] AS choice FROM conversations)
SELECT conv_id, turn, concat(turn + 1, sep, word) AS token, CASE WHEN choice IS NOT NULL THEN turn + 1 END AS num, choice, choice IS NULL AS bad FROM c UNION ALL SELECT conv_id, turn, '007 a', 7, 'A', false FROM c UNION ALL SELECT conv_id, turn, 'zz', NULL, NULL, true FROM c""",
    "answers_in_force": f"WITH {ASKED} SELECT lote, num, seg_a, eleccion FROM asked",
    "answers_unknown": f"WITH {ASKED}, r AS (SELECT lote, num, CASE WHEN eleccion = 'quizas' THEN 'no choice' WHEN (lote, num) NOT IN (SELECT (lote, num) FROM pr) THEN 'no such pair' END AS reason FROM ans) SELECT lote, num, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL",
    "pairs_pending": f"WITH {ASKED} SELECT lote, num, concat(seg_a, '.mp3') AS a, concat(seg_b, '.mp3') AS b FROM asked WHERE eleccion IS NULL AND seg_b IN (SELECT p_partkey FROM part)",
    "pairs_seen": f"WITH {ASKED} SELECT concat('p/', seg_a, '.mp3') AS a, concat('p/', seg_b, '.mp3') AS b FROM pr WHERE seg_b IN (SELECT p_partkey FROM part)",
    "batch_numbers": f"WITH {ASKED} SELECT max(lote) + 1 AS next, max(lote) FILTER (eleccion IS NULL) AS pending FROM asked",
    "gem_wins": f"WITH {ASKED}, g AS (SELECT eleccion, x.interes - x.ejecucion > y.interes - y.ejecucion AS first FROM asked JOIN pf x ON x.id = seg_a JOIN pf y ON y.id = seg_b WHERE tipo = 'gem_vs_perf' AND eleccion IS NOT NULL) SELECT count(*) AS n, count(*) FILTER ((eleccion = 'A' AND first) OR (eleccion = 'B' AND NOT first)) AS wins, round(count(*) FILTER ((eleccion = 'A' AND first) OR (eleccion = 'B' AND NOT first)) / count(*), 6) AS rate FROM g",
    "opposite_tails": f"WITH {ASKED}, q AS (SELECT quantile_cont(interes, 0.7) AS i7, quantile_cont(interes, 0.5) AS i5, quantile_cont(ejecucion, 0.7) AS e7, quantile_cont(ejecucion, 0.5) AS e5 FROM pf) SELECT path, interes >= i7 AND ejecucion <= e5 AS gem, ejecucion >= e7 AND interes <= i5 AS perf FROM pf, q",
    "pair_sides": f"WITH {BEST_RUN} SELECT path, n AS n_win, ini AS start, fin AS \"end\" FROM run WHERE n >= 3",
    "latent_join": f"WITH {ASKED} SELECT id AS item, concat(id, '.mp3') AS toma, (id % 17 / 10)::DOUBLE AS bt, interes, ejecucion FROM pf WHERE id % 3 = 0 AND topic <> 'Brand#11'",
    "segment_ids": "SELECT concat('p/', p_partkey, '.mp3') AS path, (p_size * 30)::DOUBLE AS start, (p_size * 30 + 60)::DOUBLE AS \"end\", 1::BIGINT AS n, 1::BIGINT AS ids FROM part",
    "dup_listing": f"WITH RECURSIVE {EDGES}, both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other), g AS (SELECT doc_id, min(other) AS grp FROM reach GROUP BY doc_id) SELECT grp AS \"group\", string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS names FROM g GROUP BY grp HAVING count(*) > 1",
    "median_percentile": f"WITH {RANKED} SELECT count(*) AS n, round(median(100 * (1 - rank / n)), 6) AS median FROM rk WHERE positive",
    "name_filter": "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%dg%'",
    "file_dates": "SELECT o_orderkey::VARCHAR AS path, epoch_us(CASE WHEN o_orderkey % 2 = 1 THEN o_orderdate WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 3 HOURS + INTERVAL 500 MILLISECONDS ELSE o_orderdate - INTERVAL 5 HOURS END) AS us FROM orders",
    "date_columns": "SELECT event_id, epoch_us(ts) - 7 * 30 * 86400000000 AS back_us, (ts - INTERVAL 3 HOURS)::DATE::VARCHAR AS day, concat('in/', strftime(ts, '%Y-%m'), '/', event_id, '.mp3') AS target, epoch_us(ts) AS us FROM events",
    "range_labels": "SELECT unnest(['2024', concat('sesion-', strftime(m + INTERVAL 9 HOURS, '%Y-%m-%d')), concat('3meses-hasta-', strftime(m, '%Y-%m')), 'desde-2024-01-03', 'todo']) AS label, unnest([0, 1, 2, 3, 4])::INT AS n FROM (SELECT max(ts) AS m FROM events)",
    "quota_rounding": "SELECT p_partkey, half, concat('todo_', CASE WHEN half % 2 = 0 THEN 'gems' ELSE 'ideas' END, '_', CASE WHEN p_partkey % 3 = 0 THEN 'dinamico' ELSE 'fijo' END) AS key FROM (SELECT p_partkey, round_even(p_partkey / 2, 0)::INT AS half FROM part)",
    "level_gains": "WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 50 <> 0 THEN -10.0 - p_size END AS db FROM part), t AS (SELECT least(max(db), -16) AS t FROM l) SELECT p_partkey, CASE WHEN db < t - 0.5 THEN (t - db)::DOUBLE ELSE 0 END AS gain_db FROM l, t",
    "pieces_long_enough": "SELECT p_partkey FROM part WHERE p_partkey % 9 >= 4",
    "beat_snap": "WITH b AS (SELECT (user_id % 20)::VARCHAR AS path, (epoch_us(ts) % 3600000000) / 1e6::DOUBLE AS beat FROM events), p AS (SELECT p_partkey, (p_partkey % 23)::VARCHAR AS path, (p_partkey * 13.5::DOUBLE) % 3600 AS t FROM part) SELECT p_partkey, p.path, round(t, 6) AS t, round(coalesce(arg_min(beat, {'a': abs(beat - t), 'b': beat}), t), 6) AS snapped FROM p LEFT JOIN b ON b.path = p.path AND abs(beat - t) <= 1.5 GROUP BY p_partkey, p.path, t",
    "fresh_streaks": f"WITH {FRESH}, top5 AS (SELECT * FROM streak QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(mean, 9) DESC, ini) <= 5), free AS (SELECT * FROM top5 s WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.path = s.path AND least(r.fin, s.fin) - greatest(r.ini, s.ini) > 0 AND least(r.fin, s.fin) - greatest(r.ini, s.ini) > least(s.fin - s.ini, r.fin - r.ini) / 2)) SELECT path, ini, fin, round(mean, 6) AS mean FROM free QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(mean, 9) DESC, ini) = 1",
    "manifest_rescore": f"WITH {RESCORED} SELECT compilado, tramo, toma, score, timing, interes, change FROM res",
    "rescore_deltas": f"WITH {RESCORED}, d AS (SELECT compilado, count(*) AS stretches, count(*) FILTER (NOT has) AS without_data, list_sort(list(abs(change)) FILTER (change IS NOT NULL)) AS c FROM res GROUP BY compilado) SELECT compilado, stretches, without_data, coalesce(c[len(c) // 2 + 1], 0) AS median_change, coalesce(c[len(c)], 0) AS max_change FROM d",
    "playlist_report": f"""SELECT -3::BIGINT AS i, 'COMPILADO todo_gems_fijo' AS line UNION ALL SELECT -2, 'filtro=todo' UNION ALL SELECT -1, ''
UNION ALL SELECT p_partkey * 4, concat(repeat(' ', greatest(0, 6 - len({_CLOCK('p_partkey * 45')}))::BIGINT), {_CLOCK('p_partkey * 45')}, '  ', p_name, '.mp3') FROM part
UNION ALL SELECT p_partkey * 4 + 1, concat('        ', {_CLOCK('p_size * 30')}, '-', {_CLOCK('(p_size * 30 + 90)')}, '  90s  ', CASE WHEN p_size > 5 THEN concat(p_size * 3, '.0') ELSE 'nan' END, 'bpm') FROM part
UNION ALL SELECT p_partkey * 4 + 2, concat('        tramo: score ', {_TWO('p_size / 100')}, ' | tim ', {_TWO('p_size / 200')}, ' gro nan afi nan ton nan son nan') FROM part
UNION ALL SELECT p_partkey * 4 + 3, '        toma:  ejec nan | int nan cre nan des nan' FROM part""",
    "class_penalties": "SELECT user_id AS n, round(sum(CASE WHEN event_id % 9 IN (1, 4, 7) THEN value ELSE 0 END), 4) AS penalty FROM events GROUP BY user_id",
    "local_files": "WITH f AS (SELECT concat(p_brand, CASE WHEN p_partkey % 2 = 0 THEN '.MP3' ELSE '.mp3' END) AS name, p_size::BIGINT AS size, p_partkey % 3 AS folder FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 7 <> 0) SELECT name, size, concat('r/', max(folder), '/', name) AS path FROM f GROUP BY name, size",
    "name_matches": "WITH n AS (SELECT DISTINCT upper(string_split(p_name, ' ')[1]) AS name FROM part UNION SELECT concat(p_name, '.MP3') FROM part), l AS (SELECT name, replace(lower(name), '.mp3', '') AS low FROM n), x AS (SELECT name, p_partkey FROM l JOIN part ON lower(p_name) = low) SELECT * FROM x UNION ALL SELECT name, p_partkey FROM l JOIN part ON contains(lower(p_name), low) WHERE name NOT IN (SELECT name FROM x)",
}
