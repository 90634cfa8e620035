import io
import math
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from takerank.functions import audio, columns
from takerank import commands
from takerank.operators import dates, duplicates, evaluation, feedback, ledger, order, scoring, segments
from takerank.plans import oracles
from takerank.sources import adapters, files

NAN = float("nan")


def test_ranks_are_average_ranks(spark):
    x = [3.0, 1.0, 1.0, None, NAN, 7.0, 3.0, 3.0]
    df = spark.createDataFrame([(i, v, 5.0, None if i else 2.0) for i, v in enumerate(x)], "k long, a double, b double, c double")
    got = scoring.percentile_ranks(df, ["k"], ["a", "b", "c"]).toPandas().pivot(index="k", columns="feature", values="rank")
    want = pd.Series([v if v == v else None for v in x], dtype=float).rank(method="average", pct=True).fillna(0.5)
    assert np.allclose(got["a"], want)
    assert np.allclose(got["b"], 0.5625)
    assert (got["c"] == 0.5).all()


def test_missing_feature_keeps_its_weight(spark):
    df = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 2.0)], "path string, widx int, pulse_clarity double")
    got = scoring.dimensions(df, ["path", "widx"], {"groove": {"pulse_clarity": (1, 0.4), "band_sync": (1, 0.6)}}).toPandas()
    assert sorted(got.groove) == pytest.approx([0.2, 0.4])


def windows(spark, rows):
    return spark.createDataFrame([(p, float(s), v, 0.0, 100.0) for p, s, v in rows], "path string, start double, score double, silence_ratio double, tempo double")


def test_best_run(spark):
    w = windows(spark, [("gap", 0, 0.9), ("gap", 60, 0.9), ("gap", 90, 0.5), ("gap", 120, 0.5), ("short", 0, 0.1), ("tie", 0, 0.5), ("tie", 30, 0.5), ("tie", 60, 0.5), ("lone", 0, 0.1), ("lone", 90, 0.8), ("lone", 180, 0.3)])
    got = {r.path: (r.ini, r.fin) for r in segments.best_run(w, 2).collect()}
    assert got == {"gap": (60.0, 120.0), "short": (0.0, 30.0), "tie": (0.0, 60.0), "lone": (90.0, 120.0)}


def test_streaks_and_trim(spark):
    w = windows(spark, [("a", 0, 0.7), ("a", 30, 0.9), ("a", 60, 0.8), ("a", 120, 0.9), ("a", 150, 0.2)])
    assert [(r.ini, r.fin, r.n) for r in segments.streaks(w, 0.6).collect()] == [(0.0, 90.0, 3)]
    assert [(r.ini, r.fin, r.n) for r in segments.streaks(w, 0.6, most=2).collect()] == [(30.0, 90.0, 2)]


def test_budget_keeps_the_crossing_row(spark):
    s = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 100.0)], "i long, len double")
    assert [r.i for r in segments.budget(s, [F.col("i")], 150, F.col("len")).collect()] == [1, 2]
    assert [r.i for r in segments.budget(s, [F.col("i")], 200, F.col("len")).collect()] == [1, 2]


def test_overlap_of_exactly_half_is_kept(spark):
    s = spark.createDataFrame([("a", 0.0, 60.0), ("a", 60.0, 120.0), ("a", 31.0, 91.0), ("b", 0.0, 60.0)], "path string, ini double, fin double")
    used = spark.createDataFrame([("a", 30.0, 90.0)], s.schema)
    assert {(r.path, r.ini) for r in segments.avoid_used(s, used).collect()} == {("a", 0.0), ("a", 60.0), ("b", 0.0)}


def test_duplicate_groups_chain(spark):
    rows = [("a", 10.0, [1.0, 0.0, 0.0]), ("b", 11.0, [1.0, 0.01, 0.0]), ("c", 13.0, [1.0, 0.02, 0.0]), ("d", 50.0, [1.0, 0.0, 0.0]), ("e", 10.0, [0.0, 1.0, 5.0]), ("n", 10.0, None)]
    df = spark.createDataFrame(rows, "path string, duration double, sig array<double>")
    got = {r.path: r.group for r in duplicates.duplicate_groups(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_last_session(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"), (3, "2024-01-02 12:00:00"), (4, "2024-01-03 00:00:00")], "i long, t string").withColumn("ts", F.to_timestamp("t"))
    assert {r.i for r in ledger.last_session(df, "ts").collect()} == {2, 3, 4}
    assert {r.i for r in ledger.last_session(df, "ts", 11.9).collect()} == {4}


def test_votes_with_undo(spark):
    rows = [(1, 1, 1, "2024-01-01", "like"), (2, 1, 1, "2024-01-03", "undo"), (3, 1, 2, "2024-01-02", "star"), (4, 1, 2, "2024-01-05", "nota"), (5, 2, 1, "2024-01-04", "like")]
    e = spark.createDataFrame(rows, "event_id long, usuario long, tramo long, t string, evento string").withColumn("ts", F.to_timestamp("t"))
    assert {(r.usuario, r.tramo, r.evento) for r in ledger.vote_state(e, ["usuario", "tramo"]).collect()} == {(1, 2, "star"), (2, 1, "like")}


def test_answers(spark):
    df = spark.createDataFrame([("LOTE 2 (x): 1 A, 2 b; 3:ambos, 4 what",)], "t string")
    got = ledger.parse_answers(df, "t").select("num", "choice", "bad").collect()
    assert [tuple(r) for r in got] == [(1, "A", False), (2, "B", False), (3, "ambos", False), (None, None, True)]


def test_bradley_terry(spark):
    m = spark.createDataFrame([("x", "y", 3.0), ("y", "x", 1.0)], "winner string, loser string, weight double")
    bt = {r.item: r.bt for r in evaluation.bradley_terry(m).collect()}
    assert bt["x"] == pytest.approx(-bt["y"]) and bt["x"] > 0


def test_p_value():
    assert evaluation.p_value(0.5, 20) == pytest.approx(0.0248, abs=1e-3)
    assert evaluation.p_value(0.0, 20) == pytest.approx(1.0)


def test_diverse_backfills(spark):
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [0.99, 0.01], [-1.0, 0.1], [0.0, 1.0]])]
    df = spark.createDataFrame(rows, "i long, sig array<double>")
    got = [r.i for r in duplicates.diverse(df, [F.col("i")], 4, 0.5).orderBy("pick").collect()]
    assert sorted(got) == [0, 1, 2, 3] and got[0] == 0 and got[-1] == 1


def test_diverse_walks_past_a_hot_group(spark):
    rows = [(-1, None), *((i, [1.0, 0.0, i * 1e-6]) for i in range(40)), (50, [-1.0, 0.1, 0.0]), (51, [0.9, 1.0, 0.0]), (52, [0.9, -1.0, 0.0])]
    df = spark.createDataFrame(rows, "i long, sig array<double>")
    got = [r.i for r in duplicates.diverse(df, [F.col("i")], 3, 0.5, block=5).orderBy("pick").collect()]
    assert got == [0, 50, 51]
    assert [r.i for r in duplicates.diverse(df.where("i < 40"), [F.col("i")], 3, 0.99, block=5).orderBy("pick").collect()][0] == 0
    none = spark.createDataFrame([(i, None) for i in range(4)], "i long, sig array<double>")
    assert [r.i for r in duplicates.diverse(none, [F.col("i")], 3).orderBy("pick").collect()] == [0, 1, 2]


def test_tempo_columns(spark):
    df = spark.createDataFrame([(86.0, 172.0), (100.0, 100.0), (None, 3.0)], "a double, b double")
    got = df.select(columns.tempo_ratio(F.col("a"), F.col("b")), columns.tempo_distance(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.15), (1.0, 0.0), (1.0, 1.0)]


def test_windows_of_a_signal():
    assert [s for _, s, _ in audio.windows(np.zeros(15), 1)] == [0.0]
    assert list(audio.windows(np.zeros(14), 1)) == []
    assert len(list(audio.windows(np.zeros(45), 1))) == 2


def _wav(y, sr=22050):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_features_of_known_signals(spark):
    sr = 22050
    t = np.arange(10 * sr) / sr
    sine = audio.window_features(0.5 * np.sin(2 * np.pi * 440 * t), sr)
    assert sine["centroid"] == pytest.approx(440, rel=0.1) and max(range(12), key=lambda i: sine[f"chroma_{i}"]) == 9
    clicks = np.zeros(10 * sr)
    clicks[:: sr // 2] = 1.0
    assert audio.window_features(clicks, sr)["tempo"] == pytest.approx(120, rel=0.06)
    assert audio.window_features(np.zeros(10 * sr), sr)["is_silent"] == 1
    df = spark.createDataFrame([("a.wav", _wav(0.5 * np.sin(2 * np.pi * 440 * t))), ("b.wav", b"junk")], "path string, content binary")
    got = {(r.path, r.status) for r in audio.extract(df, win=5.0, hop=5.0).collect()}
    assert got == {("a.wav", "ok"), ("b.wav", "error")}


def test_score_log(spark):
    lines = [(0, "Procesando: a.mp3"), (1, "score: 0.5"), (2, "Procesando: b.mp3"), (3, "error reading"), (4, "Procesando: c.mp3"), (5, "score: 1.5")]
    got = files.score_log(spark.createDataFrame(lines, "n long, value string")).collect()
    assert {(r.file, r.score) for r in got} == {("a.mp3", 0.5), ("b.mp3", None), ("c.mp3", 1.5)}


def test_vote_stream_equals_batch(spark, tmp_path):
    from takerank.streaming import views

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"event_id":1,"usuario":1,"tramo":1,"ts":"2024-01-01T00:00:00Z","evento":"like"}\nbroken\n{"event_id":2,"usuario":1,"tramo":1,"ts":"2024-01-02T00:00:00Z","evento":"star"}\n')
    q = views.votes_in_force(views.vote_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("votes_now").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.usuario, r.tramo, r.evento) for r in spark.sql("select * from votes_now").collect()] == [(1, 1, "star")]
    assert math.isfinite(1.0)


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, usuario long, compilado string, tramo long, toma string, t string, evento string, deshace string").withColumn("ts", F.to_timestamp("t")).drop("t")


def test_votes_notes_and_their_undos(spark):
    e = events(spark, [
        (1, 1, "c", 1, "a", "2024-01-01", "like", None), (2, 1, "c", 1, "a", "2024-01-02", "dislike", None),
        (3, 1, "c", 2, "a", "2024-01-01", "star", None), (4, 1, "c", 2, "a", "2024-01-02", "undo", "nota"),
        (5, 1, "c", 3, "a", "2024-01-01", "like", None), (6, 1, "c", 3, "a", "2024-01-02", "undo", None),
        (7, 1, "c", 4, "a", "2024-01-03", "like", None), (8, 1, "c", 4, "a", "2024-01-02", "undo", None), (9, 2, "c", 2, "b", "2024-01-02", "nota", None),
    ])
    keys = ["usuario", "compilado", "tramo"]
    assert {r.event_id for r in ledger.vote_state(e, keys).collect()} == {1, 3, 7}
    assert {r.event_id for r in ledger.vote_state(e, keys, kinds=ledger.VOTES).collect()} == {2, 3, 7}
    assert [r.event_id for r in ledger.note_state(e, keys).collect()] == [9]


def test_votes_move_with_all_they_hold(spark):
    votes = spark.createDataFrame([(1, 7, "c1", 2, "a", "like", "x", 0.0, 60.0), (2, 7, "c1", 0, "b", "nota", "y", 0.0, 60.0), (3, 7, "c2", 1, "z", "star", None, 0.0, 60.0), (4, 7, "c1", 5, "d", "like", None, 0.0, 60.0)], "vote_id long, usuario long, compilado string, tramo long, toma string, evento string, texto string, ini double, fin double").withColumn("ts", F.lit("2024-05-01").cast("timestamp"))
    c = spark.createDataFrame([("a", "c1", 9, 500.0, 560.0), ("a", "c3", 2, 0.0, 60.0), ("b", "c3", 4, 100.0, 160.0), ("b", "c4", 1, 30.0, 90.0), ("d", "c1", 5, 0.0, 60.0)], "toma string, compilado string, tramo long, ini double, fin double")
    homes = ledger.rehome(votes, c)
    assert {(r.vote_id, r.new_compilado, r.new_tramo) for r in homes.collect()} == {(1, "c1", 9), (2, "c4", 1), (3, None, None), (4, "c1", 5)}
    got = {(r.vote_id, r.evento, r.compilado, r.tramo, r.texto, r.deshace, r.nota_ts is not None) for r in ledger.corrections(votes.drop("ini", "fin"), homes, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert got == {(1, "undo", "c1", 2, None, None, False), (1, "like", "c1", 9, "x", None, False), (2, "undo", "c1", 0, None, "nota", True), (2, "nota", "c4", 1, "y", None, False), (3, "undo", "c2", 1, None, None, False)}


def test_all_words_of_answers(spark):
    df = spark.createDataFrame([("LOTE1: 1 ambas, 2=ninguna;3: los dos\n4-LAS DOS, 5B, 6.A, 7 A B",)], "t string")
    got = ledger.parse_answers(df, "t").select("num", "choice", "bad").collect()
    assert [tuple(r) for r in got] == [(1, "ambos", False), (2, "ninguno", False), (3, "ambos", False), (4, "ambos", False), (5, "B", False), (None, None, True), (None, None, True)]


def test_totals_in_an_order(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v")).repartition(5)
    got = order.running(df, [F.col("v"), F.col("id").desc()], {"before": F.col("v"), "n": F.lit(1)}).collect()
    rows = sorted(((r.v, -r.id, r.before, r.n) for r in got))
    total = 0
    for i, (v, _, before, n) in enumerate(rows):
        assert (before, n) == (total, i)
        total += v
    assert {r.id: r.rank for r in order.ranked(df, [F.col("id")]).collect()} == {i: i + 1 for i in range(5000)}


def test_exact_quantiles_with_hot_values(spark):
    x = [float(i % 50 if i % 3 else 7) for i in range(3000)] + [None, NAN]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, a double")
    r = scoring.quantile_row(df, "a", {"p": 0.0, "q": 0.37, "r": 0.6, "s": 1.0}).first()
    assert np.allclose([r.p, r.q, r.r, r.s], np.quantile(x[:3000], [0, 0.37, 0.6, 1]))
    got = scoring.percentile_ranks(df, ["i"], ["a"]).toPandas().sort_values("i")["rank"]
    assert np.allclose(got, pd.Series(x).rank(pct=True).fillna(0.5))


def test_chain_by_tempo(spark):
    p = spark.createDataFrame([("a", 0.0, 60.0, 100.0), ("b", 0.0, 60.0, None), ("c", 5.0, 60.0, 161.5), ("d", 0.0, 60.0, 80.0), ("a", 90.0, 120.0, 104.0), ("e", 0.0, 60.0, 89.0)], "path string, ini double, fin double, tempo double")
    got = [(r.path, r.ini) for r in segments.tempo_chain(p, [F.col("path"), F.col("ini")]).orderBy("position").collect()]
    assert got == [("d", 0.0), ("e", 0.0), ("a", 0.0), ("a", 90.0), ("c", 5.0), ("b", 0.0)]


def test_levels_beats_and_dates(spark):
    p = spark.createDataFrame([(1, -20.0), (2, -18.0), (3, float("-inf")), (4, -18.4)], "i long, dbfs double")
    assert {r.i: r.gain_db for r in segments.level_gains(p).collect()} == {1: 2.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert {r.i: r.gain_db for r in segments.level_gains(p.withColumn("dbfs", F.col("dbfs") + 10)).collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    beats = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0)], "path string, beat double")
    points = spark.createDataFrame([("a", 1.5), ("a", 7.5), ("a", 7.4), ("b", 1.0)], "path string, t double")
    assert [(r.t, r.snapped) for r in segments.snap_to_beat(points, beats).orderBy("path", "t").collect()] == [(1.5, 1.0), (7.4, 7.4), (7.5, 9.0), (1.0, 1.0)]
    assert dates.since(months=2, now=dates.since(day="2024-03-31")).isoformat() == "2024-01-31T00:00:00+00:00" and segments.criterion("interes") == "score" and segments.criterion("groove") == "groove"


def test_pairs_are_drawn_by_quota(spark):
    rows = [(f"p{i}", f"t{i % 6}" if i % 9 else None, f"g{i % 8}" if i % 5 else None, float(i * 37 % 101), i * 53 % 97 / 97, i * 29 % 97 / 97) for i in range(120)]
    c = spark.createDataFrame(rows, "path string, topic string, group string, score_med double, interes double, ejecucion double")
    got = feedback.draw_pairs(c, 20, 3).collect()
    by = {r[0]: r for r in rows}
    assert [r.num for r in got] == list(range(1, 21)) and len({frozenset((r.a, r.b)) for r in got}) == 20
    for r in got:
        a, b = by[r.a], by[r.b]
        assert r.a != r.b and (a[1] is None or a[1] != b[1]) and (a[2] is None or a[2] != b[2])
    kinds = [r.kind for r in got]
    assert kinds.count("parejos") == 10 and kinds.count("gem_vs_perf") == 4 and kinds.count("azar") == 6
    order_ = sorted(rows, key=lambda r: (r[3], r[0]))
    place = {r[0]: i for i, r in enumerate(order_)}
    assert all(abs(place[r.a] - place[r.b]) <= 6 for r in got if r.kind == "parejos")
    again = feedback.draw_pairs(c, 20, 3, spark.createDataFrame([(r.b, r.a) for r in got], "a string, b string")).collect()
    assert not {frozenset((r.a, r.b)) for r in again} & {frozenset((r.a, r.b)) for r in got}
    assert feedback.quotas(5) == {"parejos": 2, "azar": 2, "gem_vs_perf": 1} and feedback.draw_pairs(c.limit(0), 5).count() == 0


def test_names_beyond_any_cap(spark):
    names = spark.range(10_050).select(F.concat(F.lit("song "), F.col("id").cast("string"), F.lit("x")).alias("name"))
    media = spark.createDataFrame([("my song 10049X take.mp3",), ("song 7x.mp3",)], "toma string")
    assert {(r.name, r.toma) for r in files.match_names(names, media).collect()} == {("song 10049x", "my song 10049X take.mp3"), ("song 7x", "song 7x.mp3")}


def _take(sr, seconds, bpm, pitch, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * sr)) / sr
    y = 0.2 * np.sin(2 * np.pi * pitch * t) + 0.01 * rng.standard_normal(len(t))
    y[:: int(sr * 60 / bpm)] += 0.7
    return _wav(y, sr)


def test_commands_over_a_folder_of_takes(spark, tmp_path):
    sr, root, store = 8000, tmp_path / "takes", f"{tmp_path}/store"
    for i, (name, bpm, pitch) in enumerate([("blues uno", 100, 220), ("blues dos", 101, 330), ("blues tres", 140, 247), ("vals", 90, 440), ("copia", 100, 220), ("marcha", 120, 300)]):
        (root / "2024-05").mkdir(parents=True, exist_ok=True)
        (root / "2024-05" / f"{name}.wav").write_bytes(_take(sr, 26 + 2 * (i % 3) if name != "copia" else 26, bpm, pitch, 0 if name == "copia" else i))
    (root / "broken.wav").write_bytes(b"junk")
    o = commands.Options(sr=sr, win=5.0, hop=5.0)
    assert commands.extract(spark, store, str(root), o, include=["BLUES"]) == 3
    assert commands.extract(spark, store, str(root), o) == 4 and commands.extract(spark, store, str(root), o) == 0
    assert commands.extract(spark, store, str(root), o, retry_errors=True) == 1
    w = files.load_windows(spark, store, o.params)
    assert w.select("path").distinct().count() == 6 and files.load_windows(spark, store, o.params | {"win": 30.0}).count() == 0
    assert w.where("path LIKE '%vals%'").count() == 5
    assert commands.extract(spark, store, str(root), o, include=["vals"], force=True) == 1
    assert files.load_windows(spark, store, o.params).count() == w.count() == w.select("path", "widx").distinct().count()
    assert {r.status for r in files.stored_files(spark, store).collect()} == {"ok", "error"} and files.load_signatures(spark, store).count() == 6
    r = commands.rank(spark, store, o).collect()
    assert [x["rank"] for x in r] == list(range(1, 7)) and len({x.group for x in r}) == 5
    assert [x.names for x in commands.dupes(spark, store, o).collect()] == [["blues uno.wav", "copia.wav"]]
    assert commands.rank(spark, store, o, dedupe=True).count() == 5 and "ibi_cv" in {x.feature for x in commands.diag(spark, store, o).collect()}
    play, document = commands.compile(spark, store, o, top=4, quantile=0.3, silence=1.0, crossfade=0.5)
    d = document.first()
    assert play.count() == len(d.tramos) > 0 and d.compilado == "todo_balance_dinamico" and [t.pos_s for t in d.tramos] == sorted(t.pos_s for t in d.tramos)
    lines = [x.line for x in commands.compilation.report_lines(play, d.compilado, "p").collect()]
    assert lines[0] == "COMPILADO todo_balance_dinamico" and len(lines) == 3 + 4 * play.count()
    used = play.select("path", "ini", "fin")
    fresh, _ = commands.compile(spark, store, o, top=4, quantile=0.3, silence=1.0, crossfade=0.5, used=used)
    assert segments.avoid_used(fresh.select("path", "ini", "fin"), used).count() == fresh.count()
    (tmp_path / "truth.txt").write_text("# known\nvals.wav\n-marcha\nblues\n")
    e = commands.evaluate(spark, store, o, f"{tmp_path}/truth.txt")
    assert e["auc"].first().n_positive == 4 and e["auc"].first().n_negative == 1 and e["median"].first().n == 4
    asked = commands.compare(spark, store, o, n=4, run=1).collect()
    assert [x.num for x in asked] == [1, 2, 3, 4] and commands.open_pairs(spark, store).count() == 4
    bad = commands.answer(spark, store, "Lote 1: 1 A, 2 b; 3 ninguno, 9 A, x").collect()
    assert {(x.token, x.reason) for x in bad} == {("9 A", "no such pair"), ("x", "not understood")} and commands.open_pairs(spark, store).count() == 1
    s = commands.summary(spark, store, o)
    assert s["latent"].count() >= 3 and s["gems"].first().n >= 0
    assert commands.compare(spark, store, o, n=2, run=1).count() == 2 and files.table_or_empty(spark, f"{store}/pairs", commands.PAIRS).agg(F.max("lote")).first()[0] == 2
    (tmp_path / "remote.json").write_text('[{"Path":"a/x.mp3","Name":"x.mp3","Size":3,"ModTime":"2024-05-02T23:30:00Z","ID":"1"},{"Path":"a/Y.MP3","Name":"Y.MP3","Size":4,"ModTime":"2024-06-02T23:30:00Z","ID":"2"},{"Path":"a/z.txt","Name":"z.txt","Size":4,"ModTime":"2024-06-02T23:30:00Z","ID":"3"},{"Path":"a","Name":"a","Size":-1,"ModTime":"2024-06-02T23:30:00Z","ID":"4","IsDir":true}]')
    commands.remember(spark, store, spark.createDataFrame([("1", None, 3, "2024-05-02T23:30:00Z", None)], commands.REMOTE))
    got = {x.id: (x.state, x.target) for x in commands.sync(spark, store, f"{tmp_path}/remote.json", str(root)).collect()}
    assert got == {"1": ("manifest", None), "2": ("download", f"{root}/2024-06/Y.MP3")}
    out = commands.main([store, "--sr", str(sr), "--win", "5", "--hop", "5", "--weight", "timing=1", "--profile", "gems", "--out", f"{tmp_path}/out", "rank"], spark)
    assert out["rank"].count() == 6 and spark.read.option("header", True).csv(f"{tmp_path}/out/rank").count() == 6


def test_grid_and_fingerprints():
    beats = np.arange(0, 20, 1.0)
    off, even = audio.grid(beats, beats[:-1] + 0.25)
    assert off == pytest.approx(0) and even == pytest.approx(1)
    assert math.isnan(audio.grid(beats[:5], beats[:5])[0])
    sr = 8000
    t = np.arange(10 * sr) / sr
    a, b, c = (audio.signature(np.sin(2 * np.pi * f * t) * g, sr) for f, g in ((220, 0.5), (220, 0.45), (330, 0.5)))
    assert len(a) == 32 and np.linalg.norm(a) == pytest.approx(1, abs=1e-6) and a @ b > a @ c
    assert audio.window_features(0.5 * np.sin(2 * np.pi * 440 * 2 ** (0.2 / 12) * t), sr)["tuning_dev"] == pytest.approx(0.2, abs=0.05)
    clicks = np.zeros(30 * sr)
    clicks[:: sr // 2] = 1.0
    f = audio.window_features(clicks, sr)
    assert f["tempo_cont"] == pytest.approx(120, rel=0.1) and 0 < f["pulse_clarity"] < 1


def test_settings_of_bands():
    config = {"banda_default": "x", "bandas": {"x": {"drive": {"salida": {"folder_id": "1"}}}, "y": {"nombre": "Y!"}}}
    assert files.band(config) == {"clave": "x", "nombre": "X", "root": "x", "drive": {"salida": {"folder_id": "1"}}} and files.band(config, "y")["nombre"] == "Y!"
    assert files.remote(config, "salida") == {"resource_key": None, "folder_id": "1"}
    with pytest.raises(KeyError):
        files.remote(config, "ensayos")
    with pytest.raises(KeyError):
        files.band(config, "z")


def test_windows_equal_their_sql_to_the_last_bit(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # more threads cut days into parts and add those up, in another order each run
    # 60 copies of the events of each user, in another order of rows, with some values missing
    con.execute("CREATE TABLE events AS SELECT event_id + copy * 100000 AS event_id, ts, user_id, event_type, CASE WHEN event_id % 17 > 0 THEN value END AS value, props FROM '/root/testdata/sf0.001/events.parquet', range(60) r(copy) ORDER BY hash(event_id, copy)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE TABLE win AS WITH {oracles.EVENT_WINDOWS} SELECT * FROM win")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # days reach over batches
    try:
        got = adapters.windows(spark, str(tmp_path)).toPandas().set_index(["path", "widx"]).sort_index()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = con.execute("SELECT * FROM win").fetch_df().set_index(["path", "widx"]).sort_index()
    assert list(got.index) == list(want.index) and len(got) > 100
    for c in ("start", *oracles.WINDOW_FEATURES):
        pd.testing.assert_series_equal(got[c], want[c], check_exact=True, check_dtype=False)
