"""Readers of files, and streams."""

import json
import time

from pyspark.sql import functions as F

from segmenta import models, sinks
from segmenta.functions import profiles
from segmenta.sources import files
from segmenta.streaming.turns import talk_per_window, turn_stream


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.gold.json").write_text(json.dumps({"language": "zh", "segments": [{"start": 1.0, "text": " x "}, {"start": 2, "end": 3.5, "text": " "}, {"end": 9.0, "text": "y", "speaker": "S"}]}, indent=1))
    (tmp_path / "b.gold.json").write_text(json.dumps({"asr_bypass": False, "segments": [{"text": "z"}]}))
    (tmp_path / "c.gold.json").write_text("no json")
    (tmp_path / "d.gold.json").write_text(json.dumps({"segments": []}))
    rows = files.transcripts(files.sidecars(spark, str(tmp_path))).collect()
    assert [(r.stem, r.text, r.duration_s, [s.end for s in r.segments]) for r in rows] == [("a", "x y", 9.0, [2.0, 9.0])]


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# note\n\nhot word\nwrong | right\nsame|same\n")
    assert [tuple(r) for r in files.lexicon(spark, str(tmp_path / "l.txt")).collect()] == [("hotword", "hot word", None), ("rule", "wrong", "right"), ("rule", "same", "same")]


def test_probe_and_rates(spark):
    text = "Duration: 01:02:03.5, start\n Stream: Video: h264, yuv420p, 1920x1080, 29.97 fps\n Stream: Audio: aac"
    rows = spark.createDataFrame([(text, "30000/1001"), ("nothing", "0/0"), (None, "25"), ("", "a/b")], "t string, r string")
    got = rows.select(files.probe(F.col("t")).alias("p"), files.fps(F.col("r")).alias("f")).collect()
    assert (got[0].p.width, got[0].p.height, got[0].p.fps, got[0].p.duration, got[0].p.has_audio) == (1920, 1080, 29.97, 3723.5, True)
    assert got[1].p.duration == 0.0 and [round(r.f, 3) for r in got] == [29.97, 0.0, 25.0, 0.0]


def test_manifest_and_config(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("samples:\n  - {id: a, category: solo, file: f.wav, args: [x]}\n  - {id: b}\n")
    assert [(r.id, r.args) for r in files.manifest(spark, str(tmp_path / "m.yaml")).collect()] == [("a", ["x"]), ("b", None)]
    (tmp_path / "c.yaml").write_text("asr: {gap: 1, other: 2}\n")
    assert files.config(str(tmp_path / "c.yaml"), {"asr": {"gap": 3, "other": None}}) == {"asr": {"gap": 3, "other": 2}}


def test_summaries_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([("r1", 0.987, 0.7, "success"), ("r2", None, None, "degraded")], "rec_id string, length_ratio double, sync_score double, status string")
    for r in sinks.summary(runs).collect():
        (tmp_path / r.rec_id).mkdir()
        (tmp_path / r.rec_id / "summary.txt").write_text(r.value)
    got = [tuple(r) for r in files.summaries(spark, f"{tmp_path}/*/summary.txt").orderBy("run_dir").collect()]
    assert got == [("r1", 0.987, 0.7, "success"), ("r2", None, None, "degraded")]
    all_runs = spark.createDataFrame([("run_1", True, 3), ("run_2", True, 0), ("run_3", False, 4)], "run_dir string, has_summary boolean, n_segments int")
    assert [r.run_dir for r in files.latest_run(all_runs).collect()] == ["run_1"]


def test_media_and_frames(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(bytes([0, 0, 3, 4]))
    signal = files.media(spark, str(tmp_path / "x.bin"), lambda b: (100, list(b)))
    assert [(r.idx, r.rms) for r in files.frames(signal, hop_ms=20).orderBy("idx").collect()] == [(0, 0.0), (1, 12.5**0.5)]


def test_signals_at_another_rate_and_of_videos(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(bytes([0, 4, 8, 12]))
    stereo = lambda b: (4, [[x, x + 2] for x in b])
    assert files.media(spark, str(tmp_path / "x.bin"), stereo, target_rate=8).first().samples == [1.0, 3.0, 5.0, 7.0, 9.0, 11.0, 13.0, 13.0]

    def fails(content):
        raise ValueError

    assert files.demuxed(spark, str(tmp_path / "x.bin"), fails, lambda b: (4, list(b))).first().samples == [0.0, 4.0, 8.0, 12.0]
    assert files.demuxed(spark, str(tmp_path / "x.bin"), fails, fails).first().samples == []


def test_segments_of_runs_and_lists_of_samples(spark, tmp_path):
    (tmp_path / "run_1").mkdir()
    (tmp_path / "run_1" / "segments.json").write_text(json.dumps({"segments": [{"index": 0, "source": " a "}, {"index": 1, "source": ""}, {"index": 2, "source": "b"}, {"index": 3}]}))
    assert [tuple(r) for r in files.run_segments(spark, f"{tmp_path}/*/segments.json").collect()] == [("run_1", "a b", 4)]
    listed = spark.createDataFrame([("a.wav", "solo"), ("b.wav", "duo")], "name string, kind string")
    there = spark.createDataFrame([("/x/a.wav",), ("/y/a.wav",)], "path string")
    assert {r.name: r.exists for r in files.samples(listed, there).collect()} == {"a.wav": True, "b.wav": False}


def test_relative_paths_of_a_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("asr: {model: m/x, other: /abs}\nout: results\n")
    got = files.config(str(tmp_path / "c.yaml"), paths=("asr.model", "asr.other", "out", "no.such"))
    assert got == {"asr": {"model": f"{tmp_path.resolve()}/m/x", "other": "/abs"}, "out": f"{tmp_path.resolve()}/results"}


def test_profiles():
    own = {"mine": {"beam_size": 9, "language": None}, "singing": {"beam_size": 7}, "bad": "x"}
    assert profiles.applied({"language": "zh"}, "MINE ", own) == ({"language": "zh", "beam_size": 9, "prompt_profile_active": "mine"}, "mine")
    assert profiles.applied({}, "unknown")[1] == "neutral" and profiles.merged(own)["singing"]["beam_size"] == 7 and profiles.merged(own)["singing"]["max_segment_seconds"] == 6.0


def test_checkpoints_and_reports(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (None, "z", 1)], "id int, s string, at int")
    new = spark.createDataFrame([(1, "c", 2), (2, "d", 5), (3, None, None)], "id int, s string, at int")
    assert sorted(tuple(r) for r in sinks.upserted(old, new, "id", "at").collect()) == [(1, "c", 2), (2, "d", 5), (3, None, None)]
    lines = [r.line for r in sinks.score_report(new, ["id", "s"], F.col("id"), F.col("id") < 3).collect()]
    assert lines[-1] == "2 of 3 passed" and lines[0] == "| id | s | passed |"
    runs = spark.createDataFrame([("r", 0.7), ("q", None)], "rec_id string, sync_score double")
    parts = spark.createDataFrame([("r", 2, 3, "open", 0.5), ("r", 0, 1, "open", 0.4)], "rec_id string, start int, end int, state string, openness double")
    got = {r.rec_id: [s.start for s in r.speech_segments] for r in sinks.timeline_sync(runs, parts, "rec_id").collect()}
    assert got == {"r": [0, 2], "q": []}


def test_repair_and_second_transcripts(spark):
    df = spark.createDataFrame([("今天天气很好", "修正后：「今天天气真好」"), ("今天天气很好", "短"), ("abc", "xyz123"), (None, "abcd")], "text string, made string")
    got = models.repaired(df, lambda p: p.assign(repaired=p["made"])).collect()
    assert [r.text for r in got] == ["今天天气真好", "今天天气很好", "abc", ""]
    first = lambda p: p.assign(text=p["made"], confidence=1.0)
    again = lambda p: p.assign(text="again", confidence=0.5)
    got = models.transcribed_again(df, F.length("text") < 3, first, again).collect()
    assert sorted(r.text for r in got) == sorted(["修正后：「今天天气真好」", "again", "xyz123", "abcd"])


def test_command_line(spark, data, tmp_path, capsys):
    from segmenta.__main__ import main

    assert main(["--list"]) == 0 and "speaker_groups" in capsys.readouterr().out.split()
    assert main(["no such query", "x"]) == 2
    assert main(["coverage", data, str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_a_silent_recording_is_closed(spark, tmp_path):
    """After the given time without rows the last turn comes out and no state is left."""
    source = tmp_path / "in"
    schema = "rec_id string, start_ms bigint, end_ms bigint, speaker string"
    spark.createDataFrame([("r", 0, 100, "A")], schema).coalesce(1).write.parquet(str(source))
    q = turn_stream(spark.readStream.schema(schema).parquet(str(source)), silent_ms=1000).writeStream.format("memory").queryName("closing").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(60):
        time.sleep(1.5)
        spark.createDataFrame([("other", 0, 1, "B")], schema).coalesce(1).write.mode("append").parquet(str(source))
        if any(r.rec_id == "r" for r in spark.table("closing").collect()):
            break
    q.stop()
    assert [(r.speaker, r.n_segments) for r in spark.table("closing").collect() if r.rec_id == "r"] == [("A", 1)]


def test_streams(spark, tmp_path):
    rows = [("r", 0, 100, "A"), ("r", 150, 300, "A"), ("r", 320, 500, "B"), ("r", 900, 1000, "B")]
    spark.createDataFrame(rows, "rec_id string, start_ms bigint, end_ms bigint, speaker string").withColumn("ingested_at", F.timestamp_millis(F.col("start_ms"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rec_id string, start_ms bigint, end_ms bigint, speaker string, ingested_at timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("turns", turn_stream(stream), "append"), ("talk", talk_per_window(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("turns").collect()) == [("r", "A", 0, 300, 2), ("r", "B", 320, 500, 1)]
    assert [(r.n, r.talk_ms) for r in spark.table("talk").collect()] == [(4, 530)]
