import json

import numpy as np
from pyspark.sql import functions as F

from lineflux.sources import landing, readers, writers
from lineflux.streaming import streams


def test_csv_with_mark_keeps_ids_as_text(spark, tmp_path):
    writers.export_csv(spark.createDataFrame([("007", 1.5), ("10", None)], "id string, x double"), tmp_path / "a.csv", mark=True)
    assert (tmp_path / "a.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), "id string, x double, y long").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("007", 1.5, None), ("10", None, None)]


def test_broadcasts(spark, tmp_path):
    event = {"order": 1, "quarter": None, "event_type": "ThreePointer", "team": {"id": "1"}, "player": {"id": "2"}}
    (tmp_path / "77").mkdir()
    (tmp_path / "77" / "b.json").write_text(json.dumps({"rounds": [{"round": 3, "events": [event]}], "score_events": [{"order": 1, "event_point_X": 1.0, "event_point_Y": 2.0}, {"order": 1, "event_point_X": 5.0, "event_point_Y": 6.0}]}))
    r = readers.read_broadcasts(spark, f"{tmp_path}/*/b.json").head()
    assert (r.game_id, r.quarter, r.x_mm, r.y_mm, r.player_id) == ("77", 3, 5.0, 6.0, "2")


def test_dictionary_and_texts(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"a": "x", "b": "", "c": "__REMOVE__ c"}))
    assert [tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "d.json")).collect()] == [("a", "x")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "game_12.txt").write_text("one\ntwo")
    r = readers.read_texts(spark, str(tmp_path / "t")).head()
    assert (r.number, r.text) == (12, "one\ntwo")


def test_scopes(spark):
    games = spark.createDataFrame([("10", "a", "b"), ("9", "b", "c"), ("11", "c", "d")], "game_id string, home_team_id string, away_team_id string")
    logs = spark.createDataFrame([("10", "p", True), ("9", "p", False)], "game_id string, player_id string, appearance boolean")
    ids = lambda df: [r[0] for r in df.collect()]
    assert ids(readers.select_ids(games)) == ["9", "10", "11"]
    assert ids(readers.select_ids(games, team="b")) == ["9", "10"]
    assert ids(readers.select_ids(games, logs=logs, player="p")) == ["10"]


def test_exports(spark, tmp_path):
    writers.export_arrays({"x": spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "x array<double>").coalesce(1)}, tmp_path / "a.npz")
    assert np.load(tmp_path / "a.npz")["x"].shape == (2, 2)
    files = spark.createDataFrame([("a", bytearray(b"xy"))], "name string, content binary")
    writers.append_manifest(files, f"{tmp_path}/m")
    writers.append_manifest(files, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").where(F.col("n_bytes") == 2).count() == 2
    assert json.loads(writers.report(spark.createDataFrame([(1, "é")], "a int, b string")).head()[0]) == {"a": 1, "b": "é"}
    assert writers.filled_template("n = {{n}}", {"n": "3"}) == "n = 3"


def test_texts_land_in_bundles_whose_number_does_not_follow_theirs(spark, tmp_path):
    texts = spark.range(3000).coalesce(2).selectExpr("id", "if(id = 7, null, concat('a\n\"', id, '\n\n')) as t")
    writers.write_texts(texts, "id", "t", f"{tmp_path}/in")
    assert len(list((tmp_path / "in").glob("**/part-*"))) <= 2
    want = {(str(r.id), r.t) for r in texts.collect()}
    assert {tuple(r) for r in readers.read_bundles(spark, f"{tmp_path}/in").collect()} == want
    stream = landing.landed_bundles(spark, f"{tmp_path}/in")
    streams.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/log")
    spark.createDataFrame([("new", "x")], "name string, text string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    streams.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/log")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == 3001 and set(got) == want | {("new", "x")}
