"""Queries that write tables in the formats of the writers and read them back."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from ..functions import windows as Wn
from ..operators import ml
from ..sources import landing, readers, writers
from ..streaming import streams
from .registry import query, table
from .streamed import scratch

C = F.col


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, c_name FROM customer")
def csv_ids_as_text(spark, d):
    """CSV parts written and read back with ids as text."""
    to = scratch(spark)
    writers.write_csv(table(spark, d, "customer"), to)
    return readers.read_csv(spark, to, readers.schema_of(strings=["c_custkey", "c_mktsegment", "c_name"]))


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, CAST(NULL AS VARCHAR) AS extra FROM customer")
def csv_other_schema(spark, d):
    """One CSV file with a byte order mark, read in another order with other types and a column that it lacks."""
    to = scratch(spark) + ".csv"
    writers.export_csv(table(spark, d, "customer").select("c_acctbal", "c_custkey", "c_nationkey"), to, mark=True)
    return readers.read_csv(spark, to, "c_custkey long, c_nationkey long, c_acctbal double, extra string")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def loaded_inputs(spark, d):
    """Several CSV inputs loaded by name and queried as views."""
    paths = {n: (scratch(spark), schema) for n, schema in (("loaded_customer", "c_custkey string, c_nationkey string"), ("loaded_nation", "n_nationkey string, n_name string"))}
    for n, (to, _) in paths.items():
        writers.write_csv(table(spark, d, n.removeprefix("loaded_")), to)
    readers.load_inputs(spark, paths)
    return spark.sql("SELECT n_name, count(*) AS n FROM loaded_customer JOIN loaded_nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("""
WITH e AS (SELECT user_id // 20 AS game, row_number() OVER (PARTITION BY user_id // 20 ORDER BY ts, event_id) - 1 AS o, event_type, value, user_id FROM events)
SELECT CAST(game AS VARCHAR) AS game_id, o AS "order", CAST(o // 100 + 1 AS INTEGER) AS quarter, o * 10 AS clock_ms, event_type, CAST(user_id AS VARCHAR) AS player_id,
       CASE WHEN event_type = 'purchase' THEN value + 1 END AS x_mm, CASE WHEN event_type = 'purchase' THEN value * 2 END AS y_mm FROM e""")
def broadcast_events(spark, d):
    """Nested broadcasts, a folder for each game: rounds of events and coordinates by order, of which the last duplicate counts."""
    e = table(spark, d, "events").withColumn("game", F.floor(C("user_id") / 20))
    e = e.withColumn("o", Wn.sequence(["game"], ["ts", "event_id"])).withColumn("round", (F.floor(C("o") / 100) + 1).cast("int"))
    one = F.struct(C("o").alias("order"), F.when(C("o") % 2 == 0, C("round")).alias("quarter"), (C("o") * 10).alias("event_quarter_time"), "event_type", F.struct(C("user_id").cast("string").alias("id")).alias("player"))
    rounds = e.groupBy("game", "round").agg(F.sort_array(F.collect_list(one)).alias("events")).groupBy("game").agg(F.sort_array(F.collect_list(F.struct("round", "events"))).alias("rounds"))
    score = lambda shift: F.struct(C("o").alias("order"), (C("value") + shift).alias("event_point_X"), (C("value") * 2).alias("event_point_Y"))
    shots = e.where("event_type = 'purchase'").groupBy("game").agg(F.flatten(F.collect_list(F.array(score(0), score(1)))).alias("score_events"))
    to = scratch(spark)
    rounds.join(shots, "game", "left").repartition("game").select("game", F.to_json(F.struct("rounds", "score_events")).alias("value")).write.partitionBy("game").text(to)
    return readers.read_broadcasts(spark, f"{to}/*/*").select("game_id", "order", "quarter", "clock_ms", "event_type", "player_id", "x_mm", "y_mm")


@query("SELECT s_suppkey, s_name || chr(10) || 'in ' || s_nationkey AS value FROM supplier")
def text_files(spark, d):
    """Texts of several lines with their names, written in bundles and read back whole."""
    to = scratch(spark)
    writers.write_texts(table(spark, d, "supplier").withColumn("text", F.concat_ws("\n", "s_name", F.concat(F.lit("in "), C("s_nationkey").cast("string")))), "s_suppkey", "text", to)
    return readers.read_bundles(spark, to).select(C("name").cast("long").alias("s_suppkey"), C("text").alias("value"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS value FROM part WHERE p_size % 5 NOT IN (0, 1)")
def json_dictionary(spark, d):
    """A JSON object; empty values and marked ones are left out."""
    value = F.when(C("p_size") % 5 == 0, "").when(C("p_size") % 5 == 1, F.concat(F.lit("__REMOVE__"), "p_name")).otherwise(C("p_name"))
    entries = table(spark, d, "part").select(F.struct(C("p_partkey").cast("string"), value).alias("e")).agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value"))
    to = scratch(spark)
    entries.write.text(to)
    return readers.read_dictionary(spark, to)


@query("SELECT page_id AS id FROM pages WHERE contains(html, 'the') AND page_id BETWEEN 10 AND 1000")
def id_probe(spark, d):
    """Ids of a range whose landed title holds a text."""
    return readers.probe_ids(spark, 10, 1000, table(spark, d, "pages").select(C("page_id").alias("id"), C("html").alias("title")), "the")


GAMES = "g AS (SELECT CAST(o_orderkey AS VARCHAR) AS game_id, CAST(o_custkey % 10 AS VARCHAR) AS home_team_id, CAST(o_custkey % 7 AS VARCHAR) AS away_team_id FROM orders)"


@query(f"""
WITH {GAMES}, l AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS game_id FROM lineitem WHERE l_suppkey = 3 AND l_linenumber <> 2)
SELECT game_id FROM g WHERE (home_team_id = '4' OR away_team_id = '4') AND game_id IN (SELECT game_id FROM l)""")
def id_scope(spark, d):
    """Ids of a team's games in which a player appeared."""
    games = table(spark, d, "orders").select(*(F.expr(x) for x in ("cast(o_orderkey as string) as game_id", "cast(o_custkey % 10 as string) as home_team_id", "cast(o_custkey % 7 as string) as away_team_id")))
    logs = table(spark, d, "lineitem").select(C("l_orderkey").cast("string").alias("game_id"), C("l_suppkey").cast("string").alias("player_id"), (C("l_linenumber") != 2).alias("appearance"))
    return readers.select_ids(games, "4", logs, "3")


@query("SELECT * FROM (VALUES ('n_nationkey', 'int', true), ('n_name', 'string', true), ('n_regionkey', 'int', true)) t(\"column\", type, nullable)")
def schema_listing(spark, d):
    return readers.described(table(spark, d, "nation"))


@query("SELECT s_suppkey, CAST(length(s_name) AS INTEGER) AS n FROM supplier")
def landed_page_stream(spark, d):
    """A stream over texts that have landed in bundles; a rerun takes up only new ones."""
    to = scratch(spark)
    pages = table(spark, d, "supplier").withColumn("text", C("s_name"))
    writers.write_texts(pages, "s_suppkey", "text", f"{to}/in")
    stream = landing.landed_bundles(spark, f"{to}/in").select(C("name").cast("long").alias("s_suppkey"), F.length("text").alias("n"))
    for _ in range(2):
        streams.run_to_table(stream, f"{to}/out", f"{to}/log")
    return spark.read.parquet(f"{to}/out")


@query("""
WITH a AS (SELECT user_id, event_id, event_type <> 'error' AND value >= 5 AS ok, 'b' || event_id AS body FROM events), b AS (SELECT user_id, max(event_id) FILTER (WHERE ok) AS last, count(*) AS attempts FROM a GROUP BY 1),
f AS (SELECT b.user_id, count(*) FILTER (WHERE NOT a.ok AND (b.last IS NULL OR a.event_id > b.last)) AS failures FROM b JOIN a ON a.user_id = b.user_id GROUP BY 1)
SELECT user_id, 'b' || last AS body, attempts, CAST(failures AS BIGINT) AS failures, CAST(CASE WHEN failures = 0 THEN 0 ELSE least(power(2, failures - 1), 60) END AS DOUBLE) AS wait_s FROM b JOIN f USING (user_id)""")
def landed_captures(spark, d):
    """The last good capture by key, failures since, and how long to wait before the next try."""
    a = table(spark, d, "events").select("user_id", "event_id", F.when(C("event_type") == "error", 429).otherwise(200).alias("status"), F.when(C("value") >= 5, F.concat(F.lit("b"), C("event_id").cast("string"))).otherwise("").alias("body"))
    return landing.captures(a, ["user_id"], "event_id", "status", "body")


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2 FROM embeddings")
def arrays_bundle(spark, d):
    """An NPZ bundle of a small export, read back."""
    to = scratch(spark) + ".npz"
    e = table(spark, d, "embeddings").select("vec_id", F.slice(C("embedding").cast("array<double>"), 1, 2).alias("x")).orderBy("vec_id")
    writers.export_arrays({"ids": e.select("vec_id"), "x": e.select("x")}, to)
    back = np.load(io.BytesIO(writers.read_bytes(spark, to)))
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(back["ids"], back["x"])], "vec_id long, x1 double, x2 double")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def json_report(spark, d):
    """Rows as JSON texts, written and read back."""
    to = scratch(spark)
    writers.report(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")).write.text(to)
    return spark.read.schema("p_partkey long, p_name string, p_retailprice double").json(to)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def filtered_copy(spark, d):
    to = scratch(spark)
    writers.copy_filtered(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("toxic = 1"), "doc_id", to)
    return spark.read.parquet(to)


@query("""
WITH f AS (SELECT CAST(page_id AS VARCHAR) AS name, html FROM pages), m AS (SELECT name, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS n_bytes FROM f)
SELECT *, true AS timed FROM m UNION ALL SELECT *, true FROM m""")
def manifest_files(spark, d):
    """An append-only manifest after two runs."""
    to = scratch(spark)
    files = table(spark, d, "pages").select(C("page_id").cast("string").alias("name"), C("html").cast("binary").alias("content"))
    for _ in range(2):
        writers.append_manifest(files, to)
    return spark.read.parquet(to).select("name", "sha256", "n_bytes", C("written_at").isNotNull().alias("timed"))


@query("SELECT vec_id, true AS same FROM embeddings")
def model_bundle(spark, d):
    """Scaler, components and clusters saved as one model: the loaded one labels as the fitted one does."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import array_to_vector

    to = scratch(spark)
    e = table(spark, d, "embeddings").select("vec_id", C("embedding").cast("array<double>").alias("x"))
    model = ml.save_bundle(e, "x", 4, 3, to)
    rows = e.select("vec_id", array_to_vector("x").alias("_v"))
    loaded = PipelineModel.load(to).transform(rows).select("vec_id", C("cluster").alias("again"))
    return model.transform(rows).join(loaded, "vec_id").select("vec_id", (C("cluster") == C("again")).alias("same"))


@query("SELECT n_name, '<h1>' || n_name || '</h1> region ' || n_regionkey || ' of ' || n_name AS page FROM nation")
def filled_pages(spark, d):
    """A template filled for each row of a small table."""
    rows = writers.small_rows(table(spark, d, "nation"), 1000)
    page = "<h1>{{name}}</h1> region {{region}} of {{name}}"
    return spark.createDataFrame([(r.n_name, writers.filled_template(page, {"name": r.n_name, "region": str(r.n_regionkey)})) for r in rows], "n_name string, page string")
