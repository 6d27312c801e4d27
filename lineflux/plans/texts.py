"""Queries of text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as Wn
from ..operators import text as T
from .registry import query, table

C = F.col


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n_keys FROM events")
def json_flatten(spark, d):
    props = F.from_json("props", "map<string,long>")
    return table(spark, d, "events").select("event_id", "user_id", F.try_element_at(props, F.lit("k")).alias("k"), F.size(props).cast("long").alias("n_keys"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(value) AS INTEGER) % 3 + 1 AS delta, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
q AS (SELECT *, (seq - 1) // 10 + 1 AS quarter, 720 - ((seq - 1) % 10) * 60 AS clock FROM e)
SELECT user_id, CAST(seq AS INTEGER) AS seq, CAST(quarter AS INTEGER) AS quarter, CAST(quarter * 720 - clock AS BIGINT) AS elapsed_s,
       event_type || CASE WHEN event_type = 'purchase' THEN ' made' ELSE '' END AS body, CAST(delta AS INTEGER) AS delta, CAST(CASE WHEN event_type = 'purchase' THEN delta ELSE 0 END AS INTEGER) AS points FROM q""")
def text_line_parse(spark, d):
    """A newest-first log is written for each user and parsed back; quarters of ten events begin with a marker."""
    e = table(spark, d, "events").withColumn("seq", Wn.sequence(["user_id"], ["ts", "event_id"]) + 1)
    e = e.withColumn("quarter", F.floor((C("seq") - 1) / 10) + 1).withColumn("clock", (720 - ((C("seq") - 1) % 10) * 60).cast("int"))
    body = F.concat(C("event_type"), F.when(C("event_type") == "purchase", " made").otherwise(""))
    marker = F.when((C("seq") - 1) % 10 == 0, F.format_string("Q%d start\n", "quarter")).otherwise("")
    entry = F.concat(F.format_string("%02d:%02d\n", F.floor(C("clock") / 60), C("clock") % 60), F.format_string("%d - %d\n", C("seq"), C("seq")), marker, body, F.format_string("\n+%d", F.floor("value").cast("int") % 3 + 1))
    docs = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("seq", entry.alias("t"))), asc=False).alias("l")).select("user_id", F.array_join("l.t", "\n\n").alias("text"))
    return T.parse_log(docs, "user_id", "text")


PHRASES = {"the": "DER", "thea": "DERA", "tion": "SION", "of": "VON"}


@query("SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(text, 'thea', 'DERA'), 'tion', 'SION'), 'the', 'DER'), 'of', 'VON'), ' +', ' ', 'g'), ' ') AS text FROM documents")
def text_translate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.translated(C("text"), PHRASES).alias("text"))


WORDS = "(SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,5}')) AS k FROM benchmark)"
REPLACED = "list_reduce(list_prepend({0}, {1}), lambda acc, k: replace(acc, k, {2}))"


@query(f"""
WITH n AS (SELECT list(k ORDER BY length(k) DESC, k) AS names FROM {WORDS} WHERE length(k) > 3), p AS (SELECT list(k ORDER BY k) AS phrases FROM {WORDS} WHERE length(k) = 3),
l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line_no, trim(regexp_replace({REPLACED.format(REPLACED.format("line", "names", "upper(k)"), "phrases", "reverse(k) || ' '")}, ' +', ' ', 'g'), ' ') AS line FROM l, n, p""")
def translate_by_table(spark, d):
    """Every line by two dictionaries that are tables: names, then phrases with a space after each, the longest first."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,5}"), F.lit(0))).alias("k")).distinct()
    names = T.entries(words.where(F.length("k") > 3).withColumn("v", F.upper("k")), "k", "v")
    phrases = T.entries(words.where(F.length("k") == 3).withColumn("v", F.concat(F.reverse("k"), F.lit(" "))), "k", "v")
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", (C("line_no") + 1).cast("long"))
    return T.translated_by(lines, "line", [names, phrases])


@query("""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT regexp_extract(trim(line, ' '), '^([^ -]+)', 1) AS name FROM l WHERE contains(line, 'the'))
SELECT name, count(*) AS n_lines FROM n WHERE length(name) BETWEEN 2 AND 6 AND NOT regexp_matches(name, '[0-9]') GROUP BY 1""")
def name_mining(spark, d):
    return T.mined_names(table(spark, d, "documents"), "text", "the")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'password=') OR (starts_with(text, 'The') AND length(text) BETWEEN 100 AND 2000)")
def contains_filter(spark, d):
    t = C("text")
    return table(spark, d, "documents").where(F.contains(t, F.lit("password=")) | (F.startswith(t, F.lit("The")) & F.length(t).between(100, 2000))).select("doc_id", "source")


@query("""
WITH n AS (SELECT DISTINCT array_to_string(string_split(p_type, ' ')[1:1 + p_partkey % 2], ' ') AS name FROM part WHERE p_size > 40)
SELECT p_partkey, (SELECT arg_max(name, length(name)) FROM n WHERE p_type = name OR starts_with(p_type, name || ' ')) AS name FROM part""")
def prefix_lookup(spark, d):
    p = table(spark, d, "part")
    names = p.where("p_size > 40").select(F.array_join(F.slice(F.split("p_type", " "), F.lit(1), (1 + C("p_partkey") % 2).cast("int")), " ").alias("name"))
    return T.prefix_lookup(p, "p_partkey", "p_type", names, "name")


@query("""
WITH o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'old' END AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS k, 'new' AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(nullif(o.v, ''), n.v, '') AS v FROM o FULL JOIN n ON o.k = n.k""")
def dictionary_merge(spark, d):
    c = table(spark, d, "customer").select(C("c_custkey").alias("k"))
    old = c.where("k % 2 = 0").withColumn("v", F.when(C("k") % 3 == 0, "").otherwise("old"))
    return T.merged_dictionary(old, c.where("k % 3 = 0").withColumn("v", F.lit("new")), "k", "v")


@query("SELECT page_id, upper(sha256(html)) AS digest, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages")
def content_manifest(spark, d):
    """Rows of an append-only manifest, less the time of writing."""
    return table(spark, d, "pages").select("page_id", F.upper(F.sha2("html", 256)).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
