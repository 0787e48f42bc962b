"""Queries of the readers and sinks: tables written as files of each kind and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import reviews as V
from ..sources import ledger as L
from ..sources import tables as S
from ..sources.scratch import fresh_folder
from ..sources.tables import table
from .registry import query


def _document(spark, sf_dir, key, *before):
    """One JSON document with the nations under a key; a manifest is a small file."""
    item = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    one = table(spark, sf_dir, "nation").agg(F.to_json(F.struct(*before, F.collect_list(item).alias(key))).alias("value"))
    path = fresh_folder(spark, "manifest")
    one.write.text(path)
    return path


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def manifest_records(spark, sf_dir):
    return S.manifest(spark, _document(spark, sf_dir, "videos"), ["clips", "videos"]).select("id", "name")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def manifest_first_list(spark, sf_dir):
    """The first key holds a text, so the second one's list counts."""
    return S.manifest_lists(spark, _document(spark, sf_dir, "videos", F.lit("none").alias("clips")), ["clips", "videos"]).select("id", "name")


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN ' ' ELSE c_name END AS id, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS match_id, CASE WHEN c_mktsegment = 'BUILDING' THEN '3' ELSE ' 2 ' END AS half FROM customer)
SELECT c_custkey, CASE WHEN trim(id) = '' THEN 'no id' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated id' WHEN match_id = '' THEN 'no match' WHEN half = '3' THEN 'half is not 1 or 2' END AS problem FROM r""")
def checked_manifest(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") == 3, " ").otherwise(F.col("c_name")).alias("id"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("match_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "3").otherwise(" 2 ").alias("half"),
    )
    return S.checked_manifest(c).select("c_custkey", "problem")


@query("""SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type, event_type = 'error' AS bad FROM events WHERE event_type <> 'view'""")
def json_line_problems(spark, sf_dir):
    """Errors are written as broken lines and views as blank ones."""
    e = table(spark, sf_dir, "events")
    path = fresh_folder(spark, "lines")
    e.select(F.when(F.col("event_type") == "error", '{"event_id": ').when(F.col("event_type") == "view", "  ").otherwise(F.to_json(F.struct("event_id", "event_type")))).write.text(path)
    rows = S.checked_json_lines(spark, path, StructType([StructField("event_id", LongType()), StructField("event_type", StringType())]))
    return rows.select("record.event_id", "record.event_type", F.col("problem").isNotNull().alias("bad"))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def delimited_strings(spark, sf_dir):
    path = fresh_folder(spark, "delimited")
    table(spark, sf_dir, "supplier").write.option("header", True).csv(path)
    return S.delimited(spark, path, ["s_suppkey", "s_name", "s_nationkey"])


@query("""SELECT (l_orderkey - 1)::INT AS frame, l_linenumber AS track_id, l_quantity AS x1, l_tax * 100 AS y1, l_quantity + 10 AS x2, l_tax * 100 + l_discount AS y2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_linenumber IN (1, 2)""")
def ground_truth_boxes(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("image_id"), F.format_string("img/%06d.jpg", "o_orderkey").alias("file_name"), (F.col("o_orderstatus") != "P").alias("is_labeled"))
    box = F.struct(F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), F.lit(10.0).alias("w"), F.col("l_discount").alias("h")).alias("bbox_image")
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("image_id"), F.col("l_linenumber").alias("track_id"), F.col("l_linenumber").alias("category_id"), box)
    return S.boxes(images, marks, [1, 2])


@query("SELECT r_name AS id, r_name || ' again' AS content FROM region")
def newest_files(spark, sf_dir):
    """Every region's file is written twice, and once more without content."""
    import time

    r, path = table(spark, sf_dir, "region"), fresh_folder(spark, "versions")
    for number, text in enumerate((F.col("r_name"), F.concat("r_name", F.lit(" again")), None)):
        rows = r.select(F.col("r_name").alias("id"), (F.lit("") if text is None else text).alias("value"))
        (rows.where(F.lit(text is not None))).write.partitionBy("id").text(f"{path}/{number}")
        time.sleep(1.1)
    found = S.newest_file(spark, f"{path}/*/id=*/*.txt", r"id=([^/]+)/")
    lines = S.numbered_lines(spark, f"{path}/*/id=*").select(F.col("file").alias("path"), "value")
    same = lambda c: F.regexp_extract(F.url_decode(F.col(c)), r"/([0-9]/id=.*)$", 1)
    return found.withColumn("k", same("path")).join(lines.select(same("path").alias("k"), F.col("value").alias("content")), "k").select(F.url_decode("id").alias("id"), "content")


@query("SELECT doc_id, unnest(['source', 'lang']) AS key, unnest([CASE WHEN source = 'src0' THEN 'team_a' ELSE 'team_b' END, 'other']) AS label FROM documents")
def label_map_rows(spark, sf_dir):
    side = F.when(F.col("source") == "src0", "team_a").otherwise("team_b")
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("source"), side, F.lit("lang"), F.lit("other")).alias("labels"))
    return S.label_map(d, "labels", ["team_a", "team_b", "other"], ("doc_id",))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def written_table(spark, sf_dir):
    path = fresh_folder(spark, "written")
    S.write_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def written_lines(spark, sf_dir):
    path = fresh_folder(spark, "written-lines")
    S.write_json_lines(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return S.json_lines(spark, path, StructType([StructField("c_custkey", LongType()), StructField("c_name", StringType())]).add("c_acctbal", "double")).drop("_corrupt_record")


@query("SELECT sha256(r_name || chr(10)) AS sha256, (strlen(r_name) + 1)::BIGINT AS bytes FROM region")
def digest_manifest(spark, sf_dir):
    path = fresh_folder(spark, "digests")
    table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.col("r_name").alias("value")).write.partitionBy("id").text(path)
    return S.file_digests(spark, f"{path}/id=*/*.txt").select("sha256", "bytes")


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 7)) AS vector FROM embeddings")
def index_rows(spark, sf_dir):
    rows = S.vectors_as_json(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    parsed = F.from_json("value", "id bigint, vector array<double>")
    return rows.select(parsed.alias("r")).select(F.col("r.id").alias("vec_id"), "r.vector")


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS half, round(event_id % 2700000 / 1000.0, 3) AS seconds, event_type AS label FROM events""")
def annotation_positions(spark, sf_dir):
    """Events as the annotations of one game file each, written and read as JSON lines."""
    e = table(spark, sf_dir, "events")
    half = F.when(F.col("user_id") % 2 == 0, "1 - 12:30").otherwise("2 - 01:02")
    path = fresh_folder(spark, "annotations")
    S.write_json_lines(e.select(F.array(F.struct("event_id", half.alias("gameTime"), (F.col("event_id") % 2700000).cast("string").alias("position"), F.col("event_type").alias("label"))).alias("annotations")), path)
    read = spark.read.schema("annotations array<struct<event_id: bigint, gameTime: string, position: string, label: string>>").json(path)
    return V.annotations(read.select(F.explode("annotations").alias("a")).select("a.*")).select("event_id", "half", F.round("seconds", 3).alias("seconds"), "label")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN 'version is not 1.3' END AS problem FROM lineitem WHERE l_linenumber IN (1, 2, 4)""")
def versioned_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("version", F.when(F.col("l_returnflag") == "A", "1.3").when(F.col("l_returnflag") == "R", "1.2"))
    return V.versioned(li, "version", "1.3", "l_linenumber", [1, 2, 4]).select("l_orderkey", "l_linenumber", "problem")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY o_custkey""")
def newest_valid_state(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice")
    return V.newest_valid(o, "o_custkey", "o_orderdate", F.col("status") == "F", F.col("o_totalprice") > 1000).select("o_custkey", "o_orderkey")


@query("SELECT vec_id, len(embedding)::INT AS dims, label FROM embeddings")
def paired_sink(spark, sf_dir):
    """Vectors and their sidecar rows, committed as one version and joined again."""
    root, rows = fresh_folder(spark, "paired"), table(spark, sf_dir, "embeddings")
    S.write_versions({"tensors": rows.select("vec_id", "embedding"), "sidecar": rows.select("vec_id", "label")}, root)
    now = S.read_version(spark, root)
    return now["tensors"].join(now["sidecar"], "vec_id").select("vec_id", F.size("embedding").alias("dims"), "label")


@query("SELECT n_name AS id, CASE WHEN n_regionkey <> 2 THEN n_nationkey::BIGINT END AS number, CASE WHEN n_regionkey = 2 THEN 'no JSON object of this kind' END AS reason FROM nation")
def isolated_files(spark, sf_dir):
    """One file per nation; those of one region break off inside the object."""
    path = fresh_folder(spark, "isolated")
    whole = F.to_json(F.struct(F.col("n_nationkey").alias("number")))
    cut = F.when(F.col("n_regionkey") == 2, F.substring(whole, 1, 8)).otherwise(whole)
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), cut.alias("value")).write.partitionBy("id").text(path)
    found = S.isolated_documents(spark, f"{path}/id=*/*.txt", StructType().add("number", "long"))
    return found.select(F.url_decode(F.url_decode(F.regexp_extract("path", "id=([^/]*)/", 1))).alias("id"), F.col("record.number").alias("number"), "reason")


@query("""WITH u AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT user_id FROM u GROUP BY user_id HAVING sum(n) >= 10), c AS (SELECT 'counts' AS stage, count(*) AS rows FROM u UNION ALL SELECT 'frequent', count(*) FROM f),
s(run, stage, status) AS (VALUES (1, 'counts', 'written'), (1, 'frequent', 'written'), (2, 'counts', 'current'), (2, 'frequent', 'current'), (3, 'counts', 'current'), (3, 'frequent', 'written')) SELECT run, stage, status, rows FROM s JOIN c USING (stage)""")
def resumed_stages(spark, sf_dir):
    """Three calls over the events: everything runs, nothing does, and the stage whose version changed does."""

    def counts(spark, _):
        return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))

    def frequent(spark, rows):
        return rows.groupBy("user_id").agg(F.sum("n").alias("n")).where("n >= 10")

    root, seen = fresh_folder(spark, "stages"), []
    for run, version in enumerate(("1", "1", "2"), 1):
        done = L.run_stages(spark, root, [L.Stage("counts", (f"{sf_dir}/events.parquet",), counts), L.Stage("frequent", ("counts",), frequent, version)])
        seen += [(run, stage, status, rows.count()) for stage, (status, rows) in done.items()]  # now, as the next call replaces rows
    return spark.createDataFrame(seen, "run int, stage string, status string, rows long")
