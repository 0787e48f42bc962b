"""Table, manifest, line and delimited-file readers, and the sinks that go with them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numbers import rounded


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def place() -> Column:
    """Where a row of a Parquet table that was just read stands: its file and its number there, the order in which one reader would see it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def manifest(spark: SparkSession, path: str, keys: list[str], schema: StructType | None = None) -> DataFrame:
    """Records of a JSON document: the list under the first of ``keys`` that is present, or the document itself if it is a list.

    A single JSON list reads as one row per element already.
    """
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    found = [k for k in keys if k in df.columns]
    if not found:
        return df
    return df.select(F.explode(F.coalesce(*[F.col(k) for k in found])).alias("record")).select("record.*")


def manifest_lists(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """As ``manifest``, but a key only counts if its value is a list."""
    df = spark.read.option("multiLine", True).json(path)
    lists = [k for k in keys if k in df.columns and df.schema[k].dataType.typeName() == "array"]
    return df.select(F.explode(F.coalesce(*[F.col(k) for k in lists])).alias("record")).select("record.*") if lists else df


def checked_manifest(rows: DataFrame, key: str = "id", match: str = "match_id", half: str = "half") -> DataFrame:
    """Rows with a problem column: null where the id is unique, the match is named and the half is 1 or 2."""
    number = F.col(half).cast("string").try_cast("int")
    whole = number.isNotNull() & F.col(half).cast("string").rlike(r"^\s*[12]\s*$")
    repeated = F.count("*").over(Window.partitionBy(key)) > 1
    problem = (
        F.when(F.coalesce(F.trim(key), F.lit("")) == "", "no id").when(repeated, "repeated id")
        .when(F.coalesce(F.trim(match), F.lit("")) == "", "no match").when(~F.coalesce(whole, F.lit(False)), "half is not 1 or 2")
    )
    return rows.withColumn("problem", problem)


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Line-delimited JSON; blank lines are skipped and lines that don't parse keep their text in _corrupt_record."""
    with_bad = StructType([*schema.fields]).add("_corrupt_record", "string")
    return spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files that may be split over tasks: lines are counted per split, and splits add up in file order."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = text.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    splits = splits.select("file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return text.join(splits, ["file", "_at"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def checked_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Line-delimited JSON as file, line, record and problem (with the line's number where it is no object); blank lines are skipped. Files without any other line are an error."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    if not lines.limit(1).count():
        raise ValueError(f"no lines in {path}")
    parsed = F.from_json("value", StructType([*schema.fields]).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = lines.withColumn("_r", parsed)
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | ~F.trim("value").startswith("{")
    record = F.struct(*[F.col(f"_r.{f}").alias(f) for f in schema.fieldNames()])
    return lines.select("file", "line", F.when(~bad, record).alias("record"), F.when(bad, F.format_string("line %d is no JSON object", "line")).alias("problem"))


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header; every column is a string, as providers write them."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*columns) if columns else df


def last_wins(rows: DataFrame, keys: list[str], sequence: list[Column]) -> DataFrame:
    """Of rows with equal keys the one that comes last by an explicit sequence."""
    order = Window.partitionBy(*keys).orderBy(*[s.desc_nulls_last() for s in sequence])
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def only_keys(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is wanted."""
    return rows.join(wanted.select(*on).distinct(), on, "left_semi")


def boxes(images: DataFrame, annotations: DataFrame, categories: list[int]) -> DataFrame:
    """Ground-truth boxes of labelled images: frame (file stem less one), track_id, x1, y1, x2, y2."""
    labelled = images.where("is_labeled").select("image_id", (F.regexp_extract("file_name", r"(\d+)\.[^.]*$", 1).cast("int") - 1).alias("frame"))
    chosen = annotations.where(F.col("category_id").isin(categories)).select("image_id", "track_id", "bbox_image.*")
    return chosen.join(labelled, "image_id").select("frame", "track_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))


def newest_file(spark: SparkSession, glob: str, id_pattern: str) -> DataFrame:
    """id, path: of the non-empty files of each id (a group of the path) the one modified last."""
    files = spark.read.format("binaryFile").load(glob).where("length > 0").select("path", "modificationTime")
    named = files.withColumn("id", F.regexp_extract("path", id_pattern, 1))
    return named.groupBy("id").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """path, bytes, sha256 of each file."""
    return spark.read.format("binaryFile").load(glob).select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def label_map(df: DataFrame, column: str, allowed: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """key, label of a map column, beside the columns to keep; a label outside the list fails the query."""
    pairs = df.select(*keep, F.explode(column).alias("key", "label"))
    bad = F.raise_error(F.concat(F.lit("label not allowed: "), F.coalesce("label", F.lit("null"))))
    return pairs.withColumn("label", F.when(F.col("label").isin(allowed), F.col("label")).otherwise(bad))


def resolve(df: DataFrame, fixed: DataFrame, on: list[str], column: str, default: str) -> DataFrame:
    """A reviewed value from ``fixed`` where there is one, else the row's own, else a neutral default."""
    joined = df.join(fixed.select(*on, F.col(column).alias("_fixed")), on, "left")
    source = F.when(F.col("_fixed").isNotNull(), "reviewed").when(F.col(column).isNotNull(), "own").otherwise("neutral")
    return joined.withColumn("source", source).withColumn(column, F.coalesce("_fixed", column, F.lit(default))).drop("_fixed")


def frame_count(probed: Column, duration: Column, rate: Column) -> Column:
    """An exact count where it is positive, else duration times rate."""
    return F.coalesce(F.when(probed > 0, probed), F.when((duration > 0) & (rate > 0), F.bround(duration * rate).cast("long")))


def write_table(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Replace a Parquet table. The old one goes first, so a failed job leaves none; ``write_versions`` keeps it."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_versions(parts: dict[str, DataFrame], root: str, same_rows: bool = True) -> str:
    """Write tables that belong together as one version below ``root``, and make it the current one last.

    Each part is a Parquet table in a new folder of the version. Once all are written, and
    with ``same_rows`` hold equally many rows, the file CURRENT is replaced by one rename, so
    readers see all of the old version or all of the new one. A job that dies before leaves
    the old one as it was; what it wrote stays beside it, and nothing points there. Of
    writers at one time the last rename counts. Returns the version's name.
    """
    if not parts:
        raise ValueError("no tables to write")
    spark = next(iter(parts.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, df in parts.items():
        df.write.parquet(f"{root}/{version}/{name}")
    if same_rows:
        counts = {name: spark.read.schema(df.schema).parquet(f"{root}/{version}/{name}").count() for name, df in parts.items()}
        if len(set(counts.values())) > 1:
            raise ValueError(f"parts differ in rows: {counts}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    made, current = fs.Path(f"{root}/{version}/NAME"), fs.Path(f"{root}/CURRENT")
    out = made.getFileSystem(conf).create(made)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(made.getFileSystem(conf).getUri(), conf).rename(made, current, options)
    return version


def read_version(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version, by name."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = fs.Path(f"{root}/{version}")
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return {f.getPath().getName(): spark.read.parquet(f.getPath().toString()) for f in found if f.isDirectory()}


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files without a byte below the folders and files that a glob names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(at) or []:
        files = system.listFiles(status.getPath(), True)
        while files.hasNext():
            file = files.next()
            if not file.getLen() and not file.getPath().getName().startswith(("_", ".")):
                found.append(file.getPath().toString())
    return found


def isolated_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """path, record, reason: of every file one JSON object; a file that isn't one is a row with the reason in place of a record.

    Files are parsed in tasks, each by itself, so none ends the run. The reason is "empty
    file", "not UTF-8" or "no JSON object of this kind" (a field of another type included).
    Fields that a file lacks are null. A file is one row, 2 GB at most. Spark's readers pass
    over empty files, so the driver lists those.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.unionByName(spark.createDataFrame([(p, b"") for p in _empty_files(spark, path)], "path string, content binary"))
    text = F.expr("try_validate_utf8(content)").alias("text")
    parsed = F.from_json("text", StructType([*schema.fields]).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = files.select("path", F.length("content").alias("bytes"), text).withColumn("_r", parsed)
    reason = (
        F.when(F.col("bytes") == 0, "empty file").when(F.col("text").isNull(), "not UTF-8")
        .when(F.col("_r").isNull() | F.col("_r._bad").isNotNull() | ~F.coalesce(F.col("text").rlike(r"^\s*\{"), F.lit(False)), "no JSON object of this kind")
    )
    record = F.struct(*[F.col(f"_r.{f}").alias(f) for f in schema.fieldNames()])
    return rows.withColumn("reason", reason).select("path", F.when(F.col("reason").isNull(), record).alias("record"), "reason")


def vectors_as_json(df: DataFrame, id_col: str, vector: str, digits: int = 7) -> DataFrame:
    """One JSON string per row with the vector rounded, as a search index takes it."""
    return df.select(F.to_json(F.struct(F.col(id_col).alias("id"), F.transform(vector, lambda x: rounded(x, digits)).alias("vector"))).alias("value"))
