"""Sources and sinks: seed documents, stored texts, run logs, and tables whose parts are replaced by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVISION = "section string, subsection string, article string, clause string, sub string, heading string, title_path string, text string, status string, struck_down_by string, effective_to string"
DOCUMENT = (
    "doc_id string, doc_title string, doc_type string, act_code string, jurisdiction string, source_url string, verification_status string, default_status string, effective_from string, "
    f"effective_to string, court string, case_year int, case_name string, citation_str string, provisions array<struct<{', '.join(c.replace(' ', ':') for c in PROVISION.split(', '))}>>, paragraphs array<struct<para:string,text:string>>"
)
RUN = "id string, recordedAt string, createdAt string, status string, input struct<text:string>, result string, error string, trace array<string>"


def seed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON documents of a folder with the name of their file, in its order. One object or a list of them in each file."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).json(folder).withColumn("file_name", F.col("_metadata.file_name"))
    return rows.orderBy("file_name")


def checked_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with a reason): a document needs an id of plain characters, a title, a type and a body."""
    body = F.coalesce(F.size("provisions"), F.lit(0)) + F.coalesce(F.size("paragraphs"), F.lit(0))
    missing = F.concat_ws(",", *[F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in ("doc_id", "doc_title", "doc_type")])
    reason = F.when(missing != "", F.concat(F.lit("missing "), missing)).when(~F.col("doc_id").rlike(r"(?i)^[a-z0-9][a-z0-9._-]*$"), "bad doc_id").when(body <= 0, "no body")
    rows = docs.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def provisions(docs: DataFrame) -> DataFrame:
    """One row for each provision or paragraph of each document, with its place."""
    as_provision = F.transform("paragraphs", lambda p: F.struct(p["para"].alias("para"), F.lit("").alias("section"), F.lit("").alias("article"), F.lit("").alias("heading"), p["text"].alias("text")))
    from_provisions = F.transform("provisions", lambda p: F.struct(F.lit("").alias("para"), p["section"].alias("section"), p["article"].alias("article"), p["heading"].alias("heading"), p["text"].alias("text")))
    body = F.when(F.size("provisions") > 0, from_provisions).otherwise(as_provision)
    return docs.select("doc_id", F.posexplode(body).alias("seq", "p")).select("doc_id", "seq", "p.*")


def replace_documents(rows: DataFrame, folder: str, by: str = "doc_id", most_rows: int = 500_000) -> None:
    """Write rows in place of those of the same documents; the parts of all other documents stay. A failed write leaves the old parts."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", most_rows).partitionBy(by).parquet(folder)


def append_runs(runs: DataFrame, folder: str, at: str = "recordedAt") -> None:
    """Append runs as lines of JSON to the folder of their day."""
    runs.withColumn("day", F.left(at, F.lit(10))).write.mode("append").partitionBy("day").json(folder)


def list_runs(spark: SparkSession, folder: str, limit: int = 50, schema: str = RUN) -> DataFrame:
    """The newest runs, at most 200: id, times, status, the first 140 characters of their input and how many events they have. Broken lines are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
    newest = rows.where("id IS NOT NULL").orderBy(F.col("recordedAt").desc(), F.col("id")).limit(max(1, min(200, limit)))
    return newest.select("id", "recordedAt", "status", F.left("input.text", F.lit(140)).alias("preview"), F.coalesce(F.size("trace"), F.lit(0)).alias("events"))


def load_run(spark: SparkSession, folder: str, run_id: str, schema: str = RUN) -> DataFrame:
    """The last record of a run."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder).where(F.col("id") == run_id).orderBy(F.col("recordedAt").desc()).limit(1)
