"""Readers and writers of requests, corpora, keys, replies, audit and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.audit import AUDIT_SCHEMA

REQUEST_SCHEMA = (
    "request_id string, tenant_id string, conversation_id string, api_key_id string, application string, "
    "model string, messages array<struct<role:string,content:string>>"
)
EXAMPLE_SCHEMA = (
    "id string, lang string, kind string, text string, "
    "spans array<struct<start:int,end:int,entity_type:string>>, note string"
)
KEY_SCHEMA = (
    "key_hash string, api_key_id string, tenant_id string, application string, allowed_models array<string>"
)
CHUNK_SCHEMA = (
    "request_id string, block string, seq bigint, delta string, final boolean, kind string"
)


SCOPE_IDS = ("request_id", "tenant_id", "conversation_id", "api_key_id")


def _refusal() -> Column:
    lacking = F.lit(False)
    for c in SCOPE_IDS:
        lacking = lacking | (F.coalesce(F.col(c), F.lit("")) == "")
    return F.when(lacking, "incomplete_scope").when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "no_messages")


def refused_requests(requests: DataFrame) -> DataFrame:
    """Requests without a complete scope or without messages, with ``reason``."""
    return requests.select(*SCOPE_IDS, F.coalesce("application", F.lit("unknown")).alias("application"), "model", _refusal().alias("reason")).where(
        "reason is not null")


def messages_of(requests: DataFrame) -> DataFrame:
    """One row per message of the requests that ``refused_requests`` does not name."""
    return requests.where(_refusal().isNull()).select(
        *SCOPE_IDS, F.coalesce("application", F.lit("unknown")).alias("application"), "model",
        F.posexplode("messages").alias("idx", "__m"),
    ).select(*SCOPE_IDS, "application", "model", "idx", F.col("__m.role").alias("role"), F.col("__m.content").alias("text"))


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Messages of request records in JSON lines or parquet, and the refused requests."""
    reader = spark.read.schema(REQUEST_SCHEMA)
    requests = reader.parquet(path) if fmt == "parquet" else reader.json(path)
    return messages_of(requests), refused_requests(requests)


def read_corpus(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Examples of one split with the corpus version; empty splits and duplicate ids fail."""
    folder = f"{path.rstrip('/')}/{split}"
    examples = spark.read.schema(EXAMPLE_SCHEMA).json(f"{folder}/*.jsonl").fillna("", "note").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,entity_type:string>>")))
    if not examples.head(1):
        raise ValueError(f"split {split} has no examples")
    if examples.groupBy("id").count().where("count > 1").head(1):
        raise ValueError(f"split {split} has duplicate ids")
    version = spark.read.text(f"{folder}/VERSION").select(F.trim("value").alias("version")).limit(1)
    return examples.withColumns({"split": F.lit(split), "version": version.scalar()})


def write_corpus(examples: DataFrame, path: str) -> None:
    """Examples as JSON lines by split and language."""
    examples.write.mode("overwrite").partitionBy("split", "lang").json(path)


def read_written_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Examples as ``write_corpus`` left them."""
    return spark.read.schema(EXAMPLE_SCHEMA + ", split string").json(path)


def read_keys(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The key dimension: hashes of keys, never the keys."""
    reader = spark.read.schema(KEY_SCHEMA)
    keys = reader.parquet(path) if fmt == "parquet" else reader.json(path)
    return keys.withColumn("allowed_models", F.coalesce("allowed_models", F.array().cast("array<string>")))


def key_dimension(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Key dimension from ``(presented key, id, tenant, application, models)`` rows."""
    import hashlib

    return spark.createDataFrame(
        [(hashlib.sha256(k.encode()).hexdigest(), i, t, a, list(m)) for k, i, t, a, m in rows], KEY_SCHEMA)


def write_audit(audit: DataFrame, path: str, fmt: str = "json", batch_id: str = "0") -> None:
    """Writes the audit events of one batch; a job that is repeated replaces its own events."""
    audit.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch_id").format(fmt).save(path)


def read_audit(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Audit events in their fixed schema."""
    return spark.read.schema(f"{AUDIT_SCHEMA}, batch_id string").format(fmt).load(path).drop("batch_id")


def read_reply_chunks(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 64, arrived: bool = False) -> DataFrame:
    """Reply chunks as a stream of files; with ``arrived`` also when each one came, for deadlines by event time."""
    return (
        spark.readStream.schema(CHUNK_SCHEMA + (", arrived timestamp" if arrived else "")).option("maxFilesPerTrigger", max_files)
        .format(fmt).load(path)
    )


REPORT_PARTS = ("scores", "failures", "gate", "thresholds")


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """An evaluation report as JSON lines, a folder a part: scores, failures, failed thresholds, and the thresholds held against."""
    unknown = set(parts) - set(REPORT_PARTS)
    if unknown:
        raise ValueError(f"a report has no {sorted(unknown)}")
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def read_report(spark: SparkSession, path: str, part: str, schema: str | None = None) -> DataFrame:
    """One part of a written report; ``schema`` is needed for a part without rows."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{path.rstrip('/')}/{part}")


def model_manifest_check(spark: SparkSession, path: str, manifest: str = "model-manifest.json") -> DataFrame:
    """``(file, problem)``: listed files that are missing or changed; bad manifests.

    The files are hashed where they are read, by the ``binaryFile`` source.
    """
    root = path.rstrip("/")
    doc = spark.read.option("multiLine", "true").schema(
        "name string, version string, licence string, languages array<string>, sha256 map<string,string>"
    ).json(f"{root}/{manifest}")
    fields = ("name", "version", "licence", "languages", "sha256")
    incomplete = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    missing_keys = doc.select(F.explode(incomplete).alias("file"), F.lit("missing_key").alias("problem"))
    empty = doc.where("sha256 is not null and cardinality(sha256) = 0").select(
        F.lit(manifest).alias("file"), F.lit("no_digests").alias("problem"))
    listed = doc.select(F.explode("sha256").alias("file", "expected"))
    actual = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        F.regexp_replace("path", f"^.*?{root}/", "").alias("file"), F.sha2("content", 256).alias("digest"))
    compared = listed.join(actual, "file", "left").select("file", F.when(
        F.col("digest").isNull(), "missing_file").when(F.col("digest") != F.lower("expected"), "changed").alias("problem"))
    return missing_keys.unionByName(empty).unionByName(compared.where("problem is not null"))
