"""Sources and sinks: documents in files, typed tables, immutable and idempotent writes."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import text as T

MAX_BYTES = 200 << 20
TAIL = 8 << 10


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; a temporary one only where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='corpusloom-')}")
    return df.checkpoint()


def read_model(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON objects, one a file; a malformed one fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def unknown_keys(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(path, key) of JSON keys that the schema lacks."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("path", F.input_file_name())
    return raw.select("path", F.explode(F.json_object_keys("value")).alias("key")).filter(~F.col("key").isin(schema.fieldNames()))


def read_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a parser's content list with their place in it."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("path", F.input_file_name())
    items = F.from_json("value", "array<struct<type:string,text:string,text_level:int,page_idx:int,bbox:array<double>,table_body:string>>")
    return raw.select("path", F.posexplode(items).alias("pos", "item")).select("path", "pos", "item.*").filter("page_idx IS NOT NULL")


def pdf_faults(content: Column, name: Column, most: int = MAX_BYTES) -> Column:
    """Why a file isn't a sound PDF: extension, size, header, version or end mark."""
    head = F.decode(F.substring(content, 1, 8), "ISO-8859-1")
    tail = F.decode(F.substring(content, -TAIL, TAIL), "ISO-8859-1")
    rule = lambda bad, why: F.when(bad, F.lit(why))
    return F.array_compact(
        F.array(
            rule(~F.lower(name).endswith(".pdf"), "extension"),
            rule((F.length(content) == 0) | (F.length(content) > most), "size"),
            rule(~head.startswith("%PDF-"), "header"),
            rule(~head.rlike(r"^%PDF-[12]\.\d"), "version"),
            rule(~F.contains(tail, F.lit("%%EOF")), "end"),
        )
    )


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with digest and faults; contents are not collected."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), pdf_faults(F.col("content"), F.col("path")).alias("faults"))


def artifact_kind(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.endswith(".zip"), "archive")
        .when(low.rlike(r"content_list[^/]*\.json$"), "content_list")
        .when(low.rlike(r"middle[^/]*\.json$"), "layout")
        .when(low.endswith(".json"), "json")
        .when(low.rlike(r"\.(md|markdown)$"), "markdown")
        .when(low.rlike(r"\.(png|jpe?g|gif|webp)$"), "image")
        .when(low.endswith(".pdf"), "pdf")
        .otherwise("other")
    )


def unsafe_members(members: DataFrame, name: str) -> DataFrame:
    """Archive members that are absolute, climb up, are reserved or differ by case only."""
    low = F.lower(name)
    same = members.groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    bad = F.col(name).rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)|\\") | low.rlike(r"(^|/)(con|prn|aux|nul|com\d|lpt\d)(\.|/|$)")
    return members.join(same, low == F.col("low")).filter(bad | (F.col("n") > 1)).select(members.columns)


# Sinks


def write_once(df: DataFrame, path: str) -> None:
    """Create a table; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the table lacks; how many there were."""
    known = df.sparkSession.read.parquet(path).select(key)
    new = checkpointed(df.join(known, key, "left_anti").dropDuplicates([key]))
    new.write.mode("append").parquet(path)
    return new.count()


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that occur in ``df`` and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def delete_rows(spark: SparkSession, path: str, by: str, keys: DataFrame) -> DataFrame:
    """The table without the given keys; the caller writes it elsewhere or to a new version."""
    return spark.read.parquet(path).join(keys.select(by), by, "left_anti")


def corpus_view(documents: DataFrame, chunks: DataFrame, tombstones: DataFrame, works: DataFrame) -> DataFrame:
    """Chunks of documents that aren't deleted, with their works."""
    return chunks.join(documents.join(tombstones.select("document_id"), "document_id", "left_anti"), "document_id").join(works, "document_id", "left")


def checksum_faults(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Paths whose digest differs from the expected one or that are missing."""
    return expected.join(files.select("path", F.col("sha256").alias("found")), "path", "left").filter("found IS NULL OR found <> sha256").select("path", "found")


def to_relative(path: Column, root: str) -> Column:
    """A path below the root as a relative one; null if it leaves the root."""
    flat = F.regexp_replace(path, r"\\", "/")
    inside = F.startswith(flat, F.lit(root.rstrip("/") + "/")) & ~flat.rlike(r"(^|/)\.\.(/|$)")
    return F.when(inside, F.substring(flat, len(root.rstrip("/")) + 2, 1 << 20))


def lexical_records(documents: DataFrame, chunks: DataFrame, references: DataFrame) -> DataFrame:
    """Searchable rows: titles, chunk texts and references."""
    row = lambda df, kind, id_, text: df.select(F.lit(kind).alias("object_type"), F.col(id_).cast("string").alias("object_id"), "document_id", text.alias("text"))
    own = row(documents, "title", "document_id", F.col("title"))
    own = own.unionByName(row(chunks, "chunk", "chunk_id", T.first_text(F.col("retrieval_text"), F.col("text"))))
    return own.unionByName(row(references, "reference", "reference_id", F.col("raw_text"))).filter(F.trim("text") != "")
