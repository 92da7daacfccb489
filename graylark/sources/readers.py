"""Readers: single messages, directories, label directories, CSV corpora, splits, literal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graylark.functions.columns import is_blank
from graylark.functions.constants import LABELS
from graylark.operators.corpus import require
from graylark.operators.parse import parsed, subject_and_body_trimmed, with_body
from graylark.operators.scorer import collapse_label
from graylark.sources.writers import CSV_READ


def _lenient(content: Column) -> Column:
    """Bytes as UTF-8 text without what isn't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """``(path, file, raw_eml)`` of one .eml file, or of all below a directory.  Who wants them in order sorts by ``path`` at the end."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not path.endswith(".eml"):
        files = files.option("pathGlobFilter", "*.eml")
    return files.load(path).select("path", file_name(F.col("path")).alias("file"), _lenient(F.col("content")).alias("raw_eml"))


def read_label_directory(spark: SparkSession, path: str) -> DataFrame:
    """``(text, label, source)`` of messages below directories named after the labels; blank ones are left out."""
    names = "|".join(LABELS.values())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.eml").load(path)
    rows = files.select(_lenient(F.col("content")).alias("raw_eml"), file_name(F.col("path")).alias("source"), F.regexp_extract("path", f"/({names})/[^/]*$|/({names})/", 0).alias("_d"))
    label = F.lit(None).cast("int")
    for k, v in LABELS.items():
        label = F.when(F.col("_d").contains(f"/{v}/"), k).otherwise(label)
    body = with_body(parsed(rows.withColumn("label", label).where("label is not null")))
    return body.select(subject_and_body_trimmed(F.col("subject"), F.col("body_text")).alias("text"), "label", "source").where(~is_blank(F.col("text")))


def read_csv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(text, label, source)`` of a CSV with these columns; names of labels become numbers, other values stay as they are."""
    rows = require(spark.read.csv(path, **CSV_READ), "text", "label")
    label = F.col("label")
    for k, v in LABELS.items():
        label = F.when(F.lower(F.col("label")) == v, str(k)).otherwise(label)
    return rows.select("text", label.alias("label"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"))


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every file is valid UTF-8, else ISO-8859-1; decided by a scan, not by the first error."""
    bad = spark.read.format("binaryFile").load(path).where(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count()
    return "ISO-8859-1" if bad else "UTF-8"


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with arbitrary columns, in whichever of the two encodings it is written."""
    return spark.read.csv(path, encoding=sniff_encoding(spark, path), **CSV_READ)


def read_splits(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The split files below ``path`` as one table with the column ``split``; the sidecars beside them are left alone."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, pathGlobFilter="*.csv", **CSV_READ)


def from_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "email_id bigint, raw_eml string")


def training_rows(df: DataFrame, binary: bool = False) -> DataFrame:
    """``(text, label)`` without nulls, the label as a number, collapsed for the two-class task."""
    rows = require(df, "text", "label").select("text", F.col("label").cast("int").alias("label")).dropna()
    return rows.withColumn("label", collapse_label(F.col("label"))) if binary else rows


def evaluation_rows(df: DataFrame) -> DataFrame:
    """Rows with a text; a missing label is an error, raised when the row is read."""
    rows = require(df, "text", "label").where(F.col("text").isNotNull())
    return rows.withColumn("label", F.coalesce(F.col("label").cast("int"), F.raise_error(F.lit("a row of the evaluation set has no label")).cast("int")))


#: A small corpus to try the plumbing with: four ham, three phishing, three machine-written phishing texts.
DEMO = (
    ("Lunch moves to Thursday, same place. Bring the survey results if you have them.", 0),
    ("The backup finished at nine, the report is in the shared folder.", 0),
    ("Minutes of yesterday's call are attached; two items are still open.", 0),
    ("My train is late, please start the review without me.", 0),
    ("URGENT: your mailbox will be closed today, verify your password at http://login.example/verify", 1),
    ("You have won a refund. Click here and enter your card number to claim it.", 1),
    ("Account suspended! Confirm your identity within 24 hours or lose access.", 1),
    ("As discussed with your colleague, I would appreciate it if the outstanding transfer could be completed before noon.", 2),
    ("Following our earlier correspondence, kindly review the revised payment instructions and confirm receipt at your convenience.", 2),
    ("To ensure continued compliance, we invite you to validate your benefits profile through the secure portal.", 2),
)


def demo_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, n, "demo") for t, n in DEMO], "text string, label int, source string")
