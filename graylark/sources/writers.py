"""Writers: result JSON, split files, sidecars, metric reports, models.

Small documents go through the Hadoop file system of their path, like Spark's own output: any store that Spark can write to will do.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graylark.functions.constants import LABELS
from graylark.operators.corpus import split_stats


#: How tables with free text are written to CSV and read again: nothing trimmed, line ends and quotes kept.
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: A quoted empty field is an empty text, an unquoted one is null.
CSV_READ = CSV | {"nullValue": "\x00null"}


def scratch(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; on a local master one of our own where it is unset, on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graylark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _store(path: str):
    """The file system of a path, and the path, as the JVM knows them."""
    spark = SparkSession.getActiveSession()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_bytes(path: str, data: bytes) -> None:
    """A small file; directories are made, an existing file is replaced."""
    fs, where = _store(path)
    out = fs.create(where, True)
    out.write(bytearray(data))
    out.close()


def read_text(path: str) -> str | None:
    """A small UTF-8 file; None if there is none."""
    fs, where = _store(path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def json_document(*columns: str) -> Column:
    """One row as JSON, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One directory per split, and beside them the label map and the statistics (tiny documents)."""
    writer = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer.options(**CSV).csv(path)
    else:
        writer.format(fmt).save(path)
    stats = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in split_stats(df).collect()}
    write_sidecar(f"{path}/label_map.json", {str(k): v for k, v in LABELS.items()})
    write_sidecar(f"{path}/stats.json", {"total": sum(s["total"] for s in stats.values()), "splits": stats})


def write_sidecar(path: str, document: Mapping) -> None:
    write_bytes(path, json.dumps(document, indent=2, ensure_ascii=False).encode())


def read_label_map(path: str) -> dict[int, str] | None:
    text = read_text(f"{path}/label_map.json")
    return None if text is None else {int(k): v for k, v in json.loads(text).items()}


def markdown_report(metrics: dict) -> str:
    """The metrics document as a short Markdown page."""
    lines = ["# Evaluation", "", f"Rows: {metrics['n_test']}, accuracy {metrics['accuracy']:.4f}", "", "| class | precision | recall | F1 | support |", "|-|-|-|-|-|"]
    lines += [f"| {k} | {v['precision']:.3f} | {v['recall']:.3f} | {v['f1']:.3f} | {v['support']} |" for k, v in metrics["per_class"].items()]
    m = metrics["macro"]
    lines += [f"| macro | {m['precision']:.3f} | {m['recall']:.3f} | {m['f1']:.3f} | {metrics['n_test']} |", "", "| layer | binary F1 |", "|-|-|"]
    lines += [f"| {k} | {'–' if v is None else format(v, '.4f')} |" for k, v in metrics["binary_f1"].items()]
    return "\n".join(lines) + "\n"


def save_model(model: PipelineModel, path: str, labels: Mapping[int, str] = LABELS) -> None:
    model.write().overwrite().save(path)
    write_sidecar(f"{path}/label_map.json", {str(k): v for k, v in labels.items()})


def load_model(path: str) -> tuple[PipelineModel, dict[int, str] | None]:
    return PipelineModel.load(path), read_label_map(path)


def list_models(root: str) -> list[str]:
    """Names of the model directories below ``root``."""
    fs, where = _store(root)
    if not fs.exists(where):
        return []
    metadata = lambda d: fs.exists(SparkSession.getActiveSession()._jvm.org.apache.hadoop.fs.Path(d, "metadata"))
    return sorted(d.getPath().getName() for d in fs.listStatus(where) if d.isDirectory() and metadata(d.getPath()))


def default_model(root: str) -> str:
    """The three-class model if there is one, else the two-class one, else the first; none is an error."""
    names = list_models(root)
    for wanted in ("3class", "multi", "binary"):
        for n in names:
            if wanted in n:
                return n
    if not names:
        raise FileNotFoundError(f"no model below {root}")
    return names[0]
