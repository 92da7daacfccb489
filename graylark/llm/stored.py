"""Intermediate tables in the shared folder that the cluster names, and sketches of word frequencies."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells and rows of the frequency sketch: its size doesn't depend on the data.
CELL_BITS, ROWS = 15, 3


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master, where it is unset (tests), one of our own is set; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graylark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths of the tables written so far, for :func:`release`.
_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: its lineage is cut and every executor can read it.

    The table stays until :func:`discard`, :func:`release` or the end of the program: what reads it may run at any time.
    """
    if not _written:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit, df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/graylark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _written.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`stored` wrote and nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


def _at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session is gone
        pass


def release(spark: SparkSession) -> None:
    """Delete all tables written so far: to be called when the results that need them have been written."""
    while _written:
        _delete(spark, _written.pop())


BLANKS = re.compile("[ \t\r\n]+")
ODD_BLANKS = re.compile("[\x0b\x0c]")


def words(text: str) -> list[bytes]:
    """Pieces of the lower-cased text between spaces, tabs, CR and LF."""
    low = text.lower()
    if ODD_BLANKS.search(low):
        return [x.encode("utf-8", "surrogatepass") for x in BLANKS.split(low) if x]
    return low.encode("utf-8", "surrogatepass").split()


def word_hashes(text: str) -> np.ndarray:
    """Distinct word hashes, sorted."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, set(words(text))), dtype=np.uint64))


def cells_of(hashes: np.ndarray, bits: int = CELL_BITS, rows: int = ROWS) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch."""
    return [((hashes >> np.uint64(bits * r)) & np.uint64((1 << bits) - 1)).astype(np.int64) for r in range(rows)]


def count_table(df: DataFrame, column: str, hashes=word_hashes, bits: int = CELL_BITS, rows: int = ROWS) -> tuple[np.ndarray, int]:
    """A sketch of how many texts hold each hash, and the number of texts; all texts are counted.

    Each task counts into a sketch of fixed size and sends its cells as rows, which are summed by cell: no task ever holds
    more than one sketch, however many there are.  Only the sums reach the driver.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(rows * size, dtype=np.int64), 0
        for batch in batches:
            chunk = []
            for text in batch.column(0).to_pylist():
                if text and not text.isspace():
                    n += 1
                    chunk.append(hashes(text))
            if chunk:
                for r, c in enumerate(cells_of(np.concatenate(chunk), bits, rows)):
                    total[r * size : (r + 1) * size] += np.bincount(c, minlength=size)
        cells = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.append(cells, -1), pa.int32()), "n": pa.array(np.append(total[cells], n), pa.int64())})

    sums = df.select(column).mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, n = sums.column("cell").to_numpy(), sums.column("n").to_numpy()
    total = np.zeros(rows * size, dtype=np.int64)
    total[cells[cells >= 0]] = n[cells >= 0]
    return total.reshape(rows, size), int(n[cells < 0].sum())


def counts_of(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The count of each hash, never less than the true one."""
    rows, size = table.shape
    return np.minimum.reduce([table[r][c] for r, c in enumerate(cells_of(hashes, size.bit_length() - 1, rows))])


def frequent_table(df: DataFrame, column: str, share: float, hashes=word_hashes) -> np.ndarray:
    """Which sketch cells count more than ``share`` of all texts."""
    total, n = count_table(df, column, hashes)
    return total > max(share * n, 8)


def is_frequent(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    c = cells_of(hashes)
    return table[0][c[0]] & table[1][c[1]] & table[2][c[2]]


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Non-blank rows with non-null key."""
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"[^ \t\r\n]"))
