"""Corpus preparation: profile, label mapping, filters, de-duplication, splits and their statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graylark.functions.columns import is_blank, strip
from graylark.functions.constants import LABELS

TEST_SHARE, VALIDATION_SHARE = (15, 100), (15, 100)
SEED = 42


class SchemaError(ValueError):
    """A required column is missing."""


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns {missing}; found {df.columns}")
    return df


def _shown(c: Column, size: int) -> Column:
    return F.concat(F.left(c, F.lit(size)), F.when(F.length(c) > size, "…").otherwise(""))


def profile(df: DataFrame, order: str, examples: int = 5, size: int = 60) -> DataFrame:
    """Per column: rows, non-null and distinct values, and the first distinct values in order of appearance.

    The ranking keeps only the first few values of each column before it shuffles them.
    """
    names = [c for c in df.columns if c != order]
    long = df.select(F.col(order).alias("_o"), *[F.col(c).cast("string").alias(c) for c in names]).unpivot("_o", names, "column", "value")
    first = long.where("value is not null").groupBy("column", "value").agg(F.min("_o").alias("at"), F.count("*").alias("n"))
    counts = first.groupBy("column").agg(F.sum("n").alias("non_null"), F.count("*").alias("distinct_values"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("at", "value"))).where(F.col("rank") <= examples)
    shown = ranked.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", _shown(F.col("value"), size).alias("v")))).alias("e"))
    rows = long.groupBy("column").agg(F.count("*").alias("row_count"))
    out = rows.join(counts, "column", "left").join(shown, "column", "left")
    return out.select(
        "column", "row_count", F.coalesce("non_null", F.lit(0)).cast("bigint").alias("non_null"), F.coalesce("distinct_values", F.lit(0)).cast("bigint").alias("distinct_values"),
        F.coalesce(F.array_join(F.transform("e", lambda x: x["v"]), " | "), F.lit("")).alias("examples"),
    )


def parse_label_map(text: str) -> dict[str, int]:
    """``name=0,other=1`` as a mapping; the last = divides, so names may hold one."""
    out = {}
    for part in text.split(","):
        name, sep, value = part.rpartition("=")
        if not sep:
            raise ValueError(f"no label in {part!r}")
        out[name.strip()] = int(value)
    return out


def map_labels(df: DataFrame, column: str, mapping: Mapping[str, int], to: str = "label") -> DataFrame:
    """Adds the mapped label; values are looked up as they are, then by their trimmed text; unknown ones become null."""
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(int(v)))])
    text = F.col(column).cast("string")
    return df.withColumn(to, F.coalesce(F.try_element_at(table, text), F.try_element_at(table, strip(text))))


def unmapped(df: DataFrame, column: str, label: str = "label", limit: int = 10) -> list[str]:
    """Up to ``limit`` distinct values without a label."""
    rows = df.where(F.col(label).isNull()).select(F.col(column).cast("string").alias("v")).distinct().orderBy("v").limit(limit).collect()
    return [r.v for r in rows]


def checked_labels(df: DataFrame, column: str, label: str = "label", drop: bool = False) -> DataFrame:
    """Rows with a label; other values are an error that names some of them, or are dropped."""
    if not drop:
        bad = unmapped(df, column, label)
        if bad:
            raise ValueError(f"values without a label: {bad}")
    return df.where(F.col(label).isNotNull())


def prepend_subject(df: DataFrame, subject: str, text: str, to: str = "text") -> DataFrame:
    return df.withColumn(to, strip(F.concat(F.coalesce(F.col(subject).cast("string"), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(text).cast("string"), F.lit("")))))


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def keep_first(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per text, the one that comes first, by a 256-bit digest of the text.

    A grouped minimum: copies of a hot text combine before the shuffle, and the key is short whatever the texts' lengths.
    """
    rest = [c for c in df.columns if c not in (text, order)]
    keyed = df.withColumn("_digest", F.unhex(F.sha2(F.col(text), 256)))
    first = keyed.groupBy("_digest").agg(F.min(F.struct(order, *rest, text)).alias("_f"))
    return first.select(*[F.col(f"_f.{c}").alias(c) for c in df.columns])


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def label_distribution(df: DataFrame, label: str = "label", names: Mapping[int, str] | None = None) -> DataFrame:
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    name = F.lit(None).cast("string")
    for k, v in (names or LABELS).items():
        name = F.when(F.col("label") == k, v).otherwise(name)
    return counts.withColumn("name", name).orderBy("label")


def _ranked(df: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Row numbers per ``keys`` in ``order``, of which ``bucket`` must be a prefix: counts per range, then ranks within ranges."""
    placed = df.withColumn("_range", bucket)
    sizes = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select(*keys, "_range", (F.sum("_c").over(upto) - F.col("_c")).alias("_start"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    return placed.withColumn("_in", F.row_number().over(within)).join(starts, [*keys, "_range"]).withColumn("_rank", F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def _quotas(counts: list[tuple[int, int]], wanted: int) -> dict[int, int]:
    """``wanted`` divided over the classes in proportion, by largest remainder, smaller labels first among equals."""
    n = sum(c for _, c in counts)
    if not n:
        return {}
    out = {k: c * wanted // n for k, c in counts}
    left = wanted - sum(out.values())
    for k, _ in sorted(counts, key=lambda x: (-(x[1] * wanted % n), x[0]))[:left]:
        out[k] += 1
    return out


def split(df: DataFrame, key: str, label: str = "label", seed: int = SEED, test: tuple[int, int] = TEST_SHARE, validation: tuple[int, int] = VALIDATION_SHARE) -> DataFrame:
    """Adds ``split``: test takes ceil(share * rows), validation its share, train the rest, each in the proportions of the labels.

    Rows are ordered by a hash of the key and the seed, so the split is the same wherever it runs.  If a split would
    have fewer rows than there are classes, or there is one class, the classes are ignored.  Only class counts reach the driver.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    counts = sorted((r[0], r[1]) for r in df.groupBy(label).agg(F.count("*")).collect())
    n = sum(c for _, c in counts)
    n_test = -(-n * test[0] // test[1])
    n_val = -(-(n - n_test) * validation[0] // (validation[1] - test[0] * validation[1] // test[1])) if n else 0
    grouped = len(counts) > 1 and test[0] * n // test[1] >= len(counts) and n_val >= len(counts)
    if grouped:
        q_test = _quotas(counts, n_test)
        q_val = _quotas([(k, c - q_test[k]) for k, c in counts], n_val)
        keyed = hashed.withColumn("_class", F.col(label))
    else:
        q_test, q_val = {0: n_test}, {0: n_val}
        keyed = hashed.withColumn("_class", F.lit(0))
    ranked = _ranked(keyed, ["_class"], ["_h", key], F.left("_h", F.lit(3)))
    limit = lambda q: F.element_at(F.create_map(*[x for k, v in q.items() for x in (F.lit(k), F.lit(v))]), F.col("_class")) if q else F.lit(0)
    part = F.when(F.col("_rank") <= limit(q_test), "test").when(F.col("_rank") <= limit(q_test) + limit(q_val), "val").otherwise("train")
    return ranked.withColumn("split", part).select(*df.columns, "split")


def split_stats(df: DataFrame, label: str = "label") -> DataFrame:
    """Per split: rows and rows of each label."""
    columns = [F.sum(F.when(F.col(label) == k, 1).otherwise(0)).alias(v) for k, v in LABELS.items()]
    return df.groupBy("split").agg(F.count("*").alias("total"), *columns)
