"""Command line: ``python -m graylark.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    return SparkSession.builder.appName("graylark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graylark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("rules", "layer one for messages"), ("score", "the whole funnel"), ("predict", "layer two only"), ("attribute", "funnel with attribution")):
        c = sub.add_parser(name, help=text)
        c.add_argument("path", help="an .eml file, a directory, or - for standard input")
        c.add_argument("--ensemble", action="store_true")
        c.add_argument("--model")
        c.add_argument("--url", default="http://127.0.0.1:11434")
        c.add_argument("--indent", type=int)
    c = sub.add_parser("prep", help="map, filter and de-duplicate a raw CSV")
    c.add_argument("csv")
    c.add_argument("--text-column", default="text")
    c.add_argument("--label-column", default="label")
    c.add_argument("--subject-column")
    c.add_argument("--label-map")
    c.add_argument("--drop-unmapped", action="store_true")
    c.add_argument("--inspect", action="store_true")
    c.add_argument("--out")
    c = sub.add_parser("build", help="splits from corpora")
    c.add_argument("--csv", nargs="*", default=[])
    c.add_argument("--directory")
    c.add_argument("--demo", action="store_true")
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--out", required=True)
    c = sub.add_parser("train", help="fit and save a classifier")
    c.add_argument("--data", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--binary", action="store_true")
    c = sub.add_parser("evaluate", help="metrics of a classifier over a labelled CSV")
    c.add_argument("--csv", required=True)
    c.add_argument("--model")
    c.add_argument("--out")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    return globals()[f"run_{args.command}"](spark, args)


def _messages(spark, path):
    from graylark.sources.readers import from_text, read_messages

    return from_text(spark, sys.stdin.read()).select(F.lit("").alias("path"), F.lit("-").alias("file"), "raw_eml") if path == "-" else read_messages(spark, path)


def _scorer(args):
    from graylark.operators.scorer import lexical_scorer, mllib_scorer
    from graylark.sources.writers import load_model

    if not getattr(args, "model", None):
        return lexical_scorer
    model, labels = load_model(args.model)
    return lambda df, text: mllib_scorer(df, text, model, labels)


def _print(df, indent=None) -> int:
    from graylark.sources.writers import json_document

    if "path" in df.columns:  # results in the order of the files; the messages themselves are never sorted
        df = df.orderBy("path").drop("path")
    for row in df.select(json_document(*df.columns).alias("j")).toLocalIterator():
        print(json.dumps(json.loads(row.j), indent=indent, ensure_ascii=False))
    return 0


def run_rules(spark, args) -> int:
    from graylark.plans.funnel import LAYER1, assessed

    return _print(assessed(_messages(spark, args.path)).select("path", "file", *LAYER1), args.indent)


def run_score(spark, args) -> int:
    from graylark.plans.funnel import analyze

    return _print(analyze(_messages(spark, args.path), scorer=_scorer(args), ensemble=args.ensemble), args.indent)


def run_predict(spark, args) -> int:
    from graylark.operators.scorer import predicted
    from graylark.plans.funnel import assessed

    rows = predicted(_scorer(args)(assessed(_messages(spark, args.path)), "full_text"), "full_text")
    return _print(rows.select("path", "file", "predicted_label", "confidence", "probabilities", "text_preview", "error"), args.indent)


def run_attribute(spark, args) -> int:
    from graylark.operators.attribution import http_provider, probe
    from graylark.plans.funnel import analyze

    model = args.model or "llama3.2"
    ok, _ = probe(args.url, model)
    return _print(analyze(_messages(spark, args.path), run_layer3=True, provider=http_provider(args.url, model) if ok else None, model=model, ensemble=args.ensemble), args.indent)


def run_prep(spark, args) -> int:
    from graylark.operators import corpus
    from graylark.sources.readers import read_csv_any
    from graylark.sources.writers import CSV

    rows = read_csv_any(spark, args.csv).withColumn("_seq", F.monotonically_increasing_id())
    if args.inspect:
        return _print(corpus.profile(rows, "_seq"))
    corpus.require(rows, args.text_column, args.label_column, *([args.subject_column] if args.subject_column else []))
    rows = corpus.prepend_subject(rows, args.subject_column, args.text_column) if args.subject_column else rows.withColumn("text", F.col(args.text_column))
    if args.label_map:
        rows = corpus.map_labels(rows, args.label_column, corpus.parse_label_map(args.label_map))
        rows = corpus.checked_labels(rows, args.label_column, drop=args.drop_unmapped)
    else:
        rows = rows.withColumn("label", F.col(args.label_column).cast("int"))
    rows = corpus.keep_first(corpus.drop_empty(rows.select("_seq", "text", "label")), "text", "_seq").select("text", "label")
    if args.out:
        rows.write.mode("overwrite").options(**CSV).csv(args.out)
    return _print(corpus.label_distribution(rows))


def run_build(spark, args) -> int:
    from graylark.operators import corpus
    from graylark.sources.readers import demo_corpus, read_csv_corpus, read_label_directory
    from graylark.sources.writers import write_splits

    frames = [read_csv_corpus(spark, p).withColumn("label", F.col("label").cast("int")) for p in args.csv]
    frames += [read_label_directory(spark, args.directory)] if args.directory else []
    frames += [demo_corpus(spark)] if args.demo else []
    rows = corpus.drop_empty(corpus.union_all(*frames)).withColumn("_seq", F.monotonically_increasing_id())
    rows = corpus.split(corpus.keep_first(rows, "text", "_seq").withColumn("_key", F.md5("text")), "_key", seed=args.seed).drop("_key", "_seq")
    write_splits(rows, args.out)
    return 0


def run_train(spark, args) -> int:
    from graylark.functions.constants import BINARY_LABELS, LABELS
    from graylark.operators.scorer import select_model
    from graylark.sources.readers import read_splits
    from graylark.sources.writers import save_model

    data = read_splits(spark, args.data)
    model, reg = select_model(data.where("split = 'train'"), data.where("split = 'val'"), binary=args.binary)
    save_model(model, args.out, BINARY_LABELS if args.binary else LABELS)
    print(json.dumps({"regularisation": reg}))
    return 0


def run_evaluate(spark, args) -> int:
    from graylark.functions.constants import LABELS
    from graylark.operators.metrics import metrics_document
    from graylark.operators.scorer import predicted
    from graylark.sources.readers import evaluation_rows, read_csv_any
    from graylark.sources.writers import markdown_report, write_bytes, write_sidecar

    rows = evaluation_rows(read_csv_any(spark, args.csv))
    index = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(v), F.lit(k))])
    extra = ["rules_pred"] if "rules_pred" in rows.columns else []
    pairs = predicted(_scorer(args)(rows, "text"), "text").select(F.col("label").alias("y"), F.element_at(index, F.col("predicted_label")).alias("p"), *extra)
    metrics = metrics_document(pairs.where("p is not null"))
    if args.out:
        write_sidecar(f"{args.out}/metrics.json", metrics)
        write_bytes(f"{args.out}/report.md", markdown_report(metrics).encode())
    print(json.dumps(metrics, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
