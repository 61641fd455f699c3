"""Experiments: a configuration over a dataset to a report of metrics; sweeps; intervals."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.operators import graph, metrics
from weftmark.plans import stats
from weftmark.plans.config import Config, combinations, read, toml
from weftmark.plans.pipeline import Outcome, Pipeline
from weftmark.runtime import materialize
from weftmark.sources.readers import DATASETS, Dataset


def dataset(spark: SparkSession, config: Config) -> Dataset:
    return DATASETS[config["dataset"].name](spark, **config["dataset"].params)


def _concepts(outcome: Outcome, dim: int) -> DataFrame:
    from weftmark.functions import vectors

    rows = graph.concepts(outcome.resolutions)
    hashed = vectors.hashed(rows.select("id", "label"), ["id"], "label", dim)
    return materialize(rows.join(hashed, "id", "left").select("id", "label", vectors.embedding(F.col("counts"), F.col("square"), dim).alias("embedding"), "first_seen", "updated_at"))


def _mentions(outcome: Outcome, truth: dict[str, DataFrame]) -> DataFrame:
    """(mention, predicted, gold); raises unless predictions and gold cover each other."""
    key = F.concat("doc_id", F.lit(":"), F.col("span_start").cast("string"), F.lit("-"), F.col("span_end").cast("string")).alias("mention")
    predicted = outcome.resolutions.select(key, F.col("concept_id").alias("predicted"))
    gold = truth["clusters_by_mention"].select(key, F.col("cluster").alias("gold"))
    metrics.check_coverage(predicted, gold)
    return predicted.join(gold, "mention")


def run_on(spark: SparkSession, config: Config, documents: DataFrame, truth: dict[str, DataFrame]) -> dict[str, dict[str, float]]:
    """Metric values by metric name and key, of the documents given."""
    pipeline = Pipeline(spark, config)
    outcome = pipeline.run(documents)
    concepts, relations = _concepts(outcome, pipeline.dim), materialize(graph.relations(outcome.induced))
    out: dict[str, dict[str, float]] = {}
    for m in config.families["metrics"]:
        if m.name == "label-f1":
            row = metrics.label_f1(concepts, truth["concept_labels"])
        elif m.name == "edge-f1":
            row = metrics.edge_f1(concepts, relations, truth["is_a_edges"])
        elif m.name == "redundancy":
            row = metrics.redundancy(concepts, **m.params)
        else:
            row = metrics.hierarchy_sanity(relations)
        out[m.name] = {k.replace("_at_", "@").replace("_", "-") if m.name != "edge-f1" else k: float(v) for k, v in row.first().asDict().items()}
    for m in config.families["document_metrics"]:
        if m.name == "f1-at-k":
            row = metrics.f1_at_k(outcome.selected, truth["keyphrases_by_document"], tuple(m.params.get("ks", (5, 10, 15))))
        elif m.name == "clustering":
            row = metrics.clustering(_mentions(outcome, truth))
        else:
            row = metrics.coherence(outcome.resolutions, pipeline.dim)
        out[m.name] = {k.replace("_at_", "@").replace("_", "-"): float(v) for k, v in row.first().asDict().items()}
    return out


def run_experiment(spark: SparkSession, config: Config) -> dict:
    """Report: config, documents_processed, errors, metrics."""
    data = dataset(spark, config)
    bad = F.col("doc_id").isNull() | F.col("text").isNull()
    errors = data.documents.filter(bad).count()
    if errors and config.on_error == "fail":
        raise ValueError(f"{errors} documents have no id or no text")
    return {"config": config.plain(), "documents_processed": data.documents.count(), "errors": errors, "metrics": run_on(spark, config, data.documents.filter(~bad), data.truth)}


def run_sweep(spark: SparkSession, sweep: dict) -> list[dict]:
    """A row a combination: axis names with their parameters, errors, metrics."""
    rows = []
    for choice, config in combinations(sweep):
        report = run_experiment(spark, config)
        row = {f"axis:{n}": s.name for n, s in choice.items()} | {f"params:{n}": json.dumps(s.params, sort_keys=True) for n, s in choice.items() if s.params}
        row |= {f"{m}.{k}": v for m in sorted(report["metrics"]) for k, v in sorted(report["metrics"][m].items())}
        rows.append(row | {"errors": report["errors"]})
    return rows


def write_sweep(rows: list[dict], folder: str | Path) -> None:
    """sweep-report.json and a Markdown table of the union of columns, floats to four digits."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "sweep-report.json").write_text(json.dumps(rows, indent=2, sort_keys=True))
    columns = list(dict.fromkeys(k for row in rows for k in row))
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(row.get(c, "")) for c in columns) + " |" for row in rows)]
    (folder / "sweep-report.md").write_text("\n".join(lines) + "\n")


def holistic_intervals(spark: SparkSession, config: Config, samples: int, seed: int, level: float = 0.95, fixed: int = 0) -> dict:
    """Percentile intervals from running the pipeline on seeded resamples of the documents; the first ``fixed`` are always kept."""
    data = dataset(spark, config)
    docs = materialize(stats.numbered(data.documents.select("doc_pos", "doc_id", "text"), "doc_pos"))
    n = docs.count()
    estimates = run_on(spark, config, docs, data.truth)
    drawn: dict[tuple[str, str], list[float]] = {}
    for positions in stats.seeded_draws(n, samples, seed, fixed):
        order = spark.createDataFrame(list(enumerate(positions)), "slot long, position long")
        again = order.join(docs.drop("doc_pos"), "position").select(F.col("slot").alias("doc_pos"), "doc_id", "text")
        for m, values in run_on(spark, config, again, data.truth).items():
            for k, v in values.items():
                drawn.setdefault((m, k), []).append(v)
    out: dict[str, dict] = {}
    for (m, k), values in drawn.items():
        span = stats.percentile_interval(estimates[m][k], values, level)
        out.setdefault(m, {})[k] = {"estimate": estimates[m][k], "percentile": {"lo": span.lo, "hi": span.hi, "method": span.method}}
    return {"seed": seed, "level": level, "samples": samples, "config": config.plain(), "metrics": out}


def order_spread(spark: SparkSession, config: Config, permutations: int, seed: int, fixed: int = 0) -> dict[str, dict[str, float]]:
    """Spread of each metric over seeded orders of the documents."""
    data = dataset(spark, config)
    docs = materialize(stats.numbered(data.documents.select("doc_pos", "doc_id", "text"), "doc_pos"))
    seen: dict[str, list[float]] = {}
    for order in stats.seeded_orders(docs.count(), permutations, seed, fixed):
        places = spark.createDataFrame([(p, i) for i, p in enumerate(order)], "position long, slot long")
        for m, values in run_on(spark, config, places.join(docs.drop("doc_pos"), "position").withColumnRenamed("slot", "doc_pos"), data.truth).items():
            for k, v in values.items():
                seen.setdefault(f"{m}.{k}", []).append(v)
    out = {}
    for k, values in seen.items():
        mean = sum(values) / len(values)
        out[k] = {"min": min(values), "max": max(values), "range": max(values) - min(values), "std": (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5}
    return out


def keyphrase_intervals(spark: SparkSession, config: Config, samples: int, seed: int, level: float = 0.95) -> dict:
    """Item-level BCa and percentile intervals of f1-at-k from one run: per-document values are resampled in Spark,
    the jackknife of a mean comes from its sums."""
    data = dataset(spark, config)
    outcome = Pipeline(spark, config).run(data.documents)
    docs = materialize(metrics.f1_at_k_documents(outcome.selected, data.truth["keyphrases_by_document"]))
    keys = [c for c in docs.columns if c != "doc_id"]
    boot = stats.bootstrap(docs, "doc_id", [F.avg(k).alias(k) for k in keys], samples, seed).collect()
    left = materialize(stats.jackknife_sums(docs, "doc_id", keys).select(*[(F.col(k) / F.col("kept")).alias(k) for k in keys]))
    means = left.agg(*[F.avg(k).alias(k) for k in keys]).first()
    sums = left.agg(*[F.sum((F.lit(means[k]) - F.col(k)) ** p).alias(f"{k}:{p}") for k in keys for p in (2, 3)]).first()
    estimate = docs.agg(*[F.avg(k).alias(k) for k in keys]).first()
    out = {}
    for k in keys:
        values = [r[k] for r in boot]
        bca, pct = stats.bca_from_moments(estimate[k], values, sums[f"{k}:2"], sums[f"{k}:3"], level), stats.percentile_interval(estimate[k], values, level)
        out[k.replace("_at_", "@")] = {"estimate": estimate[k], "bca": bca.__dict__, "percentile": pct.__dict__}
    return {"seed": seed, "level": level, "samples": samples, "config": config.plain(), "metrics": {"f1-at-k": out}}


def main(arguments: Sequence[str]) -> int:
    """python -m weftmark CONFIG.toml | --sweep SWEEP.toml FOLDER | --intervals CONFIG.toml FOLDER [SAMPLES [SEED]]"""
    if not arguments:
        print(main.__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if arguments[0] == "--sweep":
        write_sweep(run_sweep(spark, toml(arguments[1])), arguments[2])
    elif arguments[0] == "--intervals":
        samples, seed = (int(x) for x in [*arguments[3:], "1000", "0"][:2]) if len(arguments) != 4 else (int(arguments[3]), 0)
        report = holistic_intervals(spark, read(arguments[1], True), samples, seed)
        Path(arguments[2]).mkdir(parents=True, exist_ok=True)
        (Path(arguments[2]) / "interval-report.json").write_text(json.dumps(report, indent=2, sort_keys=True))
    else:
        print(json.dumps(run_experiment(spark, read(arguments[0], True)), indent=2, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
