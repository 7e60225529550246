"""Command line: run variants over reports, evaluate their outputs, ground stored outputs, compare two annotations."""

from __future__ import annotations

import argparse
import importlib
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _backend(name: str | None):
    """A model factory named module:attribute; without one the deterministic stand-in."""
    from .operators.generate import Stub

    if not name:
        return Stub
    module, attribute = name.split(":")
    return getattr(importlib.import_module(module), attribute)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Each variant's documents and sentinels as JSON in a folder of its name, which evaluate reads; logs and judgements as Parquet beside them."""
    from .operators import generate
    from .sources import reports

    logging.info("run %s over %s", " ".join(a.variants), a.reports)
    docs, backend = reports.load_reports(spark, a.reports, strict=True), _backend(a.backend)
    if "v0" in a.variants:
        _write(*generate.v0(docs, backend), f"{a.output_dir}/v0")
    if set(a.variants) & {"v1", "v2", "v3"}:
        # Written once and read from there: V2 and V3 take V1's stored output, so the model is not asked again.
        ok, failed = generate.v1(docs, backend)
        _write(ok, failed, f"{a.output_dir}/v1")
        ok, _, failed = reports.load_system(spark, f"{a.output_dir}/v1")
    if "v2" in a.variants:
        grounded, judged = generate.v2(ok, docs)
        _write(grounded, failed, f"{a.output_dir}/v2")
        reports.write_results({"v2_claims": judged}, a.output_dir)
    if "v3" in a.variants:
        left, answers, steps = generate.v3(ok, docs, backend)
        _write(left, failed, f"{a.output_dir}/v3")
        reports.write_results({"v3_answers": answers, "v3_log": steps}, a.output_dir)


def _write(docs: DataFrame, failed: DataFrame, path: str) -> None:
    from .sources import reports

    reports.write_documents(docs, path, failed)
    logging.info("wrote %s", path)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scores of the variants that are named; a folder that is not there is an error."""
    from .operators.evaluation import evaluate_folders
    from .sources.reports import write_results

    named = {v: getattr(a, v) for v in ("v0", "v1", "v2", "v3") if getattr(a, v)}
    if not named:
        raise ValueError("no variant to evaluate")
    tables = evaluate_folders(spark, a.gold, named, a.alpha)
    tables["summary"].show(truncate=False)
    tables["tests"].show(truncate=False)
    for row in tables["tests"].orderBy("kind", "comparison").collect():  # a row for each kind and comparison
        p = "no difference" if row["method"] == "none" else f"p = {row['p_value']:.4f} ({row['method']}), {'significant' if row['significant'] else 'not significant'} at {a.alpha}, {row['effect_label']} effect (r = {row['effect_size_r']})"
        print(f"{row['kind']} {row['comparison']}: N = {row['n']}, {p}")
    if a.output:
        write_results(tables, a.output)


def ground(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import generate, grounding
    from .sources import reports

    ok, _, _ = reports.load_system(spark, a.v1_outputs)
    docs, judged = generate.v2(ok, reports.load_reports(spark, a.reports), threshold=a.threshold, strict=a.strict)
    reports.write_documents(docs, f"{a.output_dir}/documents")
    reports.write_results({"claims": judged.where("kept"), "report": grounding.report(judged)}, a.output_dir)


def agree(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import claims, stats
    from .plans import schema
    from .sources import reports

    def own(path: str) -> DataFrame:
        return claims.agreement_claims(reports.read_json(spark, path).select(F.regexp_replace("doc_id", "_(pilot|reannotate)$", "").alias("doc_id"), schema.parse(F.col("json")).alias("doc")))

    x, y = own(a.original), own(a.repeat)
    both = stats.agreement(x, y)
    units = x.union(y).select("doc_id", "pos", F.col("claim").alias("value"))
    scored = both.join(stats.nominal_alpha(units, ["doc_id"]), "doc_id", "left")
    scored.show(truncate=False)
    stats.mean_alpha(scored).show()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="claimspan", description=__doc__)
    p.add_argument("--log", help="file of the log; without one it goes to standard error")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("run")
    c.add_argument("--reports", required=True)
    c.add_argument("--variants", nargs="+", choices=("v0", "v1", "v2", "v3"), default=["v0", "v1", "v2", "v3"])
    c.add_argument("--output-dir", required=True)
    c.add_argument("--backend", help="module:factory of the model")
    c = commands.add_parser("evaluate")
    c.add_argument("--gold", required=True)
    for v in ("v0", "v1", "v2", "v3"):
        c.add_argument(f"--{v}")
    c.add_argument("--output")
    c.add_argument("--alpha", type=float, default=0.05)
    c = commands.add_parser("ground")
    for name in ("v1-outputs", "reports", "output-dir"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--threshold", type=float, default=0.65)
    c.add_argument("--strict", action="store_true")
    c = commands.add_parser("agree")
    c.add_argument("--original", required=True)
    c.add_argument("--repeat", required=True)
    a = p.parse_args(argv)
    from .session import ship

    # Fixed value: the fields of a line of the log.
    logging.basicConfig(level=logging.INFO, format="%(asctime)s - %(name)s - %(levelname)s - %(message)s", filename=a.log)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    {"run": run, "evaluate": evaluate, "ground": ground, "agree": agree}[a.command](ship(spark or SparkSession.builder.getOrCreate()), a)


if __name__ == "__main__":
    main()
