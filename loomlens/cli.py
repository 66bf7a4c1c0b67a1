"""Command lines: split, extract, train, predict, evaluate, frequency, export."""

from __future__ import annotations

import argparse
import json
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import annotate, keyphrases, split
from .plans import evaluate as E
from .plans.chains import Chains
from .plans.config import EnsembleConfig, KeyphraseConfig
from .plans.proposer import ModelProposer
from .plans.trainer import Trainer
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomlens")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *needs: str, **options):
        s = sub.add_parser(name)
        for n in needs:
            s.add_argument(f"--{n}", required=True)
        for n, default in options.items():
            kind = type(default) if default is not None else str
            s.add_argument(f"--{n.replace('_', '-')}", default=default, type=kind)
        return s

    add("split", "data", "out", test_frac=0.1, seed=0, max_obs=0)
    add("extract", "data", "config", plugins="")
    add("train", "data", "index", "folder", config="", partition="train", text="text", label="y", max_obs=0, concepts="", plugins="", templates="", search="greedy")
    add("predict", "data", "folder", "out", last=0)
    add("evaluate", "data", "folder", "out", last=1, sensitivity=0.9, domain=None, age=None, cutoff=0.0, training=None, exclude="")
    add("frequency", "data", "folder", "out", share=0.5)
    add("export", "data", "folder", "out")
    return p


def models(spark: SparkSession, config: EnsembleConfig, plugins: str, templates: str) -> dict:
    """Annotator and proposer of the configured model clients. plugins: comma-separated modules that register
    clients when imported; templates: a folder with extraction.txt, baseline.txt and iteration.txt."""
    for name in filter(None, plugins.split(",")):
        import_module(name)
    roles = config.client.roles()
    if roles is None:
        return {}
    text = lambda name: tables.read_template(spark, f"{templates}/{name}.txt")
    c, t = config.concept, config.training
    proposer = ModelProposer(roles["iter"], text("baseline"), text("iteration"), c.goal_num_meta_concepts, t.num_greedy_holdout)
    return {"annotator": annotate.ModelAnnotator(roles["extraction"], text("extraction"), t.batch_concept_size), "proposer": proposer}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomlens").getOrCreate()
    read = lambda path: tables.keyed(spark.read.parquet(path) if path.endswith(".parquet") else tables.read_csv(spark, path))
    notes = read(a.data)
    if a.command == "split":
        rows = notes.orderBy("obs_id").limit(a.max_obs) if a.max_obs else notes
        tables.write_csv(split.global_split(rows.select("obs_id"), "obs_id", a.test_frac, a.seed).orderBy("partition", "obs_id"), a.out)
        return
    if a.command == "extract":
        for name in filter(None, a.plugins.split(",")):
            import_module(name)
        config = KeyphraseConfig.from_dict(tables.read_config(tables.read_template(spark, a.config)))
        said = keyphrases.configured(notes, config, tables.read_template(spark, config.prompt_file))
        if config.llm_outputs_file:
            tables.write_csv(notes.join(said, said.columns[0]), config.llm_outputs_file)
        return
    if a.command == "train":
        settings = tables.read_config(tables.read_template(spark, a.config)) if a.config else {}
        config = EnsembleConfig.from_args(**settings)
        if a.concepts:  # the phrase column by the join column
            notes = tables.attach(notes, read(a.concepts), config.data.concept_column, config.data.join_column or "obs_id")
        rows = tables.load_partition(notes, tables.read_csv(spark, a.index), a.partition, a.text, a.max_obs).withColumn("y", F.col(a.label).cast("int"))
        kind = {"greedy": Trainer, "chains": Chains}[a.search]
        kind(spark, config, a.folder, **models(spark, config, a.plugins, a.templates)).fit(rows)
        return
    trainer = Trainer.from_checkpoint(spark, a.folder)
    if a.command == "predict":
        out = notes.join(trainer.predict(notes, a.last or None), "obs_id")
        tables.write_csv(out, a.out)
        if "y" in notes.columns:
            tables.write_csv(E.simple_metrics(out.withColumn("prob", F.col("prob_1"))), f"{a.out}-metrics")
    elif a.command == "evaluate":
        excluded = [c for c in a.exclude.split("|") if c]
        rows = E.predictions(notes, trainer.predict(notes, a.last or None, excluded=excluded or None), read(a.training) if a.training else None)
        rows = rows.withColumn("prob", F.col("prob_1")).withColumn("sample_weight", F.lit(1.0) if "sample_weight" not in rows.columns else F.col("sample_weight"))
        tables.write_csv(E.evaluate(rows, a.sensitivity, a.domain, a.age, a.cutoff if a.age else None), a.out)
        tables.write_csv(E.prevalence_table(trainer.annotations(notes, a.last or None)), f"{a.out}-prevalence")
    elif a.command == "frequency":
        tables.write_csv(annotate.class_frequency(trainer.annotations(notes), notes.select("obs_id", "y"), a.share), a.out)
    elif a.command == "export":
        answers = annotate.wide(trainer.annotations(notes), sorted(trainer.concepts.values(), key=lambda c: c["concept_id"]))
        tables.viewer_export(notes.join(answers, "obs_id", "left"), {"concepts": list(trainer.concepts), "config": json.loads(json.dumps(trainer.config.to_dict()))}, a.out)


if __name__ == "__main__":
    main()
