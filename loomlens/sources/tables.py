"""Sources and sinks: keyed ingest, partition load, overlap, JSON, text, YAML-like config."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Quoted, multi-line CSV with a header. Types are inferred only without a schema."""
    reader = spark.read.options(header=True, multiLine=True, escape='"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_clean_csv(df: DataFrame, path: str, text: str = "sentence") -> None:
    write_csv(df.drop(text), path.removesuffix(".csv") + "_clean.csv")


def keyed(df: DataFrame, key: str = "obs_id") -> DataFrame:
    """Consecutive keys 0.. in file order, by per-partition counts: no global sort.
    For inputs without a key of their own; done once, at the border."""
    if key in df.columns:
        return df
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per input partition
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = marked.withColumn("_part", part).join(F.broadcast(base), "_part")
    return out.withColumn(key, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")


def load_partition(notes: DataFrame, index: DataFrame, partition: str | None, text: str = "text", most: int = 0, concepts: DataFrame | None = None, concept_column: str | None = None, key: str = "obs_id") -> DataFrame:
    """Rows of one partition with their weight (1 where none is given) and non-null
    text, multiplicity from the index side; the first `most` by key where asked."""
    if concepts is not None:
        notes = attach(notes, concepts, concept_column, key)
    own = index if partition is None else index.filter(F.col("partition") == partition)
    columns = [key, "partition", *(["sample_weight"] if "sample_weight" in index.columns else [])]
    out = notes.drop("partition", "sample_weight").join(own.select(*columns), key).filter(F.col(text).isNotNull())
    weight = F.coalesce(F.col("sample_weight"), F.lit(1.0)) if "sample_weight" in columns else F.lit(1.0)
    out = out.withColumn("sample_weight", weight)
    return out.orderBy(key).limit(most) if most > 0 else out


def attach(notes: DataFrame, concepts: DataFrame, column: str, key: str = "obs_id") -> DataFrame:
    """The concept column by key; notes without one leave."""
    return notes.drop(column).join(concepts.select(key, column), key, "inner")


def check_same(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> None:
    """Raises if any row of left has no equal row in right."""
    odd = left.select(key, *columns).exceptAll(right.select(key, *columns))
    if odd.limit(1).count():
        raise ValueError(f"rows differ in {columns}")


def without_overlap(notes: DataFrame, training: DataFrame, key: str) -> DataFrame:
    """Notes whose id is not among the training ids; a null id equals a null id."""
    seen = training.select(F.col(key).alias("_seen")).distinct()
    return notes.join(seen, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")


def write_evidence(evidence: DataFrame, path: str) -> None:
    evidence.select("obs_id", F.to_json("evidence").alias("evidence")).write.mode("overwrite").json(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame | None:
    """(obs_id, evidence map), or None where there is no readable file."""
    try:
        raw = spark.read.schema("obs_id long, evidence string").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return raw.select("obs_id", F.from_json("evidence", "map<string,string>").alias("evidence"))


def read_template(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def prompt_catalogue(spark: SparkSession, folder: str, steps: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """(step, filename, content) of the prompts of each step, and the names of missing files."""
    wanted = spark.createDataFrame([(s, n) for s, names in steps.items() for n in names], "step string, filename string")  # a bounded list
    found = spark.read.text(f"{folder}/*", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("content"))
    both = wanted.join(found, "filename", "left")
    missing = sorted({r["filename"] for r in both.filter("content is null").select("filename").collect()})
    return both.filter("content is not null").select("step", "filename", "content"), missing


def concept_names(df: DataFrame) -> DataFrame:
    return df.select(F.col("concept" if "concept" in df.columns else df.columns[0]).alias("concept"))


def images(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """Rows with image_path (below the folder, or whole) and the file's bytes; null where
    there is no such file. Equal names in two folders stay apart."""
    if "image_path" not in df.columns:
        raise ValueError("missing columns: ['image_path']")
    plain = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(plain(F.col("path")).alias("_path"), "content")
    base = folder.rstrip("/")
    whole = F.when(F.col("image_path").rlike("^([a-z0-9]+:)?/"), F.col("image_path")).otherwise(F.concat(F.lit(base + "/"), "image_path"))
    return df.withColumn("_path", plain(whole)).join(files, "_path", "left").drop("_path")


def viewer_export(rows: DataFrame, config: dict, folder: str) -> None:
    """data as CSV and config as one JSON text."""
    write_csv(rows, f"{folder}/data.csv")
    rows.sparkSession.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config.json")


def rows_json(rows: DataFrame, folder: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(folder)


def read_config(text: str) -> dict:
    """Flat `name: value` lines (a subset of YAML): numbers, booleans, null, quoted or bare text."""
    out: dict = {}
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        name, colon, value = line.partition(":")
        if not colon or name != name.strip():
            raise ValueError(f"not a flat setting: {line!r}")
        value = value.strip()
        try:
            out[name] = json.loads(value)
        except ValueError:
            out[name] = None if value in ("", "~") else value.strip("'\"")
    return out


def common_keys(left: DataFrame, right: DataFrame, key: str = "obs_id") -> DataFrame:
    """Distinct keys that both hold."""
    return left.select(key).intersect(right.select(key))


def without_excluded(notes: DataFrame, decisions: DataFrame, key: str = "obs_id") -> DataFrame:
    """Notes but for those whose decision (key, exclude) says so; a note without one stays."""
    out = decisions.filter(F.coalesce("exclude", F.lit(False))).select(key).distinct()
    return notes.join(out, key, "left_anti")
