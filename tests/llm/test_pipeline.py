"""The pipeline's stages, each against its own input."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from loomlens.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(900001, None, "en", None, None), (900002, "", None, "s", 0), (None, "the and of to in is that was for with as by", "en", "s", 1), (900003, "12 34", "en", "s", 5), (900004, "a " * 60_000, "en", "s", 9)]


@pytest.fixture(scope="module")
def mixed(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS).filter("doc_id < 400")
    more = spark.createDataFrame(ODD, SCHEMA)
    again = base.filter("doc_id = 7")
    return base.unionByName(more).unionByName(again).withColumn("score", F.lit("clash")).withColumn("kept", F.lit("clash")).cache()


@pytest.mark.parametrize(("name", "stage"), P.STAGES[:-1])
def test_stage(spark, sf_dir, mixed, name, stage):
    out = stage(spark, mixed, sf_dir)
    assert out.columns == P.COLUMNS
    rows = out.collect()
    ids = collections.Counter(r.doc_id for r in rows)
    given = {(r.doc_id, r.text) for r in mixed.collect()}
    assert all((r.doc_id, r.text) in given for r in rows)
    if name == "language_id":
        assert not ids[900001] and not ids[900002] and not ids[900003]
        assert sum(1 for d in ids if d is not None and d < 400) >= 395
    if name == "near_dedup":
        assert ids[7] == 1 and max(ids.values()) == 1
    if name == "decontamination":
        texts = {r.doc_id: r.text for r in mixed.collect()}
        bench = [b.text for b in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
        leaked = {d for d, t in texts.items() if t and any(b in t for b in bench)}
        assert leaked and not leaked & set(ids)
    assert stage(spark, mixed.limit(0), sf_dir).count() == 0


def test_rows_without_an_id_are_judged_by_their_own_text(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").first().text
    rows = [(None, f"some words {item} and more", "en", "s", 1), (None, "a clean text of its own", "en", "s", 1), (None, None, "en", "s", 1), (3, f"{item} again", "en", "s", 1), (4, "clean", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    left = {(r.doc_id, r.text) for r in dict(P.STAGES)["decontamination"](spark, df, sf_dir).collect()}
    assert left == {(d, t) for d, t, *_ in rows[1:3] + rows[4:]}
    both = df.unionByName(df.filter("doc_id is null or doc_id = 4"))  # rows that repeat: without an id each stays
    near = [(r.doc_id, r.text) for r in dict(P.STAGES)["near_dedup"](spark, both, sf_dir).collect()]
    assert sorted(map(str, near)) == sorted(map(str, [(d, t) for d, t, *_ in rows[:3] * 2 + rows[4:] + rows[3:4]]))


def test_packing_stage(spark, sf_dir, mixed):
    stage = dict(P.STAGES)["packing"]
    out = stage(spark, mixed, sf_dir)
    assert sorted(out.columns) == ["doc_id", "doc_tokens", "ids_crc32", "length", "offset", "sequence_id", "start"]
    rows = out.collect()
    assert collections.Counter(r.doc_id for r in rows if r.start == 0) == collections.Counter(r.doc_id for r in mixed.collect())
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert stage(spark, mixed.limit(0), sf_dir).count() == 0


def test_quality_stage_keeps_good_and_drops_bad(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in dict(P.STAGES)["quality_classifier"](spark, base, sf_dir).select("doc_id").collect()}
    good, bad = ([d for d, q in labels.items() if q == v] for v in (1, 0))
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)


def test_whole_run(spark, sf_dir):
    pieces = P.run(spark, sf_dir).collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(pieces[0].asDict())
    documents = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    packed = {r.doc_id for r in pieces}
    assert 0.5 * len(documents) < len(packed) < len(documents)
    # the same rows by calling the stages one after another, each on the last one's rows
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        rows = stage(spark, docs, sf_dir).collect()
        docs = spark.createDataFrame([tuple(r[c] for c in P.COLUMNS) for r in rows], SCHEMA)
    assert {r.doc_id for r in rows} == packed
    assert tokenizer_path()
