"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

A document's set holds 64-bit hashes of its distinct word shingles. One permutation
(a hash) puts them on a circle of UNIVERSE places; a second one (a fixed table),
shifted by one place for each coordinate, ranks them: coordinate k is the smallest
rank under the k-fold shift. BANDS groups of ROWS coordinates give bucket keys.

Documents with equal sets are one class; only class representatives (the smallest
doc_id) go on. In each bucket every member is compared with the bucket's hub (the
member that meets most others) and never with all others, so a bucket of n members
costs n comparisons. Verified links give components. Members that then lie outside
their hub's component meet the hubs of PARTS parts of the bucket in the same way.
Buckets whose members still lie in several components hold pairs not yet judged;
those are found by an exact prefix and position filter between the members outside
the hub's component and all others of such buckets, verified, and joined to the
components. No bucket is capped.

Defined cases: words are runs without ASCII white space, A-Z lower-cased; with
fewer words than a shingle, the whole sequence is one shingle; null or empty texts
have an empty set and link with nothing; rows of one doc_id are one document with
several sets; a null doc_id links with nothing, its component is null and it is
kept; an empty table gives an empty result; other columns are not read.

Plan: one narrow pass writes sketches (about 250 bytes a document). Bucket keys are
counted with map-side sums; keys of one member end there. Texts are read again and
the members of shared buckets are picked by a filter of fixed size (`Bloom`), without
an exchange: other rows that it lets pass only make the table of sets longer. Sets travel with pairs that are linear in the
number of bucket memberships. Joins on possibly hot keys (bucket, hub, class) have
tables read back from files on both sides, so AQE can split them. Components are
found by rounds of smallest labels with pointer jumps, each written to the shared
folder; nothing of them reaches the driver but a count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bloom, Scratch, resident, slices
from .tokens import Powers

UNIVERSE = 1 << 20
ROWS = 5
BANDS = 25
PARTS = 8
BLOCK_BYTES = 1 << 19
SET_BYTES = 6  # of each hash, where two full sets are compared: 48 bits
_C = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_powers = Powers()


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30)) ^ np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _C[0]
    h = (h ^ (h >> np.uint64(27))) * _C[1]
    return h ^ (h >> np.uint64(31))


def _blocks(raw: list[bytes]) -> Iterator[bytes]:
    """The texts of one line each, in blocks that end at white space, so that work
    arrays stay small for very long texts (a word longer than a block stays whole)."""
    held: list[bytes] = []
    size = 0
    for text in raw:
        begin = 0
        while len(text) - begin > BLOCK_BYTES:
            cut = _SPACE.search(text, begin + BLOCK_BYTES)
            if cut is None:
                break
            held.append(text[begin : cut.end()])
            begin = cut.end()
            yield b"".join(held)
            held, size = [], 0
        held.append(text[begin:] + b"\n")
        size += len(held[-1])
        if size > BLOCK_BYTES:
            yield b"".join(held)
            held, size = [], 0
    yield b"".join(held) + b"\n"


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the words of each text."""
    raw = [(t or "").encode().translate(_LOWER) for t in texts]
    hashes, starts_of, begin = [], [], 0
    for block in _blocks(raw):
        data = np.frombuffer(block, np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        ends = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
        powers = _powers if len(data) <= 4 * BLOCK_BYTES else Powers()  # those of one huge word are not kept
        powers.need(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], out=total[1:])
        hashes.append(mix((total[ends] - total[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64) * _C[2]))
        starts_of.append(starts + begin)
        begin += len(data)
    edges = np.cumsum([0] + [len(r) + 1 for r in raw])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts_of), edges))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    out = []
    whole = None
    if len(h) >= words:
        n = len(h) - words + 1
        whole = np.full(n, words, np.uint64)
        for i in range(words):
            whole = mix(whole * _C[3] + h[i : i + n])
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < words:
            one = np.array([n], np.uint64)
            for x in h[end - n : end]:
                one = mix(one * _C[3] + x)
            out.append(one)
        else:
            out.append(np.unique(whole[end - n : end - words + 1]))
    return out


def circle(coordinates: int) -> np.ndarray:
    """Row i: ranks of place i under each shift of the second permutation."""
    ranks = resident(("circle",), lambda: np.random.default_rng(20).permutation(UNIVERSE).astype(np.int32))
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: coordinates - 1]]), coordinates)


def signatures(sets: list[np.ndarray], coordinates: int, table: np.ndarray) -> np.ndarray:
    out = np.full((len(sets), coordinates), UNIVERSE, np.int32)
    for i, s in enumerate(sets):
        places = (mix(s, 3) >> np.uint64(44)).astype(np.int64)
        for j in range(0, len(places), 2048):
            np.minimum(out[i], table[places[j : j + 2048]].min(axis=0), out=out[i])
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    n, k = signature.shape
    parts = signature.astype(np.uint64).reshape(n, k // rows, rows)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64), (n, k // rows)).copy()
    for i in range(rows):
        key = mix(key * _C[4] + parts[:, :, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = circle(bands * rows)
        for batch in batches:
            for part in slices(batch, 128):
                sets = shingle_sets(part.column(1).to_pylist(), words)
                sizes = np.array([len(s) for s in sets])
                keys = band_keys(signatures(sets, bands * rows, table), rows)
                marks = [np.array([mix(s, salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (1, 2)]
                offsets = pa.array(np.arange(0, (len(sets) + 1) * bands, bands), pa.int32())
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(marks[0]), pa.array(marks[1]), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "mark_a", "mark_b", "keys"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, n_shingles long, mark_a long, mark_b long, keys array<long>")


def packed(s: np.ndarray) -> bytes:
    """The sorted set with SET_BYTES of each hash (the high ones keep the order)."""
    return (s >> np.uint64(64 - 8 * SET_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    return out.reshape(-1).view("<u8")


def sets_of(docs: DataFrame, nodes: Bloom, words: int) -> DataFrame:
    """(node, shingles) of the documents in the filter: all nodes, and few others.
    Rows are chosen before their shingles are made; no text is exchanged."""
    columns = [F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                sets = shingle_sets(part.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed(s) for s in sets], pa.binary())], names=["node", "shingles"])

    return docs.select(*columns).filter(nodes.may_hold("node")).mapInArrow(run, "node long, shingles binary")


def verified(scratch: Scratch, pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """The (a, b) whose sets reach the similarity num / den. A fixed-size filter
    leaves out sets of other nodes where they are read; the join itself is exact."""
    ends = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"ends-{name}")
    near = sets.filter(Bloom(ends, "node").may_hold("node"))
    own = near.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    other = near.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    sized = pairs.join(own, "a").join(other, "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            last, other_set = None, None
            for i in range(batch.num_rows):
                x, y = left[i].as_py(), right[i].as_py()
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    continue
                if y != last:
                    last, other_set = y, unpacked(y)
                one = unpacked(x)
                common = len(one) + len(other_set) - len(np.unique(np.concatenate([one, other_set])))
                keep[i] = den * common >= num * (len(one) + len(other_set) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return sized.mapInArrow(run, "a long, b long").distinct()


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of all nodes with links; label: the smallest node reachable."""
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")), f"{name}-both")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        heard = scratch.save(labels.join(heard, "node").select("node", F.col("label").alias("before"), F.least("label", "heard").alias("label")), f"{name}-heard-{step}")
        jump = heard.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch.save(heard.join(jump, "label").select("node", F.col("further").alias("label"), (F.col("further") != F.col("before")).alias("moved")), f"{name}-{step}")
        done = new.filter("moved").limit(1).count() == 0
        scratch.drop(f"{name}-{step - 1}", f"{name}-heard-{step}")
        labels = new.select("node", "label")
        if done:
            scratch.drop(f"{name}-both")
            return labels


def rest_pairs(scratch: Scratch, sets: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different labels, a outside its bucket's hub component, that
    can reach the similarity: exact prefix and position filter with each set ordered
    by how many of these sets hold a hash, rare ones first. Hashes of one set only
    cannot be shared; they just count as places.
    nodes: (node, label, outside)."""
    near = sets.filter(Bloom(nodes, "node").may_hold("node"))
    known = scratch.save(near.join(nodes, "node").withColumn("n", (F.octet_length("shingles") / SET_BYTES).cast("long")), "rest-sets")

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = unpacked(data.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(s)], names=["node", "token"])

    tokens = scratch.save(known.select("node", "shingles").mapInArrow(flatten, "node long, token long"), "rest-tokens")
    held = scratch.save(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "rest-held")
    own = Window.partitionBy("node")  # bounded by a document's own set
    placed = tokens.join(held, "token").join(known.select("node", "label", "outside", "n"), "node")
    placed = placed.withColumn("at", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("held", "token")) - 1)
    prefix = placed.filter(F.col("at") < F.col("n") - F.ceil(F.col("n") * num / den) + 1)
    tokens = scratch.save(prefix.select("token", "at", "n", "node", "label", "outside"), "rest-prefixes")
    size = F.floor(F.log("n") / F.log(F.lit(den / num)))  # sets that reach the similarity differ by one class at most
    x = tokens.filter("outside").select("token", size.alias("class"), *(F.col(c).alias(f"{c}_a") for c in ("at", "n", "node", "label")))
    y = tokens.select("token", F.explode(F.array(size - 1, size, size + 1)).alias("class"), *(F.col(c).alias(f"{c}_b") for c in ("at", "n", "node", "label")))
    reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fit = (
        (F.col("label_a") != F.col("label_b"))
        & (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
        & ((num + den) * reach >= num * (F.col("n_a") + F.col("n_b")))
    )
    found = x.join(y, (x["token"] == y["token"]) & (x["class"] == y["class"]) & fit)
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def hubs_of(members: DataFrame, parts: int) -> DataFrame:
    """(key, hub): of each bucket, or of each of `parts` parts of it by a hash, the
    heaviest member (the smallest of equals)."""
    part = F.pmod(F.xxhash64("node"), F.lit(parts))
    top = members.groupBy("key", part.alias("_part")).agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("_top"))
    return top.select("key", (-F.col("_top.minus")).alias("hub"))


def relabelled(scratch: Scratch, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels (node, label) after the links (a, b) join components."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end)
    edges = scratch.save(ends.filter("label_a != label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), f"{name}-edges")
    if not edges.limit(1).count():
        return labels
    joined = components(scratch, edges, name).select(F.col("node").alias("label"), F.col("label").alias("_new"))
    return scratch.save(labels.join(joined, "label", "left").select("node", F.coalesce("_new", "label").alias("label")), name)


def unsettled(scratch: Scratch, members: DataFrame, hubs: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(key, node, label) of all members, and (key, main) of the buckets with several
    labels, main being the hub's."""
    spread = scratch.save(members.select("key", "node").join(labels, "node"), f"spread-{name}")
    mixed = spread.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    own = labels.select(F.col("node").alias("hub"), F.col("label").alias("main"))
    return spread, scratch.save(mixed.join(hubs, "key").join(own, "hub").select("key", "main"), f"mixed-{name}")


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document (doc_id, text)."""
    scratch = Scratch(spark, "neardup")
    sketch = scratch.save(sketches(docs, words, bands, rows), "sketch")
    marks = ["mark_a", "mark_b", "n_shingles"]
    classes = scratch.save(sketch.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(*marks).agg(F.min("doc_id").alias("node")), "classes")
    firsts = sketch.filter(F.col("n_shingles") > 0).join(classes.select(F.col("node").alias("doc_id"), *marks), ["doc_id", *marks], "left_semi")
    keyed = scratch.save(firsts.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key")), "keyed")
    shared = scratch.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    members = scratch.save(keyed.join(shared, "key"), "members")
    scratch.drop("keyed", "shared")

    # the hub of a bucket: the member whose buckets are largest
    weight = scratch.save(members.groupBy("node").agg(F.sum("n").alias("weight")), "weight")
    members = scratch.save(members.select("key", "node").join(weight, "node"), "weighed")
    scratch.drop("members")
    sets = scratch.save(sets_of(docs, Bloom(weight, "node"), words), "sets")
    labels = weight.select("node", F.col("node").alias("label"))

    hubs = scratch.save(hubs_of(members, 1).select("key", "hub"), "hubs")
    pairs = members.join(hubs, "key").filter(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    judged = scratch.save(pairs, "pairs-0")
    labels = relabelled(scratch, labels, scratch.save(verified(scratch, judged, sets, num, den, "0"), "links-0"), "labels-0")

    # members outside their hub's component meet the hubs of PARTS parts of the bucket
    spread, mixed = unsettled(scratch, members, hubs, labels, "1")
    several = hubs_of(members.join(mixed, "key", "left_semi"), PARTS).join(labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub")
    outside = spread.join(mixed, "key").filter("label != main")
    pairs = outside.join(several, "key").filter("label != hub_label").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = scratch.save(pairs.join(judged, ["a", "b"], "left_anti"), "pairs-1")
    labels = relabelled(scratch, labels, scratch.save(verified(scratch, pairs, sets, num, den, "1"), "links-1"), "labels-1")
    judged = judged.union(pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # all pairs that are left between components
    spread, mixed = unsettled(scratch, members, hubs, labels, "2")
    rest = scratch.save(spread.join(mixed, "key").groupBy("node", "label").agg(F.max(F.col("label") != F.col("main")).alias("outside")), "rest")
    scratch.drop("weighed", "hubs", "spread-1", "mixed-1", "spread-2", "mixed-2")
    if rest.limit(1).count():
        more = scratch.save(rest_pairs(scratch, sets, rest, num, den).join(judged, ["a", "b"], "left_anti"), "pairs-2")
        labels = relabelled(scratch, labels, scratch.save(verified(scratch, more, sets, num, den, "2"), "links-2"), "labels-2")

    own = labels.select("node", "label")
    by_class = scratch.save(classes.join(own, "node", "left").select(*marks, F.coalesce("label", "node").alias("_component")), "components")
    scratch.drop("sets", "rest-sets", "rest-tokens", "rest-held", "rest-prefixes", "ends-0", "ends-1", "ends-2", "classes", "weight")
    some = F.col("n_shingles") > 0  # documents without a set, however many, meet no key
    out = sketch.filter(some).select("doc_id", *marks).join(by_class, marks, "left").select("doc_id", "n_shingles", "_component")
    out = out.unionByName(sketch.filter(~some).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("_component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
