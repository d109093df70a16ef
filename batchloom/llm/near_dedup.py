"""MinHash near-duplicate groups of documents.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set is its distinct five-word shingles
(the whole sequence as one, if it has fewer words). Documents link when their sets' Jaccard similarity is at
least 0.75; groups are connected components.

1. One pass makes each document's set fingerprint, 128 universal hash minima and 32 band keys of four minima.
   A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32, about 5 in a million.
2. Documents with equal sets form a class, which goes on as its smallest document. Classes that share a band are a
   bucket.
3. Each class is compared with the smallest class of its buckets: links are verified by signature, then on the
   full sets, and components come from alternating large-star and small-star.
4. Only buckets that hold several components are looked at again. In each, the classes outside its commonest component
   are compared with all of its classes, in cells of about ``CELL`` by ``CELL``: signatures tell which classes have a
   promising partner in another component, a pair counting only in the first band that it shares, and for these an
   index of the one side's shingles counts the common shingles exactly. Only the components that a cell joins come out, so no pairs are written, and no pair that
   shares a band stays unverified unless it is connected anyway.
5. A bucket of more than ``LARGE`` classes on both sides is first split: two sets at 0.75 share one of their rarest
   shingles (of n, the n - ceil(0.75 n) + 1 that the fewest classes of such buckets have), so these are the keys of
   smaller buckets. This loses nothing, and what a whole family of pages has in common names no bucket.

Keys that very many rows have (a text's copies, a band, the smallest class of a large bucket) are dealt over several tasks.

Edge cases: a null or empty text, or one without words, has an empty set, links with nothing and is kept; rows
with the same id are one node of the graph, linked if any of their sets is (but a row without words is alone); a row without an id links with nothing, has a null
component and is kept; an empty table gives an empty table; extra columns are ignored. A long text is
one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import drop_stages, mixed, pieces, shingle_hashes, spread_join, stages_so_far, utf8_column, word_hashes, written

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
CELL, LARGE = 512, 4_096
#: Signature similarity below which a pair is refused unseen: over five standard errors under 0.75.
REFUSE = 0.55
#: Up to so many candidate ids (8 MB) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_PROFILE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
_PROFILE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_CELL_COLUMNS = ["key", "id", "component", "probe", "r", "c"]


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of consecutive texts: the first one's number, their shingle hashes, and how many each has."""
    data, offsets = utf8_column(column)
    for a, b in pieces(offsets):
        words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, *shingle_hashes(words, counts, SHINGLE)


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The upper 32 bits of every hash minimum; a row per text, zeros for one without shingles."""
    out = np.zeros((BANDS * ROWS, len(counts)), np.uint32)
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    if starts.size:
        held = np.empty_like(shingles)
        for k in range(BANDS * ROWS):
            np.multiply(shingles, _A[k], out=held)
            held += _B[k]
            out[k, some] = np.minimum.reduceat(held, starts) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; its last bits are the band's number."""
    rows = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    for j in range(ROWS):
        keys = mixed((keys ^ rows[:, :, j]) * _A[j])
    keys = (keys & np.uint64(2**64 - BANDS)) | np.arange(BANDS, dtype=np.uint64)
    return keys.view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, shingles, counts in _sets(batch.column(1)):
            n = len(counts)
            size, set_a, set_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            at = 0
            for i, c in enumerate(counts.tolist()):
                if c:
                    own = np.unique(shingles[at : at + c])
                    size[i] = own.size
                    set_a[i] = mixed(own).sum(dtype=np.uint64).astype(np.int64)
                    set_b[i] = mixed(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)
                    at += c
            bands = band_keys(signatures(shingles, counts))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, n), pa.array(size), pa.array(set_a), pa.array(set_b), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))],
                schema=_PROFILE_ARROW,
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, shingles, counts in _sets(batch.column(1)):
            sets, at = [], 0
            for c in counts.tolist():
                sets.append(np.unique(shingles[at : at + c]).tobytes())
                at += c
            sigs = [s.tobytes() for s in signatures(shingles, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["id", "sig", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) whose signatures, and then full sets, are similar enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("x_sig", "y_sig"))
        good = (a == b).mean(axis=1) >= REFUSE
        for i in np.flatnonzero(good).tolist():
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("x_set", "y_set"))
            common = np.intersect1d(x, y, assume_unique=True).size
            good[i] = 100 * common >= PERCENT * (x.size + y.size - common)
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def connected_components(spark: SparkSession, links: DataFrame, name: str = "components") -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star.

    ``links`` has two long columns u and v. Returns (node, component) for every node that has a link; the component
    is its smallest node.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = written(spark, ordered(links), name)
    while True:
        # Of every node that has smaller neighbours, the smallest; how many smaller and larger ones it has.
        smaller = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_smaller"))
        larger = edges.groupBy("v").agg(F.count("*").alias("n_rows"))
        least = smaller.join(larger, F.col("u") == F.col("v"), "left")
        if least.where("n_smaller > 1 OR n_rows IS NOT NULL").isEmpty():
            break
        n = edges.count()
        # Large-star: larger neighbours of a node go to its smallest neighbour, if that is smaller than the node.
        hubs = least.where("n_rows IS NOT NULL").select(F.col("u").alias("v"), "m", "n_rows")
        large = spread_join(edges, hubs, ["v"], "u", n, "left").select("u", F.coalesce("m", "v").alias("v"))
        large = written(spark, ordered(large), name)
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        firsts = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
        small = spread_join(large, firsts, ["u"], "v", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(spark, ordered(small.unionByName(firsts.select("u", F.col("m").alias("v")))), name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _verified(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v), each v in one of them, that are similar enough."""
    leaders = pairs.groupBy("u").agg(F.count("*").alias("n_rows"))
    leaders = written(spark, sets.join(leaders, F.col("id") == F.col("u")).select("u", "n_rows", F.col("sig").alias("x_sig"), F.col("shingles").alias("x_set")), "near-leaders")
    rows = pairs.join(sets.select(F.col("id").alias("v"), F.col("sig").alias("y_sig"), F.col("shingles").alias("y_set")), "v")
    joined = spread_join(rows, leaders, ["u"], "v", pairs.count(), maybe_few=False)
    return joined.select("u", "v", "x_sig", "x_set", "y_sig", "y_set").mapInArrow(_similar, "u long, v long")


def _promising(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The classes of a cell that have a partner of another component whose signature is similar enough.

    A pair counts in the first band that it shares, as it meets in the bucket of each; buckets of shingles have band -1.
    """
    sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(rows.num_rows, -1)
    # One byte of a minimum is enough to refuse most pairs; equal minima have equal bytes, so none is lost.
    short = np.ascontiguousarray(sigs.astype(np.uint8))
    components, probe = rows.column("component").to_numpy(), rows.column("probe").to_numpy(zero_copy_only=False)
    band, rest = rows.column("band")[0].as_py(), np.flatnonzero(~probe)
    keep = np.zeros(rows.num_rows, bool)
    for i in np.flatnonzero(probe).tolist():
        near = rest[(short[rest] == short[i]).mean(axis=1) >= REFUSE]
        near = near[components[near] != components[i]]
        if near.size and band >= 0:
            near = near[(sigs[near] == sigs[i]).reshape(near.size, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        keep[near] = True
        keep[i] |= near.size > 0
    return rows.select(_CELL_COLUMNS).filter(pa.array(keep))


def _cell(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Links between components of a cell, enough to connect all that similar pairs connect."""
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    components, probe = rows.column("component").to_pylist(), rows.column("probe").to_pylist()
    probes = [i for i, p in enumerate(probe) if p]
    if not probes:
        return _LINKS.empty_table()
    size = np.array([sets[i].size for i in probes])
    own = np.array([components[i] for i in probes])
    joined = np.concatenate([sets[i] for i in probes])
    order = np.argsort(joined, kind="stable")
    number = np.repeat(np.arange(len(probes)), size)[order]
    known, starts, counts = np.unique(joined[order], return_index=True, return_counts=True)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    for i, p in enumerate(probe):
        if p or not sets[i].size:
            continue
        at = np.minimum(np.searchsorted(known, sets[i]), known.size - 1)
        at = at[known[at] == sets[i]]
        if not at.size:
            continue
        common = np.zeros(len(probes), np.int64)
        # A shingle that many probes have gives as many entries, so they are counted some at a time.
        total = np.cumsum(counts[at])
        for a, b in _slices(total):
            times = counts[at[a:b]]
            ends = np.cumsum(times)
            places = np.repeat(starts[at[a:b]] - (ends - times), times) + np.arange(int(ends[-1]))
            common += np.bincount(number[places], minlength=len(probes))
        for c in np.unique(own[100 * common >= PERCENT * (size + sets[i].size - common)]).tolist():
            x, y = sorted((find(c), find(components[i])))
            if x != y:
                root[y] = x
    return pa.Table.from_arrays([pa.array(list(root), pa.int64()), pa.array(list(root.values()), pa.int64())], schema=_LINKS)


def _slices(total: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of entries of running sums that add up to about ``most``, or one entry."""
    start = 0
    while start < total.size:
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
        yield start, end
        start = end


def _open(spark: SparkSession, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets that hold several components, and their members (key, id, component) with the bucket's size on both sides.

    Of buckets with the same members that of the first band is taken.
    """
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    per = members.groupBy("key", "component").agg(F.count("*").alias("n"), *marks)
    marks = [F.bit_xor(f"x{k}").alias(f"x{k}") for k in (1, 2)]
    per = per.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n_rows"), F.count("*").alias("parts"), *marks)
    per = per.where("parts > 1").select("key", F.col("most.component").alias("largest"), "n_rows", (F.col("n_rows") - F.col("most.n")).alias("others"), "x1", "x2")
    one = per.groupBy("x1", "x2", "n_rows").agg(F.min(F.struct(F.col("key").bitwiseAND(BANDS - 1), "key", "largest", "others")).alias("b")).select("b.key", "b.largest", "b.others", "n_rows")
    one = written(spark, one.withColumn("all", F.col("n_rows")), "near-open")
    return one, spread_join(members, one, ["key"], "id", members.count())


def _rare(spark: SparkSession, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of large buckets again, by the rarest shingles of each class in place of the bucket's key."""
    ids = members.select("id", "component").distinct()
    held = sets.join(ids, "id").select("id", "component", "shingles")
    held = written(spark, held.mapInArrow(_exploded, "id long, component long, n long, key long"), "near-shingles")
    counts = written(spark, held.groupBy("key").agg(F.count("*").alias("n_rows")).where("n_rows > 1").withColumn("classes", F.col("n_rows")), "near-counts")
    known = spread_join(held, counts, ["key"], "id", held.count(), "left")
    ordered = known.groupBy("id", "component").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("classes", F.lit(1)).alias("classes"), "key"))).alias("all"), F.first("n").alias("n"))
    first = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int"))
    return written(spark, ordered.select(F.explode(first).alias("s"), "id", "component").where("s.classes > 1").select("s.key", "id", "component"), "near-rare")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = np.frombuffer(raw.as_buffer(), np.int64)
            for at in range(0, own.size, 100_000):
                part = own[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.size, i)), pa.array(np.full(part.size, c)), pa.array(np.full(part.size, own.size)), pa.array(part)], names=["id", "component", "n", "key"])


def _rest(spark: SparkSession, buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of each bucket (key, id)."""
    members = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    members = written(spark, members, "near-members")
    opened, known = _open(spark, members)
    known = known.withColumn("band", F.col("key").bitwiseAND(BANDS - 1).cast("int"))
    if not opened.where(F.col("others") > LARGE).isEmpty():
        rare = _rare(spark, known.where(F.col("others") > LARGE), sets)
        known = known.where(F.col("others") <= LARGE).unionByName(_open(spark, rare)[1].withColumn("band", F.lit(-1)))
        known = written(spark, known, "near-known")
    blocks = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    known = known.withColumns({"rows": blocks("all"), "columns": blocks("others")})
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = known.select("key", "band", "id", "component", F.lit(False).alias("probe"), place("rows").alias("r"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"))
    probes = known.where("component <> largest").select("key", "band", "id", "component", F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), place("columns").alias("c"))
    cells = every.unionByName(probes).join(sets.select("id", "sig"), "id").groupBy("key", "r", "c")
    near = written(spark, cells.applyInArrow(_promising, "key long, id long, component long, probe boolean, r int, c int"), "near-cells")
    cells = near.join(sets.select("id", "shingles"), "id").groupBy("key", "r", "c")
    return cells.applyInArrow(_cell, "u long, v long")


def _chosen_sets(spark: SparkSession, texts: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """Signature and full set of every wanted id; of an id with several texts all sets as one row each."""
    some = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    chosen = texts.withColumnRenamed("doc_id", "id").join(some, "id", "left_semi")
    if repeated:
        chosen = chosen.dropDuplicates(["id", "text"])
    return written(spark, chosen.select("id", "text").mapInArrow(_shingle_sets, "id long, sig binary, shingles binary"), "near-sets")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id of its group) and kept."""
    since = stages_so_far()
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    profiles = written(spark, texts.mapInArrow(_profile, _PROFILE), "near-profiles")
    usable = profiles.where("n_shingles > 0 AND doc_id IS NOT NULL")
    n_docs, n_ids = usable.agg(F.count("*"), F.count_distinct("doc_id")).first()
    classes = written(spark, usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")), "near-classes")
    heads = usable.select(F.col("doc_id").alias("rep"), "set_a", "set_b", "bands").join(classes, ["rep", "set_a", "set_b"])
    heads = written(spark, heads.select(F.col("rep").alias("id"), "bands"), "near-heads")
    entries = heads.select(F.explode("bands").alias("key"), "id")
    crowded = entries.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n_rows")).where("leader < last")
    crowded = written(spark, crowded.drop("last"), "near-crowded")
    buckets = written(spark, spread_join(entries, crowded, ["key"], "id", n_docs * BANDS, maybe_few=False).distinct(), "near-buckets")
    sets = _chosen_sets(spark, texts, buckets.select("id").distinct(), n_docs > n_ids)

    first = written(spark, buckets.where("leader <> id").groupBy(F.col("id").alias("v")).agg(F.min("leader").alias("u")).select("u", "v"), "near-first")
    links = _verified(spark, first, sets)
    if n_docs > n_ids:
        # An id with several sets ties their classes together.
        owned = usable.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select(F.col("doc_id").alias("v"), F.col("rep").alias("u"))
        links = links.unionByName(owned.where("u <> v").distinct())
    labels = connected_components(spark, links, "near-labels").withColumnRenamed("node", "id")
    parts = connected_components(spark, _rest(spark, buckets.select("key", "id"), labels, sets), "near-parts").select(F.col("node").alias("component"), F.col("component").alias("to"))
    every = labels.unionByName(buckets.select("id").distinct().join(labels, "id", "left_anti").withColumn("component", F.col("id")))
    labels = every.join(parts, "component", "left").select("id", F.coalesce("to", "component").alias("component"))

    found = classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").where("n_rows > 1 OR component IS NOT NULL")
    found = written(spark, found.select("set_a", "set_b", "n_rows", F.coalesce("component", "rep").alias("component_id")), "near-found")
    drop_stages(spark, since, ("near-profiles", "near-found"))
    out = spread_join(usable.select("doc_id", "n_shingles", "set_a", "set_b"), found, ["set_a", "set_b"], "doc_id", n_docs, "left")
    alone = profiles.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
