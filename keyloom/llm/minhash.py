"""Near-duplicate classes by min-max hashing.

Under each permutation of the shingle hashes both the minimum and the maximum
are kept, so that 80 permutations give 160 signature values. 32 bands of 5
values make candidates; a pair of sets at similarity 0.8 shares no band with
probability (1 - 0.8^5)^32 < 4e-6. Every link is confirmed on the full sets.

Documents with the same set are one class from the start. The links to each
bucket's hub (its member that meets most others) are tried first, which is linear. What a hub
leaves in another class is then compared on full sets with all that share a
bucket with that hub, in blocks of bounded size inside the workers; only links
become rows. So no link between different texts is lost, and no group is
expanded into its pairs.

Defined results: null or empty text has an empty set and is linked with
nothing; fewer than two words make one shingle; a null doc_id is its own class
with component_id null and kept true; rows that repeat a doc_id share its class;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, M1, M2, bounded, forget, free, map_slices, mix64, stored

PERMUTATIONS, BAND = 80, 5
#: Members, and queries, that one comparison block holds.
BLOCK = 256

_rng = np.random.Generator(np.random.PCG64(20240501))
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_set(text: str | None, words: int = 2) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = HASHES.of(found)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix64(out * M2 + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def set_name(items: np.ndarray) -> list[int]:
    """A 128-bit name of a set, as two integers."""
    return np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64).tolist()


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of band keys for each set (none may be empty)."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    low, high = (np.empty((len(sets), PERMUTATIONS), np.uint64) for _ in "ab")
    for k in range(PERMUTATIONS):
        v = flat * _A[k] + _B[k]
        low[:, k], high[:, k] = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
    both = np.concatenate([low, high], axis=1)
    bands = both.shape[1] // BAND
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * M1, (len(sets), bands))
    for i in range(BAND):
        key = mix64(key ^ both[:, i::BAND])
    return key


def signatures(docs: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a 128-bit name of the set), bands."""

    def step(rows: dict) -> dict:
        sets = [shingle_set(x, words) for x in rows["text"]]
        names = [set_name(x) for x in sets]
        full, bands = [i for i, x in enumerate(sets) if len(x)], [None] * len(sets)
        if full:
            for i, k in zip(full, band_keys([sets[i] for i in full]).view(np.int64), strict=True):
                bands[i] = k
        return {"doc_id": rows["doc_id"], "n_shingles": [len(x) for x in sets], "k1": [x[0] for x in names], "k2": [x[1] for x in names], "bands": bands}

    return map_slices(docs.select("doc_id", "text"), step, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """rep, items: the full sets named in ids (rep, k1, k2), one row for each rep."""

    def step(rows: dict) -> dict:
        sets = [shingle_set(x, words) for x in rows["text"]]
        names = [set_name(x) for x in sets]
        return {"rep": rows["doc_id"], "k1": [x[0] for x in names], "k2": [x[1] for x in names], "items": [x.view(np.int64) for x in sets]}

    ids = bounded(ids)
    wanted = docs.select("doc_id", "text").join(ids.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    found = map_slices(wanted, step, "rep long, k1 long, k2 long, items array<long>")
    return found.join(ids, ["rep", "k1", "k2"], "left_semi").select("rep", "items").dropDuplicates(["rep"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough; an `a` of many pairs is spread over blocks of them."""
    large = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"), "large")
    salted = pairs.join(bounded(large), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).alias("salt"))
    a, b = (sets.select(F.col("rep").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)).cast("long") - 1)
    a = a.join(pairs.select("a").distinct(), "a", "left_semi").join(bounded(large), "a", "left").select("a", "items_a", F.explode(every).alias("salt"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - both
    return salted.join(b, "b").join(a, ["a", "salt"]).where(100 * both >= percent * union).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """rep, comp: the smallest id that each end of edges (a, b) reaches.

    Each round takes the least label among neighbours and then the label's own
    label, so that the rounds grow with the logarithm of a chain's length.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.col("rep")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("rep").alias("b"), "comp"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "rep").select("rep", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        own = labels.select(F.col("rep").alias("mid"), F.col("comp").alias("jump"))
        step = stored(step.join(own, "mid", "left").select("rep", "old", F.least("mid", "jump").alias("comp")), "labels")
        done = not step.where("comp < old").limit(1).count()
        forget(labels)
        labels = step.select("rep", "comp")
        labels.stored_path = step.stored_path
        if done:
            forget(both)
            return labels


def _across(shared: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different classes among the documents that share a bucket with one hub.

    Members outside the hub's class are queries; they meet all members, in
    blocks, so that a large group is spread over many tasks.
    """
    comp = F.coalesce("comp", "rep").alias("comp")
    labelled = stored(shared.select("hub", "rep").join(comps, "rep", "left").select("hub", "rep", comp), "labelled")
    mixed = labelled.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("comp"))).alias("main"), F.count("*").alias("size"))
    # Written first: what stands on either side of the join is then a plain scan, which can be broadcast or split by size.
    mixed = stored(mixed.where("low < high").select("hub", "main", F.ceil(F.col("size") / BLOCK).alias("blocks")), "mixed")
    rest = stored(labelled.join(bounded(mixed), "hub").select("hub", "rep", "comp", (F.col("comp") != F.col("main")).alias("query"), "blocks"), "rest")
    forget(labelled, mixed)
    own = F.pmod(F.xxhash64("rep"), "blocks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    asked = stored(rest.where("query").select("hub", own.alias("qb")).distinct(), "asked")
    members = rest.withColumn("mb", own).join(bounded(asked), "hub").withColumn("as_query", F.lit(False))
    queries = rest.where("query").select("*", every.alias("mb")).withColumn("qb", own).withColumn("as_query", F.lit(True))
    cells = members.unionByName(queries).join(sets, "rep").select("hub", "qb", "mb", "rep", "comp", "query", "as_query", "items")
    cells = cells.repartition("hub", "qb", "mb").sortWithinPartitions("hub", "qb", "mb")

    def links(cell: list[pa.Table]) -> list[tuple[int, int]]:
        t = pa.concat_tables(cell)
        rep, comp, query, asked = (t[k].to_numpy() for k in ("rep", "comp", "query", "as_query"))
        items = [x.values.to_numpy() for x in t["items"]]
        m = np.flatnonzero(~asked)
        if not len(m):
            return []
        size = np.fromiter((len(items[i]) for i in m), np.int64, len(m))
        flat, of = np.concatenate([items[i] for i in m]), np.repeat(np.arange(len(m)), size)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        found = []
        for q in np.flatnonzero(asked):
            low, high = np.searchsorted(flat, items[q], "left"), np.searchsorted(flat, items[q], "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(of[at], minlength=len(m))
            alike = 100 * both >= percent * (size + len(items[q]) - both)
            for i in m[alike & (comp[m] != comp[q]) & (~query[m] | (rep[m] > rep[q]))]:
                found.append((min(rep[i], rep[q]), max(rep[i], rep[q])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, now = [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key = np.stack([t[k].to_numpy() for k in ("hub", "qb", "mb")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            out = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    if now is not None and tuple(key[i]) != now:
                        out += links(cell)
                        cell = []
                    now = tuple(key[i])
                    cell.append(t.slice(i, j - i))
            yield _pairs_batch(out)
        if cell:
            yield _pairs_batch(links(cell))

    return cells.mapInArrow(run, "a long, b long").distinct()


def _pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _hubs(reps: DataFrame) -> DataFrame:
    """hub, hub_n, rep, n: each set beside the hub of each bucket that it shares.

    A bucket's hub is its member that meets most others over all its buckets (of
    equals the smallest id): where texts are copies of one, that is the original,
    which links with copies that don't link among themselves.
    """
    buckets = reps.select("rep", "n", F.explode("bands").alias("h"))
    sizes = stored(buckets.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    kept = stored(buckets.join(sizes, "h"), "buckets")
    meets = stored(kept.groupBy("rep").agg(F.sum("size").alias("meets")), "meets")
    told = stored(kept.drop("size").join(meets, "rep"), "told")
    best = told.groupBy("h").agg(F.max(F.struct("meets", (-F.col("rep")).alias("least"), "n")).alias("hub"))
    hubs = stored(best.select("h", (-F.col("hub.least")).alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    out = stored(told.join(hubs, "h").select("hub", "hub_n", "rep", "n").distinct(), "shared")
    forget(sizes, kept, meets, told, hubs)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    signed = stored(signatures(docs, words), "signatures")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    reps = stored(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "reps")
    shared = _hubs(reps)
    ids = stored(reps.select("rep", "k1", "k2").join(bounded(stored(shared.select("rep").distinct(), "ids")), "rep", "left_semi"), "ids")
    sets = stored(_sets(docs, ids, words), "sets")
    stars = shared.where("rep <> hub").where(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    edges = stored(_confirmed(stars, sets, percent), "links")
    comps = components(edges)
    more = stored(_across(shared, comps, sets, percent), "links")
    if more.limit(1).count():
        forget(comps)
        comps = components(edges.union(more))
    classes = reps.select("k1", "k2", "rep").join(comps, "rep", "left").select("k1", "k2", F.coalesce("comp", "rep").alias("comp"))
    named = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    out = stored(signed.drop("bands").join(classes, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), named).alias("component_id")), "classes")
    forget(signed, reps, shared, ids, sets, edges, comps, more)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = 80, words: int = 2) -> DataFrame:
    """The rows of docs without those that a smaller doc_id stands for.

    Where ids are null or repeat, a row is known by its id and text: repeated rows
    count once, rows of one id with different texts are compared like any others,
    and a row without id is kept only if no row with one stands for it.
    """
    unique = docs.groupBy("doc_id").count().agg(F.coalesce(F.max(F.when(F.col("doc_id").isNull(), 2).otherwise(F.col("count"))), F.lit(0))).first()[0] < 2
    if unique:
        gone = stored(near_duplicates(docs, percent, words).where("not kept").select("doc_id"), "dropped")
        return docs.join(bounded(gone), "doc_id", "left_anti").select(docs.columns)
    t1, t2, row = free(docs, "t1", "t2", "row")
    keyed = docs.withColumn(t1, F.xxhash64("text")).withColumn(t2, F.hash("text")).dropDuplicates(["doc_id", t1, t2])
    order = keyed.select("doc_id", F.col(t1).alias("t1"), F.col(t2).alias("t2")).orderBy(F.col("doc_id").asc_nulls_last(), "t1", "t2")
    numbered = stored(docs.sparkSession.createDataFrame(order.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), "doc_id long, t1 long, t2 int, row long"), "rows")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col(f"d.{t1}") == F.col("r.t1")) & (F.col(f"d.{t2}") == F.col("r.t2"))
    rows = stored(keyed.alias("d").join(numbered.alias("r"), same).select("d.*", F.col("r.row").alias(row)).drop(t1, t2), "keyed")
    gone = stored(near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), percent, words).where("not kept").select(F.col("doc_id").alias(row)), "dropped")
    return rows.join(bounded(gone), row, "left_anti").select(docs.columns)
