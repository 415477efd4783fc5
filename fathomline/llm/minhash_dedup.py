"""MinHash near-dedup with tensored banding.

A document has two collections of small hashes, each made of ``rows`` minhashes: A_1..A_m and
B_1..B_m. Every pair (A_i, B_j) is the key of a table, so 2 m small hashes serve m x m tables whose
keys hold 2 x rows minhashes. Two documents meet in a table when they agree in some A_i and some B_j.

1. One pass over the texts gives each row a digest of its shingle set and its small hashes. Equal
   sets become one class, so copies never meet each other again.
2. A small hash that only one class has cannot be part of a shared key. Keys are formed from the
   shared ones alone, which leaves most documents with none.
3. In each table every class is paired with one class of its bucket, chosen differently per table:
   a bucket of n gives n - 1 pairs. Pairs are verified on full shingle sets.
4. Buckets that still hold several components are chained by the classes they have in common. A chain
   that fits in one task is compared there, all with all, and gives a spanning forest. Larger ones
   are paired again as in step 3; then their pairs across components are verified, each in the
   first table that the two share. So every pair that shares a key is verified or already connected.

At a similarity of exactly 0.8 a pair shares no key with a chance of 2e-5 (rows 3, m 16).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .shared import Cache, attach, cut, spare

SHINGLE = 5
PERCENT = 80
COLLECTION = 16
ROWS = 3
#: Ids that may be broadcast as a filter: 8 bytes each, so 16 MB.
BROADCAST_IDS = 2_000_000
#: Packed shingles of a chain of buckets that one task may hold.
CHAIN_BYTES = 48 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, size: int):
        self.size = size
        self.words = Cache(xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes | None) -> np.ndarray:
        # bytes know only ASCII: A-Z are lower-cased, words end at space and \t to \r
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = max(1, len(ids) - self.size + 1)
        out = np.full(n, min(len(ids), self.size), np.uint64)
        for k in range(min(self.size, len(ids))):
            out = _scrambled(out * _MIX + ids[k : k + n])
        out.sort()
        return out if n == 1 else out[np.concatenate(([True], out[1:] != out[:-1]))]


def _coefficients(n: int) -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def small_hashes(shingles: np.ndarray, factors: np.ndarray, rows: int) -> np.ndarray:
    """The hashes of both collections; each folds ``rows`` minhashes."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        for k, f in enumerate(factors):
            least[k] = min(least[k], (part * f).min())
    folded = least.reshape(-1, rows)
    out = folded[:, 0]
    for k in range(1, rows):
        out = _scrambled(out * _MIX + folded[:, k])
    return out


def _text_hash():
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def sketches(docs: DataFrame, shingle: int = SHINGLE, collection: int = COLLECTION, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, digest, n_shingles, small) of every row; the digest stands for the whole shingle set.

    ``small`` holds the 2 x collection small hashes as 64-bit integers, null for an empty set.
    """
    factors = _coefficients(2 * collection * rows)

    def run(batches):
        shingles_of = Shingler(shingle)
        for batch in batches:
            digest, n, small = [], [], []
            for text in batch.column(1):
                own = shingles_of(text.as_py())
                digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                n.append(len(own))
                small.append(small_hashes(own, factors, rows).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(small, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "digest", "n_shingles", "small"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), _text_hash())
    return source.mapInArrow(run, "doc_id long, text_hash long, digest binary, n_shingles long, small array<long>")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(rep, digest, shingles) of rows (rep, text); shingles are packed 64-bit hashes."""

    def run(batches):
        shingles_of = Shingler(shingle)
        for batch in batches:
            packed = [shingles_of(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(xxhash.xxh3_128_digest, packed), pa.binary()), pa.array(packed, pa.binary())],
                names=["rep", "digest", "shingles"],
            )

    return docs.mapInArrow(run, "rep long, digest binary, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet ``100 * intersection >= percent * union``."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                if min(len(one), len(two)) * 100 < percent * max(len(one), len(two)):
                    keep.append(False)
                    continue
                at = np.searchsorted(one, two)
                at[at == len(one)] = 0
                common = int((one[at] == two).sum()) if len(one) else 0
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("__x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("__y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "__x", "__y").mapInArrow(run, "a long, b long")


def _table_keys(classes: DataFrame, collection: int) -> DataFrame:
    """(node, table, key): the keys that can be shared, formed from small hashes of several classes."""
    hashes = classes.select("node", F.posexplode("small").alias("at", "h"))
    shared = hashes.groupBy("at", "h").count().where("count > 1").select("at", "h")
    own = hashes.join(shared, ["at", "h"]).groupBy("node").agg(F.collect_list(F.struct("at", "h")).alias("own"))
    side = lambda test: F.filter("own", test)
    first = side(lambda x: x["at"] < collection)
    second = side(lambda x: x["at"] >= collection)
    return (
        own.select("node", F.explode(first).alias("x"), second.alias("second"))
        .select("node", "x", F.explode("second").alias("y"))
        .select("node", (F.col("x.at") * collection + F.col("y.at") - collection).alias("table"), F.xxhash64("x", "y").alias("key"))
    )


def _bucket_pairs(keys: DataFrame, masks: int, labels: DataFrame | None = None) -> DataFrame:
    """Each class with one other of its bucket; which one differs by table, in ``masks`` ways.

    With ``labels`` (node, component), pairs within a component are left out.
    """
    rng = np.random.default_rng(masks)
    by_table = F.array(*(F.lit(int(m)) for m in rng.integers(0, 2**62, masks)))
    mask = F.element_at(by_table, (F.col("table") % masks + 1).cast("int"))
    ranked = keys.select("table", "key", "node", F.col("node").bitwiseXOR(mask).alias("rank"), mask.alias("mask"))
    heads = ranked.groupBy("table", "key").agg(F.min("rank").alias("head"), F.count("*").alias("n")).where("n > 1")
    met = ranked.join(heads.select("table", "key", "head"), ["table", "key"])
    head = F.col("head").bitwiseXOR(F.col("mask"))
    pairs = met.where(F.col("node") != head).select(F.greatest("node", head).alias("a"), F.least("node", head).alias("b")).distinct()
    if labels is None:
        return pairs
    label = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    return pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(apart).select("a", "b")


def _mixed(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """The keys of buckets that hold several components: (table, key, node, component, minor).

    ``minor`` rows are outside the component that most of the bucket belongs to.
    """
    labelled = keys.select("table", "key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = labelled.groupBy("table", "key", "component").agg(F.count("*").alias("n"))
    several = held.groupBy("table", "key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("k")).where("k > 1")
    met = labelled.join(several.select("table", "key", "major"), ["table", "key"])
    return met.select("table", "key", "node", "component", (F.col("component") != F.col("major")).alias("minor"))


def _pairs_across(mixed: DataFrame, classes: DataFrame, collection: int) -> DataFrame:
    """(a, b): all pairs of a bucket that lie in different components, each from the first table they share."""
    rows = mixed.join(classes.select("node", "small"), "node")
    left = rows.where("minor").select("table", "key", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("small").alias("sa"))
    right = rows.select("table", "key", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("small").alias("sb"), "minor")
    first = lambda name, at, n: F.slice(name, at, n)
    i, j = F.floor(F.col("table") / collection).cast("int"), (F.col("table") % collection).cast("int")
    earlier = lambda at, n: F.exists(F.zip_with(first("sa", at, n), first("sb", at, n), lambda x, y: x == y), lambda same: same)
    met = left.join(right, ["table", "key"]).where(
        (F.col("ca") != F.col("cb")) & (~F.col("minor") | (F.col("a") > F.col("b"))) & ~earlier(F.lit(1), i) & ~earlier(F.lit(collection + 1), j)
    )
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, collection: int) -> DataFrame:
    """(node, component) of the classes (node, rep, digest, small) that are linked to another."""
    keys = cut(_table_keys(classes, collection))
    met = classes.join(keys.select("node").distinct(), "node", "left_semi").select("node", "rep", "digest")
    reps = met.select("rep").distinct()
    wanted = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").cast("binary").alias("text"))
    # the digest tells apart rows that repeat an id with another text; equal rows count once
    sets = _shingle_sets(texts.join(wanted, "rep", "left_semi"), shingle).join(met, ["rep", "digest"])
    sets = cut(sets.groupBy("node").agg(F.min("shingles").alias("shingles")))
    pairs = cut(_bucket_pairs(keys, 2))
    labels = cut(connected_components(cut(_verified(pairs, sets, percent))))
    mixed = cut(_mixed(keys, labels))
    chains = connected_components(_bucket_pairs(mixed, 1)).withColumnRenamed("component", "chain")
    chained = cut(chains.join(sets.select("node", F.length("shingles").alias("size")), "node"))
    small = chained.groupBy("chain").agg(F.sum("size").alias("bytes")).where(F.col("bytes") <= CHAIN_BYTES).select("chain")
    inside = cut(chained.join(small, "chain").select("node", "chain"))
    edges = [labels.select(F.col("node").alias("a"), F.col("component").alias("b")), _linked_within(inside.join(sets, "node"), percent)]
    mixed = cut(mixed.join(inside, "node", "left_anti"))
    if not mixed.isEmpty():
        more = cut(_bucket_pairs(mixed, collection * collection, labels).join(pairs, ["a", "b"], "left_anti"))
        late = cut(_verified(more, sets, percent))
        merged = cut(connected_components(edges[0].union(late)))
        rest = cut(_pairs_across(_mixed(mixed, merged), classes, collection).join(pairs.union(more), ["a", "b"], "left_anti"))
        edges += [late, _verified(rest, sets, percent)]
    whole = edges[0]
    for part in edges[1:]:
        whole = whole.union(part)
    return connected_components(cut(whole))


def _linked_within(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each chain of ``rows`` (chain, node, shingles).

    Every pair of a chain is compared, by counting common shingles over postings: the shingle lists
    of a chain fit in CHAIN_BYTES, and what is written is a row per class.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group["node"].to_numpy()
        lists = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        sizes = np.array([len(x) for x in lists])
        owner = np.repeat(np.arange(len(nodes), dtype=np.int32), sizes)
        ids = np.unique(np.concatenate(lists), return_inverse=True)[1].astype(np.int32)
        posted = owner[np.argsort(ids, kind="stable")]
        ends = np.cumsum(np.bincount(ids))
        starts = np.concatenate(([0], ends[:-1]))
        shared = (ends - starts > 1)[ids]
        first = np.concatenate(([0], np.cumsum(sizes)))
        root = np.arange(len(nodes))
        for k in range(len(nodes)):
            own = ids[first[k] : first[k + 1]][shared[first[k] : first[k + 1]]]
            if not len(own):
                continue
            common = np.bincount(np.concatenate([posted[i:j] for i, j in zip(starts[own], ends[own])]), minlength=len(nodes))
            hit = np.flatnonzero(100 * common >= percent * (sizes[k] + sizes - common))
            roots = np.unique(root[hit])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
        return pd.DataFrame({"a": nodes, "b": nodes[root]})

    return rows.select("chain", "node", "shingles").groupBy("chain").applyInPandas(run, "a long, b long")


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, collection: int = COLLECTION, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Words are lower-cased in A-Z and end at white space; a text of fewer words than ``shingle`` is
    one shingle; null, empty and blank texts have none and are linked with nothing. Component_id
    is the smallest doc_id reachable over links, kept where it is the own one. Rows without an id
    are linked with nothing: component_id null, kept. Repeated rows are all returned, with equal
    results; an empty table gives an empty table; other columns are not read.
    """
    all_rows = cut(sketches(docs, shingle, collection, rows))
    linked = all_rows.where("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # the smallest id of a class carries its hashes; rows that repeat it are equal
    small = (
        linked.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
        .groupBy("digest").agg(F.min("small").alias("small"))
    )
    known = cut(classes.join(small, "digest").withColumn("node", F.monotonically_increasing_id()))
    parts = links(docs, known, shingle, percent, collection)
    member = known.join(cut(parts), "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = cut(member.join(roots, "component").select("digest", "copies", "component_id"))
    found = attach(all_rows.select("doc_id", "text_hash", "digest", "n_shingles"), facts, "digest", "copies")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_hash", "n_shingles", own.cast("long").alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest id.

    All columns stay, whatever their names. Texts without words and rows without an id stay; of rows that
    repeat an id and its text, one stays. An empty table gives an empty table.
    """
    key = ["doc_id", "text_hash"]
    found = cut(groups(docs, shingle, percent))
    dropped = found.where("not kept").select(*key).distinct()
    repeated = found.where("kept and n_shingles > 0 and doc_id is not null").groupBy(*key).count().where("count > 1").select(*key)
    names = spare(docs, "__id", "__hash")
    own = docs.withColumns(dict(zip(names, [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))])))
    gone, once = (keys.toDF(*names) for keys in (dropped.union(repeated), repeated))
    single = own.join(gone, names, "left_anti")
    one_each = own.join(once, names, "left_semi").dropDuplicates(names)
    return single.select(*docs.columns).union(one_each.select(*docs.columns))
