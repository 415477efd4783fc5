"""Top-k retrieval for a batch of questions, and what is built from the result.

Exact search keeps, in each task, the best k candidates per question while it streams over
the candidate vectors, so only k rows per question and task are shuffled, never the pairs.
Approximate search does the same over the cells of an index that lie next to a question.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import fixed_values as fv
from ..functions import text as tx, vectors as vx
from ..session import cut_lineage

# Question vectors that travel to every task, or that one group holds, stay under this size.
BLOCK_BYTES = 32 << 20
# A ranked result is broadcast up to this many rows; it has k rows per question.
BROADCAST_ROWS = 1_000_000


def metadata_filter(
    tickers: list[str] | None = None,
    sections: list[str] | None = None,
    form_types: list[str] | None = None,
) -> Column | None:
    """Conjunction of the given lists, or None. Tickers are upper-cased, the others are not."""
    conditions = []
    for name, values in (
        ("ticker", [t.upper() for t in tickers or []]),
        ("section", sections or []),
        ("form_type", form_types or []),
    ):
        if len(values) == 1:
            conditions.append(F.col(name) == values[0])
        elif values:
            conditions.append(F.col(name).isin(values))
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def date_filter(
    rows: DataFrame, date: str = "filing_date", start: Column | str | None = None, end: Column | str | None = None
) -> DataFrame:
    """Inclusive bounds on ISO text. A missing date fails a lower bound and passes an upper one."""
    day = F.coalesce(F.col(date).cast("string"), F.lit(""))
    keep = F.lit(True)
    for bound, test in ((start, lambda b: day >= b), (end, lambda b: day <= b)):
        if bound is None or (isinstance(bound, str) and not bound):
            continue
        b = F.lit(bound) if isinstance(bound, str) else bound
        keep = keep & (b.isNull() | (b == "") | test(b))
    return rows.filter(keep)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


class _Best:
    """The best ``k`` candidates of each question of a block, while candidates go by.

    ``tests`` holds one list per filter column, with a predicate (or None) per question.
    """

    def __init__(self, ids: list, matrix: np.ndarray, k: int, cosine: bool, digits: int, tests: list):
        self.ids, self.k, self.cosine, self.digits, self.tests = ids, k, cosine, digits, tests
        self.matrix = _unit(matrix) if cosine else matrix
        self.best: list[list[tuple]] = [[] for _ in ids]

    def add(self, ids: pa.Array, vectors: pa.ListArray, columns: list[pa.Array]) -> None:
        dim, k, best = self.matrix.shape[1], self.k, self.best
        # Vectors of another length, or none, cannot be scored. This is checked here and
        # not as a filter: pushed below the encoder, a filter would encode twice.
        usable = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
        ids, vectors = ids.filter(usable).to_pylist(), vectors.filter(usable)
        if not ids:
            return
        vecs = _matrix(vectors, dim)
        vecs = _unit(vecs) if self.cosine else vecs
        coded = []
        for column in columns:
            enc = pc.fill_null(column.filter(usable), "").dictionary_encode()
            coded.append((enc.dictionary.to_pylist(), enc.indices.to_numpy(zero_copy_only=False)))
        for lo in range(0, len(self.ids), 256):
            scores = np.round(vecs @ self.matrix[lo : lo + 256].T, self.digits)
            for j in range(scores.shape[1]):
                q, s = lo + j, scores[:, j]
                ok = np.ones(len(ids), dtype=bool)
                for per_question, (names, codes) in zip(self.tests, coded):
                    test = per_question[q]
                    if test is not None:
                        ok &= np.array([test(n) for n in names], dtype=bool)[codes]
                if len(best[q]) == k:
                    ok &= s >= -best[q][-1][0]
                idx = np.flatnonzero(ok)
                if len(idx) > k:
                    # Everything level with the k-th score stays, so ties fall by id.
                    idx = idx[s[idx] >= np.partition(s[idx], -k)[-k]]
                if len(idx):
                    best[q] = nsmallest(k, best[q] + [(-s[i], ids[i]) for i in idx])

    def batch(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows = [(self.ids[q], i, -neg) for q, found in enumerate(self.best) for neg, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema)], schema=schema)


def _tests(asked: dict[str, list], filters: list[str], dates: list[str]) -> list[list]:
    """Predicates of each question: one list per filter column, and one for the dates."""
    tests = [[_one_of(v) for v in asked[q]] for q in filters]
    if dates:
        tests.append([_between(s, e) for s, e in zip(*(asked[c] for c in dates))])
    return tests


def _streamed(make: Callable[[], _Best], schema: pa.Schema):
    """Task-side search of one block of questions over the batches of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = make()
        for batch in batches:
            best.add(batch.column(0), batch.column(1), batch.columns[2:])
        yield from best.batch(schema)

    return run


def _grouped_topk(asked: DataFrame, scan: DataFrame, out_type: T.StructType, dim: int, k: int, cosine: bool, digits: int, filters: list[str], dates: list[str]) -> DataFrame:
    """The best ``k`` of each question within each group: (query, candidate, score).

    Both sides hold their group in ``_g``. The questions of a group come before its candidates, so a task holds
    one group's questions and streams its candidates.
    """
    qid, cid = out_type.names[0], out_type.names[1]
    restricted = [c for c in scan.columns if c not in ("_g", cid, "_v")]
    left = asked.select("_g", F.lit(0).alias("_kind"), F.col(qid).alias("_qid"), "_q", *[F.col(c).alias(f"_asked_{c}") for c in (*filters, *dates)])
    right = scan.select("_g", F.lit(1).alias("_kind"), F.col(cid).alias("_cid"), "_v", *restricted)
    rows = left.unionByName(right, allowMissingColumns=True).repartition("_g").sortWithinPartitions("_g", "_kind")
    schema = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, best = None, [], None
        for batch in batches:
            key = batch.column("_g").to_numpy(zero_copy_only=False)
            kind = batch.column("_kind").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
            for at, end in zip([0, *edges], [*edges, len(key)]):
                if at == end:
                    continue
                part = batch.slice(at, end - at)
                if key[at] != group:
                    if best is not None:
                        yield from best.batch(schema)
                    group, held, best = key[at], [], None
                if kind[at] == 0:
                    held.append(part)
                elif held:
                    if best is None:
                        table = pa.Table.from_batches(held)
                        own = {c: table.column(f"_asked_{c}").to_pylist() for c in (*filters, *dates)}
                        matrix = np.concatenate([_matrix(p.column("_q"), dim) for p in held])
                        best = _Best(table.column("_qid").to_pylist(), matrix, k, cosine, digits, _tests(own, filters, dates))
                        held = [None]
                    best.add(part.column("_cid"), part.column("_v"), [part.column(c) for c in restricted])
        if best is not None:
            yield from best.batch(schema)

    return rows.mapInArrow(run, out_type)


def _ranked(found: DataFrame, query_id: str, cand_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(cand_id))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _one_of(values) -> Callable[[str], bool] | None:
    return set(values).__contains__ if values is not None and len(values) else None


def _between(start, end) -> Callable[[str], bool] | None:
    """Inclusive bounds on ISO text; a missing date is empty text."""
    start, end = start or "", end or ""
    if not start and not end:
        return None
    return lambda day: (not start or day >= start) and (not end or day <= end)


def _pushed(pdf, filters, dates) -> list[Column]:
    """What every question of a block excludes, as filters that reach the scan."""
    pushed = []
    for q, c in filters:
        lists = [v for v in pdf[q] if v is not None and len(v)]
        union = sorted({x for v in lists for x in v})
        if len(lists) == len(pdf) and len(union) <= 1000:
            pushed.append(F.col(c).isin(union))
    if dates:
        start, end, c = dates
        starts, ends = [s for s in pdf[start] if s], [e for e in pdf[end] if e]
        day = F.col(c).cast("string")
        if len(starts) == len(pdf):
            pushed.append(day >= min(starts))
        if len(ends) == len(pdf):
            pushed.append(day.isNull() | (day <= max(ends)))
    return pushed


def exact_topk(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 6,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    cand_id: str = "chunk_id",
    cand_vec: str = "embedding",
    cosine: bool = True,
    digits: int = 9,
    filters: list[tuple[str, str]] | None = None,
    dates: tuple[str, str, str] | None = None,
) -> DataFrame:
    """(query_id, cand_id, score, rank): the best ``k`` candidates of every question.

    ``filters`` pairs an array column of the questions with a candidate column it restricts;
    an empty or null array does not restrict. ``dates`` names the questions' inclusive start
    and end columns and the candidates' date. Scores count to ``digits`` places, ties go to
    the smaller id. Questions are computed once. Up to ``BLOCK_BYTES`` of them travel to every
    task; more are dealt out to groups of at most that size, each of which meets every
    candidate. In both cases candidates are read, and encoded, once.
    """
    filters = filters or []
    out_type = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(cand_id, candidates.schema[cand_id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    asked = [q for q, _ in filters] + (list(dates[:2]) if dates else [])
    usable = cut_lineage(queries.filter(F.size(query_vec) > 0).select(query_id, F.col(query_vec).cast("array<double>").alias("_q"), *asked))
    facts = usable.agg(F.min(F.size("_q")).alias("least"), F.max(F.size("_q")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    dim = facts["dim"]
    if facts["least"] != dim:
        raise ValueError(f"question vectors have different lengths, from {facts['least']} to {dim}")
    if dim is None:
        empty = candidates.sparkSession.createDataFrame([], out_type)
        return empty.withColumn("rank", F.lit(None).cast("int"))
    restricted = [c for _, c in filters] + ([dates[2]] if dates else [])
    named, days = [q for q, _ in filters], list(dates[:2]) if dates else []
    blocks = -(-facts["n"] * dim * 8 // BLOCK_BYTES)
    pdf = usable.toPandas() if blocks <= 1 else None
    scan = candidates
    for condition in _pushed(pdf, filters, dates) if pdf is not None else []:
        scan = scan.filter(condition)
    scan = scan.select(
        cand_id,
        F.col(cand_vec).cast("array<float>").alias("_v"),
        *[F.col(c).cast("string").alias(f"_f{i}") for i, c in enumerate(restricted)],
    )
    if pdf is not None:
        ids, matrix = pdf[query_id].tolist(), np.array(pdf["_q"].tolist(), dtype=np.float64)
        own = {c: pdf[c].tolist() for c in asked}
        make = lambda: _Best(ids, matrix, k, cosine, digits, _tests(own, named, days))
        found = scan.mapInArrow(_streamed(make, to_arrow_schema(out_type)), out_type)
    else:
        # groups of questions times groups of candidates; a candidate is in one of the latter
        groups = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = F.pmod(F.xxhash64(cand_id), F.lit(groups)) * blocks
        scan = scan.select("*", dealt.alias("_c")).select(*scan.columns, F.explode(F.sequence(F.col("_c"), F.col("_c") + blocks - 1)).alias("_g"))
        block = F.pmod(F.xxhash64(query_id), F.lit(blocks))
        every = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * blocks + block)
        found = _grouped_topk(usable.withColumn("_g", F.explode(every)), scan, out_type, dim, k, cosine, digits, named, days)
    return _ranked(found, query_id, cand_id, k)


def rejected_vectors(vectors: DataFrame, dim: int, id: str = "chunk_id", vec: str = "embedding") -> DataFrame:
    """(id, reason): vectors that a search over ``dim`` components leaves out."""
    size = F.size(vec)
    reason = F.when(F.col(vec).isNull(), "no vector").when(size != dim, F.concat(F.lit("length "), size.cast("string")))
    return vectors.select(id, reason.alias("reason")).filter("reason is not null")


def attach(ranked: DataFrame, candidates: DataFrame, cand_id: str, max_rows: int) -> DataFrame:
    """Ranked ids with the candidates' other columns; ``max_rows`` bounds the ranked side."""
    small = F.broadcast(ranked) if max_rows <= BROADCAST_ROWS else ranked
    return candidates.join(small, cand_id)


def search(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = 6,
    cosine: bool = True,
    date_mode: str = "post",
    vec: str = "embedding",
) -> DataFrame:
    """Filtered retrieval for a table of questions.

    ``tickers``, ``sections`` and ``form_types`` of a question restrict before the search.
    Its date bounds apply after it with ``date_mode="post"``, so fewer than ``k`` rows may be
    left, or before it with ``"pre"``.
    """
    names = [("tickers", "ticker"), ("sections", "section"), ("form_types", "form_type")]
    filters = [(q, c) for q, c in names if q in questions.columns and c in chunks.columns]
    asked = questions
    if "tickers" in questions.columns:
        asked = asked.withColumn("tickers", F.transform("tickers", F.upper))
    dated = {"date_start", "date_end"} <= set(questions.columns) and "filing_date" in chunks.columns
    before = ("date_start", "date_end", "filing_date") if dated and date_mode == "pre" else None
    ranked = exact_topk(
        asked, chunks, k, query_vec=vec, cand_vec=vec, cosine=cosine, filters=filters, dates=before
    )
    found = attach(ranked, chunks.drop(vec), "chunk_id", questions.count() * k)
    if dated and before is None:
        bounds = asked.select("query_id", "date_start", "date_end")
        found = date_filter(
            found.join(bounds, "query_id"), "filing_date", F.col("date_start"), F.col("date_end")
        ).drop("date_start", "date_end")
    return found


def nearest(
    candidates: DataFrame, vector: list[float], k: int = 5, vec: str = "embedding", tie: str = "chunk_id"
) -> DataFrame:
    """Top ``k`` rows for a single vector, by dot product, as a bounded heap per task."""
    target = F.lit([float(x) for x in vector])
    return (
        candidates.withColumn("score", vx.dot(F.col(vec), target))
        .orderBy(F.col("score").desc_nulls_last(), tie)
        .limit(k)
    )


# ---- cells -------------------------------------------------------------------------------

# Candidates of a cell that one task walks; a cell with more is split.
CELL_ROWS = 1 << 16
MAX_CELLS = 4096


def fit_cells(vectors: DataFrame, vec: str = "embedding", cells: int | None = None, sample_rows: int = 20_000, rounds: int = 15, seed: int = 42) -> np.ndarray:
    """Unit centroids of spherical k-means over at most ``sample_rows`` vectors, chosen by their hash.

    Only the places of the cells depend on the sample: the index holds every vector. The root of the
    number of vectors, but at most ``MAX_CELLS``, is the default number of cells.
    """
    usable = vectors.filter(F.size(vec) > 0).select(F.col(vec).cast("array<double>").alias("v"))
    if cells is None:
        cells = min(MAX_CELLS, max(1, round(usable.count() ** 0.5)))
    rows = [r["v"] for r in usable.orderBy(F.xxhash64("v"), "v").limit(sample_rows).collect()]
    if not rows:
        return np.zeros((0, 0))
    points = _unit(np.array([r for r in rows if len(r) == len(rows[0])], dtype=np.float64))
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(rounds):
        own = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids = np.where(np.bincount(own, minlength=len(centroids))[:, None] > 0, _unit(sums), centroids)
    return centroids


def with_cells(vectors: DataFrame, centroids: np.ndarray, vec: str = "embedding", probes: int | None = None) -> DataFrame:
    """Adds ``cell``, that of the nearest centroid (-1 without a usable vector), or ``cells``, the nearest ``probes``."""
    kind = T.IntegerType() if probes is None else T.ArrayType(T.IntegerType())
    name = "cell" if probes is None else "cells"
    schema = T.StructType([*vectors.schema.fields, T.StructField(name, kind)])
    at = vectors.columns.index(vec)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            ok = pc.fill_null(pc.equal(pc.list_value_length(column), centroids.shape[1]), False)
            usable = ok.to_numpy(zero_copy_only=False)
            near = _unit(_matrix(column.filter(ok), centroids.shape[1])) @ centroids.T if usable.any() else None
            if probes is None:
                own = np.full(len(usable), -1, np.int32)
                if near is not None:
                    own[usable] = near.argmax(axis=1)
                cells = pa.array(own)
            else:
                lists = [[] for _ in usable]
                if near is not None:
                    order = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    for row, found in zip(np.flatnonzero(usable), order.tolist()):
                        lists[row] = found
                cells = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], schema=arrow)

    return vectors.mapInArrow(run, schema)


def write_cells(indexed: DataFrame, path: str, id: str = "chunk_id") -> DataFrame:
    """Writes an index, one folder per cell; a cell of many rows is written by several tasks. Returns it as read."""
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL_ROWS)).alias("_parts"))  # one row per cell
    dealt = indexed.join(F.broadcast(sizes), "cell").repartition("cell", F.pmod(F.xxhash64(id), F.col("_parts")))
    dealt.drop("_parts").write.partitionBy("cell").parquet(path)
    return indexed.sparkSession.read.schema(indexed.schema).parquet(path)


def cells_topk(
    queries: DataFrame,
    indexed: DataFrame,
    centroids: np.ndarray,
    k: int = 6,
    probes: int = 8,
    query_id: str = "query_id",
    cand_id: str = "chunk_id",
    vec: str = "embedding",
    digits: int = 9,
) -> DataFrame:
    """Approximate top ``k`` by cosine: the candidates in the ``probes`` cells nearest to a question, scored exactly.

    Only probed cells are read. A cell of many candidates is split, and the questions of a cell are dealt out to
    groups of at most ``BLOCK_BYTES``. All cells probed give the exact result.
    """
    out_type = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(cand_id, indexed.schema[cand_id].dataType), T.StructField("score", T.DoubleType())])
    dim = centroids.shape[1]
    near = with_cells(queries.filter(F.size(vec) == dim).select(query_id, F.col(vec).cast("array<double>").alias(vec)), centroids, vec, probes)
    asked = cut_lineage(near.select(query_id, F.col(vec).alias("_q"), F.explode("cells").alias("cell")))
    probed = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per cell
    if not probed:
        return candidates_none(indexed, out_type)
    blocks = -(-max(r["n"] for r in probed) * dim * 8 // BLOCK_BYTES)
    read = indexed.filter(F.col("cell").isin([r["cell"] for r in probed]))
    parts = F.broadcast(read.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL_ROWS)).alias("_parts")))  # one row per cell
    group = lambda part, block: (F.col("cell").cast("long") * (1 << 24) + part) * blocks + block
    own = read.join(parts, "cell").select(cand_id, F.col(vec).cast("array<float>").alias("_v"), group(F.pmod(F.xxhash64(cand_id), F.col("_parts")), F.lit(0)).alias("_c"))
    scan = own.select(cand_id, "_v", F.explode(F.sequence(F.col("_c"), F.col("_c") + blocks - 1)).alias("_g"))
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    every = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda part: group(part, block))
    dealt = asked.join(parts, "cell").withColumn("_g", F.explode(every))
    return _ranked(_grouped_topk(dealt, scan, out_type, dim, k, True, digits, [], []), query_id, cand_id, k)


def tuned_probes(
    vectors: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int = 6, target: float = 0.95, questions: int = 256,
    cand_id: str = "chunk_id", vec: str = "embedding",
) -> int:
    """The fewest probes with which ``target`` of the exact neighbours of sample vectors lie in probed cells.

    At most ``questions`` vectors, chosen by the hash of their id, ask for their ``k`` nearest others. How many cells that
    takes is a property of the vectors: few where they form clusters, most of them where they have no structure.
    """
    asked = vectors.filter(F.size(vec) == centroids.shape[1]).orderBy(F.xxhash64(cand_id), cand_id).limit(questions).select(F.col(cand_id).alias("_asked"), vec)
    order = {r["_asked"]: {c: i for i, c in enumerate(r["cells"])} for r in with_cells(asked, centroids, vec, len(centroids)).select("_asked", "cells").collect()}
    exact = exact_topk(asked, vectors, k + 1, query_id="_asked", query_vec=vec, cand_id=cand_id, cand_vec=vec).filter(F.col("_asked") != F.col(cand_id))
    met = indexed.select(cand_id, "cell").join(exact.select("_asked", cand_id), cand_id).collect()  # k rows per question
    ranks = sorted(order[r["_asked"]].get(r["cell"], len(centroids)) for r in met)
    return min(len(centroids), ranks[math.ceil(target * len(ranks)) - 1] + 1) if ranks else len(centroids)


def candidates_none(indexed: DataFrame, out_type: T.StructType) -> DataFrame:
    return indexed.sparkSession.createDataFrame([], out_type).withColumn("rank", F.lit(None).cast("int"))


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", cand_id: str = "chunk_id") -> DataFrame:
    """(wanted, met, recall): the share of the pairs of an exact search that another one found."""
    pairs = exact.select(query_id, cand_id).join(found.select(query_id, cand_id, F.lit(1).alias("_hit")), [query_id, cand_id], "left")
    wanted, met = F.count(F.lit(1)), F.count("_hit")
    return pairs.agg(wanted.alias("wanted"), met.alias("met"), F.try_divide(met, wanted).alias("recall"))


def within_budget(
    ranked: DataFrame, text: str = "document", budget: float = 1200, tokens: Column | None = None
) -> DataFrame:
    """Marks (``in_context``) the ranked prefix whose running token sum stays inside the budget.

    The first chunk that does not fit ends the prefix, even if a later one would fit.
    ``tokens`` is any non-negative column; four characters per token if not given.
    """
    w = (
        Window.partitionBy("query_id").orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cost = tx.token_estimate(F.col(text)) if tokens is None else tokens
    return ranked.withColumn("tokens_used", F.sum(cost).over(w)).withColumn(
        "in_context", F.col("tokens_used") <= budget
    )


def contexts(budgeted: DataFrame, text: str = "document", bullets: bool = False) -> DataFrame:
    """One context per question: chunks parted by a blank line, or as a bulleted list."""
    kept = F.collect_list(F.when(F.col("in_context"), F.struct("rank", F.col(text).alias("t"))))
    passages = F.transform(F.array_sort(kept), lambda c: c["t"])
    joined = (
        F.concat(F.lit("- "), F.array_join(passages, "\n- ")) if bullets else F.array_join(passages, "\n\n")
    )
    return budgeted.groupBy("query_id").agg(joined.alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame, template: str = fv.ANSWER_TEMPLATE) -> DataFrame:
    """One prompt per question, also for those without any context."""
    head, rest = template.split("{context}")
    middle, tail = rest.split("{question}")
    return questions.join(contexts, "query_id", "left").select(
        "query_id",
        "question",
        F.coalesce("context", F.lit("")).alias("context"),
        F.concat(
            F.lit(head), F.coalesce("context", F.lit("")), F.lit(middle), F.col("question"), F.lit(tail)
        ).alias("prompt"),
    )


SOURCE_COLUMNS = ["ticker", "company_name", "filing_date", "form_type", "section", "accession_number"]


def citations(found: DataFrame, text: str = "document", snippet_chars: int = 400) -> DataFrame:
    """Sources of each question in rank order, with a snippet."""
    have = [c if c in found.columns else F.lit("").alias(c) for c in SOURCE_COLUMNS]
    source = F.struct(*have, tx.snippet(F.col(text), snippet_chars).alias("text"))
    return found.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", source.alias("s")))), lambda c: c["s"]
        ).alias("sources")
    )
