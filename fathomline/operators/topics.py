"""Topics: TF-IDF with one- and two-word terms, and LDA fitted over the whole corpus."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed_values as fv
from ..functions.binding import let
from ..session import cut_lineage


def words(text: Column, stop_words: list[str]) -> Column:
    """Lower-case words of two letters or more, without stop words."""
    found = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    keep = lambda w: F.length(w) >= 2
    if not stop_words:
        return F.filter(found, keep)
    return F.filter(found, lambda w: keep(w) & ~w.isin(list(stop_words)))


def terms(text: Column, stop_words: list[str]) -> Column:
    """Words and pairs of neighbouring words; stop words are gone before pairs are formed."""

    def with_pairs(ws: Column) -> Column:
        shifted = F.slice(ws, 2, F.size(ws))
        pairs = F.zip_with(ws, shifted, lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
        return F.concat(ws, F.filter(pairs, lambda pair: pair.isNotNull()))

    return let(words(text, stop_words), with_pairs)


def english_stop_words(extra: list[str] = fv.FILING_STOP_WORDS) -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english") + list(extra)


# Words that a task counts or codes at a time, which bounds its memory.
CHUNK_WORDS = 1 << 20


def _starts(lists: pa.Array) -> np.ndarray:
    """Where the values of each list begin, and where the last one's end; a null list has none."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _chunks(lists: pa.Array):
    """(rows, flat words, row of each word) of runs of rows with about ``CHUNK_WORDS`` words each."""
    starts, first = _starts(lists), 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK_WORDS, side="right")) - 1)
        yield slice(first, last), lists.slice(first, last - first).flatten(), np.repeat(np.arange(last - first), np.diff(starts[first : last + 1]))
        first = last


def _totals(listed: DataFrame, firsts: list[str] | None = None, seconds: list[str] | None = None) -> DataFrame:
    """(term, df, total) of the words, or given ``firsts`` of the pairs that begin with one of them.

    With ``seconds`` a pair's second word is one of these too. Terms are counted by their numbers in chunks of rows, then
    per task, then per term. The number of rows is the df of a term that is null.
    """

    def run(batches):
        for batch in batches:
            for rows, words_, owner in _chunks(batch.column(0)):
                coded = words_.dictionary_encode()
                names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                if firsts is not None:
                    known = [np.ones(len(names), bool) if some is None else pc.is_in(names, pa.array(some, names.type)).to_numpy(zero_copy_only=False) for some in (firsts, seconds)]
                    at = np.flatnonzero((owner[:-1] == owner[1:]) & known[0][codes[:-1]] & known[1][codes[1:]])
                    pairs, codes = np.unique(codes[at] * len(names) + codes[at + 1], return_inverse=True)
                    owner = owner[at]
                    names = pc.binary_join_element_wise(*(names.take(pa.array(x)) for x in np.divmod(pairs, max(1, len(names)))), " ")
                n = len(names)
                seen = np.sort(owner * n + codes)
                once = seen[np.diff(seen, prepend=-1) > 0] % max(1, n)
                df, total = (np.append(np.bincount(x, minlength=n), extra).astype(np.int64) for x, extra in ((once, rows.stop - rows.start), (codes, 0)))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([names.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(df), pa.array(total)], names=["term", "df", "total"])

    found = listed.mapInArrow(run, "term string, df long, total long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(
    docs: DataFrame,
    text: str,
    stop_words: list[str],
    max_features: int = 5000,
    min_df: int = 2,
    max_df: float = 0.9,
) -> tuple[list[str], np.ndarray]:
    """The most frequent terms that occur in enough but not too many documents, and their smooth idf.

    Words are counted first. A pair occurs no more often, and in no more documents, than either of its words; so no pair can
    be among the terms unless both its words are as frequent as the last of ``max_features`` words, and others are not
    counted. A pair sorts behind its first word, so of words that are as frequent as the last one only those before it can
    begin a pair. At most ``max_features`` rows come back, and the few words that are in too many documents.
    """
    listed = docs.select(words(F.coalesce(F.col(text), F.lit("")), stop_words).alias("_words"))
    counts = cut_lineage(_totals(listed).filter((F.col("df") >= min_df) | F.col("term").isNull()))
    whole = counts.filter("term is null").first()
    n_docs = whole["df"] if whole else 0
    single, fits = counts.filter((F.col("df") >= min_df) & F.col("term").isNotNull()), F.col("df") <= max_df * n_docs
    leading = lambda found: found.filter(fits).orderBy(F.desc("total"), "term").limit(max_features)
    top = leading(single).collect()
    lowest = top[-1]["total"] if top and len(top) == max_features else 0
    as_frequent = single.filter(F.col("total") >= lowest)
    firsts = [r["term"] for r in top] + [r["term"] for r in as_frequent.filter(~fits).select("term").collect()]
    # very many words that are as frequent as the last one are not sent to the tasks
    seconds = [r["term"] for r in as_frequent.select("term").limit(4 * len(firsts) + 1).collect()]
    pairs = _totals(listed, firsts, seconds if len(seconds) <= 4 * len(firsts) else None).filter((F.col("df") >= min_df) & F.col("term").isNotNull())
    rows = leading(single.unionByName(pairs)).collect()
    return [r["term"] for r in rows], np.array([math.log((1 + n_docs) / (1 + r["df"])) + 1 for r in rows])


def _weigher(vocab: list[str], idf: np.ndarray):
    """Function of (flat words, row of each, number of rows): where each row's terms start, their numbers in the vocabulary
    in order, counts, and tf-idf weights of unit length."""
    parts = [t.split(" ") for t in vocab]
    single = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
    n = max(1, len(single))
    alone, joined = np.full(n, -1), {}
    for i, p in enumerate(parts):
        if len(p) == 1:
            alone[single[p[0]]] = i
        else:
            joined[single[p[0]] * n + single[p[1]]] = i
    keys = np.array(sorted(joined), dtype=np.int64)
    numbers = np.array([joined[k] for k in sorted(joined)], dtype=np.int64)

    def weigh(words_: pa.Array, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = pc.index_in(words_, pa.array([*single], words_.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.flatnonzero(at >= 0)
        one = alone[at[known]]
        found = [owner[known[one >= 0]] * len(vocab) + one[one >= 0]]
        if len(keys):
            left = known[:-1][(np.diff(known) == 1)]
            left = left[owner[left] == owner[left + 1]]
            pair = at[left] * n + at[left + 1]
            place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            same = keys[place] == pair
            found.append(owner[left[same]] * len(vocab) + numbers[place[same]])
        each, tf = np.unique(np.concatenate(found), return_counts=True)
        row, codes = np.divmod(each, max(1, len(vocab)))
        w = tf * idf[codes]
        norm = np.sqrt(np.bincount(row, w * w, rows))
        return np.searchsorted(row, np.arange(rows + 1)), codes, tf, w / norm[row]

    return weigh


def tfidf_table(
    docs: DataFrame,
    doc_id: str,
    text: str = "text",
    stop_words: list[str] | None = None,
    max_features: int = 5000,
    min_df: int = 2,
    max_df: float = 0.9,
) -> DataFrame:
    """(doc, term, tf, weight): smooth idf, unit length per document.

    Weight is tf * (ln((1 + n) / (1 + df)) + 1) over the document's norm. Terms are counted, weighed
    and normed within the row, so after the vocabulary (at most ``max_features`` terms) nothing is shuffled.
    """
    stops = english_stop_words() if stop_words is None else stop_words
    vocab, idf = vocabulary(docs, text, stops, max_features, min_df, max_df)
    weigh = _weigher(vocab, idf)
    key = docs.schema[doc_id]
    schema = T.StructType([key, T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("weight", T.DoubleType())])

    def run(batches):
        names = pa.array(vocab, pa.string())
        for batch in batches:
            for rows, words_, owner in _chunks(batch.column(1)):
                starts, codes, tf, w = weigh(words_, owner, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(rows.start, rows.stop), np.diff(starts)))), names.take(pa.array(codes)), pa.array(tf.astype(np.int64)), pa.array(w.astype(np.float64))],
                    names=[doc_id, "term", "tf", "weight"],
                )

    return docs.select(doc_id, words(F.col(text), stops).alias("_words")).mapInArrow(run, schema)


# ---- topics ------------------------------------------------------------------------------

# Numbers per topic of a batch of documents that is mixed at a time: little enough for a processor's cache.
BATCH_TERMS = 1 << 16


def _digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the log of the gamma function, for positive numbers."""
    # eight steps up, far enough out for the series: the sum of 1 / (x + i), in which i and 7 - i are paired
    a = x * (x + 7)
    b, c, d = a + 6, a + 10, a + 12
    ab, cd = a * b, c * d
    low = (2 * x + 7) * ((a + b) * cd + (c + d) * ab) / (ab * cd)
    x = x + 8
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240))) - low


def expected(shares: np.ndarray) -> np.ndarray:
    """exp of the expected log of each part of Dirichlet distributions, one per row."""
    low = _digamma(np.concatenate([shares, shares.sum(axis=1, keepdims=True)], axis=1))
    return np.exp(low[:, :-1] - low[:, -1:])


def _batches(starts: np.ndarray, terms_: np.ndarray, weights: np.ndarray):
    """(documents, their terms, their weights) of documents of about one size, padded to one with weights of zero.

    A batch has at most ``BATCH_TERMS`` places unless it is one document; documents without terms are in none.
    """
    sizes = np.diff(starts)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    ordered, last = sizes[order], len(order)
    while last:
        longest = int(ordered[last - 1])
        first = max(last - max(1, BATCH_TERMS // longest), int(np.searchsorted(ordered[:last], 0.8 * longest)))
        own = order[first:last]
        inside = np.arange(longest) < sizes[own, None]
        at = np.where(inside, starts[own, None] + np.arange(longest), starts[own, None])
        yield own, terms_[at], np.where(inside, weights[at], 0.0)
        last = first


def _placed(topics: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The topics at each place of a batch: documents, topics, places."""
    return np.ascontiguousarray(topics[codes].transpose(0, 2, 1))


def _expectation(mix: np.ndarray, term: np.ndarray) -> np.ndarray:
    """What mixes expect of the term at each place."""
    return np.matmul(mix[:, None, :], term)[:, 0, :] + 1e-100


def _mixed(term: np.ndarray, weights: np.ndarray, alpha: float, rounds: int, tolerance: float) -> np.ndarray:
    """Topic shares (unnormed) of a batch; ``term`` has the topics at each place.

    Documents whose shares moved by less than ``tolerance`` on average are done; a batch is packed anew when a quarter is.
    """
    shares = np.ones(term.shape[:2])
    out, at, open_ = shares.copy(), np.arange(len(weights)), np.ones(len(weights), bool)
    for _ in range(rounds):
        mix = expected(shares)
        new = alpha + mix * np.matmul(term, (weights / _expectation(mix, term))[:, :, None])[:, :, 0]
        moved = np.abs(new - shares).mean(axis=1) >= tolerance
        shares = new
        if moved.all():
            continue
        done = open_ & ~moved
        out[at[done]] = new[done]
        open_ &= moved
        left = np.count_nonzero(open_)
        if not left:
            return out
        if left <= 0.75 * len(open_):
            term, weights, shares, at = term[open_], weights[open_], shares[open_], at[open_]
            open_ = np.ones(left, bool)
    out[at[open_]] = shares[open_]
    return out


def mixes(starts: np.ndarray, terms_: np.ndarray, weights: np.ndarray, topics: np.ndarray, alpha: float, rounds: int, tolerance: float) -> np.ndarray:
    """Topic shares (unnormed) of documents given as runs of terms; ``topics`` has a row per term."""
    shares = np.full((len(starts) - 1, topics.shape[1]), alpha)
    for own, codes, w in _batches(starts, terms_, weights):
        shares[own] = _mixed(_placed(topics, codes), w, alpha, rounds, tolerance)
    return shares


@dataclass
class TopicModel:
    """A fitted topic model: the vocabulary with its idf, and a weight per topic and term."""

    vocabulary: list[str]
    idf: np.ndarray
    components: np.ndarray
    stop_words: list[str]
    text: str
    rounds: int
    tolerance: float
    log_perplexity: float | None = None

    @property
    def n_topics(self) -> int:
        return len(self.components)

    def topics(self, n_words: int = 10, n_topics: int | None = None) -> list[tuple[int, list[str], list[float]]]:
        """(topic, words, weights), the heaviest words of each topic first; equal weights in vocabulary order."""
        out = []
        for k, row in enumerate(self.components[:n_topics]):
            top = np.argsort(-row, kind="stable")[:n_words]
            out.append((k, [self.vocabulary[i] for i in top], [float(row[i] / row.sum()) for i in top]))
        return out

    def topic_table(self, spark: SparkSession, n_words: int = 10, n_topics: int | None = None) -> DataFrame:
        return spark.createDataFrame(self.topics(n_words, n_topics), "topic int, words array<string>, weights array<double>")

    def transform(self, docs: DataFrame) -> DataFrame:
        """Adds ``topic_0`` .. ``topic_{k-1}``, the topic mix of each document."""
        weigh, topics, alpha, rounds, tolerance = _weigher(self.vocabulary, self.idf), np.ascontiguousarray(expected(self.components).T), 1 / self.n_topics, self.rounds, self.tolerance

        @F.arrow_udf("array<double>")
        def mix(found: pa.Array) -> pa.Array:
            out = []
            for rows, words_, owner in _chunks(found):
                starts, codes, _, w = weigh(words_, owner, rows.stop - rows.start)
                shares = mixes(starts, codes, w, topics, alpha, rounds, tolerance)
                out.append(shares / shares.sum(axis=1, keepdims=True))
            flat = np.concatenate(out).ravel() if out else np.array([])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * topics.shape[1]), pa.array(flat))

        mixed = docs.withColumn("_mix", mix(words(F.col(self.text), self.stop_words)))
        return mixed.select(*docs.columns, *[F.col("_mix")[i].alias(f"topic_{i}") for i in range(self.n_topics)])

    def dominant(self, docs: DataFrame, n_words: int = 10) -> DataFrame:
        """Adds the leading topic (the first one on ties), its words and its share."""
        mixed = self.transform(docs)
        mix = F.array(*[f"topic_{i}" for i in range(self.n_topics)])
        words = F.lit([w for _, w, _ in self.topics(n_words)])
        top = (F.array_position(mix, F.array_max(mix)) - 1).cast("int")
        return mixed.select(*docs.columns, top.alias("topic"), F.get(words, top).alias("words"), F.array_max(mix).alias("probability"))


def fit_topics(
    docs: DataFrame,
    text: str = "text",
    n_topics: int = 8,
    max_features: int = 5000,
    max_iter: int = 20,
    seed: int = 42,
    min_df: int = 2,
    max_df: float = 0.9,
    stop_words: list[str] | None = None,
    perplexity: bool = False,
    rounds: int = 100,
    tolerance: float = 1e-3,
) -> TopicModel:
    """TF-IDF and latent Dirichlet allocation by batch variational passes over all documents.

    Weights of documents are written once and read by each pass. A pass sends the topics (``n_topics`` x
    ``max_features`` numbers) to the tasks, mixes every document there, and sums the statistics per task and then per
    term; so topics do not depend on the partitioning but for the order of sums. Priors are one over the number of topics.
    """
    stops = english_stop_words() if stop_words is None else stop_words
    vocab, idf = vocabulary(docs, text, stops, max_features, min_df, max_df)
    if not vocab:
        raise ValueError("no terms to fit topics on")
    weigh, alpha = _weigher(vocab, idf), 1 / n_topics

    def weighed(batches):
        for batch in batches:
            for rows, words_, owner in _chunks(batch.column(0)):
                starts, codes, _, w = weigh(words_, owner, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(x)) for x in (codes.astype(np.int32), w)], names=["terms", "weights"])

    rows = cut_lineage(docs.select(words(F.col(text), stops).alias("_words")).mapInArrow(weighed, "terms array<int>, weights array<double>"))
    names = [f"s{i}" for i in range(n_topics)]

    def one_pass(topics: np.ndarray, score: bool):
        """Statistics of a task: a row per term that occurs, and with ``score`` one for the bound (term -1)."""

        def run(batches):
            total, bound, mass = np.zeros(topics.shape[::-1]), 0.0, 0.0
            for batch in batches:
                lists, prior = batch.column(0), math.lgamma(alpha * n_topics) - n_topics * math.lgamma(alpha)
                flat = (batch.column(i).flatten().to_numpy().astype(kind) for i, kind in ((0, np.int64), (1, np.float64)))
                for own, codes, w in _batches(_starts(lists), *flat):
                    term = _placed(topics, codes)
                    shares = _mixed(term, w, alpha, rounds, tolerance)
                    mix = expected(shares)
                    norm = _expectation(mix, term)
                    ratio = w / norm
                    for k in range(n_topics):
                        total[k] += np.bincount(codes.ravel(), (mix[:, k, None] * ratio).ravel(), len(topics))
                    if score:
                        log_gamma = np.vectorize(math.lgamma, otypes=[float])
                        bound += (w * np.log(norm)).sum() + ((alpha - shares) * np.log(mix)).sum() + log_gamma(shares).sum()
                        bound += len(own) * prior - log_gamma(shares.sum(axis=1)).sum()
                        mass += w.sum()
            total = total.T
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, k]) for k in range(n_topics))], names=["term", *names])
            if score:
                extra = [bound, mass, *[0.0] * n_topics][:n_topics] if n_topics > 1 else [bound]
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([x]) for x in extra)], names=["term", *names])

        stats = rows.mapInArrow(run, f"term int, {', '.join(f'{c} double' for c in names)}")
        # at most one row per term of the vocabulary comes back
        found = stats.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).collect()
        sums, extra = np.zeros_like(topics), [0.0] * n_topics
        for r in found:
            if r["term"] < 0:
                extra = list(r)[1:]
            else:
                sums[r["term"]] = list(r)[1:]
        return sums, extra

    components = np.random.default_rng(seed).gamma(1.0, 1.0, (n_topics, len(vocab)))  # uneven, so that topics part
    for _ in range(max_iter):
        topics = np.ascontiguousarray(expected(components).T)
        components = alpha + (topics * one_pass(topics, False)[0]).T
    model = TopicModel(vocab, idf, components, stops, text, rounds, tolerance)
    if perplexity:
        topics = np.ascontiguousarray(expected(components).T)
        _, (bound, mass, *_) = one_pass(topics, True)
        log_gamma = np.vectorize(math.lgamma, otypes=[float])
        bound += ((alpha - components) * np.log(topics.T)).sum() + (log_gamma(components) - math.lgamma(alpha)).sum()
        bound += (math.lgamma(alpha * len(vocab)) - log_gamma(components.sum(axis=1))).sum()
        model.log_perplexity = -bound / mass
    return model


def topic_mix(doc_topics: DataFrame, group: str) -> DataFrame:
    """Mean share of every topic per group."""
    cols = [c for c in doc_topics.columns if c.startswith("topic_")]
    return doc_topics.groupBy(group).agg(*[F.avg(c).alias(c) for c in cols])
