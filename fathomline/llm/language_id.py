"""Language identification by a linear-chain conditional random field over words.

Each word has features: affixes, character n-grams and membership in per-language lexicons that are
learned too. A chain of word labels has one weight per feature and language, and one per pair of
neighbouring labels. Forward-backward gives each word's chance of each language, so text that
switches languages is labelled word by word; a document's language is the one most words are expected in.

Chains run in step over many documents at once, sorted by length, so a step costs one small matrix
product for all of them. Whole texts are labelled; a chain is never cut.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import held_out

UNKNOWN = "und"
#: Labelled documents that are fitted, the first ones by a hash of their id.
SAMPLE_DOCS = 4000
#: Consecutive words of a document that are fitted, from a place given by its text.
SAMPLE_WORDS = 60
BUCKETS = 1 << 16
LEXICON_WORDS = 300
ROUNDS = 40
RIDGE = 1e-4
#: Characters of the documents that are labelled together; a longer document is labelled alone.
GROUP_CHARS = 2_000_000
MEMO_WORDS = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    found = _WORD.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def word_features(word: str, lexicons: dict[str, list[int]]) -> list[int]:
    """Buckets of a word's affixes and n-grams; the lexicons it is in have buckets of their own."""
    raw = f"^{word}$"
    grams = [raw[k : k + 2] for k in range(len(raw) - 1)] + [raw[k : k + 3] for k in range(len(raw) - 2)]
    affixes = [f"<{word[:n]}" for n in (3, 4) if len(word) >= n] + [f">{word[-n:]}" for n in (3, 4) if len(word) >= n]
    crc = zlib.crc32
    return [crc(g.encode()) & (BUCKETS - 1) for g in (*grams, *affixes)] + lexicons.get(word, [])


@dataclass
class Chain:
    languages: list[str]
    weights: np.ndarray  # (buckets + languages) x languages
    moves: np.ndarray  # languages x languages
    lexicons: dict[str, list[int]]

    def emissions(self, found: list[str]) -> np.ndarray:
        return _emissions(self.weights, *_packed(found, self.lexicons))


def _packed(found: list[str], lexicons: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lists = [word_features(w, lexicons) for w in found]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((f for own in lists for f in own), np.int64, int(sizes.sum()))
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def _emissions(weights: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[flat], ends[:-1], axis=0) if len(ends) > 1 else np.zeros((0, weights.shape[1]))


def forward_backward(score: np.ndarray, ids: np.ndarray, lengths: np.ndarray, moves: np.ndarray):
    """Chances of each label by word and summed chances of each move, for chains laid end to end.

    ``score`` has emissions by word type, ``ids`` the type of each word; chains are longest first.
    """
    n_labels = score.shape[1]
    local = np.exp(score - score.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    width = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(width), side="left")
    forward = np.empty((len(ids), n_labels))
    now = local[ids[starts]]
    now /= now.sum(axis=1, keepdims=True)
    forward[starts] = now
    for t in range(1, width):
        at = starts[: active[t]] + t
        now = (now[: active[t]] @ step) * local[ids[at]]
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    pairs = np.zeros((n_labels, n_labels))
    back = np.ones((len(lengths), n_labels))
    for t in range(width - 1, 0, -1):
        n = active[t]
        at = starts[:n] + t
        ahead = local[ids[at]] * back[:n]
        before = forward[at - 1]
        mass = (before * (ahead @ step.T)).sum(axis=1, keepdims=True)
        pairs += step * ((before / mass).T @ ahead)
        forward[at] *= back[:n]
        behind = ahead @ step.T
        back[:n] = behind / behind.sum(axis=1, keepdims=True)
    forward[starts] *= back
    return forward / forward.sum(axis=1, keepdims=True), pairs


def fit(samples: list[tuple[str, list[str]]]) -> Chain | None:
    """Adam on the conditional log-likelihood of (language, words) samples; None without samples."""
    samples = sorted((s for s in samples if s[1]), key=lambda s: (-len(s[1]), s))
    languages = sorted({s[0] for s in samples})
    if not languages:
        return None
    label = {x: k for k, x in enumerate(languages)}
    counts: dict[str, Counter] = {x: Counter() for x in languages}
    for language, own in samples:
        counts[language].update(own)
    total = sum(counts.values(), Counter())
    lexicons: dict[str, list[int]] = {}
    for k, language in enumerate(languages):
        typical = [w for w, n in counts[language].most_common() if n >= 3 and n >= 0.8 * total[w]]
        for w in typical[:LEXICON_WORDS]:
            lexicons.setdefault(w, []).append(BUCKETS + k)
    types = {w: k for k, w in enumerate(sorted(total))}
    flat, ends = _packed(list(types), lexicons)
    owner = np.repeat(np.arange(len(types)), np.diff(ends))
    ids = np.array([types[w] for _, own in samples for w in own])
    lengths = np.array([len(own) for _, own in samples])
    gold = np.repeat([label[x] for x, _ in samples], lengths)
    n_labels, n = len(languages), len(ids)
    weights, moves = np.zeros((BUCKETS + n_labels, n_labels)), np.zeros((n_labels, n_labels))
    gold_moves = np.diag(np.bincount([label[x] for x, _ in samples], lengths - 1, n_labels))
    gold_types = np.bincount(ids * n_labels + gold, minlength=len(types) * n_labels).reshape(-1, n_labels)
    slopes = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for r in range(1, ROUNDS + 1):
        chance, pairs = forward_backward(_emissions(weights, flat, ends), ids, lengths, moves)
        by_type = gold_types - np.stack([np.bincount(ids, chance[:, k], len(types)) for k in range(n_labels)], 1)
        up = np.stack([np.bincount(flat, by_type[owner, k], len(weights)) for k in range(n_labels)], 1) / n - RIDGE * weights
        for x, g, m, v in ((weights, up, slopes[0], slopes[1]), (moves, (gold_moves - pairs) / n - RIDGE * 10 * moves, slopes[2], slopes[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    return Chain(languages, weights, moves, lexicons)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Chain | None:
    """Learns from text and lang of documents that are not held out: at most ``sample_docs`` rows.

    Ids are chosen first, by a hash. Where they have more rows than that, rows of an id with equal words and
    language count once and the first by a hash are taken, so no id can fill the driver.
    """
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def run(batches):
        for batch in batches:
            language, kept = [], []
            for x, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words(text.as_py())
                at = zlib.crc32(str(len(own)).encode()) % max(1, len(own) - sample_words + 1)
                language.append(x), kept.append(own[at : at + sample_words])
            columns = [pa.array(language, pa.string()), pa.array(kept, pa.list_(pa.string())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "id"])

    rows = usable.join(F.broadcast(chosen), "doc_id").select("lang", "text", F.col("doc_id").cast("string").alias("id"))
    found = rows.mapInArrow(run, "lang string, words array<string>, id string").distinct().orderBy(F.xxhash64("id", "lang", "words"), "id").limit(sample_docs)
    return fit([(r["lang"], r["words"]) for r in found.select("lang", "words").toArrow().to_pylist()])


class Labeller:
    """Labels texts with a chain; keeps the emissions of a bounded number of words."""

    def __init__(self, chain: Chain):
        self.chain, self.known, self.score = chain, {}, np.zeros((0, len(chain.languages)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k] or ""))
        at = 0
        while at < len(order):
            group, chars = [], 0
            while at < len(order) and (not group or chars + len(texts[order[at]] or "") <= GROUP_CHARS):
                group.append(order[at])
                chars += len(texts[order[at]] or "")
                at += 1
            self._group(texts, group, out)
        return out

    def _group(self, texts, group, out) -> None:
        if len(self.known) > MEMO_WORDS:
            self.known, self.score = {}, self.score[:0]
        found = [(k, words(texts[k] or "")) for k in group]
        found = sorted(((k, own) for k, own in found if own), key=lambda x: -len(x[1]))
        if not found:
            return
        known, new = self.known, []
        for _, own in found:
            for w in own:
                if w not in known:
                    known[w] = len(known)
                    new.append(w)
        ids = np.fromiter((k for _, own in found for k in map(known.__getitem__, own)), np.int64)
        if new:
            self.score = np.concatenate([self.score, self.chain.emissions(new)])
        lengths = np.array([len(own) for _, own in found])
        chance, _ = forward_backward(self.score, ids, lengths, self.chain.moves)
        share = np.add.reduceat(chance, np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0) / lengths[:, None]
        best = share.argmax(axis=1)
        for (k, _), b, s in zip(found, best, share):
            out[k] = (self.chain.languages[b], min(1.0, float(s[b])))


    def spans(self, text: str | None) -> list[dict]:
        """Runs of words that are likeliest in one language: place and length in characters, language, mean chance."""
        hits = [m for m in _WORD.finditer(text or "") if any(map(str.isalpha, m.group()))]
        if not hits:
            return []
        own = [m.group().lower() for m in hits]
        types = {w: k for k, w in enumerate(dict.fromkeys(own))}
        ids = np.array([types[w] for w in own])
        chance, _ = forward_backward(self.chain.emissions(list(types)), ids, np.array([len(own)]), self.chain.moves)
        best = chance.argmax(axis=1)
        edges = [0, *(np.flatnonzero(np.diff(best)) + 1), len(best)]
        return [
            {
                "start": hits[a].start(), "length": hits[b - 1].end() - hits[a].start(),
                "lang": self.chain.languages[best[a]], "chance": min(1.0, float(chance[a:b, best[a]].mean())),
            }
            for a, b in zip(edges, edges[1:])
        ]


SPANS = "array<struct<start:long,length:long,lang:string,chance:double>>"


def label_spans(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``: where a whole text is in which language.

    Each word has the language that forward-backward finds likeliest, the first by name in a tie; neighbours
    with one language are one span, counted in characters from 0. Null texts, texts without letters and all
    texts where nothing could be learned have no spans. Repeated rows are all returned, and columns other than
    doc_id and text are not read.
    """

    def run(batches):
        label = Labeller(chain).spans if chain else lambda text: []
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string()), ("chance", pa.float64())]))
        for batch in batches:
            found = pa.array([label(text.as_py()) for text in batch.column(1)], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, spans {SPANS}")


def predict(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        label = Labeller(chain) if chain else lambda texts: [(UNKNOWN, 0.0)] * len(texts)
        for batch in batches:
            found = label(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang).

    ``lang`` is only read for training, from rows that are not held out. The score is the expected
    share of words in the predicted language; ties go to the first language by name. Null texts
    and texts without letters are ``und`` with score 0, as all are when nothing can be learned. Repeated
    rows are all returned.
    """
    return predict(docs, train(docs, sample_docs, sample_words)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
