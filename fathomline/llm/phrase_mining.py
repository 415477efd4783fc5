"""Phrase collocation mining by top-order marginalisation.

Every word opens one window: its lead columns hold the next words of its piece, padded where the
piece ends. Only these longest windows are counted. The count of a shorter phrase is the sum over the
windows that it begins, so one ROLLUP over the counted windows gives the counts of all lengths, without
another explosion of the text.

Words travel as 64-bit hashes, which a first pass over the words of all documents proves to be different
for different words (else it takes another seed). A word rarer than any phrase ends a piece, as far as a bitmap
of fixed size tells. A task counts its windows over word numbers and hands on each distinct window once. Windows meet by
their beginning, sorted. There, windows too rare to be phrases themselves matter to their prefixes only
and are merged before the roll-up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .shared import attach, stored

LONGEST = 3
LEAST = 10
TOP = 2000
#: A shorter phrase goes when a longer candidate holds it in so many of 100 of its occurrences.
COVERED = 50
UNKNOWN = "und"

#: A task hands on what it has counted after so many bytes of text; a longer text is cut at ends of pieces.
FLUSH_BYTES = 24 << 20
#: Rows of an Arrow batch that is handed on.
BATCH = 1 << 16
#: Bits that tell frequent words, whatever the size of the corpus: 8 MB.
BITS = 1 << 26
#: Hash seeds to try; a second one is needed where two words of the corpus have one hash.
SEEDS = 8
#: Ranking deals each language out to so many groups first; each hands on its own top rows only.
_DEALS = 64

_BREAK = b"\n"
#: A-Z to a-z, ends of pieces to a newline, tabs to spaces; other bytes of UTF-8 stay.
_MAP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + 9 * b"\n" + b" ")
#: Numbers of no word and of the end of a piece; the hash that stands for padding.
_PAD, _END, _NO_WORD = 0, 1, 0


def _hash(word: str, lang: str, seed: int) -> int:
    """A signed 64-bit hash of a word of a language."""
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang, seed)) - (1 << 63)


def _parts(data: bytes):
    """A mapped text in parts of about ``FLUSH_BYTES`` that end where pieces end."""
    at = 0
    while at < len(data):
        end = data.find(_BREAK, at + FLUSH_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end + 1


def _coded(parts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Words by number, and the texts as numbers with ``_END`` after each piece. Numbers 0 and 1 stand for no word."""
    data = _BREAK.join(parts).replace(_BREAK, b" \n ") + b" \n"
    tokens = pc.split_pattern(pa.array([data], pa.binary()).cast(pa.string()), " ").flatten().dictionary_encode()
    words = tokens.dictionary.to_pylist()
    number = np.arange(2, len(words) + 2)
    for k, word in enumerate(words):
        if word in ("", "\n"):
            number[k] = _END if word else _PAD
    codes = number[tokens.indices.to_numpy()]
    return ["", "\n", *words], codes[codes != _PAD]


def _by_language(docs: DataFrame, count, schema: str) -> DataFrame:
    """Arrow batches that ``count(lang, words, codes)`` makes of all texts of a language in one stretch of a task."""

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                columns = count(lang, *_coded(parts))
                for k in range(0, len(columns[0][1]), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + BATCH], kind) for kind, c in columns], names=names)
            held.clear()

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for k, lang in enumerate(batch.column(0).to_pylist()):
                for part in _parts(texts[k].as_py().translate(_MAP)):
                    held.setdefault(lang, []).append(part)
                    size += len(part) + 1
                    if size >= FLUSH_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, schema)


def word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, h, n) of all words, and the seed for which no two words have one hash."""
    for seed in range(SEEDS):

        def count(lang, words, codes):
            n = np.bincount(codes, minlength=len(words))
            some = [k for k in np.flatnonzero(n).tolist() if k > _END]
            words = [words[k] for k in some]
            return [(pa.string(), [lang] * len(words)), (pa.string(), words), (pa.int64(), [_hash(w, lang, seed) for w in words]), (pa.int64(), n[some])]

        rows = _by_language(docs, count, "lang string, word string, h long, n long")
        found = stored(rows.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")))
        if found.groupBy("h").agg(F.count("*").alias("words")).where(f"words > 1 or h = {_NO_WORD}").isEmpty():
            return found, seed
    raise ValueError(f"two words have one hash with each of {SEEDS} seeds")


def _frequent_bits(words: DataFrame, least: int) -> np.ndarray:
    """A bitmap of ``BITS`` bits; the bit of each word of ``least`` occurrences or more is set."""
    place = F.pmod("h", F.lit(BITS)) + 1
    own = words.where(F.col("n") >= least).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in own.collect():  # 4 KB each, BITS / 32768 rows at most
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _windows(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Lead columns: each word with the words after it in its piece, padded."""
    own = np.flatnonzero(codes != _END)
    columns, open_ = [codes[own]], np.ones(len(own), bool)
    for k in range(1, longest):
        then = codes[np.minimum(own + k, len(codes) - 1)]  # the last code is an end
        open_ = open_ & (then != _END)
        columns.append(np.where(open_, then, _PAD))
    return columns


def _distinct(columns: list[np.ndarray], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct windows in order, and how often each occurs."""
    if words ** len(columns) < 1 << 63:
        key = columns[0]
        for column in columns[1:]:
            key = key * words + column
        key, n = np.unique(key, return_counts=True)
        back = []
        for _ in columns:
            key, part = np.divmod(key, words)
            back.append(part)
        return back[::-1], n
    rows, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    return list(rows.T), n


def _names(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def counted_windows(docs: DataFrame, seed: int, bits: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(w1 ... wN, n): distinct padded windows of word hashes of a task's share of ``docs``, each with its count there."""

    def count(lang, words, codes):
        hashes = np.array([_NO_WORD, _NO_WORD, *(_hash(w, lang, seed) for w in words[2:])], np.int64)
        place = np.mod(hashes, BITS)
        renamed = np.where(bits[place >> 3] >> (place & 7) & 1, np.arange(len(words)), _END)
        columns, n = _distinct(_windows(renamed[codes], longest), len(words))
        return [*((pa.int64(), hashes[c]) for c in columns), (pa.int64(), n)]

    return _by_language(docs, count, ", ".join(f"{c} long" for c in (*_names(longest), "n")))


def merged_windows(counted: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(w1 ... wN, n) that rolls up to the same counts of ``least`` or more, with far fewer rows.

    Windows of ``least`` occurrences or more stay. The others are merged by their beginning without the last
    word, or where that is rare too, by the one without the last two.
    """
    names = _names(longest)
    short = max(1, longest - 2)  # words of the beginning that stays in any case

    def starts_of(columns: list[np.ndarray]) -> np.ndarray:
        """Rows whose key is not that of the row before."""
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return new

    def run(batches):
        # of the window that ends a batch: its row; of its beginning: all occurrences so far, and those not handed on
        row, total, rest = None, 0, 0

        def handed(keys: list[np.ndarray], n: np.ndarray):
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, n)], names=[*names, "n"])

        def remainders(keys: list[np.ndarray], all_: np.ndarray, left: np.ndarray):
            """Rows for the beginnings of complete groups; neighbours that share a shortened one are summed."""
            some = np.flatnonzero(left > 0)
            if len(some):
                own = [c[some] if k < short else np.where(all_[some] >= least, c[some], _NO_WORD) for k, c in enumerate(keys)]
                at = np.flatnonzero(starts_of(own))
                yield from handed([*(c[at] for c in own), np.full(len(at), _NO_WORD)], np.add.reduceat(left[some], at))

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [c.to_numpy() for c in batch.columns]
            if row is not None:
                own = [np.concatenate([a, b]) for a, b in zip(row, own)]
            keys, n = own[:-1], own[-1]
            group = starts_of(keys[:-1])
            at = np.flatnonzero(group | starts_of(keys[-1:]))
            sums, groups = np.add.reduceat(n, at), np.cumsum(group)[at] - 1
            row = [*(c[at[-1:]] for c in keys), sums[-1:]]
            open_, at, sums, groups = groups[-1], at[:-1], sums[:-1], groups[:-1]
            kept = (sums >= least) & (keys[-1][at] != _NO_WORD)
            yield from handed([c[at[kept]] for c in keys], sums[kept])
            all_ = np.bincount(groups, sums, open_ + 1).astype(np.int64)
            left = np.bincount(groups, np.where(kept, 0, sums), open_ + 1).astype(np.int64)
            all_[0], left[0] = all_[0] + total, left[0] + rest
            total, rest = int(all_[-1]), int(left[-1])
            firsts = np.flatnonzero(group)[:-1]
            yield from remainders([c[firsts] for c in keys[:-1]], all_[:-1], left[:-1])
        if row is not None:
            own, n = row[:-1], row[-1]
            whole = n[0] >= least and own[-1][0] != _NO_WORD
            if whole:
                yield from handed(own, n)
            yield from remainders(own[:-1], n + total, np.array([rest]) if whole else n + rest)

    dealt = counted.repartition(*names[:-1]).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, counted.schema)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f): every phrase of up to ``longest`` words with ``least`` occurrences or more.

    ``words`` 0 is the count of all word occurrences of a language, whatever it is.
    """
    names = _names(longest)
    words, seed = word_counts(docs)
    merged = merged_windows(counted_windows(docs, seed, _frequent_bits(words, least), longest), longest, least)
    summed = merged.rollup(*names).agg(F.sum("n").alias("f")).where(F.col(names[0]).isNotNull() & (F.col("f") >= least))
    whole = F.filter(F.array(*names), lambda w: w.isNotNull())
    found = stored(summed.select(whole.alias("hashes"), "f").where(~F.array_contains("hashes", _NO_WORD)))  # no phrase ends in padding
    # hashes to words; a word is in f / least frequent windows at most, so n tells which words are hot
    each = found.select("hashes", "f", F.posexplode("hashes").alias("at", "h"))
    told = attach(each, words.where(F.col("n") >= least).select("h", "lang", "word", "n"), "h", "n")
    phrases = told.groupBy("hashes").agg(
        F.max("lang").alias("lang"), F.count("*").cast("int").alias("words"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"), F.max("f").alias("f")
    )
    totals = words.groupBy("lang").agg(F.lit(0).alias("words"), F.lit("").alias("phrase"), F.sum("n").alias("f"))
    return phrases.select("lang", "words", F.array_join("w.word", " ").alias("phrase"), "f").union(totals)


def collocations(
    docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED
) -> DataFrame:
    """The ``top`` phrases of each language by the tie between their parts: (lang, rank, phrase, a, l, r, n, score).

    ``docs`` needs ``text`` and ``lang``; other columns are not read, whatever their names. A null
    text is empty, a null language is ``und``, and repeated rows count as often as they occur. Texts
    are lower-cased in A-Z and cut at ``. , ; : ! ?`` and line ends into pieces, pieces at spaces and
    tabs into words. Candidates have two to ``longest`` words and ``least`` occurrences. The score of
    a cut is floor(10^6 a^2 / (l r)); the lowest cut counts, and of equal ones the first. A candidate
    goes when a longer candidate holds it and has ``covered`` of 100 of its occurrences. Equal scores
    are ranked by a, then by the bytes of the phrase. A corpus without candidates gives no rows.
    """
    counts = stored(phrase_counts(docs, longest, least))
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.where("words > 0").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))
    candidates = phrases.where("words > 1")

    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.struct("lang", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("phrase")).alias("left"),
        F.struct("lang", F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w"))).alias("phrase")).alias("right"),
    )
    # a part with f occurrences is in f / least candidates at most, so f tells which parts are hot
    for side, name in (("left", "l"), ("right", "r")):
        facts = phrases.select(F.struct("lang", "phrase").alias(side), F.col("a").alias(name), F.col("a").alias("copies"))
        cuts = attach(cuts, facts, side, "copies")
    wide = "decimal(19,0)"
    score = F.expr(f"(1000000 * cast(a as {wide}) * cast(a as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"), F.lit(None).cast("long").alias("longer"))

    spans = [(start, size) for size in range(2, longest) for start in range(1, longest - size + 2)]
    inner = F.array(*(F.when(start + size - 1 <= F.col("words"), F.concat_ws(" ", F.slice("w", start, size))) for start, size in spans)) if spans else F.array().cast("array<string>")
    holders = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"), "words")
    holders = holders.where("phrase is not null and size(split(phrase, ' ', -1)) < words").drop("words")
    both = scored.unionByName(holders, allowMissingColumns=True)
    met = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    kept = met.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = kept.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(_DEALS)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return last.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
