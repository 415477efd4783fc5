"""Best-fit packing by sum of squares.

Documents become token pieces in one pass over the texts. Pieces that fill a sequence stand
alone. The others are dealt evenly over shards of a bounded number of pieces, and each shard
packs its own: a piece goes where the squared counts of open sequences per residual gap become
smallest. Only lengths and checksums travel; a shard loses a few open sequences at most.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs.
SHARD_PIECES = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Texts of these characters only are cut into pre-tokens here; within them the classes below are
# exactly the tokenizer's letters, digits and white space. All other texts go to it whole.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PRE = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^ \t-\rA-Za-zÀ-ÖØ-öø-ÿ0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)
#: Pre-tokens that a task remembers: the first ones seen, among which are the frequent ones.
MEMO_ENTRIES = 250_000


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, with a bounded memo of pre-tokens.

    The tokenizer file is the authority. A pre-token of a plain text is merged by the same ranks
    in a faster library, which gives the same ids.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in w): k for w, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if w not in self.special}
        self.merge = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece)).tobytes()
        if len(self.pieces) < MEMO_ENTRIES and len(piece) < 64:
            self.pieces[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        known, merged = self.pieces.get, self._piece
        return b"".join([known(p) or merged(p) for p in _PRE.findall(text)])

    def encode(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self._plain(text)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document; a null text counts as empty and keeps its end id.

    ``with_ids`` adds the ids themselves as little-endian 32-bit bytes.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            doc, part, start, length, crc, ids = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encoder.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cuts(len(raw) // 4, capacity)):
                    own = raw[4 * s : 4 * (s + n)]
                    doc.append(d), part.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(own)
            columns = [pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) by piece, placing pieces in the given order.

    ``count[g]`` sequences are open with a gap of g. Placing a piece of s tokens into gap g changes
    the sum of squares by 2 (count[g-s] - count[g] + 1); closing a sequence, by 1 - 2 count[s].
    The least change wins, ties go to the smallest gap; a sequence is opened where none has room.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = 0
    for k, s in enumerate(lengths.tolist()):
        here = count[s:capacity]
        change = 2 * (count[: capacity - s] - here + 1)
        if len(change):
            change[0] = 1 - 2 * here[0]
            change[here == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
        if len(change) and here[best]:
            gap = best + s
            bin_ = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_ = capacity, n
            n += 1
        sequence[k], offset[k] = bin_, capacity - gap
        left = gap - s
        if left:
            count[left] += 1
            open_at[left].append(bin_)
    return sequence, offset


def place(parts: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32).

    Pieces of a shard are placed longest first. An empty table gives an empty table.
    """
    known = cut(parts.withColumn("__row", F.monotonically_increasing_id()))
    short = known.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard_pieces))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "__row"], ascending=[False, True], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows = rows.assign(sequence_id=(sequence * shards + key[0]) * 2 + 1, offset=offset)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    full = known.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("__row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    dealt = short.withColumn("__shard", F.pmod(F.xxhash64("__row"), F.lit(shards)))
    packed = dealt.groupBy("__shard").applyInPandas(run, PIECES + ", sequence_id long, offset long")
    return full.unionByName(packed)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Packs every document (doc_id, text) into sequences of at most ``capacity`` tokens.

    Null and empty texts hold one end id. Repeated rows are packed each. Documents with a null id
    are packed under it. Other columns are not read. Sequence ids are unique, not dense.
    """
    return place(pieces(docs, tokenizer, capacity), capacity, shard_pieces)
