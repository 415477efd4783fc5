"""URL filters: a bit-parallel automaton that runs all wildcard rules over each URL at once.

A glob is packed into Shift-And masks: one bit per literal, and a self-loop on the bit before a
wildcard. All globs lie side by side in as many 64-bit words as they need; a step over one byte is

    state = (state << 1) & literal[byte]  |  state & loop[byte]

for a whole batch of URLs, so the cost of a URL is its length times the words, not the rules. Site rules
see the host and path as they are written; the method's own globs see them in canonical form.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import ascii_lower

WORD = 64
#: Bytes of URLs held as one matrix at a time.
MATRIX_BYTES = 4 << 20
#: Bytes of automaton states of the URLs in hand.
STATE_BYTES = 16 << 20
#: Rules that a rule table may hold; every task keeps all masks, 256 x 2 bits a literal.
MAX_RULES = 20_000


@dataclass(frozen=True)
class Glob:
    """``*`` stands for any bytes but ``/``, ``**`` for any bytes, ``?`` for one byte but ``/``, ``[.-]`` for one of
    the bytes between the brackets.

    The text that a glob must cover is ``.`` + host + path. ``name`` is reported; a glob without one decides only.
    """

    pattern: str
    verdict: str
    name: str | None = None


def site_rule(verdict: str, host: str, path: str) -> Glob:
    """Fits the host and all its subdomains where the URL's path starts with ``path``; no byte of either is a wildcard."""
    return Glob(f"*.{re.sub(r'([*?[])', r'[\1]', host + path)}**", verdict, host + path)


def rule_table(rules: DataFrame) -> list[Glob]:
    """The globs of a table (verdict, host, path), or (verdict, pattern[, name]) for wildcard rules.

    Null hosts and paths are empty, rows without a verdict or with nothing to match are left out, repeated rows count
    once. The rules go to every task, so a table of over ``MAX_RULES`` rows is refused.
    """
    if "pattern" in rules.columns:
        name = F.col("name").cast("string") if "name" in rules.columns else F.lit(None).cast("string")
        columns = [F.col("pattern").cast("string").alias("pattern"), "verdict", name.alias("name")]
        wanted = rules.select(*columns).where("verdict is not null and pattern <> ''")
    else:
        columns = ["verdict", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path"))]
        wanted = rules.select(*columns).where("verdict is not null and host || path <> ''")
    rows = wanted.distinct().limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    made = (Glob(r["pattern"], r["verdict"], r["name"]) if "pattern" in rules.columns else site_rule(*r) for r in rows)
    return sorted(made, key=lambda g: (g.pattern, g.verdict, g.name or ""))


# Words that mark a host of the method's own block list. Anywhere in the host, at the end of one of the
# words that dots and hyphens part, or as a whole such word.
BLOCKED_ANYWHERE = ("porn", "hentai")
BLOCKED_ENDINGS = ("casino", "casinos", "warez", "escorts")
BLOCKED_WORDS = (
    "adult", "bet", "betting", "cialis", "erotic", "escort", "gambling", "jackpot", "keygen", "nude", "nudes", "payday",
    "poker", "roulette", "sex", "sexcam", "slots", "sportsbook", "viagra", "xxx",
)
#: Hosts of these top-level domains are never blocked by a word.
TRUSTED = ("edu", "gov", "int", "mil")

#: The method's own verdicts, for URLs that no named rule fits; the first that fits the canonical form counts.
DEFAULT_GLOBS = (
    *(Glob(f"*.{t}/**", "allow") for t in TRUSTED),
    *(Glob(f"*{w}*/**", "block") for w in BLOCKED_ANYWHERE),
    *(Glob(f"*{w}[-./]**", "block") for w in BLOCKED_ENDINGS),
    *(Glob(f"*[-.]{w}[-./]**", "block") for w in BLOCKED_WORDS),
)


@dataclass
class Automaton:
    literal: np.ndarray  # 256 x words
    loop: np.ndarray
    start: np.ndarray
    final: list[tuple[int, int]]  # word and bit, by glob

    @classmethod
    def of(cls, globs: list[Glob]) -> Automaton:
        literal: list[tuple[int, list[int]]] = []
        loops: list[tuple[int, bool]] = []
        starts, finals, bit = [], [], 0
        but_slash = [x for x in range(256) if x != ord("/")]
        for glob in globs:
            starts.append(bit)
            raw, k = glob.pattern.encode(), 0
            while k < len(raw):
                if raw[k] == ord("*"):
                    double = raw[k : k + 2] == b"**"
                    loops.append((bit, double))
                    k += 1 + double
                    continue
                bit += 1
                close = raw.find(b"]", k + 2) if raw[k] == ord("[") else -1  # a bracket may be the first in brackets
                if close > 0:
                    literal.append((bit, list(raw[k + 1 : close])))
                    k = close + 1
                else:
                    literal.append((bit, but_slash if raw[k] == ord("?") else [raw[k]]))
                    k += 1
            finals.append((bit // WORD, bit % WORD))
            bit += 1
        words = bit // WORD + 1
        masks = cls(np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), finals)
        one = lambda b: np.uint64(1 << (b % WORD))
        for b, fits in literal:
            masks.literal[sorted(set(fits)), b // WORD] |= one(b)
        for b, double in loops:
            masks.loop[list(range(256)) if double else but_slash, b // WORD] |= one(b)
        for b in starts:
            masks.start[b // WORD] |= one(b)
        return masks

    def run(self, texts: list[bytes]) -> np.ndarray:
        """One row per text, one column per glob: does the glob cover the whole text?"""
        out = np.zeros((len(texts), len(self.final)), bool)
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            width = max(1, int(lengths[order[at]]))
            rows = order[at : at + max(1, min(MATRIX_BYTES // width, STATE_BYTES // self.start.nbytes))]
            at += len(rows)
            matrix = np.zeros((len(rows), width), np.uint8)
            for k, r in enumerate(rows):
                matrix[k, : lengths[r]] = np.frombuffer(texts[r], np.uint8)
            state = np.repeat(self.start[None], len(rows), 0)
            ends = np.searchsorted(-lengths[rows], -np.arange(width), side="left")  # rows longer than the step
            for step in range(width):
                n = ends[step]
                now, byte = state[:n], matrix[:n, step]
                shifted = now << np.uint64(1)
                shifted[:, 1:] |= now[:, :-1] >> np.uint64(WORD - 1)
                state[:n] = shifted & self.literal[byte] | now & self.loop[byte]
            for g, (word, bit) in enumerate(self.final):
                out[rows, g] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1
        return out


def parts(url):
    """(host, path) of a URL column: host lower-cased in A-Z, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def canonical(host: bytes, path: bytes) -> tuple[bytes, bytes]:
    """One spelling of a URL's host and path: percent codes read, no login, port, last dot, empty or dot segments.

    Slashes that were percent codes stay codes, so that they part no segments. A path starts with ``/``.
    """
    code = lambda m: b"%2f" if (b := bytes([int(m[1], 16)])) == b"/" else b
    if b"%" in host:
        host = re.sub(rb"%([0-9A-Fa-f]{2})", code, host).lower()
    if b"%" in path:
        path = re.sub(rb"%([0-9A-Fa-f]{2})", code, path)
    host = re.sub(rb":[0-9]*$", b"", host.rpartition(b"@")[2]).rstrip(b".")
    if b"//" not in path and b"/." not in path:
        return host, path or b"/"
    kept: list[bytes] = []
    *inner, last = path.split(b"/")
    for part in (*inner, last):
        if part == b"..":
            del kept[-1:]
        elif part not in (b"", b"."):
            kept.append(part)
    end = b"/" if kept and last in (b"", b".", b"..") else b""
    return host, b"/" + b"/".join(kept) + end


def judge(pages: DataFrame, rules: Sequence[Glob] | DataFrame, defaults: Sequence[Glob] = DEFAULT_GLOBS, otherwise: str = "allow",
          key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` are globs or a table of them (see ``rule_table``). The longest fitting rule decides (ties: the first in
    text order); without one, the first default that fits the canonical form, else ``otherwise``. A null URL or one
    without ``://`` has an empty host and path, which no rule fits. Very long URLs are read whole, repeated rows are
    judged each, no rows give no rows, and other columns of ``pages`` are not read.
    """
    given = rule_table(rules) if isinstance(rules, DataFrame) else list(rules)
    ranked = sorted(given, key=lambda g: (-len(g.name or g.pattern), g.name or g.pattern))

    def first(automaton, texts, n):
        """Number of the first glob that covers each text; ``n``, the number of globs, where none does."""
        if not n or not texts:
            return np.full(len(texts), n)
        fits = automaton.run(texts)
        return np.where(fits.any(axis=1), fits.argmax(axis=1), n)

    def run(batches):
        named, own = Automaton.of(ranked), Automaton.of(list(defaults))
        names = np.array([g.name for g in ranked] + [None], dtype=object)
        verdicts = np.array([g.verdict for g in ranked] + [None], dtype=object)
        own_verdicts = np.array([g.verdict for g in defaults] + [otherwise], dtype=object)
        for batch in batches:
            sites = [(h.encode(), p.encode()) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rule = first(named, [b"." + h + p for h, p in sites], len(ranked))
            verdict, rest = verdicts[rule], np.flatnonzero(rule == len(ranked))
            plain = [b"." + b"".join(canonical(*sites[k])) for k in rest]
            verdict[rest] = own_verdicts[first(own, plain, len(defaults))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(names[rule], pa.string()), pa.array(verdict, pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    host, path = parts(F.col(url))
    kind = dict(pages.dtypes)[key]
    return pages.select(key, host.alias("host"), path.alias("path")).mapInArrow(
        run, f"`{key}` {kind}, host string, path string, rule string, verdict string"
    )
