"""Named sections of a document, found by header patterns, as arrays of (section, text)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as tx
from .. import fixed_values as fv
from .binding import let

SECTION_ARRAY = "array<struct<section:string,text:string>>"
# Unicode-aware classes and case folding, and a dot that stops at \n only, as Python has them.
_IGNORE_CASE = "(?iuUd)"
_EXACT_CASE = "(?Ud)"
_MARK, _NO_MARK = "\x01", "\x02"


def no_sections() -> Column:
    return F.array().cast(SECTION_ARRAY)


def last_match_start(text: Column, pattern: str) -> Column:
    """0-based start of the last non-overlapping match, or null if there is none.

    Text without a match is walked once. Else a second walk sets a mark before each match, and the length of
    what stands behind the last mark gives the place. Marks of the text itself are replaced first.
    """
    plain = F.when(F.instr(text, _MARK) > 0, F.translate(text, _MARK, _NO_MARK)).otherwise(text)
    marked = F.regexp_replace(plain, F.lit(pattern), F.lit(_MARK + "$0"))
    behind = F.length(F.substring_index(marked, _MARK, -1))
    return F.when(F.rlike(text, F.lit(pattern)), F.length(text) - behind)


def header_positions(text: Column, catalog: list, case_sensitive: bool = False) -> Column:
    """Sorted array of (pos, ord, section): the last hit of the first alternative that hits at all.

    An alternative is looked for only where those before it do not hit.
    """
    flags = _EXACT_CASE if case_sensitive else _IGNORE_CASE
    hits = [
        F.struct(
            F.coalesce(*[last_match_start(text, flags + p) for p in patterns]).alias("pos"),
            F.lit(i).alias("ord"),
            F.lit(key).alias("section"),
        )
        for i, (key, patterns) in enumerate(catalog)
    ]
    return F.array_sort(F.filter(F.array(*hits), lambda h: h["pos"].isNotNull()))


def slice_sections(
    text: Column, positions: Column, max_chars: int | None = None, min_chars: int = 200
) -> Column:
    """Text from each header to the next; the last section runs to the end, or to ``max_chars`` where that is given."""

    def cut(hits: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            last = F.length(text) if max_chars is None else hit["pos"] + max_chars
            end = F.coalesce(F.get(hits, i + 1)["pos"], last)
            body = tx.strip(F.substring(text, hit["pos"] + 1, end - hit["pos"]))
            return F.struct(hit["section"].alias("section"), body.alias("text"))

        return F.filter(F.transform(hits, one), lambda s: F.length(s["text"]) > min_chars)

    return let(positions, cut).cast(SECTION_ARRAY)


def keep_last_per_key(found: Column) -> Column:
    """A later section replaces an earlier one of the same name (custom catalogs may repeat names)."""
    return let(
        found,
        lambda all_found: F.filter(
            all_found,
            lambda s, i: ~F.exists(
                F.slice(all_found, i + 2, F.size(all_found)),
                lambda later: later["section"] == s["section"],
            ),
        ),
    )


def has_repeated_keys(catalog: list) -> bool:
    keys = [key for key, _ in catalog]
    return len(set(keys)) < len(keys)


def _head(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


def split_sections(
    html: Column,
    clean: Column,
    boundary_tag: str = "hr",
    max_parts: int | None = None,
    min_part_chars: int = 300,
    min_chars: int = 200,
    max_chars: int | None = None,
    keep_tail: bool = True,
) -> Column:
    """Numbered parts between rule tags, or between dash lines where there are under two rules.

    What follows the last rule is a part too, or is left out without ``keep_tail``. Numbers keep their gaps.
    """
    rule = rf"(?i)<{boundary_tag}\b[^>]*>"

    def ruled(pieces: Column) -> Column:
        chosen = pieces if keep_tail else F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.filter(
            F.transform(chosen, lambda p: tx.strip(tx.node_text(p))),
            lambda p: F.length(p) > min_part_chars,
        )

    dashed = F.transform(F.split(clean, "-{10,}", -1), tx.strip)
    parts = let(F.split(html, rule, -1), lambda p: F.when(F.size(p) >= 3, ruled(p)).otherwise(dashed))
    if max_parts is not None:
        parts = F.slice(parts, 1, max_parts)
    numbered = F.transform(
        parts,
        lambda p, i: F.struct(
            F.concat(F.lit("section_"), (i + 1).cast("string")).alias("section"),
            F.when(F.length(p) > min_chars, _head(p, max_chars)).alias("text"),
        ),
    )
    return F.filter(numbered, lambda s: s["text"].isNotNull()).cast(SECTION_ARRAY)


def full_text(clean: Column, max_chars: int | None = None) -> Column:
    whole = F.struct(F.lit("full_text").alias("section"), _head(clean, max_chars).alias("text"))
    return F.array(whole).cast(SECTION_ARRAY)


def form_sections(clean: Column, form_type: Column, annual=None, quarterly=None) -> Column:
    """Sections by the catalog of the form: the quarterly one for 10-Q, else the annual one."""

    def by(catalog: list) -> Column:
        found = slice_sections(clean, header_positions(clean, catalog))
        return keep_last_per_key(found) if has_repeated_keys(catalog) else found

    return F.when(form_type == "10-Q", by(quarterly or fv.QUARTERLY_SECTIONS)).otherwise(
        by(annual or fv.ANNUAL_SECTIONS)
    )
