"""Text expressions: cleaning, HTML to text, statistics, sentences."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from .binding import let
from .lookup import lookup

# (?U) makes \s cover every Unicode space; the control range is what str.strip() adds to it.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
# A sentence ends after . ! or ?, with any closing quotes and brackets that follow.
SENTENCE_BREAK = r"(?<=[.!?][\"'”’)\]]{0,4})\s+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def one_line(text: Column) -> Column:
    """Newlines to spaces, then strip."""
    return strip(F.translate(text, "\n", " "))


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    """Pieces between single spaces, empty ones included."""
    return F.size(F.split(text, " ", -1))


def rough_sentence_count(text: Column) -> Column:
    return F.size(F.split(text, r"\. ", -1))


def token_estimate(text: Column) -> Column:
    """Four characters per token."""
    return F.length(text) / F.lit(4.0)


def snippet(text: Column, n: int = 400) -> Column:
    return F.substring(text, 1, n)


def ellipsis(text: Column, n: int) -> Column:
    """At most ``n`` characters, marked with dots when something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def sentences(text: Column) -> Column:
    """Array of sentences; the white space between them belongs to none."""
    return F.filter(F.split(text, SENTENCE_BREAK, -1), lambda s: F.length(s) > 0)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references to characters, in a single pass."""
    named = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}

    def decoded(piece: Column) -> Column:
        ref = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*)(?:;|(?![0-9a-zA-Z;]))", 1)
        whole = F.regexp_extract(piece, r"^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?", 0)
        code = F.when(
            F.rlike(ref, F.lit("^#[xX]")),
            F.conv(F.substring(ref, 3, 8), 16, 10).cast("int"),
        ).when(F.startswith(ref, F.lit("#")), F.substring(ref, 2, 8).cast("int"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(
            valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        ).when(code.isNull(), lookup(ref, named, "string"))
        rest = F.substring(piece, F.length(whole) + 1, F.length(piece))
        return F.when(
            (F.length(ref) > 0) & char.isNotNull(), F.concat(char, rest)
        ).otherwise(F.concat(F.lit("&"), piece))

    def frequent(plain: Column) -> Column:
        # The most frequent references go first as plain replacements; none of them yields an "&".
        for ref, char in {"&nbsp;": "\u00a0", "&#160;": "\u00a0", "&#8217;": "\u2019",
                          "&lt;": "<", "&gt;": ">", "&quot;": '"'}.items():
            plain = F.replace(plain, F.lit(ref), F.lit(char))
        return plain

    def rebuilt(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.size(pieces)), decoded)
        return F.concat(pieces[0], F.array_join(rest, ""))

    return let(
        text,
        lambda t: F.when(
            F.contains(t, F.lit("&")), let(F.split(frequent(t), "&", -1), rebuilt)
        ).otherwise(t),
    )


def node_text(html: Column, drop: tuple[str, ...] = ("script", "style")) -> Column:
    """Text nodes joined by one space; ``drop`` names the elements left out with their content."""
    out = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "<!>")
    for name in drop:
        end = r"(?:</head\s*>|(?=<body\b)|\z)" if name == "head" else rf"(?:</{name}\s*>|\z)"
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?{end}", "<!>")
    # A run of tags with nothing between them separates two text nodes once. The repeats are
    # possessive: Java walks them in a loop, where a plain group repeat would recurse per tag.
    tag = r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    out = F.regexp_replace(out, rf"(?:{tag})++", " ")
    out = F.regexp_replace(out, r"(?:<[a-zA-Z/!?][^>]*+>)++", " ")
    return decode_entities(out)


def html_to_text(html: Column) -> Column:
    """Readable text of a page: no head, scripts or styles, spaces and blank lines collapsed."""
    out = node_text(html, drop=("script", "style", "head"))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))
