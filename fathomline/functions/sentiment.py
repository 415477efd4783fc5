"""Lexicon sentiment of a text as a column: (pos, neu, neg, compound)."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .binding import let
from .lookup import lookup

SCORE = "struct<pos:double,neu:double,neg:double,compound:double>"
def override(base: dict[str, float], extra: dict[str, float]) -> dict[str, float]:
    """Base valences with domain terms laid over them."""
    return {**base, **extra}


def tokens(text: Column, keep_short: bool = False) -> Column:
    """White-space tokens with edge punctuation removed; case is kept.

    ``keep_short`` leaves tokens of up to two letters as written, as the rules want them.
    """
    if not keep_short:
        # From the first to the last character of a token that is no punctuation.
        core = r"[^\s\p{Punct}](?:\S*[^\s\p{Punct}])?"
        return F.regexp_extract_all(text, F.lit(core), F.lit(0))

    def bare(w: Column) -> Column:
        return let(
            F.btrim(w, F.lit(string.punctuation)),
            lambda inner: F.when(F.length(inner) <= 2, w).otherwise(inner),
        )

    words = F.split(text, r"\s+", -1)
    return F.filter(F.transform(words, bare), lambda w: F.length(w) > 0)


def join_phrases(text: Column, lexicon: dict[str, float]) -> tuple[Column, dict[str, float]]:
    """Write each multi-word term as one token, so that single-token lookup can see it.

    All terms are one alternation, the longest first, so the number of walks does not grow with the lexicon.
    """
    terms = sorted((t for t in lexicon if " " in t), key=lambda t: (-len(t), t))
    if not terms:
        return text, lexicon
    any_term = "|".join(re.escape(t).replace(r"\ ", r"\s+") for t in terms)
    pattern = rf"(?i)\b(?:{any_term})\b"

    def glued(cut: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            term = F.regexp_replace(F.get(cut["hits"], i), r"\s+", "_")
            return F.concat(piece, F.coalesce(term, F.lit("")))

        return F.array_join(F.transform(cut["pieces"], one), "")

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    out = let(F.struct(F.split(text, pattern, -1).alias("pieces"), hits.alias("hits")), glued)
    return out, {t.replace(" ", "_"): v for t, v in lexicon.items()}


def compound(total: Column) -> Column:
    raw = total / F.sqrt(total * total + fv.COMPOUND_ALPHA)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def score_parts(valences: Column, emphasis: Column, digits: tuple[int, int]) -> Column:
    """Scores from token valences; ``emphasis`` strengthens the side that leads."""
    part, whole = digits
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("total", "pos", "neg", "neu")])

    def add(acc: Column, v: Column) -> Column:
        return F.struct(
            (acc["total"] + v).alias("total"),
            (acc["pos"] + F.when(v > 0, v + 1).otherwise(0.0)).alias("pos"),
            (acc["neg"] + F.when(v < 0, 1 - v).otherwise(0.0)).alias("neg"),
            (acc["neu"] + F.when(v == 0, 1.0).otherwise(0.0)).alias("neu"),
        )

    def finish(acc: Column) -> Column:
        strong = acc["total"] + F.signum(acc["total"]) * emphasis
        pos = acc["pos"] + F.when(acc["pos"] > acc["neg"], emphasis).otherwise(0.0)
        neg = acc["neg"] + F.when(acc["neg"] > acc["pos"], emphasis).otherwise(0.0)
        mass = pos + neg + acc["neu"]
        return F.struct(
            # a text without any token is neutral
            F.round(F.coalesce(F.try_divide(pos, mass), F.lit(0.0)), part).alias("pos"),
            F.round(F.coalesce(F.try_divide(acc["neu"], mass), F.lit(1.0)), part).alias("neu"),
            F.round(F.coalesce(F.try_divide(neg, mass), F.lit(0.0)), part).alias("neg"),
            F.round(compound(strong), whole).alias("compound"),
        )

    return F.aggregate(valences, zero, add, finish).cast(SCORE)


def _blank() -> Column:
    return F.struct(
        F.lit(0.0).alias("pos"), F.lit(1.0).alias("neu"),
        F.lit(0.0).alias("neg"), F.lit(0.0).alias("compound"),
    ).cast(SCORE)


def plain_valences(words: Column, lexicon: dict[str, float]) -> Column:
    return F.transform(words, lambda w: F.coalesce(lookup(F.lower(w), lexicon), F.lit(0.0)))


def rule_valences(words: Column, lexicon: dict[str, float], idioms: dict[str, float] = fv.IDIOMS) -> Column:
    """Valences adjusted for capitals, degree words and phrases, negation, idioms and a contrasting "but".

    Phrases are looked up only around words that have a valence, where the first and the last word begin and
    end some phrase; so a text costs little more than one lookup a word. As in the published model, idioms and
    degree phrases count from the fourth word of a text on, behind a word without a valence, and a degree phrase
    moves either sign the same way.
    """
    degree = {w: fv.DEGREE_STEP for w in fv.INTENSIFIERS} | {w: -fv.DEGREE_STEP for w in fv.DAMPENERS}
    degree_phrases = {w: d for w, d in degree.items() if " " in w}
    phrases = [p.split(" ") for p in (*idioms, *degree_phrases)]
    begins, ends = {p[0] for p in phrases}, {p[-1] for p in phrases}
    roles = {
        w: {"v": lexicon.get(w), "deg": degree.get(w, 0.0), "neg": w in fv.NEGATIONS, "begins": w in begins, "ends": w in ends}
        for w in {*lexicon, *degree, *fv.NEGATIONS, *begins, *ends}
    }

    def fact(w: Column) -> Column:
        """What the rules need to know about a token, from a single lookup."""
        return let(
            F.lower(w),
            lambda low: let(
                lookup(low, roles, "struct<v:double,deg:double,neg:boolean,begins:boolean,ends:boolean>"), lambda role: known(w, low, role)
            ),
        )

    def known(w: Column, low: Column, role: Column) -> Column:
        return F.struct(
            role["v"].alias("v"),
            F.coalesce(role["deg"], F.lit(0.0)).alias("deg"),
            (F.coalesce(role["neg"], F.lit(False)) | F.endswith(low, F.lit("n't"))).alias("neg"),
            ((low != w) & (F.upper(w) == w)).alias("cap"),
            low.alias("w"),
            F.coalesce(role["begins"], F.lit(False)).alias("begins"),
            F.coalesce(role["ends"], F.lit(False)).alias("ends"),
        )

    def adjusted(facts: Column, mixed: Column, but: Column) -> Column:
        def one(f: Column, i: Column) -> Column:
            def near(by: int) -> Column:
                return F.get(facts, i + by)

            def is_one(by: int, *options: str) -> Column:
                return F.coalesce(near(by)["w"].isin(*options), F.lit(False))

            def phrase(first: int, last: int, values: dict[str, float]) -> Column:
                """The value of the words at these distances, looked up where they can be a phrase."""
                whole = F.concat_ws(" ", *[near(k)["w"] for k in range(first, last + 1)])
                return F.when(near(first)["begins"] & near(last)["ends"], lookup(whole, values))

            no = F.lit(False)
            stressed = is_one(-1, "so", "this"), is_one(-2, "so", "this")
            doubt = is_one(-1, "doubt"), is_one(-2, "doubt")
            # "never so" stresses, "without doubt" leaves as it is
            lifted = [no, is_one(-2, "never") & stressed[0], is_one(-3, "never") & (stressed[0] | stressed[1])]
            calm = [no, is_one(-2, "without") & doubt[0], is_one(-3, "without") & (doubt[0] | doubt[1])]
            behind = [(-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2)]
            idiom = F.coalesce(
                *[phrase(a, b, idioms) for a, b in [(0, 2), (0, 1), *behind]]
            )
            extra = sum(F.coalesce(phrase(a, b, degree_phrases), F.lit(0.0)) for a, b in [(-3, -1), (-3, -2), (-2, -1)])
            before = F.array(
                *[
                    F.struct(
                        near(-back).alias("f"), F.lit(damp).alias("damp"),
                        lifted[back - 1].alias("lifted"), calm[back - 1].alias("calm"),
                        (idiom if back == 3 else F.lit(None).cast("double")).alias("idiom"),
                        (extra if back == 3 else F.lit(0.0)).alias("extra"),
                    )
                    for back, damp in enumerate(fv.DISTANCE_DAMPING, start=1)
                ]
            )

            def step(v: Column, prev: Column) -> Column:
                p = prev["f"]
                caps = F.when(mixed & p["cap"] & (p["deg"] != 0), fv.CAPS_STEP).otherwise(0.0)
                moved = v + (p["deg"] + caps) * F.signum(v) * prev["damp"]
                turned = moved * (
                    F.when(prev["lifted"], fv.NEVER_SO_FACTOR).when(prev["calm"] | ~p["neg"], 1.0).otherwise(fv.NEGATION_FACTOR)
                )
                # A word with a valence of its own neither strengthens nor negates.
                return F.when(p.isNull() | p["v"].isNotNull(), v).otherwise(
                    F.coalesce(prev["idiom"], turned) + prev["extra"]
                )

            # "no" negates what follows, and is no word of its own before a word with a valence
            after_no = is_one(-1, "no") | is_one(-2, "no") | (is_one(-3, "no") & is_one(-1, "or", "nor"))
            plain = F.when((f["w"] == "no") & near(1)["v"].isNotNull(), 0.0).otherwise(f["v"])
            start = F.when(after_no, f["v"] * fv.NEGATION_FACTOR).otherwise(plain)
            loud = F.when(mixed & f["cap"], F.when(start > 0, fv.CAPS_STEP).otherwise(-fv.CAPS_STEP)).otherwise(0.0)
            least = is_one(-1, "least") & near(-1)["v"].isNull() & ~is_one(-2, "at", "very")
            side = F.when(but == 0, 1.0).when(i + 1 < but, fv.BUT_BEFORE).when(
                i + 1 > but, fv.BUT_AFTER
            ).otherwise(1.0)
            own = F.aggregate(before, start + loud, step) * F.when(least, fv.NEGATION_FACTOR).otherwise(1.0)
            silent = f["v"].isNull() | (f["deg"] != 0) | ((f["w"] == "kind") & is_one(1, "of"))
            return F.when(silent, F.lit(0.0)).otherwise(own * side)

        return F.transform(facts, one)

    def ruled(facts: Column) -> Column:
        mixed = F.exists(facts, lambda f: f["cap"]) & F.exists(facts, lambda f: ~f["cap"])
        but = F.array_position(F.transform(facts, lambda f: f["w"]), F.lit("but")).cast("int")
        return let(
            F.struct(mixed.alias("mixed"), but.alias("but")),
            lambda t: adjusted(facts, t["mixed"], t["but"]),
        )

    return let(F.transform(words, fact), ruled)


def punctuation_emphasis(text: Column) -> Column:
    bangs = F.least(F.regexp_count(text, F.lit("!")), F.lit(4)) * fv.EXCLAMATION_STEP
    asked = F.regexp_count(text, F.lit(r"\?"))
    questions = (
        F.when(asked > 3, F.lit(fv.QUESTION_CAP))
        .when(asked > 1, asked * fv.QUESTION_STEP)
        .otherwise(0.0)
    )
    return bangs + questions


def score(
    text: Column,
    lexicon: dict[str, float],
    rules: bool = True,
    phrases: bool = False,
    max_chars: int | None = None,
    digits: tuple[int, int] = (3, 4),
) -> Column:
    """Sentiment of a whole text, or of its first ``max_chars`` characters where that is given."""
    head = text if max_chars is None else F.substring(text, 1, max_chars)
    if phrases:
        head, lexicon = join_phrases(head, lexicon)
    words = tokens(head, keep_short=rules)
    valences = rule_valences(words, lexicon) if rules else plain_valences(words, lexicon)
    emphasis = punctuation_emphasis(head) if rules else F.lit(0.0)
    scored = let(emphasis, lambda e: score_parts(valences, e, digits))
    blank = text.isNull() | ~F.rlike(text, F.lit(r"(?U)[^\s\x1c-\x1f]"))
    return F.when(blank, _blank()).otherwise(F.coalesce(scored, _blank()))
