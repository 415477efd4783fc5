"""Chat formatting from an event log.

A log holds what happened to each conversation in sequence: messages are opened, grow by streamed
deltas, are edited or are generated anew. The log is folded into the final messages, which are then
rendered turn by turn with a template whose control strings cannot occur inside a text.

The fold runs per message, not per conversation: the newest reset of a message (its opening, last
edit or last regeneration) is a mergeable maximum, and only what came from then on is put together.
So a conversation with a third of all events is spread over its messages, and drafts are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import attach, ordered_digest, stored

OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
TURN, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this template and of the other common one; texts must not hold them bare.
_CONTROLS = (r"<(\\*)(\|im_start\|>|\|im_end\|>|/?s>)", r"\[(\\*)(/?INST\])")
_ESCAPED = (r"<\\(\\*)(\|im_start\|>|\|im_end\|>|/?s>)", r"\[\\(\\*)(/?INST\])")
#: Characters of one streamed delta in a log made from finished turns.
PIECE = 256


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, opened, role, text): the final messages of a log, to be read in the order of ``opened``.

    ``log`` holds conv_id, seq, event, message, role, text; ``seq`` and ``message`` may be of any
    type with an order, other columns are not read. ``open`` gives the role and may give the first
    text, ``delta`` adds text, ``edit`` puts its text in place of all so far, ``regenerate`` empties
    the message and drops every message that was opened after it and before the regeneration. A null
    text is empty, a null role is empty, null ids are ids like others. A message that was never
    opened begins at its first event with an empty role. Events repeated with one ``seq`` are applied
    once if they are equal rows, else in the order of their texts. An empty log has no messages.
    """
    own = log.select(
        F.struct("conv_id", "message").alias("key"), "seq", "event",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    when = lambda *kinds: F.when(F.col("event").isin(*kinds), F.col("seq"))
    facts = own.groupBy("key").agg(
        F.max(when(OPEN, EDIT, REGENERATE)).alias("base"),
        F.coalesce(F.min(when(OPEN)), F.min("seq")).alias("opened"),
        F.coalesce(F.min(F.when(F.col("event") == OPEN, F.struct("seq", "role")))["role"], F.lit("")).alias("role"),
        F.max(when(REGENERATE)).alias("redone"),
        F.count("*").alias("copies"),
    )
    # a message goes if one that was opened before it is generated anew after it
    before = Window.partitionBy("key.conv_id").orderBy("opened", "key").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("until", F.max("redone").over(before))
    facts = stored(facts.where(F.col("until").isNull() | (F.col("until") < F.col("opened"))).drop("until", "redone"))
    parts = own.where(F.col("event").isin(OPEN, DELTA, EDIT)).select("key", "seq", "text")
    live = attach(parts, facts.select("key", "base", "copies"), "key", "copies", "inner")
    live = live.where(F.col("base").isNull() | (F.col("seq") >= F.col("base")))
    texts = live.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("seq", "text"))).alias("parts"))
    whole = texts.select("key", F.array_join("parts.text", "").alias("text"))
    met = facts.select("key", "opened", "role").join(whole, "key", "left")
    return met.select("key.conv_id", "opened", "role", F.coalesce("text", F.lit("")).alias("text"))


def escape(text: Column) -> Column:
    """Text whose control strings hold one backslash more after their first character."""
    for pattern, first in zip(_CONTROLS, "<["):
        text = F.regexp_replace(text, pattern, rf"{first}\\$1$2")
    return text


def unescape(text: Column) -> Column:
    for pattern, first in zip(_ESCAPED, "<["):
        text = F.regexp_replace(text, pattern, f"{first}$1$2")
    return text


def _role_out(role: Column) -> Column:
    """A role as one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    # a marker that no role holds keeps the pairs apart while line ends are put back
    marked = F.replace(unescape(role), F.lit("\\\\"), F.lit("\n"))
    parts = F.split(marked, "\n", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """``messages`` with ``formatted`` and the part of it that the loss covers: ``loss_start``, ``loss_length``.

    A conversation's sample is its ``formatted`` turns put together in order. Offsets count
    characters within the turn; turns whose role is not ``trained`` have a length of 0. Null roles and
    texts are empty.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(TURN), _role_out(role), F.lit("\n"))
    covered = F.when(role == trained, F.char_length(escape(text))).otherwise(0)
    return messages.withColumns({
        "formatted": F.concat(head, escape(text), F.lit(f"{END}\n")),
        "loss_start": F.char_length(head).cast("long"), "loss_length": covered.cast("long"),
    })


def read_back(rendered: DataFrame) -> DataFrame:
    """``rendered`` with ``turns`` (role, text of each turn found in ``formatted``) and ``loss_text``."""
    turn = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
    roles, texts = (F.regexp_extract_all("formatted", F.lit(turn), F.lit(k)) for k in (1, 2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(_role_in(r).alias("role"), unescape(t).alias("text")))
    loss = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))
    return rendered.withColumns({"turns": turns, "loss_text": F.when(F.col("loss_length") > 0, unescape(loss))})


def digest(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from ``formatted``.

    Turns stream through one hash per conversation in order; no conversation is held in memory.
    """
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(rendered).select(
        "conv_id", "opened", F.size("turns").cast("long").alias("n_turns"), told.alias("turns_sha256"),
        F.coalesce(F.char_length("loss_text"), F.lit(0)).cast("long").alias("loss_chars"), F.col("loss_text").alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    found = ordered_digest(rows, "conv_id", ["opened"], ["turns_sha256", "loss_sha256"], ["n_turns", "loss_chars", "formatted_chars"])
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def turn_log(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text) as a chat service would have streamed them.

    Texts arrive in deltas of ``piece`` characters. By crc32 of ``conv_id:turn`` modulo 4, a turn
    starts with a draft that is generated anew (1), with one that is edited (2), or with an answer that a
    later message follows before it is generated anew (3), so that message is dropped. Turns of equal number
    follow in the order of role and sha256 of the text; repeated rows are turns of their own.
    """
    own = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    counted = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = counted.select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("hash"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    text, n = F.col("text"), F.greatest(F.ceil(F.char_length("text") / F.lit(piece)), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(text, k * piece + 1, F.lit(piece)))
    # one list of events in which the side message, if any, has a mark of its own
    event = lambda kind, value, side=False: F.struct(F.lit(kind).alias("event"), value.cast("string").alias("text"), F.lit(side).alias("side"))
    none, first = F.lit(None).cast("string"), F.element_at("pieces", 1)
    draft = event(DELTA, F.concat(F.lit("Draft: "), first))
    deltas = F.transform("pieces", lambda p: event(DELTA, p))
    rest = F.slice(deltas, 2, F.greatest(F.size("pieces") - 1, F.lit(0)))
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit(""))).cast("binary")) % 4
    steps = (
        F.when(kind == 1, F.concat(F.array(draft, event(REGENERATE, none)), deltas))
        .when(kind == 2, F.concat(F.array(draft, event(EDIT, first)), rest))
        .when(kind == 3, F.concat(F.array(draft, event(OPEN, none, True), event(DELTA, F.lit("Go on."), True), event(REGENERATE, none)), deltas))
        .otherwise(deltas)
    )
    listed = rows.withColumn("pieces", pieces).select(
        "conv_id", "turn", "role", "hash", "copy", F.posexplode(F.concat(F.array(event(OPEN, none)), steps)).alias("step", "e")
    )
    return listed.select(
        "conv_id", F.struct("turn", "role", "hash", "copy", "step").alias("seq"), "e.event",
        F.struct("turn", "role", "hash", "copy", "e.side").alias("message"), "role", "e.text",
    )


def format_turns(turns: DataFrame) -> DataFrame:
    """Finished turns as rendered turns: through their log, the fold and the template."""
    return render(fold(turn_log(turns)))
