"""Conversation structure repair by the auction algorithm for shortest paths.

The nodes of a conversation's lattice are (rows read, state), where the state says which roles may
come next; its arcs are the edits. A path grows from the start along arcs that are tight at the present
node prices and shrinks, raising the price of its last node, where none is. Costs are integers, so
prices rise by one or more and end as the dual prices of the cheapest repair.

The path is the ASCII-least of the cheapest ones: while a node stays on the path its price is
fixed and other prices only rise, so arcs that are tight in the end were tight when the path left
the node, and the path always leaves by the least letter. The trace over the arcs that are tight at the
converged prices therefore finds the same path.

Rows are dealt out by ranges of (conversation, turn), so a conversation of any length is spread over
tasks. A task solves blocks of at most ``BLOCK`` rows and chains them; the pieces of a conversation
meet as small tables of (state before, state after, cost, letters). Inserted turns belong to the
row that follows them, so of two pieces over the same rows none begins with the other, and comparing
the first pieces that differ compares the whole audits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

from .shared import attach, ordered_digest, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: For a truncated row that is not deleted.
TRUNCATED = 5
#: Rows of a block: the path may shrink to its start at each price rise, so blocks are small.
BLOCK = 64
SPACE = " \t\n\x0b\f\r"

#: Nothing yet, after a system turn, after a user turn, after an assistant turn; the end.
_NONE, _SYSTEM, _USER, _ASSISTANT, _END = range(5)
#: What is still missing where a conversation ends: cost and letters by state.
_TAILS = {_NONE: (0, ""), _ASSISTANT: (0, ""), _USER: (COST[INSERT], INSERT), _SYSTEM: (2 * COST[INSERT], 2 * INSERT)}
_LEGAL = {"su", "ua", "au"}


def _turn(state: int) -> tuple[str, int]:
    """The role that an inserted or renamed turn takes in ``state``, and the state after it."""
    return ("assistant", _ASSISTANT) if state == _USER else ("user", _USER)


def _kept(state: int, initial: str) -> int | None:
    """The state after a kept turn, or None where its role may not come."""
    if initial == "s":
        return _SYSTEM if state == _NONE else None
    role, after = _turn(state)
    return after if initial == role[0] else None


def _lattice(rows: list[tuple[str, str, int]], target: int) -> tuple[list[list[tuple[str, int, int]]], list[int], int]:
    """Arcs (letters, cost, node) by node, feasible first prices, and the node of the end.

    A row is (initial, fault, copies): copies after the first are duplicates or blank, so they are deleted.
    Only nodes from which ``target`` can be reached have arcs that lead to them.
    """
    n = len(rows)
    end = 4 * n + 4
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(end)]
    last_system = max((i for i, r in enumerate(rows) if r[0] == "s" and r[1] not in ("blank", "duplicate")), default=-1)

    def alive(i: int, state: int) -> bool:
        if i == n and target != _END:
            return state == target
        if target in (_NONE, _SYSTEM):
            return state == target or (state < target and i <= last_system)
        return True

    floor = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, fault, copies = rows[i]
        more, tail = COST[DELETE] * (copies - 1), DELETE * (copies - 1)
        extra = TRUNCATED if fault == "truncated" else 0
        removed = fault in ("blank", "duplicate")
        least = COST[DELETE]
        for state in range(4):
            out = [(DELETE + tail, COST[DELETE] + more, i + 1, state)]
            role, after = _turn(state)
            out.append((INSERT, COST[INSERT], i, after))
            if not removed:
                kept = _kept(state, initial)
                if kept is not None:
                    out.append((KEEP + tail, COST[KEEP] + extra + more, i + 1, kept))
                out.append((REROLE + tail, COST[REROLE] + extra + more, i + 1, after))
                least = min(least, extra + (COST[KEEP] if initial in ("s", "u", "a") else COST[REROLE]))
            arcs[4 * i + state] = [(letters, cost, 4 * j + q) for letters, cost, j, q in out if alive(j, q)]
        floor[i] = floor[i + 1] + least + more
    for state in range(4):
        if target == _END:
            cost, letters = _TAILS[state][0], _TAILS[state][1]
            arcs[4 * n + state] = [(letters, cost, end)]
        elif state == target:
            arcs[4 * n + state] = [("", 0, end)]
    return arcs, [floor[k // 4] for k in range(end)] + [0], end


def auction(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int, end: int) -> None:
    """Raise ``price`` until a path of tight arcs joins ``origin`` and ``end``.

    Prices must be feasible (no price over cost plus price of the next node); they stay so, and can be
    used again for other origins. Arcs of a node are in the order of their letters.
    """
    path = [origin]
    while (node := path[-1]) != end:
        best, to = None, end
        for _, cost, then in arcs[node]:
            if best is None or cost + price[then] < best:
                best, to = cost + price[then], then
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def trace(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int, end: int) -> str:
    """The letters of the least path over tight arcs."""
    letters, node = [], origin
    while node != end:
        text, _, node = next(a for a in arcs[node] if price[node] == a[1] + price[a[2]])
        letters.append(text)
    return "".join(letters)


def ways(rows: list[tuple[str, str, int]], entries: Iterable[int], targets: Iterable[int]) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, letters) of the cheapest, ASCII-least edits of ``rows`` for each pair of states that they can join."""
    found = {}
    system = any(r[0] == "s" and r[1] not in ("blank", "duplicate") for r in rows)
    for target in targets:
        arcs, price, end = _lattice(rows, target)
        for entry in entries:
            if target < _USER and entry != target and not (entry == _NONE and system):
                continue
            auction(arcs, price, entry, end)
            found[entry, target] = (price[entry], trace(arcs, price, entry, end))
    return found


def _extend(reached: dict, piece: dict) -> dict:
    """Chains of pieces by the state they end in: (cost, rank of the letters, (chain before, letters))."""
    best: dict = {}
    for (entry, after), (cost, letters) in piece.items():
        if entry in reached:
            so_far, rank, chain = reached[entry]
            way = (so_far + cost, rank, letters, chain)
            if after not in best or way[:3] < best[after][:3]:
                best[after] = way
    order = {after: k for k, after in enumerate(sorted(best, key=lambda a: best[a][1:3]))}
    return {a: (cost, order[a], (chain, letters)) for a, (cost, _, letters, chain) in best.items()}


def _letters(chain) -> list[str]:
    pieces = []
    while chain is not None:
        chain, letters = chain
        pieces.append(letters)
    return pieces[::-1]


_WAYS = T.ArrayType(T.StructType([
    T.StructField("entry", T.IntegerType()), T.StructField("after", T.IntegerType()),
    T.StructField("cost", T.LongType()), T.StructField("letters", T.StringType()),
]))


def _flagged(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and the first fault of the first copy."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", space("role"), space("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("hash", F.sha2("text", 256)).withColumn("same", F.struct("conv_id", "role", "hash"))
    facts = rows.groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("met"))
    own = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(own == "", "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate")
        .when(~F.substring(own, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    )
    return attach(rows, facts, "same", "met").select("conv_id", "turn", "role", "text", "hash", "copies", fault.alias("fault"))


def _pieces(turns: DataFrame) -> DataFrame:
    """Rows by place (part, at), and after the rows of each conversation in a part its piece, ``at`` -1."""
    order = ["conv_id", "turn", "role", "hash"]
    rows = _flagged(turns).repartitionByRange(*order).sortWithinPartitions(*order).drop("hash")
    fields = [*(T.StructField(f.name, f.dataType) for f in rows.schema), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("edges", T.StringType()), T.StructField("illegal", T.LongType()), T.StructField("ways", _WAYS)]
    schema, names = T.StructType(fields), rows.columns

    def solve(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        part, arrow = TaskContext.get().partitionId(), to_arrow_schema(schema)
        open_, first = None, True  # the conversation that is being read; whether it may begin in an earlier part

        def closed(last: bool) -> dict:
            own = open_
            if own["block"] or last:
                block(own, [_END] if last else range(4))
            found = [
                {"entry": e, "after": a, "cost": cost, "letters": "".join(_letters(chain))}
                for e, reached in own["reached"].items() for a, (cost, _, chain) in reached.items()
            ]
            return dict.fromkeys(names) | {"conv_id": own["id"], "part": part, "at": -1, "edges": own["first"] + own["last"], "illegal": own["illegal"], "ways": found}

        def block(own: dict, targets) -> None:
            piece = ways(own["block"], {q for reached in own["reached"].values() for q in reached}, targets)
            own["reached"] = {e: _extend(reached, piece) for e, reached in own["reached"].items()}
            own["block"] = []

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if open_ is None or open_["id"] != row["conv_id"]:
                    if open_ is not None:
                        out.append(closed(last=True))
                        first = False
                    entries = range(4) if first else [_NONE]
                    open_ = {"id": row["conv_id"], "reached": {e: {e: (0, 0, None)} for e in entries}, "block": [], "at": 0, "first": None, "last": "", "illegal": 0}
                initial = row["role"][:1] or "-"
                if open_["first"] is None:
                    open_["first"] = initial
                else:
                    open_["illegal"] += open_["last"] + initial not in _LEGAL
                open_["illegal"] += row["copies"] - 1
                open_["last"] = initial
                if len(open_["block"]) == BLOCK:
                    block(open_, range(4))
                open_["block"].append((initial, row["fault"], row["copies"]))
                out.append(row | {"part": part, "at": open_["at"]})
                open_["at"] += 1
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([closed(last=False)], schema=arrow)

    return rows.mapInArrow(solve, schema)


def _solved(pieces: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, illegal, segments): the pieces of each conversation put together."""
    own = pieces.where("at = -1").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "edges", "illegal", "ways"))).alias("pieces"))
    segment = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("letters", T.StringType())])
    schema = T.StructType([
        own.schema["conv_id"], T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
        T.StructField("illegal", T.LongType()), T.StructField("segments", T.ArrayType(segment)),
    ])

    def join(row: dict) -> dict:
        reached, illegal, last = {_NONE: (0, 0, None)}, 0, None
        for piece in row["pieces"]:
            illegal += piece["illegal"] + (last is not None and last + piece["edges"][0] not in _LEGAL)
            last = piece["edges"][1]
            reached = _extend(reached, {(w["entry"], w["after"]): (w["cost"], (w["letters"], w["entry"], w["after"])) for w in piece["ways"]})
        if _END not in reached:
            reached = _extend(reached, {(q, _END): (cost, (letters, q, _END)) for q, (cost, letters) in _TAILS.items()})
        cost, _, chain = reached[_END]
        steps = _letters(chain)
        parts = [p["part"] for p in row["pieces"]]
        if len(steps) > len(parts):  # what the tail adds belongs to the last piece
            (letters, entry, _), (tail, _, _) = steps[-2:]
            steps[-2:] = [(letters + tail, entry, _END)]
        found = [{"part": p, "entry": entry, "letters": letters} for p, (letters, entry, _) in zip(parts, steps)]
        return {"conv_id": row["conv_id"], "cost": cost, "audit": "".join(s["letters"] for s in found), "illegal": illegal, "segments": found}

    def solve(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            yield pa.RecordBatch.from_pylist([join(r) for r in batch.to_pylist()], schema=arrow)

    return own.mapInArrow(solve, schema)


def _edited(pieces: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, part, place, edit, copies, turn, role, text): every edit in order, by letters and rows."""
    marks = solved.select("conv_id", F.inline("segments")).withColumn("at", F.lit(-1).cast("long"))
    rows = pieces.where("at >= 0").select("conv_id", "part", "at", "turn", "role", "text", "copies")
    both = rows.unionByName(marks, allowMissingColumns=True)
    dealt = both.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
    schema = T.StructType([
        rows.schema["conv_id"], rows.schema["part"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("copies", T.LongType()), rows.schema["turn"], T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    ])

    def apply(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        letters, next_, state, place, last = "", 0, _NONE, 0, None

        def inserted(own):
            nonlocal next_, state, place
            while letters[next_ : next_ + 1] == INSERT:
                role, state = _turn(state)
                yield own | {"place": place, "edit": INSERT, "copies": 1, "turn": None, "role": role, "text": ""}
                next_, place = next_ + 1, place + 1

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = {"conv_id": row["conv_id"], "part": row["part"]}
                if row["at"] == -1:
                    if last is not None:
                        out.extend(inserted(last))
                    letters, next_, state, place, last = row["letters"], 0, row["entry"], 0, own
                    continue
                out.extend(inserted(own))
                edit, role, copies = letters[next_], row["role"], row["copies"]
                if edit == REROLE:
                    role, state = _turn(state)
                elif edit == KEEP:
                    state = _kept(state, role[:1])
                gone = copies if edit == DELETE else copies - 1
                same = own | {"turn": row["turn"], "text": row["text"]}
                if edit != DELETE:
                    out.append(same | {"place": place, "edit": edit, "copies": 1, "role": role})
                if gone:
                    out.append(same | {"place": place + copies - gone, "edit": DELETE, "copies": gone, "role": row["role"]})
                next_, place = next_ + copies, place + copies
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if last is not None and (rest := list(inserted(last))):
            yield pa.RecordBatch.from_pylist(rest, schema=arrow)

    return dealt.mapInArrow(apply, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The findings of each conversation, and its edits in order.

    ``turns`` holds conv_id, turn, role, text; other columns are not read, whatever their names.
    Nulls in role and text are one space; a null conversation is one like any other; a null turn comes first.
    Turns of equal number follow in the order of role and sha256 of the text; equal rows are copies
    that stand next to each other. The first fault of a row counts: blank (nothing but space),
    duplicate (its role and text came before), truncated (does not end in ``.``, ``!`` or ``?``).

    Findings: conv_id, gaps (missing turn numbers), blank, duplicate, truncated, illegal (neighbours
    whose roles may not follow each other), cost and audit (initials of the cheapest edits, ASCII-least).
    Edits: conv_id, part, place, edit, copies, turn, role, text; the repaired conversation is the rows that
    are not deleted, by part and place. An empty table gives no findings and no edits. An audit is one
    text, so a conversation's letters (one byte a row) meet in one task; its texts never do.
    """
    pieces = stored(_pieces(turns))
    solved = stored(_solved(pieces))
    rows = pieces.where("at >= 0")
    count = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")
    again = F.when(F.col("fault") == "duplicate", F.col("copies")).otherwise(F.col("copies") - 1)
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count(F.col("fault") == "blank", F.col("copies")).alias("blank"),
        count(F.col("fault") != "blank", again).alias("duplicate"),
        count(F.col("fault") == "truncated", F.lit(1)).alias("truncated"),
    )
    own = solved.select(F.col("conv_id").alias("id"), "illegal", "cost", "audit")
    found = counts.join(own, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    return found, _edited(pieces, solved)


def damage(turns: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text,
    2 takes out its sentence ends, 3 repeats it, 4 makes its role user. Nulls count as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = turns.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return rows.drop("copy")


def report(turns: DataFrame, all_ids: DataFrame) -> DataFrame:
    """Findings and ``repaired_sha256`` of every conv_id in ``all_ids``; those without rows have zeros and empty texts."""
    found, edits = repair(turns)
    line = F.concat_ws(":", "role", "text").alias("repaired_sha256")
    kept = edits.where(F.col("edit") != DELETE).select("conv_id", F.struct("part", "place").alias("at"), line)
    hashes = ordered_digest(kept, "conv_id", ["at"], ["repaired_sha256"], [], glue="\n")
    ids = all_ids.select(F.col("conv_id").alias("id")).distinct()
    met = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    digests = hashes.select(F.col("conv_id").alias("id"), "repaired_sha256")
    met = met.join(digests, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return met.select(
        "conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in longs),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
