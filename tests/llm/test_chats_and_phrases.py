"""Conversation repair, chat formatting and phrase mining against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fathomline.llm import chat_format as cf, conversation_repair as cr, phrase_mining as pm, queries

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string"
#: Names that the operators use inside.
CLASHES = ["same", "hash", "part", "at", "copies", "key", "message", "n", "copy", "pieces", "lang_", "w1", "tokens", "a"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def with_clashes(df, *more):
    return df.withColumns({c: F.lit(7) for c in [*CLASHES, *more] if c not in df.columns})


# ---- conversation repair -----------------------------------------------------------------


def after(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def cheapest(rows):
    """Least (cost, audit, repaired lines) by a table from the end; rows are (role, text, fault)."""
    best = {"": (0, "", ()), "a": (0, "", ())}
    for i in range(len(rows), -1, -1):
        here = {}
        for state in ("", "s", "u", "a"):
            ways = [best[state]] if i == len(rows) and state in best else []
            if i < len(rows):
                role, text, fault = rows[i]
                if state in best:
                    cost, audit, lines = best[state]
                    ways.append((cost + 2, "D" + audit, lines))
                extra = 5 if fault == "truncated" else 0
                for edit, name in (("K", role), ("R", "user"), ("R", "assistant")):
                    then = after(state, name[:1])
                    if fault not in ("blank", "duplicate") and then in best:
                        cost, audit, lines = best[then]
                        ways.append((cost + extra + (edit == "R"), edit + audit, (f"{name}:{text}", *lines)))
            if ways:
                here[state] = min(ways)
        for _ in range(4):  # inserted turns
            for state in ("", "s", "u", "a"):
                for name in ("user", "assistant"):
                    then = after(state, name[0])
                    if then in here:
                        cost, audit, lines = here[then]
                        here[state] = min(here.get(state, (10**9,)), (cost + 5, "I" + audit, (f"{name}:", *lines)))
        best = here
    return best[""]


def repaired(rows):
    """The contract's columns of one conversation; rows are (turn, role, text) in order."""
    seen, judged, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in rows:
        own = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
        blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "truncated")
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest(judged)
    return gaps, blank, duplicate, truncated, illegal, cost, audit, sha("\n".join(lines))


def in_order(rows):
    """Conversations as lists of (turn, role, text) by turn, nulls first; nulls of role and text are a space."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2]))
    return {conv: sorted(own, key=order) for conv, own in found.items()}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def told(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def odd_turns(seed, conversations=60):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 5 + ["system", "tool", "", None, "s", "usher"]
    texts = ["Yes.", "No!", "Why?", "so", "well", "", " \n", None, "End. ", "Ünde.", "a.b"]
    rows = []
    for conv in [None, *range(conversations)]:
        for k in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            turn = rng.choice([k, k, k, k, k + 3, None, 2])
            rows.append((conv, turn, rng.choice(roles), f"{rng.choice(texts)}" if rng.random() < 0.4 else f"Text {rng.randrange(10**6)}{rng.choice(['.', '!', ''])}"))
    rows += rng.sample(rows, 20) + [rows[0]] * 30  # repeated rows
    long = ["user", "assistant"] * 4 + ["system"]
    for k in range(3 * cr.BLOCK + 11):  # over several blocks and range partitions
        rows.append((1000, k, rng.choice(long), f"Long {k % 150}{rng.choice('..?x')}"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_matches_brute_force(spark, seed):
    rows = odd_turns(seed)
    turns = with_clashes(spark.createDataFrame(rows, TURNS).repartition(5))
    ids = spark.createDataFrame([(c,) for c in [None, 5000, *range(60), 1000]], "conv_id long")
    want = in_order(rows)
    got = told(cr.report(turns, ids))
    assert set(got) == {r["conv_id"] for r in ids.collect()}
    for conv, found in got.items():
        assert found == repaired(want.get(conv, [])), conv


def test_auction_agrees_with_a_table_on_all_short_conversations(spark):
    kinds = [("user", ""), ("assistant", ""), ("system", ""), ("user", "truncated"), ("assistant", "blank"), ("x", "")]
    for n in range(4):
        for code in range(len(kinds) ** n):
            rows = [kinds[code // len(kinds) ** k % len(kinds)] for k in range(n)]
            found = cr.ways([(r[:1], f, 1) for r, f in rows], [cr._NONE], [cr._END])[cr._NONE, cr._END]
            assert found == cheapest([(r, "t", f) for r, f in rows])[:2], rows


def test_blocks_join_to_the_same_audit(spark, monkeypatch):
    rows = odd_turns(3, conversations=25)
    turns = spark.createDataFrame(rows, TURNS)
    ids = turns.select("conv_id")
    whole = told(cr.report(turns, ids))
    monkeypatch.setattr(cr, "BLOCK", 2)
    assert told(cr.report(turns, ids)) == whole


def test_edits_give_the_repaired_conversations(spark):
    rows = odd_turns(4, conversations=30)
    found, edits = cr.repair(spark.createDataFrame(rows, TURNS))
    audits = {r["conv_id"]: r["audit"] for r in found.collect()}
    own = defaultdict(list)
    for r in sorted(edits.collect(), key=lambda r: (r["part"], r["place"])):
        own[r["conv_id"]].append(r)
    assert {k: "".join(r["edit"] * r["copies"] for r in v) for k, v in own.items()} == audits
    for edited in own.values():
        roles = "".join(r["role"][0] for r in edited if r["edit"] != "D")
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_damage_and_whole_query_match_brute_force(spark):
    rows = [(1, None, None, None), (None, 3, "user", "Hi."), (2, 2**40, "user", "A? b! c."), *odd_turns(5)]
    got = Counter(tuple(r) for r in cr.damage(spark.createDataFrame(rows, TURNS)).collect())
    assert got == Counter(damaged(rows))
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = in_order(damaged(given))
    assert told(queries.op11_conversation_repair(spark, SMALL)) == {conv: repaired(want.get(conv, [])) for conv in {r[0] for r in given}}


def test_repair_of_empty_and_lost_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert cr.report(none, none).count() == 0
    ids = spark.createDataFrame([(3,)], "conv_id long")
    assert told(cr.report(none, ids)) == {3: (0, 0, 0, 0, 0, 0, "", sha(""))}
    huge = spark.createDataFrame([(1, 0, "user", "x" * 2_000_000 + "?"), (1, 1, "assistant", "y" * 2_000_000)], TURNS)
    assert told(cr.report(huge, huge))[1][:7] == (0, 0, 0, 1, 0, 4, "DD")


# ---- chat formatting ---------------------------------------------------------------------


def folded(log):
    """Final (conv, opened, role, text) of a log, event by event."""
    live, dead = {}, set()
    for conv, seq, event, message, role, text in sorted(log, key=lambda e: e[1]):
        key = conv, message
        own = live.setdefault(key, {"opened": seq, "role": "", "named": False, "text": ""})
        if event == "open":
            if not own["named"]:
                own |= {"role": role or "", "named": True, "opened": seq}
            own["text"] = text or ""
        elif event == "delta":
            own["text"] += text or ""
        elif event == "edit":
            own["text"] = text or ""
        elif event == "regenerate":
            own["text"] = ""
            dead |= {k for k, v in live.items() if k[0] == conv and v["opened"] > own["opened"]}
    return {(k[0], v["opened"], v["role"], v["text"]) for k, v in live.items() if k not in dead}


def test_fold_matches_an_event_loop(spark):
    rng = random.Random(11)
    log, seq = [], 0
    for conv in [None, 1, 2, 3]:
        made = []
        for _ in range(120):
            seq += 1
            event = rng.choices(["open", "delta", "edit", "regenerate"], [4, 8, 1, 1])[0] if made else "open"
            message = len(made) if event == "open" else rng.choice(made[-3:])
            if event == "open":
                made.append(message)
            log.append((conv, seq, event, message, rng.choice(["user", None]), rng.choice(["a", "b ", "", None, "\n"])))
        log.append((conv, seq := seq + 1, "delta", -1, None, "never opened"))
    df = with_clashes(spark.createDataFrame(log, "conv_id long, seq long, event string, message long, role string, text string").drop("message_"), "base")
    got = {tuple(r) for r in cf.fold(df).select("conv_id", "opened", "role", "text").collect()}
    assert got == folded(log)
    assert cf.fold(df.where("false")).count() == 0


def test_hot_message_and_conversation(spark):
    log = spark.range(20_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "open").when(F.col("id") % 1000 == 999, "regenerate").otherwise("delta").alias("event"),
        F.lit(0).alias("message"), F.lit("user").alias("role"), F.lit("x").alias("text"),
    )
    rows = cf.fold(log.where("id < 19500")).collect()
    assert [(r["opened"], r["text"]) for r in rows] == [(0, "x" * 500)]


CONTROLS = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<\\|im_end|>", "<\\\\</s>", "[\\/INST]", "<", "[", "\\", "\n", "\\n", "ü", "user"]


def test_template_round_trip(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(CONTROLS, k=rng.randrange(9))) for _ in range(300)]
    rows = [(k // 5, k, rng.choice(["assistant", "user", texts[-k], None]), t if k % 50 else None) for k, t in enumerate(texts)]
    made = cf.read_back(cf.render(spark.createDataFrame(rows, "conv_id long, opened long, role string, text string"))).collect()
    for r in made:
        role, text = r["role"] or "", r["text"] or ""
        assert [tuple(t) for t in r["turns"]] == [(role, text)]
        assert (r["loss_text"] or "") == (text if role == "assistant" else "")
        body = r["formatted"][len("<|im_start|>") : -len("<|im_end|>\n")]
        assert not any(c in body for c in CONTROLS[:6])


def test_format_of_odd_rows(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, 0, 1, 2]), rng.choice(["assistant", "user", None, "a\nb"]), rng.choice(["", None, "x" * 1000, *CONTROLS])) for _ in range(150)]
    got = {r["conv_id"]: r for r in cf.digest(cf.format_turns(with_clashes(spark.createDataFrame(rows, TURNS), "opened"))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss)) and r["formatted_chars"] > 0
    assert cf.digest(cf.format_turns(spark.createDataFrame([], TURNS))).count() == 0


# ---- phrase mining -----------------------------------------------------------------------


def mined(rows, top=pm.TOP, longest=pm.LONGEST, least=pm.LEAST, covered=pm.COVERED):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in own.items():
            held = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in own.items())
            if not held:
                score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def texts(seed, many=400):
    rng = random.Random(seed)
    words = ["The", "the", "of", "new", "york", "city", "Ünd", "ünd", "x", "re\xa0al", "#1", "a-b", "日本"]
    phrase = lambda: rng.choices(words, k=rng.randrange(1, 7))
    glue = [" ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "; ", "!? "]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(w + rng.choice(glue[:4] + [" "] * 9) for w in phrase()) + rng.choice(glue)) for _ in range(many)]
    return rows + [("en", None), (None, ""), ("en", " ,. "), ("de", "new york city " * 300), ("en", "x x x x x x x x x x x x")] + rows[:40]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_match_brute_force(spark, seed):
    rows = texts(seed)
    df = with_clashes(spark.createDataFrame(rows, "lang string, text string"), "l", "f", "words")
    assert {tuple(r) for r in pm.collocations(df).collect()} == mined(rows)


@pytest.mark.parametrize("options", [{"top": 3}, {"longest": 2, "least": 3}, {"longest": 4, "least": 2, "covered": 100}])
def test_phrases_with_other_settings(spark, options):
    rows = texts(7, many=150)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in pm.collocations(df, **options).collect()} == mined(rows, **options)


def test_no_phrases_in_empty_tables(spark):
    for rows in ([], [("en", None)], [("en", "one two three")]):
        assert pm.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_scores_past_64_bits_are_exact(spark):
    a, l, r = 3 * 10**14 + 1, 3 * 10**14 + 7, 3 * 10**14 + 11
    wide = "decimal(19,0)"
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(
        f"(1000000 * cast(a as {wide}) * cast(a as {wide})) div (cast(l as {wide}) * cast(r as {wide})) as s").first()["s"]
    assert got == 10**6 * a * a // (l * r)


def test_windows_meet_once_and_roll_up_once(spark):
    """No n-gram length has an explosion or an aggregate of its own."""
    plan = pm.merged_windows(pm.counted_windows(spark.createDataFrame([("en", "a b c")], "lang string, text string"), 0, pm.np.zeros(pm.BITS // 8, "uint8")))
    told = plan.rollup("w1", "w2", "w3").count()._jdf.queryExecution().executedPlan().toString()
    assert told.count("MapInArrow") == 2 and told.count("Expand") == 1 and "Generate" not in told and "Window" not in told


def test_words_of_one_hash_take_another_seed(spark, monkeypatch):
    rows = texts(13)
    own = pm._hash
    monkeypatch.setattr(pm, "_hash", lambda word, lang, seed: own(word, lang, seed) % (5 if seed == 0 else 1 << 62) + 1)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert pm.word_counts(df)[1] == 1 and {tuple(r) for r in pm.collocations(df).collect()} == mined(rows)
    monkeypatch.setattr(pm, "_hash", lambda *a: 1)
    with pytest.raises(ValueError, match="one hash"):
        pm.word_counts(df)


def test_phrases_over_many_flushes_and_batches(spark, monkeypatch):
    rows = texts(9)
    monkeypatch.setattr(pm, "FLUSH_BYTES", 120)
    monkeypatch.setattr(pm, "BATCH", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {tuple(r) for r in pm.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == mined(rows)
