"""The training-data operators against brute force, and on nulls, empties, long texts, ties and repeats."""

import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import (
    components, decontamination as dc, embedding_dedup as ed, language_id as li, license_scan as ls, line_dedup as ld,
    minhash_dedup as mh, packing, quality as ql, span_dedup as sd, url_filter as uf,
)
from fathomline.llm.queries import URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, *texts, ids=None, lang="en"):
    rows = [(k if ids is None else ids[k], t, lang, f"s{k % 5}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# ---- components --------------------------------------------------------------------------


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- MinHash -----------------------------------------------------------------------------


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def near_groups(texts, size):
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sets, root


def edited(rng, text, rate):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < rate else w for w in text.split())


@pytest.mark.parametrize("chain_bytes", [mh.CHAIN_BYTES, 0])
def test_minhash_matches_brute_force(spark, monkeypatch, chain_bytes):
    monkeypatch.setattr(mh, "CHAIN_BYTES", chain_bytes)  # 0: every chain takes the way of large ones
    rng = random.Random(5)
    base = prose(rng, 150)
    texts = [base, base.upper(), None, "", " \t\n", "one two", "ONE two", "three words here", "a b c"]
    texts += [edited(rng, base, rng.choice((0.005, 0.02, 0.04, 0.08))) for _ in range(60)]
    texts += [prose(rng, 60) for _ in range(20)] + [base + " " + prose(rng, 120) for _ in range(5)]
    sets, root = near_groups(texts, 5)
    got = {r["doc_id"]: r for r in mh.groups(docs(spark, *texts)).collect()}
    assert [got[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]
    assert [got[k]["component_id"] for k in range(len(texts))] == root
    assert all(got[k]["kept"] == (root[k] == k) for k in got)


def test_minhash_repeats_nulls_and_clashing_columns(spark):
    text = prose(random.Random(1), 40)
    rows = docs(spark, text, text, text + " tail", text, "other words stand here now", None, ids=[5, 5, 5, None, 9, 9])
    rows = rows.withColumn("node", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("kept", F.lit(False))
    got = mh.groups(rows).orderBy("doc_id", "n_shingles").collect()
    assert len(got) == 6 and [r["component_id"] for r in got] == [None, 5, 5, 5, 9, 9] and all(r["kept"] for r in got)
    left = mh.deduplicate(rows)
    assert left.columns == rows.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in left.collect()) == sorted([(-1, text), (5, text), (5, text + " tail"), (9, ""), (9, "other words stand here now")])
    assert mh.groups(rows.limit(0)).count() == 0 and mh.deduplicate(rows.limit(0)).count() == 0


def test_tensored_keys_need_few_minhashes():
    factors = mh._coefficients(2 * mh.COLLECTION * mh.ROWS)
    assert len(factors) == 96 and mh.COLLECTION**2 == 256  # 256 tables of six minhashes each
    own = mh.Shingler(5)(b"a b c d e f g")
    assert len(mh.small_hashes(own, factors, mh.ROWS)) == 32


# ---- embeddings --------------------------------------------------------------------------


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(scale=s, size=(40, 16)) for c, s in zip(centers, (0.05, 0.1, 0.15, 0.2, 0.25, 0.3) * 2)])
    x = np.concatenate([x, x[:30], 3 * x[:5]]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near, root[None], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [1.0, 2.0], 1), (1005, [], 1), (None, x[0].tolist(), 1), (1006, [float("inf")] * 16, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("digest", F.lit(1)).withColumn("n_links", F.lit(2))
    for block in (ed.BLOCK, 64):
        got = {r["vec_id"]: r for r in ed.near_duplicates(table, block=block).collect()}
        assert len(got) == len(rows) + len(odd)
        assert [got[k]["n_links"] for k in range(len(x))] == near.sum(1).tolist()
        assert [got[k]["component_id"] for k in range(len(x))] == root.tolist()
        assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k, *_ in odd if k is not None)
        assert got[None]["component_id"] is None and got[None]["kept"]
    assert ed.near_duplicates(table.limit(0)).count() == 0
    wide = table.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted(map(tuple, ed.near_duplicates(wide, block=64).where("vec_id is not null").collect())) == sorted(tuple(r) for k, r in got.items() if k is not None)


def test_decontamination_counts_in_tasks_and_joins_any_size_of_counts(spark, monkeypatch):
    rng = random.Random(6)
    bench = [prose(rng, rng.randrange(1, 30)) for _ in range(12)]
    texts = [prose(rng, 40) + " " + rng.choice(bench) + " " + prose(rng, 5) for _ in range(60)] + [bench[3]] * 400 + ["", None]
    table, items = docs(spark, *texts, ids=[*range(60), *[60] * 400, 61, 62]), spark.createDataFrame([(str(k), b) for k, b in enumerate(bench)], "item_id string, text string")
    found = dc.contamination(table, items)
    assert "REPARTITION_BY" not in found._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["item_ids"])), r["contaminated"]) for r in df.collect())
    want = rows(found)
    assert len(want) == len(texts) and [r for r in want if r[0] == 60] == [want[60]] * 400 and want[60][4]
    monkeypatch.setattr(dc, "COUNT_BYTES", 0)
    assert rows(dc.contamination(table, items)) == want


def test_principal_dimensions_from_a_sketch():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 40)) * np.array([20, 12, 7] + [0.3] * 37)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    moments = (x @ turn).T @ (x @ turn)
    probe = rng.normal(size=(40, 3 + ed.OVERSAMPLE))
    found = ed._principal(moments @ probe, probe, 3)
    assert np.allclose(found.T @ found, np.eye(3)) and np.allclose(np.abs(np.sum(found * np.linalg.eigh(moments)[1][:, ::-1][:, :3], axis=0)), 1, atol=1e-3)
    flat = np.outer(np.ones(40), np.ones(40))  # one direction only: the rest of the basis is any orthonormal one
    found = ed._principal(flat @ probe, probe, 3)
    assert np.allclose(found.T @ found, np.eye(3)) and np.allclose(np.abs(found[:, 0]), 40**-0.5)


# ---- packing -----------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    own = Tokenizer.from_file(tokenizer_path())
    texts = [prose(rng, rng.randrange(1, 900)) for _ in range(120)] + [None, "", prose(rng, 9000), "a  b\n\n c\t’é½", "x" * 5000, "same", "same"]
    ids = [own.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    rows = docs(spark, *texts).withColumn("piece", F.lit("clash")).withColumn("length", F.lit(1))
    got = packing.pack(rows, tokenizer_path(), shard_pieces=50).collect()
    for k, want in enumerate(ids):
        parts = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == [sum(p["length"] for p in parts[:i]) for i in range(len(parts))]
        assert sum(r["length"] for r in parts) == len(want) and all(r["length"] == 2048 for r in parts[1:])
        for r in parts:
            raw = np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(raw)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    least = -(-sum(map(len, ids)) // 2048)
    assert len(sequences) <= least + 4
    assert packing.pack(rows.limit(0), tokenizer_path()).count() == 0
    whole = packing.pieces(rows, tokenizer_path(), with_ids=True).where("doc_id = 5").first()["ids"]
    assert np.frombuffer(whole, "<u4").tolist() == ids[5]


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    own, fast, rng = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path()), random.Random(1)
    letters = "ab  \n\t.,!'sté12é½—<|endoftext|>"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(25)))
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
    for text in ("it's <|endoftext|> here", "we'll'd 've", "\x1c a\x85b"):
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


# ---- decontamination ---------------------------------------------------------------------


def hits(texts, items, window=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    windows = {}
    for item, t in items:
        w = cut(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for t in texts:
        w, hit, ids = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), ids))
    return out


@pytest.mark.parametrize("bound", [dc.BROADCAST_BYTES, 4000])
def test_decontamination_matches_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", bound)  # the small bound makes several broadcast blocks
    rng = random.Random(8)
    item = [prose(rng, 40, 30), prose(rng, 13, 30), "Short item", "É single", None, "...", "a a a a a a a a a a a a a a a", "solo"]
    items = [(k, t) for k, t in enumerate(item)] + [(1, item[1]), (None, prose(rng, 20, 30))]
    texts = [None, "", "?!", item[0], "x " * 200 + item[0], item[0].upper() + ", " + item[1], "short ITEM", "é single É SINGLE", "a " * 40, "Solo."]
    texts += [prose(rng, 60, 30) + " " + " ".join(item[0].split()[k : k + 14]) + " " + prose(rng, 30, 30) for k in range(0, 26, 3)]
    table = docs(spark, *texts, texts[3], ids=[*range(len(texts)), 3]).withColumn("words", F.lit(1)).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("word", F.lit("clash"))
    got = dc.contamination(table, bench).collect()
    assert len(got) == len(texts) + 1
    want = hits(texts, items)
    for r in got:
        n, hit, ids = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], set(r["item_ids"])) == (n, hit, ids - {None})
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    clean = {k for k, (n, hit, _) in enumerate(want) if not (hit and 20 * hit >= n)}
    left = dc.decontaminate(table, bench)
    assert left.columns == table.columns and {r["doc_id"] for r in left.collect()} == clean
    assert dc.contamination(table.limit(0), bench).count() == 0
    assert dc.contamination(table, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_runs_no_python(spark, small):
    table = lambda n: spark.read.parquet(f"{small}/{n}.parquet")
    plan = dc.contamination(table("documents"), table("benchmark"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# ---- lines -------------------------------------------------------------------------------


def test_line_dedup_matches_counts(spark):
    common, rare, near = "A line that many sites have", "A line that two sites have", "A line at the very threshold"
    rows = []
    for k in range(60):
        lines = [f"text of document {k}, its own", "short"]
        lines += [common] * (k < 40) + ["  " + rare] * (k in (3, 4)) + [near + " "] * (k < 8) + [near + "!"] * (k < 7)
        rows.append((k, "\n".join(lines), f"site{k % 20}"))
    rows += [(100, None, "site1"), (101, "", None), (102, common, None), (103, f"{common}\n{common}", "site2"), (103, f"{common}\n{common}", "site2"), (None, common, "site3")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit(1)).withColumn("pos", F.lit(2))
    sites = {}
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            if site and len(x.strip(" ")) >= ld.MIN_CHARS:
                sites.setdefault(x.strip(" "), set()).add(site)
    bad = {x for x, s in sites.items() if len(s) >= ld.MIN_SITES}
    assert bad == {common, near}
    got = ld.deduplicate(table).select("doc_id", "text", "__n_removed").collect()
    want = [(d, t if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad)) for d, t, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r[0], r[1]) for r in got], key=key) == sorted(want, key=key)
    kept = {r["doc_id"]: r["text"] for r in ld.deduplicate(table, keep_first=True).collect()}
    assert common in kept[0] and common not in kept[1] and near in kept[0] and kept[103] == ""
    assert ld.deduplicate(table.limit(0)).count() == 0


# ---- spans -------------------------------------------------------------------------------


def test_span_dedup_removes_later_passages_only(spark):
    rng = random.Random(6)
    sentence = lambda: prose(rng, rng.randrange(6, 14), 5000).capitalize() + ". "
    passage = "".join(sentence() for _ in range(6))
    unmarked = prose(rng, 120, 5000)
    own = ["".join(sentence() for _ in range(8)) for _ in range(6)]
    texts = [own[0] + passage + own[1], own[2] + passage.upper() + own[3], own[4], own[5] + passage + "\n" + passage, None, "", unmarked + " end", own[1][:40] + " " + unmarked, "No. Yes. No. Yes."]
    texts += ["No. Yes. No. Yes."]
    table = docs(spark, *texts).withColumn("run", F.lit(1)).withColumn("first", F.lit(2)).withColumn("row", F.lit(3))
    got = {r["doc_id"]: r for r in sd.deduplicate(table).collect()}
    for k in (0, 2, 4, 5, 6, 8, 9):
        assert got[k]["text"] == texts[k] and got[k]["n_removed"] == 0
    assert got[1]["text"] == own[2] + own[3] and got[1]["first_docs"] == [0]
    assert got[3]["text"].strip() == own[5].strip() and 0 in got[3]["first_docs"]
    assert len(got[7]["text"].split()) < 60 and got[7]["first_docs"] == [6]
    assert all("".join(sd.sentences(t)) == t for t in texts if t)
    assert sd.deduplicate(table.limit(0)).count() == 0


def test_spans_of_rows_without_or_with_one_id(spark):
    rng = random.Random(16)
    sentence = lambda: prose(rng, rng.randrange(8, 14), 5000).capitalize() + ". "
    passage, own = "".join(sentence() for _ in range(5)), ["".join(sentence() for _ in range(4)) for _ in range(8)]
    texts = [own[0] + passage, own[1] + passage, passage + own[2], own[3] + passage, own[4] + own[5], own[4] + own[5], own[4] + own[5]]
    table = docs(spark, *texts, ids=[None, None, 7, 7, 9, 9, 9])
    got = sd.deduplicate(table).collect()
    left = sum(passage[:40] in r["text"] for r in got)
    assert len(got) == 7 and left == 1 and next(r for r in got if passage[:40] in r["text"])["doc_id"] == 7
    nulls = [r for r in got if r["doc_id"] is None]
    assert all(r["n_removed"] == 5 and r["first_docs"] == [7] for r in nulls)
    equal = sorted((r["n_removed"], r["first_docs"]) for r in got if r["doc_id"] == 9)
    assert equal == [(0, []), (8, [9]), (8, [9])]
    only = sd.deduplicate(docs(spark, *texts[:2], ids=[None, None])).collect()
    assert sorted(r["n_removed"] for r in only) == [0, 5] and all(r["first_docs"] == [] for r in only)


def test_spans_of_scripts_without_spaces(spark):
    passage = "今天天气很好我们一起去公园散步吧。公园里有很多花和树还有小鸟在唱歌。孩子们在草地上跑来跑去非常开心。"
    texts = ["第一篇文章的开头部分在这里写着一些话。" + passage, passage + "第二篇文章的结尾部分也写着别的一些话。", "ไม่มีอะไรซ้ำ"]
    got = {r["doc_id"]: r for r in sd.deduplicate(docs(spark, *texts)).collect()}
    assert got[1]["text"] == "第二篇文章的结尾部分也写着别的一些话。" and got[0]["text"] == texts[0] and got[2]["text"] == texts[2]
    assert all("".join(sd.sentences(t)) == t for t in [*texts, passage * 9, passage.replace("。", "")])


def test_runs_hold_several_sentences_and_enough_words():
    text = "One two three. Four five. " + " ".join(f"w{k}" for k in range(18)) + ". Last one."
    found = sd.runs(text)
    assert found and all(n >= 2 for _, _, n in found)
    assert sd.runs("") == [] and sd.runs("Only a few words. Here.") == []
    brute = []
    own = [s.split() for s in sd.sentences(text)]
    for k in range(len(own)):
        for end in range(k + 2, len(own) + 1):
            if sum(map(len, own[k:end])) >= sd.WORDS:
                brute.append((k, end - k))
                break
    assert [(a, n) for _, a, n in found] == brute


def test_repeated_passages_keep_no_tail(spark):
    rng = random.Random(15)
    sentence = lambda n: prose(rng, n, 5000) + ". "
    passage = sentence(10) + sentence(10) + sentence(6)
    assert [(a, n) for _, a, n in sd.runs(passage)] == [(0, 2), (0, 3)]
    passages = [passage] + ["".join(sentence(rng.randrange(1, 14)) for _ in range(rng.randrange(2, 9))) for _ in range(12)]
    texts = [passage, passage]
    for _ in range(40):
        texts.append("".join(rng.choice(passages) if rng.random() < 0.6 else sentence(rng.randrange(1, 14)) for _ in range(6)))
    first, gone = {}, []
    for text in texts:  # every run there is
        own, drop = [s.split() for s in sd.sentences(text)], set()
        for a in range(len(own)):
            for b in range(a + 2, len(own) + 1):
                run = tuple(map(tuple, own[a:b]))
                if sum(map(len, run)) >= sd.WORDS and first.setdefault(run, (len(gone), a)) != (len(gone), a):
                    drop |= set(range(a, b))
        gone.append("".join(s for k, s in enumerate(sd.sentences(text)) if k not in drop))
    got = {r["doc_id"]: r["text"] for r in sd.deduplicate(docs(spark, *texts)).collect()}
    assert got[1] == "" and [got[k] for k in range(len(texts))] == gone


# ---- URLs --------------------------------------------------------------------------------


def test_glob_automaton_matches_regex():
    rng = random.Random(9)
    globs = [uf.Glob(p, "block") for p in ("a*b", "**b/a**", "?b*", "*", "ab", "*.a/b**", "", "b" * 70 + "**", "**" + "a" * 130)]
    texts = ["".join(rng.choice("ab./") for _ in range(rng.randrange(9))) for _ in range(600)] + ["b" * 71, "a" * 131, "b" * 69, "é/b/a"]
    made = [re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|\?|.", g.pattern))) for g in globs]
    got = uf.Automaton.of(globs).run([t.encode() for t in texts])
    for t, row in zip(texts, got):
        assert row.tolist() == [bool(m.fullmatch(t)) for m in made], t


def test_url_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "https://x.com/de/#q": ("x.com", "/de/", "com/de/", "block"), "https://x.org": ("x.org", "", None, "allow"),
        "https://com/fr/": ("com", "/fr/", "com/fr/", "allow"), "//x.org/a": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "https://adult-x.net/a": ("adult-x.net", "/a", None, "block"), "https://x.net/a.org/es/": ("x.net", "/a.org/es/", None, "allow"), "https://x.org/" + "y" * 50_000: ("x.org", "/" + "y" * 50_000, "org/", "allow"),
        "http://x.org?a=://b.com/de/": ("x.org", "", None, "allow"), "http://ÄB.ORG/É": ("Äb.org", "/É", "org/", "allow"),
    }
    rows = [(k, u) for k, u in enumerate(cases)] * 2
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = uf.judge(table, [uf.site_rule(*r) for r in URL_RULES]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(cases.values())[r["page_id"]]
    assert uf.judge(table.limit(0), []).count() == 0


def test_url_canonical_form():
    cases = {
        (b"x.org", b""): (b"x.org", b"/"), (b"x.org", b"/a/../b/./c"): (b"x.org", b"/b/c"), (b"x.org", b"/../../a//b/"): (b"x.org", b"/a/b/"),
        (b"u:p@x.org:8080", b"/"): (b"x.org", b"/"), (b"x.org.:443", b"/%61%2Fb"): (b"x.org", b"/a%2fb"), (b"x%2Eorg", b"/%2e%2e/a"): (b"x.org", b"/a"),
        (b"c%41sino.com", b"/%zz"): (b"casino.com", b"/%zz"), (b"", b""): (b"", b"/"), (b"x.org", b"/a/.."): (b"x.org", b"/"), (b"x.org", b"/a/b/.."): (b"x.org", b"/a/"),
    }
    for site, plain in cases.items():
        assert uf.canonical(*site) == plain and uf.canonical(*plain) == plain, site


def test_url_defaults_by_word(spark):
    cases = {
        "https://casinos-history.edu/a": "allow", "https://history.example.net/adult/poker": "allow", "https://best-casino.com": "block", "http://bestcasino.com:80/x": "block",
        "https://www.poker.example.net/": "block", "https://pokery.net/": "allow", "https://m.freeporn.tv": "block", "https://c%61sino.com/": "block", "https://x.porn": "block",
        "https://adult@x.net/": "allow", "https://essex.ac.uk/": "allow", "https://casino.state.gov./": "allow", "none": "allow",
    }
    table = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in uf.judge(table, []).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_url_rule_tables(spark):
    sites = [(("block", "allow")[k % 2], f"h{k}.net", f"/p{k}/") for k in range(400)] + [("allow", "h7.net", None), (None, "h8.net", "/"), ("block", None, None)]
    rules = spark.createDataFrame(sites * 2, "verdict string, host string, path string").withColumn("name", F.lit(1))
    urls = [f"http://a.h{k}.net/p{k}/x" for k in range(400)] + [f"http://h{k}.net/p/" for k in range(10)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in uf.judge(pages, rules, defaults=(), otherwise="none").collect()}
    assert [got[k] for k in range(400)] == [(f"h{k}.net/p{k}/", ("block", "allow")[k % 2]) for k in range(400)]
    assert [got[400 + k] for k in range(10)] == [("h7.net", "allow") if k == 7 else (None, "none") for k in range(10)]
    wild = spark.createDataFrame([("block", "*/[0-]?.html", "digits"), ("block", "", "empty"), ("allow", "*.h1.net/**", None)], "verdict string, pattern string, name string")
    pages = spark.createDataFrame([(0, "http://a.b/-x.html"), (1, "http://a.b/1x.html"), (2, "http://a.b/0/.html"), (3, "http://h1.net/a*b")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in uf.judge(pages, wild, otherwise="none").collect()}
    assert got == {0: ("digits", "block"), 1: (None, "none"), 2: (None, "none"), 3: (None, "allow")}
    starred = uf.judge(pages, [uf.site_rule("block", "h1.net", "/a*b"), uf.site_rule("block", "net", "/a?b")]).where("rule is not null").collect()
    assert [(r["page_id"], r["rule"]) for r in starred] == [(3, "h1.net/a*b")]
    assert uf.rule_table(rules.limit(0)) == []


# ---- quality, language, licenses ---------------------------------------------------------


def test_quality_on_held_out_rows(spark, small):
    table, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = ql.judge(table, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95 and ((got.score >= 0) & (got.score <= 1)).all()
    assert (got.predicted == (got.score >= 0.7)).all()


def test_quality_edges(spark):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(40)] + [(1, None, 1), (None, 1, 1), (3, 7, 0)], "doc_id long, quality int, toxic int")
    texts = [("Plain words stand here. " * 5) if k % 2 else ("BUY!! NOW!! " * 9) for k in range(40)] + [None, "", "word " * 200_000]
    table = docs(spark, *texts, None, ids=[*range(43), None]).withColumn("score", F.lit("x")).withColumn("quality", F.lit(9))
    got = {r["doc_id"]: r for r in ql.judge(table, labels).collect()}
    assert len(got) == 44 and got[40]["score"] == got[41]["score"] == got[None]["score"] and got[None]["held_out"] is False
    assert all(got[k]["predicted"] == k % 2 for k in range(40))
    assert {k for k in range(43) if got[k]["held_out"]} == {k for k in range(43) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert {r["score"] for r in ql.judge(table, labels.limit(0)).collect()} == {0.5}
    assert ql.judge(table.limit(0), labels).count() == 0


def test_quality_cut_is_the_quantile_of_all_documents(spark):
    rng = random.Random(16)
    good = lambda: "A calm sentence, with words. " + prose(rng, rng.randrange(20, 90), 10**9)
    bad = lambda: "BUY!!! $$$ " + prose(rng, 8).upper() + "!" * rng.randrange(1, 30)
    texts = [good() if k % 2 else bad() for k in range(200)] + [good() for _ in range(600)]  # a hot source without labels
    table = docs(spark, *texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    ranking = ql.train(table, labels, sample_rows=40)
    share = labels.where(~ql.held_out(F.col("doc_id"))).agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0]
    raw = np.stack([ql.features(t) for t in texts]) @ ranking.weights
    assert np.isclose(ranking.threshold, np.quantile(raw, share))
    rejected = ql.judge(table, labels, sample_rows=40).where("predicted = 0").count()
    assert rejected == (raw < ranking.threshold).sum() and abs(rejected - share * len(texts)) <= 1
    values = [rng.choice([rng.random(), 0.25, 1e-300 * rng.random()]) for _ in range(501)]
    column = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.0, 0.1, 0.333, 0.5, 0.77, 1.0):
        assert np.isclose(ql.exact_quantile(column, "v", q), np.quantile(values, q), rtol=1e-12, atol=0)
    assert ql.exact_quantile(column.limit(0), "v", 0.5) is None


def test_pairs_rank_preferred_first():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    good = x[:, 0] - 0.5 * x[:, 1] > 0
    ranking = ql.fit_pairs(x, good)
    assert ranking.weights[0] > 0 > ranking.weights[1] and ((ranking.score(x) >= 0.7) == good).mean() > 0.95
    assert ql.fit_pairs(x, np.ones(200, bool)) is None


def test_language_on_held_out_rows(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    got = li.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark):
    en, de = "the cat and the dog were in the house with a friend ", "der hund und die katze sind nicht auf dem großen haus "
    rows = [(k, (en if k % 2 else de) * 3, "en" if k % 2 else "de", "s", 1) for k in range(60)]
    rows += [(60, None, "en", "s", 1), (61, "", None, "s", 1), (62, "123 ²³ !?", "de", "s", 1), (63, en * 30_000, None, "s", 1), (64, en * 4 + de, None, None, None), (64, en * 4 + de, None, None, None), (None, de, "xx", "s", 1)]
    table = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)).withColumn("words", F.lit(2))
    got = li.identify(table).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == ("en" if k % 2 else "de") for k in range(60))
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (60, 61, 62))
    assert by[63]["lang_pred"] == by[64]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and 0.5 < by[64]["score"] < 0.95
    assert {r["lang_pred"] for r in li.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert li.identify(table.limit(0)).count() == 0


def test_forward_backward_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    score, moves = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    lengths, ids = np.array([5, 3, 1]), rng.integers(0, 6, 9)
    chance, pairs = li.forward_backward(score, ids, lengths, moves)
    want, want_pairs, at = [], np.zeros((3, 3)), 0
    for n in lengths:
        own, mass, both = ids[at : at + n], np.zeros((n, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            p = np.exp(sum(score[w, y] for w, y in zip(own, path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                mass[t, y] += p
            for a, b in zip(path, path[1:]):
                both[a, b] += p
        want.append(mass / mass.sum(1, keepdims=True))
        want_pairs += both / mass[0].sum()
        at += n
    assert np.allclose(chance, np.concatenate(want)) and np.allclose(pairs, want_pairs)


def test_licenses(spark):
    gpl3, gpl2 = ls.TEMPLATES[8].text, ls.TEMPLATES[7].text
    long_mit = ls.TEMPLATES[3].text
    texts = [
        "Some text.\nReleased under the MIT License.\nMore text.", f"Intro\n{gpl3}", gpl2, "RELEASED  UNDER THE MIT LICENSE", "A driving licence is needed here.", None, "",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "word " * 100_000 + "\n" + long_mit.replace(", and to permit", ",\nand to permit"), "no cue at all " * 50,
        "Licensed under the Apache License, Version 1.1.", "Released under the MIT License.\n\nLicensed under CC BY-SA 4.0.",
    ]
    want = [["MIT"], ["GPL-3.0"], ["GPL-2.0"], ["MIT"], [], [], [], ["CC-BY-NC-4.0"], ["CC-BY-4.0"], ["MIT"], [], [], ["CC-BY-SA-4.0", "MIT"]]
    table = docs(spark, *texts, texts[0], ids=[*range(len(texts)), 0]).withColumn("licenses", F.lit(1)).withColumn("matches", F.lit(1))
    got = ls.scan(table).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r["licenses"] == want[r["doc_id"]], texts[r["doc_id"]] and texts[r["doc_id"]][:60]
        for m in r["matches"]:
            assert m["reduction"] > 0 and set(m["missing"]) <= set(ls.words(" ".join(t.text for t in ls.TEMPLATES)))
    first = next(r for r in got if r["doc_id"] == 0)["matches"][0]
    assert texts[0][first["start"] : first["start"] + first["length"]] == "Released under the MIT License." and first["added"] == first["missing"] == []
    assert ls.scan(table.limit(0)).count() == 0


def test_licenses_in_long_lines():
    rng = random.Random(12)
    scanner = ls.Scanner()
    for k in (0, 5, 3):
        notice, name = ls.TEMPLATES[k].text, ls.TEMPLATES[k].name
        for size in (1_000, 2_000, 8_000, 20_000):  # up to 100 KB in one line
            before, after = prose(rng, size // 2), prose(rng, size // 2)
            found = scanner.scan(f"{before} {notice} {after}")[1]
            assert [m["license"] for m in found] == [name]
            if size > 1_000:
                cut = f"{before} {notice} {after}"[found[0]["start"] : found[0]["start"] + found[0]["length"]]
                assert ls.words(cut) == ls.words(notice)
    line = f"{prose(rng, 9000)} {ls.TEMPLATES[0].text} {prose(rng, 20)} {ls.TEMPLATES[6].text} {prose(rng, 9000)}"
    assert [m["license"] for m in scanner.scan(line)[1]] == ["MIT", "Apache-2.0"]
    assert scanner.scan("x" * 50_000 + " Released under the MIT License. " + "y" * 50_000)[1][0]["license"] == "MIT"
    assert scanner.scan("the licence of a driver " * 5_000)[1] == []


def test_licenses_in_long_wrapped_paragraphs():
    rng = random.Random(13)
    scanner = ls.Scanner()
    wrapped = lambda text, width: "\n".join(textwrap.wrap(text, width))
    for k in (3, 9, 10, 14, 20):  # MIT, GPL 3 and 2, ISC, Unlicense
        notice, name = ls.TEMPLATES[k].text, ls.TEMPLATES[k].name
        for lead in range(1_200, 2_500, 100):  # the notice comes near the end of what an earlier cue's piece holds
            text = "Copyright by nobody.\n" + wrapped(prose(rng, lead // 4), 70)[:lead] + "\n" + wrapped(notice, 30) + "\n" + wrapped(prose(rng, 1_000), 70)
            found = scanner.scan(text)[1]
            assert [m["license"] for m in found] == [name], lead
            assert ls.words(text[found[0]["start"] :])[: len(ls.words(notice))] == ls.words(notice)
    bsd = ls.TEMPLATES[13].text
    for text in (bsd.replace(" and use", "\n * and use"), wrapped(prose(rng, 1_000), 70) + "\n" + bsd.replace("and use", "and\n * use")):
        assert [m["license"] for m in scanner.scan(text)[1]] == ["BSD-2-Clause OR BSD-3-Clause"]  # the sentence that both share


def named(scanner, text):
    return sorted({m["license"] for m in scanner.scan(text)[1]})


def test_every_notice_of_a_line_is_named_whatever_its_length():
    scanner, rng = ls.Scanner(), random.Random(14)
    notices = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    for more in (0, 100, 1_000, 2_300, 2_500, 2_800, 9_000):
        assert named(scanner, f"{notices} {prose(rng, more // 4)}"[: len(notices) + more]) == ["Apache-2.0", "MIT"], more


def test_licenses_with_one_opening_are_told_apart():
    scanner = ls.Scanner()
    opening = next(t.text for t in ls.TEMPLATES if t.name == ls.FAMILY[0])
    second, third = (next(t.text for t in ls.TEMPLATES if t.name == n) for n in ls.FAMILY[1:])
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    for gap in ("\n", "\n\n", " "):
        assert named(scanner, gap.join([opening, source, second])) == ["BSD-2-Clause"]
        assert named(scanner, gap.join([opening, source, second, third])) == ["BSD-3-Clause"]
    assert named(scanner, opening) == ["BSD-2-Clause OR BSD-3-Clause"]
    far = "\n\n".join([opening, second, "Text. " * 400, opening, third])
    assert [m["license"] for m in scanner.scan(far)[1]] == ["BSD-2-Clause"] * 2 + ["BSD-3-Clause"] * 2


def test_denied_licenses_are_none():
    scanner = ls.Scanner()
    for text in ("This project is not released under the MIT License.", "It is never\nlicensed under the Apache License, Version 2.0.", "This isn't licensed under CC BY 4.0."):
        assert named(scanner, text) == [], text
    assert named(scanner, "We do not track you. Released under the MIT License.") == ["MIT"]


def test_each_template_names_itself():
    scanner = ls.Scanner()
    for t in ls.TEMPLATES:
        assert t.name in named(scanner, f"Some words before.\n{t.text}\nSome after."), t.text


# ---- names and sizes ---------------------------------------------------------------------

HELPERS = ["__id", "__hash", "__doc", "__gone", "__n_lines", "__n_removed", "__score", "text_hash", "doc", "line", "pos", "row", "digest"]


def test_columns_with_names_of_helpers_stay(spark):
    rng = random.Random(17)
    common = "This line is on every site of the whole web."
    texts = [f"{prose(rng, 40)}\n{common}\n{prose(rng, 30)}" for _ in range(20)] + [None, "", common]
    texts += [texts[3], texts[3] + " x"]
    table = docs(spark, *texts).withColumn("source", F.concat(F.lit("s"), "doc_id"))
    table = table.withColumns({c: F.concat(F.lit(f"{c}-"), "doc_id") for c in HELPERS})
    items = spark.createDataFrame([(1, " ".join(texts[5].split()[:20]))], "item_id long, text string").withColumn("__id", F.lit(3))
    plain = table.select("doc_id", "text", "lang", "source", "n_chars")
    for apply in (lambda d: ld.deduplicate(d, counts=("lines_", "removed_")), mh.deduplicate, lambda d: dc.decontaminate(d, items)):
        got, want = apply(table), apply(plain)
        rows = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
        assert got.columns[: len(table.columns)] == table.columns and rows(got) == rows(want)
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in got.collect() for c in HELPERS)


def test_many_removed_lines_take_linear_time(spark):
    import time

    def seconds(lines):
        common = [f"line number {k} of the boilerplate" for k in range(lines)]
        table = docs(spark, *["\n".join(common) + f"\nown {k}" for k in range(8)]).withColumn("source", F.concat(F.lit("s"), "doc_id"))
        start = time.time()
        got = ld.deduplicate(table).collect()
        assert all(r["__n_removed"] == lines and r["text"] == f"own {r['doc_id']}" for r in got)
        return time.time() - start

    seconds(100)
    few, many = seconds(4_000), seconds(40_000)
    assert many < 8 * few + 5
