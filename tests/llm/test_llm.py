"""The numbered operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from wayline.llm import chat_formatting, components, decontamination, ngram_join, packing, pii, quality_classifier, quality_rules, secret_scans, sharding, suffix_dedup

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
DOCS = "doc_id long, text string"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "word " * 3000), (6, "word " * 3000), (6, "word " * 3000), (None, "null id, some words here to read"), (7, "é" * 50_000), (8, "\x00zero\x00 byte"), (9, "日本語 のテキスト 🎉")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).withColumns({"ledger": F.lit("x"), "node": F.lit(1), "key": F.lit(2), "slot_": F.lit(3)})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def _digests(turns):
    conv = collections.defaultdict(list)
    for c, t, r, x in turns:
        conv[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, v in conv.items():
        v.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in v)
        loss = "".join(x for _, _, r, x in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    random.seed(1)
    bits = ["</turn>", "### User: ", "\\", "#", "<", "/turn>", "\n", "a: b", "=", "é🎉", " ", "word " * 30]
    turns = []
    for c in range(40):
        for t in range(random.randint(1, 12)):
            turns.append((c, t, random.choice(["system", "user", "assistant", "Tool:x", "", None, "###\n"]), None if random.random() < 0.1 else "".join(random.choices(bits, k=random.randint(0, 8)))))
    turns += [(None, 0, "user", "x"), (50, None, "assistant", "first"), (50, 0, "assistant", "dup"), (50, 0, "assistant", "dup")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    for p in (chat_formatting.Params(), chat_formatting.Params(budget=120, history=40)):
        w = chat_formatting.windows(df, p).cache()
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_formatting.digest(w).collect()}
        assert got == _digests(turns)
        room = "" if p.budget > 500 else " AND NOT contains(formatted, '### System')"  # a long system turn goes beyond a small budget
        assert w.where(f"n_turns > 1 AND n_tokens > {p.budget}{room}").count() == 0
    assert chat_formatting.digest(chat_formatting.windows(df.limit(0))).count() == 0


# 2


def test_quality_measures(spark, edge):
    got = quality_rules.ledger(edge, out="found").select("doc_id", "text", "found.*").collect()
    assert len(got) == len(EDGE)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert bool(r.failed & 1) == (len(w) < 10)
    assert quality_rules.filter_documents(empty(spark)).count() == 0


@here
def test_ledger_policies_and_ablation(docs):
    led = quality_rules.apply_policies(quality_rules.ledger(docs)).cache()
    base = led.where("kept_base").count()
    assert base >= led.where("kept_v1").count() >= led.where("kept_v2").count() > 0
    for r in quality_rules.ablation(led).collect():
        assert r.n_failed == led.where(F.col("ledger.failed").bitwiseAND(r.bit) != 0).count()
        assert r.n_failed_alone == led.where(F.col("ledger.failed") == r.bit).count()


# 3


def _brute_removal(rows, length):
    seen = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet", ["ab", "abc\x00", "aé"])
def test_two_stage_order(alphabet):
    random.seed(2)
    for n in (1, 2, 17, 300):
        t = "".join(random.choices(alphabet.replace("\x00", "d"), k=n)).encode() + b"\0"
        order = suffix_dedup.two_stage_suffix_array(np.frombuffer(t, np.uint8), 400)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("hot", [1, 400])
def test_repeated_bytes(spark, edge, hot):
    random.seed(4)
    passage = "".join(random.choices("abcdefgh ", k=150))
    rows = [(i, "".join(random.choices("xyz é", k=random.randint(0, 80))) + passage[: random.randint(20, 150)] + "".join(random.choices("xyz", k=random.randint(0, 60)))) for i in range(60)]
    rows += [(100, "ab" * 300), (101, rows[3][1]), (101, rows[3][1]), (102, None), (103, "")]
    p = suffix_dedup.Params(length=60, gram=12, hot=hot, piece=5)
    got = suffix_dedup.digest(suffix_dedup.remove(spark.createDataFrame(rows, DOCS), p)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_removal([(d, (t or "").encode()) for d, t in rows], 60)
    small = [(d, t[:1500] if t else t) for d, t in EDGE]
    got = suffix_dedup.digest(suffix_dedup.remove(spark.createDataFrame(small, DOCS))).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_removal([(d, (t or "").encode()) for d, t in small], 400)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove(edge).collect()}
    assert got[7] == (100_000, 100_000) and got[6] == (15_000, 15_000) and got[1] == (0, 0)
    assert suffix_dedup.remove(empty(spark)).count() == 0


def test_op3_keeps_only_minimizers_that_occur_again(spark, monkeypatch):
    """Most of what there was is gone before contexts are counted and joined."""
    rng, rows_of, real = random.Random(5), {}, suffix_dedup.materialize
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(700)
    rows = [(i, text(3000)) for i in range(20)] + [(20, text(500) + shared), (21, shared + text(500))]

    def counted(df, tag):
        out = real(df, tag)
        rows_of[tag] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", counted)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, n in got.items() if n} == {20, 21} and got[20] == got[21] >= 700
    assert 0 < rows_of["suffix-occurrences"] < 40


# 4


def test_tokens_are_the_library_s():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["Hello WORLD, it's <|endoftext|> 12 3.5 déjà-vu  ÀÉ\tfoo\x1fbar İ ΑΣ ß.", "", None, "é é don't. A, .. , . a., a,. ﬀ Ǆ ŉ", *[x for _, x in EDGE]]
    ids, at = packing.tokenize(pa.array(texts), packing.default_tokenizer())
    for text, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_packing(spark, edge):
    rows = packing.pack(edge, max_len=256, grain=8).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 256
    order = rows.sort_values(["sequence_id", "offset"])
    assert (order.offset == order.groupby("sequence_id").length.cumsum() - order.length).all()
    assert rows[rows.doc_id.isna()].length.sum() > 1
    one = rows[rows.doc_id == 5].sort_values("start")
    assert (one.start == one.length.cumsum() - one.length).all() and one.length.sum() == one.doc_tokens.iloc[0]
    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(packing.default_tokenizer()).encode(EDGE[4][1], add_special_tokens=False).ids, 1], "<u4")
    assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(one.start, one.length)] == one.ids_crc32.tolist()
    assert packing.pack(empty(spark)).count() == 0


def test_cutting_stock_meets_demand():
    rng = np.random.default_rng(0)
    demand = rng.integers(0, 200, 64)
    p = packing.plan(demand, 64)
    met = np.bincount(p.cls, p.after - p.first, minlength=64)
    assert (met == demand).all()
    units = (demand * np.arange(1, 65)).sum()
    assert p.sequences * 64 <= units * 1.03


@pytest.mark.parametrize("room,seed", [(12, 1), (64, 2), (512, 3)])
def test_cutting_stock_is_solved_to_its_bound(room, seed):
    """The value is within one sequence, or a ten-thousandth, of a bound that an exact solution confirms."""
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 300, room) * (rng.random(room) < (0.5 if room > 12 else 1))
    patterns, amount, bound = packing.column_generation(demand, room)
    size = np.arange(1, room + 1)
    assert (size @ patterns <= room).all() and (amount >= 0).all()
    assert np.abs(patterns @ amount - demand).max() < 1e-2  # the shift
    assert (demand @ size) / room <= amount.sum() + 1e-6
    assert amount.sum() - bound < max(1, 1e-4 * bound) and bound <= amount.sum() + 1e-2
    if room == 12:  # all patterns
        every = [[]]
        for c in range(room):
            every = [p + [k] for p in every for k in range((room - sum(x * (i + 1) for i, x in enumerate(p))) // (c + 1) + 1)]
        best, kept = np.array(every).T, packing.plan(demand, room)
        assert kept.sequences >= np.ceil(kept.bound - 1e-6)
        # feasible duals give no more than the value: try those of single classes and of the sizes
        for dual in (size / room, 1 / (room // size)):
            assert (dual @ best).max() > 0 and demand @ (dual / (dual @ best).max()) <= amount.sum() + 1e-2
    p = packing.plan(demand, room)
    assert p.sequences >= p.bound - 1e-6 and p.sequences <= p.bound * 1.02 + 8


def test_packing_holds_every_id(spark):
    from tokenizers import Tokenizer

    random.seed(14)
    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = {f"doc-{i}": " ".join(random.choices(["Hello", "world,", "ÉTÉ.", "x9_", "\n", "déjà-vu"], k=random.randint(0, 900))) for i in range(40)} | {None: "no id"}
    got = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), max_len=256).toPandas()
    for d, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id.isna() if d is None else got.doc_id == d].sort_values("start")
        assert (mine.doc_tokens == len(ids)).all() and mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]] and mine.length.sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    inside = got.sort_values(["sequence_id", "offset"])
    assert (inside.offset == inside.groupby("sequence_id").length.cumsum() - inside.length).all()
    with pytest.raises(ValueError):
        packing._tokenizer(packing.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k"))


def test_names_that_clash(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine TEN")], DOCS)
    df = df.withColumns({c: F.lit(c) for c in ("_ledger", "_id", "_gone", "_key", "_n", "_ways", "_deal", "n_shingles", "component_id")})
    assert quality_rules.filter_documents(df).columns == df.columns
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
    items = spark.createDataFrame([(0, "one two three four five six seven eight")], "item_id long, text string")
    assert decontamination.keep_clean(df, items).columns == df.columns
    placed = sharding.place(df, "doc_id", ["a", "b"], 101, spread="text")
    assert set(placed.columns) == {*df.columns, "slot", "shard"}
    with pytest.raises(ValueError):
        sharding.place(placed, "doc_id", ["a", "b"], 101)
    with pytest.raises(ValueError):
        quality_rules.ledger(df.withColumn("Ledger", F.lit(0)))
    sharding.write_shards(placed, str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.shard) for r in back.collect()) == sorted((r.doc_id, r.shard) for r in placed.collect())


def test_long_roles(spark):
    role = "r" * 50_000
    df = spark.createDataFrame([(1, 0, role, "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = chat_formatting.digest(chat_formatting.windows(df)).first()
    assert got.turns_sha256 == hashlib.sha256(f"{role}\nx\nassistant\ny\n".encode()).hexdigest()


# 5


def test_sharding(spark, edge):
    shards = [f"s{i}" for i in range(8)]
    table = sharding.build_table(shards, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.build_table(shards[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer)) < 1009 * 0.45
    got = sharding.place(edge, "doc_id", shards, 1009).select("doc_id", "slot", "shard").collect()
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, table[slot])
    hot = spark.range(0, 900).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', string(id)) AS k")
    spread = sharding.place(hot, "k", shards, 1009, spread="doc_id")
    assert spread.count() == 900 and spread.where("k = 'hot'").select("shard").distinct().count() > 1
    assert sharding.place(empty(spark), "doc_id", shards, 1009, spread="text").count() == 0
    with pytest.raises(ValueError):
        sharding.build_table(shards, 1000)


# 6


def test_ordinal_classifier(spark, edge):
    random.seed(6)
    words = {0: ["vile", "awful"], 1: ["%%%", "&&&"], 2: ["good", "fine"]}
    rows = [(i, " ".join(random.choices(["the", "of", "and", "it"], k=30) + random.choices(words[i % 3], k=2)), i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS + ", grade int")
    m = quality_classifier.fit(df.where("doc_id < 400"))
    assert (np.diff(m.thresholds) >= 0).all()
    r = quality_classifier.score(df.where("doc_id >= 400").drop("grade"), m).join(df, "doc_id").collect()
    assert np.mean([x.kept == (x.grade == 2) for x in r]) > 0.97
    assert np.mean([x.expected_grade for x in r if x.grade == 0]) < np.mean([x.expected_grade for x in r if x.grade == 1])
    assert quality_classifier.score(edge, m).count() == len(EDGE)
    assert quality_classifier.score(empty(spark), quality_classifier.fit(df.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables are not here")
def test_grades_held_out(spark):
    """Fitted on three quarters of the rated rows, read on the rest: better than the most common grade."""
    docs, rated = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rows = docs.join(rated, "doc_id").select("doc_id", "text", grade.alias("grade")).where("grade IS NOT NULL")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    r = quality_classifier.score(rows.where(held).drop("grade"), quality_classifier.fit(rows.where(~held))).join(rows, "doc_id").collect()
    right = np.mean([x.kept == (x.grade == 2) for x in r])
    most = max(np.mean([x.grade == 2 for x in r]), np.mean([x.grade != 2 for x in r]))
    assert len(r) > 60 and right >= 0.85 and right > most


def test_rated_texts_of_tables_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, 8, "y"), (3, "c", 9, "z")], "doc_id long, text string, grade int, quality string")
    rated = spark.createDataFrame([(1, 0), (2, 2), (3, None), (4, 1), (None, 1)], "doc_id long, grade int")
    assert sorted(quality_classifier.sample_rated(docs, rated).collect()) == [(1, "a b", 0), (2, None, 2)]


def test_features_of_whole_words():
    a, b = ("x" * 40 + "1" + end for end in ("a", "b"))  # alike but for their ends
    one, two = (set(quality_classifier.features(pa.array([t]), 17)[1].tolist()) for t in (a, b))
    assert one != two
    quality_classifier._cache.update(bits=None)
    assert one == set(quality_classifier.features(pa.array([a]), 17)[1].tolist())
    assert len(quality_classifier.features(pa.array(["", None]), 17)[1]) == 4


# 7


def test_decontamination(spark):
    items = [(0, "A train with 12 cars leaves Paris at noon and needs 3 hours for the 240 km to Lyon every day."), (1, "Plain words only make this question rather easy to find anywhere."), (2, "too short"), (3, None)]
    docs = [
        (0, "Intro text. " + items[0][1] + " More text."),
        (1, "A train with 15 cars leaves Rome at noon and needs 5 hours for the 300 km to Milan every day."),  # other parameters
        (2, "Nothing of the kind is in this document, which has its own words throughout."),
        (3, items[1][1].upper() + " ### "),
        (4, None),
        (5, ""),
        (6, "too short"),
        (None, items[1][1]),
        (7, "Plain words only then something else entirely and more of it."),
    ]
    d, b = spark.createDataFrame(docs, DOCS).withColumn("item", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    for p in (decontamination.Params(), decontamination.Params(broadcast_bytes=0)):
        got = {(r.doc_id, r.item_id): r.exact for r in decontamination.leaks(d, b, p).collect()}
        assert got == {(0, 0): True, (1, 0): False, (3, 1): True, (None, 1): True}
    assert sorted(r.doc_id for r in decontamination.keep_clean(d, b).collect()) == [2, 4, 5, 6, 7]
    bad = spark.createDataFrame([(9, "A train with 12 cars leaves Paris at noon and needs 3 hours for the 240 km to Lyon every day. A train with 13 cars leaves Rome at noon and needs 4 hours for the 241 km to Nice every day.")], DOCS)
    assert [(r.doc_id, r.item_id, r.exact) for r in decontamination.leaks(bad, b).collect()] == [(9, 0, True)]  # the copy counts, whatever stands beside it
    assert decontamination.leaks(empty(spark), b).count() == decontamination.leaks(d, b.limit(0)).count() == 0


def test_decontamination_by_alignment(spark):
    twice = "A train travels 60 km in 2 hours. Another train travels 80 km in 3 hours. How far apart are both of them then?"
    once = "A train with 12 cars leaves Paris at noon and needs 3 hours for the 240 km to Lyon every day."
    other = "A train with 13 cars leaves Rome at noon and needs 4 hours for the 241 km to Nice every day."
    third = "A train with 15 cars leaves Oslo at noon and needs 6 hours for the 301 km to Bergen every day."
    same = "Each of 3 boxes holds 3 red pens and 3 blue pens, so how many pens of any colour are there?"
    docs = [
        (0, twice),  # the item repeats a template with other values
        (1, "Intro. " + twice + " More."),
        (2, once + " " + other),  # a variant beside the copy
        (3, other + " Filler between them. " + third),  # two variants, no copy
        (4, other + " " + once.replace("at noon", "right at noon") + " " + third),  # a word put in
        (5, once + " In other news, the cat with 7 cars leaves Rome at noon and needs rest."),
        (6, same.replace("3 boxes", "4 boxes").replace("3 blue", "5 blue")),  # one slot, three values in one alignment
        (7, "filler words " * 500 + twice + " filler words" * 500 + " " + twice.replace("60", "61")),
        (None, once),
        (None, other),  # the same shift in another text of the same id
    ]
    d = spark.createDataFrame(docs, DOCS)
    b = spark.createDataFrame([(0, twice), (1, once), (2, same)], "item_id long, text string")
    for p in (decontamination.Params(), decontamination.Params(broadcast_bytes=0)):
        got = {(r.doc_id, r.item_id): (r.exact, r.n_found, r.n_windows) for r in decontamination.leaks(d, b, p).collect()}
        assert {k: v[0] for k, v in got.items()} == {(0, 0): True, (1, 0): True, (2, 1): True, (3, 1): False, (4, 1): True, (5, 1): True, (7, 0): True, (None, 1): True}
        assert all(found == windows for k, (_, found, windows) in got.items() if k != (4, 1))
    assert [r.doc_id for r in decontamination.keep_clean(d, b).collect()] == [6]


def test_reparameterised_items_are_found(spark):
    random.seed(7)
    names, filler = ["Anna", "Bruno", "Clara", "Diego", "Elena", "Farid"], [f"word{i}" for i in range(400)]
    shapes = ["In the town of {n} there are {a} shops and each of them sells {b} apples for {c} dollars every morning.", "When {n} walks {a} km in {b} hours and rests for {c} minutes, how fast did the whole trip go on average?", "A box made by {n} holds {a} red and {b} blue marbles, so what is the chance to draw {c} red ones in a row?"]
    fill = lambda i: shapes[i % 3].format(n=random.choice(names), a=random.randint(2, 99), b=random.randint(2, 99), c=random.randint(2, 99))
    items = [(i, fill(i)) for i in range(3)]
    noise = lambda k: " ".join(random.choices(filler, k=k))
    docs = [(i, f"{noise(30)}. {fill(i)} {noise(30)}") for i in range(120)] + [(1000 + i, noise(80)) for i in range(120)]
    for p in (decontamination.Params(), decontamination.Params(broadcast_bytes=0)):
        found = decontamination.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), p)
        if not p.broadcast_bytes:
            assert "SortMergeJoin" in found._jdf.queryExecution().toString()
        got = {(r.doc_id, r.item_id) for r in found.collect()}
        assert len(got & {(i, i % 3) for i in range(120)}) >= 0.9 * 120 and all(d < 1000 for d, _ in got)


# 8


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_secrets(spark, edge):
    random.seed(8)
    bits = ["password", "TOKEN", "api_key", "apikey", "Secret", ":", "=", " ", '"', "'", "abc", "x" * 7, "AKIA", "AKIAAKIA", "Z9" * 10, "0123456789abcdef" * 2, "é🎉", "\n", "-", "."]
    rows = EDGE + [(100 + i, "".join(random.choices(bits, k=random.randint(1, 30)))) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    got = secret_scans.detect(df).join(df.dropDuplicates(["doc_id"]).withColumnRenamed("text", "t"), "doc_id").collect()
    for r in got:
        assert [tuple(s) for s in r.base] == _base_secrets(r.t or "")
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rnd = [(i, "key " + "".join(random.choices(alphabet, k=40)) + " end") for i in range(60)]
    calm = [(100, "com-foo-Bar_baz-Quux-2020-edition-Something"), (101, "A" * 30 + "1"), (102, "Donaudampfschifffahrtsgesellschaft2"), (103, "0123456789" * 4)]
    out = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in secret_scans.detect(spark.createDataFrame(rnd + calm, DOCS)).collect()}
    assert sum(bool(out[i]) for i in range(60)) >= 54 and not any(out[i] for i in range(100, 104))
    red = {r.doc_id: r.text for r in secret_scans.redact(df).collect()}
    assert red[4] == "one" and red[2] == ""
    assert secret_scans.digest(secret_scans.detect(empty(spark))).count() == 0


def test_battery_by_encoding(spark):
    random.seed(18)
    kinds = {"hex upper": "0123456789ABCDEF", "base 32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": "abcdefghijklmnopqrstuvwxyz0123456789", "base 64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    rows = [(1000 * i + j, f"a line with {''.join(random.choices(alphabet, k=48))} in it") for i, alphabet in enumerate(kinds.values()) for j in range(60)]
    words = ["data", "Center", "north", "Alpha", "river", "2020", "Edition", "stone", "paper", "09"]
    rows += [(9000 + i, "see " + "-".join(random.choices(words, k=6))) for i in range(120)]
    out = {r.doc_id: sum(s.kind == 3 for s in r.spans) for r in secret_scans.detect(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(sum(out[1000 * i + j] for j in range(60)) >= 54 for i in range(4))  # of 60 for each encoding
    assert sum(out[9000 + i] for i in range(120)) <= 6


def test_long_texts_and_redaction(spark):
    random.seed(19)
    token = "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=200_000))
    many = "é password=abcdef " * 5_000
    df = spark.createDataFrame([(1, token), (2, many), (3, None), (4, "x" * 300_000 + "1")], DOCS).withColumn("_new", F.lit(1))
    began = time.time()
    got = {r.doc_id: r for r in secret_scans.detect(df).collect()}
    assert [tuple(s) for s in got[2].base] == _base_secrets(many)
    red = secret_scans.redact(df)
    assert red.columns == df.columns
    red = {r.doc_id: r.text for r in red.collect()}
    assert red[2] == "é [SECRET] " * 5_000 and red[3] is None and red[4] == "x" * 300_000 + "1"
    assert time.time() - began < 60


# 9


PLAIN = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base_personal(t):
    email, ip, card, phone = PLAIN
    out = [("email", *m.span()) for m in email.finditer(t)]
    out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and _luhn(d)]
    return out + [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_by_plain_patterns():
    random.seed(9)
    bits = ["a", "b.", "@", ".", "1", "22", "256", "0", "-", " ", "x@y.z", "%", "+", "(at)", "[dot]", "(", "1.2.3.4", "é", "4111 1111 1111 1111", "+1 614 555 80"]
    for _ in range(4000):
        t = "".join(random.choices(bits, k=random.randint(0, 25)))
        assert pii.base_spans(t) == _base_personal(t)
    began = time.time()
    for t in ("a" * 1_000_000 + " x@y.z", "9" * 1_000_000 + " 1.2.3.4", "a.b@c.de 555-123-4567 " * 50_000, "a(at)" * 200_000):
        pii.candidates(t, pii.base_spans(t))
    assert time.time() - began < 20


def test_added_kinds_are_found(spark):
    """Labelled spans of every added kind with a fitting context, decoys without: recall 0.9, few decoys."""
    random.seed(29)
    digits = lambda k: "".join(random.choices("0123456789", k=k))

    def iban():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    make = {
        "email_spelled": lambda: f"mail me: joe{digits(2)} (at) site{digits(2)}.com today",
        "ipv6": lambda: "from host " + ":".join(random.choices(["2001", "db8", "85a3", "8a2e", "7334", "1f"], k=8)) + " again",
        "phone_local": lambda: f"call ({random.randint(200, 999)}) 555-{digits(4)} now",
        "iban": lambda: f"account {iban()} please",
        "ssn": lambda: f"ssn {random.randint(100, 599)}-{random.randint(10, 99)}-{random.randint(1000, 9999)} on file",
    }
    rows = [(1000 * i + j, f()) for i, f in enumerate(make.values()) for j in range(50)]
    rows += [(8000 + j, f"order {random.randint(900, 999)}-00-{digits(4)} part DE00{digits(16)}x") for j in range(50)]
    rows += [(9000 + j, f"joe{j}@site{j}.com wrote from 10.1.{j}.7 about card 4111 1111 1111 1111") for j in range(100)]
    found, _ = pii.detect(spark.createDataFrame(rows, DOCS))
    got = {r.doc_id: {pii.KINDS[s.kind] for s in r.spans} for r in found.collect()}
    for i, kind in enumerate(make):
        assert sum(kind in got[1000 * i + j] for j in range(50)) >= 45, kind
    assert sum(bool(got[8000 + j] - set(pii.BASE_KINDS)) for j in range(50)) <= 5


def test_personal_data(spark, edge):
    text = "Mail jo.81@mail7.example.com, or call +1 (614) 555-8001; host 192.168.0.1, not 1.2.3.256; card 4111 1111 1111 1111 but not 4111 1111 1111 1112."
    rows = [(i, text) for i in range(30)] + [(50, "9" * 6000), (51, "1.2.3.4.5"), (52, "+12"), *EDGE]
    found, model = pii.detect(spark.createDataFrame(rows, DOCS))
    got = {r.doc_id: r for r in pii.digest(found).collect()}
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 1, 1)
    spans = ",".join(f"{k}:{text.index(x)}:{text.index(x) + len(x)}" for k, x in (("email", "jo.81@mail7.example.com"), ("ip", "192.168.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (614) 555-8001")))
    assert got[0].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert got[0].spans.startswith("email") and set(spans.split(",")) <= set(got[0].spans.split(","))
    assert got[51].n_ip == 1 and got[52].n_phone == 0 and got[2].spans == ""
    assert (model.reliability > 0).all() and len(pii.digest(pii.detect(edge)[0]).collect()) == len(EDGE)
    assert pii.digest(pii.detect(empty(spark))[0]).count() == 0


# 10


def _brute_groups(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(x), find(d)) for d, x in sets)


@pytest.mark.parametrize("small", [2, 8])
def test_similarity_join(spark, small):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, passage = random.choices(vocabulary, k=60), random.choices(vocabulary, k=40)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(random.randint(0, 3)):
            w[random.randrange(60)] = random.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(120, 250):
        w = random.choices(vocabulary, k=random.randint(5, 60))
        rows.append((i, " ".join([*w[:4], *passage, *w[4:]])))
    rows += [(i, " ".join(random.choices(vocabulary[:4], k=random.randint(0, 9)))) for i in range(250, 350)]
    rows += [(400, None), (3, "Own other text of id three with words"), (401, "own other TEXT of id three with words"), (402, "É é"), (403, "é é")]
    r, _, roots = ngram_join.join(spark.createDataFrame(rows, DOCS).withColumn("node", F.lit(0)), ngram_join.Params(small=small, block=40, star=16))
    assert sorted(tuple(x) for x in ngram_join.group_ids(r, roots).collect()) == _brute_groups(rows)


def test_similarity_join_edges(spark, edge):
    r, _, roots = ngram_join.join(edge)
    got = [tuple(x) for x in ngram_join.group_ids(r, roots).collect()]
    assert len(got) == len(EDGE) and {(6, 1, 5), (1, 0, 1), (None, 3, None)} <= set(got)
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns and 6 not in {x.doc_id for x in kept.collect()}
    r, _, roots = ngram_join.join(empty(spark))
    assert ngram_join.group_ids(r, roots).count() == 0


def test_component_stars(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 50), (70, 70)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 60: 50}


# the pipeline


@here
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    said = "Some plain words stand before password=hunter22 and after that password: abc123, which nobody should read again here."
    more = spark.createDataFrame([(900_001, said, "en", "web", len(said))], docs.schema)
    folder = str(tmp_path)
    docs.unionByName(more).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    judged = corpus_pipeline.quality(spark, docs, SF)
    assert judged.columns == docs.columns
    led = {r.doc_id: r.failed for r in quality_rules.ledger(docs).select("doc_id", "ledger.failed").collect()}
    assert ids(judged) == {d for d, f in led.items() if f == 0}
    left = sorted(ids(judged))
    groups = _brute_groups([(d, texts[d]) for d in left])
    assert ids(corpus_pipeline.near_duplicates(spark, judged, SF)) == {d for d, _, g in groups if d == g}
    heads = {d for d, _, g in groups if d == g}
    leaky = {r.doc_id for r in decontamination.leaks(docs, bench).collect()}
    assert {d for d in heads for i in bench.collect() if i.text in texts[d]} <= leaky
    stay = heads - leaky
    assert len(stay) > 0.5 * len(heads)
    # redaction and packing by plain Python
    spans = {r.doc_id: sorted((s.start, s.stop) for s in r.spans) for r in secret_scans.detect(docs.where(F.col("doc_id").isin(list(stay)))).collect()}
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(packing.default_tokenizer()), {}
    for d in stay:
        text, at, parts = texts[d] or "", 0, []
        for a, b in spans[d]:
            if a >= at:
                parts += [text[at:a], "[SECRET]"]
            at = max(at, b)
        ids = np.array([*t.encode("".join([*parts, text[at:]]), add_special_tokens=False).ids, 1], "<u4")
        want[d] = [zlib.crc32(ids[s : s + 2048].tobytes()) for s in range(0, len(ids), 2048)]
    out = corpus_pipeline.run(spark, folder)
    got = collections.defaultdict(list)
    for r in out.orderBy("doc_id", "start").collect():
        got[r.doc_id].append(r.ids_crc32)
    assert got == want and len(spans[900_001]) == 2
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
