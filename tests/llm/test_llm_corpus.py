"""Near duplicates, repeated passages, decontamination, chat, nearest vectors, pipeline: against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholium.llm import chat_format, decontamination, near_dedup, nearest, substring_dedup
from scholium.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, node string, label string, n_chars bigint"


def words(text):
    return (text or "").encode().split()


def shingles(text, size):
    w = words((text or "").lower()) if text and text.isascii() else [x.lower() for x in words(text)]
    if not w:
        return frozenset()
    k = min(size, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def groups(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


@pytest.fixture(scope="module")
def family(spark):
    """A source, many copies with changed words, chains of links, exact copies, short and empty texts."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(220)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base if i % 3 else rows[-1][1].split())
        for _ in range(rng.randrange(14)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(60, rows[5][1].upper()), (61, None), (62, ""), (63, " \n"), (64, "two words"), (65, "Two\twords"), (66, "one")]
    rows += [(67, " ".join(base[:110])), (68, " ".join(base[:100]))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", None, 1) for d, t in rows], SCHEMA)


def test_near_duplicates_equal_brute_force(spark, family):
    for size, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(frame(spark, family), size, percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(family, size, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(frame(spark, family).limit(0)).count() == 0
    twice = near_dedup.near_duplicates(frame(spark, [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "p q r")])).collect()
    assert len(twice) == 4 and {r.component_id for r in twice if r.doc_id == 2} == {1}


def test_one_of_each_with_two_texts_under_one_id(spark):
    copy, clean, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "acz")
    rows = [
        (3, copy), (7, copy + " more"), (7, clean), (8, clean.upper()), (9, other), (9, other + " b"), (9, other),
        (9, "entirely different words here"), (10, None), (10, ""), (11, "one"), (11, "one"),
    ]
    left = near_dedup.one_of_each(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    # of 10, whose texts have no words, one row; of 9's near copies the first text, and the other text
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        [(3, copy), (7, clean), (9, other), (9, "entirely different words here"), (10, ""), (11, "one")], key=str)


def test_rows_without_an_id_are_linked(spark):
    copy, clean = (" ".join(f"{c}{i}" for i in range(60)) for c in "ac")
    rows = [(None, copy), (3, copy + " more"), (4, copy + " and"), (None, clean), (None, clean), (None, clean + " x"), (None, None), (None, ""), (5, "")]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(None, 3, False), (3, 3, True), (4, 3, False), *[(None, None, True)] * 5, (5, 5, True)], key=str)
    left = near_dedup.one_of_each(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        [(3, copy + " more"), (None, clean), (None, None), (None, ""), (5, "")], key=str)


def test_repeated_rows_are_verified_once(spark, monkeypatch):
    """Many rows of one id and text are one text: 60 of each side give one pair."""
    seen = []
    whole = near_dedup.similarities

    def counting(pairs, texts, size):
        out = near_dedup.store(whole(pairs, texts, size))
        seen.append((out.count(), texts.count()))
        return out

    monkeypatch.setattr(near_dedup, "similarities", counting)
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(1, a)] * 60 + [(2, a + " end")] * 60 + [(7, f"lonely text {a[:3]}")]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 121 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (7, 7)}
    assert seen[0] == (1, 2) and seen[1][0] == 0  # the third text shares no bucket


def test_similar_but_unlinked_families_stay_cheap_and_whole(spark, monkeypatch):
    """Texts 0.6 to 0.8 alike share buckets and are linked with few: all links are found, from few of the pairs."""
    seen = []
    whole = near_dedup.similarities

    def counting(pairs, texts, size):
        seen.append(pairs.count())
        return whole(pairs, texts, size)

    monkeypatch.setattr(near_dedup, "similarities", counting)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(220):
        copy = list(base)
        for at in rng.sample(range(300), rng.choice([3, 9, 14, 20])):
            copy[at] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows, 3, 85)
    assert sum(seen) < 220 * 219 / 2 / 8


def test_near_dedup_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op4_near_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(docs, 3, 85)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    one, two = near_dedup.signatures([a, b], 200)
    assert abs((one == two).mean() - 0.6) < 0.12
    alone = near_dedup.signatures([pool[:1], pool[:0]], 96)
    assert (alone[0] < np.iinfo(np.uint64).max).all() and (alone[1] == np.iinfo(np.uint64).max).all()


def test_components_of_a_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a != 20")
    got = {r.node: r.label for r in near_dedup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 21)) and all(got[i] == 21 for i in range(22, 41))
    assert near_dedup.components(edges.limit(0)).count() == 0


def stripped(rows, window=20):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    passage = [f"p{i}é" for i in range(70)]
    rows = [(i, " ".join([f"n{rng.randrange(50)}" for _ in range(rng.randrange(40))] + passage[rng.randrange(30) : 40 + rng.randrange(30)] * rng.choice([1, 1, 2]))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "a " * 300), (43, " ".join(passage[:19])), (44, " ".join(passage[:20])), (None, " ".join(passage[:25]))]
    got = substring_dedup.remove_repeats(frame(spark, rows)).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got), key=str) == stripped(rows)
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0
    same = substring_dedup.remove_repeats(frame(spark, [(1, " ".join(passage)), (1, " ".join(passage)), (2, " ".join(passage))])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in same) == [(1, 0), (1, 0), (2, 70)]


def test_repeats_of_one_id_are_told_apart(spark):
    """Texts of one id, or of none, whose 32-bit hashes are equal, and many equal rows."""
    long = F.concat(F.lit("start "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " "), F.lit(" e"), F.col("id").cast("string"))
    ids = spark.range(120000)
    pair = ids.select(long.alias("a")).join(ids.select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("b")), F.hash("a") == F.hash("b")).first()
    assert pair is not None
    other = " ".join(f"w{i}" for i in range(1, 61))
    rows = [(i, t) for i in (5, None) for t in pair] + [(9, other), (9, "short"), (-(1 << 63), "least of all ids")] + [(9, other)] * 70
    got = substring_dedup.remove_repeats(frame(spark, rows)).withColumn("sha", F.sha2("kept", 256)).collect()
    alike = {}
    for r in got:
        alike.setdefault((r.doc_id, r.n_words), []).append((r.n_removed, r.sha))
    assert len(got) == len(rows) and all(len(set(v)) == 1 for v in alike.values())
    assert {k: len(v) for k, v in alike.items()} == {(5, 62): 1, (5, 1): 1, (None, 62): 1, (None, 1): 1, (9, 60): 71, (9, 1): 1, (-(1 << 63), 4): 1}
    assert alike[(None, 62)][0][0] == 0 and alike[(5, 62)][0][0] == 62 and alike[(9, 60)][0][0] == 60


def test_repeats_beside_letters_that_end_like_a_space(spark):
    passage = " ".join(f"\u0120{i} \u4e20\u0220 é{i}" for i in range(20))
    rows = [(i, f"\u0120 a{i} b{i} {passage} c{i}") for i in range(6)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got), key=str) == stripped(rows)


def test_a_passage_of_all_documents_is_dealt_to_slices(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ROWS_PER_SLICE", 3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"a{i} {passage} c{i}") for i in range(60)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got), key=str) == stripped(rows)


def test_repeats_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op6_substring_dedup"](spark, SF).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == stripped(docs)


def test_leaks(spark):
    item = " ".join(f"term{i}" for i in range(40))
    changed = item.split()
    changed[3] = "other"
    items = spark.createDataFrame([(1, item, 0), (2, "a b c", 0), (3, None, 0), (4, "", 0), (5, item, 0)], "item_id bigint, text string, n int")
    rows = [
        (1, "intro words " + item.upper().replace(" ", ", ") + " end"), (2, " ".join(changed)), (3, "x a b c y"), (4, "a b x c"), (5, None), (6, ""),
        (7, " ".join(item.split()[:20])), (7, item), (None, item), (8, ("filler " * 50 + item + " ") * 2),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(frame(spark, rows), items).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 7, None, 8) for i in (1, 5)} | {(3, 2)}
    assert got[(1, 1)].start == 2 and got[(8, 1)].start == 50 and got[(2, 1)].similarity == pytest.approx(32 / 40)
    assert decontamination.leaks(frame(spark, rows).limit(0), items).count() == 0
    assert decontamination.leaks(frame(spark, rows), items.limit(0)).count() == 0
    kept = decontamination.without_leaks(frame(spark, rows), items)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6] and kept.columns == frame(spark, rows).columns


def test_windows_meet_only_items_that_they_share_a_shingle_with(spark, monkeypatch):
    """Ten times the items do not make ten times the pairs; repeated rows are worked on once."""
    pairs = []
    stored = decontamination.store

    def spy(df, *rest):
        out = stored(df, *rest)
        if "shingles" in out.columns and "start" in out.columns:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(decontamination, "store", spy)
    item = lambda k: " ".join(f"t{k}x{i}" for i in range(40))
    rows = [(i, f"before {item(i % 3)} after {i}") for i in range(30)] + [(99, item(1))] * 50 + [(None, item(2))] * 50
    for n in (20, 200):
        items = spark.createDataFrame([(k, item(k)) for k in range(n)] + [(None, item(n))], "item_id bigint, text string")
        got = decontamination.leaks(frame(spark, rows), items).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(i, i % 3) for i in range(30)] + [(99, 1), (None, 2)], key=str)
    assert pairs[0] == pairs[1] < 32 * 6
    nameless = spark.createDataFrame([(None, item(0)), (None, item(1))], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, rows[:2]), nameless).collect()} == {(0, None), (1, None)}


def test_leaks_of_texts_shorter_than_the_item(spark):
    item = [f"term{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "a b c d e f"), (3, "p q r")], "item_id bigint, text string")
    rows = [
        (1, " ".join(item[:39])), (2, " ".join(item[6:])), (3, " ".join(item[8:])), (4, " ".join(item[:20] + ["other"] + item[21:39])),
        (5, "a b c d e"), (6, "p q"), (7, "a b c d"), (8, " ".join(item[:38])), (8, "filler " * 60), (8, "filler"), (None, " ".join(item[1:])),
    ]
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.n_words) for r in decontamination.leaks(frame(spark, rows), items).collect()}
    # (3: 28 of 36 shingles are too few; 4: 30 of 41; 5: 1 of 2; 6 and 7 have no whole shingle)
    want = {(1, 1): (35 / 36, 0, 39), (2, 1): (30 / 36, 0, 34), (8, 1): (34 / 36, 0, 38), (None, 1): (35 / 36, 0, 39)}
    assert got == {k: (round(s, 9), a, n) for k, (s, a, n) in want.items()}
    assert sorted(r.doc_id for r in decontamination.without_leaks(frame(spark, rows), items).collect()) == [3, 4, 5, 6, 7]


def test_hamming_blocks_find_all_within_the_radius(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(60):
        a = rng.getrandbits(64)
        for k in rng.sample(range(64), 19):
            a_flipped = a ^ sum(1 << j for j in rng.sample(range(64), 19))
        pairs.append((a - (1 << 63), a_flipped - (1 << 63)))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    same = F.exists(F.arrays_zip(decontamination.blocks_of(F.col("a"), 19).alias("x"), decontamination.blocks_of(F.col("b"), 19).alias("y")), lambda z: z["x"] == z["y"])
    assert df.where(same).count() == 60


def test_fingerprints_make_hashes_and_windows_once(spark):
    """Not once for each of the 64 bits, nor for each shingle; all bits count, whatever the array's length."""
    hashes = decontamination.simhash(F.transform(F.col("s"), lambda x: F.xxhash64(x)))
    assert hashes._jc.toString().count("xxhash64") == 1
    assert decontamination.shingles_of(F.slice(F.col("s"), F.col("a") + 1, 40), 5)._jc.toString().count("slice(s") == 1
    rng = random.Random(5)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (0, 1, 2, 3, 40, 70_000)] + [[-1] * 5, [-(1 << 63), -(1 << 63), 1], [0, -1]]
    got = [r[0] for r in spark.createDataFrame([(k, h) for k, h in enumerate(rows)], "k int, h array<bigint>").orderBy("k").select(decontamination.simhash(F.col("h"))).collect()]
    want = [sum(1 << (63 - b) for b in range(64) if 2 * sum(h >> b & 1 for h in row) > len(row)) for row in rows]
    assert [g % (1 << 64) for g in got] == want


def test_chat_round_trip(spark):
    rng = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN>>", "<<TEXT>>", "<</TURN>>", "\\", "<", "[", "a", "\n", "<\\s>", "$1"]
    rows = [(c, t if t else None, rng.choice(["user", "assistant", "system", None, "x<<TEXT>>y"]), rng.choice([None, "".join(rng.choices(parts, k=6))]), 1) for c in range(80) for t in range(3)]
    rows += [(None, 0, "user", "alone", 1), (7, 1, "user", "tie", 1), (7, 1, "user", "tie", 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    out = chat_format.format_conversations(turns).withColumn("read", chat_format.recovered(F.col("formatted"), F.col("escaped"))).collect()
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.read] for r in out} == want and all(r.exact for r in out)
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[49]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] * 16, 1), (1060, [None] * 16, 1), (1080, [1.0, 2.0], 1), (None, [1.0] * 16, 1), (20, [float(c) for c in x[20]], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = nearest.neighbours(table, table.where("vec_id % 20 = 0"))
    near = {}
    for r in got.orderBy("query_id", "rank").collect():
        near.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 400, 20):
        s = x.astype(float) @ x[q].astype(float)
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        assert len(near[q]) == 20 and all(abs(score - s[i]) < 1e-9 for i, score in near[q])
        hits, total = hits + len(set(best) & {i for i, _ in near[q]}), total + 20
    assert hits >= 0.9 * total and set(near) == set(range(0, 400, 20))
    assert nearest.neighbours(table.limit(0), table).count() == 0


def recall(spark, got, table, everything=False):
    """Share of the exact 20 nearest that are found; scores must be exact and in order."""
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    near = {}
    for r in got.orderBy("query_id", "rank").collect():
        near.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    assert set(near) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in near.items():
        s = x @ x[ids == q][0]
        best = [i for _, i in sorted((-v, i) for v, i in zip(s.tolist(), ids.tolist()) if i != q)][: len(found)]
        assert all(abs(score - s[ids == i][0]) < 1e-9 for i, score in found) and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert len(found) == min(20, len(ids) - 1)
        hits, total = hits + len({i for i, _ in found} & set(best)), total + len(best)
    return hits / total


def test_registered_nearest(spark):
    for sf in ("sf0.001", "sf0.01"):
        table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        assert recall(spark, QUERIES["op10_nearest"](spark, f"/root/testdata/{sf}"), table) >= 0.9


def test_nearest_of_grouped_vectors_reads_few_blocks_and_splits_busy_ones(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 128)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(30, 12)) * 3
    x = (centre[np.arange(3000) % 30] + rng.normal(size=(3000, 12)) / 3).astype(np.float32)
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").cache()
    assert recall(spark, nearest.neighbours(table, table.where("vec_id % 20 = 0")), table) >= 0.9


def test_nearest_is_exact_where_no_setting_is_good_enough(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MOST_PROBES", 1)
    monkeypatch.setattr(nearest, "CALIBRATION_RECALL", 1.0)
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert recall(spark, nearest.neighbours(table, table.where("vec_id % 20 = 0")), table) == 1.0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scans", "packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF)
        assert after.columns == docs.columns
        at = spark.createDataFrame(after.collect(), docs.schema)
    left = {r.doc_id for r in at.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    firsts = {d for d, _, c in groups(rows, 5, 80) if d == c}
    leaking = {r.doc_id for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    assert left <= firsts - leaking and len(left) >= len(firsts - leaking) - 4
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == left
