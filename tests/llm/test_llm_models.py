"""Fitted operators against plain loops, and awkward rows through every stage of the pipeline."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholium.llm import quality, secret_scan, token_counts
from scholium.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- token counts -----------------------------------------------------------------------------------------------------

def test_registered_token_counts_equal_greedy_search(spark):
    known = set(token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    longest = max(map(len, known))
    seen = {}

    def pieces(word):
        if word not in seen:
            at = n = 0
            while at < len(word):
                at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in known)
                n += 1
            seen[word] = n
        return seen[word]

    got = {r.doc_id: (r.n_words, r.n_bytes, r.n_tokens) for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        data = (r.text or "").encode()
        words = data.split()
        assert got[r.doc_id] == (len(words), len(data), sum(pieces(b" " + w) for w in words))


# --- language ---------------------------------------------------------------------------------------------------------

def plain_grams(text):
    """Counts of hashed 4-grams of bytes, one by one."""
    data = bytearray(b" ")
    for b in text.lower().encode() + b" ":
        c = b if b > 127 or chr(b).isalpha() else 32
        if c != 32 or data[-1] != 32:
            data.append(c)
    while len(data) < 4:
        data.append(32)
    counts = {}
    for k in range(len(data) - 3):
        code = data[k] | data[k + 1] << 8 | data[k + 2] << 16 | data[k + 3] << 24
        key = code * 2654435761 % (1 << 32) >> 16
        counts[key] = counts.get(key, 0) + 1
    return counts


def plain_em(grams, tables, start):
    shares, total = list(start), sum(grams.values())
    for _ in range(40):
        new = [0.0] * len(shares)
        for g, n in grams.items():
            like = [t[g] for t in tables]
            top = max(like)
            weight = [s * x / top for s, x in zip(shares, like)]
            for i, w in enumerate(weight):
                new[i] += n * w / sum(weight) / total
        moved, shares = max(abs(a - b) for a, b in zip(new, shares)), new
        if moved < 1e-3:
            break
    return shares


def test_language_shares_equal_plain_em(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    trained = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            own = trained.setdefault(r.lang, [0.5] * (1 << 16))
            for g, n in plain_grams(r.text).items():
                own[g] += n
    langs = sorted(trained)
    tables = [[x / sum(trained[lang]) for x in trained[lang]] for lang in langs]
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, SF).collect()}
    compared = 0
    for r in [r for r in rows if r.text and any(map(str.isalpha, r.text)) and len(r.text) < 3000][:50]:
        shares = plain_em(plain_grams(r.text), tables, [1 / len(langs)] * len(langs))
        best = langs.index(got[r.doc_id].lang_pred)
        assert got[r.doc_id].score == pytest.approx(shares[best], abs=1e-6)
        assert shares[best] == max(shares) or got[r.doc_id].mixture[langs[best]] >= max(got[r.doc_id].mixture.values()) - 1e-12
        assert sum(got[r.doc_id].mixture.values()) == pytest.approx(1, abs=1e-9)
        compared += 1
    assert compared == 50
    right = [got[r.doc_id].lang_pred == r.lang for r in rows if r.lang is not None and got[r.doc_id].held_out and r.text]
    assert sum(right) >= 0.95 * len(right)


# --- quality ----------------------------------------------------------------------------------------------------------

def plain_risk(pos, unl, prior, hidden, steps, rate, decay, seed):
    """The same minimisation in float loops, for inputs of one batch per step."""
    rng = np.random.default_rng(seed)
    n_features = len(pos[0])
    both = pos + unl
    mean = [sum(r[f] for r in both) / len(both) for f in range(n_features)]
    scale = [math.sqrt(sum((r[f] - mean[f]) ** 2 for r in both) / len(both)) + 1e-3 for f in range(n_features)]
    norm = lambda r: [min(8.0, max(-8.0, (x - m) / s)) for x, m, s in zip(r, mean, scale)]
    w = rng.normal(0, 1 / math.sqrt(n_features), (n_features, hidden)).tolist()
    b, v, c = [0.0] * hidden, rng.normal(0, 1 / math.sqrt(hidden), hidden).tolist(), 0.0
    flat = lambda: [x for row in w for x in row] + b + v + [c]
    m1, m2 = [0.0] * len(flat()), [0.0] * len(flat())
    for step in range(1, steps + 1):
        orders = [rng.permutation(len(x)) for x in (pos, unl)]
        a = [norm(pos[k]) for k in orders[0]]
        u = [norm(unl[k]) for k in orders[1]]
        out = []
        for r in a + u:
            h = [math.tanh(sum(r[f] * w[f][k] for f in range(n_features)) + b[k]) for k in range(hidden)]
            g = 1 / (1 + math.exp(-(sum(x * y for x, y in zip(h, v)) + c)))
            out.append((r, h, g))
        g_pos, g_unl = [g for _, _, g in out[: len(a)]], [g for _, _, g in out[len(a) :]]
        negative = sum(g_unl) / len(u) - prior * sum(g_pos) / len(a)
        grad = [0.0] * len(flat())
        for k, (r, h, g) in enumerate(out):
            slope = g * (1 - g)
            # of the positive risk prior * (1 - g), and of the negative part g_unl - prior * g_pos, which is turned round below 0
            if k < len(a):
                d = -prior * slope / len(a) + (-prior * slope / len(a)) if negative >= 0 else prior * slope / len(a)
            else:
                d = slope / len(u) if negative >= 0 else -slope / len(u)
            for j in range(hidden):
                back = d * v[j] * (1 - h[j] ** 2)
                for f in range(n_features):
                    grad[f * hidden + j] += r[f] * back
                grad[n_features * hidden + j] += back
                grad[(n_features + 1) * hidden + j] += h[j] * d
            grad[-1] += d
        now = flat()
        for i in range(len(now)):
            if i < n_features * hidden or (n_features + 1) * hidden <= i < len(now) - 1:
                grad[i] += decay * now[i]
            m1[i] = 0.9 * m1[i] + 0.1 * grad[i]
            m2[i] = 0.999 * m2[i] + 0.001 * grad[i] ** 2
            now[i] -= rate * (m1[i] / (1 - 0.9**step)) / (math.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
        w = [now[f * hidden : (f + 1) * hidden] for f in range(n_features)]
        b, v, c = now[n_features * hidden : (n_features + 1) * hidden], now[(n_features + 1) * hidden : -1], now[-1]
    return lambda r: sum(math.tanh(sum(x * w[f][k] for f, x in enumerate(norm(r))) + b[k]) * v[k] for k in range(hidden)) + c


def test_risk_equals_float_loops():
    rng = np.random.default_rng(3)
    pos, unl = (rng.normal(1, 1, (5, 3))).tolist(), rng.normal(0, 1.5, (7, 3)).tolist()
    for prior in (0.3, 0.9):  # with the larger prior the negative part falls below 0
        net = quality.minimise_risk(np.array(pos), np.array(unl), prior, hidden=4, epochs=1, batch=7, rate=0.05)
        plain = plain_risk(pos, unl, prior, 4, 400, 0.05, 1e-4, 7)
        for r in pos + unl:
            assert float(net.margin(np.array([r]))[0]) == pytest.approx(plain(r), abs=1e-6)


# --- secrets ----------------------------------------------------------------------------------------------------------

def test_access_spans_equal_plain_search(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(120):
        parts = [rng.choice(["AKIA", "akia", "AKI", "xAKIA", "AKIAAKIA", " ", "é", "\n"]) + "".join(rng.choice("ABZ059" * 4 + "a_") for _ in range(rng.randrange(24))) for _ in range(6)]
        texts.append("".join(parts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "access"] for r in secret_scan.scan(df).collect()}
    found = 0
    for i, t in enumerate(texts):
        want = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        assert got[i] == want
        found += len(want)
    assert found > 20 and got[-1] == []


# --- pipeline ---------------------------------------------------------------------------------------------------------

ENGLISH = "The river keeps its old course while the mills along the bank turn slowly through the night and the morning."


def awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 300 and 3000").orderBy("doc_id").limit(30).collect()
    rows = [tuple(r) for r in docs]
    words = [f"{a}{b}" for a in ("mill", "bank", "tide", "oak", "fern", "loom") for b in ("er", "ing", "ed", "s", "like", "ward", "less", "ful")]
    rng = random.Random(12)
    long = ENGLISH + " " + " ".join(rng.choice(words) for _ in range(20000))
    own = [
        (900001, None, "en", "a", 0), (900002, "", "en", "a", 0), (900003, " \n\t", None, "a", 3), (900004, "12 34 ½ !!", "en", None, 10),
        (900005, long, "en", "a", len(long)), (900006, ENGLISH, "en", "a", len(ENGLISH)), (900006, ENGLISH, "en", "a", len(ENGLISH)),
        (900006, ENGLISH.upper() + " " + " ".join(words), "en", "b", None), (900007, "Looms stand idle when the tide is low and the fern grows over the old oak. password = hunter2hunter2", "en", "a", 1),
        (None, "No id stands before this text about looms and ferns, but it is as good as others are.", "en", "a", 1),
        (None, "No id stands before this text about looms and ferns, but it is as good as others are.", "en", "a", 1),
    ]
    return rows + own


def test_awkward_rows_through_every_stage(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = awkward_rows(spark)
    at = spark.createDataFrame(rows, schema)
    for column in ("node", "twin", "row", "n", "item", "spans"):  # names that the stages use themselves
        at = at.withColumn(column, F.lit(f"own {column}"))
    columns, kept = at.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == columns
        got = out.collect()
        assert all(r["node"] == "own node" and r["spans"] == "own spans" for r in got)
        kept[name] = got
        at = spark.createDataFrame(got, out.schema)
    ids = lambda name: [r.doc_id for r in kept[name] if r.doc_id is None or r.doc_id >= 900000]
    # without a letter there is no language; all others stay, each row for itself
    assert sorted(map(str, ids("language_id"))) == sorted(map(str, [900005, 900006, 900006, 900006, 900007, None, None]))
    # equal rows of one id, and of none, are one document; the other text of 900006 stays
    assert sorted(map(str, ids("near_dedup"))) == sorted(map(str, [900005, 900006, 900006, 900007, None]))
    assert sorted(map(str, ids("decontamination"))) == sorted(map(str, ids("near_dedup"))) == sorted(map(str, ids("secret_scans")))
    clean = {r.doc_id: r for r in kept["secret_scans"]}
    assert "hunter2" not in clean[900007].text and clean[900007].n_chars == len(clean[900007].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept["secret_scans"]}
    assert sum(r.doc_id == 900005 for r in packed) > 4 and max(r.offset + r.length for r in packed) <= 4096


def test_empty_table_through_every_stage(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        assert out.count() == 0, name
