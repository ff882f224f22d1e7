"""Licence rules, hard negatives and token alignment against plain versions on small and awkward inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scholium.llm import hard_negatives, license_rules, license_scan, token_alignment
from scholium.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, row string, n_words string, batch string, place int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", None, "y", 1) for i, t in texts], SCHEMA)


# --- licence scan ---------------------------------------------------------------------------------------------------------

def plain_scan(text, rules):
    """Detections by Python's own regular expressions over the words, suppressed pair by pair."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spaced = " " + "  ".join(words) + " "
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, spaced):
            found.append((spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2, r.label, r.level, k, r.base))

    def beats(b, a):
        inside = b[0] <= a[0] and a[1] <= b[1] and b[3] <= a[3] and not b[5]
        return inside and ((b[0], b[1]) != (a[0], a[1]) or (b[3], b[4]) < (a[3], a[4]))

    return len(words), sorted(a for a in found if a[5] or not any(beats(b, a) for b in found))


LICENCE_TEXTS = [
    (1, None), (2, ""), (3, " \n.,"), (4, "Licensed under the Apache License,\nVersion 2.0 and the MIT License; CC-BY-NC 4.0 or cc_by."),
    (4, "Licensed under the Apache License,\nVersion 2.0 and the MIT License; CC-BY-NC 4.0 or cc_by."), (4, "the MIT\tLICENSE"),
    (None, "SPDX-License-Identifier: GPL-3.0-or-later"), (7, "GNU General Public License v2 or (at your option) any later version. gplv3"),
    (8, "nothing of the kind, though commits permit unlimited accord by"), (9, "é MIT licenseİ mit license ǅ \U0001F600 mit license"),
    (10, "gnu " * 3 + "general public license " * 2 + "mit license " * 5), (11, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (12, "see the LICENSE file. All rights reserved. Copyright (c) 2019 X"), (13, ("word " * 50 + "apache license ") * 400), (14, "smith license, mit licenses, mit licence"),
]


def test_license_rules_are_many_and_keywords_are_in_every_match():
    rules = license_rules.rules()
    assert len(rules) > 300 and len({r.label for r in rules}) > 80
    for _, text in LICENCE_TEXTS:
        low = (text or "").lower()
        for r in rules:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            if re.search(r.pattern, " " + "  ".join(words) + " "):
                assert all(k in low or k == "cc-by" for k in r.keywords), (r, text)


def test_license_scan(spark):
    rules = license_rules.rules()
    got = sorted((str(r.doc_id), r.n_words, [tuple(d) for d in r.detections]) for r in license_scan.scan(frame(spark, LICENCE_TEXTS)).collect())
    want = sorted((str(i), *plain_scan(t, rules)) for i, t in LICENCE_TEXTS)
    assert [(i, n, sorted(d)) for i, n, d in got] == want
    assert license_scan.scan(frame(spark, LICENCE_TEXTS).limit(0)).count() == 0


def test_license_suppression(spark):
    rules = [
        license_rules.Rule("short", 1, ("b",), "b c"), license_rules.Rule("long", 2, ("b",), "a b c d"), license_rules.Rule("twin", 1, ("b",), "b c"),
        license_rules.Rule("better", 0, ("b",), "a b c d"), license_rules.Rule("base", 2, ("b",), "b c", True), license_rules.Rule("worse", 2, ("d",), "d e"),
    ]
    def of(text):
        return [d.label for d in license_scan.scan(frame(spark, [(1, text)]), rules).first().detections]
    assert of("a b c d e") == ["better", "base", "worse"]
    assert of("x b c d") == ["base", "short"]


# --- hard negatives -------------------------------------------------------------------------------------------------------

def plain_negatives(rows, is_anchor, positives=5, negatives=5):
    use = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        r = (label, [math.floor(256 * c) for c in v])
        use[i] = min(use.get(i, r), r)
    out = []
    for a, (own, x) in use.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, label) for i, (label, y) in use.items() if i != a and len(y) == len(x))
        for s, i, label in [t for t in scored if t[2] == own][:positives]:
            fits = [t for t in scored if t[2] != own and 80 * -s <= 100 * -t[0] and -t[0] <= -s][:negatives]
            out += [(a, i, k, j, -s, -t) for k, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK", 8)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 5))
    rows = [(i, (centre[i % 6] + rng.normal(size=5) / 4).astype(float).tolist(), int(i % 6 if i % 3 else rng.integers(4))) for i in range(300)]
    rows += [(1000 + i, rows[7][1], i % 2) for i in range(60)]  # one vector, many ids
    rows += [(2000, None, 1), (2001, [1.0, None, 0.0, 0.0, 0.0], 1), (2002, [float("nan")] * 5, 1), (2003, [0.5] * 5, None), (None, [0.5] * 5, 1),
             (2010, [0.0] * 5, 2), (2020, [1.0, 1.0], 1), (2021, [1.0, 0.9], 1), (2022, [1.0, 0.8], 0), (2030, [], 1), (2031, [], 1), (2032, [], 0),
             rows[10], rows[10], (10, rows[11][1], 5), (2040, [float("inf")] * 5, 1)]
    table = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], "vec_id bigint, embedding array<double>, label int, block string, anchor int")
    got = sorted(tuple(r) for r in hard_negatives.mine(table, lambda i: i % 10 == 0).collect())
    assert got == plain_negatives(rows, lambda i: i % 10 == 0) and len(got) > 100
    assert hard_negatives.mine(table.limit(0), lambda i: i % 10 == 0).count() == 0
    assert hard_negatives.mine(table, lambda i: i == -1).count() == 0


def test_few_blocks_are_read_where_vectors_are_grouped():
    rng = np.random.default_rng(5)
    centre = rng.integers(-200, 200, size=(40, 8))
    x = np.concatenate([c + rng.integers(-5, 6, size=(50, 8)) for c in centre])
    order = np.argsort(hard_negatives.curve_of(x), kind="stable")
    blocks = [x[order[k : k + 50]] for k in range(0, len(x), 50)]
    chunk = hard_negatives.Chunk(np.arange(len(x)), np.zeros(len(x), int), x, floor=np.array([np.sort(x @ v)[-6] for v in x]))
    asked = sum(len(chunk.wanted(b.min(0), b.max(0), 0, 0)) for b in blocks)
    assert asked < len(x) * len(blocks) / 4
    for b in blocks[:5]:
        low, high = hard_negatives.interval(x, b.min(0), b.max(0))
        s = x @ b.T
        assert (low <= s.min(1)).all() and (s.max(1) <= high).all()


def test_neighbours_on_the_curve_are_neighbours_in_space():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    place = hard_negatives.curve_places(grid, 3)
    assert sorted(place.tolist()) == list(range(512))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_registered_hard_negatives(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, SF).collect())
    assert got == plain_negatives(rows, lambda i: i % 100 == 0)


# --- token alignment ------------------------------------------------------------------------------------------------------

def plain_alignment(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = token_alignment.byte_of_letter()

    def piece_bytes(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    docs = []
    for i, text in rows:
        links, groups = [], []
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xb = [bytes(letters[c] for c in a.id_to_token(k)) for k in x]
        yb = [piece_bytes(k) for k in y]
        if text and b"".join(xb) == b"".join(yb) == (" " + text).encode():
            spans = []
            for pieces in (xb, yb):
                at, own = 0, []
                for p in pieces:
                    own.append((at, at + len(p)))
                    at += len(p)
                spans.append(own)
            ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
            at = 0
            for e in ends:
                groups.append(tuple([k for k, s in zip(ids, own) if at <= s[0] and s[1] <= e] for ids, own in zip((x, y), spans)))
                at = e
            links = [(k, m) for k, s in zip(x, spans[0]) for m, t in zip(y, spans[1]) if s[0] < t[1] and t[0] < s[1]]
        else:
            x = y = []
        docs.append((i, x, y, groups, links))
    count = Counter(p for d in docs for p in set(d[4]))
    most = defaultdict(int)
    for (k, _), n in count.items():
        most[k] = max(most[k], n)
    out = []
    for i, x, y, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((str(i), len(x), len(y), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return sorted(out)


def aligned_rows(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_alignment_of_awkward_texts(spark):
    rng = random.Random(3)
    odd = ["naïve café", "日本語のテキスト", "▁x", "a  b\n\n\tc ", "<s> </s> <unk> <|endoftext|> <0x41>", "x" * 3000, "﷽ﬁ\U0001F600é", "\x00\x1c", " "]
    mixed = ["".join(rng.choice("aé日 \n0x,\U0001F600") for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    texts = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no id"), *[(10 + k, t) for k, t in enumerate(odd + mixed)]]
    got = aligned_rows(token_alignment.align(frame(spark, texts)))
    assert got == plain_alignment(texts)
    assert token_alignment.align(frame(spark, texts).limit(0)).count() == 0


def test_long_text_is_many_lanes():
    rng = np.random.default_rng(6)
    for lane in (1, 7, 256, 10**9):
        ends = [np.unique(np.append(rng.integers(1, 3000, 700), 3000)) for _ in range(2)]
        la, lb, cut_a, cut_b = token_alignment.merge(*ends, np.array([0, len(ends[0])]), np.array([0, len(ends[1])]), lane)
        begins = [np.append(0, e[:-1]) for e in ends]
        want = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if begins[0][i] < ends[1][j] and begins[1][j] < ends[0][i]}
        assert len(la) == len(want) and set(zip(la.tolist(), lb.tolist())) == want
        assert (ends[0][cut_a] == np.intersect1d(*ends)).all() and (ends[1][cut_b] == np.intersect1d(*ends)).all()


def test_registered_alignment(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert aligned_rows(QUERIES["op13_token_alignment"](spark, SF)) == plain_alignment([(i, t) for i, t in rows])


def test_pairs_of_a_batch_by_plain_counting():
    texts = ["one two two one", None, "", "two", "one two two one", "süß 😀 one  two", "　x"]
    both = token_alignment.encoders(public_tokenizers.path(token_alignment.A_FILE), public_tokenizers.path(token_alignment.B_FILE))
    got = token_alignment.align_batch(texts, both)
    pairs = list(got["pairs"])
    assert pairs == sorted(set(pairs)) and len(pairs) == len(got["docs"])
    holders = Counter(p for places in got["places"] for p in places)
    assert list(got["docs"]) == [holders[k] for k in range(len(pairs))]
    assert [sum(t) for t in got["times"]] == list(got["n_links"])
    assert list(got["places"][0]) == list(got["places"][4]) == sorted(got["places"][0])
    words = both.a_words
    assert words.numbers[7] == b"7," and words.numbers[7 + len(words.tokens)] == b"7|"


def test_ascii_texts_are_encoded_by_words_kept(monkeypatch):
    rng = random.Random(8)
    both = token_alignment.Encoders(public_tokenizers.path(token_alignment.A_FILE), public_tokenizers.path(token_alignment.B_FILE))
    parts = ["'s", "'S", "'ll", "'", "''re", " ", "  ", "\n", "\r\n\t", "\x0b\x0c", "\x1c", "\x1f\x00", "\x7f", "_", "a", "Zq", "12", "<|endoftext|>", "--", "can't", "x1"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(300)] + [chr(k) * n for k in range(128) for n in (1, 2, 3)] + ["na\u00efve 's", "\u3000x"]
    want = [both.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    for most in (100_000, 3):
        monkeypatch.setattr(token_alignment, "KEPT_WORDS", most)
        both.words.clear()
        assert [x.tolist() for x in both.encode_a(texts)] == want
        assert len(both.words) <= most

    class Asked:
        def encode_batch_fast(self, batch, **_):
            assert not batch
            return []

    monkeypatch.setattr(token_alignment, "KEPT_WORDS", 100_000)
    ascii_texts = [t for t in texts if t.isascii()]
    first = both.encode_a(ascii_texts)
    both.a = both.words.tokenizer = Asked()  # every word is known by now
    assert all((x == y).all() for x, y in zip(first, both.encode_a(ascii_texts)))
    both.words[" a"] = b""  # as if its ids did not spell it
    assert both.encode_a(["a"]) == [None]
