"""Tokens, packing and subjects."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelweft.llm import packing, subjects, tokens

SCHEMA = "doc_id bigint, text string, ids string, n_tokens string, words int"


@pytest.fixture(scope="module")
def reference():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(os.path.join(tokens.VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = [
    "", " ", "\n", "Hello world, it's 2024!", "  two  spaces\tand tab\r\n\r\nlines \n", "<|endoftext|> is text", "naïve café — 日本語 🎉👩‍👩‍👧 ​﻿ x", "'s 't're've'm'll'd S'S",
    "a" * 5000, "=" * 3000 + " " * 3000 + "x", "def f(x):\n    return x+1\n" * 50, "\x1c\x1d\x85\xa0 　 a᠎b", "ſ ı İ ǆ ²³¼ Ⅷ ٣٤", "\x00\x01\x7f", "aaaaabaaaabaaabaab" * 40, "ünïcödé" * 200,
]


def test_ids_equal_the_public_library(spark, reference):
    rnd = random.Random(1)
    alphabet = "abc XYZ019 \n\t.,;'éßд中🎉_-=/\\\"{}"
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(300)]
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)] + [(9000, None, "x", "y", 1), (None, "null id", "x", "y", 1), (3, texts[3], "x", "y", 1)]
    got = tokens.encode(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: list(r["ids"]) for r in got}
    assert by[9000] == [] and by[0] == [] and by[None] == reference("null id")
    assert all(by[i] == reference(t) for i, t in enumerate(texts))
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert counts == {k: len(v) for k, v in by.items()}
    assert tokens.encode(spark.createDataFrame([], SCHEMA)).collect() == []


def test_encoder_matches_merging_and_round_trips():
    ranks = tokens.read_ranks(os.path.join(tokens.VOCABULARIES, tokens.RANK_FILE))
    encoder = tokens.PrefixEncoder(ranks, kept=50)
    rnd = random.Random(2)
    for _ in range(300):
        piece = bytes(rnd.choice(b"abehlnorst -=") for _ in range(rnd.randrange(1, 40)))
        assert [encoder.tokens[i] for i in encoder.encode_piece(piece)] == encoder.merge(piece)
    for text in TEXTS:
        assert b"".join(encoder.tokens[i] for i in encoder.encode(text)).decode() == text
    encoder.encode_many(TEXTS)
    encoder.encode_many(TEXTS)  # after the remembered pieces were dropped
    with pytest.raises(ValueError):
        tokens.PrefixEncoder({b"a": 0}).encode("b")


def pack(spark, sizes, capacities, **kw):
    s = spark.createDataFrame([(*r, "x", 1) for r in sizes], "doc_id bigint, n_tokens int, grp string, capacity int")
    c = spark.createDataFrame(capacities, "container_type int, capacity_tokens int")
    return [tuple(r) for r in packing.pack(s, c, **kw).collect()]


def test_packing_keeps_every_token_once(spark):
    rnd = random.Random(3)
    sizes = [(i, rnd.choice([0, 1, 5, 40, 90, 250, 1000, 3333])) for i in range(900)] + [(5000, None)]
    kw = {"open_windows": 8, "per_group": 60, "fan_in": 3}
    rows = pack(spark, [*sizes, sizes[3], (None, 7)], [(1, 100), (2, 512), (3, 0), (None, 9), (4, None), (2, 512)], **kw)
    for kind, capacity in ((1, 100), (2, 512)):
        own = [r for r in rows if r[0] == kind]
        fill, pieces = {}, {}
        for _, c, d, p, start, n in own:
            fill[c] = fill.get(c, 0) + n
            pieces.setdefault(d, []).append((p, start, n))
        assert max(fill.values()) <= capacity
        for d, n in sizes:
            got = sorted(pieces.pop(d))
            assert [p for p, _, _ in got] == list(range(len(got)))
            at = 0
            for _, start, k in got:
                assert start == at
                at += k
            assert at == (n or 0)
            assert len(got) == max(1, -(-(n or 0) // capacity))
        assert not pieces
        assert sum(fill.values()) / (len(fill) * capacity) > 0.93
    assert {r[0] for r in rows} == {1, 2}
    shuffled = sizes[:]
    rnd.shuffle(shuffled)
    assert sorted(pack(spark, shuffled, [(1, 100), (2, 512)], **kw)) == sorted(rows)


def test_packing_nothing(spark):
    assert pack(spark, [], [(1, 100)]) == []
    assert pack(spark, [(1, 5)], []) == []
    assert [r[2:] for r in pack(spark, [(1, 0)], [(1, 100)])] == [(1, 0, 0, 0)]


def test_open_windows():
    w = packing.OpenWindows(10, 2)
    assert [w.place(s) for s in (6, 7, 4, 3, 9, 9, 1)] == [0, 1, 0, 1, 2, 3, 2]
    w = packing.OpenWindows(10, 2)
    assert [w.place(s) for s in (6, 7, 5)] == [0, 1, 2]
    assert sorted(c for _, c in w.free) == [0, 2]  # the fullest closed


WORDS = {"farming": "barn tractor plough silo wheat cattle".split(), "music": "chord violin tempo choir octave drum".split(), "law": "court statute verdict plaintiff notary appeal".split()}
COMMON = "fix update value field node table return none with when missing handle file".split()


def corpus(seed, n=600):
    rnd = random.Random(seed)
    docs, truth = [], set()
    for i in range(n):
        kind = rnd.random()
        about = [] if kind < 0.15 else rnd.sample(sorted(WORDS), 2 if kind > 0.85 else 1)
        words = [rnd.choice(COMMON) for _ in range(12)]
        for s in about:
            words += [w for x in rnd.sample(WORDS[s], 4) for w in (x, rnd.choice(COMMON))]
            truth.add((i, s))
        others = [s for s in WORDS if s not in about]
        if about and rnd.random() < 0.3 and others:
            words += [rnd.choice(COMMON), rnd.choice(WORDS[rnd.choice(others)]), rnd.choice(COMMON)]  # in passing
        docs.append((i, f"{' '.join(words[:6])}\n\n{' '.join(words[6:])}", "x", "y", 1))
    labelled = rnd.sample(sorted(truth), min(60, len(truth) // 2))
    labels = [(d, s if rnd.random() > 0.1 else rnd.choice(sorted(WORDS)), "r") for d, s in labelled]
    return docs, truth, labels


def assign(spark, docs, labels):
    areas = spark.createDataFrame([(s, "d") for s in WORDS], "subject string, description string")
    clash = lambda df, *names: df.withColumns({n: F.lit("x") for n in names})
    given = clash(spark.createDataFrame(labels, "doc_id bigint, subject string, labelled_by string"), "name", "code", "w", "text")
    out = subjects.assign_subjects(clash(spark.createDataFrame(docs, SCHEMA), "subject", "w", "p", "belief"), clash(areas, "doc_id", "name", "code"), given).collect()
    assert len(out) == len({tuple(r) for r in out})
    return {(r["doc_id"], r["subject"]) for r in out}


def test_subjects_on_held_out_documents(spark):
    docs, truth, labels = corpus(1)
    dirt = [(7000, None, "x", "y", 1), (7001, "", "x", "y", 1), (7002, " \n", "x", "y", 1), (None, docs[0][1], "x", "y", 1), docs[5], (7003, "barn tractor " * 30_000, "x", "y", 1)]
    got = assign(spark, docs + dirt, [*labels, (99_999, "law", "r"), (1, "unknown", "r"), (None, "law", "r"), (2, None, "r"), labels[0]])
    seen = {d for d, _, _ in labels}
    held = {(d, s) for d, s in got if d not in seen and d < 7000}
    want = {(d, s) for d, s in truth if d not in seen}
    assert len(held & want) >= 0.95 * len(want)
    assert len(held & want) >= 0.95 * len(held)
    assert not {d for d, _ in got} & {7000, 7001, 7002, None}


def test_subjects_of_nothing(spark):
    docs, _, labels = corpus(2, 30)
    assert assign(spark, [], labels) == set()
    assert assign(spark, docs, []) == set()


def test_words_of_commits():
    text = "commit 0123456789abcdef\nAuthor: Some Body <a@b>\n\n    Fix marginCall of lease_term\n\ndiff --git a/app/x.py b/app/x.py\n--- a/app/x.py\n+++ b/app/x.py\n@@ -1 +1 @@ def lunarPhase\n+tuning-fork\n"
    found = subjects.word_pairs(text)
    assert ("call", "margin") in found and ("lease", "call") in found and ("phase", "lunar") in found and ("fork", "tuning") in found
    assert not {w for w, _ in found} & {"body", "author", "commit"}
    quoted = '{"commit":"ab","author":"nobody","message":"tax\\nbracket","diff":"+yield\\n"}'
    assert {"tax", "bracket", "yield"} <= {w for w, _ in subjects.word_pairs(quoted)} and "nobody" not in {w for w, _ in subjects.word_pairs(quoted)}


def test_merging_keeps_few_containers_open():
    capacity = 1000
    pieces = pd.DataFrame({"doc_id": range(4096), "piece_no": 0, "token_start": 0, "n_tokens": 600})
    left = packing.merger(1, 256)((1, 0, capacity), pieces)
    assert len(left) == 4096 and left.loc[left["is_open"], "container_id"].nunique() == 256
    assert not packing.merger(2, 0)((1, 0, capacity), pieces)["is_open"].any()
    # thousands of empty texts share a container, which goes no further
    empty = packing.merger(1, 256)((1, 0, capacity), pieces.assign(n_tokens=0))
    assert empty["container_id"].nunique() == 1 and not empty["is_open"].any()


def test_violations_are_found(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 25), (3, 0), (4, 8)], "doc_id bigint, n_tokens int")
    capacities = spark.createDataFrame([(7, 10)], "container_type int, capacity_tokens int")
    assert packing.violations(packing.pack(sizes, capacities), sizes, capacities).count() == 0
    bad = [(7, 1, 1, 0, 0, 5), (7, 1, 4, 0, 0, 8), (7, 2, 2, 0, 0, 10), (7, 3, 2, 1, 10, 10), (7, 4, 3, 0, 0, 0)]
    rows = packing.violations(spark.createDataFrame(bad, packing.SCHEMA), sizes, capacities).collect()
    assert {(r["rule"], r["id"]) for r in rows} == {("capacity", 1), ("coverage", 2), ("split", 2)}


def test_decoding(spark):
    texts = ["", None, "naïve café 文字 \U0001f600", " a\r\n\tb ", "x" * 3000]
    rows = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(rows)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first()["text"] is None
