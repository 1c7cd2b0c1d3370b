"""License scan, exact dedup and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeline.llm import exact_dedup as ed
from tapeline.llm import licenses, near_copies, set_links, simhash, toxicity
from tapeline.llm.common import maybe_listed

from .conftest import EDGE


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def base_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    at, labels = [], set()
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_match_brute_force(spark, docs):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows] + [(10**6 + k, t) for k, (_, t) in enumerate(EDGE)] + [(10**7, "mit mit license general public license public license general public license MIT\tLICENSE")]
    got = licenses.license_report(licenses.license_spans(docs(rows))).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(text[r.doc_id]), r
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_diagonals_merge_over_inserted_words(docs):
    text = "This work is licensed, as said, under the GNU General Public License (GPL), version 3"
    got = licenses.license_report(licenses.license_spans(docs([(1, "x " * 50 + text), (2, "nothing here"), (3, text.replace("GNU", "other").replace("licensed", "not"))]))).orderBy("doc_id").collect()
    assert got[0].labels == "gpl,gpl-3.0" and got[0].n_base == 1
    assert got[1].labels == "" and got[1].score == 0.0
    assert "gpl-3.0" not in got[2].labels


@pytest.mark.parametrize("put", [lambda w: w, lambda w: [*w[:2], "(inserted)", *w[2:]]])
def test_templates_are_told_apart(docs, put):
    texts = [" ".join(["x y"] + put(t.split()) + ["z"]) for _, t in licenses.TEMPLATES]
    got = {r.doc_id: set(r.labels.split(",")) - {"mit", "apache", "gpl", ""} for r in licenses.license_report(licenses.license_spans(docs(list(enumerate(texts))))).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert got[i] == {label}, (texts[i], got[i])


def test_other_versions_and_kinds_give_no_label(docs):
    texts = [
        "This work is licensed under the GNU General Public License, version 9", "Licensed under CC BY-NC-ND 4.0", "Licensed under the Apache License, Version 1.1",
        "licensed and under pressure the apache were released", "This work is licensed under a Creative Commons Attribution-NonCommercial 2.5 International License",
    ]
    got = licenses.license_report(licenses.license_spans(docs(list(enumerate(texts))))).orderBy("doc_id").collect()
    assert [set(r.labels.split(",")) & {"gpl-2.0", "gpl-3.0", "cc-by-4.0", "cc-by-nc-4.0", "apache-2.0"} for r in got] == [set()] * 5, got


def test_license_edges(spark, docs):
    got = {r.doc_id: r for r in licenses.license_report(licenses.license_spans(docs(EDGE))).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[4].n_base == 2 and len(licenses.license_report(licenses.license_spans(docs(EDGE))).collect()) == len(EDGE) and got[5].n_words == 150_000
    assert licenses.license_report(licenses.license_spans(docs([]))).count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, keep):
    rows = [(k, t) for k, t in enumerate(["A b", "a B", "a b", "É", "é", None, "", "z"] + ["same"] * 1000)] + [(3, "É"), (None, "zz")]
    got = ed.exact_dedup(docs(rows), keep=keep).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    pick = min if keep == "min" else max
    for r in got:
        t = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in groups[t])
        best = pick([i for i in groups[t] if i is not None], default=None)
        assert (r.keep_id, r.group_size) == (best, len(groups[t])) and (not r.kept or r.doc_id == best)
    assert sum(r.kept for r in got) == len(groups)
    assert ed.exact_dedup(docs([])).count() == 0


def test_collisions_leave_the_group(docs):
    rows = [(k, t) for k, t in enumerate(["aa", "ab", "aa", "ab", "ac", "b"])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in ed.exact_dedup(docs(rows), hashed=F.substring("t", 1, 1)).collect()}
    assert got == {0: (0, 2), 2: (0, 2), 1: (1, 2), 3: (1, 2), 4: (4, 1), 5: (5, 1)}


def brute_fp(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(text)) if x]
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 4:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fp(r.text) for r in rows}
    want = brute_components(fps)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fp % (1 << 64), r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("chunk, parts", [(4096, None), (40, None), (4096, simhash.FINE)])
def test_links_of_planted_fingerprints(spark, chunk, parts):
    rng = random.Random(5)
    fps = set()
    for centre in (0, rng.getrandbits(64), rng.getrandbits(64)):  # dense balls, chains and strangers
        for _ in range(150):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    x = rng.getrandbits(64)
    for k in range(12):
        fps.add(x)
        for b in rng.sample(range(64), 4 if k % 3 else 5):
            x ^= 1 << b
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    want = brute_components(dict(enumerate(fps)))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    edges = simhash.links(simhash.with_pivots(nodes), chunk=chunk, parts=parts)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
    groups, mine = {}, {}
    for k, x in enumerate(fps):
        groups.setdefault(want[k], set()).add(x)
        mine.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_simhash_edges(docs):
    got = [r for r in simhash.near_duplicates(docs(EDGE)).collect()]
    assert len(got) == len(EDGE)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and all(r.fp == 0 for r in got if r.doc_id in (1, 2, 3))
    assert simhash.near_duplicates(docs([])).count() == 0


def shingles(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(text)) if x]
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)} if w else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def similar_roots(texts):
    s = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if b < a and 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in s}


def planted(words, want, rng):
    """``words`` with words replaced, one after the other, as long as the share of equal shingles stays at ``want`` or more."""
    now, base = list(words), shingles(" ".join(words))
    for k in rng.sample(range(len(words)), len(words)):
        then = [*now[:k], f"other{k}", *now[k + 1 :]]
        if share(base, shingles(" ".join(then))) < want:
            break
        now = then
    return " ".join(now)


@pytest.mark.parametrize("small, sample", [(1024, 1), (3, 1), (3, 0)])
def test_stage_finds_copies_of_similarity_at_least_0_8(spark, docs, monkeypatch, small, sample):
    forest, linked = near_copies.bucket_forest, near_copies.linked_components  # with 3, buckets and clusters are many pieces
    monkeypatch.setattr(near_copies, "bucket_forest", lambda *a: forest(*a, chunk=small, short=min(small, 16)))
    monkeypatch.setattr(near_copies, "linked_components", lambda e, n, sets: linked(e, n, sets, piece=small))
    monkeypatch.setattr(near_copies, "SAMPLE", sample)  # the share of texts searched; with 0, no shingle is known to be common
    rng = random.Random(11)
    passage = [f"common{k}" for k in range(60)]
    rows, by_share = {}, {}
    for k in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(500)]
        rows[100 * k] = " ".join(words)
        for j, want in enumerate((0.8, 0.85, 0.9, 0.95, 0.7)):
            rows[100 * k + j + 1] = planted(words, want, rng)
            by_share[100 * k + j + 1] = share(shingles(rows[100 * k]), shingles(rows[100 * k + j + 1]))
        rows[100 * k + 50] = " ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(8))])
        rows[100 * k + 51] = " ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(40))])
    start = [f"x{k}" for k in range(200)]
    for k in range(40):  # a chain whose ends aren't alike
        rows[5000 + k] = " ".join(start)
        start[5 * k % 200 : 5 * k % 200 + 6] = [f"y{k}x{j}" for j in range(6)]
    rows |= {9001: "a b c", 9002: "A  b\tc", 9003: "", 9004: None, 9005: "a b d"}
    assert all(s >= 0.8 or i % 100 == 5 for i, s in by_share.items())
    want = similar_roots(rows)
    got = near_copies.similar_groups(docs(list(rows.items()))).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    kept = {r.doc_id for r in near_copies.near_dedup_stage(spark, docs(list(rows.items())), "").collect()}
    assert kept == set(want.values()) and not kept & {100 * k + j for k in range(12) for j in (1, 2, 3, 4)}


def test_stage_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = similar_roots({r.doc_id: r.text for r in df.collect()})
    assert {r.doc_id: r.component_id for r in near_copies.similar_groups(df).collect()} == want
    assert near_copies.similar_groups(df.limit(0)).count() == 0


ROWS = [(1, "same text"), (2, "same text"), (2, "other words here"), (3, "rep"), (3, "rep"), (None, "same text"), (None, "null twice"), (None, "null twice"), (None, None), (4, ""), (5, "Same Text")]


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_leave_exactly_one_row_of_a_group(spark, docs):
    want = {(1, "same text"), (2, "other words here"), (3, "rep"), (None, "null twice"), (4, "")}
    for stage in (ed.exact_dedup_stage, near_copies.near_dedup_stage):
        for rows in (ROWS, ROWS[::-1] * 2):
            got = left(stage(spark, docs(rows).repartition(3), ""))
            assert set(got) == want and len(got) == len(want), stage
    more = [(7, "alpha beta gamma delta eps zeta"), (7, "ALPHA beta gamma delta eps  zeta"), (6, "x"), (6, "x"), (6, "y")]
    assert left(near_copies.near_dedup_stage(spark, docs(more), "")) in ([(6, "x"), (6, "y"), more[0]], [(6, "x"), (6, "y"), more[1]])
    for stage in (ed.exact_dedup_stage, near_copies.near_dedup_stage):
        assert stage(spark, docs([]), "").count() == 0


def test_rows_are_judged_by_their_own_text(spark, docs, tmp_path, monkeypatch):
    weights = np.zeros(toxicity.N_VOTERS + 4)
    weights[: toxicity.N_VOTERS], weights[-1] = 10, -5  # any vote is enough
    monkeypatch.setattr(toxicity, "lexicon_of", lambda rows, train: ["bad"])
    monkeypatch.setattr(toxicity, "learn", lambda votes, train: weights)
    spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, "bad"), (None, "clean"), (None, None), (1, "bad"), (1, "clean"), (1, "clean")]
    assert left(toxicity.toxicity_stage(spark, docs(rows), str(tmp_path))) == sorted([(None, "clean"), (None, None), (1, "clean"), (1, "clean")], key=repr)


def test_bitmaps_lose_no_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 700, 6000):
        s = rng.integers(-(1 << 62), 1 << 62, n)
        for cut in (0, n // 18, n // 9):
            t = np.concatenate([s[cut:], rng.integers(-(1 << 62), 1 << 62, cut)])
            maps = set_links.parity_bitmaps(np.concatenate([s, t]), np.repeat([0, 1], n), 2, 512)
            pop = set_links.differing(maps[:1], maps[1:])
            assert pop[0] <= 2 * cut and set_links.may_share(pop, np.array([n]), np.array([n]))[0]


def test_stages_keep_columns_of_any_name_and_type(spark):
    rows = [(1, "one text of words", {"k": 1}, "z", (1, None)), (1, "one text of words", {"k": 2}, None, None), (2, "One text of words", None, "z", (2, "é")), (3, "another", {}, "y", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, m map<string, int>, `a.b` string, `odd ``name` struct<x: int, y: string>")
    for stage in (ed.exact_dedup_stage, near_copies.near_dedup_stage):
        out = stage(spark, df, "")
        assert out.schema == df.schema and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_dedup_of_a_text_of_a_megabyte(spark, docs):
    long = " ".join(f"word{k}" for k in range(120_000))
    rows = [(1, long), (2, long.upper()), (3, long + " more"), (4, long[: len(long) // 2])]
    assert [i for i, _ in left(ed.exact_dedup_stage(spark, docs(rows), ""))] == [1, 3, 4]
    assert [i for i, _ in left(near_copies.near_dedup_stage(spark, docs(rows), ""))] == [1, 4]


def test_bitmap_of_listed_keys_lets_all_listed_rows_pass(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k"), "id")
    listed = rows.filter("id % 50 = 0")
    left_over = {r.id for r in maybe_listed(rows, "k", listed, "k").collect()}
    assert {*range(0, 20_000, 50)} <= left_over and len(left_over) < 3000
    assert maybe_listed(rows, "k", listed.filter("false"), "k").count() == 0
