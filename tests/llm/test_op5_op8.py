"""Language and toxicity: brute-force counts and distances, and held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np

from tapeline.llm import langid, toxicity

from .conftest import EDGE


def brute_grams(text):
    sym = "".join(c if c.isalpha() else " " for c in text.lower())
    sym = " " + " ".join(sym.split()) + (" " if sym[-1:] == " " and sym.strip() else "")
    out = Counter()
    for i, c in enumerate(sym):
        if c != " ":
            out[c] += 1
        if i and not (sym[i - 1] == " " and c == " "):
            out[sym[i - 1 : i + 1]] += 1
        if i > 1 and sym[i - 1] != " ":
            out[sym[i - 2 : i + 1]] += 1
    return out


def unpack(g):
    return "".join(" " if c == langid.EDGE else chr(c) for c in (g >> 42 & 0x1FFFFF, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if c)


def test_gram_counts_match_brute_force():
    texts = ["Hello, wörld!", "a", "ab  cd", "日本語 x", "ÀÉ1b", "z."]
    owner, gram, n = langid.gram_counts(texts, np.arange(len(texts)))
    for k, t in enumerate(texts):
        got = {unpack(g): c for o, g, c in zip(owner.tolist(), gram.tolist(), n.tolist()) if o == k}
        want = brute_grams(t)
        ends = {g: c for g, c in got.items() if g not in want}
        assert all(got[g] == c for g, c in want.items() if not g.endswith(" ")), t
        assert all(g.endswith(" ") for g in ends)
    # the two ways of counting agree
    one = langid.gram_counts(texts * 40, np.zeros(len(texts) * 40, np.int64))
    many = langid.gram_counts(texts * 40, np.arange(len(texts) * 40))
    total = Counter()
    for g, c in zip(many[1].tolist(), many[2].tolist()):
        total[g] += c
    assert total == dict(zip(one[1].tolist(), one[2].tolist()))


def test_distances_match_brute_force():
    rng = random.Random(1)
    texts = {"en": "the cat and the dog " * 5, "fr": "le chat et la chienne " * 5}
    rows = []
    for lang, t in texts.items():
        c = Counter()
        for o, g, n in zip(*(x.tolist() for x in langid.gram_counts([t], np.zeros(1, np.int64)))):
            c[g] += n
        rows += [(lang, g, k) for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:300])]
    p = langid.Profiles(rows)
    rank = {lang: {g: k for x, g, k in rows if x == lang} for lang in texts}
    for t in ["the cat", "la", "".join(rng.choice("abcde ") for _ in range(200)), "..."]:
        c = Counter()
        for o, g, n in zip(*(x.tolist() for x in langid.gram_counts([t], np.zeros(1, np.int64)))):
            c[g] += n
        top = [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:300]]
        d, letters = p.distances([t])
        for k, lang in enumerate(p.langs):
            want = sum(abs(rank[lang][g] - i) if g in rank[lang] else 300 for i, g in enumerate(top)) / max(1, 300 * len(top))
            assert abs(d[0, k] - want) < 1e-12
        assert letters[0] == any(c.isalpha() for c in t)


def test_language_accuracy_and_split(spark):
    got = langid.op5_langid(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) >= 0.98


def test_language_edges(docs):
    df = docs([*EDGE, (20, "the cat and the dog"), (21, "123 !!"), (22, "the cat and the dog"), (23, "the cat and the dog")], lang={20: "en", 22: "en", 23: "en"})
    got = langid.identify(df, langid.fit(df)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE) + 4 and all(by[i].lang_pred == "und" for i in (1, 2, 3, 21)) and by[20].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(df, langid.fit(docs([]))).collect()} == {"und"}
    assert langid.identify(docs([]), langid.fit(docs([]))).count() == 0


def corpus(n=3000, seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["zquor", "zquorry", "wexal", "vumbo", "kreet", "plixt"]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(base, k=rng.randint(20, 120))
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(1, 4) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w).capitalize() + "."))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return rows, labels, {i for i, t in rows if any(b in t.lower().replace(".", "").split() for b in bad)}


def test_toxicity_accuracy(spark, docs):
    rows, labels, truth = corpus()
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.score_toxicity(docs([*rows, *EDGE, (9000, "kreet " + rows[0][1])]), lab).collect()
    assert len(got) == len(rows) + len(EDGE) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    own = [r for r in got if r.doc_id is not None and r.doc_id > 8 and r.doc_id < 3000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    tp = sum(r.predicted and r.doc_id in truth for r in own)
    assert tp >= 0.97 * sum(r.doc_id in truth for r in own) and sum(r.predicted and r.doc_id not in truth for r in own) == 0
    assert next(r for r in got if r.doc_id == 9000).predicted == 1


def test_toxicity_edges(spark, docs):
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_toxicity(docs(EDGE), lab).collect()
    assert len(got) == len(EDGE) and all(r.score == 0 for r in got)
    assert toxicity.score_toxicity(docs([]), lab).count() == 0


def test_label_model_weighs_correlated_voters_down(spark):
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.1
    hit = lambda a, b: rng.random(len(y)) < np.where(y, a, b)
    h = np.zeros((len(y), toxicity.N_VOTERS), bool)
    h[:, 0], h[:, 1], h[:, 2] = hit(0.6, 0.01), hit(0.5, 0.02), hit(0.7, 0.01)
    h[:, 3] = h[:, 2]
    bits = (h.astype(np.int64) << np.arange(toxicity.N_VOTERS)).sum(axis=1)
    votes = spark.createDataFrame([(int(v),) for v in bits], "votes bigint")
    known = spark.createDataFrame([(int(v), int(t)) for v, t in zip(bits[:3000], y[:3000])], "votes bigint, toxic int")
    m = toxicity.fit_label_model(votes, known)
    assert np.allclose(m.toxic[:3], [0.6, 0.5, 0.7], atol=0.08) and abs(m.prior - 0.1) < 0.03
    assert m.weight[2] < 0.6 and m.weight[3] < 0.6 and m.weight[0] > 0.7
