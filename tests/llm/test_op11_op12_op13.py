import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from tapeline.llm import merkle, minhash, set_links, ztrie
from tests.llm.conftest import EDGE


def shingles(text, n=2):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(rows, n=2):
    """Smallest id reachable, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def planted(seed=0):
    """Random texts, copies at several distances, a ball of near copies around one text, a chain."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: list(rng.choice(vocabulary, n))

    def edit(words, k):
        words = list(words)
        for i in rng.choice(len(words), k, replace=False):
            words[i] = str(rng.choice(vocabulary))
        return words

    rows = [text(int(n)) for n in rng.integers(1, 300, 40)]
    base = text(150)
    rows += [edit(base, int(k)) for k in rng.integers(0, 14, 150)]
    chain = [text(120)]
    for _ in range(30):
        chain.append(edit(chain[-1], 3))
    long = text(3000)
    rows += chain + [long, edit(long, 100), edit(long, 170), edit(long, 800)]
    order = rng.permutation(len(rows))
    return [(int(order[i]) + 100, " ".join(r)) for i, r in enumerate(rows)]


def components_of(spark, docs, rows):
    out = minhash.similar_sets(docs(rows)).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


def test_minhash_equals_all_pairs(docs, spark):
    rows = planted() + EDGE
    assert components_of(spark, docs, rows) == groups(rows)


def test_minhash_in_small_pieces(docs, spark, monkeypatch):
    """Buckets of many chunks, clusters of many pieces, links between pieces that only the second pass finds."""
    monkeypatch.setattr(minhash, "bucket_forest", lambda *a: set_links.bucket_forest(*a, chunk=8, short=3))
    monkeypatch.setattr(minhash, "linked_components", lambda e, n, s: set_links.linked_components(e, n, s, piece=8))
    rows = planted(1)
    assert components_of(spark, docs, rows) == groups(rows)


def test_minhash_of_nothing(docs, spark):
    assert minhash.similar_sets(docs([(1, "a b")])).filter("false").count() == 0
    assert components_of(spark, docs, []) == []
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (None, "one"), (5, "É é"), (6, "é é")]
    assert components_of(spark, docs, rows) == groups(rows)


def test_sketches_never_discard_a_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 1000, 1100, 5000):
        base = rng.integers(-(1 << 63), 1 << 63, n)
        d = n // 9  # two sets of n that share n - d: just similar enough
        other = np.concatenate([base[d:], rng.integers(-(1 << 63), 1 << 63, d)])
        far = np.concatenate([base[n // 2 :], rng.integers(-(1 << 63), 1 << 63, n // 2)])
        values, sizes = np.concatenate([base, other, far]), np.array([len(base), len(other), len(far)])
        sketch = minhash.odd_sketches(values, np.append(0, np.cumsum(sizes)))
        pop = set_links.differing(sketch[[0, 0]], sketch[[1, 2]])
        assert minhash.may_link(pop, sizes[[0, 0]], sizes[[1, 2]])[0]
        if 40 <= n <= 1000:
            assert not minhash.may_link(pop, sizes[[0, 0]], sizes[[1, 2]])[1]
        if n >= 300:  # the estimate itself
            near = minhash.estimated_similarity(pop, sizes[[0, 0]], sizes[[1, 2]])
            assert abs(near[0] - (n - d) / (n + d)) < 0.06


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha256("".join(levels[-1][i : i + 2]).encode()).hexdigest() for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i ^ 1 < len(level), i & 1, level[i ^ 1] if i ^ 1 < len(level) else ""))
        i >>= 1
    return out


def expected_manifest(rows, every=7):
    """rows: doc_id, text, lang, source, n_chars."""

    def leaf(r, more=0):
        fields = (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
        return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields).encode()).hexdigest()

    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    of = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree_of([leaf(r) for r in of[g]]) for g in langs}
    top = tree_of([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(of[g]):
            path = climb(trees[g], i) + climb(top, k)
            changed = r[0] is not None and r[4] is not None and crc32(str(r[0]).encode()) % every == 0
            now = leaf(r, int(changed))
            for there, right, d in path:
                now = sha256(((d + now if right else now + d) if there else now).encode()).hexdigest()
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha256("".join(d for *_, d in path).encode()).hexdigest(), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_merkle_manifest(spark, levels):
    rng = np.random.default_rng(levels)
    rows = [(int(i), f"text {i}", [None, "de", "en", "É", "x"][min(4, int(rng.integers(0, 9)))], None if i % 5 == 0 else "s", None if i % 6 == 0 else int(i)) for i in rng.permutation(150)]
    rows += [(None, None, "de", "s", 4), (3, "again", "en", "s", 1), (3, "again", "en", "s", 1), (9_007_199_254_740_993, "", "one", None, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"digest": F.lit("x"), "tree": F.lit(1), "n": F.lit(2)})
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = merkle.digest_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS))
    got = sorted((tuple(r) for r in merkle.manifest(df, changed=F.when(hit, changed), levels=levels).collect()), key=str)
    assert got == expected_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_merkle_edges(spark):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert merkle.manifest(spark.createDataFrame([], kind)).count() == 0
    one = [(7, "a", "en", "s", 1)]
    assert [tuple(r) for r in merkle.manifest(spark.createDataFrame(one, kind)).collect()] == expected_manifest(one, every=1 << 40)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_log_positions_are_the_postorder(spark, n):
    """Every position once, children before their parent, and left before right."""
    leaves = spark.createDataFrame([(0, i, n, f"{i}") for i in range(n)], "tree bigint, index bigint, n bigint, digest string")
    nodes = {(r["level"], r["index"]): r["position"] for t in merkle.append_log(leaves, 2) for r in t.collect()}
    order, top = [], merkle.height(n)

    def visit(level, index):
        for child in (2 * index, 2 * index + 1) if level else ():
            if (level - 1, child) in nodes:
                visit(level - 1, child)
        order.append((level, index))

    visit(top, 0)
    assert {x: i for i, x in enumerate(order)} == nodes


def trie_of(sequences):
    """sequences: conv_id -> list of (role, text). All nodes by plain dictionaries."""
    members, ends = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, m in members.items():
        below = [x for x in members if x[: len(p)] == p]
        children = [x for x in below if len(x) == len(p) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(children), len(leaves), sum((len(members[x]) - 1) * words(x) for x in below), sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt_of(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(own[c], key=lambda x: x[:2])] for c in own}
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


CONVERSATION = "conv_id bigint, turn int, role string, text string, node string, depth int"


def nodes_of(spark, rows, batches=ztrie.BATCHES):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATION)
    return sorted((tuple(r) for r in ztrie.prefix_trie(ztrie.rebuilt(df), batches).collect()), key=str)


@pytest.mark.parametrize("batches", [(1,), (1, 1, 1, 1), ztrie.BATCHES])
def test_prefix_trie_equals_dictionaries(spark, batches):
    rng = np.random.default_rng(len(batches))
    rows = []
    for c in range(1, 130):
        for t in range(int(rng.integers(0, 9)) if c % 17 else 40):
            rows.append((c, t, ["user", None][t % 2], "" if t == 5 else f"turn {t} {rng.integers(0, 1 + (t > 1) + 3 * (t == 4))}"))
    rows += [(500, None, "user", "first"), (500, 1, None, None), (501, 1, "a", "b c"), (None, 1, "a", "nobody's"), (9_007_199_254_740_993, 1, "a", "b"), (520, 1, "É", "é   é")]
    rows += [(c, t, "user", "same") for c in range(601, 640) for t in range(6)]  # copies, base absent
    assert nodes_of(spark, rows, batches) == trie_of(rebuilt_of(rows))


def test_prefix_trie_edges(spark):
    assert nodes_of(spark, []) == []
    c = next(c for c in range(21, 40) if crc32(str(c).encode()) % 4 == 2)  # two turns go, the base is absent: nothing is left
    assert nodes_of(spark, [(c, 0, "u", "x")]) == trie_of({c: []})
    long = [(40, t, "user", f"{t}") for t in range(300)] + [(60, t, "user", f"{t}") for t in range(299)]
    assert nodes_of(spark, long) == trie_of(rebuilt_of(long))


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", ztrie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x) for r in rows)
