"""Packing against a brute-force check of every contract, and the vocabulary's two forms against each other."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tapeline.llm import packing

from .conftest import EDGE


def verify(rows, texts):
    """rows: as op7 returns them; texts: (doc_id, text) in any order."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else (len(ids) - 1) % 1024 + 1
        at = [0, *range(first, len(ids), 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)]))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_documents_are_packed_whole(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [tuple(r) for r in df.select("doc_id", "text").collect()]
    n = verify(packing.pack_documents(df).collect(), texts)
    tokens = sum(r.length for r in packing.pieces(df).select("length").collect())
    assert n <= 1.02 * -(-tokens // 1024)


def test_edges(docs):
    rows = [*EDGE, (50, "one <|endoftext|> two<|endoftext|>"), (51, "<|endoftext|>"), (51, "<|endoftext|>")]
    verify(packing.pack_documents(docs(rows)).collect(), rows)
    assert packing.pack_documents(docs([])).count() == 0


def test_added_token_is_one_id_inside_texts(docs):
    end = "<|endoftext|>"
    texts = [end, f"a{end}b", f"one  {end}  two\n{end}{end} three", "<|endoftext|", "<|EndOfText|>", f"é{end}\u3000x", f"w {end} " * 900, f"<{end}>", "<|endof" + end + "text|>"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.id, r.piece): r for r in packing.pieces(docs(list(enumerate(texts)))).collect()}
    n = 0
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        for k, (at, length) in enumerate(packing.cut(len(ids))):
            r = got[i, k]
            assert (r.start, r.length, r.ids_crc32) == (at, length, zlib.crc32(ids[at : at + length].tobytes()))
            n += 1
    assert n == len(got) and got[0, 0].length == 2
    assert {a.content: i for i, a in t.get_added_tokens_decoder().items()} == packing.SPECIAL


def test_fullest_configuration_against_all_of_them():
    for seed in range(60):
        rng = random.Random(seed)
        demand = {rng.randint(3, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        use = packing.fullest(demand, 50)
        top = max(demand)
        best = max(
            sum(s * k for s, k in zip(demand, ks))
            for ks in itertools.product(*(range(n + 1) for n in demand.values()))
            if sum(s * k for s, k in zip(demand, ks)) <= 50 and dict(zip(demand, ks))[top]
        )
        assert use[top] and all(k <= demand[s] for s, k in use.items() if k) and sum(s * k for s, k in use.items()) == best


def test_large_pieces_come_through_configurations_of_few_sizes(monkeypatch):
    rng = random.Random(4)
    counts = {}
    for _ in range(9_000):
        n = min(1024, int(rng.lognormvariate(5.7, 1.0)) + 5)
        counts[n] = counts.get(n, 0) + 1
    seen, real = [], packing.fullest
    monkeypatch.setattr(packing, "fullest", lambda demand, capacity: seen.append(sum(demand.values())) or (len(demand) <= packing.GROUPS or 1 / 0) and real(demand, capacity))
    for small in packing.SMALL:
        seen.clear()
        packing.group_and_fit(counts, 1024, small, packing.GROUPS)
        large = sum(n for s, n in counts.items() if small < s <= 1024 - min(counts))
        assert seen[0] == large and seen == sorted(seen, reverse=True) and len(set(seen)) == len(seen)
    sizes = packing.group_lengths({s: n for s, n in counts.items() if 128 < s < 1024}, packing.GROUPS)
    assert len(set(sizes.values())) <= packing.GROUPS and all(size >= s for s, size in sizes.items())
    total = sum(s * n for s, n in counts.items())
    assert max(r[3] + r[2] for r in packing.plan(counts)) <= 1.002 * total / 1024 + 1
    assert packing.plan({}) == [] and packing.plan({1024: 3, 1: 2}) and packing.plan({600: 5}) == [(600, 0, 5, 0, 0)]


def test_plan_is_whole_and_tight():
    for seed in range(8):
        rng = random.Random(seed)
        counts = {}
        for _ in range(rng.choice([3, 60, 20_000])):
            n = min(1024, int(rng.lognormvariate(5.5, 1.2)) + 1) if seed % 2 else rng.randint(1, 1024)
            counts[n] = counts.get(n, 0) + 1
        runs = packing.plan(counts)
        fill, covered = {}, {}
        for s, r, n, seq, off in runs:
            covered.setdefault(s, []).append((r, n))
            for k in range(n):
                fill.setdefault(seq + k, []).append((off, s))
        for s, n in counts.items():
            at = 0
            for r, m in sorted(covered[s]):
                assert r == at
                at += m
            assert at == n
        for b in fill.values():
            at = 0
            for off, s in sorted(b):
                assert off == at
                at += s
            assert at <= 1024
        total = sum(s * n for s, n in counts.items())
        if sum(counts.values()) > 1000:
            assert len(fill) <= 1.03 * total / 1024 + 2, (seed, len(fill), total / 1024)
