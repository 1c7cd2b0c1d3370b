"""Merge-dropout against an agenda per text, the model's own encoder, and exact round trips."""

import heapq
import time

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tapeline.llm import merges

from .conftest import EDGE

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  two  spaces ", "▁ sign ▁▁", "né 𝕏 \x00\n\t", "日本語テキスト", "a" * 300, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "x ▁y"]


def agenda(text, key, vocab, dropout, seed):
    """One text, one heap of candidates, without words or vectors."""
    if not text:
        return []
    codes = [ord(c) for c in " " + text]
    sym = [int(vocab.char[c]) for c in codes]
    nxt, prv = list(range(1, len(sym))) + [-1], [-1, *range(len(sym) - 1)]
    k = int(merges.mix(merges.mix(np.array([key], np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))[0])
    heap, dead = [], [False] * len(sym)

    def push(i):
        j = nxt[i] if i >= 0 else -1
        if i < 0 or j < 0 or sym[i] < 0 or sym[j] < 0:
            return
        m = int(vocab.merged(np.array([sym[i]]), np.array([sym[j]]))[0])
        if m >= 0:
            heapq.heappush(heap, (int(vocab.order[m]), i, j, sym[i], sym[j], m))

    for i in range(len(sym)):
        push(i)
    while heap:
        _, i, j, a, b, m = heapq.heappop(heap)
        if dead[i] or dead[j] or sym[i] != a or sym[j] != b or nxt[i] != j:
            continue
        inner = int(merges.mix(np.array([i << 20 ^ m], np.uint64))[0])
        if int(merges.mix(np.array([(k + inner) % (1 << 64)], np.uint64))[0]) < min(int(dropout * 2.0**64), (1 << 64) - 1):
            continue
        sym[i], dead[j] = m, True
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        push(prv[i])
        push(i)
    out, i = [], 0
    while i >= 0:
        out += [sym[i]] if sym[i] >= 0 else [int(vocab.byte_ids[b]) for b in chr(codes[i]).encode()]
        i = nxt[i]
    return out


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_agendas_and_model(spark):
    vocab = merges.vocabulary(PATH)
    texts = ODD + [r.text[:3000] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    keys = np.arange(len(texts), dtype=np.uint64) * np.uint64(977)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    plain = split(*merges.encode(texts, keys, vocab, 0.0, 1))
    for t, got in zip(texts, plain):
        if "▁" not in t:
            assert got == sp.encode(t), t[:50]
    seen = 0
    for p, seed in ((0.1, 42), (0.5, 7), (1.0, 7)):
        got = split(*merges.encode(texts, keys, vocab, p, seed))
        for t, k, ids in zip(texts, keys, got):
            assert ids == agenda(t, int(k), vocab, p, seed), (p, t[:50])
            assert merges.decode(np.array(ids), vocab) == t
        seen += sum(a != b for a, b in zip(got, plain))
    assert seen > len(texts)


def test_documents_round_trip(spark, docs):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, t) for k, (_, t) in enumerate(EDGE)]
    enc = merges.encode_documents(docs(rows))
    got = {r.doc_id: r.text for r in merges.decode_documents(enc).collect()}
    assert got == {i: t or "" for i, t in rows}
    again = merges.encode_documents(docs(rows).repartition(3))
    assert sorted(map(tuple, enc.select("doc_id", F.hash("ids")).collect())) == sorted(map(tuple, again.select("doc_id", F.hash("ids")).collect()))
    assert merges.encode_documents(docs([])).count() == 0
    other = {r.doc_id: r.ids for r in merges.encode_documents(docs(rows), seed=1).collect()}
    assert any(other[r.doc_id] != r.ids for r in enc.collect())


def test_long_words_have_the_agenda_of_short_ones(monkeypatch):
    vocab = merges.vocabulary(PATH)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("theinrsa日 "[:10]), 700)).replace(" ", "x"), "a" * 600 + " " + "b" * 5, "é" * 520 + "😀" * 10 + "z" * 30, "short words only", "ab" * 400 + " ▁ " + "x" * 513]
    keys = np.arange(len(texts), dtype=np.uint64) + np.uint64(77)
    for dropout in (0.0, 0.1, 0.5):
        got = merges.encode(texts, keys, vocab, dropout)
        monkeypatch.setattr(merges, "LONG", 10**9)
        want = merges.encode(texts, keys, vocab, dropout)
        monkeypatch.setattr(merges, "LONG", 512)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_a_word_of_a_megabyte_is_encoded_in_seconds():
    vocab = merges.vocabulary(PATH)
    word = "".join(np.random.default_rng(1).choice(list("ABCDEFGHabcdefgh0123456789+/"), 1_000_000))
    began = time.process_time()
    ids, counts = merges.encode([word], np.array([5], np.uint64), vocab)
    assert time.process_time() - began < 30 and counts[0] == len(ids) and merges.decode(ids, vocab) == word
