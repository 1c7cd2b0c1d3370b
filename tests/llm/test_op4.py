"""Chat formatting: exact round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tapeline.llm import chat

PIECE = st.sampled_from([*chat.CONTROLS, chat.ESC, "[", "<", "/s>", "INST]", "x", "\n", "[␛INST]", "<␛␛/s>", "é"])
TEXT = st.lists(PIECE, max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]) | TEXT, TEXT), max_size=4))
def test_conversations_come_back(turns):
    out = [chat.format_turn(*t) for t in turns]
    assert chat.parse("".join(x[0] for x in out)) == turns
    for (_, text), (s, a, b) in zip(turns, out):
        assert chat.unescape(s[a:b]) == text


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    convs = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        convs.setdefault(c, []).append((role, text or ""))
    got = chat.op4_chat(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(convs)
    for r in got:
        t = convs[r.conv_id]
        loss = "".join(x for role, x in t if role == "assistant")
        assert r.n_turns == len(t) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > sum(len(b) for _, b in t)


def test_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, rendered string, loss_start int"
    rows = [(1, 0, None, None, "x", 1), (1, None, "user", "", "x", 1), (None, 2, "assistant", "[INST]" * 20_000, "x", 1), (2, 5, "assistant", "a", "", 0), (2, 5, "assistant", "a", "", 0)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].n_turns == 2 and got[1].turns_sha256 == hashlib.sha256(b"user\n\n\n\n").hexdigest()
    assert got[None].loss_chars == 120_000 and got[2].loss_chars == 2 and got[2].n_turns == 2
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0
