"""Chat formatting with a grammar round trip."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import through_python

# The control strings that open and close a role's turn. Other roles: [ROLE]name[TEXT]text[/ROLE].
TURNS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: The sign put after the first character of a control string inside a text. One more is put where some stand already.
ESC = "␛"
LEARNED = "assistant"  # the role under the loss mask

CONTROLS = sorted({x for pair in TURNS.values() for x in pair} | set(OTHER))
_FOUND = re.compile("|".join(f"(?:{re.escape(c[0])}){ESC}*(?:{re.escape(c[1:])})" for c in CONTROLS))
_BARE = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str, controls: set[str]) -> str:
    """Put one sign more into each of these control strings."""
    return _FOUND.sub(lambda m: m[0][0] + ESC + m[0][1:] if m[0].replace(ESC, "") in controls else m[0], text)


def unescape(text: str) -> str:
    return _FOUND.sub(lambda m: m[0].replace(ESC, "", 1), text)


def render(role: str, text: str, controls: set[str]) -> tuple[str, int, int]:
    """The turn's string, and where its text begins and ends in it."""
    body = escape(text, controls)
    if role in TURNS:
        head, tail = TURNS[role]
    else:
        head, tail = OTHER[0] + escape(role, controls) + OTHER[1], OTHER[2]
    return head + body + tail, len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a string, from left to right, by bare control strings alone; ValueError at anything the grammar lacks."""
    openers = {head: (role, tail) for role, (head, tail) in TURNS.items()}
    turns, at = [], 0
    found = _BARE.finditer(rendered)
    for m in found:
        if m.start() != at:
            raise ValueError("text between turns")
        role, tail = openers.get(m[0], (None, OTHER[2]))
        if role is None:
            if m[0] != OTHER[0] or (name := next(found, None)) is None or name[0] != OTHER[1]:
                raise ValueError("no turn begins here")
            role, m = unescape(rendered[m.end() : name.start()]), name
            if role in TURNS:
                raise ValueError("role has a form of its own")
        close = next(found, None)
        if close is None or close[0] != tail:
            raise ValueError("turn not closed")
        turns.append((role, unescape(rendered[m.end() : close.start()])))
        at = close.end()
    if at != len(rendered):
        raise ValueError("text after turns")
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """Render, reparse and compare; escape one more of the control strings that stand in the content until the turn comes back."""
    conflicts = iter(dict.fromkeys(m.replace(ESC, "") for m in _FOUND.findall(text) + _FOUND.findall(role)))
    controls: set[str] = set()
    while True:
        out = render(role, text, controls)
        try:
            if parse(out[0]) == [(role, text)]:
                return out
        except ValueError:
            pass
        controls.add(next(conflicts))  # with all of them escaped the turn comes back


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, rendered, loss_start, loss_end: a string for each turn, in order within a conversation; the conversation is their
    concatenation. The span (else null) is the part of the string under the loss mask: an assistant's text, still escaped.

    Rows are ordered by turn (null first), then role and the text's SHA-256; rows that repeat are turns of their own. Null roles and
    texts are empty. Other columns are ignored.

    Scale: turns are formatted where they lie; then one shuffle by conversation, sorted. A conversation of any length needs the memory
    of a batch, and only its digest goes turn by turn.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [format_turn(r, t) for r, t in zip(f["role"], f["text"], strict=True)]
            mask = f["role"].to_numpy() == LEARNED
            got = pd.DataFrame(out, columns=["rendered", "loss_start", "loss_end"])
            got[["loss_start", "loss_end"]] = got[["loss_start", "loss_end"]].astype("Int64").where(pd.Series(mask), pd.NA)
            yield pd.concat([f[["conv_id", "turn", "role", "key"]].reset_index(drop=True), got], axis=1)

    made = through_python(rows, run, "role string, key binary, rendered string, loss_start bigint, loss_end bigint", ("conv_id", "turn"))
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "key").select("conv_id", "rendered", "loss_start", "loss_end")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from its strings and masks alone: counts and digests of the turns parsed and the text under the mask.

    ``formatted`` as format_conversations gives it: whole conversations in a partition, in order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None

        def row() -> tuple:
            conv, n, turns, chars, loss, size = now
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for f in frames:
            out = []
            convs = f["conv_id"].astype(object).where(f["conv_id"].notna(), None)
            for conv, text, a, b in zip(convs, f["rendered"], f["loss_start"], f["loss_end"], strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if not pd.isna(a):
                    learned = unescape(text[int(a) : int(b)])
                    now[3] += len(learned)
                    now[4].update(learned.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([row()], columns=names)

    schema = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = ["conv_id", *(x.split()[0] for x in schema.split(", "))]
    return through_python(formatted, run, schema, ("conv_id",))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return read_back(format_conversations(rows.unionByName(extra)))


_PATTERN = "|".join(f"{re.escape(c[0])}{ESC}*{re.escape(c[1:])}" for c in CONTROLS)
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_PATTERN}')) + CASE role WHEN 'system' THEN {len("".join(TURNS["system"]))} WHEN 'user' THEN {len("".join(TURNS["user"]))}
  WHEN 'assistant' THEN {len("".join(TURNS["assistant"]))} ELSE {len("".join(OTHER))} + length(role) + len(regexp_extract_all(role, '{_PATTERN}')) END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
