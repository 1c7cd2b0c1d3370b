"""Media columns: bytes in an MPEG transport stream, and back.

The stream has a program association table, a program map table and one elementary stream of private data in PES packets.
Layouts follow ISO/IEC 13818-1.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, through_python, written

PACKET, BODY = 188, 184
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data
#: Payload bytes of a PES packet; samples a second (8-bit samples); PES packets from one random-access point to the next.
UNIT, RATE, RAP_EVERY = 8192, 8000, 4
CLOCK = 90_000
#: Bytes of text whose streams are made at once.
BYTES = 16_000_000


@lru_cache(maxsize=4096)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | 5 + len(body) + 4).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(
    PMT_PID,
    _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _pts_bytes(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254])


def _pts_value(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload. An empty payload has tables and no PES packet."""
    parts, cc, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pts = at * CLOCK // RATE
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (8 + len(unit)).to_bytes(2, "big") + b"\x80\x80\x05" + _pts_bytes(pts) + unit
        field = b""  # of the first packet: random access and the program clock
        if k % RAP_EVERY == 0:
            for table in (PAT, PMT):
                row = table.copy()
                row[3] |= tables & 15
                parts.append(row.tobytes())
            tables += 1
            clock = pts & (1 << 33) - 1
            field = b"\x07\x50" + (clock << 15 | 0x7E00).to_bytes(6, "big")
        first = BODY - len(field)
        n = 1 + max(0, -(-(len(pes) - first) // BODY))
        rows = np.zeros((n, PACKET), np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        rows[:, 3] = 0x10 | (cc + np.arange(n)) & 15
        rows[0, 1] |= 0x40
        cc += n
        body = np.frombuffer(pes, np.uint8)
        spare = first + (n - 1) * BODY - len(pes)  # bytes to stuff in the last packet
        if n == 1:
            field = _stuffed(field, spare)
            _fill(rows[0], field, body)
        else:
            _fill(rows[0], field, body[:first])
            rows[1:-1, 4:] = body[first : first + (n - 2) * BODY].reshape(n - 2, BODY)
            _fill(rows[-1], _stuffed(b"", spare), body[first + (n - 2) * BODY :])
        parts.append(rows.tobytes())
    return b"".join(parts) or PAT.tobytes() + PMT.tobytes()


def _stuffed(field: bytes, spare: int) -> bytes:
    """An adaptation field made longer by ``spare`` bytes."""
    if not spare:
        return field
    if not field:
        return bytes([spare - 1]) + (b"\x00" + b"\xff" * (spare - 2) if spare > 1 else b"")
    return bytes([field[0] + spare]) + field[1:] + b"\xff" * spare


def _fill(row: np.ndarray, field: bytes, body: np.ndarray) -> None:
    if field:
        row[3] |= 0x20
        row[4 : 4 + len(field)] = np.frombuffer(field, np.uint8)
    row[4 + len(field) :] = body


def read_stream(media: bytes) -> dict:
    """payload, pts (one per PES packet), random_access (indexes of PES packets), cc_errors, packets.

    Raises ValueError if sync bytes, table checksums, start codes or PES lengths are wrong.
    """
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        raise ValueError("sync byte lost")
    pid = (rows[:, 1].astype(np.int32) & 31) << 8 | rows[:, 2]
    pmt_pid = _pat_program(_sections(rows[pid == 0]))
    es_pid = _pmt_stream(_sections(rows[pid == pmt_pid]))
    errors = sum(_gaps(rows[pid == p]) for p in (0, pmt_pid))
    es = rows[pid == es_pid]
    errors += _gaps(es)
    if not len(es):
        return {"payload": b"", "pts": [], "random_access": [], "cc_errors": errors, "packets": len(rows)}
    adapted = es[:, 3] & 0x20 > 0
    start = 4 + np.where(adapted, es[:, 4].astype(np.int32) + 1, 0)
    begins = np.flatnonzero(es[:, 1] & 0x40)
    access = adapted & (es[:, 4] > 0) & (es[:, 5] & 0x40 > 0)
    flat = es[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    offsets = [*(ends[begins] - (PACKET - start[begins])).tolist(), len(flat)]
    units, pts = [], []
    for a, b in zip(offsets, offsets[1:], strict=False):
        pes = flat[a:b]
        if pes[:3] != b"\x00\x00\x01" or int.from_bytes(pes[4:6], "big") != len(pes) - 6:
            raise ValueError("broken PES packet")
        pts.append(_pts_value(pes[9:14]))
        units.append(pes[9 + pes[8] :])
    return {"payload": b"".join(units), "pts": pts, "random_access": np.flatnonzero(access[begins]).tolist(), "cc_errors": errors, "packets": len(rows)}


def _gaps(rows: np.ndarray) -> int:
    """Packets whose continuity counter doesn't follow the one before."""
    cc = rows[:, 3].astype(np.int32) & 15
    return int(((cc[1:] - cc[:-1]) & 15 != 1).sum())


def _sections(rows: np.ndarray) -> bytes:
    """The section of a table's first packet, with its checksum verified; every packet's is checked."""
    found = b""
    for raw in {r.tobytes()[4:] for r in rows}:
        data = raw[1 + raw[0] :]
        section = data[: 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)]
        if crc32_mpeg(section) != 0:
            raise ValueError("table checksum")
        found = section
    return found


def _pat_program(section: bytes) -> int:
    for at in range(8, len(section) - 4, 4):
        if section[at : at + 2] != b"\x00\x00":
            return int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
    raise ValueError("no program")


def _pmt_stream(section: bytes) -> int:
    at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
    if at + 5 > len(section) - 4:
        raise ValueError("no elementary stream")
    return int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF


def _padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a transport stream.

    Null and empty texts give 64 bytes of 0. Rows map to rows one by one, so repeated rows repeat; other columns are ignored.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = frame["t"].map(lambda t: len(t or "")).to_numpy()
            for _, part in frame.groupby(np.cumsum(size) // BYTES, sort=False):  # few long texts in memory at once
                padded = [_padded(t) for t in part["t"]]
                yield pd.DataFrame({"id": part["id"].array, "n_bytes": [n for n, _ in padded], "media": [write_stream(p) for _, p in padded]})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return through_python(rows, write, "n_bytes bigint, media binary").withColumnRenamed("id", id_col)


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def stream_features(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """Columns ``keep`` and what is read back from the stored streams: digests, and a feature string.

    The feature holds counts of packets and PES packets, the first and last timestamp, the random-access timestamps' count and last,
    counter errors, and mean and mean absolute difference of the samples in thousandths.
    """

    def features(raw: bytes) -> tuple:
        got = read_stream(raw)
        data = got["payload"]
        x = np.frombuffer(data, np.uint8)
        mean = int(x.sum(dtype=np.int64)) * 1000 // max(1, len(x))
        step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) * 1000 // max(1, len(x) - 1)
        pts, rap = got["pts"], got["random_access"]
        text = f"packets={got['packets']};pes={len(pts)};pts={pts[0] if pts else '-'}..{pts[-1] if pts else '-'};rap={len(rap)}@{pts[rap[-1]] if rap else '-'};cc_errors={got['cc_errors']};mean={mean};step={step}"
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), text

    names = [x.split()[0] for x in FEATURES.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = pd.DataFrame([features(bytes(x)) for x in frame[media_col]], columns=names)
            yield pd.concat([frame[keep].reset_index(drop=True), got], axis=1)

    return through_python(media.select(*keep, media_col), read, FEATURES, tuple(keep))


def timestamps(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, unit (PES packet, from 0), pts (90 kHz), random_access: a row per PES packet of the stored streams, to seek by.

    A null id stays null; rows that repeat give their packets again; an empty table gives an empty one.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ident, raw in zip(frame["id"].array, frame["media"], strict=True):
                got = read_stream(bytes(raw))
                access = set(got["random_access"])
                out += [(ident, k, pts, k in access) for k, pts in enumerate(got["pts"])]
            yield pd.DataFrame(out, columns=["id", "unit", "pts", "random_access"])

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return through_python(rows, read, "unit bigint, pts bigint, random_access boolean").withColumnRenamed("id", id_col)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams are stored as a table's column and read back from there."""
    stored = written(text_media(documents(spark, sf_dir)), "media", "zstd")
    return stream_features(stored, ["doc_id", "n_bytes"])
