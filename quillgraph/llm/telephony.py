"""Telephony audio in table columns: G.711 and IMA ADPCM.

mu-law and A-law codes are expanded through tables of 256 values that the coding rules build; ADPCM blocks
are decoded with numpy across all blocks of a batch at once, one sample of every block at a step. PCM of
8 kHz is resampled to 16 kHz and stored as 16-bit WAV.

Defined cases: null and empty payloads are padded to one unit; a payload whose size isn't a multiple of the
ADPCM block has its last block cut; equal payloads give equal bytes and features; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

# WAVE format tags.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
RATE = 8000
#: Bytes of a stored unit; also the size of an ADPCM block: 4 of header, 188 of nibbles.
UNIT = 192

# IMA ADPCM step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law code: sign, exponent and mantissa of the inverted code, biased by 132."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law code; every other bit of the code is inverted."""
    code = np.arange(256) ^ 0x55
    exponent = (code >> 4) & 7
    size = ((code & 15) << 4) + 8 + np.where(exponent > 0, 256, 0)
    size = size << np.maximum(exponent - 1, 0)
    return np.where(code & 128, size, -size).astype(np.int16)


def ima_table() -> tuple[np.ndarray, np.ndarray]:
    """By step index and nibble: the change of the sample, and the next step index."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    after = np.clip(np.arange(len(STEPS))[:, None] + INDEX[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), after.astype(np.int32).ravel()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + 2 * data bytes) of n mono blocks (n, bytes): a step for each sample, over all blocks."""
    change, after = ima_table()
    n, size = blocks.shape
    now = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((1 + 2 * (size - 4), n), dtype=np.int16)
    out[0] = now
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(size - 4):
        for k, nibble in ((1, data[i] & 15), (2, data[i] >> 4)):
            at = index * 16 + nibble
            now = np.clip(now + change[at], -32768, 32767)
            index = after[at]
            out[2 * i + k] = now
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: old samples stay, each new one is (9 (b + c) - (a + d)) / 16 of the four around it, rounded."""
    x = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - (x[:-3] + x[3:]) + 8) >> 4, -32768, 32767)
    return out


def wav(data: bytes, tag: int, rate: int = RATE) -> bytes:
    """A mono WAV file of ``data`` as it is."""
    bits = {PCM: 16, MULAW: 8, ALAW: 8, IMA: 4}[tag]
    align = {PCM: 2, MULAW: 1, ALAW: 1, IMA: UNIT}[tag]
    per_second = rate * UNIT // (1 + 2 * (UNIT - 4)) if tag == IMA else rate * align
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + (b"" if tag == PCM else struct.pack("<H", 2) + struct.pack("<H", 1 + 2 * (UNIT - 4)) if tag == IMA else struct.pack("<H", 0))
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(file: bytes) -> tuple[int, int, memoryview]:
    """(format tag, rate, data) of a WAV file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, None, None
    while at + 8 <= len(file):
        kind, n = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", file, at + 8)
        if kind == b"data":
            return tag, rate, memoryview(file)[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("WAV file without data")


def to_pcm(file: bytes) -> np.ndarray:
    """The 16-bit samples of a WAV file of any of the four formats."""
    tag, _, data = unwav(file)
    raw = np.frombuffer(data, dtype=np.uint8)
    if tag == MULAW:
        return mulaw_table()[raw]
    if tag == ALAW:
        return alaw_table()[raw]
    if tag == IMA:
        whole = raw[: len(raw) // UNIT * UNIT].reshape(-1, UNIT)
        last = raw[len(raw) // UNIT * UNIT :]
        parts = [decode_ima(whole).ravel()]
        if len(last) > 4:
            parts.append(decode_ima(last[None, :]).ravel())
        return np.concatenate(parts)
    if tag == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"format {tag} is unknown")


def decode_column(df: DataFrame, key: str = "id", column: str = "media") -> DataFrame:
    """(key, rate, pcm): each WAV file of ``column`` decoded, resampled to 16 kHz and stored as PCM WAV."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pcm = [None if m is None else wav(resample(to_pcm(m)).tobytes(), PCM, 2 * unwav(m)[1]) for m in b[column]]
            yield pd.DataFrame({key: b[key], "rate": 2 * RATE, "pcm": pcm})

    kind = dict(df.dtypes)[key]
    return df.select(key, column).mapInPandas(run, f"{key} {kind}, rate int, pcm binary")


def padded(text: F.Column) -> F.Column:
    """UTF-8 bytes, with bytes 32 up to a positive multiple of UNIT."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    want = F.greatest(F.ceil(F.octet_length(raw) / UNIT) * UNIT, F.lit(UNIT))
    fill = F.repeat(F.lit(" "), (want - F.octet_length(raw)).cast("int"))
    return F.concat(raw, F.encode(fill, "UTF-8"))


#: Bytes of payload that features are computed over at once.
CHUNK = 1 << 21


def features(payloads: list[np.ndarray]) -> list[str]:
    """Of each payload, taken as mu-law, A-law and ADPCM: sum of squares and CRC-32 of the 16 kHz PCM."""
    mu, al = mulaw_table(), alaw_table()
    out = []
    group: list[np.ndarray] = []

    def flush() -> None:
        if not group:
            return
        raw = np.concatenate(group)
        ends = np.cumsum([len(p) for p in group])
        samples = decode_ima(raw.reshape(-1, UNIT)).astype(np.int64)
        adpcm = np.add.reduceat((samples * samples).sum(1), np.concatenate([[0], ends[:-1] // UNIT]))
        squares = np.add.reduceat(al[raw].astype(np.int64) ** 2, np.concatenate([[0], ends[:-1]]))
        pcm = mu[raw]
        for p, (start, end) in enumerate(zip(ends - [len(p) for p in group], ends)):
            up = resample(pcm[start:end])
            out.append(f"mulaw={zlib.crc32(up.tobytes()):08x};alaw={squares[p]};adpcm={adpcm[p]}")
        group.clear()

    size = 0
    for p in payloads:
        group.append(p)
        size += len(p)
        if size >= CHUNK:
            flush()
            size = 0
    flush()
    return out


def analyse(stored: DataFrame) -> DataFrame:
    """What the stored files (doc_id, n_bytes, media) hold, from their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [np.frombuffer(unwav(m)[2], dtype=np.uint8) for m in b["media"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "n_bytes": b["n_bytes"],
                "payload_bytes": [len(r) for r in raw],
                "payload_sha256": [hashlib.sha256(r).hexdigest() for r in raw],
                "tail_crc32": [zlib.crc32(r[-16:]) for r in raw],
                "media_bytes": [len(m) for m in b["media"]],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in b["media"]],
                "feature": features(raw),
            })

    return stored.mapInPandas(run, f"doc_id {dict(stored.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def encode_column(df: DataFrame, tag: int = MULAW) -> DataFrame:
    """(doc_id, n_bytes, media) of (doc_id, n_bytes, payload): each payload as the data of a WAV file, as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "media": [wav(p, tag) for p in b["payload"]]})

    return df.mapInPandas(run, f"doc_id {dict(df.dtypes)['doc_id']}, n_bytes long, media binary")


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), padded(F.col("text")).alias("payload"))
    return analyse(materialize(encode_column(d), "telephony"))
