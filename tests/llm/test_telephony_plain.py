"""Telephony features and stored PCM against one sample at a time."""

import hashlib
import random
import struct
import zlib

from quillgraph.llm import telephony as T


def mulaw(code):
    code = 255 - code
    size = ((code % 16) * 8 + 132) * 2 ** ((code // 16) % 8) - 132
    return -size if code >= 128 else size


def alaw(code):
    code ^= 85
    e, m = (code // 16) % 8, code % 16
    size = m * 16 + 8 if e == 0 else (m * 16 + 264) * 2 ** (e - 1)
    return size if code >= 128 else -size


def adpcm(payload):
    out = []
    for at in range(0, len(payload), T.UNIT):
        block = payload[at : at + T.UNIT]
        now, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
        out.append(now)
        for byte in block[4:]:
            for nibble in (byte % 16, byte // 16):
                step = int(T.STEPS[index])
                change = step // 8 + (step if nibble & 4 else 0) + (step // 2 if nibble & 2 else 0) + (step // 4 if nibble & 1 else 0)
                now = max(-32768, min(32767, now - change if nibble & 8 else now + change))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nibble % 8]))
                out.append(now)
    return out


def doubled(x):
    out = []
    for i, b in enumerate(x):
        a, c, d = x[max(0, i - 1)], x[min(len(x) - 1, i + 1)], x[min(len(x) - 1, i + 2)]
        out += [b, max(-32768, min(32767, (9 * (b + c) - (a + d) + 8) // 16))]
    return out


def samples(x):
    return struct.pack(f"<{len(x)}h", *x)


def some_payloads():
    r = random.Random(2)
    texts = ["", "a", "word " * 200, "é中😀" * 70, "".join(chr(r.randrange(32, 0x300)) for _ in range(900))]
    return [(b := t.encode()) + b" " * (-len(b) % T.UNIT or (0 if b else T.UNIT)) for t in texts] + [bytes(r.randrange(256) for _ in range(3 * T.UNIT))]


def test_features_are_those_of_single_samples(monkeypatch):
    import numpy as np

    payloads = some_payloads()
    want = [f"mulaw={zlib.crc32(samples(doubled([mulaw(c) for c in p]))):08x};alaw={sum(alaw(c) ** 2 for c in p)};adpcm={sum(v * v for v in adpcm(p))}" for p in payloads]
    for chunk in (1, 1000, T.CHUNK):  # payloads alone and together
        monkeypatch.setattr(T, "CHUNK", chunk)
        assert T.features([np.frombuffer(p, dtype=np.uint8) for p in payloads]) == want


def test_stored_pcm_of_all_codings(spark):
    decode = {T.MULAW: lambda p: [mulaw(c) for c in p], T.ALAW: lambda p: [alaw(c) for c in p], T.IMA: adpcm, T.PCM: lambda p: list(struct.unpack(f"<{len(p) // 2}h", p))}
    rows = [(i, tag, T.wav(p, tag)) for tag in decode for i, p in enumerate(some_payloads())]
    df = spark.createDataFrame([(f"{tag}-{i}", bytearray(m), 7) for i, tag, m in rows] + [("none", None, 7)], "id string, media binary, rate int")
    got = {r["id"]: r for r in T.decode_column(df).collect()}
    assert got["none"]["pcm"] is None
    for i, tag, m in rows:
        kind, rate, data = T.unwav(bytes(got[f"{tag}-{i}"]["pcm"]))
        assert (kind, rate) == (T.PCM, 16000) and bytes(data) == samples(doubled(decode[tag](some_payloads()[i])))


def test_a_query_over_long_texts_and_other_columns(spark, tmp_path):
    texts = [None, "", "x" * 3_000_000, "same", "same"]
    spark.createDataFrame([(i, t, "m", 5) for i, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in T.op2_telephony(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(T.wav(payload, T.MULAW)), hashlib.sha256(T.wav(payload, T.MULAW)).hexdigest())
    assert got[3]["feature"] == got[4]["feature"]
