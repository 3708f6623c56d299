import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planeflow import constants as K
from planeflow.functions import bits, color, cost
from planeflow.operators import decode, delta, encode
from planeflow.sources import bitstream


def buffers(rng, planes, kind):
    hidden = rng.integers(0, 256, (planes, K.HEIGHT, K.ROW_BYTES)).astype(np.uint8)
    target = hidden.copy()
    if kind == 1:
        target[:] = rng.integers(0, 2, (planes, K.HEIGHT, 1)) * 255
    elif kind == 2:
        target[:, :, :15] = 255
        target[:, :, 15:] = rng.integers(0, 256, (planes, K.HEIGHT, 5))
    elif kind == 3:
        target[:, :, 18:] = rng.integers(0, 256, (planes, K.HEIGHT, 2))
    elif kind == 4:
        target = rng.integers(0, 256, hidden.shape).astype(np.uint8)
    return hidden, target


@pytest.mark.parametrize("planes", [1, 2, 3, 4, 5])
def test_delta_round_trip(planes):
    rng = np.random.default_rng(planes)
    for trial in range(25):
        hidden, target = buffers(rng, planes, trial % 5)
        plain = delta.encode(hidden, target)
        packed = delta.encode(hidden, target, rle=True)
        assert len(packed[1]) <= len(plain[1]) and packed[2].cycles(planes) <= plain[2].cycles(planes)
        for op, data, stats in (plain, packed):
            writes, used, found = delta.parse(op, data, planes)
            assert used == len(data) and found == stats
            out = hidden.copy()
            for w in writes:
                w.apply(out[:, w.y])
            assert (out == target).all()


def test_rle_tokens():
    assert delta.rle_tokens(b"\1" * 20) == (bytes((145, 1)), 0, 20, 1)
    data, literals, repeats, tokens = delta.rle_tokens(b"ab" + b"\0" * 3 + b"cd" + b"e" * 13)
    assert (literals, repeats, tokens) == (4, 16, 4) and data[0] == 1


@pytest.mark.parametrize(
    "data",
    [
        b"\0" * 15, b"\x80" + b"\0" * 15 + b"\0\0", b"\x80" + b"\0" * 15 + b"\0\0\1", b"\x80" + b"\0" * 15 + b"\x80\0\0", b"\0" * 16, b"\0" * 16 + b"\x81", b"\0" * 16 + b"\1\x80",
        b"\0" * 16 + b"\1\0" + bytes((0x80 | 18, 7)), b"\0" * 16 + b"\1\0\x14" + b"x" * 21, b"\0" * 16 + b"\2\5\x91a\5\x91a", b"\0" * 16 + b"\2\5\x91a\4\x91a", b"\0" * 16 + b"\1\0\x91",
    ],
)
def test_malformed_deltas_are_rejected(data):
    with pytest.raises(delta.Malformed):
        delta.parse(K.DELTA_RLE, data, 1)


def stream(rng, planes, n=20, bands=False):
    """A stream with deltas, RLE, copies, repeats and palettes, made packet by packet."""
    y0, y1, rows, change = 8, 120, (16 if bands else 0), (3 if bands else 0)
    now = [np.zeros((planes, K.HEIGHT, K.ROW_BYTES), np.uint8) for _ in range(2)]
    out, crcs, palette = [], [], [[0] * (1 << planes)] * bitstream.n_bands(y0, y1, rows)
    for i in range(n):
        if i % 5 == 3:
            out.append(bitstream.put_packet(K.REPEAT))
        else:
            copy = i % 3 == 2
            if copy:
                now[1][:, y0:y1] = now[0][:, y0:y1]
            target = now[1].copy()
            target[:, y0 + i : y0 + i + 30, : 3 + i % 17] = rng.integers(0, 3, (planes, 30, 1))
            op, data, _ = delta.encode(now[1], target, rle=i % 2 == 0)
            raw = b""
            if i % 7 == 0:
                first = rng.integers(0, 4096, 1 << planes).tolist()
                palette = [first]
                for _ in range(bitstream.n_bands(y0, y1, rows) - 1):
                    nxt = list(palette[-1])
                    nxt[1 + i % (len(nxt) - 1)] = int(rng.integers(0, 4096))
                    palette.append(nxt)
                raw = bitstream.put_palettes(palette, change)
            out.append(bitstream.put_packet(op, data, raw, copy=copy))
            now[1] = target
            now.reverse()
        crcs.append(zlib.crc32(bits.depack(np.swapaxes(now[0], 0, 1)).tobytes() + np.array(palette, ">u2").tobytes()))
    body = b"".join(out)
    return bitstream.put_header(planes, y0, y1, n, len(body), 7, band_rows=rows, band_colors=change) + body, crcs


def test_row_folds_equal_whole_frames(spark):
    rng, files, want = np.random.default_rng(3), [], []
    for planes in (2, 3, 5):
        content, crcs = stream(rng, planes, bands=planes == 3)
        assert decode.decode_frame_model(content) == crcs
        files.append((f"s{planes}", content))
        side = crcs[:-1] if planes == 2 else crcs
        if planes == 5:
            side = [*crcs[:4], crcs[4] ^ 1, *crcs[5:]]
        want.append((f"s{planes}", np.array(side, ">u4").tobytes()))
    frame = spark.createDataFrame(files, "stream_id string, content binary")
    sides = bitstream.read_sidecar(spark.createDataFrame(want, "stream_id string, content binary"))
    got = decode.verify(frame, sides, bitstream.packets(frame)).collect()
    odd = sorted((r["stream_id"], r["n"], r["status"]) for r in got if r["status"] != "OK")
    assert len(got) == 60 and odd == [("s2", 19, "UNVERIFIED"), ("s5", 4, "FAILED")]


def test_headers_are_validated(spark):
    good, _ = stream(np.random.default_rng(1), 3, 5)
    bad = {"no magic": b"XXXX" + good[4:], "unknown version": good[:4] + b"\0\5" + good[6:], "wrong size": good[:8] + b"\0\1" + good[10:], "payload is cut off": good[:-1], "audio flag and format disagree": good[:6] + b"\0\1" + good[8:], "file is shorter than a header": good[:20], "planes out of range": good[:12] + b"\6" + good[13:]}
    rows = spark.createDataFrame([*bad.items(), ("good", good)], "stream_id string, content binary")
    found = {r["stream_id"]: r["errors"] for r in bitstream.parse_headers(rows).select("stream_id", "errors").collect()}
    assert found.pop("good") == []
    assert all(why in errors for why, errors in found.items())


def test_packets_are_validated():
    def walk(*packets, version=6):
        body = b"".join(packets)
        return list(bitstream.walk(bitstream.put_header(2, 0, 128, len(packets), len(body), version) + body))

    ok = bitstream.put_packet(K.REPEAT)
    assert walk(ok)[0][-1] == []
    assert walk(bitstream.put_packet(9))[0][-1] == ["unknown operation"]
    assert walk(bitstream.put_packet(K.DELTA_RLE, b"\0" * 17))[0][-1] == ["unknown operation"]
    assert walk(bitstream.put_packet(K.REPEAT, palette=b"\0" * 8))[0][-1] == ["a repeat has a palette or a copy"]
    assert walk(struct.pack(">HBBH", 6, 1, 0, 9))[0][-1] == ["palette and audio are longer than the packet"]
    assert walk(struct.pack(">HBBH", 7, 1, 0, 0) + b"\0")[0][-1] == ["packet length cannot be used"]
    assert walk(ok, b"\0")[1][-1] == ["packet is cut off"]


def test_palettes_round_trip():
    bands = [[0, 1, 2, 3], [0, 1, 9, 3], [0, 7, 9, 8]]
    assert bitstream.read_palettes(bitstream.put_palettes(bands, 2), 4, 3, 2) == bands
    with pytest.raises(ValueError):
        bitstream.put_palettes(bands, 1)


def test_encoder_streams_decode(spark):
    rng = np.random.default_rng(9)
    index = np.zeros((14, K.HEIGHT, K.WIDTH), np.uint8)
    for f in range(14):
        index[f, 20:60, f * 8 : f * 8 + 40] = f % 7 + 1
        index[f, 70:90] = rng.integers(0, 8, (20, K.WIDTH)) if f in (0, 7) else index[f - 1, 70:90]
    index[5] = index[4]
    palettes = {0: [[c * 0x111 for c in range(8)]], 7: [[0, *range(0x700, 0x707)]]}
    for settings in (encode.Settings(), encode.Settings(rle=True, predict="hidden"), encode.Settings(predict="visible"), encode.Settings(min_hold=3), encode.Settings(threshold=0.05), encode.Settings(audio_format=K.PCM8, period=443)):
        out = encode.encode_stream(index, palettes, settings, [b"ab"] * 14 if settings.audio_format else None)
        assert decode.decode_frame_model(out.content) == out.crcs
        assert out.totals["repeats"] + out.totals["deltas"] == 14
        if settings == encode.Settings():
            assert out.totals["error"] == 0 and out.totals["repeats"] == 1
    whole = encode.encode_stream(index, palettes, encode.Settings())
    build = lambda t: encode.encode_stream(index, palettes, encode.Settings(threshold=t))
    _, small = encode.fit_to_budget(build, whole.totals["bytes"] * 7 // 10)
    assert small.totals["bytes"] <= whole.totals["bytes"] * 7 // 10 and small.totals["error"] > 0
    assert encode.fit_to_budget(build, whole.totals["bytes"])[0] == 0.0


def test_lateness():
    vbl = K.CYCLES_PER_VBL
    assert cost.late_vbls(0, vbl, 2 * vbl) == 0
    assert cost.late_vbls(0, 2.5 * vbl, 2 * vbl) == 1
    rng = np.random.default_rng(2)
    for _ in range(200):
        start, work, every, fill = rng.uniform(0, 10 * vbl), rng.uniform(1, 3 * vbl), 450_000.0, 32_300.0
        at = start
        if at % every < fill:
            at += fill - at % every
        left, now = work, at
        while left > 0:
            until = (np.floor(now / every) + (now % every > 0)) * every
            if until - now >= left:
                now, left = now + left, 0
            else:
                left -= until - now
                now = until + fill
        assert cost.late_vbls(start, work, 0, every, fill) == int(np.ceil(now / vbl))


def test_colours(spark):
    rows = spark.createDataFrame([(int(r), int(g), int(b)) for r, g, b in np.random.default_rng(0).integers(0, 256, (300, 3))], "r int, g int, b int")
    c = rows.withColumn("lab", color.oklab(F.col("r"), F.col("g"), F.col("b"))).withColumn("back", color.srgb(F.col("lab"))).withColumn("code", color.rgb444(F.col("r"), F.col("g"), F.col("b")))
    for x in c.collect():
        assert (x["back"]["r"], x["back"]["g"], x["back"]["b"]) == (x["r"], x["g"], x["b"])
        assert x["code"] == ((x["r"] * 15 + 127) // 255) << 8 | ((x["g"] * 15 + 127) // 255) << 4 | (x["b"] * 15 + 127) // 255
    white = spark.range(1).select(color.oklab(F.lit(255), F.lit(255), F.lit(255)).alias("x")).first()["x"]
    assert abs(white["L"] - 1) < 1e-6 and abs(white["a"]) < 1e-6 and abs(white["b"]) < 1e-6


def test_planes_round_trip():
    index = np.random.default_rng(1).integers(0, 32, (4, K.WIDTH)).astype(np.uint8)
    assert (bits.depack(bits.planarize(index, 5)) == index).all()
    assert bits.doubled(b"\xa5") == bytes((0b11001100, 0b00110011))


def test_crc_of_text(spark):
    got = spark.createDataFrame([("123456789",), ("",), ("é" * 1000,)], "t string").select("t", F.crc32(F.encode("t", "utf-8")).alias("c")).collect()
    assert all(r["c"] == zlib.crc32(r["t"].encode()) for r in got) and got[0]["c"] == 0xCBF43926
