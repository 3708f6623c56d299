import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planeflow import constants as K
from planeflow.functions import bits, cost
from planeflow.operators import audio, convert, decode, encode, quantize, report, search
from planeflow.operators.encode import Settings, encode_stream
from planeflow.sources import bitstream, raw


def test_still_frame():
    rng = np.random.default_rng(0)
    index = np.zeros((K.HEIGHT, K.WIDTH), np.uint8)
    index[20:90] = rng.integers(0, 8, (70, K.WIDTH))
    palettes = [[c * 0x111 for c in range(8)], [0, 0xF00, *(c * 0x111 for c in range(2, 8))]]
    out = report.still(index, palettes, 3, 16, 112, 48, 2)
    crc = zlib.crc32(index.tobytes() + np.array(palettes, ">u2").tobytes())
    assert decode.decode_frame_model(out["stream"]) == [crc]
    words = np.frombuffer(out["framebuffer"], ">u2").reshape(3, K.HEIGHT, K.ROW_BYTES)
    plain = np.swapaxes(bits.planarize(index, 3), 0, 1)
    assert len(out["framebuffer"]) == 3 * 5120 and all(int(words[p, y, c]) == int("".join(b * 2 for b in f"{plain[p, y, c]:08b}"), 2) for p, y, c in ((0, 20, 3), (2, 88, 19), (1, 50, 0)))
    assert report.framebuffer_crc(index, 3) == zlib.crc32(out["framebuffer"])
    assert out["picture"].startswith(b"P6\n160 128\n") and len(out["picture"]) == 15 + K.WIDTH * K.HEIGHT * 3


def test_display_list():
    palettes = [[0, 0x111, 0x222, 0x333], [0, 0x111, 0xABC, 0x333]]
    data = report.display_list(0x12345678, 2, 16, 112, palettes, 48, 2)
    moves = list(struct.iter_unpack(">HH", data))
    assert moves[:2] == [(0x8E, 0x2C81), (0x90, 0x2CC1)] and moves[-1] == (0xFFFF, 0xFFFE)
    assert (0xE0, 0x1234) in moves and (0xE2, 0x5678) in moves and (0x100, 0x2200) in moves
    at = moves.index((0x184, 0xABC))
    assert moves[at - 1] == ((0x2C + 2 * 64) << 8 & 0xFFFF | 7, 0xFFFE) and moves[at + 1] == (0x1FE, 0)
    assert len(moves) == 8 + 4 + 4 + 1 + 256 * 3 + 1 + 2 + 1


def test_mismatches(spark):
    rows = spark.createDataFrame([(b"abc", b"abc"), (b"abc", b"axc"), (b"ab", b"abcd"), (None, b"")], "a binary, b binary")
    got = [tuple(r["x"]) for r in rows.select(report.mismatches("a", "b").alias("x")).collect()]
    assert got == [(0, None), (1, 1), (2, 2), (0, None)]


def test_settings_are_validated():
    for bad in ({"planes": 6}, {"y0": 9, "y1": 9}, {"predict": "x"}, {"audio_format": K.PCM8}, {"band_rows": 8}, {"min_hold": 0}):
        with pytest.raises(ValueError):
            encode.Settings(**bad)


@pytest.mark.parametrize("form", [K.FIB4, K.PCM8, K.ADPCM])
def test_audio_travels_in_packets(spark, form):
    hz = K.PAULA_HZ / 443
    v = (9000 * np.sin(np.arange(3000) / 20)).astype(int)
    cut = audio.slices(len(v), 6, hz)
    assert cut[0][0] == 0 and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False)) and all((b - a) % 2 == 0 for a, b in cut)
    data = audio.encode_samples(v[: cut[-1][1]], form)
    per = 1 if form == K.PCM8 else 2
    parts = [data[a // per : b // per] for a, b in cut]
    index = np.zeros((6, K.HEIGHT, K.WIDTH), np.uint8)
    made = encode.encode_stream(index, {0: [[0] * 8]}, encode.Settings(audio_format=form, period=443), parts)
    files = spark.createDataFrame([("a", made.content)], "stream_id string, content binary")
    got = audio.stream_audio(bitstream.packets(files), bitstream.parse_headers(files)).first()
    want = audio.decode_bytes(data, form)
    assert got["crc"] == zlib.crc32(want.tobytes()) and got["n"] == cut[-1][1]
    assert np.abs(want[100:].astype(int) - v[100 : cut[-1][1]] / 256).mean() < 3


def test_better_audio():
    size = lambda form, rate: rate * (1 if form == K.PCM8 else 0.5)
    assert audio.better_audio(size, 9000, True, [8000, 9000, 10_000]) == (K.PCM8, 9000)
    assert audio.better_audio(size, 5000, True, [8000, 9000]) == (K.FIB4, 8000)
    assert audio.better_audio(size, 9000, False, [8000]) == (K.FIB4, 8000)


def test_files_are_written_and_read(spark, tmp_path):
    raw.register(spark)
    rows = spark.createDataFrame([(f"f{i}", bytes((i,)) * i) for i in range(5)], "name string, content binary")
    rows.write.format("binaryrows").mode("append").save(str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"f{i}": bytes((i,)) * i for i in range(5)}
    frame = np.random.default_rng(1).integers(0, 256, (2, K.HEIGHT, K.WIDTH, 3)).astype(np.uint8)
    files = spark.createDataFrame([("c", frame.tobytes())], "clip_id string, content binary")
    got = raw.frames(files).collect()
    assert len(got) == 2 * K.HEIGHT and all(bytes(r["rgb"]) == frame[r["frame"], r["y"]].tobytes() for r in got)


def test_play_report(spark):
    row = dict.fromkeys("packets late max_late vbl vbl_expected first_vbl first_line_cck last_vbl last_line_cck fill_sum fill_max copies copy_sum copy_max audio_irqs audio_format period bytes load_vsync".split(), 0)
    row |= {"disk_id": "d", "bytes": 774_048, "load_vsync": 2105, "audio_irqs": 3, "audio_format": 1, "period": 443, "last_vbl": 6, "last_line_cck": (100 << 16) + 20, "fill_sum": 48_000, "fill_max": 16_400}
    got = report.play_report(spark.createDataFrame([row])).first()
    span = (6 * 313 + 100) * 227 + 20
    assert abs(got["load_kb_s"] - 17.95) < 0.01 and abs(got["interval_cck"] - span / 2) < 1e-6
    assert abs(got["drift_ms"] - (span - 2 * 512 * 443) * 1000 / K.PAULA_HZ) < 1e-6
    assert abs(got["fill_ms"] - 4.511) < 0.001 and got["copy_ms"] is None and not got["broken_stamp"]
    timing = spark.createDataFrame([("d", 0, 0), ("d", 1, 50), ("d", 2, 50)], "disk_id string, n int, cck long")
    assert tuple(report.timing_summary(timing).select("deltas", "worst_n").first()) == (2, 1)
    assert spark.range(1).select(report.budget(F.lit(7752)).alias("b")).first()["b"] == (1760 - 2 - 16) * 512


def _lossy(spark):
    """(frames, stream, headers, packets) of a noisy clip with a held frame and two colours that the palette lacks."""
    rng = np.random.default_rng(3)
    frames = np.zeros((6, K.HEIGHT, K.WIDTH, 3), np.uint8)
    for n in range(6):
        frames[n, 10 + n : 40 + n, 20:90] = (255, 0, 0)
        frames[n, 60:70, n * 4 : n * 4 + 40] = rng.integers(0, 256, (10, 40, 3))
    frames[3] = frames[2]
    settings = Settings(planes=2, rle=True, min_hold=2)
    scene = {0: [[0x000, 0xF00, 0x0F0, 0x00F]]}
    index = np.stack([convert.mapped(f, np.array(scene[0][0])) for f in frames])
    stream = encode_stream(index, scene, settings)
    files = spark.createDataFrame([("s", bytes(stream.content))], "stream_id string, content binary")
    return frames, index, stream, files, bitstream.parse_headers(files), bitstream.packets(files)


def test_attribution_equals_brute_force(spark):
    frames, index, stream, files, headers, packets = _lossy(spark)
    source = spark.createDataFrame([("s", n, y, frames[n, y].tobytes()) for n in range(1, 6) for y in range(K.HEIGHT)], "stream_id string, n int, y int, rgb binary")
    decoded = decode.fold_rows(decode.row_writes(packets, headers)).persist()
    # shift the stream by a frame, so that held and compressed pixels occur
    late = decoded.withColumn("n", F.col("n") + 1)
    got = {r.n: r for r in decode.attributed(late, source, packets, headers).collect()}
    head = headers.first()
    y0, y1 = head.y0, head.y1
    shown = {(r.n, r.y): np.frombuffer(bytes(r["index"]), np.uint8) for r in late.collect()}
    ops = {r.n: r.op for r in packets.collect()}
    entries = quantize.oklab(quantize.from_rgb444(np.array([0x000, 0xF00, 0x0F0, 0x00F])))
    total = [0, 0, 0]
    for n in range(1, 6):
        drawn = max(k for k in range(n + 1) if ops[k] != K.REPEAT)
        want, error = [0, 0, 0], 0.0
        for y in range(y0, y1):
            for x in range(K.WIDTH):
                c, v = quantize.oklab(frames[n, y, x][None])[0], shown[n, y][x]
                d, least = np.linalg.norm(c - entries[v]), np.linalg.norm(c - entries[index[n, y, x]])
                error += d
                if d > K.BAD_PIXEL:
                    kind = 0 if least > K.BAD_PIXEL else 1 if drawn >= 1 and v == index[drawn, y, x] else 2
                    want[kind] += 1
        assert [got[n].colours, got[n].held, got[n].compression] == want and got[n].pixels == (y1 - y0) * K.WIDTH
        assert abs(got[n].error - error) < 1e-6
        total = [a + b for a, b in zip(total, want, strict=True)]
    assert total[0] and total[2]


def test_parts_add_up_to_the_payload(spark):
    _, _, stream, files, headers, packets = _lossy(spark)
    r = report.delta_parts(packets, headers).first()
    parts = ["headers", "palettes", "audio", *report.PARTS]
    assert sum(r[p] for p in parts) == len(stream.content) - K.HEADER_BYTES
    assert r.packets == 6 and r.deltas == sum(p.op != K.REPEAT for p in packets.collect())
    assert r.row_map == 16 * r.deltas and r.column_masks == 3 * (r.rows - r.rle_rows) and r.padding <= r.packets
    empty = files.limit(0)
    assert report.delta_parts(bitstream.packets(empty), bitstream.parse_headers(empty)).count() == 0


def test_fills_and_what_was_played(spark):
    samples = {"a": bytes(range(200)) * 5, "b": b"", "c": b"\x07" * 512, "d": b"\x01"}
    df = spark.createDataFrame(list(samples.items()), "stream_id string, samples binary")
    got = {(r.stream_id, r.fill): bytes(r.samples) for r in audio.fills(df).collect()}
    assert got == {("a", 0): samples["a"][:512], ("a", 1): samples["a"][512:] + samples["a"][-1:] * 24, ("c", 0): samples["c"], ("d", 0): b"\x01" * 512}
    heard = {"a": samples["a"] + samples["a"][-1:] * 24, "b": b"\0" * 512, "c": samples["c"][:500], "d": b"\x02" * 512}
    played = spark.createDataFrame([(k, len(v), zlib.crc32(v)) for k, v in heard.items()], "stream_id string, count long, want long")
    assert {r.stream_id: r.status for r in audio.check_played(df, played).collect()} == {"a": "OK", "b": "OK", "c": "SHORT", "d": "FAILED"}


def test_pictures_by_aspect(spark):
    def box(w, h, size, aspect):
        r = spark.range(1).select(cost.picture(F.lit(w), F.lit(h), F.lit(size), F.lit(aspect)).alias("b")).first().b
        return r and (r.cols, r.rows, r.x0, r.y0, round(r.scale, 6))

    assert box(1920, 1080, 100, "letterbox") == (160, 96, 0, 16, 1.0)
    assert box(1080, 1920, 100, "letterbox") == (68, 128, 46, 0, round(160 / 68, 6))  # 67.5 columns
    assert box(1920, 1080, 100, "crop") == (212, 128, -26, 0, 1.0)
    assert box(1920, 1080, 100, "stretch") == (160, 128, 0, 0, 1.0)
    assert box(1920, 1080, 80, "letterbox") == (128, 76, 16, 26, 1.25)
    assert box(1920, 1080, 90, "crop") is None


def test_finest_size(spark):
    pick = spark.createDataFrame([("a", 90, False), ("b", 100, False), ("c", 80, True), ("d", 95, False), ("e", 83, False)], "key string, size int, raised boolean")
    tried = search.finer(pick)
    assert sorted((r.key, r["size"]) for r in tried.collect()) == [("a", 92), ("a", 94), ("d", 97), ("d", 99)]
    results = tried.withColumns({"ok": F.lit(True), "fits": F.col("size") < 94, "worst_late": F.lit(1)})
    assert {r.key: r["size"] for r in search.finest(pick, results, "key").collect()} == {"a": 92, "b": 100, "c": 80, "d": 95, "e": 83}
