import numpy as np
import pytest
from pyspark.sql import functions as F

from planeflow import constants as K
from planeflow.operators import audio, calibrate, prepare, quantize, search
from planeflow.sources import disk, raw
from planeflow.streaming import player


def test_disk_image(spark):
    rng = np.random.default_rng(0)
    boot, code, data = b"DOS\0" + rng.bytes(600), b"xxxxA5PL" + rng.bytes(2000), rng.bytes(40_000)
    image = disk.assemble(boot, code, data)
    assert len(image) == K.DISK_BYTES and disk.boot_is_valid(image)
    assert not disk.boot_is_valid(image[:100] + bytes((image[100] ^ 1,)) + image[101:])
    rows = spark.createDataFrame([("d", image)], "disk_id string, content binary")
    assert bytes(disk.stream_on_disk(rows).first()["content"]) == data
    with pytest.raises(ValueError):
        disk.assemble(boot, code, bytes(K.DISK_BYTES))
    with pytest.raises(ValueError):
        disk.assemble(boot, code, bytes(K.DISK_BYTES - 6 * 512 - 512 * 60), reserve_tail=80)


def test_end_around_sum(spark):
    rng = np.random.default_rng(1)
    for n in (0, 4, 8, 100, 1024):
        data, total = (b"\xff" * n if n == 8 else rng.bytes(n)), 0
        for i in range(0, n, 4):
            total += int.from_bytes(data[i : i + 4], "big")
            total = (total & 0xFFFFFFFF) + (total >> 32)
        assert disk.end_around_sum(data) == total
        got = disk.word_sums(spark.createDataFrame([(1, data)], "k int, b binary")).select(disk.end_around(F.col("total")).alias("x")).first()["x"]
        assert got == total


def test_information_sectors(spark):
    image = bytearray(K.DISK_BYTES)
    at = K.INFO_SECTOR * K.SECTOR
    image[at : at + 4] = b"PLAY"
    for i in range(33):
        image[at + 4 + 4 * i : at + 8 + 4 * i] = (1000 + i).to_bytes(4, "big")
    image[at + 136 : at + 148] = b"AUDC" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    image[K.TIMING_SECTOR * K.SECTOR + 8 : K.TIMING_SECTOR * K.SECTOR + 12] = (12345).to_bytes(4, "big")
    rows = spark.createDataFrame([("d", bytes(image))], "disk_id string, content binary")
    play = disk.info(rows, "PLAY").first()
    assert (play["packets"], play["late"], play["max_late"], play["fill_sum"], play["fb_crc1"], play["audio_crc"], play["audio_samples"]) == (1000, 1007, 1008, 1026, 1032, 7, 9)
    assert disk.info(rows, "MEMR").count() == 0
    times = {r["n"]: r["cck"] for r in disk.timings(rows).collect()}
    assert len(times) == 512 and times[2] == 12345 and times[3] == 0


def test_wav_and_ppm():
    assert disk.wav(np.array([1, -1]), 8000)[-4:] == b"\x00\x01\x00\xff"
    assert disk.ppm(np.zeros((2, 3, 3))) == b"P6\n3 2\n255\n" + bytes(18)


def test_fib4_round_trip(spark):
    rng = np.random.default_rng(2)
    v = np.clip(np.cumsum(rng.integers(-20, 21, 500)), -128, 127)
    n = audio.fib4_nibbles(v)
    rows = spark.createDataFrame([("a", i, int(x)) for i, x in enumerate(n)], "stream_id string, s int, nibble int")
    got = [r["v"] for r in audio.fib4_decode(rows).orderBy("s").collect()]
    acc, want = 0, []
    for x in n:
        acc += K.FIB_STEPS[x]
        assert -128 <= acc <= 127
        want.append(acc)
    assert got == want and np.abs(np.array(got) - v).mean() < 4


def test_fib4_wraps(spark):
    rows = spark.createDataFrame([("a", i, 15) for i in range(20)], "stream_id string, s int, nibble int")
    got = [r["v"] for r in audio.fib4_decode(rows).orderBy("s").collect()]
    assert got == [((21 * (i + 1) + 128) % 256) - 128 for i in range(20)]


def test_adpcm_follows_a_tone():
    v = (12000 * np.sin(np.arange(800) / 9)).astype(int)
    out = np.array(audio.adpcm_samples(audio.adpcm_nibbles(v)))
    assert np.abs(out[50:] - v[50:] / 256).mean() < 2
    assert audio.adpcm_samples([7] * 60)[-1] == 127 and audio.adpcm_samples([15] * 60)[-1] == -128


def test_channel_choice():
    t = np.arange(4000) / 8000
    tone = np.sin(2 * np.pi * 1000 * t)
    assert audio.pick_channel(tone, tone, 8000) == "mid"
    assert audio.pick_channel(tone, 0.5 * tone, 8000) == "mid" and audio.pick_channel(tone, 0.1 * tone, 8000) == "left"
    assert audio.pick_channel(tone, -0.5 * tone, 8000) == "left"
    assert audio.pick_channel(0.5 * tone, -tone, 8000) == "right"


def test_repeated_frames_are_found_and_dropped(spark):
    rng = np.random.default_rng(3)
    d = rng.uniform(4, 6, 100)
    planted = list(range(7, 100, 5))
    d[planted] = 0.01
    gone, interval, regular = prepare.repeated_frames(d)
    assert gone == planted and interval == 5 and regular == 1
    assert prepare.repeated_frames(rng.uniform(4, 6, 100))[0] == [] == prepare.repeated_frames(d[:40])[0]
    d[planted[3]] = 5.0  # a cut hides one; the pattern runs on
    assert prepare.repeated_frames(d)[0] == [p for p in planted if p != planted[3]]
    rows = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(d)], "clip_id string, frame int, delta double")
    kept = prepare.drop_repeated(rows, rows).orderBy("frame").collect()
    assert [r["frame"] for r in kept] == list(range(100 - len(planted) + 1))


def test_frame_differences(spark):
    frames = np.random.default_rng(4).integers(0, 256, (3, 4, 30)).astype(np.uint8)
    rows = spark.createDataFrame([("c", f, y, frames[f, y].tobytes()) for f in range(3) for y in range(4)], "clip_id string, frame int, y int, rgb binary")
    got = {r["frame"]: r["delta"] for r in prepare.frame_differences(rows).collect()}
    assert got[0] is None
    for f in (1, 2):
        assert abs(got[f] - np.abs(frames[f].astype(int) - frames[f - 1]).mean()) < 1e-9


def test_palettes():
    rng = np.random.default_rng(5)
    rgb, n = rng.integers(0, 256, (200, 3)), rng.integers(1, 50, 200)
    a = quantize.kmeans(rgb, n, 16)
    order = rng.permutation(200)
    assert (a == quantize.kmeans(rgb[order], n[order], 16)).all() and a[0] == 0 and len(set(a.tolist())) == 16
    errors = [quantize.palette_error(rgb, n, quantize.kmeans(rgb, n, k)) for k in (2, 4, 8, 16, 32)]
    assert errors == sorted(errors, reverse=True)
    other = quantize.kmeans(rgb[:30], n[:30], 16)
    pooled = quantize.from_rgb444(quantize.to_rgb444(rgb))
    before = quantize.palette_error(pooled, n, other)
    swapped = quantize.swap_colors(rgb, n, other, a, 4)
    assert quantize.palette_error(pooled, n, swapped) < before
    assert set(swapped.tolist()) <= set(other.tolist()) | set(a.tolist())
    assert (swapped != other).sum() <= 4 and swapped[0] == other[0]
    assert len(quantize.kmeans(rgb[:1], n[:1], 16)) == 2


def test_a_swap_is_the_best_of_all():
    rng = np.random.default_rng(9)
    rgb, n = np.unique(rng.integers(0, 16, (300, 3)), axis=0) * 16, None
    n = rng.integers(1, 50, len(rgb))
    palette, offer = rng.permutation(4096)[:6], rng.permutation(4096)[:9]
    lab = quantize.oklab(rgb)  # one colour a pool

    def error(p):
        return float((np.sqrt(((lab[:, None] - quantize.oklab(quantize.from_rgb444(p))) ** 2).sum(-1)).min(1) * n).sum())

    best = min((error(np.append(np.delete(palette, j), c)) for j in range(1, 6) for c in offer[1:]), default=0)
    got = quantize.swap_colors(rgb, n, palette, offer, 1)
    assert abs(error(got) - min(best, error(palette))) < 1e-6 and (got != palette).sum() <= 1


def test_snap_takes_near_colours_in_turn():
    above = np.array([0, 0xF00, 0x0F0, 0x00F])
    assert quantize.snap(np.array([0, 0x00E, 0xE00, 0xFFF]), above, 0.2).tolist() == [0, 0x00F, 0xF00, 0xFFF]
    assert quantize.snap(np.array([0, 0x00E, 0x00F, 0xFFF]), above, 0.1).tolist() == [0, 0x00F, 0x00F, 0xFFF]  # taken: it stays itself
    assert quantize.snap(np.array([0, 0x00E]), above, 0).tolist() == [0, 0x00E]


def test_hysteresis():
    entries = np.array([0x000, 0x888, 0x999])
    rgb = quantize.from_rgb444(np.array([[0x888], [0x999], [0xFFF]]))
    index = np.array([[1], [2], [2]], np.uint8)
    assert quantize.hysteresis(index, rgb, entries, 0.5).ravel().tolist() == [1, 1, 1]
    assert quantize.hysteresis(index, rgb, entries, 0.0).ravel().tolist() == [1, 2, 2]


def test_least_squares_recovers_planted_coefficients(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(a), int(b), int(5580 + 852 * a + 177 * b) + (0 if i else 500)) for i, (a, b) in enumerate(rng.integers(0, 100, (200, 2)))]
    frame = spark.createDataFrame(rows, "n int, rows int, cols int, cycles long")
    got = calibrate.fit(frame.filter("n > 0"), ["rows", "cols"], "cycles")
    assert np.allclose(got["weights"], [5580, 852, 177]) and got["r2"] > 1 - 1e-9 and got["rows"] == 199
    worst = calibrate.residuals(frame, ["rows", "cols"], "cycles", got["weights"], "n").first()
    assert worst["at"] == 0 and abs(worst["worst"] - 500) < 1e-6


def test_search_prefers_planes_then_size(spark):
    rows = [("a", 0, 3, 100, True, True, 0, False, 4.0), ("a", 1, 5, 80, True, True, 1, False, 5.9), ("a", 2, 5, 90, True, True, 1, False, 6.1), ("a", 3, 5, 100, True, False, 0, False, 1.0), ("a", 4, 5, 100, True, True, 0, True, 1.0), ("b", 5, 3, 90, True, True, 0, True, 1.0)]
    frame = spark.createDataFrame(rows, "clip_id string, cfg_id int, planes int, size int, ok boolean, fits boolean, worst_late int, raised boolean, bad double")
    assert {r["clip_id"]: r["cfg_id"] for r in search.winner(frame, "clip_id").collect()} == {"a": 1, "b": 5}
    assert search.grid(spark).count() == 75
    assert search.longest(lambda points: {p: p <= 37 for p in points}, 1, 100) == 37


def test_raw_sources(spark, tmp_path):
    frames = np.random.default_rng(7).integers(0, 256, (3, K.HEIGHT, K.WIDTH, 3)).astype(np.uint8)
    (tmp_path / "clip.rgb").write_bytes(frames.tobytes() + b"cut")
    (tmp_path / "clip.pcm").write_bytes(np.array([[1, 2], [-3, 4], [5, 6]], "<i2").tobytes())
    raw.register(spark)
    got = spark.read.format("rawvideo").options(path=str(tmp_path / "*.rgb"), start=1, count=5).load().collect()
    assert len(got) == 2 * K.HEIGHT and all(bytes(r["rgb"]) == frames[r["frame"], r["y"]].tobytes() for r in got)
    pcm = spark.read.format("rawpcm").options(path=str(tmp_path / "*.pcm"), channels=2).load().collect()
    assert [(r["s"], r["v"]) for r in pcm] == [(0, [1, 2]), (1, [-3, 4]), (2, [5, 6])]


def test_probe():
    said = "width=640\nwidth=0\nheight=480\nr_frame_rate=30000/1001\nr_frame_rate=1/1\nsample_rate=0\nsample_rate=44100\nduration=12.5\nfield_order=tt\n"
    got = raw.probe(said)
    assert (got["width"], got["height"], got["rate"], got["duration"], got["progressive"]) == (640, 480, 44100, 12.5, False)
    assert abs(got["fps"] - 29.97) < 0.01 and raw.ratio("1/0") == 0.0


def test_streamed_lateness(spark, tmp_path):
    vbl = K.CYCLES_PER_VBL
    cycles = [9e9, 2.5 * vbl, vbl, 0, 4.2 * vbl]
    rows = [("s", n, float(c)) for n, c in enumerate(cycles)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "stream_id string, n int, cycles double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    packets = spark.readStream.schema("stream_id string, n int, cycles double").parquet(str(tmp_path / "in"))
    run = player.lateness(packets).writeStream.outputMode("update").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    run.stop()
    got = spark.table("late").orderBy(F.desc("shown")).first()
    assert (got["shown"], got["late"], got["worst"]) == (5, 2, 1)
