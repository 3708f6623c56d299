import zlib

import numpy as np
import pytest

from planeflow import constants as K
from planeflow.operators import audio, convert, decode, quantize
from planeflow.operators.encode import Settings, encode_stream
from planeflow.sources import bitstream, disk


def source(n=8, seed=1):
    """Two scenes of flat areas and noise, with a moving block."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, K.HEIGHT, K.WIDTH, 3), np.uint8)
    for f in range(n):
        late = f >= n // 2
        out[f, :, :80] = (200, 30, 40) if late else (20, 60, 150)
        out[f, :, 80:] = rng.integers(0, 256, (K.HEIGHT, 80, 3)) // (2 if late else 3)
        out[f, 30:60, 4 * f : 4 * f + 20] = (250, 240, 90)
    return out


def test_distances_and_cuts():
    frames = source()
    got = convert.distances(frames, 10, 100, 120)
    for n in range(1, len(frames)):
        a, b = (quantize.oklab(x[10:100]) for x in (frames[n], frames[n - 1]))
        assert abs(got[n] - np.sqrt(((a - b) ** 2).sum(-1)).mean() * 160 / 120) < 1e-12
    assert got[0] == np.inf
    assert convert.cut_places(np.array([9, 0.2, 0, 0.3, 0.01, 0.5, 0.5]), 0.12, 2) == [0, 3, 5]


@pytest.mark.parametrize("size", [0, 2, 4])
def test_dither_moves_lightness_then_takes_the_nearest(size):
    frame, entries = source(1)[0, 8:24], np.array([0, 0xF00, 0x248, 0x999, 0xFFF])
    got = convert.mapped(frame, entries, 8, size, 0.2)
    ranks = {2: K.BAYER_2, 4: K.BAYER_4}.get(size)
    lab, colours = quantize.oklab(frame), quantize.oklab(quantize.from_rgb444(entries))
    for y in range(0, 16, 5):
        for x in range(0, 160, 7):
            p = lab[y, x].copy()
            if size:
                p[0] += ((ranks[(y + 8) % size * size + x % size] + 0.5) / size**2 - 0.5) * 0.2
            assert got[y, x] == ((colours - p) ** 2).sum(1).argmin()


def test_a_source_becomes_a_verified_disk(spark):
    frames = source()
    samples = 20_000 * np.sin(np.arange(4000) / 9)
    s = Settings(planes=3, y0=16, y1=112, rle=True, audio_format=K.FIB4, period=443, band_rows=16, band_colors=3)
    threshold, out, image, cuts = convert.convert(frames, convert.Recipe(s, budget=120_000, dither=4, shortest_scene=2), samples)
    assert cuts == [0, 4] and out.totals["bytes"] <= 120_000 and len(image) == K.DISK_BYTES and disk.boot_is_valid(image)
    found = disk.stream_on_disk(spark.createDataFrame([("d", image)], "disk_id string, content binary")).first()["content"]
    assert bytes(found) == out.content
    assert decode.decode_frame_model(out.content) == out.crcs[:-1]
    files = spark.createDataFrame([("d", out.content)], "stream_id string, content binary")
    sides = bitstream.read_sidecar(spark.createDataFrame([("d", out.sidecar())], "stream_id string, content binary"))
    packets, headers = bitstream.packets(files), bitstream.parse_headers(files)
    sound = audio.stream_audio(packets, headers)
    assert [r["status"] for r in decode.verify(files, sides, packets).collect()] == ["OK"] * 8
    assert [(r["n"], r["status"]) for r in decode.verify_audio(sides, sound, headers).collect()] == [(8, "OK")]
    broken = sides.withColumn("crc", sides.crc + 1)
    assert decode.verify_audio(broken, sound, headers).first()["status"] == "FAILED"
    assert decode.verify_audio(sides.filter("n < 8"), sound, headers).first()["status"] == "UNVERIFIED"
    heard = bytes(sound.first()["samples"])
    assert len(heard) == audio.slices(1 << 40, 8, K.PAULA_HZ / 443)[-1][1] and zlib.crc32(heard) == out.crcs[-1]


def test_errors_are_by_band():
    """The lower band's colours are near, so its pixels stay as they were: wrong, but not bad; by the upper band's
    palette they would be bad."""
    index = np.ones((1, K.HEIGHT, K.WIDTH), np.uint8)
    index[0, :, 80:] = 2
    far, near = [0, 0xF00, 0x0F0, 0xFFF], [0, 0x111, 0x112, 0xFFF]
    s = Settings(planes=2, threshold=0.09, band_rows=64, band_colors=3)
    out = encode_stream(np.concatenate([index, 3 - index]), {0: [far, near]}, s)
    assert out.totals["bad"] == 0 < out.totals["error"]
    assert encode_stream(np.concatenate([index, 3 - index]), {0: [far, far]}, s).totals["error"] == 0


def test_repeated_frames_are_dropped():
    rng = np.random.default_rng(2)
    frames = np.zeros((60, K.HEIGHT, K.WIDTH, 3), np.uint8)
    for n in range(60):
        frames[n] = frames[n - 1] if n % 5 == 4 else rng.integers(0, 255, 3)
    _, out, _, _ = convert.convert(frames, convert.Recipe(Settings(planes=2), drop_repeated=True))
    assert len(out.crcs) == 48
