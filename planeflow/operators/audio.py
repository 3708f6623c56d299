"""Audio: Fibonacci delta and ADPCM, resampling, gain and channel choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def fib4_decode(nibbles: DataFrame, stream: str = "stream_id", order: str = "s") -> DataFrame:
    """Adds v: the 8-bit wrapping prefix sum of the nibbles' steps. Wrapping is associative: a plain window."""
    step = F.get(F.array(*map(F.lit, K.FIB_STEPS)), F.col("nibble").cast("int"))
    total = F.sum(step).over(Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return nibbles.withColumn("v", (F.pmod(total + 128, F.lit(256)) - 128).cast("int"))


def fib4_nibbles(samples: np.ndarray) -> np.ndarray:
    """The greedy nibbles of 8-bit samples: the step that comes nearest without leaving -128..127."""
    steps, acc, out = np.array(K.FIB_STEPS), 0, np.zeros(len(samples), np.uint8)
    for i, v in enumerate(samples.tolist()):
        to = acc + steps
        miss = np.where((to < -128) | (to > 127), 10**6, np.abs(to - v))
        out[i] = k = int(miss.argmin())
        acc = int(to[k])
    return out


class Adpcm:
    """The predictor and its step index."""

    def __init__(self):
        self.pred, self.index = 0, 0

    def after(self, nibble: int) -> tuple[int, int]:
        step = K.ADPCM_STEPS[self.index]
        move = (step >> 3) + sum(step >> i for i, bit in enumerate((4, 2, 1)) if nibble & bit)
        pred = self.pred - move if nibble & 8 else self.pred + move
        return max(-32768, min(32767, pred)), max(0, min(88, self.index + K.ADPCM_INDEX[nibble & 7]))

    def step(self, nibble: int) -> int:
        """The sample that sounds: the predictor's high byte, rounded down."""
        self.pred, self.index = self.after(nibble)
        return self.pred >> 8


def adpcm_samples(nibbles) -> list[int]:
    state = Adpcm()
    return [state.step(int(n)) for n in nibbles]


def adpcm_nibbles(samples: np.ndarray) -> np.ndarray:
    """Nibbles of 16-bit samples, each the best for its sample and the next one together."""
    state, out = Adpcm(), np.zeros(len(samples), np.uint8)
    values = [int(x) for x in samples]
    for i, v in enumerate(values):
        best = None
        for n in range(16):
            pred, index = state.after(n)
            cost = (pred - v) ** 2
            if best is not None and cost >= best[0]:
                continue  # the next sample can only add to it
            if i + 1 < len(values):
                trial = Adpcm()
                trial.pred, trial.index = pred, index
                cost += min((trial.after(m)[0] - values[i + 1]) ** 2 for m in range(16))
            if best is None or cost < best[0]:
                best = cost, n
        out[i] = best[1]
        state.step(int(best[1]))
    return out


def fold_stream(frame: DataFrame, stream: str, order: str, value: str, f, out: str) -> DataFrame:
    """f over each stream's ordered values, one number out for each in. Streams come one behind the other, so short
    ones cost no group of their own, and a task holds the values of one stream at a time."""
    kinds = dict(frame.dtypes)
    names = [stream, order, out]

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the stream that the last batch ended in

        def made(part: pa.Table) -> pa.RecordBatch:
            numbers = np.asarray(f(part.column(2).to_numpy()), np.int64)
            whole = part.combine_chunks()
            return pa.RecordBatch.from_arrays([*(whole.column(i).combine_chunks() for i in (0, 1)), pa.array(numbers)], names)

        for batch in batches:
            keys = batch.column(0)
            if not len(keys):
                continue
            if held and held[-1].column(0)[-1] != keys[0]:
                yield made(pa.Table.from_batches(held))
                held = []
            same = pc.equal(keys[1:], keys[:-1])
            same = pc.or_(pc.fill_null(same, False), pc.and_(keys[1:].is_null(), keys[:-1].is_null()))
            cut = [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), len(keys)]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                held.append(batch.slice(x, y - x))
                if y < len(keys):
                    yield made(pa.Table.from_batches(held))
                    held = []
        if held:
            yield made(pa.Table.from_batches(held))

    rows = frame.select(stream, order, value).repartition(stream).sortWithinPartitions(stream, order)
    return rows.mapInArrow(run, f"{stream} {kinds[stream]}, {order} {kinds[order]}, {out} long")


def resample(frame: DataFrame, stream: str, step: float) -> DataFrame:
    """(stream, i, v) at positions i * step between samples s (0, 1, ...), by linear interpolation."""
    order = Window.partitionBy(stream).orderBy("s")
    pairs = frame.withColumn("next", F.coalesce(F.lead("v").over(order), F.col("v"))).withColumn("n", F.count("*").over(Window.partitionBy(stream)))
    first = F.ceil(F.col("s") / step).cast("long")
    last = F.ceil((F.col("s") + 1) / step).cast("long") - 1
    inside = pairs.filter(last >= first).select(stream, "s", "v", "next", F.explode(F.sequence(first, last)).alias("i"))
    part = F.col("i") * step - F.col("s")
    return inside.select(stream, "i", (F.col("v") + (F.col("next") - F.col("v")) * part).alias("v"))


def pcm8(v: Column, gain: Column) -> Column:
    """8-bit samples, rounded half away from zero and clipped."""
    return F.greatest(F.lit(-128), F.least(F.lit(127), F.round(v * gain).cast("int")))


def snr(frame: DataFrame, gains: list[float], stream: str) -> DataFrame:
    """Signal, noise, clipped samples and decibels of each stream at each gain."""
    each = frame.withColumn("gain", F.explode(F.array(*map(F.lit, gains)))).withColumn("out", pcm8(F.col("v"), F.col("gain")))
    noise = F.col("v") * F.col("gain") - F.col("out")
    sums = each.groupBy(stream, "gain").agg(F.sum(F.pow(F.col("v") * F.col("gain"), F.lit(2))).alias("signal"), F.sum(noise * noise).alias("noise"), F.count_if(F.abs(F.col("v") * F.col("gain")) > 127.5).alias("clipped"))
    return sums.withColumn("db", F.when(F.col("noise") > 0, 10 * F.log10(F.col("signal") / F.col("noise"))).otherwise(99.0))


def best_gain(levels: DataFrame, stream: str, within: float = 1.0) -> DataFrame:
    """The loudest gain within a decibel of the best."""
    top = levels.groupBy(stream).agg(F.max("db").alias("top"))
    return levels.join(top, stream).filter(F.col("db") >= F.col("top") - within).groupBy(stream).agg(F.max("gain").alias("gain"))


def high_pass_energy(values: np.ndarray, hz: float, cut: float = 2000.0) -> float:
    """Energy above a second-order Butterworth high-pass."""
    w = 2 * np.pi * cut / hz
    alpha, c = np.sin(w) / np.sqrt(2), np.cos(w)
    b = np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2]) / (1 + alpha)
    a1, a2 = -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)
    z1 = z2 = total = 0.0
    for x in values.tolist():
        y = b[0] * x + z1
        z1, z2 = b[1] * x - a1 * y + z2, b[2] * x - a2 * y
        total += y * y
    return total


def pick_channel(left: np.ndarray, right: np.ndarray, hz: float) -> str:
    """mid if the difference of the channels is more than 5 dB below their mean, above 2 kHz; else the louder channel,
    as a mean would cancel what they don't share. Silence is mid."""
    energy = {n: high_pass_energy(v, hz) for n, v in (("left", left), ("right", right), ("mid", (left + right) / 2), ("side", (left - right) / 2))}
    if energy["mid"] <= 0 or energy["side"] < energy["mid"] * 10**-0.5:
        return "mid"
    return "right" if energy["right"] > energy["left"] else "left"


def decode_bytes(data: bytes, form: int) -> np.ndarray:
    """All samples of one stream's audio bytes, as signed 8-bit numbers."""
    raw = np.frombuffer(data, np.uint8)
    if form == K.PCM8:
        return raw.astype(np.int8)
    nibbles = np.stack([raw >> 4, raw & 15], 1).ravel()
    if form == K.FIB4:
        return np.cumsum(np.array(K.FIB_STEPS)[nibbles]).astype(np.uint8).astype(np.int8)
    return np.array(adpcm_samples(nibbles), np.int8) if form == K.ADPCM else np.zeros(0, np.int8)


def encode_samples(values: np.ndarray, form: int) -> bytes:
    """Samples in -32768..32767 as audio bytes; two to a byte, the first in the high nibble."""
    low = np.clip(np.floor(values / 256 + 0.5), -128, 127).astype(int)
    if form == K.PCM8:
        return low.astype(np.int8).tobytes()
    n = fib4_nibbles(low) if form == K.FIB4 else adpcm_nibbles(values)
    n = np.append(n, np.zeros(len(n) % 2, np.uint8))
    return (n[::2] << 4 | n[1::2]).astype(np.uint8).tobytes()


def stream_audio(packets: DataFrame, headers: DataFrame) -> DataFrame:
    """(stream_id, samples, n, crc): the audio of all packets is one stream, whose state runs on."""
    info = headers.select("stream_id", "audio_format")

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        out = decode_bytes(b"".join(bytes(a) for a in part["audio"] if a is not None), int(part["audio_format"].iloc[0]))
        return pd.DataFrame([(part["stream_id"].iloc[0], out.tobytes(), len(out))], columns=["stream_id", "samples", "n"])

    found = packets.filter(F.size("errors") == 0).join(info, "stream_id").filter("audio_format <> 0").select("stream_id", "n", "audio", "audio_format")
    return found.groupBy("stream_id").applyInPandas(whole, "stream_id string, samples binary, n long").withColumn("crc", F.crc32("samples"))


def fills(audio: DataFrame, size: int = K.AUDIO_BUFFER) -> DataFrame:
    """(stream_id, fill, samples): what each interrupt's buffer holds of a stream's audio; in the last one the last
    sample sounds on. A stream without samples has no fills."""
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.length("samples") / size).cast("int") - 1))
    each = audio.filter(F.length("samples") > 0).select("stream_id", "samples", number.alias("fill"))
    part = F.substring(F.col("samples"), F.col("fill") * size + 1, F.lit(size))
    return each.select("stream_id", "fill", F.rpad(part, F.lit(size), F.substring("samples", -1, 1)).alias("samples"))


def check_played(audio: DataFrame, played: DataFrame) -> DataFrame:
    """(stream_id, count, want, got, status) of (stream_id, count, want) from the player: the checksum of the count
    samples that it filled, the last one repeated behind the end. SHORT: it didn't fill them all."""
    both = played.join(audio.select("stream_id", "samples"), "stream_id")
    silent = F.length("samples") == 0
    whole = F.rpad(F.when(silent, F.lit(b"\0")).otherwise(F.col("samples")), F.col("count").cast("int"), F.when(silent, F.lit(b"\0")).otherwise(F.substring("samples", -1, 1)))
    out = both.withColumn("got", F.crc32(whole))
    status = F.when(F.col("got") != F.col("want"), "FAILED").when(F.col("count") < F.length("samples"), "SHORT").otherwise("OK")
    return out.select("stream_id", "count", "want", "got", status.alias("status"))


def slices(total: int, frames: int, hz: float) -> list[tuple[int, int]]:
    """(first, end) sample of each packet: even counts, by exact rates."""
    through = lambda n: min(total, 2 * int((n + 1) * (hz / K.FPS) // 2))
    return [(through(n - 1) if n else 0, through(n)) for n in range(frames)]


def better_audio(build, budget: int, lossless: bool, rates: list[int]) -> tuple[int, int]:
    """(format, rate) that a stream can afford: build(format, rate) gives its bytes.

    Fibonacci delta at the first rate is what there is; with lossless video and room PCM replaces it, and then
    the highest of the other rates that fits."""
    form, rate = K.FIB4, rates[0]
    if lossless and build(K.PCM8, rate) <= budget:
        form = K.PCM8
        rate = max([r for r in rates if build(form, r) <= budget], default=rate)
    return form, rate
