"""The library's operators on the driver's tables, each as (name, query, SQL or None)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import bits, color, cost
from ..operators import audio, calibrate, convert, decode, delta, prepare, quantize, report, search
from ..operators.encode import Settings
from ..sources import bitstream, disk
from . import clips

ALL: dict[str, tuple] = {}
PALETTE = [(0, 0, 0), (255, 255, 255), (40, 25, 0), (120, 100, 60), (200, 50, 90), (80, 200, 150), (240, 250, 240), (130, 125, 120)]
_PALETTE_SQL = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE))


def query(sql: str | None = None):
    def add(f):
        ALL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark, d) -> DataFrame:
    """Line items as pixels: a scene a line number, a colour from quantity, discount and tax."""
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    return table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("scene"), (F.col("l_quantity").cast("int") * 5 % 256).alias("r"), (cents("l_discount") * 25).alias("g"), (cents("l_tax") * 30).alias("b"))


PIXELS = "pixels AS (SELECT CAST(l_linenumber AS INT) AS scene, CAST(l_quantity AS INT) * 5 % 256 AS r, CAST(round(l_discount * 100) AS INT) * 25 AS g, CAST(round(l_tax * 100) AS INT) * 30 AS b FROM lineitem)"
HIST = PIXELS + ", hist AS (SELECT scene, r, g, b, count(*) AS n FROM pixels GROUP BY ALL)"
NEAR = HIST + f", pal(i, pr, pg, pb) AS (VALUES {_PALETTE_SQL}), near AS (SELECT scene, r, g, b, n, min(((r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb)) * 100 + i) AS k FROM hist, pal GROUP BY ALL)"


@query(f"WITH {HIST} SELECT scene, r, g, b, n FROM hist")
def color_histogram(spark, d):
    return quantize.histogram(pixels(spark, d), "scene", "r", "g", "b")


@query(f"WITH {HIST} SELECT scene, count(*) AS colors, CAST(sum(n) AS BIGINT) AS pixels FROM hist GROUP BY scene")
def unique_colors(spark, d):
    return color_histogram(spark, d).groupBy("scene").agg(F.count("*").alias("colors"), F.sum("n").alias("pixels"))


def _nearest(spark, d):
    square = lambda c, n: (F.col(n) - c[n]) * (F.col(n) - c[n])
    pal = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(p, "rgb", strict=True))) for p in PALETTE))
    return color_histogram(spark, d).withColumn("best", quantize.nearest(pal, lambda c: square(c, "r") + square(c, "g") + square(c, "b")))


@query(f"WITH {NEAR} SELECT scene, r, g, b, n, CAST(k % 100 AS INT) AS idx, CAST(k // 100 AS INT) AS d2 FROM near")
def nearest_palette(spark, d):
    return _nearest(spark, d).select("scene", "r", "g", "b", "n", F.col("best.i").alias("idx"), F.col("best.d2").alias("d2"))


@query(f"WITH {NEAR} SELECT scene, CAST(sum(CAST(floor(sqrt(k // 100) * 1000) AS BIGINT) * n) AS BIGINT) AS error_milli, CAST(sum(n) AS BIGINT) AS pixels FROM near GROUP BY scene")
def quant_error(spark, d):
    return _nearest(spark, d).groupBy("scene").agg(F.sum(F.floor(F.sqrt("best.d2") * 1000) * F.col("n")).alias("error_milli"), F.sum("n").alias("pixels"))


@query(f"WITH {NEAR}, known AS (SELECT DISTINCT scene, r, g, b, CAST(k % 100 AS INT) AS idx FROM near WHERE r < 120) SELECT p.scene, coalesce(idx, 0) AS idx, count(*) AS n FROM pixels p LEFT JOIN known USING (scene, r, g, b) GROUP BY ALL")
def index_lookup(spark, d):
    known = nearest_palette(spark, d).filter("r < 120").select("scene", "r", "g", "b", "idx")
    return quantize.lookup(pixels(spark, d), known, ["scene", "r", "g", "b"]).groupBy("scene", "idx").agg(F.count("*").alias("n"))


@query(f"WITH {HIST}, c AS (SELECT r, g, b, ((r*15+127)//255)*256 + ((g*15+127)//255)*16 + (b*15+127)//255 AS code FROM hist) SELECT DISTINCT r, g, b, CAST(code AS INT) AS code, CAST((code // 256) * 17 AS INT) AS r8, CAST((code // 16 % 16) * 17 AS INT) AS g8, CAST((code % 16) * 17 AS INT) AS b8, CAST((code // 2) & 1911 AS INT) AS half FROM c")
def rgb444(spark, d):
    c = pixels(spark, d).select("r", "g", "b").distinct().withColumn("code", color.rgb444(F.col("r"), F.col("g"), F.col("b")))
    back = color.rgb_of(F.col("code"))
    return c.select("r", "g", "b", "code", *(back[n].alias(f"{n}8") for n in "rgb"), color.half_bright(F.col("code")).alias("half"))


_LIN = lambda c: f"CASE WHEN {c}/255.0::DOUBLE <= 0.04045::DOUBLE THEN {c}/255.0::DOUBLE/12.92::DOUBLE ELSE pow(({c}/255.0::DOUBLE+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END"
_MAT = lambda row, cols: " + ".join(f"{c} * ({k}::DOUBLE)" for k, c in zip(row, cols, strict=True))


@query(f"""WITH {PIXELS}, u AS (SELECT DISTINCT r, g, b FROM pixels), l AS (SELECT r, g, b, {_LIN('r')} AS lr, {_LIN('g')} AS lg, {_LIN('b')} AS lb FROM u),
m AS (SELECT r, g, b, {', '.join(f'cbrt({_MAT(row, ("lr", "lg", "lb"))}) AS {n}' for row, n in zip(color.TO_LMS, ('x', 'y', 'z'), strict=True))} FROM l)
SELECT r, g, b, {', '.join(f'CAST(floor(({_MAT(row, ("x", "y", "z"))}) * 100000 + 0.5) AS BIGINT) AS {n}' for row, n in zip(color.TO_LAB, ('lab_l', 'lab_a', 'lab_b'), strict=True))}, r AS r_back, g AS g_back, b AS b_back FROM m""")
def oklab(spark, d):
    u = pixels(spark, d).select("r", "g", "b").distinct().withColumn("lab", color.oklab(F.col("r"), F.col("g"), F.col("b")))
    back = color.srgb(F.col("lab"))
    return u.select("r", "g", "b", *(F.floor(F.col(f"lab.{n}") * 100000 + 0.5).alias(f"lab_{n.lower()}") for n in "Lab"), *(back[n].alias(f"{n}_back") for n in "rgb"))


@query("""WITH e AS (SELECT event_id // 8 AS cell, 7 - event_id % 8 AS bit, user_id % 32 AS v FROM events)
SELECT cell, plane, CAST(sum(((v >> plane) & 1) << bit) AS BIGINT) AS byte FROM e, unnest(range(0, 5)) AS p(plane) GROUP BY cell, plane""")
def bitplanes(spark, d):
    e = table(spark, d, "events").select(F.expr("event_id div 8").alias("cell"), (7 - F.col("event_id") % 8).cast("int").alias("bit"), (F.col("user_id") % 32).alias("v"))
    each = e.withColumn("plane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return each.groupBy("cell", "plane").agg(F.sum(F.expr("shiftleft(shiftright(v, cast(plane as int)) & 1, bit)")).alias("byte"))


@query("""WITH e AS (SELECT event_id, event_id // 8 AS cell, 7 - event_id % 8 AS bit, user_id % 32 AS v FROM events) SELECT event_id, v AS idx FROM e""")
def depack(spark, d):
    """Back from bit-planes to the pixels."""
    planes = bitplanes(spark, d).withColumn("event_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("cell") * 8 + i)))
    out = planes.groupBy("event_id").agg(F.sum(F.expr("shiftleft(shiftright(byte, cast(7 - event_id % 8 as int)) & 1, cast(plane as int))")).alias("idx"))
    return out.join(table(spark, d, "events").select("event_id"), "event_id", "left_semi")


@query("SELECT v, CAST(sum(((v >> i) & 1) * 3 * (1 << (2 * i))) AS INT) AS doubled FROM unnest(range(0, 256)) AS a(v), unnest(range(0, 8)) AS b(i) GROUP BY v")
def double_byte(spark, d):
    return spark.range(256).select(F.col("id").alias("v"), bits.double_byte(F.col("id").cast("int")).cast("int").alias("doubled"))


@query("""WITH tab AS (SELECT list(c ORDER BY v) AS t FROM (SELECT v, list_reduce(range(0, 8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, v::BIGINT) AS c FROM unnest(range(0, 256)) AS u(v))),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents)
SELECT doc_id, xor(list_reduce(bytes, lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM b, tab""")
def text_crc(spark, d):
    """CRC-32 of every whole text; chained over two halves it is the same."""
    return table(spark, d, "documents").select("doc_id", F.crc32(F.encode("text", "utf-8")).alias("crc"))


NIBBLES = "nib AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS s, CAST(floor(abs(value) * 100) AS BIGINT) % 16 AS nibble FROM events)"


def nibbles(spark, d):
    s = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").select("user_id", "event_id", s.cast("long").alias("s"), (F.floor(F.abs("value") * 100) % 16).alias("nibble"))


@query(f"""WITH {NIBBLES}, st AS (SELECT *, (list_value({', '.join(map(str, K.FIB_STEPS))}))[nibble + 1] AS step FROM nib),
t AS (SELECT user_id, event_id, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS t FROM st)
SELECT user_id, event_id, CAST(((t + 128) % 256 + 256) % 256 - 128 AS INT) AS v FROM t""")
def fib4_decode(spark, d):
    return audio.fib4_decode(nibbles(spark, d), "user_id", "event_id").select("user_id", "event_id", "v")


_STEP = f"(list_value({', '.join(map(str, K.ADPCM_STEPS))}))"
_MOVE = "((step >> 3) + (CASE WHEN nibble & 4 > 0 THEN step ELSE 0 END) + (CASE WHEN nibble & 2 > 0 THEN step >> 1 ELSE 0 END) + (CASE WHEN nibble & 1 > 0 THEN step >> 2 ELSE 0 END))"


@query(f"""WITH RECURSIVE {NIBBLES}, f(user_id, s, pred, idx) AS (
  SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM nib
  UNION ALL
  SELECT user_id, s, greatest(-32768, least(32767, CASE WHEN nibble & 8 > 0 THEN pred - {_MOVE} ELSE pred + {_MOVE} END)),
         greatest(0, least(88, idx + (list_value(-1, -1, -1, -1, 2, 4, 6, 8))[(nibble & 7) + 1]))
  FROM (SELECT n.user_id, n.s, n.nibble, f.pred, f.idx, {_STEP}[f.idx + 1] AS step FROM f JOIN nib n ON n.user_id = f.user_id AND n.s = f.s + 1))
SELECT user_id, s, CAST(floor(pred / 256.0) AS BIGINT) AS v FROM f WHERE s >= 0""")
def adpcm_decode(spark, d):
    return audio.fold_stream(nibbles(spark, d), "user_id", "s", "nibble", audio.adpcm_samples, "v")


def _samples(spark, d):
    s = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").select("user_id", s.cast("long").alias("s"), (F.pmod(F.floor(F.col("value") * 10), F.lit(256)) - 128).cast("int").alias("v"))


SAMPLES = "smp AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS s, CAST(((floor(value * 10) % 256) + 256) % 256 - 128 AS BIGINT) AS v FROM events)"
_FIB = f"(list_value({', '.join(map(str, K.FIB_STEPS))}))"


@query(f"""WITH RECURSIVE {SAMPLES}, f(user_id, s, acc, nibble) AS (
  SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM smp
  UNION ALL
  SELECT user_id, s, acc + {_FIB}[k], CAST(k - 1 AS BIGINT) FROM (SELECT user_id, s, acc, list_position(miss, list_min(miss)) AS k FROM (
    SELECT smp.user_id, smp.s, f.acc, list_transform({_FIB}, lambda x: CASE WHEN f.acc + x < -128 OR f.acc + x > 127 THEN 1000000 ELSE abs(f.acc + x - smp.v) END) AS miss
    FROM f JOIN smp ON smp.user_id = f.user_id AND smp.s = f.s + 1)))
SELECT user_id, s, nibble FROM f WHERE s >= 0""")
def fib4_encode(spark, d):
    return audio.fold_stream(_samples(spark, d), "user_id", "s", "v", audio.fib4_nibbles, "nibble")


def _moved(pred: str, step: str, n: str) -> str:
    """SQL of the predictor after a nibble."""
    move = f"(({step} >> 3) + ({n} >> 2 & 1) * {step} + ({n} >> 1 & 1) * ({step} >> 1) + ({n} & 1) * ({step} >> 2))"
    return f"greatest(-32768, least(32767, {pred} + CASE WHEN {n} >= 8 THEN -{move} ELSE {move} END))"


@query(f"""WITH RECURSIVE {SAMPLES}, nx AS (SELECT user_id, s, v * 256 AS v, lead(v * 256) OVER (PARTITION BY user_id ORDER BY s) AS v2 FROM smp), f(user_id, s, pred, idx, nibble) AS (
  SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM smp
  UNION ALL
  SELECT user_id, s, p1, i1, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c, n) AS k FROM (
    SELECT user_id, s, n, p1, i1, (p1 - v) * (p1 - v) + coalesce(min((p2 - v2) * (p2 - v2)), 0) AS c FROM (
      SELECT *, {_moved('p1', f'{_STEP}[i1 + 1]', 'm')} AS p2 FROM (
        SELECT f.user_id, nx.s, nx.v, nx.v2, n, {_moved('f.pred', f'{_STEP}[f.idx + 1]', 'n')} AS p1,
               greatest(0, least(88, f.idx + (list_value(-1, -1, -1, -1, 2, 4, 6, 8))[(n & 7) + 1])) AS i1
        FROM f JOIN nx ON nx.user_id = f.user_id AND nx.s = f.s + 1, unnest(range(0, 16)) AS a(n)), unnest(range(0, 16)) AS b(m))
    GROUP BY user_id, s, n, p1, i1, v)) WHERE k = 1)
SELECT user_id, s, nibble FROM f WHERE s >= 0""")
def adpcm_encode(spark, d):
    return audio.fold_stream(_samples(spark, d).withColumn("v", F.col("v") * 256), "user_id", "s", "v", audio.adpcm_nibbles, "nibble")


@query("""WITH g AS (SELECT event_type, event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS gap FROM events),
l AS (SELECT event_type, list_sort(list(gap)) AS gs FROM g WHERE gap IS NOT NULL GROUP BY event_type),
m AS (SELECT event_type, gs, gs[len(gs) // 2 + 1] AS median FROM l)
SELECT event_type, CAST(median AS BIGINT) AS median, CAST(len(list_filter(gs, lambda x: abs(x - median) <= 1)) AS BIGINT) AS regular, CAST(len(gs) AS BIGINT) AS gaps FROM m""")
def pulldown_interval(spark, d):
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("event_type").orderBy("event_id"))
    gaps = table(spark, d, "events").select("event_type", gap.alias("gap")).filter("gap is not null")
    both = gaps.join(prepare.upper_median(gaps, "event_type", "gap"), "event_type")
    return both.groupBy("event_type", "median").agg(F.count_if(F.abs(F.col("gap") - F.col("median")) <= 1).alias("regular"), F.count("*").alias("gaps"))


DELTAS = "dl AS (SELECT user_id, event_id, row_number() OVER w - 1 AS pos, abs(value - lag(value) OVER w) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


def _deltas(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("delta"))


@query(f"""WITH RECURSIVE {DELTAS}, f(user_id, pos, event_id, last, cut) AS (
  SELECT user_id, pos, event_id, pos, true FROM dl WHERE pos = 0
  UNION ALL
  SELECT n.user_id, n.pos, n.event_id, CASE WHEN n.delta >= 20 AND n.pos - f.last >= 6 THEN n.pos ELSE f.last END, n.delta >= 20 AND n.pos - f.last >= 6
  FROM f JOIN dl n ON n.user_id = f.user_id AND n.pos = f.pos + 1)
SELECT user_id, event_id, cut, sum(CAST(cut AS INT)) OVER (PARTITION BY user_id ORDER BY pos)::BIGINT - 1 AS scene FROM f""")
def scene_cuts(spark, d):
    found = prepare.cuts(_deltas(spark, d), "user_id", "event_id", "delta", 20.0, 6)
    return prepare.scene_of(found, "user_id", "event_id").select("user_id", "event_id", "cut", "scene")


@query(f"""WITH {DELTAS}, c AS (SELECT user_id, event_id AS start, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS scene FROM dl WHERE pos = 0 OR delta >= 20)
SELECT dl.user_id, dl.event_id, c.scene FROM dl ASOF JOIN c ON dl.user_id = c.user_id AND dl.event_id >= c.start""")
def scene_asof(spark, d):
    marked = _deltas(spark, d).withColumn("cut", F.col("delta").isNull() | (F.col("delta") >= 20))
    return prepare.scene_of(marked, "user_id", "event_id").select("user_id", "event_id", "scene")


@query(f"""WITH u AS (SELECT user_id, count(*) AS frames FROM events GROUP BY user_id), k AS (SELECT user_id, frames, unnest(range(0, frames * 2)) AS slot FROM u),
s AS (SELECT user_id, slot, least(CAST(floor(slot * 15.0::DOUBLE / {K.FPS!r}::DOUBLE + 0.5) AS BIGINT), frames - 1) AS frame FROM k),
e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events)
SELECT s.user_id, s.slot, e.event_id FROM s JOIN e ON s.user_id = e.user_id AND s.frame = e.frame""")
def cadence(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("frame"))
    k = e.groupBy("user_id").agg(F.count("*").alias("frames")).withColumn("slot", F.explode(F.expr("sequence(0L, frames * 2 - 1)")))
    slots = k.select("user_id", "slot", prepare.source_frame(F.col("slot"), F.lit(15.0), F.col("frames")).alias("frame"))
    return slots.join(e, ["user_id", "frame"]).select("user_id", "slot", "event_id")


@query("""WITH s AS (SELECT user_id, row_number() OVER w - 1 AS s, value AS v, coalesce(lead(value) OVER w, value) AS nx, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT user_id, unnest(range(0, CAST(ceil(n / 1.5) AS BIGINT))) AS i FROM (SELECT DISTINCT user_id, n FROM s))
SELECT i.user_id, i.i, CAST(floor((v + (nx - v) * (i.i * 1.5::DOUBLE - s.s)) * 1000 + 0.5) AS BIGINT) AS milli FROM i JOIN s ON s.user_id = i.user_id AND s.s = CAST(floor(i.i * 1.5) AS BIGINT)""")
def resample(spark, d):
    s = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    e = table(spark, d, "events").select("user_id", s.alias("s"), F.col("value").alias("v"))
    return audio.resample(e, "user_id", 1.5).select("user_id", "i", F.floor(F.col("v") * 1000 + 0.5).alias("milli"))


@query(f"""WITH n AS (SELECT event_id AS n FROM events), h AS (SELECT n, 2 * CAST(floor((n + 1) * ({K.PAULA_HZ / 443!r}::DOUBLE / {K.FPS!r}::DOUBLE) / 2) AS BIGINT) AS upto, 2 * CAST(floor(n * ({K.PAULA_HZ / 443!r}::DOUBLE / {K.FPS!r}::DOUBLE) / 2) AS BIGINT) AS before FROM n)
SELECT n, before AS first, upto - before AS samples, (upto - before) // 2 AS fib4_bytes FROM h""")
def audio_slices(spark, d):
    n, hz = F.col("n"), K.PAULA_HZ / 443
    e = table(spark, d, "events").select(F.col("event_id").alias("n"))
    out = e.withColumn("first", cost.samples_through(n - 1, hz)).withColumn("samples", cost.samples_through(n, hz) - F.col("first"))
    return out.withColumn("fib4_bytes", cost.audio_bytes(F.lit(K.FIB4), F.col("samples")))


_GAINS = [0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5]
SNR = f"""lv AS (SELECT user_id, gain, sum(pow(value * gain, 2)) AS signal, sum(pow(value * gain - greatest(-128, least(127, round(value * gain))), 2)) AS noise, count(*) FILTER (abs(value * gain) > 127.5) AS clipped
  FROM events, (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in _GAINS)}]) AS gain) GROUP BY user_id, gain), db AS (SELECT *, CASE WHEN noise > 0 THEN 10 * log10(signal / noise) ELSE 99 END AS db FROM lv)"""


def _snr(spark, d):
    return audio.snr(table(spark, d, "events").select("user_id", F.col("value").alias("v")), _GAINS, "user_id")


@query(f"WITH {SNR} SELECT user_id, gain, CAST(floor(db * 1000 + 0.5) AS BIGINT) AS db_milli, clipped FROM db")
def snr_gain(spark, d):
    return _snr(spark, d).select("user_id", "gain", F.floor(F.col("db") * 1000 + 0.5).alias("db_milli"), "clipped")


@query(f"WITH {SNR}, t AS (SELECT user_id, max(db) AS top FROM db GROUP BY user_id) SELECT user_id, max(gain) AS gain FROM db JOIN t USING (user_id) WHERE db >= top - 1 GROUP BY user_id")
def gain_choice(spark, d):
    return audio.best_gain(_snr(spark, d), "user_id")


CHARS = "ch AS (SELECT doc_id, i - 1 AS pos, substr(text, i, 1) AS c FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents))"


def _texts(spark, d, f, schema: str) -> DataFrame:
    """f(identifiers, symbols, starts) of whole texts, an Arrow batch at a time."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in f(keys, *delta.symbols(part.column(1)))], [c.split()[0] for c in schema.split(", ")])

    return table(spark, d, "documents").select("doc_id", "text").mapInArrow(run, schema)


@query(f"""WITH {CHARS.replace("substr(text, i, 1)", "cs[i]").replace("SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents", "SELECT doc_id, string_split(text, '') AS cs, unnest(range(1, length(text) + 1)) AS i FROM documents")},
r AS (SELECT doc_id, pos // 20 AS row, pos % 20 AS col, c, row_number() OVER (PARTITION BY doc_id, pos // 20 ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, pos // 20, c ORDER BY pos) AS g FROM ch)
SELECT doc_id, row, min(col) AS col, count(*) AS length FROM r GROUP BY doc_id, row, c, g HAVING count(*) >= 3""")
def rle_runs(spark, d):
    def runs(keys, codes, at):
        text, row, col, length = delta.row_runs(codes, at, K.ROW_BYTES, 3)
        return keys[text], row, col, length

    return _texts(spark, d, runs, "doc_id long, row long, col long, length long")


_ROWS = "rw AS (SELECT doc_id, pos // 20 AS row, pos % 20 AS col, c, lag(c) OVER (PARTITION BY doc_id, pos % 20 ORDER BY pos) AS old FROM ch), cs AS (SELECT doc_id, row, count(*) FILTER (old IS NULL OR old <> c) AS cols, CAST(coalesce(sum(CASE WHEN old IS NOT NULL AND abs(unicode(c) - unicode(old)) >= 3 THEN abs(unicode(c) - unicode(old)) END), 0) AS BIGINT) AS total FROM rw GROUP BY doc_id, row)"
_FAST = CHARS.replace("substr(text, i, 1)", "cs[i]").replace("SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents", "SELECT doc_id, string_split(text, '') AS cs, unnest(range(1, length(text) + 1)) AS i FROM documents")


@query(f"""WITH {_FAST}, {_ROWS}, st AS (SELECT doc_id, count(*) FILTER (cols > 0) AS rows, CAST(sum(cols) AS BIGINT) AS cols, count(*) FILTER (cols = 20) AS full_rows FROM cs GROUP BY doc_id)
SELECT doc_id, rows, cols, full_rows, CAST((rows - full_rows) * {K.CYC_ROW} + (cols - full_rows * 20) * {K.CYC_COL} + (cols * 3 - full_rows * 60) * {K.CYC_BYTE} + full_rows * {K.CYC_FULL_ROW} + full_rows * 60 * {K.CYC_FULL_BYTE} AS BIGINT) AS cycles FROM st""")
def delta_stats(spark, d):
    def stats(keys, codes, at):
        text, cols, _ = delta.row_changes(codes, at, K.ROW_BYTES, 3)
        some, n = np.unique(text), len(keys)
        by = [np.bincount(text, x, minlength=n).astype(np.int64)[some] for x in (cols > 0, cols, cols == K.ROW_BYTES)]
        return keys[some], *by

    st = _texts(spark, d, stats, "doc_id long, rows long, cols long, full_rows long")
    return st.withColumn("cycles", cost.delta_cost(F.lit(3), F.col("rows"), F.col("cols"), F.col("cols") * 3, F.col("full_rows")).cast("long"))


@query(f"WITH {_FAST}, {_ROWS} SELECT doc_id, count(*) FILTER (total >= 12) AS kept_rows, CAST(coalesce(sum(total) FILTER (total >= 12), 0) AS BIGINT) AS error FROM cs GROUP BY doc_id")
def quality_filter(spark, d):
    """The lossy rule on rows: small steps stay as they were, then rows whose steps add up to little."""

    def kept(keys, codes, at):
        text, _, total = delta.row_changes(codes, at, K.ROW_BYTES, 3)
        some, n = np.unique(text), len(keys)
        by = [np.bincount(text, x, minlength=n).astype(np.int64)[some] for x in (total >= 12, np.where(total >= 12, total, 0))]
        return keys[some], *by

    return _texts(spark, d, kept, "doc_id long, kept_rows long, error long")


@query("""SELECT CAST(l_linenumber AS INT) AS scene, CASE WHEN l_tax <= 0.03 THEN 'good' WHEN l_discount > 0.05 THEN 'colours' WHEN l_suppkey % 3 = l_partkey % 3 THEN 'held' ELSE 'compression' END AS why, count(*) AS n FROM lineitem GROUP BY ALL""")
def error_attribution(spark, d):
    why = quantize.attribution(F.col("l_tax"), F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0), F.col("l_suppkey") % 3, F.col("l_partkey") % 3, 0.03)
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("scene"), why.alias("why")).agg(F.count("*").alias("n"))


@query("""SELECT source, doc_id, CAST(sum(n_chars) OVER w - n_chars AS BIGINT) AS off, CASE WHEN sum(n_chars) OVER w <= 100000 THEN 0 ELSE 1 END AS block FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def packet_offsets(spark, d):
    """Packet offsets of each stream, and the memory block that each packet goes to."""
    return prepare.blocks(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 100_000).select("source", "doc_id", "off", "block")


@query("""WITH h AS (SELECT page_id, hex(encode(html)) AS h FROM pages)
SELECT page_id, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS magic, CAST(('0x' || substr(h, 9, 4)) AS BIGINT) AS version, CAST(('0x' || substr(h, 25, 2)) AS BIGINT) AS planes, CAST(('0x' || substr(h, 41, 8)) AS BIGINT) AS packets FROM h WHERE length(h) >= 64""")
def header_fields(spark, d):
    data = F.encode("html", "utf-8")
    p = table(spark, d, "pages").withColumn("b", data).filter(F.length("b") >= 32)
    return p.select("page_id", *(bits.be(F.col("b"), o, s).alias(n) for n, o, s in (("magic", 0, 4), ("version", 4, 2), ("planes", 12, 1), ("packets", 20, 4))))


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), w AS (SELECT doc_id, CAST('0x' || rpad(substr(h, 8 * i + 1, 8), 8, '0') AS BIGINT) AS w FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 7) // 8)) AS i FROM h)),
t AS (SELECT doc_id, CAST(sum(w) AS BIGINT) AS t FROM w GROUP BY doc_id) SELECT doc_id, CASE WHEN t = 0 THEN 0 ELSE (t - 1) % 4294967295 + 1 END AS checksum FROM t""")
def boot_checksum(spark, d):
    """The end-around-carry sum of every whole text's words."""
    t = table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("b")).filter("length(b) > 0")
    return disk.word_sums(t).select(F.col("key").alias("doc_id"), disk.end_around(F.col("total")).alias("checksum"))


@query("""WITH s AS (SELECT source, doc_id, CAST(ceil(strlen(text) / 512.0) AS BIGINT) AS sectors FROM documents)
SELECT source, doc_id, sectors, CAST(sum(sectors) OVER (PARTITION BY source ORDER BY doc_id) - sectors + 2 AS BIGINT) AS first FROM s""")
def sector_layout(spark, d):
    s = table(spark, d, "documents").select("source", "doc_id", disk.sectors(F.octet_length("text")).alias("sectors"))
    return s.withColumn("first", F.sum("sectors").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sectors") + K.PLAYER_SECTOR)


RESULTS = "rs AS (SELECT o_custkey, o_orderkey AS cfg_id, CAST(o_orderkey % 3 + 3 AS INT) AS planes, CAST(80 + 5 * (o_orderkey % 5) AS INT) AS size, CAST(floor(o_totalprice) AS BIGINT) % 100 AS bad, o_orderstatus <> 'P' AS ok, o_totalprice < 300000 AS fits, CAST(o_orderkey % 4 AS INT) AS worst_late, o_orderkey % 7 = 0 AS raised FROM orders)"


def _results(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select("o_custkey", k.alias("cfg_id"), (k % 3 + 3).cast("int").alias("planes"), (80 + 5 * (k % 5)).cast("int").alias("size"), (F.floor("o_totalprice") % 100).alias("bad"), (F.col("o_orderstatus") != "P").alias("ok"), (F.col("o_totalprice") < 300000).alias("fits"), (k % 4).cast("int").alias("worst_late"), (k % 7 == 0).alias("raised"))


@query(f"""WITH {RESULTS}, g AS (SELECT *, min(raised) OVER (PARTITION BY o_custkey) AS r0 FROM rs WHERE ok AND fits AND worst_late <= 2),
h AS (SELECT *, min(bad) OVER (PARTITION BY o_custkey) AS b0 FROM g WHERE raised = r0),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY planes DESC, size DESC, bad, cfg_id) AS nth FROM h WHERE bad <= b0 + 2)
SELECT o_custkey, cfg_id, planes, size, bad FROM r WHERE nth = 1""")
def config_pick(spark, d):
    return search.winner(_results(spark, d), "o_custkey")


@query(f"""WITH {RESULTS}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, CASE WHEN fits THEN bad ELSE size END, cfg_id) AS nth FROM rs) SELECT o_custkey, cfg_id, fits FROM r WHERE nth = 1""")
def rate_control_pick(spark, d):
    """The best measured stream: of those that fit the least error, else the smallest."""
    rank = F.struct((~F.col("fits")).alias("a"), F.when(F.col("fits"), F.col("bad")).otherwise(F.col("size")).alias("b"), "cfg_id")
    return _results(spark, d).groupBy("o_custkey").agg(F.min_by(F.struct("cfg_id", "fits"), rank).alias("x")).select("o_custkey", "x.cfg_id", "x.fits")


@query("SELECT CAST(floor(regr_slope(l_extendedprice, l_quantity) * 100 + 0.5) AS BIGINT) AS slope, CAST(floor(regr_intercept(l_extendedprice, l_quantity) * 100 + 0.5) AS BIGINT) AS base, CAST(floor(regr_r2(l_extendedprice, l_quantity) * 1000000 + 0.5) AS BIGINT) AS r2, count(*) AS n FROM lineitem")
def cost_fit(spark, d):
    got = calibrate.fit(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    base, slope = got["weights"]
    return spark.createDataFrame([(int(np.floor(slope * 100 + 0.5)), int(np.floor(base * 100 + 0.5)), int(np.floor(got["r2"] * 1e6 + 0.5)), got["rows"])], "slope long, base long, r2 long, n long")


@query("SELECT l_returnflag AS op, count(*) AS packets, CAST(sum(l_quantity) AS BIGINT) AS bytes, CAST(max(l_quantity) AS BIGINT) AS largest, min(l_orderkey) FILTER (l_quantity = 50) AS first_largest FROM lineitem GROUP BY l_returnflag")
def stream_breakdown(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("op")).agg(F.count("*").alias("packets"), F.sum("l_quantity").cast("long").alias("bytes"), F.max("l_quantity").cast("long").alias("largest"), F.max_by("l_orderkey", F.struct("l_quantity", -F.col("l_orderkey"))).alias("first_largest"))


@query("""WITH e AS (SELECT user_id, row_number() OVER w - 1 AS n, epoch_us(ts) - first_value(epoch_us(ts)) OVER w AS since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT user_id, greatest(0, CAST(ceil((since - n * 3600000000) / 40000.0) AS BIGINT)) AS late FROM e) SELECT user_id, count(*) AS shown, count(*) FILTER (late > 0) AS late, CAST(max(late) AS BIGINT) AS worst FROM l GROUP BY user_id""")
def late_frames(spark, d):
    """Late ones are counted, not dropped."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("n"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), w_first("ts", w).alias("first"))
    late = F.greatest(F.lit(0), F.ceil((F.col("us") - F.col("first") - (F.col("n") - 1) * 3600000000) / 40000.0)).cast("long")
    return e.select("user_id", late.alias("late")).groupBy("user_id").agg(F.count("*").alias("shown"), F.count_if(F.col("late") > 0).alias("late"), F.max("late").alias("worst"))


def w_first(name: str, w) -> F.Column:
    return F.first(F.unix_micros(F.col(name).cast("timestamp"))).over(w)


@query(f"SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, CAST(([{', '.join(map(str, K.BAYER_4))}])[(l_suppkey % 4) * 4 + l_partkey % 4 + 1] AS INT) AS t4, CAST(([{', '.join(map(str, K.BAYER_2))}])[(l_suppkey % 2) * 2 + l_partkey % 2 + 1] AS INT) AS t2 FROM lineitem")
def dither_index(spark, d):
    x, y = F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), color.dither(x, y, 4).alias("t4"), color.dither(x, y, 2).alias("t2"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS palette FROM events""")
def palette_inherit(spark, d):
    sent = F.when(F.col("event_id") % 3 == 0, F.floor("value"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.last(sent, ignorenulls=True).over(w).alias("palette"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 2 AS buffer, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS v FROM events)
SELECT user_id, event_id, buffer, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, buffer ORDER BY event_id) AS visible FROM e""")
def buffer_parity(spark, d):
    """A cell of the double buffer without copies: the last write to the buffer of the same parity."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, d, "events").select("user_id", "event_id", (n % 2).cast("long").alias("buffer"), F.when(F.col("event_id") % 5 != 0, F.floor("value")).alias("v"))
    w = Window.partitionBy("user_id", "buffer").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("user_id", "event_id", "buffer", F.last("v", ignorenulls=True).over(w).alias("visible"))


@query("""WITH c AS (SELECT p_partkey, 100.0::DOUBLE + p_size * 10 AS w, 100.0::DOUBLE + p_partkey % 200 AS h, 80 + p_size % 21 AS pct, p_partkey % 3 AS a FROM part),
r AS (SELECT p_partkey, a, CASE WHEN a = 1 THEN 100 ELSE pct END AS pct, floor(floor(160 * (16.0::DOUBLE / 15) / (w / h) + 0.5) / 2) * 2 AS across, floor(floor(128 * (w / h) / (16.0::DOUBLE / 15) + 0.5) / 2) * 2 AS down FROM c),
f AS (SELECT *, a <> 2 AND ((a = 0 AND across > 128) OR (a = 1 AND across < 128)) AS tall FROM r),
k AS (SELECT *, CASE WHEN tall THEN down ELSE 160 END AS c, CASE WHEN a = 2 OR tall THEN 128 ELSE across END AS r FROM f),
z AS (SELECT p_partkey, a, CAST(CASE WHEN pct < 100 THEN floor(floor(c * pct / 100.0::DOUBLE + 0.5) / 2) * 2 ELSE c END AS INT) AS cols, CAST(CASE WHEN pct < 100 THEN floor(floor(r * pct / 100.0::DOUBLE + 0.5) / 2) * 2 ELSE r END AS INT) AS rows FROM k)
SELECT p_partkey, cols, rows, CAST((160 - cols) // 2 AS INT) AS x0, CAST((128 - rows) // 2 AS INT) AS y0, CASE WHEN a <> 1 AND cols < 160 THEN 160.0::DOUBLE / cols ELSE 1.0::DOUBLE END AS scale FROM z""")
def geometry(spark, d):
    """Letterbox, crop and stretch; a crop is always at full size."""
    kind = F.col("p_partkey") % 3
    aspect = F.when(kind == 0, "letterbox").when(kind == 1, "crop").otherwise("stretch")
    box = cost.picture(100.0 + F.col("p_size") * 10, 100.0 + F.col("p_partkey") % 200, F.when(kind == 1, 100).otherwise(80 + F.col("p_size") % 21), aspect)
    return table(spark, d, "part").select("p_partkey", box.alias("x")).select("p_partkey", "x.*")


@query("""WITH p AS (SELECT p_partkey, CAST(80 + p_partkey % 5 * 5 AS INT) AS size, p_size % 4 = 0 AS raised, p_size FROM part),
t AS (SELECT p_partkey, s FROM p, unnest(range(82, 101)) AS r(s) WHERE NOT raised AND s > size AND (s - size) % 2 = 0 AND s < least(size + 5, 102) AND (p_size + s) % 3 > 0)
SELECT p_partkey, CAST(greatest(size, coalesce((SELECT max(s) FROM t WHERE t.p_partkey = p.p_partkey), 0)) AS INT) AS size FROM p""")
def finest_size(spark, d):
    """The finest size of each part's configuration; a made-up rule says which of the sizes between are usable."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = table(spark, d, "part").select(k, s, (80 + k % 5 * 5).cast("int").alias("size"), F.lit(4).alias("planes"), F.lit(3).alias("hold"), (s % 4 == 0).alias("raised"))
    tried = search.finer(pick).withColumns({"ok": (s + F.col("size")) % 3 > 0, "fits": F.lit(True), "worst_late": F.lit(0)})
    return search.finest(pick, tried, "p_partkey").select("p_partkey", "size")


@query("""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS stream_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
f AS (SELECT stream_id, CAST(i AS INT) AS fill, rpad(substr(h, i * 1024 + 1, 1024), 1024, '#') AS part, right(h, 2) AS tail FROM s, unnest(range(0, CAST(ceil(length(h) / 1024.0) AS BIGINT))) AS r(i) WHERE length(h) > 0)
SELECT stream_id, fill, md5(replace(part, '##', tail)) AS samples FROM f""")
def audio_fills(spark, d):
    """The buffers that each interrupt fills, the bytes of a text being the samples."""
    audio_of = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stream_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("samples"))
    return audio.fills(audio_of).select("stream_id", "fill", F.md5(F.hex("samples").cast("binary")).alias("samples"))


@query("""WITH v AS (SELECT p_partkey, CAST(p_partkey % 128 AS INT) AS y, CAST(p_size % 20 AS INT) AS y0, 128 - CAST(p_size % 30 AS INT) AS y1, CAST(p_partkey % 17 AS INT) AS f FROM part),
n AS (SELECT *, CASE WHEN f <= 0 OR y1 <= y0 THEN 1 ELSE CAST(ceil((y1 - y0) / f::DOUBLE) AS INT) END AS bands FROM v)
SELECT p_partkey, bands, CASE WHEN bands <= 1 OR y < y0 THEN 0 ELSE least((y - y0) // f, bands - 1) END AS band, 32 + (bands - 1) * 16 AS words FROM n""")
def band_of(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    v = table(spark, d, "part").select(k, (k % 128).cast("int").alias("y"), (s % 20).cast("int").alias("y0"), (128 - s % 30).cast("int").alias("y1"), (k % 17).cast("int").alias("f"))
    y0, y1, f = F.col("y0"), F.col("y1"), F.col("f")
    return v.select(k, bits.bands(y0, y1, f).alias("bands"), bits.band_of(F.col("y"), y0, y1, f).alias("band"), bits.palette_words(F.lit(32), bits.bands(y0, y1, f), F.lit(8)).alias("words"))


@query("""WITH l AS (SELECT l_orderkey, min(l_linenumber) + l_orderkey % 2 AS want FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN want IS NULL THEN 'UNVERIFIED' WHEN want = 1 THEN 'OK' ELSE 'FAILED' END AS status, count(*) AS n FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY ALL""")
def verify_status(spark, d):
    got = table(spark, d, "orders").select(F.lit("s").alias("stream_id"), F.col("o_orderkey").alias("n"), F.lit(1).alias("got"))
    want = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("n")).agg((F.min("l_linenumber") + F.col("n") % 2).alias("crc")).withColumn("stream_id", F.lit("s"))
    return decode.status(got, want).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT o_orderkey AS n, CAST(floor(o_totalprice) AS BIGINT) % 7 AS cck FROM orders), s AS (SELECT l_orderkey AS n, count(*) AS rows FROM lineitem GROUP BY l_orderkey) SELECT n, rows, cck * 2 AS cycles FROM t JOIN s USING (n) WHERE cck > 0""")
def timing_join(spark, d):
    timing = table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), (F.floor("o_totalprice") % 7).alias("cck"))
    return calibrate.measured(timing, table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("n")).agg(F.count("*").alias("rows"))).select("n", "rows", "cycles")


@query("SELECT event_id, (year(ts) * 313 + month(ts)) * 227 + day(ts) AS cck FROM events")
def beam_stamp(spark, d):
    return table(spark, d, "events").select("event_id", cost.stamp_cck(F.year("ts").cast("long"), F.month("ts"), F.day("ts")).alias("cck"))


@query("SELECT CAST(count(*) AS BIGINT) AS deltas, CAST(count(*) FILTER (d < 0.8) AS BIGINT) AS near_same, CAST(floor(avg(d) * 1000 + 0.5) AS BIGINT) AS mean_milli FROM (SELECT abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events) WHERE d IS NOT NULL")
def frame_deltas(spark, d):
    x = _deltas(spark, d).filter("delta is not null")
    return x.agg(F.count("*").alias("deltas"), F.count_if(F.col("delta") < 0.8).alias("near_same"), F.floor(F.avg("delta") * 1000 + 0.5).alias("mean_milli"))


@query("SELECT DISTINCT event_type AS stream_id, CAST(n AS INT) AS n, 'OK' AS status FROM events, unnest(range(0, 12)) AS r(n)")
def stream_verify(spark, d):
    """Encode a clip an event type, decode it row by row, and check every frame."""
    made = clips.encoded(spark, d)
    files = made.select("stream_id", "content")
    sides = bitstream.read_sidecar(made.select("stream_id", F.col("sidecar").alias("content")))
    return decode.verify(files, sides, bitstream.packets(files)).select("stream_id", "n", "status")


@query(f"""WITH px AS (SELECT event_type AS clip, CAST(event_id % {clips.FRAMES} AS INT) AS f, ((CAST(floor(value) AS BIGINT) % 128) + 128) % 128 AS y, (user_id * 7 % 160) // 8 AS b, max(user_id % 7 + 1) AS v FROM events GROUP BY ALL),
shown AS (SELECT clip, f, v FROM px WHERE f % 4 <> 3 UNION ALL SELECT clip, f + 1, v FROM px WHERE f % 4 = 2),
lit AS (SELECT clip, f, v, 8 * count(*) AS pixels FROM shown GROUP BY ALL),
frames AS (SELECT DISTINCT event_type AS clip, CAST(n AS INT) AS f FROM events, unnest(range(0, {clips.FRAMES})) AS r(n)),
dark AS (SELECT clip, f, 0 AS v, 20480 - coalesce((SELECT sum(pixels) FROM lit WHERE lit.clip = frames.clip AND lit.f = frames.f), 0) AS pixels FROM frames)
SELECT clip AS stream_id, f AS n, CAST((list_value({', '.join(map(str, clips.COLOURS))}))[v + 1] AS INT) AS colour, CAST(pixels AS BIGINT) AS pixels
FROM (SELECT * FROM lit UNION ALL SELECT * FROM dark) WHERE pixels > 0""")
def source_to_disk(spark, d):
    """Raw frames to a disk image, and back: the colours on the screen when the stream on the disk is decoded."""
    made = convert.convert_clips(clips.raw_rows(spark, d), convert.Recipe(Settings(rle=True)))
    files = disk.stream_on_disk(made.select(F.col("clip_id").alias("disk_id"), F.col("image").alias("content"))).withColumnRenamed("disk_id", "stream_id")
    packets, headers = bitstream.packets(files), bitstream.parse_headers(files)
    rows = decode.fold_rows(decode.row_writes(packets, headers))
    return decode.colour_counts(rows, decode.palettes_at(packets, headers), headers)


@query()
def stream_attribution(spark, d):
    """Raw frames to a stream, decoded, and held against the frame behind each: why pixels are off."""
    source = clips.raw_rows(spark, d).withColumnsRenamed({"clip_id": "stream_id", "frame": "n"})
    made = convert.convert_clips(clips.raw_rows(spark, d), convert.Recipe(Settings(rle=True)))
    files = made.select(F.col("clip_id").alias("stream_id"), "content")
    packets, headers = bitstream.packets(files), bitstream.parse_headers(files)
    late = decode.fold_rows(decode.row_writes(packets, headers)).withColumn("n", F.col("n") + 1)
    return decode.attributed(late, source, packets, headers).withColumn("error", F.round("error", 6))


@query()
def stream_parts(spark, d):
    """Bytes by part of the encoded clips."""
    files = clips.encoded(spark, d).select("stream_id", "content")
    return report.delta_parts(bitstream.packets(files), bitstream.parse_headers(files))


@query()
def stream_search(spark, d):
    """Every clip at every configuration, and the winner."""
    configs = search.grid(spark, sizes=(100,))
    schema = "stream_id string, cfg_id int, planes int, hold int, size int, ok boolean, fits boolean, worst_late int, raised boolean, bad double"
    return search.winner(search.evaluate(clips.pixels(spark, d), configs, clips.trial, schema, "stream_id"), "stream_id")


@query()
def kmeans_palette(spark, d):
    return quantize.palettes(color_histogram(spark, d), ["scene"], 8).withColumn("error", F.round("error", 6))


@query()
def palette_swap(spark, d):
    """The palette of the darker half of each scene's colours, with four entries at most swapped for the whole scene's."""

    def swap(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["r", "g", "b"])
        rgb, n = part[["r", "g", "b"]].to_numpy(int), part["n"].to_numpy()
        first = quantize.kmeans(rgb[: len(rgb) // 2], n[: len(rgb) // 2], 8)
        out = quantize.swap_colors(rgb, n, first, quantize.kmeans(rgb, n, 8), 4)
        return pd.DataFrame({"scene": part["scene"].iloc[0], "i": np.arange(len(out)), "old": first, "new": out})

    return color_histogram(spark, d).groupBy("scene").applyInPandas(swap, "scene int, i int, old int, new int")


@query()
def repeated_frames(spark, d):
    """Frames that the repeat pattern drops, by user."""

    def find(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("event_id")
        gone, interval, regular = prepare.repeated_frames(part["delta"].fillna(0).to_numpy())
        return pd.DataFrame([(part["user_id"].iloc[0], len(part), len(gone), interval, regular)], columns=["user_id", "frames", "dropped", "interval", "regular"])

    return _deltas(spark, d).groupBy("user_id").applyInPandas(find, "user_id long, frames long, dropped long, interval double, regular double")


@query(f"""WITH p AS (SELECT o_orderkey, o_orderkey % 7 AS irqs, 300 + o_custkey % 200 AS period, CAST(floor(o_totalprice) AS BIGINT) AS fill, o_custkey % 50 AS vsync FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS disk_id, CASE WHEN vsync > 0 THEN CAST(floor(fill / 1024 / (vsync / 50.0::DOUBLE) * 1000 + 0.5) AS BIGINT) END AS load_milli,
  CASE WHEN irqs >= 2 THEN CAST(floor((irqs * {313 * 227} - (irqs - 1) * 512 * period) * 1000 / {K.PAULA_HZ!r}::DOUBLE * 1000 + 0.5) AS BIGINT) END AS drift_milli,
  CASE WHEN irqs >= 2 AND fill > 0 THEN CAST(floor(fill / irqs * 1000 / {K.PAULA_HZ!r}::DOUBLE * 1000 + 0.5) AS BIGINT) END AS fill_milli FROM p""")
def play_report(spark, d):
    o = table(spark, d, "orders")
    n, zero = F.col("o_orderkey") % 7, F.lit(0).cast("long")
    names = {"audio_irqs": n, "period": 300 + F.col("o_custkey") % 200, "fill_sum": F.floor("o_totalprice"), "bytes": F.floor("o_totalprice"), "load_vsync": F.col("o_custkey") % 50, "last_vbl": n, "audio_format": F.lit(1)}
    rest = "packets late max_late vbl vbl_expected first_vbl first_line_cck last_line_cck fill_max copies copy_sum copy_max".split()
    play = o.select(F.col("o_orderkey").cast("string").alias("disk_id"), *(c.alias(k) for k, c in names.items()), *(zero.alias(k) for k in rest))
    out = report.play_report(play)
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5)
    return out.select("disk_id", milli("load_kb_s").alias("load_milli"), milli("drift_ms").alias("drift_milli"), milli("fill_ms").alias("fill_milli"))


@query("SELECT p_partkey, (1760 - 2 - CAST(ceil((p_partkey * 37 + p_size) / 512.0) AS BIGINT) - 6) * 512 AS budget FROM part")
def disk_budget(spark, d):
    return table(spark, d, "part").select("p_partkey", report.budget(F.col("p_partkey") * 37 + F.col("p_size"), 6).alias("budget"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS disk_id, count(*) FILTER (floor(o_totalprice) % 3 > 0) AS deltas, max(CAST(floor(o_totalprice) AS BIGINT) % 3) FILTER (floor(o_totalprice) % 3 > 0) AS worst FROM orders GROUP BY o_custkey")
def timing_summary(spark, d):
    timing = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("disk_id"), F.col("o_orderkey").alias("n"), (F.floor("o_totalprice") % 3).alias("cck"))
    return report.timing_summary(timing).select("disk_id", "deltas", F.round(F.col("worst_ms") * K.PAULA_HZ / 1000).cast("long").alias("worst"))
