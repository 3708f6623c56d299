"""Disk images: assembly, boot checksum, and the sectors that test players write."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.bits import be

MASK = 0xFFFFFFFF


def end_around_sum(data: bytes) -> int:
    """The 32-bit big-endian words added with the carry coming back in, in closed form."""
    total = int(np.frombuffer(data + b"\0" * (-len(data) % 4), ">u4").astype(object).sum()) if data else 0
    return (total - 1) % MASK + 1 if total else 0


def word_sums(data: DataFrame) -> DataFrame:
    """(key, total) of (key, binary): the plain sum of the big-endian 32-bit words, the last one padded with zeros."""

    def sums(batches):
        for batch in batches:
            total = [None if x is None else int(np.frombuffer(x + b"\0" * (-len(x) % 4), ">u4").sum(dtype=np.uint64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], ["key", "total"])

    return data.mapInArrow(sums, f"key {data.dtypes[0][1]}, total long")


def end_around(total: Column) -> Column:
    """The same for a plain sum of words."""
    return F.when(total == 0, F.lit(0).cast("long")).otherwise((total - 1) % MASK + 1)


def finish_boot(boot: bytes) -> bytes:
    """A boot block with its checksum, for which all words add up to 0xFFFFFFFF."""
    if len(boot) != K.BOOT_BYTES:
        raise ValueError("a boot block has 1024 bytes")
    blank = boot[:4] + b"\0\0\0\0" + boot[8:]
    return blank[:4] + struct.pack(">I", MASK ^ end_around_sum(blank)) + blank[8:]


def boot_is_valid(boot: bytes) -> bool:
    return boot[:4] == b"DOS\0" and end_around_sum(boot[: K.BOOT_BYTES]) == MASK


def sectors(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / K.SECTOR).cast("long")


def assemble(boot: bytes, player: bytes, data: bytes, reserve_tail: int = 0) -> bytes:
    """A bootable image: boot block, player from sector 2 on, data from the next free sector on.

    The player's length goes into the boot block, the data's place and length into the player's header."""
    if len(boot) > K.BOOT_BYTES or len(player) < 16:
        raise ValueError("the boot block is too long, or the player too short")
    first = K.PLAYER_SECTOR + -(-len(player) // K.SECTOR)
    if first + -(-len(data) // K.SECTOR) > K.SECTORS - reserve_tail:
        raise ValueError("the data do not fit on the disk")
    boot = boot.ljust(K.BOOT_BYTES, b"\0")
    boot = finish_boot(boot[:8] + struct.pack(">I", len(player)) + boot[12:])
    player = player[:8] + struct.pack(">II", first * K.SECTOR, len(data)) + player[16:]
    image = bytearray(K.DISK_BYTES)
    for at, part in ((0, boot), (K.PLAYER_SECTOR * K.SECTOR, player), (first * K.SECTOR, data)):
        image[at : at + len(part)] = part
    return bytes(image)


def room(player: bytes, reserve_tail: int = 0) -> int:
    """Bytes of data that fit on a disk behind a player."""
    return (K.SECTORS - reserve_tail - K.PLAYER_SECTOR - -(-len(player) // K.SECTOR)) * K.SECTOR


def stream_on_disk(disks: DataFrame) -> DataFrame:
    """(disk_id, content) to the bitstream that the player's header points at."""
    at = K.PLAYER_SECTOR * K.SECTOR
    found = disks.withColumn("_at", be(F.col("content"), at + 8, 4)).withColumn("_len", be(F.col("content"), at + 12, 4))
    return found.select("disk_id", F.expr("substring(content, cast(_at as int) + 1, cast(_len as int))").alias("content"))


#: Big-endian fields of the information sector by its magic, in order from byte 4.
INFO = {
    "MEMR": "chip_free chip_largest slow_free slow_largest total player plane".split(),
    "FBDM": "planes fb_addr cop_addr used err1 err2".split(),
    "PLAY": "packets load_vsync bytes blk1 blk1_bytes blk2 blk2_bytes late max_late vbl vbl_expected fb0 fb1 max_cck max_cck_packet deltas entries err audio_irqs first_vbl first_line_cck last_vbl last_line_cck start_vbl audio_format period fill_sum fill_max copy_sum copy_max copies fb_crc0 fb_crc1".split(),
}


def info(disks: DataFrame, magic: str) -> DataFrame:
    """One row of fields for each disk whose last sector has the magic."""
    at = K.INFO_SECTOR * K.SECTOR
    good = disks.filter(F.substring("content", at + 1, 4) == F.lit(magic.encode()))
    out = good.select("disk_id", *(be(F.col("content"), at + 4 + 4 * i, 4).alias(n) for i, n in enumerate(INFO[magic])), F.substring("content", at + 137, 12).alias("_audio"))
    if magic != "PLAY":
        return out.drop("_audio")
    audio = F.substring("_audio", 1, 4) == F.lit(b"AUDC")
    return out.withColumn("audio_crc", F.when(audio, be(F.col("_audio"), 4, 4))).withColumn("audio_samples", F.when(audio, be(F.col("_audio"), 8, 4))).drop("_audio")


def timings(disks: DataFrame) -> DataFrame:
    """(disk_id, n, cck) of the 512 decode times."""
    at = K.TIMING_SECTOR * K.SECTOR
    table = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda n: F.conv(F.hex(F.substring("content", n * 4 + at + 1, F.lit(4))), 16, 10).cast("long"))
    return disks.select("disk_id", table.alias("all")).select("disk_id", F.posexplode("all").alias("n", "cck"))


def dump(disks: DataFrame) -> DataFrame:
    """(disk_id, framebuffer, copper) of still-frame dumps."""
    fields = info(disks, "FBDM").select("disk_id", "planes")
    return disks.join(fields, "disk_id").select("disk_id", F.expr(f"substring(content, {K.DUMP_SECTOR * K.SECTOR} + 1, cast(planes as int) * 5120)").alias("framebuffer"), F.substring("content", K.COPPER_SECTOR * K.SECTOR + 1, 8192).alias("copper"))


def wav(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono file of 8-bit samples."""
    data = (samples.astype("<i2") * 256).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def ppm(rgb: np.ndarray) -> bytes:
    return f"P6\n{rgb.shape[1]} {rgb.shape[0]}\n255\n".encode() + rgb.astype(np.uint8).tobytes()
