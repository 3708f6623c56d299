"""Fixed values of the format and of the measured cost model."""

WIDTH, HEIGHT, ROW_BYTES = 160, 128, 20
HEADER_BYTES, MAGIC, VERSIONS = 32, b"A5VP", (6, 7)
DELTA, REPEAT, DELTA_RLE = 0, 1, 2
HAS_PALETTE, COPY = 1, 2
NO_AUDIO, FIB4, PCM8, ADPCM = 0, 1, 2, 3

PAULA_HZ = 3_546_895.0
VBL_HZ = PAULA_HZ / (313 * 227)
FPS = VBL_HZ / 2
CPU_HZ = 7_093_790.0
CYCLES_PER_VBL = CPU_HZ / VBL_HZ
CCK_PER_LINE, LINES_PER_VBL = 227, 313

SECTOR, SECTORS, BOOT_BYTES, PLAYER_SECTOR = 512, 1760, 1024, 2
DISK_BYTES = SECTOR * SECTORS
TIMING_SECTOR, INFO_SECTOR, DUMP_SECTOR, COPPER_SECTOR = 1754, 1759, 1660, 1710
AUDIO_BUFFER = 512

#: Cycles of the decode cost model.
CYC_ROW_FEW_PLANES, CYC_ROW, CYC_COL = 900, 940, 19
CYC_BYTE, CYC_BYTE_5 = 36, 43
CYC_FULL_ROW, CYC_FULL_BYTE, CYC_FULL_BYTE_5 = 200, 40, 44
CYC_COPY, CYC_COPY_5 = 126, 130
CYC_FILL = {NO_AUDIO: 0, FIB4: 32_300, PCM8: 7_000, ADPCM: 59_000}
CYC_RLE_PACKET, CYC_RLE_ROW, CYC_RLE_PLANE, CYC_RLE_LITERAL, CYC_RLE_REPEAT, CYC_RLE_TOKEN = 150, 200, 40, 48, 18, 100

#: Fibonacci delta steps, by nibble.
FIB_STEPS = (-34, -21, -13, -8, -5, -3, -2, -1, 0, 1, 2, 3, 5, 8, 13, 21)
#: IMA ADPCM step sizes and index changes.
ADPCM_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
ADPCM_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)
#: Ordered dither thresholds.
BAYER_2, BAYER_4 = (0, 2, 3, 1), (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)
#: Oklab distance that counts as a wrong pixel; below NEAR_SAME two frames count as alike.
BAD_PIXEL, NEAR_SAME = 0.1, 0.008
