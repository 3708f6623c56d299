"""Harmonic packing of token streams into sequences of a fixed capacity.

Class k holds the lengths in (capacity / (k + 1), capacity / k], and a bin of class k takes k documents; lengths
of capacity / LAST and less are one class, whose bins take what fits. A document is cut in two cases only: where
it is longer than the capacity (its full sequences stand alone, its tail is dealt to a class), and as a filler:
once a bin has its k documents, the next one of that class gives its first tokens for the room left, and its
rest is dealt to the class of its own length. So every closed bin is full.

Every worker fills its bins on its own. What is left in its open bins (less than a sequence a class) meets that
of FAN neighbouring workers, round by round, until one group is left, which has FAN times LAST open bins at most;
there they are laid end to end, and only the last sequence of all is padded.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import release, spans, texts, tidy, written
from ._words import buffers

CAPACITY = 4096
#: The class of all lengths of capacity / LAST and less.
LAST = 64
END_ID = 2
FAN = 32
#: Bytes of text whose words are looked up at once; longer texts are encoded block by block.
CHUNK = 4 << 20
#: Bytes of words and ids that a worker remembers in one generation; it keeps two.
CACHE_BYTES = 48 << 20
#: Bytes of an entry besides its word and ids.
ENTRY = 180
VOCABULARY = "word_bpe_49k.json"
#: Lower-case words of these letters are composed already and one piece; their lower case has one character for each.
LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+")
#: Byte-level alphabet: bytes that are not printable as Latin-1 characters follow from U+0100 on, in order.
_ODD = [*range(33), *range(127, 161), 173]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(_ODD)}

PIECE = "run long, {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids of texts, word by word: the vocabulary never joins characters across white space.

    Letters A-Z count as a-z, and a comma or full stop after a letter stands alone, as the vocabulary's
    own rules have it; so words are remembered without them. Words are remembered for two generations: when the
    present one is full it becomes the old one, and a word that is met again moves over. So common words stay, and
    rare ones are forgotten."""

    def __init__(self, path: str, chunk: int | None = None, cache_bytes: int | None = None):
        import tokenizers

        self.chunk, self.cache_bytes = chunk, cache_bytes
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.bare = tokenizers.Tokenizer(self.tokenizer.model)  # for words that need neither normalising nor splitting
        self.bare.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        del vocabulary
        release()

    def _plain(self, words: list[str]) -> list[bytes] | None:
        """Ids of words of byte-level letters: each ends in its one piece that ends a word."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cut = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)] if len(cut) == len(words) + 1 else None

    def _learn(self, words: list[bytes]) -> None:
        known, old, fresh, split, new = self.known, self.old, {}, {}, {}
        for w in words:
            ids = old.get(w)
            if ids is not None:
                fresh[w] = ids
                continue
            head = w.rstrip(b".,!?;:")
            if head and len(head) < len(w) and (97 <= head[-1] <= 122 or head[-1] > 127 and head.decode().lower()[-1].isalpha()):
                split[w] = head, w[len(head) :]
                new[split[w][1]] = None
                w = head
            new[w] = None
        plain, bare, rest = [], [], []
        for w in new:
            if w in fresh or w in known:
                continue
            if w.isalpha():
                plain.append(w)
                bare.append(w.decode())
            elif w[:1] > b"@" and LATIN.fullmatch(text := w.decode()):
                plain.append(w)
                bare.append(text.lower().encode().decode("latin-1").translate(BYTE_LEVEL))
            else:
                rest.append(w)
        found = self._plain(bare) if plain else []
        if found is None:
            rest, found = rest + plain, []
        else:
            fresh.update(zip(plain, found, strict=True))
        for w, ids in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            fresh[w] = np.array(ids.ids, np.uint32).tobytes()
        known.update(fresh)
        for w, (head, tail) in split.items():
            fresh[w] = known[w] = known[head] + known[tail]
        self.size += ENTRY * len(fresh) + sum(map(len, fresh)) + sum(map(len, fresh.values()))

    def _chunk(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lower = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        words = pc.ascii_split_whitespace(lower)
        coded = words.values.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        known = self.known
        missing = [w for w in distinct if w not in known]
        if missing:
            self._learn(missing)
        raw = list(map(known.__getitem__, distinct))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        ids, code = np.frombuffer(b"".join(raw), np.uint32), coded.indices.to_numpy()
        each = size[code]
        at = np.append(0, np.cumsum(each))  # where each word's ids begin
        shift = (np.cumsum(size) - size)[code] - at[:-1]
        out = ids[np.arange(at[-1]) + np.repeat(shift, each)]
        if self.size > (self.cache_bytes or CACHE_BYTES):
            self.known, self.old, self.size = {}, known, 0
        return out, at[words.offsets.to_numpy() - words.offsets[0].as_py()]

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text. A text longer than CHUNK is cut at white space into blocks."""
        out, chunk = [], self.chunk or CHUNK
        for a, b in spans(np.diff(buffers(column)[1]), chunk):
            part = column.slice(a, b - a)
            if b == a + 1 and (text := part[0].as_buffer().to_pybytes()) and len(text) > chunk:
                blocks, x = [], 0
                while x < len(text):
                    y = x + chunk
                    while y < len(text) and text[y] not in b" \t\n\x0b\x0c\r":
                        y += 1
                    blocks.append(self._chunk(pa.array([text[x:y].decode()], pa.large_string()))[0])
                    x = y
                out.append(np.concatenate(blocks))
                continue
            ids, at = self._chunk(part)
            out += [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out


def encoder(path: str, chunk: int | None = None, cache_bytes: int | None = None) -> Encoder:
    """One encoder a worker process, file and sizes."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_planeflow_encoders", {})
    key = path, chunk, cache_bytes
    if key not in held:
        held[key] = Encoder(*key)
    return held[key]


class Bins:
    """Open bins, one a class. A piece is (id, doc_tokens, raw, base, start, stop): raw has the ids from base on."""

    def __init__(self, capacity: int, run: int, first_sequence: int):
        self.capacity, self.run, self.next = capacity, run, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.tokens: dict[int, int] = {}
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, total, raw, base, start, stop in pieces:
            crc = zlib.crc32(memoryview(raw)[4 * (start - base) : 4 * (stop - base)])
            self.done.append((self.run, key, start, stop - start, crc, total, self.next, offset, None))
            offset += stop - start
        self.next += 1

    def add(self, key, total: int, raw: bytes, base: int, start: int, stop: int) -> None:
        c = self.capacity
        while start < stop:
            n = stop - start
            if n >= c:
                self._close([(key, total, raw, base, start, start + c)])
                start += c
                continue
            k = min(c // n, LAST)
            own, held = self.open.setdefault(k, []), self.tokens.get(k, 0)
            take = min(n, c - held)  # less than n for a filler only
            own.append((key, total, raw[4 * (start - base) : 4 * (start - base + take)], start, start, start + take))
            start += take
            self.tokens[k] = held + take
            if held + take == c:
                self._close(own)
                del self.open[k], self.tokens[k]

    def finish(self) -> None:
        """Lay what is open end to end."""
        pieces, held = [], 0
        for own in (self.open[k] for k in sorted(self.open)):
            for key, total, raw, base, start, stop in own:
                while start < stop:
                    take = min(stop - start, self.capacity - held)
                    pieces.append((key, total, raw, base, start, start + take))
                    start, held = start + take, held + take
                    if held == self.capacity:
                        self._close(pieces)
                        pieces, held = [], 0
        if pieces:
            self._close(pieces)
        self.open, self.tokens = {}, {}

    def rest(self) -> list[tuple]:
        """The pieces of open bins, with their ids and without a sequence."""
        return [(self.run, key, start, stop - start, None, total, None, None, raw) for own in self.open.values() for key, total, raw, _, start, stop in own]


def _schema(id_type: pa.DataType) -> pa.Schema:
    long = pa.int64()
    return pa.schema([("run", long), ("id", id_type), ("start", long), ("length", long), ("ids_crc32", long), ("doc_tokens", long), ("sequence_id", long), ("offset", long), ("ids", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _fill(path: str, capacity: int, end_id: int, chunk: int | None = None, cache_bytes: int | None = None):
    def fill(batches):
        from pyspark import TaskContext

        release()  # what earlier stages left in this worker
        run = TaskContext.get().partitionId()
        bins, coder, schema = Bins(capacity, run, run << 32), encoder(path, chunk, cache_bytes), None
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            schema = schema or _schema(batch.schema.field(0).type)
            column, keys = texts(batch.column(1)), batch.column(0).to_pylist()
            for a, b in spans(np.diff(buffers(column)[1]), chunk or CHUNK):
                for key, ids in zip(keys[a:b], coder.ids(column.slice(a, b - a)), strict=True):
                    raw = ids.tobytes() + end
                    bins.add(key, len(raw) // 4, raw, 0, 0, len(raw) // 4)
                yield _table(bins.done, schema)
                bins.done = []
        if schema:
            yield _table(bins.rest(), schema)

    return fill


def _meet(level: int, capacity: int, last: bool):
    def meet(key, table):
        group = key[0].as_py()
        bins = Bins(capacity, group, level << 58 | group << 32)
        columns = (table.column(c).to_pylist() for c in ("run", "length", "id", "start", "doc_tokens", "ids"))
        for _, n, of, start, total, ids in sorted(zip(*columns, strict=True), key=lambda r: (r[0], -r[1], r[5], r[3])):
            bins.add(of, total, ids, start, start, start + n)
        if last:
            bins.finish()
        return pa.Table.from_batches([_table(bins.done + bins.rest(), table.schema)])

    return meet


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, chunk: int | None = None, cache_bytes: int | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows with equal or null identifiers are packed one by one,
    each with its own pieces. Every id lies in one piece; pieces fill a sequence gaplessly from 0, and all
    sequences but one are full. An empty table gives no rows. Which document is cut as a filler depends on how
    the input is partitioned. chunk and cache_bytes (CHUNK and CACHE_BYTES where unset) trade a worker's memory for
    time; pieces don't depend on them."""
    if capacity < LAST:
        raise ValueError(f"capacity is {LAST} at least")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECE.format(id=f"id {rows.schema['id'].dataType.simpleString()}")
    first = written(rows.mapInArrow(tidy(_fill(vocabulary or vocabulary_path(), capacity, end_id, chunk, cache_bytes)), schema), "pieces")
    done, rest, level, last = [first.filter("sequence_id is not null")], first.filter("sequence_id is null"), 0, False
    while not last:
        level, runs = level + 1, (rest.agg(F.max("run")).first()[0] or 0) + 1
        last = runs <= FAN
        met = written(rest.groupBy(F.expr(f"run div {FAN}").alias("group")).applyInArrow(_meet(level, capacity, last), schema), "pieces")
        done.append(met.filter("sequence_id is not null"))
        rest = met.filter("sequence_id is null")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("run", "ids")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
