"""Token ids as raw binary shards with a minimal perfect hash index.

A shard is one file: a head, the ids of its documents one after another as little-endian unsigned integers (two bytes
each where the vocabulary allows, else four), the ids' owners in file order, and an index.  Shards follow one another
in ascending document id; a shard's place is written in the table of shards.  Layout, all numbers little-endian:

    head     8 bytes magic, u32 version, u32 bytes per id, u64 documents, u64 ids, u64 place of keys, u64 place of index
             (without numbers at the file's start, with them at its end)
    ids      raw payload
    keys     documents x (i64 key, u32 copy)
    index    u32 levels, u64 seed, u64 bits of each level; blocks of 64 bytes: u64 set bits before, 7 x u64 bits;
             then per slot: u32 fingerprint, u64 start, u32 ids

The index is a minimal perfect hash of (key, copy): level by level each key hashes to a bit; bits hit once are set and
their keys leave; the slot is the number of set bits before the key's bit.  A slot's fingerprint tells absent keys
(false matches: 2**-32).  A lookup in a closed shard reads its head, one block a level (1.6 levels on average), one slot
and the payload, whatever the size of the shard; only shards that are read through load their index.

Special tokens written in a text are ordinary text, as the vocabulary's own description has it; with
``special_tokens=True`` they are what the library makes of them by default.

Nulls and odd cases: a null or empty text has only its end id.  Rows that repeat an id are numbered as copies 0, 1, ...
in an order by hash and text, also where they fill several shards; equal rows (id and text) stand in one shard.  Rows
without id are written last, as copies of a key of their own.  An empty table gives no shards.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.work import partitions, shared_dir
from loamdex.llm.words import mix, slices, span_numbers, texts

MAGIC, VERSION = b"LOAMTOK1", 2
HEAD = struct.Struct("<8sIIQQQQ")
#: The key of rows without id, told from the id of the same value by the highest bit of its copies.
NO_ID, NO_ID_COPY = 2**63 - 1, 1 << 31
#: Bytes of text of a shard (and of the smallest one that is worth a task), and files that a worker keeps open.
SHARD_BYTES, LEAST_BYTES, OPEN = 256 << 20, 1 << 20, 64
#: Distinct pieces of text whose ids a worker keeps, about 40 bytes each.
CACHE = 2_000_000
_SHARDS = "shard int, file string, first_none boolean, first_key long, last_none boolean, last_key long, last_rows long, documents long, ids long"
_SLOT = np.dtype([("fingerprint", "<u4"), ("start", "<u8"), ("n", "<u4")])
_PIECE = np.dtype([("a", np.uint64), ("b", np.uint64), ("at", np.int64), ("n", np.int32)])
_KEY = np.dtype([("key", "<i8"), ("copy", "<u4")])



# -- minimal perfect hash ------------------------------------------------------------------------------------------


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(keys["key"].astype(np.uint64) + np.uint64(seed)) + keys["copy"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BLOCK_BITS = 7 * 64


class PerfectHash:
    """Maps n keys one to one to the slots 0 to n-1.

    levels: the bits of each; fetch(numbers) gives the blocks of these numbers, eight 64-bit words each.
    """

    def __init__(self, seed: int, levels: list[int], fetch) -> None:
        self.seed, self.levels, self.fetch = seed, levels, fetch
        self.first = np.concatenate([[0], np.cumsum(np.array(levels, np.int64) // BLOCK_BITS)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, seed: int = 1) -> PerfectHash:
        """keys must differ from one another. Each level takes about 6 of 10 keys that are left."""
        levels, blocks, left, before = [], [np.zeros((0, 8), np.uint64)], keys, 0
        while len(left):
            size = -(-2 * len(left) // BLOCK_BITS) * BLOCK_BITS
            at = (_hash(left, seed + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            own = np.zeros((size // BLOCK_BITS, 8), np.uint64)
            own[:, 1:] = np.packbits(alone, bitorder="little").view("<u8").reshape(-1, 7)
            counts = np.bitwise_count(own[:, 1:]).sum(1).astype(np.int64)
            own[:, 0] = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            levels.append(size)
            blocks.append(own)
            left = left[~alone[at]]
        index = cls(seed, levels, None)
        index.blocks = np.concatenate(blocks)
        index.fetch = index.blocks.__getitem__
        return index

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level has the key."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, size in enumerate(self.levels):
            if not len(open_):
                break
            at = (_hash(keys[open_], self.seed + n) % np.uint64(size)).astype(np.int64)
            block, within = self.fetch(self.first[n] + at // BLOCK_BITS), at % BLOCK_BITS
            which, bit = within >> 6, (within & 63).astype(np.uint64)
            word = block[np.arange(len(open_)), 1 + which]
            hit = (word >> bit & np.uint64(1)).astype(bool)
            earlier = (np.bitwise_count(block[:, 1:]) * (np.arange(7) < which[:, None])).sum(1)
            rank = block[:, 0].astype(np.int64) + earlier + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0x5BD1E995) >> np.uint64(32)).astype(np.uint32)


# -- shards --------------------------------------------------------------------------------------------------------


def open_path(uri: str):
    """(file system, path in it) for a Hadoop-style address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class ShardWriter:
    """Writes documents in order; the file appears under its name only when it is whole."""

    def __init__(self, uri: str, width: int) -> None:
        self.fs, self.path = open_path(uri)
        self.width, self.keys, self.copies, self.lengths = width, [], [], []
        self.at, self.temporary = HEAD.size, f"{self.path}.part-{np.random.default_rng().integers(2**63)}"
        self.fs.create_dir(self.path.rpartition("/")[0])
        self.out = self.fs.open_output_stream(self.temporary)
        # the head's counts are known at the end, so they are repeated in a tail of the same form
        self.out.write(HEAD.pack(MAGIC, VERSION, width, 0, 0, 0, 0))

    def add(self, key: int, copy: int, ids: bytes) -> None:
        self.keys.append(key)
        self.copies.append(copy)
        self.lengths.append(len(ids) // self.width)
        self.at += self.out.write(ids)

    def close(self) -> tuple[int, int]:
        keys = np.empty(len(self.keys), _KEY)
        keys["key"], keys["copy"] = self.keys, self.copies
        n = np.array(self.lengths, np.int64)
        starts = np.cumsum(n) - n
        place = self.at
        self.out.write(keys.tobytes())
        index = PerfectHash.build(keys)
        slots = np.empty(len(keys), _SLOT)
        at = index.slots(keys)
        slots["fingerprint"][at], slots["start"][at], slots["n"][at] = fingerprints(keys), starts, n
        self.out.write(struct.pack(f"<IQ{len(index.levels)}Q", len(index.levels), index.seed, *index.levels))
        self.out.write(index.blocks.astype("<u8").tobytes())
        self.out.write(slots.tobytes())
        self.out.write(HEAD.pack(MAGIC, VERSION, self.width, len(keys), int(n.sum()), place, place + keys.nbytes))
        self.out.close()
        from pyarrow import fs

        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:  # an earlier attempt of the same task
            self.fs.delete_file(self.path)
        self.fs.move(self.temporary, self.path)
        return len(keys), int(n.sum())


class Shard:
    """A written shard: keyed access by a few small reads; many keys load the index."""

    def __init__(self, uri: str) -> None:
        files, path = open_path(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        magic, version, self.width, self.documents, self.ids, self.place, self.index = HEAD.unpack(self.file.read_at(HEAD.size, size - HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is no shard of version {VERSION}")
        levels, seed = struct.unpack("<IQ", self.file.read_at(12, self.index))
        bits = list(struct.unpack(f"<{levels}Q", self.file.read_at(8 * levels, self.index + 12)))
        self.blocks_at = self.index + 12 + 8 * levels
        self.slots_at = self.blocks_at + 64 * (sum(bits) // BLOCK_BITS)
        self.loaded: tuple[np.ndarray, np.ndarray] | None = None
        self.hash = PerfectHash(seed, bits, self._blocks)

    def _blocks(self, numbers: np.ndarray) -> np.ndarray:
        if self.loaded:
            return self.loaded[0][numbers]
        data = b"".join(self.file.read_at(64, self.blocks_at + 64 * int(n)) for n in numbers)
        return np.frombuffer(data, "<u8").reshape(-1, 8)

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        if self.loaded:
            return self.loaded[1][numbers]
        return np.frombuffer(b"".join(self.file.read_at(_SLOT.itemsize, self.slots_at + _SLOT.itemsize * int(n)) for n in numbers), _SLOT)

    def load(self) -> None:
        """Read the whole index."""
        if not self.loaded:
            blocks = np.frombuffer(self.file.read_at(self.slots_at - self.blocks_at, self.blocks_at), "<u8").reshape(-1, 8)
            self.loaded = blocks, np.frombuffer(self.file.read_at(_SLOT.itemsize * self.documents, self.slots_at), _SLOT)

    def close(self) -> None:
        self.file.close()

    def keys(self) -> np.ndarray:
        """Keys and copies in file order."""
        return np.frombuffer(self.file.read_at(self.index - self.place, self.place), _KEY)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start (in ids, within the shard) and number of ids of each key; -1 where the shard doesn't hold it."""
        slot = self.hash.slots(keys)
        there = np.flatnonzero(slot >= 0)
        found = self._slots(slot[there])
        own = found["fingerprint"] == fingerprints(keys[there])
        start, n = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        start[there[own]], n[there[own]] = found["start"][own], found["n"][own]
        return start, n

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from a start, as unsigned 32-bit integers."""
        return np.frombuffer(self.file.read_at(n * self.width, HEAD.size + start * self.width), f"<u{self.width}").astype("<u4")


# -- encoding ------------------------------------------------------------------------------------------------------


# byte classes
_LETTER, _MARK, _DIGIT, _BLANK, _LINE = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[ord("'")] = 0  # an apostrophe may belong to the letters behind it
_KIND[32], _KIND[10] = _BLANK, _LINE
# bytes that begin a character which no reading of Unicode takes for white space
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_SOLID[0xC3:0xE0] = True
_SOLID[0xE4:0xEE] = True


def cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places where pieces begin that a byte-level vocabulary encodes independently of what is before them.

    A cut is: before a blank between two characters that are no white space; between a letter and a mark; before a
    single line end between such characters, and behind it.  Everything else stays together.  begins: rows' first bytes.
    """
    n = len(data)
    kind, solid = _KIND[data], _SOLID[data]
    later = np.flatnonzero((data & 0xC0) == 0x80)
    if len(later):  # a character's later bytes are as its first; letters of Latin-1 are letters
        lead = np.arange(n)
        lead[later] = 0
        lead = np.maximum.accumulate(lead)
        solid = solid[lead]
        latin = (data[lead] == 0xC3) & (data != 0x97) & (data != 0xB7)
        kind[latin] = _LETTER
    edge = np.ones(n + 1, bool)  # what is outside a row
    edge[:-1] = False
    edge[begins] = True
    inner = ~edge[1:-1]  # between places i and i + 1 of one row
    cut = np.zeros(n, bool)
    here, there = kind[:-1], kind[1:]
    cut[1:] = (here == _LETTER) & (there == _MARK)
    # a blank or line end alone: both its neighbours are solid and in the row
    alone = np.zeros(n, bool)
    alone[1:-1] = solid[:-2] & solid[2:] & inner[:-1] & inner[1:]
    cut |= alone & ((kind == _BLANK) | (kind == _LINE))
    cut[1:] |= (alone & (kind == _LINE))[:-1]
    cut[begins[begins < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes whole texts to packed ids with a byte-level vocabulary.

    Texts are cut where the vocabulary cuts in any case; each different piece is encoded once as long as the worker
    remembers it.  Where special tokens count, rows that hold one's string are encoded by the library as they are.
    """

    def __init__(self, path: str, width: int, end_id: int | None, special_tokens: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_tokens
        added = self.tokenizer.get_added_tokens_decoder().values()
        # strings that the library looks for before it cuts: special ones only where they count, others in any case
        self.whole = [t.content for t in added if special_tokens or not t.special]
        if max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1) > 256**width:
            raise ValueError(f"{width} bytes can't hold the ids of {path}")
        self.kind, self.end = f"<u{width}", [] if end_id is None else [end_id]
        self._forget()

    def _forget(self) -> None:
        # pieces by two numbers of 64 bits, sorted by the first; where their ids are in ``ids``, and how many
        self.known = np.zeros(0, _PIECE)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode new pieces; where their ids are, and how many."""
        at, n = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for lo in range(0, len(pieces), 500):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[lo : lo + 500]], add_special_tokens=False)]
            n[lo : lo + 500] = sizes = [len(ids) for ids in found]
            at[lo : lo + 500] = self.used + np.cumsum(sizes) - sizes
            flat = np.array([i for ids in found for i in ids], self.kind)
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), self.kind)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        return at, n

    def _look(self, wanted: np.ndarray, pieces) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of pieces are, and how many. wanted: their numbers; pieces(places) gives the bytes of some."""
        if len(self.known) + len(wanted) > CACHE:
            self._forget()
        at = np.minimum(np.searchsorted(self.known["a"], wanted["a"]), max(0, len(self.known) - 1))
        hit = np.zeros(len(wanted), bool)
        if len(self.known):
            hit = (self.known["a"][at] == wanted["a"]) & (self.known["b"][at] == wanted["b"])
        start, n = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        start[hit], n[hit] = self.known["at"][at[hit]], self.known["n"][at[hit]]
        new = np.flatnonzero(~hit)
        start[new], n[new] = self._encoded(pieces(new))
        fresh = wanted[new]
        fresh["at"], fresh["n"] = start[new], n[new]
        fresh = fresh[np.argsort(fresh["a"], kind="stable")]
        self.known = np.insert(self.known, np.searchsorted(self.known["a"], fresh["a"]), fresh)
        return start, n

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and how many each row has (the end id included)."""
        if self.whole:
            held = np.zeros(len(column), bool)
            for content in self.whole:
                held |= pc.fill_null(pc.match_substring(column, content), False).to_numpy(zero_copy_only=False)
            if held.any():
                return self._mixed(column, held)
        return self._plain(column)

    def _mixed(self, column: pa.Array, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold an added token, by the library; the others as always."""
        found, counts = [], []
        edges = np.concatenate([[0], np.flatnonzero(held[1:] != held[:-1]) + 1, [len(held)]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held[lo]:
                ids = [self.tokenizer.encode(t, add_special_tokens=False).ids + self.end for t in column.slice(lo, hi - lo).to_pylist()]
                found.append(np.array([i for x in ids for i in x], self.kind))
                counts.append(np.array([len(x) for x in ids], np.int64))
            else:
                ids, n = self._plain(column.slice(lo, hi - lo))
                found.append(ids)
                counts.append(n)
        return np.concatenate(found), np.concatenate(counts)

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = texts(column)
        rows = len(offsets) - 1
        starts = cuts(data, offsets[:-1]) if len(data) else np.zeros(0, np.int64)
        if not len(starts):
            return np.array(self.end * rows, self.kind), np.full(rows, len(self.end))
        whole, ends = data.tobytes(), np.append(starts[1:], len(data))
        wanted = np.zeros(len(starts), _PIECE)
        wanted["a"], wanted["b"] = span_numbers(data, starts), span_numbers(data, starts, 1)
        _, first, of = np.unique(wanted["a"], return_index=True, return_inverse=True)
        if (wanted["b"][first][of] != wanted["b"]).any():  # two pieces share a number of 64 bits
            _, first, of = np.unique(wanted[["a", "b"]], return_index=True, return_inverse=True)
        source, size = self._look(wanted[first], lambda places: [whole[a:b] for a, b in zip(starts[first[places]].tolist(), ends[first[places]].tolist(), strict=True)])
        size, source = size[of], source[of]
        row = np.searchsorted(offsets, starts, "right") - 1
        count = np.bincount(row, size, rows).astype(np.int64) + len(self.end)
        # where each piece's ids go: behind those before it and the end ids of the rows before its own
        target = np.cumsum(size) - size + row * len(self.end)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out = np.empty(int(count.sum()), self.kind)
        out[np.repeat(target, size) + within] = self.ids[np.repeat(source, size) + within]
        if self.end:
            out[np.cumsum(count) - 1] = self.end[0]
        return out, count


_encoders: dict[tuple, Encoder] = {}


def encoder_of(*options) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if options not in _encoders:
        _encoders[options] = Encoder(*options)
    return _encoders[options]


def _write(folder: str, width: int, options: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, encoder = TaskContext.get().partitionId(), None, None
        key, copy, first = None, 0, None
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                encoder = encoder or encoder_of(*options)
                writer = writer or ShardWriter(f"{folder}/shard-{shard:06d}.tok", width)
                ids, count = encoder.encode(batch.column(1))
                ends = np.cumsum(count)
                for own, a, b in zip(batch.column(0).to_pylist(), (ends - count).tolist(), ends.tolist(), strict=True):
                    copy = copy + 1 if first is not None and own == key else 0
                    key = own
                    first = first or (own,)
                    writer.add(NO_ID if own is None else own, copy | (NO_ID_COPY if own is None else 0), ids[a:b].tobytes())
        if writer:
            documents, ids = writer.close()
            one = {"shard": shard, "file": f"{folder}/shard-{shard:06d}.tok", "first_none": first[0] is None, "first_key": first[0], "last_none": key is None, "last_key": key, "last_rows": copy + 1, "documents": documents, "ids": ids}
            kinds = [pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one.values(), kinds, strict=True)], names=list(one))

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, *, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = 2, end_id: int | None = 2, special_tokens: bool = False, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Encode whole texts and write shards in ascending id; the table of shards (a row a file).

    ``folder`` must be reachable by all executors; the default is a new one in the shared folder, which goes when the
    driver ends.  ``width`` is 2 for vocabularies up to 65,536 ids, else 4.  A shard holds about ``shard_bytes`` of text;
    small tables have smaller ones, as many as a shuffle has parts.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    text = F.col(text_col).cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, min(partitions(spark), math.ceil(total / LEAST_BYTES)), math.ceil(total / shard_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("key"), text.alias("text"))
    # ids are split among shards where one has many texts
    order = [F.col("key").isNull(), F.col("key"), F.xxhash64("text")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")
    rows.mapInArrow(_write(folder, width, (tokenizer, width, end_id, special_tokens)), _SHARDS).write.parquet(f"{folder}/shards")
    return spark.read.schema(_SHARDS).parquet(f"{folder}/shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, first, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            shard = Shard(file)
            shard.load()
            keys, head = shard.keys(), None
            for lo in range(0, len(keys), 256):
                part = keys[lo : lo + 256]
                start, n = shard.find(part)
                if (start < 0).any():
                    raise ValueError(f"{file}: a key is not in the index")
                low = int(start.min())
                ids = shard.read(low, int((start + n).max()) - low)
                crc = [zlib.crc32(ids[s : s + k].tobytes()) for s, k in zip(start - low, n, strict=True)]
                null, copy = part["copy"] >= NO_ID_COPY, (part["copy"] & np.uint32(NO_ID_COPY - 1)).astype(np.int64)
                head = head or (part["key"][0], null[0])
                copy += copies * ((part["key"] == head[0]) & (null == head[1]))  # copies of the first key in the shards before
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["key"], pa.int64(), mask=null), pa.array(copy), pa.array(start + first), pa.array(n), pa.array(crc, pa.int64())], names=["key", "copy", "start", "n_tokens", "ids_crc32"]
                )
            shard.close()


def read_tokens(shards: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per document, read back through the index: id, copy, start (ids of all documents before), n_tokens, ids_crc32."""
    # one row a shard: sums over these are small however many documents there are
    every = Window.orderBy("shard")
    before = F.coalesce(F.sum("ids").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    so_far = F.sum("last_rows").over(Window.partitionBy("last_none", "last_key").orderBy("shard"))
    placed = shards.withColumn("first", before.cast("long")).withColumn("so_far", so_far)
    goes_on = F.lag("last_key").over(every).eqNullSafe(F.col("first_key")) & (F.lag("last_none").over(every) == F.col("first_none"))
    placed = placed.withColumn("copies", F.when(goes_on, F.lag("so_far").over(every)).otherwise(0).cast("long"))
    placed = placed.select("file", "first", "copies").repartition(partitions(shards.sparkSession), "file").select("file", "first", "copies")
    return placed.mapInArrow(_read, "key long, copy long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", id_col)


def lookup(shards: DataFrame, keys: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Ids of wanted documents (copy 0): id, ids.  Keys that no shard holds give no row.

    Two numbers a shard go along to the tasks; each key is found by a few small reads of one shard, or through its
    loaded index where a batch asks for many keys of it, and nothing is shuffled.
    """
    table = shards.where("not first_none").select("first_key", F.when(F.col("last_none"), F.lit(NO_ID)).otherwise(F.col("last_key")).alias("last_key"), "shard", "file").orderBy("shard").collect()
    low, high, number = (np.array([r[i] for r in table], np.int64) for i in range(3))
    folder = table[0].file.rpartition("/")[0] if table else ""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: OrderedDict[int, Shard] = OrderedDict()
        for batch in batches:
            wanted = np.zeros(batch.num_rows, _KEY)
            wanted["key"] = batch.column(0).to_numpy()
            # the last shard that begins before the key, if it reaches it; else one that begins with it
            home = np.searchsorted(low, wanted["key"], "left") - 1
            home[(home < 0) | (len(high) == 0 or high[np.maximum(home, 0)] < wanted["key"])] += 1
            home[home >= len(low)] = -1
            for f in np.unique(home[home >= 0]).tolist():
                if f not in opened:
                    opened[f] = Shard(f"{folder}/shard-{number[f]:06d}.tok")
                    if len(opened) > OPEN:
                        opened.popitem(last=False)[1].close()
                opened.move_to_end(f)
                shard, own = opened[f], wanted[home == f]
                if 32 * len(own) > shard.documents:
                    shard.load()
                start, n = shard.find(own)
                hit = np.flatnonzero(start >= 0)
                ids = [shard.read(int(start[i]), int(n[i])).astype(np.int64) for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(own["key"][hit], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["key", "ids"])

    wanted = keys.select(F.col(id_col).cast("long").alias("key")).where("key is not null")
    return wanted.mapInArrow(find, "key long, ids array<long>").withColumnRenamed("key", id_col)
