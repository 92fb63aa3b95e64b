"""Token ids of a corpus in shards, each one file with a wavelet matrix.

A wavelet matrix keeps one bit-plane per bit of the ids. Each plane is the ids' bits at that level after a stable
partition by the bits above, cut into blocks that are compressed on their own and counted in a rank directory. One
file thus answers: the token at a position, how often a token occurs before a position, and where it occurs.

`write_shards` stores documents in ascending id order, `read_documents` gives them back, `token_counts` and
`occurrences` ask for tokens.

Defined cases: a null text counts as empty, and an empty document holds the end id alone; null ids come first;
rows with the same id are ordered by a hash of their text, and repeated rows are all stored; a document of any length
stays whole in one shard; an empty table gives no shards; columns other than `doc_id` and `text` are not looked at.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartflow.llm.common import Memo, materialize, pieces, ship_package, text_of

MODEL = "byte_bpe_50k.json"
END_ID = 0
SHARD_TOKENS = 4_000_000

MAGIC = b"WAVETOK1"
BLOCK_BITS = 1 << 16


class WaveletMatrix:
    """Rank, select and access over ids. `plane(level, block)` gives a block's bytes; blocks are read when needed."""

    def __init__(self, size: int, bits: int, zeros: list[int], ones: list[np.ndarray], plane):
        self.size, self.bits, self.zeros, self.ones = size, bits, zeros, ones
        self.plane = lru_cache(maxsize=4 * bits)(plane)

    @staticmethod
    def planes(ids: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """The bits of each level from the highest, and how many of them are zero."""
        bits = max(1, int(ids.max()).bit_length()) if ids.size else 1
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = ids & ids.dtype.type(1 << level) != 0
            low, high = ids[~one], ids[one]
            yield np.packbits(one), low.size
            ids = np.concatenate((low, high))

    def bit(self, level: int, at: int) -> int:
        block, inside = divmod(at, BLOCK_BITS)
        return self.plane(level, block)[inside >> 3] >> (7 - (inside & 7)) & 1

    def rank(self, level: int, at: int) -> int:
        """Ones of a plane before `at`."""
        block, inside = divmod(at, BLOCK_BITS)
        before = int(self.ones[level][block])
        if not inside:
            return before
        raw = np.frombuffer(self.plane(level, block), np.uint8)
        rest = int(raw[inside >> 3]) >> (8 - (inside & 7)) if inside & 7 else 0
        return before + int(np.bitwise_count(raw[: inside >> 3]).sum()) + rest.bit_count()

    def select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the `nth` (from 0, ascending) zeros or ones of a plane."""
        starts = np.arange(len(self.ones[level]), dtype=np.int64) * BLOCK_BITS
        before = self.ones[level] if bit else starts - self.ones[level]
        blocks = np.searchsorted(before[:-1], nth, side="right") - 1
        out = np.empty(len(nth), np.int64)
        for block in np.unique(blocks):
            raw = np.unpackbits(np.frombuffer(self.plane(level, int(block)), np.uint8))
            places = np.flatnonzero(raw == bit)
            here = blocks == block
            out[here] = starts[block] + places[nth[here] - before[block]]
        return out

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.bits):
            one = self.bit(level, at)
            ones = self.rank(level, at)
            at = self.zeros[level] + ones if one else at - ones
            value = value << 1 | one
        return value

    def interval(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token before `end` stand on the last level."""
        if token >> self.bits:
            return 0, 0
        low, high = 0, end
        for level in range(self.bits):
            ones = self.rank(level, low), self.rank(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + ones[0], self.zeros[level] + ones[1]
            else:
                low, high = low - ones[0], high - ones[1]
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        low, high = self.interval(token, self.size if end is None else end)
        return high - low

    def positions(self, token: int) -> np.ndarray:
        """Every position of a token, ascending."""
        at = np.arange(*self.interval(token, self.size), dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - level) & 1:
                at = self.select(level, 1, at - self.zeros[level])
            else:
                at = self.select(level, 0, at)
        return at

    def ids(self) -> np.ndarray:
        """All ids, put together from the lowest plane upwards."""
        values = np.zeros(self.size, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            blocks = range(-(-self.size // BLOCK_BITS))
            raw = b"".join(self.plane(level, block) for block in blocks)
            one = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.size).view(bool)
            above = np.empty_like(values)
            above[~one] = values[: self.zeros[level]]
            above[one] = values[self.zeros[level] :] | values.dtype.type(1 << (self.bits - 1 - level))
            values = above
        return values.astype("<u4", copy=False)


def pack_shard(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """One file: magic, header, document table, then per plane its rank directory and compressed blocks."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([x is not None for x in doc_ids], bool)
    frames = [pack(np.array([x or 0 for x in doc_ids], "<i8").tobytes()), pack(known.tobytes()), pack(ends.astype("<u8").tobytes())]
    zeros, step = [], BLOCK_BITS // 8
    for plane, low in WaveletMatrix.planes(ids):
        zeros.append(low)
        blocks = [plane[i : i + step] for i in range(0, plane.size, step)]
        counts = np.cumsum([0, *(int(np.bitwise_count(b).sum()) for b in blocks)])
        frames.append(pack(counts.astype("<u8").tobytes()))
        frames += [pack(b.tobytes()) for b in blocks]
    header = json.dumps({"size": int(ids.size), "docs": len(doc_ids), "zeros": zeros, "frames": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *frames])


class Shard:
    """A file of `pack_shard`, opened for random access: `source` is seekable, only asked-for blocks are read."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        if source.read(8) != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(source.read(4), "little")
        header = json.loads(source.read(size))
        self.starts = np.concatenate(([0], np.cumsum(header["frames"]))) + 12 + size
        known = np.frombuffer(self.frame(1), bool)
        self.doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(self.frame(0), "<i8"), known, strict=True)]
        self.ends = np.frombuffer(self.frame(2), "<u8").astype(np.int64)
        blocks = -(-header["size"] // BLOCK_BITS)
        first = [3 + level * (blocks + 1) for level in range(len(header["zeros"]))]
        ones = [np.frombuffer(self.frame(f), "<u8").astype(np.int64) for f in first]
        self.matrix = WaveletMatrix(header["size"], len(first), header["zeros"], ones, lambda level, block: self.frame(first[level] + 1 + block))

    def frame(self, number: int) -> bytes:
        self.source.seek(int(self.starts[number]))
        return self.unpack(self.source.read(int(self.starts[number + 1] - self.starts[number])))


class Tokenizer:
    """The library's ids of whole texts, with the ids of recurring parts remembered.

    The vocabulary's pattern starts a new pre-token at each space before a visible character, so a text's ids are
    those of its units, and a unit's those of its pre-tokens. Texts with an added token's string go to the library
    as a whole, and so do units with characters whose class may differ between versions of Unicode.
    """

    SETTLED = "\u0250"  # below it, letters and digits are the same in all versions

    def __init__(self, path: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.start = re.compile(r" (?=\S)")
        self.pretokens = regex.compile(public_tokenizers.PATTERN)
        self.units = Memo(lambda unit: self.encode_whole(" " + unit), 250_000)  # by the text behind the space
        self.parts = Memo(self.encode_whole)

    def encode_whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_units(self, units: list[str]) -> list[bytes]:
        cut = [self.pretokens.findall(u) if u and max(u) < self.SETTLED else [u] for u in units]
        parts = self.parts
        new = list(set().union(*cut) - parts.keys() - parts.old.keys())
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            for part, got in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                parts[part] = array("I", got.ids).tobytes()
        out = [b"".join([parts[x] for x in c]) for c in cut]
        parts.forget(new)
        parts.trim()
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        units, firsts, rests = self.units, [], []
        for text in texts:
            whole = self.added and self.added.search(text)
            first, *rest = [text] if whole else self.start.split(text)
            firsts.append(None if whole else first)
            rests.append(rest)
        new = list(set().union(*rests) - units.keys() - units.old.keys())
        units.update(zip(new, self.encode_units([" " + u for u in new]), strict=True))
        start = iter(self.encode_units([f for f in firsts if f is not None]))
        look = units.__getitem__
        heads = [self.encode_whole(t) if f is None else next(start) for t, f in zip(texts, firsts, strict=True)]
        out = [head + b"".join(map(look, rest)) for head, rest in zip(heads, rests, strict=True)]
        units.forget(new)
        units.trim()
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer(path)


def open_folder(folder: str):
    """The file system of a shared folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


MANIFEST = "part int, shard int, file string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def write_shards(
    docs: DataFrame, folder: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """Write the shards and return their table: part, shard, file, n_docs, n_tokens, n_bytes, start.

    One range shuffle by id; a task then encodes its range and keeps at most one shard in memory. File names are
    new for every attempt, and the table is stored by Spark's committer, so it names the files of successful attempts
    only. `start` sums the tokens of earlier shards: within a task's range, and over one row per task.
    """
    path = path or public_tokenizers.path(MODEL)
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        library, part = tokenizer(path), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        held, shard = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, shard
            ids = np.frombuffer(b"".join(parts), "<u4")
            ends = np.cumsum([len(x) // 4 for x in parts])
            content = pack_shard(ids, doc_ids, ends)
            name = f"shard-{part:06d}-{shard:04d}-{uuid.uuid4().hex}.wm"
            system, base = open_folder(folder)
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/{name}") as target:
                target.write(content)
            row = [part], [shard], [name], [len(doc_ids)], [ids.size], [len(content)]
            doc_ids.clear()
            parts.clear()
            held, shard = 0, shard + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3), strict=True)],
                names=["part", "shard", "file", "n_docs", "n_tokens", "n_bytes"],
            )

        for batch in batches:
            for piece in pieces(batch):
                rows = piece.to_pydict()
                for doc_id, ids in zip(rows["doc_id"], library.encode_all(rows["text"]), strict=True):
                    doc_ids.append(doc_id)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= shard_tokens:
                        yield flush()
        if parts:
            yield flush()

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    written = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST)
    stored = materialize(written, "wavelet-manifest")
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    ahead = F.coalesce(F.sum("of_part").over(before(Window.orderBy("part"))), F.lit(0))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    shifted = stored.withColumn("inside", inside).join(parts.select("part", ahead.alias("ahead")), "part")
    return shifted.select(*stored.columns, (F.col("ahead") + F.col("inside")).cast("bigint").alias("start"))


def each_shard(manifest: DataFrame, folder: str, use, schema: str) -> DataFrame:
    """Open every shard of the table in a task of its own and collect what `use(shard, start)` yields as batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with system.open_input_file(f"{base}/{name}") as source:
                    yield from use(Shard(source), start)

    ship_package(manifest.sparkSession)
    rows = manifest.select("file", "start")
    return rows.repartition(max(1, manifest.count()), "file").mapInArrow(run, schema)


def read_documents(manifest: DataFrame, folder: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids (little-endian, 32 bits), decoded from the files."""

    def use(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        ids, low, starts = shard.matrix.ids(), 0, np.concatenate(([0], shard.ends[:-1]))
        step = 2_000
        for low in range(0, len(shard.doc_ids), step):
            cut = slice(low, low + step)
            packed = [ids[a:b].tobytes() for a, b in zip(starts[cut], shard.ends[cut], strict=True)]
            columns = {
                "doc_id": pa.array(shard.doc_ids[cut], pa.int64()),
                "start": pa.array(starts[cut] + start, pa.int64()),
                "n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in packed], pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(packed, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return each_shard(manifest, folder, use, schema)


def token_counts(manifest: DataFrame, folder: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each asked token occurs, from rank queries on every shard."""

    def use(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([shard.matrix.count(t) for t in tokens], pa.int64())})

    return each_shard(manifest, folder, use, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(manifest: DataFrame, folder: str, token: int) -> DataFrame:
    """doc_id, position (in the whole corpus), offset (in the document) of every occurrence of a token."""

    def use(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        at = shard.matrix.positions(token)
        which = np.searchsorted(shard.ends, at, side="right")
        first = np.concatenate(([0], shard.ends[:-1]))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([shard.doc_ids[i] for i in which], pa.int64()),
                "position": pa.array(at + start, pa.int64()),
                "offset": pa.array(at - first[which], pa.int64()),
            }
        )

    return each_shard(manifest, folder, use, "doc_id bigint, position bigint, offset bigint")


def open_bytes(content: bytes) -> Shard:
    return Shard(io.BytesIO(content))
