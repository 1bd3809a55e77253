"""Token-id output: bit-plane shuffled blocks, each plane compressed with zstandard, with a chunk index.

Documents are put into ascending order of their id by a range partition; each partition is a shard.  A shard's ids are
cut into blocks of ``block`` ids.  A block is transposed into 32 bit planes (or 4 byte planes), so that the high, nearly
constant bits lie together, and each plane is compressed on its own.  A chunk row holds the planes and, for each document
that it touches, the document's place in the shard and how many of the chunk's ids are its own.  The index repeats all
but the planes.  Rows go through Spark's writer, so a lost task leaves no half-written file and any store works.

Null texts count as empty; each document, also an empty one, ends with ``end_id``.  Rows with equal ids keep one place
each, their order among one another is open; a null id comes first.  No documents give an empty table.  Only the id and
text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import text as T

CHUNKS = "shard int, chunk int, first long, n_ids int, plane_bytes array<int>, planes binary, docs array<struct<doc_id:{id},seq:long,part:int,len:int,n_tokens:long,at:long>>"
_CODE = np.zeros(256, np.uint8)  # 1 ASCII white space, 2 ASCII letter or digit, 3 other ASCII, 0 part of a longer character
_CODE[:128] = 3
_CODE[list(T.BLANKS)] = 1
_CODE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
_KNOWN, _POOL = 800_000, 6_000_000


def pieces(texts: T.Texts) -> T.Words:
    """Cuts where byte-level BPE's own splitting always cuts: before a lone white-space byte, after a lone one that is no
    blank, and between an ASCII letter or digit and ASCII punctuation.  A text that may hold white space beyond ASCII, a
    control separator or a special token stays whole."""
    data, offsets = texts.data, texts.offsets
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        none = np.empty(0, np.int64)
        return T.Words(data, none, none, np.zeros(len(offsets), np.int64))
    code = _CODE[data]
    opens = np.zeros(len(data) + 1, bool)
    white = code == 1
    lone = np.zeros(len(data), bool)
    lone[1:-1] = white[1:-1] & ~white[:-2] & ~white[2:]
    lone[offsets[full]] = lone[offsets[full + 1] - 1] = False
    opens[:-1] = lone
    opens[1:] |= lone & (data != 0x20)
    opens[1:-1] |= (code[:-1] == 2) & (code[1:] == 3)
    pair = data[:-1].astype(np.uint16) << 8 | data[1:]
    odd = np.flatnonzero(((data >= 0xE1) & (data <= 0xE3)) | ((data >= 0x1C) & (data <= 0x1F)))
    odd = np.concatenate([odd, np.flatnonzero((pair == 0xC285) | (pair == 0xC2A0) | (pair == 0x3C7C))])
    for r in np.unique(np.searchsorted(offsets, odd, side="right") - 1).tolist():
        opens[offsets[r]:offsets[r + 1]] = False
    opens[offsets[full]] = True
    starts = np.flatnonzero(opens[:-1])
    return T.Words(data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets))


class Encoder:
    """Ids of whole texts.  The library encodes each new piece once; pieces seen before are looked up by 64-bit hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.of = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.shown = "".join(chr(b if b in plain else next(rest)) for b in range(256))  # how byte-level BPE shows each byte
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def _encode(self, raw: list[bytes]) -> list[list[int]]:
        """A blank and letters are one unit of the vocabulary's merges; anything else takes the whole way."""
        texts = [r.decode() for r in raw]
        merge, shown = self.of.model.tokenize, self.shown
        unit = [t[t[:1] == " ":].isalpha() for t in texts]
        rest = iter(self.of.encode_batch_fast([t for t, u in zip(texts, unit) if not u], add_special_tokens=False))
        return [[k.id for k in merge(r.decode("latin-1").translate(shown))] if u else next(rest).ids for r, u in zip(raw, unit)]

    def __call__(self, texts: T.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and how many each text has."""
        cut = pieces(texts)
        if not len(cut):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.known) > _KNOWN or self.used > _POOL:
            self.forget()
        unique, sample, which = np.unique(cut.keys(), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != unique[inside]
        if new.any():
            made = self._encode([cut.get(i) for i in sample[new].tolist()])
            n = np.fromiter(map(len, made), np.int64, len(made))
            while self.used + n.sum() > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.used:self.used + n.sum()] = np.fromiter((i for m in made for i in m), np.uint32, n.sum())
            self.at = np.insert(self.at, place[new], self.used + np.cumsum(n) - n)
            self.n = np.insert(self.n, place[new], n)
            self.known = np.insert(self.known, place[new], unique[new])
            self.used += int(n.sum())
            place = np.searchsorted(self.known, unique)
        n = self.n[place][which]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[place][which] - ends + n, n) + np.arange(ends[-1])]
        return ids, T.sums(n, cut.first)


_ENCODERS: dict[str, Encoder] = {}  # of this Python worker, which serves many tasks


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def shuffle(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a block of little-endian unsigned ids: plane 0 is the lowest bit (or byte)."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(4)]
    planes = []
    for k in range(4):
        column = np.ascontiguousarray(octets[:, k])
        planes += [np.packbits(column & np.uint8(1 << b), bitorder="little").tobytes() if column.any() else bytes(-(-len(ids) // 8)) for b in range(8)]
    return planes


def unshuffle(planes: list[bytes], n: int) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if len(planes) == 4:
            octets[:, k] = np.frombuffer(plane, np.uint8)
        elif plane.strip(b"\0"):
            octets[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << np.uint8(k % 8)
    return octets.reshape(-1).view("<u4")


def _writer(path: str, end_id: int, block: int, bits: bool, schema: pa.Schema):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = encoder(path), zstandard.ZstdCompressor(level=1)
        shard, chunk, first, seq, held, block_of, docs, out = TaskContext.get().partitionId(), 0, 0, 0, 0, np.empty(block, np.uint32), [], []

        def flush(ids: np.ndarray) -> None:
            nonlocal chunk, first, docs
            planes = [press.compress(p) for p in shuffle(ids, bits)]
            out.append({"shard": shard, "chunk": chunk, "first": first, "n_ids": len(ids), "plane_bytes": [len(p) for p in planes], "planes": b"".join(planes), "docs": docs})
            chunk, first, docs = chunk + 1, first + len(ids), []

        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for texts in T.slices(batch.column(1)):
                ids, counts = encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                for doc_id, n in zip(names[at:at + len(texts)], (counts + 1).tolist()):
                    place, part, done = first + held, 0, 0
                    while done < n:
                        take = min(n - done, block - held)
                        docs.append({"doc_id": doc_id, "seq": seq, "part": part, "len": take, "n_tokens": n, "at": place})
                        block_of[held:held + take] = ids[:take]
                        ids, held, done, part = ids[take:], held + take, done + take, part + 1
                        if held == block:
                            flush(block_of)
                            held = 0
                    seq += 1
                at += len(texts)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
            T.release()
        if held:
            flush(block_of[:held])
            yield pa.RecordBatch.from_pylist(out, schema)
    return write


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", block: int = 1 << 16, bits: bool = True) -> None:
    """Encode ``docs`` and write ``path``/chunks and ``path``/index."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[doc_id]
    ddl = CHUNKS.format(id=kind)
    schema = pa.schema(_arrow(kind))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).repartitionByRange(parts, "d").sortWithinPartitions("d")
    ordered.mapInArrow(_writer(tokenizer, end_id, block, bits, schema), ddl).write.parquet(f"{path}/chunks")
    spark.read.schema(ddl).parquet(f"{path}/chunks").drop("planes").write.parquet(f"{path}/index")


def _arrow(kind: str) -> list[tuple[str, pa.DataType]]:
    own = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]
    doc = pa.struct([("doc_id", own), ("seq", pa.int64()), ("part", pa.int32()), ("len", pa.int32()), ("n_tokens", pa.int64()), ("at", pa.int64())])
    return [("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.binary()), ("docs", pa.list_(doc))]


def block_ids(planes: bytes, sizes: list[int], n: int) -> np.ndarray:
    """The ids of one chunk."""
    unpress, ends = zstandard.ZstdDecompressor(), np.cumsum(sizes)
    return unshuffle([unpress.decompress(planes[e - s:e]) for s, e in zip(sizes, ends.tolist())], n)


def _shift(crc: int, octets: int) -> int:
    """CRC register after ``octets`` zero bytes: multiplication by x**(8 n) modulo the reflected polynomial."""
    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out
    power, square, n = 1 << 31, 1 << 23, octets
    while n:
        if n & 1:
            power = times(power, square)
        square, n = times(square, square), n >> 1
    return times(power, crc)


def crc_of_parts(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of joined bytes from the (crc, length) of each part."""
    crc = 0
    for own, n in parts:
        crc = _shift(crc, n) ^ own
    return crc


def read_parts(spark: SparkSession, path: str, doc_type: str = "bigint") -> DataFrame:
    """One row for each document and chunk: what the written planes hold of it, as a checksum."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                raw, at, crcs = block_ids(row["planes"], row["plane_bytes"], row["n_ids"]).tobytes(), 0, []
                for d in row["docs"]:
                    crcs.append(zlib.crc32(raw[at:at + 4 * d["len"]]))
                    at += 4 * d["len"]
                docs = row["docs"]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(docs), pa.int32()), *[pa.array([d[k] for d in docs]).cast(t) for k, t in (("seq", pa.int64()), ("part", pa.int32()), ("len", pa.int32()))], pa.array(crcs, pa.int64())], ["shard", "seq", "part", "len", "crc"])
    chunks = spark.read.schema(CHUNKS.format(id=doc_type)).parquet(f"{path}/chunks")
    return chunks.select("shard", "planes", "plane_bytes", "n_ids", F.col("docs")).mapInArrow(decode, "shard int, seq long, part int, len int, crc long")


def read_documents(spark: SparkSession, path: str, doc_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, all from the files."""
    index = spark.read.schema(CHUNKS.format(id=doc_type)).parquet(f"{path}/index")
    # one row a shard
    sizes = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    heads = index.select("shard", F.explode("docs").alias("d")).where("d.part = 0").select("shard", "d.*").drop("part", "len")
    joined = F.udf(lambda parts: crc_of_parts([(p.crc, 4 * p.len) for p in parts]), "bigint")
    crcs = (read_parts(spark, path, doc_type).groupBy("shard", "seq").agg(F.array_sort(F.collect_list(F.struct("part", "len", "crc"))).alias("p"))
            .select("shard", "seq", F.when(F.size("p") == 1, F.col("p")[0]["crc"]).alias("one"), F.when(F.size("p") > 1, F.col("p")).alias("p")))
    many = crcs.where("p is not null").select("shard", "seq", joined("p").alias("ids_crc32"))
    crcs = crcs.where("p is null").select("shard", "seq", F.col("one").alias("ids_crc32")).unionByName(many)
    return heads.join(crcs, ["shard", "seq"]).join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
