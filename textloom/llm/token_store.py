"""Documents as token ids in raw binary shards, with a minimal perfect hash index from document keys to shard offsets.

A store is a folder: ``shards/`` holds raw little-endian ids, document after document in ascending doc_id order, and nothing
else; ``index/`` holds one file for each bucket of keys; ``manifest`` and ``buckets`` are tables that name the files which
count. A task names its files after its attempt, so that one which runs again leaves no file half replaced: a file that no table names is not
part of the store.

A key is a doc_id and the number of the copy (rows that repeat a doc_id are copies 0, 1, ...). An index file has, for each level of
the hash, its bits in blocks of 512 with the rank before each, and then one record of fixed size for each key: a stored
fingerprint and where its ids lie. One key thus takes a read of a bit block per level, of one record and of its ids, however large
the store is; many keys are looked up bucket by bucket and read shard by shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.line_dedup import PerfectHash, mixed
from textloom.llm.ordering import before, parts_for, ranged
from textloom.llm.packing import encoder
from textloom.llm.shared import text_bytes
from textloom.llm.words import mix

WRITTEN = "part int, shard int, name string, row long, doc_id long, copy long, offset long, n long"
LOCATED = "doc_id long, copy long, part int, shard int, offset long, n long"
READ = "doc_id long, copy long, start long, n_tokens long, ids_crc32 long"
RECORD = np.dtype([("print", "<u8"), ("part", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])
MAGIC = b"textloom ids 01\n"
BLOCK = 512


def halves(doc_id: np.ndarray, copy: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key; together they differ wherever the keys do."""
    return mix(doc_id.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), mix(copy.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64))


def prints(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h1 * np.uint64(0xD6E8FEB86659FD93) ^ mix(h2 + np.uint64(0xC2B2AE3D27D4EB4F)))


def key_columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc_id = table.column("doc_id")
    return doc_id.fill_null(0).to_numpy(), table.column("copy").to_numpy(), doc_id.is_null().to_numpy()


def index_bytes(h1: np.ndarray, h2: np.ndarray, records: np.ndarray) -> bytes:
    """An index file: magic, counts of keys and levels, bits of each level, then bit blocks with ranks, then records by slot."""
    found = PerfectHash.build(h1, h2)
    out, rank = [MAGIC, np.array([len(h1), len(found.levels), *map(len, found.levels)], "<u8").tobytes()], 0
    for bits in found.levels:
        padded = np.zeros(-(-len(bits) // BLOCK) * BLOCK, bool)
        padded[: len(bits)] = bits
        counts = padded.reshape(-1, BLOCK).sum(axis=1)
        ranks = rank + np.r_[0, np.cumsum(counts)[:-1]]
        rows = np.concatenate([ranks.astype("<u8").view(np.uint8).reshape(-1, 8), np.packbits(padded, bitorder="little").reshape(-1, BLOCK // 8)], axis=1)
        out.append(rows.tobytes())
        rank += int(counts.sum())
    placed = np.zeros(len(h1), RECORD)
    placed[found.slots(h1, h2)] = records
    return b"".join([*out, placed.tobytes()])


def index_parts(raw: bytes) -> tuple[PerfectHash, np.ndarray]:
    """The hash and the records of a whole index file."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not an index file")
    keys, n = np.frombuffer(raw, "<u8", 2, len(MAGIC)).tolist()
    sizes, at, levels = np.frombuffer(raw, "<u8", n, len(MAGIC) + 16).tolist(), len(MAGIC) + 16 + 8 * n, []
    for size in sizes:
        blocks = -(-size // BLOCK)
        rows = np.frombuffer(raw, np.uint8, blocks * (8 + BLOCK // 8), at).reshape(blocks, -1)
        levels.append(np.unpackbits(rows[:, 8:].reshape(-1), bitorder="little")[:size].astype(bool))
        at += rows.size
    return PerfectHash(levels), np.frombuffer(raw, RECORD, keys, at)


def whole(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


class TokenStore:
    """A written store. ``width`` is the numpy type of an id in the shards, ``end_id`` the last id of every document."""

    def __init__(self, spark: SparkSession, folder: str, width: str, end_id: int, buckets: int):
        self.spark, self.folder, self.width, self.end_id, self.n_buckets = spark, folder, width, end_id, buckets
        self.manifest = spark.read.parquet(f"{folder}/manifest")
        self.buckets = spark.read.parquet(f"{folder}/buckets")

    def keys(self) -> DataFrame:
        """(doc_id, copy) of every document."""
        return placed(self.spark.read.schema(WRITTEN).parquet(f"{self.folder}/written"), self.manifest).select("doc_id", "copy")

    def located(self, keys: DataFrame) -> DataFrame:
        """(doc_id, copy, part, shard, offset, n) of each row of ``keys``, by the index; a key that is not in the store has
        nulls. Offsets count bytes and ``n`` counts ids."""
        folder = self.folder

        def find(table: pa.Table) -> pa.Table:
            ids, copy, null = key_columns(table)
            h1, h2 = halves(ids, copy, null)
            name, at = table.column("name")[0].as_py(), np.full(len(ids), -1)
            if name is not None:
                store, base = fs.FileSystem.from_uri(folder)
                index, records = index_parts(whole(store, f"{base}/index/{name}"))
                at = index.slots(h1, h2)
                at[at >= 0] = np.where(records["print"][at[at >= 0]] == prints(h1, h2)[at >= 0], at[at >= 0], -1)
            found = records[at] if name is not None and len(records) else np.zeros(len(ids), RECORD)
            return pa.table([table.column("doc_id"), table.column("copy"), *(pa.array(found[c].astype(kind), mask=at < 0) for c, kind in (("part", "i4"), ("shard", "i4"), ("offset", "i8"), ("n", "i8")))], names=["doc_id", "copy", "part", "shard", "offset", "n"])

        asked = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy"))
        bucketed = asked.withColumn("bucket", bucket_of(self.n_buckets)).join(self.buckets.select("bucket", "name"), "bucket", "left")
        return bucketed.groupBy("bucket").applyInArrow(find, LOCATED)

    def documents(self, keys: DataFrame, keep_ids: bool = False) -> DataFrame:
        """doc_id, copy, start (ids of all documents before it), n_tokens and ids_crc32 of each key in the store, from the
        shards; with ``keep_ids`` also ``ids``, little-endian unsigned 32-bit."""
        folder, width, end_id = self.folder, np.dtype(self.width), self.end_id

        def read(table: pa.Table) -> pa.Table:
            table = table.sort_by("offset")
            store, root = fs.FileSystem.from_uri(folder)
            crcs, raw = [], []
            with store.open_input_file(f"{root}/shards/{table.column('name')[0].as_py()}") as f:
                for offset, n in zip(table.column("offset").to_pylist(), table.column("n").to_pylist(), strict=True):
                    ids = np.frombuffer(f.read_at(n * width.itemsize, offset), width).astype("<u4")
                    if len(ids) != n or ids[-1] != end_id:
                        raise ValueError("a shard does not hold what its index says")
                    crcs.append(zlib.crc32(ids.tobytes()))
                    if keep_ids:
                        raw.append(ids.tobytes())
            start = table.column("base").to_numpy() + table.column("offset").to_numpy() // width.itemsize
            arrays, names = [table.column("doc_id"), table.column("copy"), pa.array(start), table.column("n"), pa.array(crcs, pa.int64())], ["doc_id", "copy", "start", "n_tokens", "ids_crc32"]
            return pa.table([*arrays, pa.array(raw, pa.binary())] if keep_ids else arrays, names=[*names, "ids"] if keep_ids else names)

        found = self.located(keys).where("n IS NOT NULL").join(self.manifest.select("part", "shard", "name", "base"), ["part", "shard"])
        return found.groupBy("part", "shard").applyInArrow(read, READ + (", ids binary" if keep_ids else ""))

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of one document, or None: some small reads, whatever the size of the store."""
        key = self.spark.range(1).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(copy).cast("long").alias("copy"))
        named = key.withColumn("bucket", bucket_of(self.n_buckets)).join(self.buckets, "bucket").select("name").first()
        if named is None:
            return None
        store, root = fs.FileSystem.from_uri(self.folder)
        h1, h2 = halves(np.array([doc_id or 0]), np.array([copy]), np.array([doc_id is None]))
        with store.open_input_file(f"{root}/index/{named[0]}") as f:
            keys, n = np.frombuffer(f.read_at(16, len(MAGIC)), "<u8").tolist()
            sizes, at, slot = np.frombuffer(f.read_at(8 * n, len(MAGIC) + 16), "<u8").tolist(), len(MAGIC) + 16 + 8 * n, -1
            for level, size in enumerate(sizes):
                bit = int(mixed(h1, h2, level)[0]) % size
                if slot < 0:
                    row = np.frombuffer(f.read_at(8 + BLOCK // 8, at + bit // BLOCK * (8 + BLOCK // 8)), np.uint8)
                    bits = np.unpackbits(row[8:], bitorder="little")
                    if bits[bit % BLOCK]:
                        slot = int(row[:8].view("<u8")[0]) + int(bits[: bit % BLOCK].sum())
                at += -(-size // BLOCK) * (8 + BLOCK // 8)
            if slot < 0:
                return None
            record = np.frombuffer(f.read_at(RECORD.itemsize, at + slot * RECORD.itemsize), RECORD)[0]
        if record["print"] != prints(h1, h2)[0]:
            return None
        name = self.manifest.where((F.col("part") == int(record["part"])) & (F.col("shard") == int(record["shard"]))).first()["name"]
        with store.open_input_file(f"{root}/shards/{name}") as f:
            return np.frombuffer(f.read_at(int(record["n"]) * np.dtype(self.width).itemsize, int(record["offset"])), self.width)


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int")


def placed(written: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, copy, part, shard, offset, n), with copies counted over all shards. The manifest has a row for each shard."""
    carry = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("carry")).otherwise(0)
    return written.join(manifest.select("part", "shard", "first_id", "carry"), ["part", "shard"]).select("doc_id", (F.col("copy") + carry).alias("copy"), "part", "shard", "offset", "n")


def write_store(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, part_bytes: int = 32 << 20, shard_bytes: int = 16 << 20, bucket_keys: int = 50_000) -> TokenStore:
    """Writes the documents in ascending doc_id order to ``folder``, a new folder that executors can write to.

    A document's ids are those of the tokenizer file followed by ``end_id``. Null and empty texts give that one id. A null doc_id
    comes first. Rows that repeat a doc_id come in the order of a hash of their texts and are copies of their own. A text of any length
    is one document in one shard. An empty table gives a store without files. Other columns are ignored.
    """
    spark, width = docs.sparkSession, encoder(tokenizer).width
    store, root = fs.FileSystem.from_uri(folder)
    for name in ("shards", "index"):
        store.create_dir(f"{root}/{name}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, enc = TaskContext.get(), encoder(tokenizer)
        part, end, size = context.partitionId(), enc._bytes([end_id]), np.dtype(enc.width).itemsize
        store, root = fs.FileSystem.from_uri(folder)
        held, ids, copies, sizes, shard = [], [], [], [], 0
        last, copy = object(), 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{shard:05d}-{context.taskAttemptId()}.ids"
            with store.open_output_stream(f"{root}/shards/{name}", compression=None) as out:
                for x in held:
                    out.write(x)
            n, rows = np.array(sizes, np.int64), len(sizes)
            arrays = [pa.array([part] * rows, pa.int32()), pa.array([shard] * rows, pa.int32()), pa.array([name] * rows), pa.array(np.arange(rows)), pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array((np.cumsum(n) - n) * size), pa.array(n)]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "shard", "name", "row", "doc_id", "copy", "offset", "n"])

        total = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = enc.encode(text or "") + end
                # Copies are counted from the start of the shard; earlier shards are added from their totals.
                copy = copy + 1 if ids and doc_id == last else 0
                last = doc_id
                held.append(raw)
                ids.append(doc_id)
                copies.append(copy)
                sizes.append(len(raw) // size)
                total += len(raw)
                if total >= shard_bytes:
                    yield flush()
                    held, ids, copies, sizes, shard, total = [], [], [], [], shard + 1, 0
        if ids:
            yield flush()

    def build(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        bucket = table.column("bucket")[0].as_py()
        records = np.zeros(table.num_rows, RECORD)
        h1, h2 = halves(*key_columns(table))
        records["print"] = prints(h1, h2)
        for c in ("part", "shard", "offset", "n"):
            records[c] = table.column(c).to_numpy()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{bucket:06d}-{TaskContext.get().taskAttemptId()}.mph"
        with store.open_output_stream(f"{root}/index/{name}", compression=None) as out:
            out.write(index_bytes(h1, h2, records))
        return pa.table([pa.array([bucket], pa.int32()), pa.array([name]), pa.array([table.num_rows], pa.int64())], names=["bucket", "name", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_rows = ranged(rows, [F.col("doc_id"), F.xxhash64("text")], parts_for(text_bytes(docs), part_bytes))
    sorted_rows.mapInArrow(write, WRITTEN).write.parquet(f"{folder}/written")
    written = spark.read.schema(WRITTEN).parquet(f"{folder}/written")

    shards = written.groupBy("part", "shard", "name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"), F.min(F.struct("row", "doc_id"))["doc_id"].alias("first_id"), F.max(F.struct("row", "doc_id", "copy")).alias("last")
    )
    shards = before(shards.withColumn("all", F.lit(0)), ["all"], ["part", "shard"], "tokens", "base").drop("all")
    # How many rows of a shard's first doc_id stand in earlier shards: those at their ends.
    ends = shards.select(F.col("last.doc_id").alias("id"), "part", "shard", F.lit(1).alias("asks"), (F.col("last.copy") + 1).alias("copies"))
    asks = shards.select(F.col("first_id").alias("id"), "part", "shard", F.lit(0).alias("asks"), F.lit(0).cast("long").alias("copies"))
    carried = before(ends.unionByName(asks), ["id"], ["part", "shard", "asks"], "copies", "carry").where("asks = 0").select("part", "shard", "carry")
    shards.join(carried, ["part", "shard"]).select("part", "shard", "name", "rows", "tokens", "base", "first_id", "carry").write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")

    keys = manifest.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    buckets = parts_for(keys, bucket_keys)
    placed(written, manifest).withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(build, "bucket int, name string, keys long").write.parquet(f"{folder}/buckets")
    return TokenStore(spark, folder, width, end_id, buckets)
