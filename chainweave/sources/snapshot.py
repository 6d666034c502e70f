"""Sources and sinks: snapshots of the unspent set, flat block files, keyed trees with latest-wins writes, checkpoints in two slots, and metrics as text."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A snapshot file: block hash (32 bytes), height, outputs, amount (8 each), set digest (28 of them zero-padded to 28) make 84 bytes; entries follow, each after its length.
HEADER, HEADER_BYTES = "<32sQQQ28s", 84
ENTRY, ENTRY_BYTES = "<32sIqQB", 53
#: Entries that a reader holds as rows at a time; a file itself is one binary value, of 2 GB at most.
BATCH_ENTRIES = 10_000


def encode_snapshot(block_hash: bytes, height: int, entries: list[tuple[bytes, int, int, int, bool, bytes]], digest: bytes = b"") -> bytes:
    """A snapshot of (txid, vout, value, height, coinbase, script) entries."""
    out = [struct.pack(HEADER, block_hash, height, len(entries), sum(e[2] for e in entries), digest[:28])]
    for txid, vout, value, h, coinbase, script in sorted(entries):
        body = struct.pack(ENTRY, txid, vout, value, h, coinbase) + script
        out.append(struct.pack("<I", len(body)) + body)
    return b"".join(out)


def read_snapshots(files: DataFrame) -> DataFrame:
    """(block_hash, snapshot_height, txid, vout, value, height, coinbase, script) of snapshot files, as the binaryFile source reads them. Fails on a file that ends early or has another number of entries than its header says."""

    names = ["block_hash", "snapshot_height", "txid", "vout", "value", "height", "coinbase", "script"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = memoryview(content.as_buffer())
                block_hash, height, n, _, _ = struct.unpack_from(HEADER, data)
                at, seen, rows = HEADER_BYTES, 0, []
                while at < len(data):
                    (size,) = struct.unpack_from("<I", data, at)
                    if at + 4 + size > len(data):
                        raise ValueError("the snapshot ends within an entry")
                    txid, vout, value, h, coinbase = struct.unpack_from(ENTRY, data, at + 4)
                    rows.append((block_hash.hex(), height, txid.hex(), vout, value, h, bool(coinbase), bytes(data[at + 4 + ENTRY_BYTES : at + 4 + size])))
                    at += 4 + size
                    if len(rows) == BATCH_ENTRIES:
                        yield made(rows)
                        seen, rows = seen + len(rows), []
                if seen + len(rows) != n:
                    raise ValueError(f"the snapshot has {seen + len(rows)} entries, its header says {n}")
                yield made(rows)

    return files.select("content").mapInArrow(run, "block_hash string, snapshot_height bigint, txid string, vout bigint, value bigint, height bigint, coinbase boolean, script binary")


def read_flat_blocks(files: DataFrame, magic: bytes = bytes.fromhex("f9beb4d9")) -> DataFrame:
    """(path, offset, size, block_hash, prev_hash, merkle_root, ts, bits, nonce) of the blocks in flat files: each after four magic bytes and its length; zeros between blocks are skipped."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, rows = data.find(magic), []
                while 0 <= at <= len(data) - 88:
                    (size,) = struct.unpack_from("<I", data, at + 4)
                    head = data[at + 8 : at + 88]
                    _, prev, root, ts, bits, nonce = struct.unpack("<i32s32sIII", head)
                    own = hashlib.sha256(hashlib.sha256(head).digest()).digest()
                    rows.append((path, at + 8, size, own[::-1].hex(), prev[::-1].hex(), root[::-1].hex(), ts, bits, nonce))
                    at = data.find(magic, at + 8 + size)
                names = ["path", "offset", "size", "block_hash", "prev_hash", "merkle_root", "ts", "bits", "nonce"]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, offset bigint, size bigint, block_hash string, prev_hash string, merkle_root string, ts bigint, bits bigint, nonce bigint")


class Tree:
    """A keyed relation as a log of batches in Parquet: writes append, reads take the latest version of a key, a null value is a deletion.

    A batch is a folder `batch-N`, N being claimed by creating a file that must not exist yet, so that no two writers share a version. Readers see a
    batch once its write job is complete, as a whole. compact() writes `base-N`, the live rows as of version N; readers start from the newest complete
    base. It never changes what readers may have open: files go one compaction later. If a batch has a key twice, the largest value holds.
    """

    SCHEMA = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("version", T.LongType())])

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._at(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _versions(self, kind: str) -> list[int]:
        """Versions of a kind (batch, base or claim) in order; of batches and bases, those whose write is complete."""
        folder = f"{self.path}/claims" if kind == "claim" else self.path
        found = sorted(int(n.split("-")[1]) for n in self._names(folder) if n.startswith(f"{kind}-"))
        return found if kind == "claim" else [v for v in found if self._fs.exists(self._at(f"{self.path}/{kind}-{v}/_SUCCESS"))]

    def _parts(self) -> tuple[int, list[str]]:
        """The newest complete base (0 for none), and the folders that the live rows follow from."""
        base = max(self._versions("base"), default=0)
        newer = [f"{self.path}/batch-{v}" for v in self._versions("batch") if v > base]
        return base, ([f"{self.path}/base-{base}"] if base else []) + newer

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMA)

    def _log(self) -> DataFrame:
        return self._read(self._parts()[1])

    @staticmethod
    def _live(log: DataFrame) -> DataFrame:
        last = log.groupBy("key").agg(F.max_by(F.struct("value"), F.struct("version", "value")).alias("v"))
        return last.select("key", "v.value").filter("value IS NOT NULL")

    def claim(self) -> int:
        """A version that no other writer has or gets."""
        v = max([0, *self._versions("claim"), *self._versions("base")])
        while True:
            v += 1
            try:
                self._fs.create(self._at(f"{self.path}/claims/claim-{v}"), False).close()
                return v
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise

    def _write(self, rows: DataFrame, version: int, kind: str = "batch") -> None:
        rows.select("key", "value", F.lit(version).cast("long").alias("version")).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{kind}-{version}")

    def commit(self, rows: DataFrame) -> None:
        """Applies a batch (key, value); null values delete."""
        self._write(rows, self.claim())

    def insert(self, key: bytes, value: bytes) -> None:
        self.commit(self.spark.createDataFrame([(key, value)], "key binary, value binary"))

    def remove(self, key: bytes) -> None:
        self.commit(self.spark.createDataFrame([(key, None)], "key binary, value binary"))

    def bulk_load_sorted(self, rows: DataFrame) -> None:
        """Loads many rows in key order, so that files hold ranges of keys and lookups skip most of them."""
        self.commit(rows.repartitionByRange("key").sortWithinPartitions("key"))

    def rows(self) -> DataFrame:
        """(key, value) of all live keys."""
        return self._live(self._log())

    def iter(self) -> DataFrame:
        return self.rows().orderBy("key")

    def get(self, key: bytes) -> bytes | None:
        found = self._log().filter(F.col("key") == F.lit(key)).orderBy(F.desc("version"), F.desc_nulls_last("value")).limit(1).collect()
        return bytes(found[0]["value"]) if found and found[0]["value"] is not None else None

    def get_many(self, keys: DataFrame) -> DataFrame:
        """keys (pos, key) with value, null where missing."""
        return keys.join(self.rows(), "key", "left")

    def contains(self, key: bytes) -> bool:
        return self.get(key) is not None

    def len(self) -> int:
        return self.rows().count()

    def clear(self) -> None:
        """Empties the tree: a base without rows takes the place of all batches claimed before."""
        self._write(self.spark.createDataFrame([], self.SCHEMA), self.claim(), "base")

    def abandon(self) -> None:
        """Gives up claims without a complete batch, as lost writers leave them; only while nobody writes."""
        done = {*self._versions("batch"), *self._versions("base")}
        base = self._parts()[0]
        for v in self._versions("claim"):
            if v > base and v not in done:
                self._write(self.spark.createDataFrame([], self.SCHEMA), v)

    def compact(self) -> None:
        """Writes the live rows as a new base, as of the last version before the first unfinished one, and drops what the base before had replaced."""
        base = self._parts()[0]
        done, upto = set(self._versions("batch")), base
        for v in self._versions("claim"):
            if v > base:
                if v not in done:
                    break
                upto = v
        if upto == base:
            return
        old = [f"{self.path}/base-{base}"] if base else []
        live = self._live(self._read(old + [f"{self.path}/batch-{v}" for v in sorted(done) if base < v <= upto]))
        self._write(live, upto, "base")
        for name in self._names(self.path):
            kind, _, v = name.partition("-")
            if (kind == "batch" and int(v) <= base) or (kind == "base" and int(v) < base):
                self._fs.delete(self._at(f"{self.path}/{name}"), True)
        for v in self._versions("claim"):
            if v <= base:
                self._fs.delete(self._at(f"{self.path}/claims/claim-{v}"), False)


def write_checkpoint(state: DataFrame, base: str, height: int) -> str:
    """Writes a state to the slot that the pointer doesn't name, then moves the pointer: a crash leaves the old checkpoint whole."""
    spark = state.sparkSession
    now = read_pointer(spark, base)
    slot = 1 - now["slot"] if now else 0
    state.write.mode("overwrite").parquet(f"{base}/slot{slot}")
    n = spark.read.parquet(f"{base}/slot{slot}").count()
    version = (now["version"] if now else 0) + 1
    spark.createDataFrame([(version, slot, height, n)], "version long, slot int, height long, n long").coalesce(1).write.mode("append").parquet(f"{base}/pointer")
    return f"{base}/slot{slot}"


def read_pointer(spark: SparkSession, base: str):
    """The newest pointer row, or None where there is no checkpoint."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/pointer")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{base}/pointer").orderBy(F.desc("version")).first()


def read_checkpoint(spark: SparkSession, base: str) -> DataFrame | None:
    now = read_pointer(spark, base)
    return spark.read.parquet(f"{base}/slot{now['slot']}") if now else None


def prometheus_text(metrics: DataFrame) -> DataFrame:
    """(value: text lines) of metrics (name, kind, labels map, value), grouped by name; label values are escaped."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    line = F.concat(F.col("name"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), F.col("value").cast("string"))
    first = F.row_number().over(Window.partitionBy("name").orderBy(pairs)) == 1
    typed = F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" "), F.col("kind"), F.lit("\n"))
    return metrics.withColumn("first", first).select("name", F.concat(F.when(F.col("first"), typed).otherwise(F.lit("")), line).alias("value")).orderBy("name", F.desc(F.col("value").startswith("#")), "value").select("value")
