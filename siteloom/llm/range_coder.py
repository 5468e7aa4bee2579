"""Token-ID files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Model, in each block from the same start: order 2 and order 1 remember, for the two ids before and for the id before, the
id that last followed them and how often it held; a slot of order 2 checks its context. Order 0 counts the ids, from
start counts in the shard's header on, in two levels of binary indexed sums. In each state (what the two orders know,
how sure they are, whether they agree) adaptive shares mix the three: an id is coded as what order 2 or order 1 expects,
or by order 0. Every id moves the shares and the memories, and one that order 0 coded its counts.

Coder: a 56-bit range coder whose carries are added to the bytes already written. It runs as a JVM user function, as an id
at a time is what vectors are slow at: TokenCoder.java is compiled by the compiler that Spark itself generates code with,
and added to the session as a jar.

Shard (one row): `doc_ids`, `doc_tokens`, and `payload`, all integers little-endian:
  u32 "SLR2", u32 blocks, u32 ids per block, u64 ids, u32 vocabulary, u32 bytes of the header table, zlib(u32 start count
  per id), then per block u32 crc32 of its ids (as u32) and u32 bytes, and last the bytes of all blocks.

Edge cases: a null or empty text is the end id alone; repeated rows, rows that share a doc_id (ordered by text) and a
null doc_id (first) are written like others; a text of any length is in one shard, over as many blocks as it needs; an
empty table gives an empty table; a damaged block raises on reading; only doc_id and text are read, so other columns
cannot clash.

Scale: one shuffle of the texts, ranged by doc_id; a shard is bounded by `shard_ids` and is one row of a Parquet table
in the shared folder, readable and restartable by itself. Positions before a shard are a two-level prefix sum over
shards.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, partitions
from .tokens import memo, text_batches

END_ID = 2
BLOCK_IDS, SHARD_IDS = 1 << 16, 1 << 22
FUNCTIONS = {"Encode": "binary", "Decode": "binary", "Documents": "array<struct<inside:bigint,n_tokens:bigint,ids_crc32:bigint>>"}
_IDS = "part long, seq long, n_ids long, doc_ids array<long>, doc_tokens array<long>, width int, vocabulary int, ids binary"
_added: set[str] = set()
_compiled = None


def coder(spark: SparkSession) -> dict[str, str]:
    """Names of the session's functions; compiles them once per driver and adds their jar once per application."""
    global _compiled
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    if _compiled is None or spark.sparkContext.applicationId not in _added:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook((Path(__file__).parent / "TokenCoder.java").read_text())
        folder = tempfile.mkdtemp(prefix="siteloom-jar-")
        atexit.register(shutil.rmtree, folder, True)
        code = compiler.getBytecodes()
        with zipfile.ZipFile(f"{folder}/siteloom-coder.jar", "w") as jar:
            for name in code:
                jar.writestr(name.replace(".", "/") + ".class", bytes(code[name]))
        spark.sql(f"ADD JAR '{folder}/siteloom-coder.jar'")
        _compiled = compiler.getClassLoader()
        _added.add(spark.sparkContext.applicationId)
    names = {}
    for name, returns in FUNCTIONS.items():
        made = _compiled.loadClass(f"siteloom.TokenCoder${name}").getDeclaredConstructor(gateway.new_array(jvm.Class, 0)).newInstance(gateway.new_array(jvm.Object, 0))
        names[name] = f"siteloom_token_{name.lower()}"
        spark._jsparkSession.udf().register(names[name], made, jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return names


def encoded(spark: SparkSession, ids: Column, width: Column, vocabulary: Column, block_ids: int = BLOCK_IDS) -> Column:
    return F.call_function(coder(spark)["Encode"], ids, width, vocabulary, F.lit(block_ids))


def decoded(spark: SparkSession, payload: Column) -> Column:
    """All ids of a shard as little-endian 32-bit integers."""
    return F.call_function(coder(spark)["Decode"], payload)


def _writer(path: str, end_id: int, shard_ids: int):
    longs = pa.list_(pa.int64())
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", longs), ("doc_tokens", longs),
                        ("width", pa.int32()), ("vocabulary", pa.int32()), ("ids", pa.binary())])

    def write(batches):
        tokenizer, part = memo(path), TaskContext.get().partitionId()
        vocabulary, width = tokenizer.tokenizer.get_vocab_size(with_added_tokens=True), tokenizer.dtype.itemsize
        end = np.array([end_id], tokenizer.dtype).tobytes()
        seq, n, docs, sizes, held = 0, 0, [], [], []

        def row():
            return pa.record_batch([[part], [seq], [n], [docs], [sizes], [width], [vocabulary], [b"".join(held)]], schema=schema)

        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in text_batches(texts):
                for i, x in zip(ids[a:b], tokenizer.encode(texts[a:b])):
                    docs.append(i)
                    held += (x, end)
                    sizes.append(len(x) // width + 1)
                    n += sizes[-1]
                if n >= shard_ids:
                    yield row()
                    seq, n, docs, sizes, held = seq + 1, 0, [], [], []
        if docs:
            yield row()

    return write


def write_files(docs: DataFrame, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The kept table of shards in ascending doc_id order: by part, then seq."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    raw = rows.mapInArrow(_writer(path, end_id, shard_ids), _IDS)
    payload = encoded(spark, F.col("ids"), F.col("width"), F.col("vocabulary"), block_ids)
    return keep(raw.select("part", "seq", "n_ids", "doc_ids", "doc_tokens", payload.alias("payload")), "shards")


def read_files(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as decoded from the shards."""
    found = F.call_function(coder(shards.sparkSession)["Documents"], F.col("payload"), F.col("doc_tokens"))
    rows = shards.select("part", "seq", F.inline(F.arrays_zip(F.col("doc_ids").alias("doc_id"), found.alias("found"))))
    rows = rows.select("part", "seq", "doc_id", "found.*")
    sizes = shards.select("part", "seq", "n_ids")
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("__n"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("__n").over(whole), F.lit(0)).alias("__part"))
    starts = sizes.withColumn("__seq", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("__part") + F.col("__seq")).alias("__start"))
    out = rows.join(starts, ["part", "seq"])
    return out.select("doc_id", (F.col("__start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def digest(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    return read_files(write_files(docs, path, end_id))
