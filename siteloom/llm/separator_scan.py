"""Token counts by a separator scan over flat, unindexed token files.

write_flat() tokenizes documents in their scan order, ends each with the end-of-document id and writes one flat stream of
16- or 32-bit ids per scan partition, cut into raw blocks regardless of documents. The blocks are rows of a Parquet
table, which Spark can write and read in any store; flat_files() gives the same blocks from plain binary files. Beside
the stream, not within it, stands the list of the written doc_ids in order.

scan() finds the separators of each block with one vector comparison. A block reports its tokens, its separators and
where the last one ends; exclusive prefix sums and a running maximum over the blocks then give every block the ordinal,
global position and start of the document that is open at its first token.

Edge cases: a null or empty text is the end id alone; a null doc_id and repeated rows are written like others; tokens
after the last separator of a file are a document with ended = false; a block without separators hands the open document
on; an empty table has no rows; only doc_id and text are read, so other columns cannot clash.

Scale: no shuffle of texts or tokens. Windows run over the block summaries of one file (a scan partition), and over one
row per file in two levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import before, keep, numbered
from .tokens import memo, text_batches

BLOCK_BYTES = 1 << 20
_FLAT = "file long, block long, width int, ids binary, doc_ids array<long>"


def _writer(path: str, eod: int, block_bytes: int):
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def write(batches):
        tokenizer, file = memo(path, special_as_text=True), TaskContext.get().partitionId()
        end = np.array([eod], tokenizer.dtype).tobytes()
        width, block, held, written = tokenizer.dtype.itemsize, 0, bytearray(), []

        def row(ids, docs):
            nonlocal block
            block += 1
            return pa.record_batch([[file], [block - 1], [width], [ids], [docs]], schema=schema)

        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in text_batches(texts):
                for i, x in zip(ids[a:b], tokenizer.encode(texts[a:b])):
                    held += x + end
                    written.append(i)
                while len(held) >= block_bytes:
                    yield row(bytes(held[:block_bytes]), written)
                    del held[:block_bytes]
                    written = []
        if held or written:
            yield row(bytes(held), written)

    return write


def write_flat(docs: DataFrame, path: str, eod: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept table of raw blocks; doc_ids: of the documents written since the block before, in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keep(rows.mapInArrow(_writer(path, eod, block_bytes), _FLAT), "flat")


def flat_files(spark: SparkSession, glob: str, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of plain little-endian binary files, numbered by path; each file must be under 2 GB."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    order = keep(numbered(files.select("path"), "file", "path").withColumn("file", F.col("file") - 1), "files")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("content") - 1, F.lit(0)), F.lit(block_bytes))
    rows = files.join(order, "path").select("file", "content", F.posexplode(starts).alias("block", "at"))
    return rows.select(
        "file", F.col("block").cast("long").alias("block"), F.lit(width).alias("width"),
        F.substring("content", F.col("at") + 1, F.lit(block_bytes)).alias("ids"), F.lit(None).cast("array<long>").alias("doc_ids"))


def _separators(eod: int):
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int32()))])

    def find(batches):
        for batch in batches:
            found = [
                np.flatnonzero(np.frombuffer(ids, f"<u{width}") == eod).astype("<i4") + 1
                for ids, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())
            ]
            n = [len(ids) // w for ids, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]
            yield pa.record_batch([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32()))], schema=schema)

    return find


def scan(blocks: DataFrame, eod: int) -> DataFrame:
    """file, ordinal (in its file), file_start, start (in all files), n_tokens (with the separator), ended; a row per document."""
    found = keep(blocks.select("file", "block", "width", "ids").mapInArrow(_separators(eod), "file long, block long, n long, ends array<int>"), "separators")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    size = found.select("file", "block", "n", "ends", F.size("ends").cast("long").alias("__seps"), F.get("ends", F.size("ends") - 1).cast("long").alias("__last"))
    size = size.withColumn("__at", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    size = size.withColumn("__ordinal", F.coalesce(F.sum("__seps").over(earlier), F.lit(0)))
    size = size.withColumn("__open", F.coalesce(F.max(F.col("__at") + F.col("__last")).over(earlier), F.lit(0)))
    closed = size.select(
        "file", "__at", "__ordinal", "__open", "ends", F.posexplode("ends").alias("__k", "__end")
    ).select(
        "file", (F.col("__ordinal") + F.col("__k")).alias("ordinal"),
        F.when(F.col("__k") == 0, F.col("__open")).otherwise(F.col("__at") + F.get("ends", F.col("__k") - 1)).alias("__from"),
        (F.col("__at") + F.col("__end")).alias("__to"), F.lit(True).alias("ended"))
    total = size.groupBy("file").agg(
        F.sum("n").alias("__tokens"), F.sum("__seps").alias("ordinal"), F.coalesce(F.max(F.col("__at") + F.col("__last")), F.lit(0)).alias("__from"))
    left = total.where(F.col("__tokens") > F.col("__from")).select("file", "ordinal", "__from", F.col("__tokens").alias("__to"), F.lit(False).alias("ended"))
    files = before(total.select("file", "__tokens"), "file", "__tokens", "file_start")
    out = closed.unionByName(left).join(files.select("file", "file_start"), "file")
    return out.select(
        "file", "ordinal", "file_start", (F.col("file_start") + F.col("__from")).alias("start"),
        (F.col("__to") - F.col("__from")).alias("n_tokens"), "ended")


def digest(docs: DataFrame, path: str, eod: int) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens: each document's tokens as the scan of the flat files finds them."""
    flat = write_flat(docs, path, eod)
    listed = flat.select("file", "block", F.size("doc_ids").cast("long").alias("__n"), "doc_ids")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    listed = listed.select("file", "__base", F.posexplode("doc_ids").alias("__k", "doc_id")).select("file", (F.col("__base") + F.col("__k")).alias("ordinal"), "doc_id")
    found = scan(flat, eod).where("ended")
    return found.join(listed, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
