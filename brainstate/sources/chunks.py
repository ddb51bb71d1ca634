"""IO1 for recordings: a stream that admits at most so many samples of a session a micro-batch, as a live pull does."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from brainstate import schemas

#: Samples of a session in a chunk, and chunks in a folder of a recording.
MAX_SAMPLES, CHUNKS = 250, 64
#: Size of a row group in bytes: small, since a task reads the few groups that hold its chunk.
ROW_GROUP = 4 << 20


def write_chunks(samples: DataFrame, path: str, max_samples: int = MAX_SAMPLES, chunks: int = CHUNKS) -> None:
    """samples (session_id, sample_idx, ...) as a recording that read_chunks streams; replaces what path holds.

    A chunk is max_samples consecutive indexes of every session, also of the null one; negative indexes come first, and where indexes
    have gaps a chunk has fewer samples. Rows that repeat an index of their session stay in its chunk. A sample without an index is
    an error, since it has no place in a recording. Folders hold some chunks of all sessions and any number of files, so neither a long
    recording nor many sessions are a hot key.
    """
    if max_samples < 1 or chunks < 1:
        raise ValueError("max_samples and chunks are at least 1")
    placed = F.when(F.col("sample_idx").isNull(), F.raise_error(F.lit("a sample has no sample_idx"))).otherwise(F.col("sample_idx"))
    numbered = samples.withColumn("chunk", F.floor(placed / max_samples).cast("long"))
    dealt = numbered.withColumn("folder", F.floor(F.col("chunk") / chunks).cast("long")).hint("rebalance", "folder")
    dealt.sortWithinPartitions("folder", "chunk").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("folder").parquet(f"{path}/samples")
    written = samples.sparkSession.read.schema("chunk long").parquet(f"{path}/samples")
    ends = written.agg(F.coalesce(F.min("chunk"), F.lit(0)).alias("first"), F.coalesce(F.max("chunk") + 1, F.lit(0)).alias("end"))
    ends.withColumn("chunks", F.lit(chunks)).coalesce(1).write.mode("overwrite").parquet(f"{path}/ends")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path that Spark knows (a plain path, file, hdfs or s3a), and the path there."""
    if "://" not in path:
        path = "file:///" + re.sub(r"^(file:)?/+", "", path)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


class ChunkFile(InputPartition):
    """The chunks from first to before end that a file holds."""

    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class ChunkReader(DataSourceStreamReader):
    """Offsets are chunk numbers; each batch is the next chunk of all sessions, or so many next ones."""

    def __init__(self, path: str, schema: pa.Schema, admitted: int = 1):
        self.path, self.schema, self.admitted = path, schema, admitted
        files, root = opened(path)
        ends = pads.dataset(f"{root}/ends", filesystem=files).to_table().to_pylist()[0]
        self.first, self.end, self.chunks = ends["first"], ends["end"], ends["chunks"]
        self.planned = None

    def initialOffset(self) -> dict:
        return {"chunk": self.first}

    def latestOffset(self) -> dict:
        # A query that is restarted plans the last batch of its log again before it asks, so planned is where it stands.
        at = self.first if self.planned is None else self.planned
        return {"chunk": min(at + self.admitted, self.end)}

    def partitions(self, start: dict, end: dict) -> list[ChunkFile]:
        first, last = start["chunk"], end["chunk"]
        if last < first:
            raise ValueError(f"the stream stands at chunk {first}, the recording ends at {last}: it isn't the one that the stream began with")
        self.planned = last
        files, root = opened(self.path)
        out = []
        for folder in range(first // self.chunks, -(-last // self.chunks)):
            found = files.get_file_info(pafs.FileSelector(f"{root}/samples/folder={folder}", allow_not_found=True))
            out += [ChunkFile(x.path, first, last) for x in found if x.is_file and x.base_name.endswith(".parquet")]
        return out if last > first else []

    def read(self, partition: ChunkFile) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        wanted = (pads.field("chunk") >= partition.first) & (pads.field("chunk") < partition.end)
        rows = pads.dataset(partition.path, filesystem=files, format="parquet")
        for batch in rows.to_batches(columns=self.schema.names, filter=wanted):
            if batch.num_rows:
                yield from pa.Table.from_batches([batch]).cast(self.schema).to_batches()


class SampleChunks(DataSource):
    """The source that read_chunks registers; options: path and the schema of the samples."""

    @classmethod
    def name(cls) -> str:
        return "sample_chunks"

    def schema(self) -> str:
        return self.options.get("samples", schemas.SAMPLES)

    def streamReader(self, schema) -> ChunkReader:
        return ChunkReader(self.options["path"], to_arrow_schema(schema), int(self.options.get("chunks", 1)))


def read_chunks(spark: SparkSession, path: str, schema: str = schemas.SAMPLES, chunks: int = 1) -> DataFrame:
    """IO1: a stream of a recording of write_chunks. A micro-batch has the next chunk of each session, one task for each file that may hold it.

    A long recording that is caught up with may have more chunks a micro-batch, as each one has a price of its own: chunks is their number, and a
    column chunk long in the schema tells them apart.
    It goes on where its checkpoint ends, without losing or repeating a sample. It is to be run with a trigger of processing time: a run
    with availableNow asks once for the newest offset, so it is one chunk. path is one that Arrow can open on driver and executors.
    """
    spark.dataSource.register(SampleChunks)
    if chunks < 1:
        raise ValueError("chunks is at least 1")
    return spark.readStream.format("sample_chunks").option("samples", schema).option("chunks", chunks).load(path)


def chunks_of(spark: SparkSession, path: str, batches: int) -> int:
    """Chunks a micro-batch with which a recording takes at most so many of them."""
    ends = spark.read.schema("first long, end long").parquet(f"{path}/ends").first()
    return max(-(-(ends["end"] - ends["first"]) // batches), 1)
