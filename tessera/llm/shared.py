"""What the training-data operators share: staging in the cluster's shared folder and table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset, a session on one machine (tests) gets a new local one;
    a cluster gets an error, as its executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, grouped by application so that it can be cleared as a whole."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs no more than its
    own tasks.  The columns keep their types."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is common where it has at least one row in so many; so there are at most so many common keys.
COMMON = 1024


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key of theirs and the number of rows with it in
    ``copies``; rows with a null in their key get nulls.  Both should be staged, as each is read twice.

    Common keys, at most COMMON of them, are broadcast, so that their rows stay where they are; the others, none of which
    has more than that share of the rows, are shuffled."""
    common = table.where(F.col(copies) * COMMON >= rows.count()).drop(copies)
    full = rows.dropna(subset=keys)
    hot = full.join(F.broadcast(common), keys)
    cold = full.join(F.broadcast(common.select(*keys)), keys, "left_anti").join(table.drop(copies), keys)
    return hot.unionByName(cold).unionByName(rows.where(" OR ".join(f"{k} IS NULL" for k in keys)), allowMissingColumns=True)


def slices(texts: pa.Array, size: int = 16_000_000) -> Iterator[tuple[int, int, list[str | None]]]:
    """(from, to, texts) of consecutive runs of a column of about so many bytes at most; a longer text is a run of its own.
    Spark bounds an Arrow batch by bytes, and only a run of it is held as Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield lo, hi, texts.slice(lo, hi - lo).to_pylist()
        lo = hi


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys`` (integers without nulls) in batches that are sorted by them; only the run at
    hand is held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            key = at[:, lo].tolist()
            if last is not None and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
            last = key
    if held:
        yield pa.concat_tables(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
