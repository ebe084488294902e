"""An exact vector index: cells with triangle-inequality bounds, and meetings of blocks of queries and vectors by a join.

Vectors travel as packed floats.  A gallery is split into cells around centers that are fitted on a bounded sample; every
vector is in the cell of its nearest center, and a cell into blocks of about BLOCK vectors.  A query first meets the cells
around it that hold as many vectors as it wants.  The worst of those is an upper bound of its last hit's distance, and only
cells that reach into that radius (distance to the center less the cell's own) are met then.  What is left out cannot be a
hit, so results are those of comparing all pairs; how much is left out depends on the data.

A meeting ships a query to the blocks that it visits and each block once; a join on (cell, block) brings them together.  No
side is broadcast but the centers and bounds of cells, CELLS at most.

Rows without a key, and vectors that are null, empty or with components that are null or not finite, are left out; so are
those of another length than most of the sample where there are cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tessera.sources import stages

#: Vectors of a block, and queries of a row that meets one.
BLOCK, CHUNK = 2048, 256
#: Vectors whose distances to all centers are held at once.
SLICE = 1024
#: Queries whose scores are summed at once.
ROWS = 16
#: Bytes of scores that a task of a full ranking holds, and rows that it hands on at once.
HELD, ROWS_OUT = 1 << 29, 1 << 16
#: Vectors that centers are fitted on, cells, and vectors of a cell that a further one is worth.
SAMPLE, CELLS, WORTH = 4096, 1024, 2048
#: What rounding may add to a distance.
SLACK = 1e-6


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarities of two sets of vectors (a distance is taken negative).  Components are added one after the other in double
    precision, so a score is the same wherever its vectors stand, and that of any plain loop over them: scores that differ
    in their last digit alone keep their order."""
    out = np.zeros((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    for lo in range(0, len(a), ROWS):
        some, sums = a[lo : lo + ROWS], out[lo : lo + ROWS]
        for x, y in zip(some.T, columns, strict=True):
            term = np.subtract.outer(x, y) if metric == "l2" else np.multiply.outer(x, y)
            sums += np.multiply(term, term, out=term) if metric == "l2" else term
    if metric == "l2":
        return -np.sqrt(out)
    if metric == "cosine":
        n = np.sqrt(np.multiply.outer(squares(a), squares(b)))
        out = np.clip(np.divide(out, n, out=np.zeros_like(out), where=n > 0), -1, 1)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """Squared lengths, component by component."""
    out = np.zeros(len(x))
    for c in x.T:
        out += c * c
    return out


def pack(batch: pa.RecordBatch, key: str, vec: Sequence[str], kinds: Sequence[str], more: Sequence[str]) -> pa.RecordBatch:
    """A batch's (key, each vector as little-endian floats, *more), without vectors that cannot be compared."""
    good, out = np.ones(batch.num_rows, bool), [batch.column(key)]
    for v, kind in zip(vec, kinds, strict=True):
        lists = batch.column(v)
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
        ends = np.concatenate([[0], np.cumsum(length)])
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])[ends]
        good &= (length > 0) & (odd[1:] == odd[:-1])
        at = pa.py_buffer((ends * values.itemsize).astype(np.int32).tobytes())
        out.append(pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, at, pa.py_buffer(values.tobytes())]))
    return pa.record_batch([*out, *[batch.column(c) for c in more]], names=[key, *vec, *more]).filter(pa.array(good))


def plain(rows: DataFrame, key: str, vec: Sequence[str], more: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(key, *vec, each of ``more`` as a double, null as NaN) of rows with a key, and the width of each vector's floats."""
    each = [F.col(key).cast("long").alias(key), *vec, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in more]]
    return rows.where(F.col(key).isNotNull()).select(*each), [width(rows, v) for v in vec]


def packed(rows: DataFrame, key: str, vec: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """(key, each vector as little-endian floats of its own width, *more as doubles)."""
    rows, kinds = plain(rows, key, vec, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pack(batch, key, vec, kinds, more)

    schema = ", ".join([f"{key} long", *[f"{v} binary" for v in vec], *[f"{c} double" for c in more]])
    return rows.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows or less."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def width(rows: DataFrame, vec: str) -> str:
    return "<f4" if isinstance(rows.schema[vec].dataType.elementType, FloatType) else "<f8"


def matrix(raw: Sequence[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length as rows of doubles."""
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centers_of(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Centers of a sample by Lloyd's rounds; the first ones are spread over it."""
    centers = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(rounds if count > 1 else 1):
        near = nearest(sample, centers)[0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=count)[:, None]
        centers = np.where(n > 0, sums / np.maximum(n, 1), centers)
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (centers**2).sum(1)[None] - 2 * (x @ centers.T)
    return np.sqrt(np.maximum(square, 0))


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, centers)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


@dataclass
class Index:
    """Cells of a gallery: ``blocks`` has (cell, block, g_ids, g_<vector>, g_<column>) with a list of each, and of each cell
    the numbers of its blocks and vectors and the range of distances to its center."""

    blocks: DataFrame
    vec: list[str]
    kinds: list[str]
    more: list[str]
    metric: str
    centers: np.ndarray | None
    n_blocks: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(gallery: DataFrame, key: str, vec: Sequence[str] = ("vec",), more: Sequence[str] = (), metric: str = "cosine", cells: int | None = None, within: str | None = None) -> Index:
    """The index of a gallery (key, *vec, *more).  Cells are formed for one vector column and a metric of distances; with
    several, or the inner product, there is one cell.  ``within`` names one of ``more``, whose values are dealt to CELLS cells."""
    rows, kinds = packed(gallery, key, vec, more), [width(gallery, v) for v in vec]
    n = gallery.count()
    count = cells or n // WORTH
    centers, low, high = None, np.zeros(1), np.zeros(1)
    if within:
        # The cells' sizes need no vector.
        each = {r[0]: r[1] for r in gallery.where(F.col(within).isNotNull()).groupBy(cell_of(F.col(within))).count().collect()}
        sizes = np.array([each.get(c, 0) for c in range(CELLS)])
        assigned = rows.where(~F.isnan(within)).withColumn("cell", cell_of(F.col(within)).cast("int"))
    elif len(vec) > 1 or metric == "dot" or count <= 1:
        sizes, assigned = np.array([n]), rows.withColumn("cell", F.lit(0))
    else:
        some = rows.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(max(1, n // SAMPLE))) == 0).select(vec[0]).limit(2 * SAMPLE).toPandas()[vec[0]].tolist()
        lengths = [len(x) for x in some]
        usual = max(set(lengths), key=lambda k: (lengths.count(k), k)) if lengths else 8
        sample = matrix([x for x in some if len(x) == usual], kinds[0]) if some else np.zeros((1, 1))
        sample = unit(sample) if metric == "cosine" else sample
        centers = centers_of(sample, max(1, min(CELLS, len(sample), count)))
        assigned = stages.stage(_assigned(rows.where(F.length(vec[0]) == usual), key, vec[0], more, kinds[0], centers, metric), "cells")
        # One row for each cell, CELLS at most.
        stats = {r["cell"]: r for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()}
        sizes, low, high = (np.array([stats[c][x] if c in stats else 0 for c in range(len(centers))]) for x in ("n", "low", "high"))
    n_blocks = -(-sizes // BLOCK)
    block = F.pmod(F.xxhash64(key), F.element_at(F.lit([max(1, int(x)) for x in n_blocks]), F.col("cell") + 1)).cast("int").alias("block")
    named = {"ids": key} | {v: v for v in vec} | {c: c for c in more}
    blocks = assigned.select("cell", block, *[F.col(c).alias(f"g_{x}") for x, c in named.items()]).groupBy("cell", "block").agg(*[F.collect_list(f"g_{x}").alias(f"g_{x}") for x in named])
    return Index(blocks, [*vec], kinds, [*more], metric, centers, n_blocks, sizes, low, high)


def _assigned(rows: DataFrame, key: str, vec: str, more: Sequence[str], kind: str, centers: np.ndarray, metric: str) -> DataFrame:
    names = [key, vec, *more, "cell", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                x = matrix(batch.column(vec).to_pylist(), kind)
                cell, d = nearest(unit(x) if metric == "cosine" else x, centers)
                yield pa.record_batch([*[batch.column(c) for c in names[:-2]], pa.array(cell.astype(np.int32)), pa.array(d)], names=names)

    return rows.mapInArrow(run, ", ".join([f"{key} long", f"{vec} binary", *[f"{c} double" for c in more], "cell int", "d double"]))


def cell_of(value: Column) -> Column:
    """The cell of a value of ``within``."""
    return F.pmod(F.xxhash64(value.cast("double")), F.lit(CELLS))


#: Which cells each query visits: (queries' vectors as rows, their columns) -> bool[query, cell].
Choose = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]


def _first(index: Index, k: int) -> Choose:
    """The cells around a query, from the nearest on, that hold more than ``k`` vectors."""
    centers, sizes, metric = index.centers, index.sizes, index.metric

    def choose(x: np.ndarray, _: dict[str, np.ndarray]) -> np.ndarray:
        if centers is None:
            return np.ones((len(x), len(sizes)), bool)
        order = distances(unit(x) if metric == "cosine" else x, centers).argsort(axis=1)
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before <= k, axis=1)
        return out

    return choose


def _reached(index: Index, radius: str) -> Choose:
    """The cells that reach within the radius around a query (NaN: all cells)."""
    centers, low, high, metric = index.centers, index.low, index.high, index.metric

    def choose(x: np.ndarray, of_query: dict[str, np.ndarray]) -> np.ndarray:
        if centers is None:
            return np.ones((len(x), len(high)), bool)
        d, r = distances(unit(x) if metric == "cosine" else x, centers), of_query[radius][:, None] + SLACK
        none = np.linalg.norm(x, axis=1)[:, None] == 0 if metric == "cosine" else False
        return np.isnan(r) | none | ((d - high[None] <= r) & (low[None] - d <= r))

    return choose


def everywhere(x: np.ndarray, of_query: dict[str, np.ndarray]) -> np.ndarray:
    return np.ones((len(x), 1), bool)


def own_cell(index: Index, column: str) -> Choose:
    """The one cell that a column of the query names."""
    count = len(index.sizes)
    return lambda x, of_query: np.arange(count)[None] == of_query[column][:, None]


def radius_of(score: Column, metric: str) -> Column:
    """The distance at which a hit has a score: between unit vectors for cosines."""
    return -score if metric == "l2" else F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * score))


def meet(queries: DataFrame, key: str, index: Index, choose: Choose, reduce: Callable[..., pd.DataFrame], schema: str, of_query: Sequence[str] = ()) -> DataFrame:
    """What ``reduce(qids, gids, [scores by each vector], query columns, gallery columns)`` makes of every meeting of some queries
    (key, *vectors, *of_query) with a block of a cell that they choose.  No vector meets itself: the score of a gid with its
    equal qid is -inf."""
    vec, metric, more, of_query = index.vec, index.metric, index.more, [*of_query]
    q_kinds, g_kinds = [width(queries, v) for v in vec], index.kinds

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                qid, gid, every = np.frombuffer(row["q_ids"], "<i8"), np.asarray(row["g_ids"]), []
                for v, qk, gk in zip(vec, q_kinds, g_kinds, strict=True):
                    every.append(met(qid, gid, row[f"q_{v}"], row[f"g_{v}"], qk, gk, metric))
                yield reduce(qid, gid, every, {c: np.frombuffer(row[f"q_{c}"], "<f8") for c in of_query}, {c: np.asarray(row[f"g_{c}"]) for c in more})

    return visits(queries, key, index, choose, of_query).mapInPandas(together, schema)


def met(qid: np.ndarray, gid: np.ndarray, q_vec: bytes, g_vec: Sequence[bytes], q_kind: str, g_kind: str, metric: str) -> np.ndarray:
    """Scores of some queries with a block."""
    s = scores(np.frombuffer(q_vec, q_kind).reshape(len(qid), -1).astype(float), matrix(list(g_vec), g_kind), metric)
    s[qid[:, None] == gid[None]] = -np.inf
    return s


def visits(queries: DataFrame, key: str, index: Index, choose: Choose, of_query: Sequence[str] = ()) -> DataFrame:
    """Rows of up to CHUNK queries (cell, q_ids, q_<vector>, q_<column>), each with a block that they choose; ``row`` is the number
    of the queries' row, from 2^33 times its partition on."""
    vec, sizes, of_query = index.vec, index.sizes, [*of_query]
    q_kinds = [width(queries, v) for v in vec]
    names = ["cell", "q_ids", *[f"q_{v}" for v in vec], *[f"q_{c}" for c in of_query]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = pack(batch, key, vec, q_kinds, of_query)
            if not batch.num_rows:
                continue
            raw = [np.array(batch.column(v).to_pylist(), object) for v in vec]
            # Vectors of one length go together; those of another one than the centers' meet nothing.
            length = np.array([len(x) for x in raw[0]])
            keep = np.flatnonzero(length == (index_dim * np.dtype(q_kinds[0]).itemsize if index_dim else length[0]))
            if not len(keep):
                continue
            columns = {c: batch.column(c).to_numpy()[keep] for c in of_query}
            visits = choose(matrix(raw[0][keep].tolist(), q_kinds[0]), columns) & (sizes > 0)[None]
            ids, out = batch.column(key).to_numpy()[keep], {n: [] for n in names}
            for cell in np.flatnonzero(visits.any(axis=0)):
                some = np.flatnonzero(visits[:, cell])
                for lo in range(0, len(some), CHUNK):
                    part = some[lo : lo + CHUNK]
                    out["cell"].append(cell)
                    out["q_ids"].append(ids[part].astype("<i8").tobytes())
                    for v, x in zip(vec, raw, strict=True):
                        out[f"q_{v}"].append(b"".join(x[keep[part]].tolist()))
                    for c in of_query:
                        out[f"q_{c}"].append(columns[c][part].astype("<f8").tobytes())
            yield pa.record_batch([pa.array(out["cell"], pa.int32()), *[pa.array(out[n], pa.binary()) for n in names[1:]]], names=names)

    index_dim = None if index.centers is None else index.centers.shape[1]
    dealt = plain(queries, key, vec, of_query)[0].mapInArrow(deal, ", ".join(["cell int", *[f"{n} binary" for n in names[1:]]]))
    last = F.element_at(F.lit([int(x) for x in index.n_blocks]), F.col("cell") + 1) - 1
    every = dealt.withColumn("row", F.monotonically_increasing_id()).select("*", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    # Spark's estimate knows nothing of the blocks that a row is repeated for, so it would broadcast visits of any size.
    return every.hint("merge").join(index.blocks, ["cell", "block"])


def top_k(queries: DataFrame, gallery: DataFrame, k: int, metric: str = "cosine", cells: int | None = None) -> DataFrame:
    """(qid, gid, score, rank): the first ``k`` of the gallery (gid, vec) for each query (qid, vec), best first and ties by gid."""
    index = build(gallery, "gid", metric=metric, cells=cells)

    def best(qid, gid, every, _, __):  # noqa: ANN001, ANN202
        top = min(k, len(gid))
        order = np.stack([np.lexsort((gid, -s))[:top] for s in every[0]])
        out = pd.DataFrame({"qid": np.repeat(qid, top), "gid": gid[order].ravel(), "score": np.take_along_axis(every[0], order, 1).ravel()})
        return out[np.isfinite(out["score"])]

    schema, rank = "qid long, gid long, score double", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "gid"))
    first = meet(queries, "qid", index, _first(index, k), best, schema).withColumn("rank", rank).where(F.col("rank") <= k)
    if index.centers is None or len(index.centers) == 1:
        return first
    first = stages.stage(first, "first-hits")
    worst = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("s")).select("qid", radius_of(F.col("s"), metric).alias("radius"))
    near, far = _first(index, k), _reached(index, "radius")
    rest = meet(queries.join(worst, "qid", "left"), "qid", index, lambda x, c: far(x, c) & ~near(x, c), best, schema, ["radius"])
    return first.drop("rank").unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k)


def ranked_all(queries: DataFrame, gallery: DataFrame, metric: str = "cosine") -> DataFrame:
    """(qid, gid, score, rank): the whole gallery (gid, vec) for each query (qid, vec), best first and ties by gid.

    Queries are dealt evenly to groups, so many that a task can hold the scores of one (HELD).  A group's task meets every block,
    one after the other, and then ranks its queries; the gallery is shuffled once for each group, and pairs are not."""
    index, asked = build(gallery, "gid", metric=metric, cells=1), queries.count()
    kind, g_kind = width(queries, "vec"), index.kinds[0]
    most = max(1, min(CHUNK, HELD // (8 * max(1, int(index.sizes.sum())))))
    groups = max(1, -(-asked // most), min(asked, 2 * queries.sparkSession.sparkContext.defaultParallelism))
    schema = pa.schema([("qid", pa.int64()), ("gid", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, list, list]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                qid, gid = np.frombuffer(batch.column("q_ids")[i].as_py(), "<i8"), batch.column("g_ids")[i].values.to_numpy()
                _, gids, every = held.setdefault(batch.column("row")[i].as_py(), (qid, [], []))
                gids.append(gid)
                every.append(met(qid, gid, batch.column("q_vec")[i].as_py(), batch.column("g_vec")[i].as_py(), kind, g_kind, metric))
        for qid, gids, every in held.values():
            gid = np.concatenate(gids)
            by_id = np.argsort(gid, kind="stable")
            gid, step = gid[by_id], max(1, ROWS_OUT // len(gid))
            for lo in range(0, len(qid), step):
                s = np.concatenate([x[lo : lo + step] for x in every], axis=1)[:, by_id]
                order = np.argsort(-s, axis=1, kind="stable")
                s = np.take_along_axis(s, order, 1)
                good = np.isfinite(s)
                rank, ids_of = np.cumsum(good, axis=1, dtype=np.int32)[good], np.repeat(qid[lo : lo + step], good.sum(axis=1))
                yield pa.record_batch([pa.array(ids_of), pa.array(gid[order][good]), pa.array(s[good]), pa.array(rank)], schema=schema)

    rows = visits(queries.select("qid", "vec").repartition(groups), "qid", index, everywhere).select("row", "q_ids", "q_vec", "g_ids", "g_vec")
    return rows.repartitionById(groups, F.shiftright("row", 33).cast("int")).mapInArrow(run, "qid long, gid long, score double, rank int")


def count_ahead(queries: DataFrame, gallery: DataFrame, metric: str = "cosine", cells: int | None = None) -> DataFrame:
    """(qid, n): how many of the gallery (gid, vec) come before the hit (score, hit) of a query (qid, vec, score, hit), by score
    and then gid; queries without a hit have no row."""
    index = build(gallery, "gid", metric=metric, cells=cells)
    reached = _reached(index, "radius")

    def ahead(qid, gid, every, of_query, _):  # noqa: ANN001, ANN202
        s, at = every[0], of_query["score"][:, None]
        g = ((of_query["high"].astype(np.int64) << 32) + of_query["low"].astype(np.int64))[:, None]
        return pd.DataFrame({"qid": qid, "n": ((s > at) | ((s == at) & (gid[None] < g))).sum(axis=1)})

    # A double holds either half of an id.
    halves = {"high": F.shiftright("hit", 32), "low": F.col("hit").bitwiseAND(F.lit(0xFFFFFFFF))}
    asked = queries.where("score IS NOT NULL AND hit IS NOT NULL").withColumns({"radius": radius_of(F.col("score"), metric)} | halves)
    found = meet(asked, "qid", index, reached, ahead, "qid long, n long", ["score", "high", "low", "radius"]).groupBy("qid").agg(F.sum("n").alias("n"))
    return asked.select("qid").join(found, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
