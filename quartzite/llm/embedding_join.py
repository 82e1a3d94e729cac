"""Near-duplicate vectors by cosine: int8 tile products with error bounds.

Equal vectors are one vector with a count from the start. The others are unit vectors x, stored as
scale * q with q of int8, and their error |x - scale * q| is known for each. Blocks of vectors are
multiplied tile by tile in the quantised form (sums of int8 products are exact in float32 up to
1,000 dimensions); for vectors with errors e and f the product is off by at most e + f + e * f.
Where that settles on which side of the threshold a pair lies, it is settled; only the pairs in
between are computed again in double precision. Blocks travel in groups of about the root of their
number, bounded by bytes, so a block is sent to as many tasks as there are groups near it, not blocks;
a task works through the tiles of two groups and returns sums of links and a spanning
forest of its links, never its pairs.

Blocks keep to regions: every vector belongs to the nearest of a bounded number of pivots, and
blocks of two regions meet only if the angle between the pivots, less both regions' largest
angles, is within the threshold's angle. On vectors without regions, such as random ones, that
prunes nothing, and the work grows with the square of the number of distinct vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths link with nothing of another length; a row with a null
id links with nothing and has a null component; repeated ids give a row each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and an upper bound of each row's error."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _nearest(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cos = unit(_matrix(b.column(2))) @ pivots.T
            best = cos.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(cos[np.arange(len(best)), best])], ["id", "copies", "v", "region", "cosine"])

    return run


def _pack(group: pa.Table) -> pa.Table:
    g = group.sort_by("id")
    raw = _matrix(g["v"])
    q, scale, error = quantised(unit(raw))
    blob = [x.tobytes() for x in (g["id"].to_numpy(), g["copies"].to_numpy(), q, scale, error, raw.astype(np.float64) if raw.dtype != np.float32 else raw)]
    return pa.table({"block": g["block"][:1], "dim": pa.array([raw.shape[1]], pa.int32()), "wide": pa.array([raw.dtype != np.float32]), **{n: pa.array([x], pa.binary()) for n, x in zip(("ids", "copies", "q", "scale", "error", "raw"), blob, strict=True)}})


BLOCK = "block long, dim int, wide boolean, ids binary, copies binary, q binary, scale binary, error binary, raw binary"


class _Block:
    def __init__(self, row: dict) -> None:
        self.ids, self.copies = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64)
        n, dim = len(self.ids), row["dim"]
        self.q = np.frombuffer(row["q"], np.int8).reshape(n, dim)
        self.scale, self.error = np.frombuffer(row["scale"], np.float64), np.frombuffer(row["error"], np.float64)
        self.raw = np.frombuffer(row["raw"], np.float64 if row["wide"] else np.float32).reshape(n, dim)


def tile_links(a: _Block, b: _Block, same: bool, least: float, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of the linked pairs, a strip of the tile at a time; within one block each pair once."""
    qb = b.q.astype(np.float32).T.copy() if b.q.shape[1] <= 1000 else b.q.astype(np.float64).T.copy()
    slack = 1e-6
    for s in range(0, len(a.ids), rows):
        qa = a.q[s : s + rows].astype(qb.dtype)
        near = (qa @ qb) * (a.scale[s : s + rows, None].astype(np.float32) * b.scale[None, :].astype(np.float32))
        e = a.error[s : s + rows].max() + b.error.max()
        i, j = np.nonzero(near >= least - e - e * e - slack)
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        got = near[i - s, j].astype(np.float64)
        bound = a.error[i] + b.error[j] + a.error[i] * b.error[j] + slack
        link = got - bound >= least
        open_ = np.flatnonzero(~link & (got + bound >= least))
        for t in range(0, len(open_), 1 << 15):
            k = open_[t : t + (1 << 15)]
            x, y = a.raw[i[k]].astype(np.float64), b.raw[j[k]].astype(np.float64)
            cos = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            link[k] = cos >= least
        yield i[link], j[link]


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tiles(least: float):
    """Sums of links and heads of the tiles between two groups of blocks, or within one."""

    def run(group: pa.Table) -> pa.Table:
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        held = [(r["party"] == low, _Block(r)) for r in sorted(group.to_pylist(), key=lambda r: (r["party"] != low, r["block"]))]
        first = np.cumsum([0, *[len(b.ids) for _, b in held]])
        ids, copies = np.concatenate([b.ids for _, b in held]), np.concatenate([b.copies for _, b in held])
        links, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for m, (left, a) in enumerate(held):
            for k in range(m, len(held)) if low == high else [k for k, (is_left, _) in enumerate(held) if left and not is_left]:
                for i, j in tile_links(a, held[k][1], k == m, least):
                    i, j = i + first[m], j + first[k]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    fresh = up[i] != up[j]
                    if fresh.any():
                        up = _labels(len(ids), np.concatenate([i[fresh], np.arange(len(ids))]), np.concatenate([j[fresh], up]))
        out = np.flatnonzero(links)
        return pa.table({"id": ids[out], "links": links[out], "head": ids[up[out]]})

    return run


#: Bytes of the blocks of one group.
PARTY_BYTES = 48 << 20


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, tile: int = 4096, vectors_per_pivot: int = 16384, most_pivots: int = 256) -> DataFrame:
    """One row per row: the id, n_links, component_id, kept."""
    spark = rows.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x + F.lit(0).cast("tinyint"))  # -0.0 is 0.0
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(id_col).isNotNull() & usable(F.col(vector_col)), v).alias("v"))
    distinct = written(every.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")), "vectors")
    links, heads = [], []
    for dim, n in sorted((r["dim"], r["count"]) for r in distinct.groupBy("dim").count().collect()):
        one = distinct.where(F.col("dim") == dim).select("id", "copies", "v")
        pivots = min(most_pivots, max(1, -(-n // vectors_per_pivot)))
        chosen = one.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").toArrow()
        if not chosen.num_rows:
            continue
        middle = unit(_matrix(chosen["v"]))
        kind = one.schema["v"].dataType.simpleString()
        placed = written(one.mapInArrow(_nearest(middle), f"id long, copies long, v {kind}, region int, cosine double"), "vectors-placed")
        region = {r["region"]: (r["n"], math.acos(max(-1.0, min(1.0, r["c"])))) for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("c")).collect()}
        meet = [(p, q) for p in region for q in region if math.acos(max(-1.0, min(1.0, float(middle[p] @ middle[q])))) - region[p][1] - region[q][1] <= math.acos(least) + 1e-6]
        sizes = spark.createDataFrame([(p, -(-m // tile)) for p, (m, _) in region.items()], "region int, parts long")
        blocked = placed.join(F.broadcast(sizes), "region").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")))  # at most most_pivots rows
        blocked = blocked.withColumn("block", F.col("region").cast("long") * (1 << 32) + F.col("part"))
        blocks = written(blocked.select("block", "id", "copies", "v").groupBy("block").applyInArrow(_pack, BLOCK), "vector-blocks")
        count = sum(-(-m // tile) for m, _ in region.values())
        together = max(1, min(math.ceil(math.sqrt(count)), PARTY_BYTES // (tile * (6 * dim + 32))))
        party = (F.col("region").cast("long") * (1 << 32) + F.floor(F.col("part") / together)).alias("party")
        names = blocks.select("block", F.floor(F.col("block") / (1 << 32)).cast("int").alias("region"), (F.col("block") % (1 << 32)).alias("part")).select("block", "region", party)
        parties = names.select("party", "region").distinct()
        near = spark.createDataFrame(meet, "region int, region_2 int")
        pairs = parties.join(F.broadcast(near), "region").join(parties.select(F.col("party").alias("other"), F.col("region").alias("region_2")), "region_2")
        tiles = written(pairs.select("party", F.least("party", "other").alias("low"), F.greatest("party", "other").alias("high")), "vector-tiles", small=True)
        sent = names.select("block", "party").join(tiles, "party")
        found = blocks.join(sent, "block").groupBy("low", "high").applyInArrow(_tiles(least), "id long, links long, head long")
        found = written(found, "vector-links")
        links.append(found)
        heads.append(found.select(F.col("id").alias("a"), F.col("head").alias("b")))
    if not links:
        label = distinct.select("v", F.lit(0).cast("long").alias("links"), "copies", F.col("id").alias("component"))
    else:
        total, edges = links[0], heads[0]
        for x, y in zip(links[1:], heads[1:], strict=True):
            total, edges = total.union(x), edges.union(y)
        total = total.groupBy("id").agg(F.sum("links").alias("links"))
        joined = distinct.join(total, "id", "left").join(components(edges), "id", "left")
        label = joined.select("v", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("component", "id").alias("component"))
    done = every.join(written(label, "vector-labels", small=True), "v", "left")
    component = F.coalesce("component", "id")
    return done.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
