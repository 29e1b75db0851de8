"""Nearest vectors by cosine: k-best lists that merge, over all vectors or over cells with exact bounds."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from oddspark.operators.ranking import top_n_per
from oddspark.sources.versions import Store
from oddspark.workspace import materialize

#: Vectors of one block of either side.
BLOCK = 512
#: How far a product of matrices may be off; nearer candidates are measured one by one.
SLACK = 1e-9
#: Cells around this many sampled vectors at most.
CENTRES = 1024

Batches = Iterator[pa.RecordBatch]


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, all of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame, name: str) -> DataFrame:
    """Rows whose vector has a length: no nulls, not zero, only finite components."""
    wide = F.col(name).cast("array<double>")
    finite = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.withColumn(name, wide).filter(finite & F.exists(name, lambda x: x != 0))


def packed(df: DataFrame, name: str, vector: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of up to ``BLOCK`` neighbouring rows: ids as a list, vectors as one binary value, and ``also``,
    the columns that all rows of a block share. Rows stay in the task that reads them."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            shared = [batch.column(2 + i).to_pylist() for i in range(len(also))]
            groups: dict[tuple, list[int]] = {}
            for i, n in enumerate(vectors.value_lengths().to_pylist()):
                groups.setdefault((n, *[s[i] for s in shared]), []).append(i)
            for key, rows in groups.items():
                for lo in range(0, len(rows), BLOCK):
                    take = pa.array(rows[lo:lo + BLOCK])
                    block = matrix(vectors.take(take))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids.take(take).to_pylist()], pa.list_(ids.type)), pa.array([block.tobytes()]), pa.array([key[0]], pa.int32()),
                         *[pa.array([v], batch.column(2 + i).type) for i, v in enumerate(key[1:])]],
                        [f"{name}s", f"{name}_matrix", f"{name}_width", *also])

    spec = f"{name}s array<{kind[name]}>, {name}_matrix binary, {name}_width int" + "".join(f", `{c}` {kind[c]}" for c in also)
    return df.select(name, vector, *also).mapInArrow(run, spec)


class Best:
    """The k best of each query so far: similarities falling, equal ones by id. Lists of two tasks merge into one."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def offer(self, query, found: list[tuple]) -> None:
        """Merge candidates (-similarity, id) into the query's list, and cut it at k."""
        self.held[query] = sorted(self.held.get(query, []) + found)[:self.k]

    def least(self, query) -> float:
        """What a candidate must reach to come into the list."""
        held = self.held.get(query, ())
        return -held[-1][0] if len(held) == self.k else -np.inf


def met(best: Best, ids: list, a: np.ndarray, queries: list, q: np.ndarray) -> None:
    """Let a block of vectors meet a block of queries."""
    na, nq = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", q, q))
    near = (q @ a.T) / nq[:, None] / na[None, :]
    for j, query in enumerate(queries):
        row, bound = near[j], best.least(query)
        if len(row) > best.k:
            bound = max(bound, float(np.partition(row, -best.k)[-best.k]))
        some = np.flatnonzero(row >= bound - SLACK)
        # Measured one by one, so that equal vectors have equal similarities in any block.
        exact = np.einsum("ij,ij->i", a[some], np.broadcast_to(q[j], (len(some), q.shape[1]))) / (na[some] * nq[j])
        best.offer(query, [(-s, ids[i]) for s, i in zip(exact.tolist(), some.tolist(), strict=True)])


def _k_best(k: int, query_type: pa.DataType, id_type: pa.DataType) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        best = Best(k)
        for batch in batches:
            for r in batch.to_pylist():
                met(best, r["ids"], np.frombuffer(r["id_matrix"]).reshape(-1, r["id_width"]),
                    r["query_ids"], np.frombuffer(r["query_id_matrix"]).reshape(-1, r["query_id_width"]))
        rows = [(query, i, -s) for query, held in best.held.items() for s, i in held]
        for lo in range(0, len(rows), 10000):
            part = list(zip(*rows[lo:lo + 10000], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0], query_type), pa.array(part[1], id_type), pa.array(part[2], pa.float64())],
                ["query_id", "id", "similarity"])

    return run


def _types(df: DataFrame, name: str) -> tuple[str, pa.DataType]:
    kind = df.schema[name].dataType
    return kind.simpleString(), to_arrow_type(kind)


def best_of_blocks(pairs: DataFrame, k: int, ids: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, id, similarity, rank`` from blocks that meet. At most k rows of a query leave a task."""
    (query_kind, query_type), (id_kind, id_type) = _types(queries, "query_id"), _types(ids, "id")
    found = pairs.mapInArrow(_k_best(k, query_type, id_type), f"query_id {query_kind}, id {id_kind}, similarity double")
    return top_n_per(found, "query_id", "similarity", k, "id")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, similarity, rank``: of ``vectors`` (id, embedding) the k nearest of each row of ``queries``
    (query_id, vector), by falling cosine, equal ones by id.

    Exact. Both sides are packed where they lie; blocks of queries meet blocks of vectors of the
    same length, each task keeps k rows of a query and merges as it goes. The vectors are neither
    shuffled nor copied. Vectors that are null, zero or not finite are near to nothing.
    """
    blocks = packed(usable(queries, "vector"), "query_id", "vector")
    pairs = packed(usable(vectors, "embedding"), "id", "embedding").crossJoin(blocks).filter("id_width = query_id_width")
    return best_of_blocks(pairs, k, vectors, queries)


# --- cells -----------------------------------------------------------------------------------


def unit(block: np.ndarray) -> np.ndarray:
    return block / np.sqrt(np.einsum("ij,ij->i", block, block))[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(a) @ unit(b).T, -1.0, 1.0))


def sampled_centres(vectors: DataFrame, width: int, sample: int) -> np.ndarray:
    """A bounded sample of the vectors of one length as centres: those with the smallest hash of their id."""
    rows = usable(vectors, "embedding").filter(F.size("embedding") == width).orderBy(
        F.xxhash64("id"), "embedding").limit(sample).collect()
    return np.array([r["embedding"] for r in rows], float).reshape(-1, width)


def with_cell(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """The vectors of the centres' length with the ``cell`` of the nearest centre and their ``angle`` to it."""
    kind = _types(vectors, "id")[0]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            far = angles(matrix(batch.column(1)), centres)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                ["id", "embedding", "cell", "angle"])

    rows = usable(vectors, "embedding").select("id", "embedding").filter(F.size("embedding") == centres.shape[1])
    return rows.mapInArrow(run, f"id {kind}, embedding array<double>, cell int, angle double")


def cell_bounds(queries: DataFrame, centres: np.ndarray, cells: dict[int, tuple[int, float]]) -> DataFrame:
    """``query_id, vector, cell, least, place``: per query the least angle at which a cell can hold a vector,
    and how many vectors lie in cells with a smaller one. One row per cell, of which there are boundedly many."""
    kind = _types(queries, "query_id")[0]
    numbers = np.array(sorted(cells), np.int32)
    sizes, radii = (np.array([cells[c][i] for c in numbers.tolist()]) for i in (0, 1))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                # An angle to a vector is no less than that to its centre, less the centre's to the vector.
                least = np.maximum(angles(matrix(part.column(1)), centres[numbers]) - radii[None, :] - SLACK, 0.0)
                order = np.argsort(least, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.cumsum(sizes[order], axis=1) - sizes[order], axis=1)
                rows = pa.array(np.repeat(np.arange(len(part)), len(numbers)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.tile(numbers, len(part))),
                     pa.array(least.ravel()), pa.array(place.ravel().astype(np.int64))],
                    ["query_id", "vector", "cell", "least", "place"])

    rows = usable(queries, "vector").select("query_id", "vector").filter(F.size("vector") == centres.shape[1])
    return rows.mapInArrow(run, f"query_id {kind}, vector array<double>, cell int, least double, place bigint")


def best_in_cells(vectors: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The k best of each query among the cells that it wants (query_id, vector, cell)."""
    blocks = packed(wanted.repartition("cell"), "query_id", "vector", ("cell",))
    stored = packed(vectors, "id", "embedding", ("cell",))
    return best_of_blocks(stored.join(blocks, "cell"), k, vectors, wanted)


@dataclass(frozen=True)
class Cells:
    """Stored vectors by cell, the centres, and per cell its number of vectors and largest angle to its centre."""

    vectors: DataFrame
    centres: np.ndarray
    sizes: dict[int, tuple[int, float]]


def write_cells(vectors: DataFrame, store: Store, width: int, sample: int = CENTRES) -> Cells:
    """Sort the vectors of one length into cells around at most ``sample`` of them, and store them by cell.

    Every usable vector is in just one cell. Vectors of other lengths are near to no query of this one.
    """
    centres = sampled_centres(vectors, width, sample)
    if not len(centres):
        raise ValueError(f"no usable vector has {width} components")
    spark = vectors.sparkSession
    rows = spark.createDataFrame(
        [(i, c) for i, c in enumerate(centres.tolist())], "number int, centre array<double>")
    store.change().put("centres", rows).put("cells", with_cell(vectors, centres), by="cell").commit()
    return open_cells(store)


def open_cells(store: Store) -> Cells:
    """The stored cells. The driver gets the centres and one row per cell, of which there are boundedly many."""
    vectors = store.read("cells")
    centres = np.array([r["centre"] for r in store.read("centres").orderBy("number").collect()], float)
    sizes = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("far"))
    return Cells(vectors, centres, {r["cell"]: (r["n"], r["far"]) for r in sizes.collect()})


def nearest_in_cells(cells: Cells, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The same rows as ``nearest``, and ``query_id, n_read``: how many vectors each query was compared with.

    First the cells that may be nearest, until they hold k vectors. The angle of the k-th best of
    those bounds the rest: a cell whose least possible angle is larger can't hold a better one.
    The tables in between are written once, in the shared folder.
    """
    bounds = materialize(cell_bounds(queries, cells.centres, cells.sizes), "cell-bounds")
    first = F.col("place") < k
    begun = materialize(best_in_cells(cells.vectors, bounds.filter(first), k).drop("rank"), "first-cells")
    worst = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("s"))
    reach = worst.filter(F.col("n") >= k).select(
        "query_id", (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s")))) + SLACK).alias("reach"))
    rest = bounds.filter(~first).join(reach, "query_id", "left").filter("reach is null or least <= reach")
    rest = materialize(rest.select("query_id", "vector", "cell"), "further-cells")
    more = best_in_cells(cells.vectors, rest, k).drop("rank")
    best = top_n_per(begun.unionByName(more), "query_id", "similarity", k, "id")
    # One row per cell.
    size = F.create_map(*[F.lit(x) for c, (n, _) in cells.sizes.items() for x in (c, n)])
    read = bounds.filter(first).select("query_id", "cell").unionByName(rest.select("query_id", "cell"))
    return best, read.groupBy("query_id").agg(F.sum(size[F.col("cell")]).alias("n_read"))
