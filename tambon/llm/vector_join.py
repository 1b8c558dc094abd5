"""Exact range join of unit vectors by pivots: all pairs of one label with cosine >= a threshold.

On unit vectors, cosine >= c means distance <= r = sqrt(2 - 2c). Each (label, length of vector) gets
pivots, a bounded sample; a vector's home is the cell of its nearest pivot p. If y lives in the cell of q and
d(x, y) <= r, the triangle inequality gives d(x, q) <= d(x, p) + 2r, d(x, q) <= r + the radius of q's cell, and
x is within r of the plane halfway between p and q. A vector visits the cells after its own that pass these
tests, so each pair of vectors meets in just one cell, and cells are joined independently.
Cells are dealt to blocks of BLOCK rows; a task multiplies two blocks. Tasks return, for each
vector, its number of links and the least vector it is linked with there, not pairs.

Equal vectors of a label are one class with a weight. Links are confirmed in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with
nothing: a component of their own; vectors of different lengths are not compared; null ids take part and
get a component id only from others; repeated ids are rows of their own that share what their id is linked
with; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import components
from .shared import only, read_table, stored

LEAST_COSINE = 0.98
CELL = 1000
PIVOTS = 4096
GROUPS = 4096
BLOCK = 1024
SLACK = 1e-9


def _unit(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a square boolean matrix, the least row it is connected with."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def range_links(vectors: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """From (vec_id, embedding, label): vec_id, n_links, component_id, kept, a row for each row."""
    spark = vectors.sparkSession
    rows = only(vectors, vec_id="long", embedding="array<double>", label="int")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = stored(rows.withColumn("good", good).withColumn("vec", F.when(F.col("good"), F.transform("embedding", lambda x: F.when(x == 0, 0.0).otherwise(x)))).drop("embedding"), "vectors")
    classes = rows.where("good").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("dim", F.size("vec")).withColumn("key", F.xxhash64("label", "vec")).withColumn("key2", F.hash("vec", "label")).withColumn("id", F.pmod(F.col("key"), F.lit(1 << 62))), "classes")
    if not classes.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("two vectors share a 62-bit hash")
    r = float(np.sqrt(2 - 2 * least_cosine)) + SLACK
    # A bounded number of pivots for each group; groups beyond GROUPS have one cell each, which blocks split.
    sizes = classes.groupBy("label", "dim").count().orderBy(F.desc("count"), "label", "dim").limit(GROUPS).collect()
    total = sum(s["count"] for s in sizes)
    wanted = {(s.label, s.dim): max(1, min(s["count"] // CELL, PIVOTS * s["count"] // max(1, total))) for s in sizes}
    wanted = {k: n for k, n in wanted.items() if n > 1}
    share = {(s.label, s.dim): min(1.0, 2 * wanted[s.label, s.dim] / s["count"]) for s in sizes if (s.label, s.dim) in wanted}
    pivots: dict[tuple[int, int], np.ndarray] = {}
    if wanted:
        rates = spark.createDataFrame([(k[0], k[1], v) for k, v in share.items()], "label int, dim int, rate double")
        picked = classes.join(F.broadcast(rates), ["label", "dim"]).where(F.pmod("key2", F.lit(1 << 20)) < F.col("rate") * (1 << 20))
        for row in picked.orderBy("key2", "id").select("label", "dim", "vec").toLocalIterator():
            pivots.setdefault((row.label, row.dim), []).append(row.vec)
        pivots = {k: np.array(v[: wanted[k]]) for k, v in pivots.items()}
        pivots = {k: v / np.linalg.norm(v, axis=1, keepdims=True) for k, v in pivots.items()}
    held = spark.sparkContext.broadcast(pivots)

    def distances(batch: pa.RecordBatch):
        """(rows, group, distances to its pivots or None) for each group in a batch."""
        label, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for k in sorted(set(zip(label.tolist(), dim.tolist(), strict=True))):
            at = np.flatnonzero((label == k[0]) & (dim == k[1]))
            p = held.value.get(k)
            yield at, k, None if p is None else np.sqrt(np.maximum(0, 2 - 2 * _unit(batch.column(2).take(pa.array(at))) @ p.T))

    def home(batches):
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, _, d in distances(batch):
                if d is not None:
                    cell[at] = d.argmin(axis=1)
                    far[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["label", "dim", "vec", "id", "weight", "cell", "far"])

    kinds = "label int, dim int, vec array<double>, id long, weight long, cell int, far double"
    homes = stored(classes.select("label", "dim", "vec", "id", "weight").mapInArrow(home, kinds), "homes")
    cells = homes.groupBy("label", "dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).where(F.col("cell") >= 0)
    radius = {(c.label, c.dim, c.cell): c.radius for c in cells.where("radius > 0 or cell > 0").limit(2 * PIVOTS + GROUPS).collect()}
    reach = spark.sparkContext.broadcast(radius)

    def visit(batches):
        for batch in batches:
            own = batch.column(5).to_numpy()
            take, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for at, k, d in distances(batch):
                if d is None:
                    continue
                p = held.value[k]
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                mine, near = own[at], d[np.arange(len(at)), own[at]]
                for q in range(len(p)):
                    gap = between[mine, q]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(gap > 0, (d[:, q] ** 2 - near**2) / (2 * gap), 0)
                    go = (mine < q) & (d[:, q] <= near + 2 * r) & (d[:, q] <= r + reach.value.get((*k, q), -10.0)) & (plane <= r)
                    take.append(at[go])
                    to.append(np.full(int(go.sum()), q, np.int32))
            at = pa.array(np.concatenate(take))
            moved = [batch.column(i).take(at) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*moved, pa.array(np.concatenate(to))], names=["label", "dim", "vec", "id", "weight", "cell"])

    visitors = homes.mapInArrow(visit, "label int, dim int, vec array<double>, id long, weight long, cell int")
    here = homes.drop("far").withColumn("guest", F.lit(False)).unionByName(visitors.withColumn("guest", F.lit(True)))
    counted = here.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = here.join(counted, ["label", "dim", "cell"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = mine.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _unit(table.column("vec").combine_chunks() if table.num_rows else table.column("vec"))
        side, ids, weight, guest = (table.column(c).to_numpy() for c in ("mine", "id", "weight", "guest"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        linked = x @ x.T >= least_cosine
        linked &= ~(guest[:, None] & guest[None, :])  # guests meet each other at home
        if i != j:
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        root = roots(linked)
        n = linked @ weight
        some = np.flatnonzero(n)
        return pa.table({"id": pa.array(ids[some]), "n": pa.array(n[some].astype(np.int64)), "root": pa.array(ids[root[some]])})

    met = stored(dealt.select("label", "dim", "cell", "i", "j", "mine", "vec", "id", "weight", "guest").groupBy("label", "dim", "cell", "i", "j").applyInArrow(join, "id long, n long, root long"), "links")
    n_links = met.groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(met.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.select("id", "label", "vec", "least", "weight").join(n_links, "id", "left").join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    done = stored(named.join(least, "c").select(F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "named")
    out = rows.join(done, (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")) & F.col("good"), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_links(read_table(spark, sf_dir, "embeddings"))
