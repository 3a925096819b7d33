"""Integer centroid clustering with PCA-rotated filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import stored

#: Components in integer units beyond this would overflow 64-bit squared distances; such vectors are not clustered.
LARGEST = 1 << 27
#: Rows that a task looks at in one go.
BLOCK = 4096
#: Bound on the rounding of projected distances, as a share of the squared lengths involved.
SLACK = 1e-9

POINTS = "id string, vec array<long>, lead array<double>, rest double"


def in_units(vec, width: int, units: int):
    """Integer components of a vector, null if it has another width or a component is null, not finite or too large."""
    whole = F.transform(vec, lambda x: F.floor(F.lit(float(units)) * x))
    fits = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * units < LARGEST))
    return F.when((F.size(vec) == width) & F.coalesce(fits, F.lit(False)), F.transform(whole, lambda x: x.cast("long")))


class Rotation:
    """Turn to principal axes: points are kept as the first coordinates along them and the norm of what remains.

    For two points, the squared distance of the first coordinates plus the squared difference of the remaining norms
    is a lower bound of their squared distance, by the triangle inequality in the remaining space.
    """

    def __init__(self, mean, axes, lead: int):
        self.mean, self.axes, self.lead = mean, axes, lead

    @classmethod
    def fit(cls, points: DataFrame, width: int, share: float) -> Rotation:
        """Axes of the covariance of all rows; as many leading ones as carry ``share`` of the variance.

        Tasks send sums for each pair of components, which are added per pair: width times width + 1 numbers come back.
        """
        import numpy as np

        def sums(batches):
            import numpy as np
            import pandas as pd

            total = np.zeros((width + 1, width + 1))
            for b in batches:
                for at in range(0, len(b), BLOCK):
                    x = np.stack(b["vec"].iloc[at : at + BLOCK].to_numpy()).astype(float)
                    x = np.column_stack([x, np.ones(len(x))])
                    total += x.T @ x
            if total[-1, -1]:
                yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

        cells = points.select("vec").mapInPandas(sums, "cell int, value double").groupBy("cell").agg(F.sum("value"))
        total = np.zeros((width + 1) ** 2)
        for cell, value in cells.collect():
            total[cell] = value
        total = total.reshape(width + 1, width + 1)
        count = max(1.0, total[-1, -1])
        mean = total[-1, :-1] / count
        values, axes = np.linalg.eigh(total[:-1, :-1] / count - np.outer(mean, mean))
        values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
        covered = np.cumsum(values) / max(values.sum(), 1e-300)
        return cls(mean, axes, int(min(width, 1 + np.searchsorted(covered, share))))

    def turned(self, x):
        """Leading coordinates and remaining norms of rows."""
        import numpy as np

        y = (x - self.mean) @ self.axes
        return y[:, : self.lead], np.sqrt((y[:, self.lead :] ** 2).sum(1))


def nearest(vec, lead, rest, centers, center_lead, center_rest):
    """Number and squared distance of each row's nearest center; among equals the smallest number.

    The center with the least bound is measured first. Others are measured only where their bound does not exceed that
    distance. Distances are integers, so rounding can let a center through in vain but never keeps one out.
    """
    import numpy as np

    bound = np.square(rest[:, None] - center_rest[None, :])
    for d in range(lead.shape[1]):
        bound += np.square(lead[:, d, None] - center_lead[None, :, d])
    size = (lead * lead).sum(1) + rest * rest
    loose = SLACK * (size[:, None] + (center_lead * center_lead).sum(1) + center_rest * center_rest + 1)
    first = bound.argmin(1)
    best = np.square(vec - centers[first]).sum(1)
    number = first.copy()
    survives = bound - loose <= best[:, None]
    survives[np.arange(len(vec)), first] = False
    for c in range(len(centers)):
        rows = np.flatnonzero(survives[:, c])
        if not len(rows):
            continue
        far = np.square(vec[rows] - centers[c]).sum(1)
        wins = (far < best[rows]) | (far == best[rows]) & (c < number[rows])
        best[rows[wins]], number[rows[wins]] = far[wins], c
    return number, best


def assigner(rotation: Rotation, centers: list[list[int]]):
    """A function of a pandas batch of points that yields blocks ``(ids, vectors, numbers, distances)``."""
    import numpy as np

    whole = np.array(centers, np.int64).reshape(len(centers), -1)
    center_lead, center_rest = rotation.turned(whole.astype(float))

    def assign(batch):
        for at in range(0, len(batch), BLOCK):
            part = batch.iloc[at : at + BLOCK]
            vec = np.stack(part["vec"].to_numpy())
            lead = np.stack(part["lead"].to_numpy())
            yield part, vec, *nearest(vec, lead, part["rest"].to_numpy(), whole, center_lead, center_rest)

    return assign


def moved(points: DataFrame, rotation: Rotation, centers: list[list[int]]) -> list[list[int]]:
    """Exact floors of the means of all clusters; an empty cluster stays where it is.

    A task sends one row of sums per cluster and component, so the shuffle has no more than that for each task.
    """
    width = len(centers[0])

    def sums(batches):
        import numpy as np
        import pandas as pd

        total = np.zeros((len(centers), width + 1), np.int64)
        assign = assigner(rotation, centers)
        for b in batches:
            for _, vec, number, _ in assign(b):
                for c in np.unique(number):
                    rows = vec[number == c]
                    total[c, :width] += rows.sum(0)
                    total[c, width] += len(rows)
        if total[:, width].any():
            cluster, part = np.indices(total.shape)
            yield pd.DataFrame({"cluster": cluster.ravel(), "part": part.ravel(), "value": total.ravel()})

    cells = points.mapInPandas(sums, "cluster int, part int, value long")
    cells = cells.groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")))
    total = {(r[0], r[1]): int(r[2]) for r in cells.collect()}  # clusters times width + 1 numbers
    return [
        [total[c, d] // total[c, width] for d in range(width)] if total.get((c, width)) else old
        for c, old in enumerate(centers)
    ]


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    width: int = 64,
    clusters: int = 8,
    rounds: int = 10,
    units: int = 1024,
    seed: int = 3,
    share: float = 0.9,
) -> DataFrame:
    """Lloyd's clustering in integers: one row per vector of ``width`` finite components.

    Components become ``floor(units * x)``. Centers start as the vectors with the smallest SHA-256 of ``seed:id`` and
    move to the floors of their clusters' means in ``rounds`` rounds; then all vectors are assigned once more. Gives
    ``(id, cluster, distance, cluster_inertia, inertia, center)``, distances squared.

    Vectors that are null, of another width, with null or non-finite components, or with a component of 2^27 units or
    more are left out. Every row counts, also if its id or its vector is repeated; a null id counts as an empty text in
    the hash, and rows with equal hashes are taken by their components. With fewer vectors than ``clusters`` there are
    as many centers as vectors. An empty table gives no rows. Equal distances go to the smaller number. Inertias beyond
    64 bits are null. Only the id and the vector of ``vectors`` are read.
    """
    spark = vectors.sparkSession
    vec = in_units(F.transform(F.col(vec_col), lambda x: x.cast("double")), width, units)
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter("vec is not null")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centers = [list(r.vec) for r in whole.select("vec", order.alias("h")).orderBy("h", "vec").limit(clusters).collect()]
    empty = spark.createDataFrame(
        [], "id long, cluster int, distance long, cluster_inertia long, inertia long, center array<long>"
    ).withColumnRenamed("id", id_col)
    if not centers:
        return empty
    rotation = Rotation.fit(whole, width, share)

    def turn(batches):
        import numpy as np

        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at : at + BLOCK]
                lead, rest = rotation.turned(np.stack(part["vec"].to_numpy()).astype(float))
                yield part.assign(lead=list(lead), rest=rest)

    points = stored(keyed(whole).mapInPandas(turn, POINTS), "points")
    for _ in range(rounds):
        centers = moved(points, rotation, centers)

    def last(batches):
        assign = assigner(rotation, centers)
        for b in batches:
            for part, _, number, far in assign(b):
                yield part[["id"]].assign(cluster=number, distance=far)

    found = stored(points.mapInPandas(last, "id string, cluster int, distance long"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = sum(int(r.total) for r in sums)  # a row per cluster
    fits = lambda n: n if n < 1 << 63 else None
    told = spark.createDataFrame(
        [(r.cluster, fits(int(r.total)), fits(inertia), centers[r.cluster]) for r in sums],
        "cluster int, cluster_inertia long, inertia long, center array<long>",
    )
    # At most one row per cluster, whose number is an argument.
    out = found.join(F.broadcast(told), "cluster").withColumn(id_col, F.col("id").cast("long"))
    return out.select(*empty.columns)


def keyed(rows: DataFrame) -> DataFrame:
    """Ids as text, since pandas turns a column of longs with nulls into doubles."""
    return rows.withColumn("id", F.col("id").cast("string"))


def center_digest(found: DataFrame) -> DataFrame:
    """Replaces the center by the digest of its components in decimal."""
    text = F.array_join(F.transform("center", lambda x: x.cast("string")), ",")
    return found.withColumn("centroid_sha256", F.sha2(text, 256)).drop("center")
