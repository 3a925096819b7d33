"""Embedding near-duplicates by spherical-cap filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import components, group_bounds, paired_chunks, stored, whole_groups

#: Blocks of the product code, rows of a chunk.
BLOCKS, CHUNK = 4, 512
#: Least filters of a vector, share of pairs exactly at the limit that must have one in common, simulated pairs.
PASSED, RECALL, PAIRS = 32, 0.99, 1000


class CapFilters:
    """Random product code: a filter is one code vector from each block of a randomly turned space.

    A vector passes the filters whose directions it exceeds the most: the cut is its own, so vectors with uneven blocks
    pass as many as others. How many follows from the cosine limit and the number of filters: as many as ``RECALL`` of
    simulated pairs with a cosine of ``least`` need to share one, so lists grow with the table and the recall stays.
    """

    def __init__(self, width: int, rows: int, least: float = 0.9, seed: int = 7, length: int | None = None):
        import numpy as np

        draw = np.random.default_rng(seed)
        self.width = width
        self.part = -(-width // BLOCKS)
        full = self.part * BLOCKS
        self.turn = np.linalg.qr(draw.standard_normal((full, full)))[0][:width]
        # As many filters as vectors, or more, keep buckets small; numbers of filters fit 32 bits.
        self.codes = min(200, max(16, int(np.ceil((4 * max(1, rows)) ** (1 / BLOCKS)))))
        book = draw.standard_normal((BLOCKS, self.codes, self.part))
        self.book = book / np.linalg.norm(book, axis=2, keepdims=True)
        self.length = self.needed(least, draw) if length is None else length

    def needed(self, least: float, draw) -> int:
        """Length of lists with which ``RECALL`` of pairs at ``least`` have a filter in common."""
        import numpy as np

        x, y = pairs_at(least, PAIRS, self.width, draw)
        length = 2 * PASSED
        while True:
            need = []
            for a, b in zip(self.best(x, length), self.best(y, length)):
                _, i, j = np.intersect1d(a, b, return_indices=True)
                need.append(np.maximum(i, j).min() + 1 if len(i) else 2 * length)
            found = int(np.quantile(need, RECALL, method="higher"))
            if found <= length:
                return max(PASSED, found)
            if length == self.codes**BLOCKS:
                return length
            length = min(2 * length, self.codes**BLOCKS)

    def scores(self, unit):
        """Products with the code pairs of the first and the last half of the blocks."""
        import numpy as np

        turned = (unit @ self.turn).reshape(len(unit), BLOCKS, self.part)
        s = np.einsum("nbp,bcp->nbc", turned, self.book)
        pair = lambda a, b: (s[:, a, :, None] + s[:, b, None, :]).reshape(len(unit), -1)
        return pair(0, 1), pair(2, 3)

    def best(self, unit, length: int):
        """The ``length`` best filters of each vector, best first, by list decoding.

        The r-th best sum has its halves at places whose product is at most r, so only those are added up.
        """
        import numpy as np

        out = []
        for at in range(0, len(unit), 128):
            for left, right in zip(*self.scores(unit[at : at + 128])):
                count = min(length, len(left))
                i, j = (np.argpartition(x, -count)[-count:] for x in (left, right))
                i, j = i[np.argsort(-left[i])], j[np.argsort(-right[j])]
                upto = np.minimum(length // np.arange(1, count + 1), count)
                u = np.repeat(np.arange(count), upto)
                v = np.arange(upto.sum()) - np.repeat(np.cumsum(upto) - upto, upto)
                sums = left[i[u]] + right[j[v]]
                top = np.argsort(-sums)[:length]
                out.append(i[u[top]] * len(right) + j[v[top]])
        return out

    def passed(self, unit):
        """Sorted filter numbers of each vector."""
        import numpy as np

        return [np.sort(x) for x in self.best(unit, self.length)]


def pairs_at(cosine: float, count: int, width: int, draw):
    """Random unit vectors in two arrays; those of a row have the given cosine (or are equal in one dimension)."""
    import numpy as np

    x, z = draw.standard_normal((2, count, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if width < 2:
        return x, x
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z


def cosine_links(classes: DataFrame, width: int, rows: int, least: float, single: bool) -> DataFrame:
    """``(a, b, links)``: with a = b the weight of vectors linked to a, otherwise edges of a spanning forest.

    ``classes(node, weight, vec)`` are different vectors. A pair is judged in double precision in every bucket that
    both are in, and counted only in that of their first common filter, so each linked pair counts once.
    """

    kind = "float32" if single else "float64"
    length = CapFilters(width, rows, least).length if width else PASSED

    def code(batches):
        import numpy as np

        filters = CapFilters(width, rows, least, length=length)
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at : at + 2048]
                vec = np.array(part["vec"].tolist(), float)
                lists = filters.passed(vec / np.linalg.norm(vec, axis=1, keepdims=True))
                yield part[["node", "weight"]].assign(
                    vec=[v.astype(kind).tobytes() for v in vec],
                    passed=[x.astype(np.int32).tobytes() for x in lists],
                    caps=[x.astype(np.int32) for x in lists],
                )

    def compare(batches):
        import numpy as np
        import pandas as pd

        for b in whole_groups(batches, ["cap", "lo", "hi"]):
            bounds = group_bounds(b, ["cap", "lo", "hi"])
            node, weight, mine, cap = (b[c].to_numpy() for c in ("node", "weight", "mine", "cap"))
            raw = np.frombuffer(b"".join(b["vec"]), kind).astype(float).reshape(len(b), width)
            length = np.sqrt((raw * raw).sum(1))
            passed = b["passed"].tolist()
            out = []
            for s, e in zip(bounds, bounds[1:]):
                near = raw[s:e] @ raw[s:e].T >= least * (length[s:e, None] * length[None, s:e])
                np.fill_diagonal(near, False)
                if b["lo"].iat[s] != b["hi"].iat[s]:
                    near &= mine[s:e, None] != mine[None, s:e]
                i, j = np.nonzero(np.triu(near))
                if not len(i):
                    continue
                lists = [np.frombuffer(c, np.int32) for c in passed[s:e]]
                lower = [x[x < cap[s]] for x in lists]
                names, col = np.unique(np.concatenate(lower), return_inverse=True)
                held = np.zeros((e - s, len(names)), np.float32)
                held[np.repeat(np.arange(e - s), [len(x) for x in lower]), col] = 1
                first = near & ~((held @ held.T) > 0)
                links = first @ weight[s:e]
                n = np.flatnonzero(links)
                out += [(node[s:e][n], node[s:e][n], links[n])]
                label = np.arange(e - s)
                while True:
                    low = np.minimum(label, np.where(near, label[None, :], e - s).min(1))
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                n = np.flatnonzero(label != np.arange(e - s))
                out += [(node[s:e][n], node[s:e][label[n]], np.zeros(len(n), int))]
            if out:
                yield pd.DataFrame({c: np.concatenate([x[k] for x in out]) for k, c in enumerate(("a", "b", "links"))})

    coded = classes.mapInPandas(code, "node long, weight long, vec binary, passed binary, caps array<int>")
    coded = stored(coded, "coded")
    spread = coded.select(F.explode("caps").alias("cap"), "node")
    pairs = paired_chunks(spread, "cap", "node", CHUNK, payload=coded.drop("caps"))
    return pairs.mapInPandas(compare, "a long, b long, links long")


def vector_groups(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9
) -> DataFrame:
    """Near-duplicate groups of vectors by cosine: ``(id, n_links, component_id, kept)``, one row per input row.

    All rows are indexed, whatever their other columns. Equal vectors are one class with a weight, so copies cost one
    row. Vectors that are null, zero, of another length than the longest, or hold null or non-finite components link
    with nothing. Rows with equal ids are different vectors; a class whose ids are all null has a null component. An
    empty table gives no rows. Found pairs are verified, so none below ``least`` is linked; a pair can be missed only
    if it shares no filter.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    fine = (F.size("vec") == width) & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    fine = F.col("vec").isNotNull() & fine & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(F.coalesce(fine, F.lit(False)), F.col("vec")))
    classes = rows.filter("vec is not null").groupBy("vec").agg(
        F.count("*").alias("weight"), F.min("id").alias("first_id")
    )
    # A number per class, whatever its ids; it holds from here on, as the classes are stored with it.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = stored(cosine_links(classes.select("node", "weight", "vec"), width, classes.count(), least, single), "links")
    links = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("a <> b").select("a", "b"))
    named = classes.join(links, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "root").select(
        "vec", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    good = rows.filter("vec is not null").join(named, "vec").select("id", "n_links", "component_id")
    rest = rows.filter("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
