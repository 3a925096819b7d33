"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import re
from operator import eq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.llm.common import stored

#: Bounds of the fit: labelled documents used, and features of the model.
MAX_LABELLED, MAX_FEATURES = 10_000, 4096

TARGETS = ("bad", "toxic")

_EDGE = re.compile(r"^\W+|\W+$")
_TAIL = re.compile(r"[^\w\s]+$")


class _Features(dict):
    """Word -> its features: the bare word in lower case and the marks at its end."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        tail = _TAIL.search(word)
        found = (_EDGE.sub("", word).lower() or "-", "mark " + tail[0][:8]) if tail else (_EDGE.sub("", word).lower(),)
        if len(self) > 200_000:
            self.clear()
        self[word] = found
        return found


def features(text: str | None, cache: _Features) -> set[str]:
    """Features of a whole text: its words, end marks and shape. A null or blank text has the one feature ``blank``."""
    words = (text or "").split()
    if not words:
        return {"blank"}
    distinct = set(words)
    found = {f for w in distinct for f in cache[w]}
    n = len(text)
    letters = max(1, sum(map(len, words)))
    upper = sum(map(str.isupper, words)) / len(words)
    marks = len(re.findall(r"[^\w\s]", text)) / letters
    lines = text.split("\n")
    again = sum(map(eq, words, words[1:])) / len(words)
    found |= {
        f"shape length {min(20, n.bit_length())}",
        f"shape upper {round(upper * 5)}",
        f"shape marks {min(10, round(marks * 20))}",
        f"shape variety {round(len(distinct) / len(words) * 10)} {min(16, len(words).bit_length())}",
        f"shape word {min(20, letters // len(words))}",
        f"shape again {min(5, round(again * 20))}",
        f"shape lines {round(len(set(lines)) / len(lines) * 5)}",
    }
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Labelled texts ``(text, bad, toxic)``, at most about ``limit`` of them, chosen by a hash of the id."""
    known = labels.select(
        F.col("doc_id").alias("label_id"),
        (F.col("quality") == 0).alias("bad"),
        (F.col("toxic") == 1).alias("toxic"),
    ).filter("label_id is not null and bad is not null and toxic is not null")
    share = limit / max(1, known.count())
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    known = known.groupBy("label_id").agg(F.max("bad").alias("bad"), F.max("toxic").alias("toxic"))
    # The sample has at most about `limit` rows of ten bytes, whatever the tables' sizes.
    return docs.join(F.broadcast(known), docs["doc_id"] == known["label_id"]).select(docs["text"], "bad", "toxic")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> dict:
    """Two logistic models over the features that tell labels apart best, fitted on a bounded labelled sample.

    Counts per feature are a grouped aggregate; the ``MAX_FEATURES`` features with the largest scores of difference are
    kept. The driver gets only the counts of those and the sample's feature numbers, both bounded by the parameters.
    """
    sample = stored(labelled_sample(docs, labels, limit), "labelled")
    totals = sample.agg(
        F.count("*").alias("n"), *[F.sum(F.col(t).cast("int")).alias(t) for t in TARGETS]
    ).first()

    def count(batches):
        from collections import Counter

        import pandas as pd

        cache = _Features()
        for b in batches:
            seen, hits = Counter(), {t: Counter() for t in TARGETS}
            for text, *marks in zip(b["text"], *(b[t] for t in TARGETS)):
                found = features(text, cache)
                seen.update(found)
                for t, hit in zip(TARGETS, marks):
                    if hit:
                        hits[t].update(found)
            yield pd.DataFrame(
                {"f": list(seen), "n": list(seen.values())} | {t: [hits[t][f] for f in seen] for t in TARGETS}
            )

    counts = sample.mapInPandas(count, "f string, n long, bad long, toxic long").groupBy("f")
    counts = counts.agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]).filter("n >= 3")

    def score(t: str) -> Column:
        rate = (totals[t] or 0) / max(1, totals["n"])
        spread = F.sqrt(F.col("n") * F.lit(max(1e-9, rate * (1 - rate))) + 1)
        return F.abs(F.col(t) - F.col("n") * rate) / spread

    ranked = counts.withColumn("z", F.greatest(*[score(t) for t in TARGETS])).filter("z >= 3")
    top = ranked.orderBy(F.desc("z"), "f").limit(MAX_FEATURES).select("f", "n").collect()
    place = {r["f"]: i for i, r in enumerate(top)}
    # Rare features count for more: the inverse root of the share of documents that have them.
    scale = [(r["n"] / totals["n"] + 0.001) ** -0.5 for r in top]

    def place_all(batches):
        import pandas as pd

        cache = _Features()
        for b in batches:
            rows = [sorted(place[f] for f in features(t, cache) if f in place) for t in b["text"]]
            yield pd.DataFrame({"at": rows, "bad": b["bad"], "toxic": b["toxic"]})

    # At most `limit` rows of at most MAX_FEATURES numbers each.
    rows = sample.mapInPandas(place_all, "at array<int>, bad boolean, toxic boolean").toPandas()
    return {"place": place, "scale": scale} | {t: _logistic(rows["at"], rows[t], scale) for t in TARGETS}


def _logistic(at, target, scale, steps: int = 150):
    """Weights and bias of a ridge logistic model by accelerated gradient descent."""
    import numpy as np

    y, scale = np.asarray(target, float), np.array(scale)
    width = len(scale)
    n = len(y)
    if not n or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1)
        return np.zeros(width), float(np.log(rate / (1 - rate)))
    sizes = np.array([len(a) for a in at])
    col = np.concatenate([np.asarray(a, int) for a in at]) if sizes.sum() else np.zeros(0, int)
    row = np.repeat(np.arange(n), sizes)
    value = scale[col]
    value = value / np.sqrt(np.bincount(row, value**2, n) + 1e-9)[row]
    w, b = np.zeros(width), 0.0
    look, look_b = w.copy(), b
    ridge, rate = 1e-5, 4.0
    for step in range(1, steps + 1):
        z = np.bincount(row, look[col] * value, n) + look_b
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = look - rate * (np.bincount(col, gap[row] * value, width) / n + ridge * look)
        new_b = look_b - rate * gap.mean()
        pace = (step - 1) / (step + 2)
        look, look_b = new + pace * (new - w), new_b + pace * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def evidence(model: dict, text: Column) -> Column:
    """Struct ``(bad, toxic)`` of a text's probabilities by the document models."""

    @F.pandas_udf(T.StructType([T.StructField(t, T.DoubleType()) for t in TARGETS]))
    def run(texts):
        import numpy as np
        import pandas as pd

        place, scale, cache = model["place"], np.array(model["scale"]), _Features()
        out = {t: [] for t in TARGETS}
        for text in texts:
            at = np.fromiter((place[f] for f in features(text, cache) if f in place), int)
            norm = np.sqrt((scale[at] ** 2).sum() + 1e-9)
            for t in TARGETS:
                w, b = model[t]
                z = (w[at] * scale[at]).sum() / norm + b
                out[t].append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return pd.DataFrame(out)

    return run(text)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """One row per (host, path): posterior means of both targets, with the global means.

    Every level is a Beta prior centred on the mean of the level above; its strength comes by the method of moments
    from how much the sites of the level differ, so hosts with few documents shrink to the global mean and paths with
    few documents to their host. All steps are grouped aggregates that combine before the shuffle.
    """
    sums = [F.sum(f"evidence.{t}").alias(t) for t in TARGETS]
    paths = stored(scored.groupBy(host, path).agg(F.count("*").cast("double").alias("n"), *sums), "paths")
    hosts = paths.groupBy(host).agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
    totals = hosts.agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]).first()
    n = totals["n"] or 1.0
    mean = {t: min(max((totals[t] or 0.0) / n, 1e-6), 1 - 1e-6) for t in TARGETS}

    def strength(level: DataFrame, centre: dict[str, Column]) -> dict[str, float]:
        """Prior size: mean binomial variance over the variance between sites beyond chance."""
        wide = level.agg(
            F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"),
            *[F.sum(F.col("n") * F.pow(F.col(t) / F.col("n") - centre[t], 2)).alias(t) for t in TARGETS],
        ).first()
        out = {}
        for t in TARGETS:
            chance = mean[t] * (1 - mean[t])
            spare = max(1.0, (wide["n"] or 1.0) - (wide["nn"] or 0.0) / (wide["n"] or 1.0))
            between = ((wide[t] or 0.0) - max(0, wide["k"] - 1) * chance) / spare
            out[t] = float(min(1e6, max(2.0, chance / max(between, 1e-9) - 1)))
        return out

    size = strength(hosts, {t: F.lit(mean[t]) for t in TARGETS})
    hosts = hosts.select(
        F.col(host).alias("__host"),
        *[((F.col(t) + size[t] * mean[t]) / (F.col("n") + size[t])).alias(f"__host_{t}") for t in TARGETS],
    )
    joined = paths.join(hosts, paths[host].eqNullSafe(hosts["__host"]))
    size = strength(joined, {t: F.col(f"__host_{t}") for t in TARGETS})
    return joined.select(
        F.col(host).alias("__host"),
        F.col(path).alias("__path"),
        *[
            ((F.col(t) + size[t] * F.col(f"__host_{t}")) / (F.col("n") + size[t])).alias(f"__site_{t}")
            for t in TARGETS
        ],
        *[F.lit(mean[t]).alias(f"__mean_{t}") for t in TARGETS],
    )


def combine(scored: DataFrame, host: str, path: str) -> DataFrame:
    """Adds ``p_bad``, ``p_toxic`` and ``keep`` to rows with ``evidence``, and drops that column.

    The log odds of a document are its own plus those by which its site's posterior differs from the global mean.
    ``scored`` should be a stored table; it is read twice. Rows whose host or path is null form a site of their own.
    """
    sites = stored(site_posteriors(scored, host, path), "sites")
    joined = scored.join(
        sites, scored[host].eqNullSafe(sites["__host"]) & scored[path].eqNullSafe(sites["__path"]), "left"
    )

    def posterior(t: str) -> Column:
        z = _logit(F.col(f"evidence.{t}")) + _logit(F.col(f"__site_{t}")) - _logit(F.col(f"__mean_{t}"))
        return (1 / (1 + F.exp(-z))).alias(f"p_{t}")

    out = joined.select(*[c for c in scored.columns if c != "evidence"], *[posterior(t) for t in TARGETS])
    return out.withColumn("keep", (F.col("p_bad") < 0.5) & (F.col("p_toxic") < 0.5))


def classify(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep_text: bool = True
) -> DataFrame:
    """Scores every row of ``docs(doc_id, text, host, path, ...)`` and keeps its columns (``text`` if asked).

    ``labels(doc_id, quality, toxic)`` may cover any part of the rows; unlabelled, null or unknown ones are not used.
    Without labels, or with labels of one kind only, the models give the smoothed rate of the kind. Null and blank
    texts are scored by the feature ``blank``. Repeated rows are scored alike; an empty table gives no rows. Other
    columns may have any names but ``evidence``, ``p_bad``, ``p_toxic``, ``keep``.
    """
    model = fit(docs, labels)
    columns = [c for c in docs.columns if keep_text or c != "text"]
    scored = stored(docs.select(*columns, evidence(model, F.col("text")).alias("evidence")), "scored")
    return combine(scored, host, path)
