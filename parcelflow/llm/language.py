"""Language identification by n-gram filters with a bit per language."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.llm.common import stored

#: Documents per language that the filters are fitted on, at most about so many, chosen by a hash of the id.
MAX_PER_LANGUAGE = 2000
#: Characters of an n-gram, slices of the filter (a power of two) and hashes per n-gram.
GRAM, SLICES, HASHES = 4, 1 << 20, 2
#: A language holds an n-gram that it uses at least this often, as a share of the language that uses it most.
SHARE, LEAST = 0.5, 3


@cache
def _letters():
    """For each code point itself if it is a letter, else a blank; digits and other numerals are no letters."""
    import numpy as np

    is_letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return np.where(is_letter, np.arange(sys.maxunicode + 1, dtype=np.uint32), np.uint32(32))


def grams(text: str | None):
    """Hashes of the n-grams of a whole text's letters in lower case, each run of other characters one blank."""
    import numpy as np

    points = _letters()[np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), np.uint32)]
    letter = points != 32
    if not letter.any():
        return np.zeros(0, np.uint64)
    letter[1:] |= letter[:-1]  # a letter, or the first blank after one
    letter[0] = True
    first = int((points != 32).argmax())
    letter[1 : first] = False
    points = points[letter].astype(np.uint64)
    n = max(1, len(points) - GRAM + 1)
    code = np.zeros(n, np.uint64)
    for i in range(min(GRAM, len(points))):
        code = code * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n]
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(32))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, limit: int) -> DataFrame:
    """``(text, lang)`` of rows with a language, at most about ``limit`` for each language."""
    rows = docs.filter(f"{lang_col} is not null and {text_col} is not null")
    shares = rows.groupBy(F.col(lang_col).alias("__lang")).agg((F.lit(float(limit)) / F.count("*")).alias("__share"))
    shares = F.broadcast(shares)  # one row per language: as many as the filter's bits, which must fit a task anyway
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) / 1e6
    picked = rows.join(shares, rows[lang_col] == shares["__lang"]).filter(draw < F.col("__share"))
    return picked.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def fit(rows: DataFrame) -> dict:
    """The bit-sliced filter of ``rows(text, lang)``: languages, a mask per slice, and false-positive rates.

    Counts per language and n-gram, the choice of languages per n-gram and the masks per slice are grouped aggregates;
    the driver gets one mask per slice, so at most ``SLICES`` rows.
    """

    def count(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for lang, part in b.groupby("lang"):
                codes, n = np.unique(np.concatenate([grams(t) for t in part["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n})

    counts = rows.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = stored(counts, "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    bit = {lang: i for i, lang in enumerate(langs)}
    words = max(1, -(-len(langs) // 63))
    if not langs:
        return {"langs": [], "masks": None, "false": []}
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, 1.0 / totals[lang])])
    place = F.create_map(*[F.lit(x) for lang in langs for x in (lang, bit[lang])])
    used = counts.withColumn("rate", F.col("n") * share[F.col("lang")]).withColumn("bit", place[F.col("lang")])
    best = used.groupBy("code").agg(F.max("rate").alias("top"))
    held = used.join(best, "code").filter((F.col("rate") >= SHARE * F.col("top")) & (F.col("n") >= LEAST))
    spots = F.array(*[F.pmod(_spot(F.col("code"), h), F.lit(SLICES)).cast("int") for h in range(HASHES)])
    sliced = held.select(F.explode(spots).alias("slice"), "bit")
    masks = sliced.groupBy("slice").agg(
        *[
            F.bit_or(F.when(F.floor(F.col("bit") / 63) == w, F.expr(f"shiftleft(1L, bit - {63 * w})")).otherwise(0))
            .alias(f"w{w}")
            for w in range(words)
        ]
    )
    import numpy as np

    got = masks.toPandas()
    table = np.zeros((words, SLICES), np.int64)
    for w in range(words):
        table[w, got["slice"].to_numpy()] = got[f"w{w}"].to_numpy()
    fill = [float((table[i // 63] >> (i % 63) & 1).mean()) for i in range(len(langs))]
    if len(langs) <= 8:
        table = table.astype(np.uint8)  # a small table stays in the processor's cache
    return {"langs": langs, "masks": table, "false": [f**HASHES for f in fill]}


def _spot(code: Column, h: int) -> Column:
    return F.shiftrightunsigned(code, 20 * h)


def predict(model: dict, text: Column) -> Column:
    """Struct ``(lang, score)`` of whole texts.

    Every n-gram gets the mask of languages that hold it, the AND of its slices. A language's share of the n-grams,
    less what false positives explain, is its support; the largest decides (ties: the first name), and the score is
    its part of all support.
    """

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(texts):
        import numpy as np
        import pandas as pd

        langs, masks, false = model["langs"], model["masks"], np.array(model["false"])
        out = []
        for text in texts:
            codes = grams(text)
            if not len(codes) or not langs:
                out.append(("und", 0.0))
                continue
            hits = np.zeros(len(langs))
            for w in range(len(masks)):
                mask = masks[w][codes & np.uint64(SLICES - 1)]
                for h in range(1, HASHES):
                    mask = mask & masks[w][(codes >> np.uint64(20 * h)) & np.uint64(SLICES - 1)]
                mine = range(63 * w, min(len(langs), 63 * w + 63))
                if masks.dtype == np.uint8:
                    seen = np.bincount(mask, minlength=256)
                    values = np.arange(256)
                    hits[list(mine)] = [seen[values >> i & 1 == 1].sum() for i in mine]
                else:
                    hits[list(mine)] = [(mask >> (i % 63) & 1).sum() for i in mine]
            support = np.maximum(0, (hits / len(codes) - false) / (1 - np.minimum(false, 0.999)))
            best = int(support.argmax())
            out.append((langs[best], float(support[best] / support.sum()) if support.sum() > 0 else 0.0))
        return pd.DataFrame(out, columns=["lang", "score"])

    return run(text)


def identify(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row; learns from rows where ``train`` holds.

    A null text, one without letters, or any text when nothing could be learned is ``und`` with score 0. Rows without
    a language are not learned from. Repeated rows and null ids are allowed; an empty table gives no rows. Whole texts
    are read. Columns may have any names but the two added.
    """
    model = fit(training_rows(docs.filter(train), id_col, text_col, lang_col, MAX_PER_LANGUAGE))
    out = docs.withColumn("__found", predict(model, F.col(text_col)))
    return out.select(
        *docs.columns, F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score")
    )
