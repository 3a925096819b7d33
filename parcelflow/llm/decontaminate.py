"""Benchmark decontamination: pigeonhole pieces and Myers bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import row_key

#: Share of an item's code points that may differ.
ERROR_RATE = 0.08
#: Code points of test items that a task holds at once; more items are searched in further blocks.
BLOCK_POINTS = 4_000_000


def normal(text: str | None) -> str:
    """A-Z in lower case, runs of ASCII white space as one space, none at the ends."""
    return b" ".join((text or "").encode().lower().split()).decode()  # bytes.lower() changes A-Z only


def budget(points: int, rate: float) -> int:
    return int(points * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets; one of them survives any ``errors`` edits."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    """Bit mask of the positions of each character."""
    found: dict[str, int] = {}
    for i, ch in enumerate(item):
        found[ch] = found.get(ch, 0) | 1 << i
    return found


def best_distance(peq: dict[str, int], points: int, text: str) -> int:
    """Least edit distance between the item and any substring of ``text``, by Myers' bit vectors."""
    full, top = (1 << points) - 1, 1 << (points - 1)
    plus, minus, score = full, 0, points
    best = points
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
    return best


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate), masks(t)) for i, t in items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, errors, _) in enumerate(self.items):
            for offset, piece in pieces(t, errors):
                owners.setdefault(piece, []).append((n, offset))
        self.machine = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.machine.add_word(piece, (len(piece), where))
        if owners:
            self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """``(item id, distance)`` of each item within its budget of some substring."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.machine.iter(text) if len(self.machine) else ():
            for n, offset in where:
                _, item, errors, _ = self.items[n]
                start = end - length + 1 - offset - errors
                spans = windows.setdefault(n, [])
                stop = start + len(item) + 2 * errors
                if spans and start <= spans[-1][1]:
                    spans[-1] = [min(start, spans[-1][0]), max(stop, spans[-1][1])]
                else:
                    spans.append([start, stop])
        found = []
        for n, spans in windows.items():
            number, item, errors, peq = self.items[n]
            best = errors + 1
            for a, b in spans:
                part = text[max(0, a) : b]
                best = min(best, 0 if item in part else best_distance(peq, len(item), part))
                if not best:
                    break
            if best <= errors:
                found.append((number, best))
        return found


def blocks(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """The test set in blocks of at most ``BLOCK_POINTS`` code points, or one item, each collected on its own."""
    numbered = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    total = numbered.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-2 * total // BLOCK_POINTS)
    out = []
    for block in range(count):
        mine = numbered.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block).distinct().collect()
        out.append([(r["id"], t) for r in mine if (t := normal(r["text"]))])
    return out


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = ERROR_RATE,
    digest: bool = False,
) -> DataFrame:
    """Pairs ``(id, item, edits)``: items that occur in whole texts within ``rate`` times their length in edits.

    ``edits`` is the least distance to any substring near a piece hit. Both sides are normalised. The test set is
    searched in blocks of bounded size, each held by the tasks as an automaton; texts are never shuffled. Null or
    blank items and texts match nothing. Each text row gives its own pairs, also where ids repeat or are null; equal
    items count once. Empty tables give no rows. Other columns are not read. With ``digest`` the pairs carry the
    ``row_digest`` of the text too, which tells rows of one id apart.
    """
    own = [id_col, "row_digest"] if digest else [id_col]
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), row_key(id_col, text_col), F.col(text_col).alias("__text"))

    def search(block):
        @F.pandas_udf("array<struct<item:long,edits:int>>")
        def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(block, rate)  # once per task
            for column in columns:
                yield pd.Series([[{"item": n, "edits": e} for n, e in matcher.find(normal(t))] for t in column])

        found = texts.select(*own, F.explode(run("__text")).alias("hit"))
        return found.select(*own, F.col("hit.item").alias(item_col), F.col("hit.edits").alias("edits"))

    found = docs.sparkSession.createDataFrame([], f"{id_col} long, {'row_digest binary, ' * digest}{item_col} long, edits int")
    for block in blocks(items, item_col, item_text_col):
        found = found.union(search(block))
    return found
