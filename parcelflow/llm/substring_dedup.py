"""Removal of repeated word passages by FM-indexes over content shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import split_join, stored

#: Words of the anchor that puts a window into a shard; at most so many windows in a row share an anchor.
ANCHOR = 8
#: Bits of the filter of repeated anchors, at most. A full filter lets more windows through, never fewer.
MOST_BITS = 1 << 27
#: Words of a shard that one task indexes; different passages that may share an anchor before windows are dealt singly.
SHARD_WORDS, MANY = 1_000_000, 5_000


def passages(words: list[bytes], length: int):
    """Runs of windows that share an anchor: arrays ``(first window, windows, anchor hash)``.

    The anchor of a window is the leftmost of its word runs of length ``ANCHOR`` with the least hash, so equal windows
    have equal anchors at equal places, and different windows of one run have one anchor occurrence.
    """
    import numpy as np
    import xxhash

    if len(words) < length:
        return (np.zeros(0, np.int64),) * 3
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)  # cheaper than to look words up
    size = min(ANCHOR, length)
    runs = len(words) - size + 1
    code = np.zeros(runs, np.uint64)
    for i in range(size):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[i : i + runs]
    code ^= code >> np.uint64(31)
    code *= np.uint64(0x94D049BB133111EB)
    code ^= code >> np.uint64(30)
    value, place = code, np.arange(runs)
    width, wanted = 1, length - size + 1
    while width < wanted:
        step = min(width, wanted - width)
        left, right = value[: len(value) - step], value[step:]
        place = np.where(right < left, place[step:], place[: len(place) - step])
        value = np.minimum(left, right)
        width += step
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return start, np.diff(np.append(start, len(place))), value[start].view(np.int64)


class WaveletMatrix:
    """Bit levels of a sequence of small numbers with counts per 64 bits; counts any number before any place."""

    def __init__(self, values):
        import numpy as np

        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.levels = []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(64 + -len(bit) % 64, np.uint8)), bitorder="little")
            words = packed.view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(words)[:-1], dtype=np.int64))
            self.levels.append((words, before.astype(np.int32), int(len(bit) - bit.sum())))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def ones(self, level: int, at):
        import numpy as np

        words, before, _ = self.levels[level]
        block = at >> 6
        low = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[block] + np.bitwise_count(low)

    def down(self, value, *places):
        """Each of ``places`` followed down the levels along ``value``."""
        import numpy as np

        for level in range(self.bits):
            zeros = self.levels[level][2]
            bit = (value >> (self.bits - 1 - level) & 1).astype(bool)
            ones = [self.ones(level, x) for x in places]
            places = [np.where(bit, zeros + a, x - a) for a, x in zip(ones, places)]
        return places

    def rank(self, value, low, high):
        """Occurrences of ``value`` before ``low`` and before ``high``, plus the same number for each value."""
        return self.down(value, low, high)


class FMIndex:
    """FM-index of a sequence of numbers from 1; searches patterns of up to ``depth`` numbers, many at a time."""

    def __init__(self, text, depth: int):
        import numpy as np

        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        rank = text
        width = 1
        while True:
            ahead = np.zeros(n, np.int64)
            if width > 1:
                ahead[: n - width // 2] = rank[width // 2 :] + 1
            key = rank * (n + 2) + ahead if width > 1 else rank
            order = np.argsort(key, kind="stable")
            if width > depth:
                break
            moved = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = moved
            if moved[-1] == n - 1:
                break
            width *= 2
        symbols = np.arange(int(text.max()) + 1)
        self.before = np.searchsorted(text[order], np.append(symbols, symbols[-1] + 1))
        self.last = WaveletMatrix(text[order - 1])
        self.shift = self.before[:-1] - self.last.down(symbols, np.zeros(len(symbols), np.int64))[0]
        self.size = n

    def repeated(self, text, ends, length: int):
        """Whether the ``length`` numbers that end before each place of ``text`` occur more than once.

        Backward search extends all matches by one number at a time; a match that has become unique is dropped, for
        its matching statistic stays below the length.
        """
        import numpy as np

        out = np.zeros(len(ends), bool)
        live = np.arange(len(ends))
        value = text[ends - 1]
        low, high = self.before[value], self.before[value + 1]
        for step in range(2, length + 1):
            value = text[ends[live] - step]
            low, high = (self.shift[value] + x for x in self.last.rank(value, low, high))
            keep = high - low > 1
            live, low, high = live[keep], low[keep], high[keep]
        out[live] = True
        return out


def _repeated_windows(frame, length: int):
    """Bit masks of the repeated windows of a shard's passages ``(n, words)``."""
    import numpy as np

    number: dict[bytes, int] = {}
    parts, sizes = [], []
    for line in frame["words"]:
        words = line.split(b" ")
        parts.append(np.array([number.setdefault(w, len(number) + 2) for w in words] + [1], np.int64))
        sizes.append(len(words))
    text, sizes = np.concatenate(parts), np.array(sizes)
    starts = np.append(0, np.cumsum(sizes + 1)[:-1])
    windows = sizes - length + 1
    mask = np.where(frame["n"].to_numpy() > 1, (np.int64(1) << windows) - 1, 0)
    single = np.flatnonzero(frame["n"].to_numpy() == 1)
    if len(single):
        row = np.repeat(single, windows[single])
        offset = np.arange(len(row)) - np.repeat(np.cumsum(windows[single]) - windows[single], windows[single])
        found = FMIndex(text, 2 * length).repeated(text, starts[row] + offset + length, length)
        np.bitwise_or.at(mask, row[found], np.int64(1) << offset[found])
    return mask


def shard_masks(pieces: DataFrame, length: int) -> DataFrame:
    """``(key, h1, h2, mask)`` of passages ``(key, h1, h2, n, words)``; passages of one key are in one shard."""

    def run(batches):
        import pandas as pd

        batches = [b for b in batches if len(b)]
        if batches:
            shard = pd.concat(batches, ignore_index=True)
            out = shard[["key", "h1", "h2"]].assign(mask=_repeated_windows(shard, length))
            yield out[out["mask"] != 0]

    total = pieces.agg(F.sum(F.length("words"))).first()[0] or 0
    least = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(least, -(-total // (6 * SHARD_WORDS)))
    return pieces.repartition(count, "key").mapInPandas(run, "key long, h1 long, h2 long, mask long")


def repeated_passages(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """``(row, start, mask)``: bit i of mask says that the window at ``start + i`` of the row occurs elsewhere too."""
    spark = docs.sparkSession
    rows = docs.select(row_token(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def anchors(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            found = [passages((t or "").encode().split(), length)[2] for t in b["text"]]
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"key": keys, "n": n})

    seen = docs.select(F.col(text_col).alias("text")).mapInPandas(anchors, "key long, n long")
    repeated = stored(seen.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "anchors")
    bits = min(MOST_BITS, 1 << max(12, (16 * repeated.count()).bit_length()))
    spots = F.array(*[F.pmod(F.shiftrightunsigned("key", 20 * i), F.lit(bits)) for i in range(2)])
    words = repeated.select(F.explode(spots).alias("at")).groupBy(F.expr("cast(shiftright(at, 6) as int)").alias("w"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toPandas()
    import numpy as np

    table = np.zeros(bits // 64, np.int64)  # at most MOST_BITS bits
    table[words["w"].to_numpy()] = words["mask"].to_numpy()
    shared = spark.sparkContext.broadcast(table.view(np.uint64))

    @F.arrow_udf("array<struct<start:int,windows:int,key:long,h1:long,h2:long>>")
    def cut(texts):
        import numpy as np
        import pyarrow as pa
        import xxhash

        table, last = shared.value, np.uint64(bits - 1)
        starts, sizes, keys, digests, ends = [], [], [], [], [0]
        for text in texts.to_pylist():
            words = (text or "").encode().split()
            start, windows, key = passages(words, length)
            keep = np.ones(len(start), bool)
            for i in range(2):
                spot = key.view(np.uint64) >> np.uint64(20 * i) & last
                keep &= (table[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
            start, windows = start[keep], windows[keep]
            starts.append(start)
            sizes.append(windows)
            keys.append(key[keep])
            stop = start + windows + length - 1
            digests += [xxhash.xxh3_128_digest(b" ".join(words[a:b])) for a, b in zip(start.tolist(), stop.tolist())]
            ends.append(len(digests))
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = [
            pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(sizes), pa.int32()),
            pa.array(np.concatenate(keys), pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
        ]
        found = pa.StructArray.from_arrays(columns, ["start", "windows", "key", "h1", "h2"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    cuts = stored(rows.select("row", F.explode(cut("text")).alias("p")).select("row", "p.*"), "cuts")
    # A passage and where it stands first; its words are not carried along.
    place = F.min(F.struct("row", "start", "windows")).alias("at")
    known = stored(cuts.groupBy("key", "h1", "h2").agg(F.count("*").alias("n"), place), "passages")
    # Windows are equal only under equal anchors, so an anchor with one passage needs no search: if the passage occurs
    # again, so do all its windows, else none.
    tally = stored(known.groupBy("key").agg(F.count("*").alias("k")), "anchors")
    alone = split_join(known.filter("n > 1"), tally.filter("k = 1").select("key"), "key")
    alone = alone.select("key", "h1", "h2", F.expr("shiftleft(1L, at.windows) - 1").alias("mask"))
    several = split_join(known, tally.filter("k > 1"), "key")
    same = stored(_passage_words(several, rows, length), "words")
    masks = alone.union(shard_masks(same.filter(F.col("k") <= MANY).drop("k"), length))
    hot = same.filter(F.col("k") > MANY)
    parts = F.split(F.col("words").cast("string"), " ")
    hot = hot.select("key", "h1", "h2", "n", parts.alias("w"))
    hot = hot.select(
        "key", "h1", "h2", "n", "w", F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("offset")
    ).withColumn("words", F.array_join(F.slice("w", F.col("offset") + 1, length), " "))
    hot = hot.select(
        "key", "h1", "h2", "n", "offset", "words",
        F.xxhash64("words").alias("w1"), F.xxhash64(F.lit("second"), "words").alias("w2"),
    )
    single = hot.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.first("words").cast("binary").alias("words"))
    single = shard_masks(single.select(F.col("w1").alias("key"), F.col("w1").alias("h1"), F.col("w2").alias("h2"), "n", "words"), length)
    single = single.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    hot = hot.join(single, ["w1", "w2"]).groupBy("key", "h1", "h2")
    masks = masks.union(hot.agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask")))
    masks = stored(masks, "masks")
    return cuts.join(masks, ["key", "h1", "h2"]).select("row", "start", "mask")


def _passage_words(passages: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """``(key, h1, h2, n, k, words)``: passages with their words, read again from the row each stands in first.

    Rows get the list of their passages, no more than they have words. Rows that share a token have equal texts; one
    of them is read.
    """
    wanted = F.struct("at.start", "at.windows", "key", "h1", "h2", "n", "k")
    wanted = passages.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(wanted).alias("wanted"))
    texts = rows.join(wanted, "row").groupBy("row").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))

    @F.arrow_udf("array<binary>")
    def sliced(texts, starts, windows):
        import pyarrow as pa

        lines, ends = [], [0]
        for text, first, sizes in zip(texts.to_pylist(), starts.to_pylist(), windows.to_pylist()):
            words = text.encode().split()
            lines += [b" ".join(words[at : at + size + length - 1]) for at, size in zip(first, sizes)]
            ends.append(len(lines))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lines, pa.binary()))

    found = texts.withColumn("words", sliced("text", F.col("wanted.start"), F.col("wanted.windows")))
    found = found.select(F.explode(F.arrays_zip("wanted", "words")).alias("p"))
    return found.select(*[F.col(f"p.wanted.{c}").alias(c) for c in ("key", "h1", "h2", "n", "k")], F.col("p.words").alias("words"))


def row_token(id_col: str, text_col: str):
    """Digest of a row's id and text: tells rows apart that share one of them; equal rows share it."""
    number = F.coalesce(F.col(id_col).cast("string"), F.lit("none"))
    return F.unhex(F.md5(F.concat(number, F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))))


def uncovered(count: int, starts, masks, length: int):
    """Whether each of ``count`` words lies outside all windows; bit i of a mask is the window at its start + i."""
    import numpy as np

    span, shift = np.nonzero(masks[:, None] >> np.arange(length) & 1)
    at = starts[span] + shift
    rise = np.bincount(at, minlength=count + 1) - np.bincount(at + length, minlength=count + 1)
    return np.cumsum(rise[:-1]) == 0


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35
) -> DataFrame:
    """Removes every word that a repeated window covers, and keeps every row and column of ``docs``.

    Words are runs without ASCII white space, unchanged. A window is ``length`` consecutive words of one row; it is
    repeated if its words start at any other place of any row. Windows are judged on the input. Adds ``n_words`` and
    ``n_removed`` and replaces the text by the kept words, joined by one space (null or blank: empty). Equal rows
    repeat one another; ids may repeat or be null. An empty table gives no rows.

    Windows go to shards by anchors, runs of words that equal windows share, so each shard is searched by its own
    windows only. Anchors that occur once, or with one passage only, need no search. Equal passages are one entry; an anchor with more than
    ``MANY`` different passages has its windows dealt out singly, so no shard grows with one anchor.
    """
    found = repeated_passages(docs, id_col, text_col, length)
    spans = found.groupBy(F.col("row").alias("__row")).agg(F.collect_set(F.struct("start", "mask")).alias("__spans"))
    joined = docs.withColumn("__row", row_token(id_col, text_col)).join(spans, "__row", "left")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def keep(texts, starts, masks):
        import numpy as np
        import pandas as pd

        out = []
        for text, first, mask in zip(texts, starts, masks):
            words = (text or "").encode().split()
            removed = 0
            if first is not None and len(first):
                left = uncovered(len(words), np.array(first), np.array(mask), length)
                removed = len(words) - int(left.sum())
                kept = b" ".join(w for w, ok in zip(words, left.tolist()) if ok)
            else:
                kept = b" ".join(words)
            out.append((len(words), removed, kept.decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    out = joined.withColumn("__kept", keep(F.col(text_col), F.col("__spans.start"), F.col("__spans.mask")))
    return out.select(
        *[c for c in docs.columns if c != text_col],
        F.col("__kept.n_words").alias("n_words"),
        F.col("__kept.n_removed").alias("n_removed"),
        F.col("__kept.kept").alias(text_col),
    )
