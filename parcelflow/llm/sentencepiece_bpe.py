"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary file lies; a parameter of every function that needs it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units longer than this are segmented one by one, shorter ones side by side.
LONG_UNIT = 48
#: Units whose spans a worker remembers; beyond that it starts anew. Results do not depend on it.
REMEMBERED = 50_000
#: Occurrences that are segmented side by side.
SIDE_BY_SIDE = 4096

_NONE = (1 << 31) - 1
_WORD64 = (1 << 64) - 1


def mix(x):
    """A 64-bit finalizer, for integers and for arrays of unsigned 64-bit numbers alike."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WORD64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WORD64
    return x ^ (x >> 31)


def mix_array(x):
    import numpy as np

    u = np.uint64
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


def _slot(ways, bits: int, turn: int):
    """Places in a hash table of ``2 ** bits``."""
    import numpy as np

    return (ways.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn) >> np.uint64(64 - bits)).astype(np.int64)


class Vocabulary:
    """Pieces, merges and byte pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = [0] * 256
        ids: dict[str, int] = {}
        score: dict[int, float] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                text = piece.replace("▁", " ")
                self.bytes_of[i] = text.encode()
                ids[text], score[i] = i, sp.get_score(i)
        self.size = size
        symbols = dict(ids)
        for text in ids:
            for ch in text:
                symbols.setdefault(ch, len(symbols) + size)
        self.symbol = symbols
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank_of = {i: order[s] for i, s in score.items()}
        self.ids = ids
        self.splits_at_newline = not any("\n" in t for t in ids)
        points = [ord(t) for t in symbols if len(t) == 1 and ord(t) < 1 << 16]
        self.of_point = -1 - np.arange(1 << 16)
        self.of_point[points] = [symbols[chr(c)] for c in points]
        self._plant(ids)

    @cached_property
    def merges(self) -> dict[tuple[int, int], int]:
        """The piece that two symbols make; only long units ask for it."""
        made = {}
        for text, i in self.ids.items():
            for cut in range(1, len(text)):
                a, b = self.symbol.get(text[:cut]), self.symbol.get(text[cut:])
                if a is not None and b is not None:
                    made[a, b] = i
        return made

    def _plant(self, ids: dict[str, int]) -> None:
        """The pieces as a trie whose branches lie in hash tables, so that many texts walk it side by side."""
        import numpy as np

        self.letter = {ch: k for k, ch in enumerate(sorted(set("".join(ids))), 1)}  # 0: no letter of any piece
        self.letter_of_point = np.zeros(1 << 16, np.int64)
        for ch, k in self.letter.items():
            if ord(ch) < 1 << 16:
                self.letter_of_point[ord(ch)] = k
        branches: dict[int, int] = {}
        numbers = [-1]
        for text, i in ids.items():
            node = 0
            for ch in text:
                way = node * (len(self.letter) + 1) + self.letter[ch]
                if way not in branches:
                    branches[way] = len(numbers)
                    numbers.append(-1)
                node = branches[way]
            numbers[node] = i
        self.longest = max(map(len, ids))
        kind = np.int16 if self.size < 1 << 15 else np.int32
        self.number_of_node = np.array(numbers, kind)
        self.rank_of_number = np.full(self.size, _NONE, np.int32)
        for i, r in self.rank_of.items():
            self.rank_of_number[i] = r
        ways, nodes = np.array(list(branches), np.int64), np.array(list(branches.values()), np.int64)
        self.tables = []
        while len(ways):  # ways that meet another one in a table go to the next
            bits = (4 * len(ways)).bit_length()
            slot = _slot(ways, bits, len(self.tables))
            slots, first = np.unique(slot, return_index=True)
            keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
            keys[slots], values[slots] = ways[first], nodes[first]
            self.tables.append((bits, keys, values))
            left = np.ones(len(ways), bool)
            left[first] = False
            ways, nodes = ways[left], nodes[left]

    def _step(self, ways):
        """Nodes that branches lead to, -1 where there is none."""
        import numpy as np

        out, rest = np.full(len(ways), -1, np.int64), np.arange(len(ways))
        for k, (bits, keys, values) in enumerate(self.tables):
            slot = _slot(ways, bits, k)
            there = keys.take(slot)
            hit = np.flatnonzero(there == ways)
            out[rest[hit]] = values[slot[hit]]
            other = np.flatnonzero((there != ways) & (there >= 0))  # an empty place: in no table
            rest, ways = rest[other], ways[other]
        return out

    def spans(self, units: list[str]):
        """A row per character of the units: the numbers of the pieces that begin there, by length, -1 where none is.

        Which piece a merge makes, and its rank, depend on the merged span alone, wherever it was cut. The last column
        stands for all greater lengths.
        """
        import numpy as np

        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        letter = self.letter_of_point[np.minimum(points, 0xFFFF)]
        for k in np.flatnonzero(points > 0xFFFF):
            letter[k] = self.letter.get(chr(points[k]), 0)
        size = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.repeat(np.cumsum(size), size)
        out = np.full((len(points), self.longest + 1), -1, self.number_of_node.dtype)
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for length in range(self.longest):
            node = self._step(node * (len(self.letter) + 1) + letter[at + length])
            found = node >= 0
            at, node = at[found], node[found]
            out[at, length] = self.number_of_node[node]
            inside = at + length + 1 < stop[at]
            at, node = at[inside], node[inside]
        return out

    def start_symbols(self, text: str):
        """A symbol per character; characters outside the vocabulary are negative, ``-1 - code point``."""
        import numpy as np

        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        out = self.of_point[np.minimum(points, 0xFFFF)]
        for k in np.flatnonzero(points > 0xFFFF):
            out[k] = self.symbol.get(chr(points[k]), -1 - points[k])
        return out

    def finish(self, symbols: list[int]) -> list[int]:
        """Piece numbers; what is no piece becomes its UTF-8 bytes."""
        out: list[int] = []
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
            else:
                ch = chr(-1 - s) if s < 0 else next(c for c, i in self.symbol.items() if i == s)
                out.extend(self.byte_id[b] for b in ch.encode())
        return out


def occurrence_key(seed: int, salt: int, place: int) -> int:
    """Hash key of the unit at ``place`` of a text with a salt of its own."""
    return mix(mix((salt ^ mix(seed & _WORD64)) & _WORD64) + place & _WORD64)


def _spot(left, split, right):
    """One number for the candidate that joins ``[left, split)`` and ``[split, right)``."""
    return left << 42 | split << 21 | right


def skipped(key: int, left: int, split: int, right: int, limit: int) -> bool:
    """Whether a candidate is skipped for good."""
    return mix(key ^ mix(_spot(left, split, right) + 1)) < limit


def segment(vocab: Vocabulary, unit: str, key: int, limit: int) -> list[int]:
    """Segments one unit with an agenda: best rank first, then leftmost; skipped candidates never merge."""
    symbols = vocab.start_symbols(unit).tolist()
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def candidate(i: int):
        j = after[i]
        if j < n and (made := vocab.merges.get((symbols[i], symbols[j]))) is not None:
            if not skipped(key, i, j, after[j], limit):
                return (vocab.rank_of[made], i, j, after[j], made)
        return None

    agenda = [c for i in range(n) if (c := candidate(i))]
    heapify(agenda)
    while agenda:
        _, i, j, end, made = heappop(agenda)
        if not (alive[i] and j < n and alive[j] and after[i] == j and after[j] == end):
            continue
        symbols[i], alive[j], after[i] = made, False, end
        if end < n:
            before[end] = i
        for at in (before[i], i):
            if at >= 0 and (c := candidate(at)):
                heappush(agenda, c)
    return vocab.finish([s for s, ok in zip(symbols, alive) if ok])


class _Rows(dict):
    """Unit -> its row among the spans, and its length in the low bits; new units get the next rows."""

    def __init__(self):
        self.used, self.new = 0, []

    def __missing__(self, unit: str) -> int:
        self[unit] = at = self.used << 6 | len(unit)
        self.used += len(unit)
        self.new.append(unit)
        return at


def segment_many(vocab: Vocabulary, units: list[str], keys, limit: int, spans, base, size) -> list[bytes]:
    """Segments many occurrences of short units side by side: each round merges the best candidate of every one.

    ``spans`` are rows of ``Vocabulary.spans``, ``base`` the one at which each occurrence's unit begins, ``size`` its
    length. Returns the piece numbers of each occurrence as 32-bit numbers. The result is that of ``segment``.
    """
    import numpy as np

    n, width = len(size), int(size.max())
    stride, columns, cut = width + 1, vocab.longest + 1, np.uint64(limit)
    flat, row = spans.reshape(-1), np.arange(n)
    inside = np.arange(stride)[None, :] < size[:, None]
    after = np.minimum(np.arange(1, stride + 1)[None, :], size[:, None]).reshape(-1)
    before = np.tile(np.arange(-1, width), n)
    rank = np.full((n, stride), _NONE, np.int32)
    ranks, alive = rank.reshape(-1), inside.copy().reshape(-1)

    def numbers(row, i, end):
        return flat.take((base.take(row) + i) * columns + (np.minimum(end - i, columns) - 1))

    def judge(row, i, j, end):
        """Ranks of the candidates that join ``[i, j)`` and ``[j, end)``; none where ``j`` is the end of the unit."""
        found = numbers(row, i, end)
        ok = np.flatnonzero((found >= 0) & (j < end))
        if limit:
            spot = _spot(i.take(ok), j.take(ok), end.take(ok)) + 1
            drawn = mix_array(keys.take(row.take(ok)) ^ mix_array(spot.view(np.uint64)))
            ok = ok[drawn >= cut]
        new = np.full(len(i), _NONE, np.int32)
        new[ok] = vocab.rank_of_number.take(found.take(ok))
        ranks[row * stride + i] = new

    live, i = np.nonzero(inside)
    judge(live, i, i + 1, np.minimum(i + 2, size.take(live)))
    live = row
    while len(live):
        i = rank.take(live, 0).argmin(1)
        at = live * stride + i
        go = np.flatnonzero(ranks.take(at) < _NONE)
        if len(go) < len(live):
            live, i, at = live.take(go), i.take(go), at.take(go)
        start = at - i
        gone = start + after.take(at)
        end = after.take(gone)
        alive[gone] = False
        ranks[gone] = _NONE
        after[at] = end
        before[start + end] = i
        p = before.take(at)
        has = np.flatnonzero(p >= 0)
        judge(
            np.concatenate([live, live.take(has)]),
            np.concatenate([i, p.take(has)]),
            np.concatenate([end, i.take(has)]),
            np.concatenate([after.take(start + end), end.take(has)]),
        )
    row, i = np.nonzero(alive.reshape(n, stride))
    made = numbers(row, i, after[row * stride + i]).astype(np.int32)
    ends = np.cumsum(np.bincount(row, minlength=n))
    data = made.tobytes()
    out = [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    for k in np.unique(row[made < 0]).tolist():  # characters that are no pieces become their bytes
        part = slice(ends[k - 1] if k else 0, ends[k])
        pairs = zip(i[part].tolist(), made[part].tolist())
        ids = [x for q, m in pairs for x in ([m] if m >= 0 else [vocab.byte_id[b] for b in units[k][q].encode()])]
        out[k] = np.array(ids, np.int32).tobytes()
    return out


class Encoder:
    """Encodes texts, each occurrence of a unit with draws of its own.

    Only the pieces on the spans of a unit are remembered, which do not depend on the draws; every occurrence is
    segmented with its draws.
    """

    def __init__(self, model: bytes, seed: int, dropout: float):
        self.vocab, self.seed = Vocabulary(model), seed
        self.limit = min(_WORD64, int(dropout * 2.0**64))
        self.units = re.compile(r"\n| *[^ \n]+| +" if self.vocab.splits_at_newline else r" *[^ ]+| +").findall
        self.pieces: list[bytes] = []
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.rows = _Rows()
        self.spans = np.zeros((0, self.vocab.longest + 1), self.vocab.number_of_node.dtype)

    def learn(self) -> None:
        """Makes the spans of new units."""
        import numpy as np

        made = self.vocab.spans(self.rows.new)
        end, self.rows.new = self.rows.used, []
        if end > len(self.spans):
            grown = np.empty((2 * end, made.shape[1]), made.dtype)
            grown[: end - len(made)] = self.spans[: end - len(made)]
            self.spans = grown
        self.spans[end - len(made) : end] = made

    def nodes(self, units: list[str], keys) -> list[int]:
        """Where ``pieces`` holds the segmentation of each occurrence of a short unit, until the next call."""
        import numpy as np

        if not self.limit and len(kinds := list(set(units))) < len(units):  # no draws: equal units are equal
            place = dict(zip(kinds, self.nodes(kinds, keys[: len(kinds)])))
            return list(map(place.__getitem__, units))
        at = np.fromiter(map(self.rows.__getitem__, units), np.int64, len(units))
        if self.rows.new:
            self.learn()
        order = np.argsort(at & 63, kind="stable")
        at, keys = at[order], keys[order]
        self.pieces = []
        for start in range(0, len(order), SIDE_BY_SIDE):
            part = slice(start, start + SIDE_BY_SIDE)
            mine = list(map(units.__getitem__, order[part].tolist()))
            self.pieces += segment_many(self.vocab, mine, keys[part], self.limit, self.spans, at[part] >> 6, at[part] & 63)
        node = np.empty(len(units), np.int64)
        node[order] = np.arange(len(units))
        return node.tolist()

    def encode(self, texts: list[str | None], salts: list[int]) -> list[bytes]:
        """Piece numbers of each text as 32-bit integers."""
        import numpy as np

        out = []
        for block in _blocks([len(t or "") for t in texts]):
            if len(self.rows) > REMEMBERED:
                self.forget()
            cut = [self.units(" " + t) if (t := texts[k]) else [] for k in block]
            many = [len(units) for units in cut]
            starts = np.cumsum([0, *many])
            seed = np.uint64(mix(self.seed & _WORD64))
            own = mix_array(np.array([salts[k] for k in block], np.int64).view(np.uint64) ^ seed)
            place = np.arange(starts[-1]) - np.repeat(starts[:-1], many)
            keys = mix_array(np.repeat(own, many) + place.astype(np.uint64))
            flat = [u for units in cut for u in units]
            apart = {}
            if max(map(len, flat), default=0) > LONG_UNIT:
                apart = {k: u for k, u in enumerate(flat) if len(u) > LONG_UNIT}
                for k in apart:
                    flat[k] = "\n"  # a place holder
            made = self.nodes(flat, keys) if flat else []
            parts = list(map(self.pieces.__getitem__, made))
            for k, unit in apart.items():
                parts[k] = np.array(segment(self.vocab, unit, int(keys[k]), self.limit), np.int32).tobytes()
            out += [b"".join(parts[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        return out


def _blocks(lengths: list[int], points: int = 200_000) -> Iterator[range]:
    """Ranges of texts of about so many code points, so that a block's units fit in memory."""
    start = total = 0
    for k, n in enumerate(lengths):
        total += n
        if total >= points:
            yield range(start, k + 1)
            start, total = k + 1, 0
    if start < len(lengths):
        yield range(start, len(lengths))


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """The text of piece numbers: their bytes, without the space put before the first word."""
    return b"".join(map(vocab.bytes_of.__getitem__, ids))[1:].decode()


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(model: bytes, seed: int, dropout: float) -> Encoder:
    """One encoder for each Python worker and setting; tasks of the worker share what it remembers."""
    at = (hash(model), seed, dropout)
    if at not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[at] = Encoder(model, seed, dropout)
    return _ENCODERS[at]


def _read(model: str) -> bytes:
    """The vocabulary file, of half a megabyte, read on the driver and sent with the tasks."""
    with open(model, "rb") as f:
        return f.read()


def _encoded(encoder: Encoder, texts, salts):
    """Blocks of an Arrow batch: its texts as strings, and their piece numbers."""
    import pyarrow.compute as pc

    for block in _blocks([n or 0 for n in pc.utf8_length(texts).to_pylist()]):
        part = texts.slice(block.start, len(block)).to_pylist()
        yield part, encoder.encode(part, salts.slice(block.start, len(block)).to_pylist())


def _lists(made: list[bytes]):
    """An Arrow list of piece numbers for each text."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0] + [len(m) // 4 for m in made]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), np.int32)))


def encode(text: Column, salt: Column, model: str = MODEL, seed: int = 1, dropout: float = 0.1) -> Column:
    """Piece numbers of whole texts as ``array<int>``.

    Merges run in order of score, leftmost first; each candidate merge is skipped with probability ``dropout`` by a
    hash keyed with the seed, the row (``salt``, say its id, and the text), the place of the unit (a word with the blanks
    before it) in the row, and the candidate's place in the unit. So every occurrence of a word draws for itself, while
    equal rows with equal salts, null among them, give equal pieces. With ``dropout=0`` the result is the tokenizer's
    own. Null and empty texts have no pieces. Characters outside the vocabulary, and U+2581 itself, become byte pieces,
    so any text decodes to itself.
    """
    data = _read(model)

    @F.arrow_udf("array<int>")
    def run(texts, salts):
        import pyarrow as pa

        blocks = _encoded(_encoder(data, seed, dropout), texts, salts)
        return pa.concat_arrays([_lists([]), *(_lists(made) for _, made in blocks)])

    # Marked so that the planner runs it once, also where its result is read twice; it is a function of its input.
    return run.asNondeterministic()(text, F.xxhash64(salt.cast("string"), text))


def encode_and_check(text: Column, salt: Column, model: str = MODEL, seed: int = 1, dropout: float = 0.1) -> Column:
    """Struct of the ``ids`` of ``encode`` and ``lossless``: they decode to the text, null counting as empty.

    One worker does both, so neither the pieces nor the decoded text cross to another one.
    """
    data = _read(model)

    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def run(texts, salts):
        import numpy as np
        import pyarrow as pa

        encoder = _encoder(data, seed, dropout)
        ids, same = [_lists([])], []
        for part, made in _encoded(encoder, texts, salts):
            ids.append(_lists(made))
            same += [decode_ids(encoder.vocab, np.frombuffer(m, np.int32).tolist()) == (t or "") for t, m in zip(part, made)]
        return pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array(same, pa.bool_())], ["ids", "lossless"])

    # Marked so that the planner runs it once, also where a decoder reads its result; it is a function of its input.
    return run.asNondeterministic()(text, F.xxhash64(salt.cast("string"), text))


def decode(ids: Column, model: str = MODEL) -> Column:
    """Texts of piece numbers; null gives null, no pieces the empty text."""
    data = _read(model)

    @F.arrow_udf("string")
    def run(lists):
        import pyarrow as pa

        vocab = _encoder(data, 0, 0.0).vocab if not _ENCODERS else next(iter(_ENCODERS.values())).vocab
        ends, values, known = lists.offsets.to_pylist(), lists.values.to_numpy(), lists.is_valid().to_pylist()
        spans = zip(known, ends, ends[1:])
        return pa.array([decode_ids(vocab, values[a:b].tolist()) if ok else None for ok, a, b in spans], pa.string())

    return run(ids)


def tokenize(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, seed: int = 1,
    dropout: float = 0.1,
) -> DataFrame:
    """Adds ``ids``, ``n_pieces`` and ``lossless`` (the decoded text equals the text, null counting as empty).

    Keeps every row and column; repeated rows and null ids are allowed, an empty table gives no rows. Columns of the
    input may have any names but these three.
    """
    out = docs.withColumn("ids", encode_and_check(F.col(text_col), F.col(id_col), model, seed, dropout))
    ids = F.col("ids")["ids"]
    return out.withColumns({"n_pieces": F.size(ids).cast("long"), "lossless": F.col("ids")["lossless"], "ids": ids})
