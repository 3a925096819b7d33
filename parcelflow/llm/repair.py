"""Structure repair of conversations by a shortest path over big-integer weights.

Rows of a conversation are edited so that role initials read ``(s?(ua)+)?``. A path through states is weighed by one
integer: its high digits are the cost and its low digits, a fixed number of three bits each, are the edits' letters
from the first on, with zeros after the last. The smallest integer is then the cheapest repair and among these the one
whose letters come first, also where one is the beginning of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import BLANKS, stored

#: Rows and text bytes of a block, the largest part of a conversation that a task holds at once.
BLOCK, BLOCK_BYTES = 256, 1 << 22
#: Digits of the letters; their order is that of the letters.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = str.maketrans("1234", "DIKR")
DIGITS = str.maketrans("DIKR", "1234")
#: States by the last initial so far, "" before the first. What may follow a state besides "s" at the beginning.
STATES = ("", "s", "u", "a")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
RIGHT_PAIRS = ("su", "ua", "au")
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1


class Weights:
    """Integers of a cost and at most ``room`` letters."""

    def __init__(self, room: int):
        self.room, self.bits = room, 3 * room
        self.mask = (1 << self.bits) - 1

    def make(self, cost: int, letters: str) -> int:
        return cost << self.bits | int(letters.translate(DIGITS).ljust(self.room, "0") or "0", 8)

    def before(self, letter: int, cost: int, weight: int) -> int:
        """Weight of a path that starts with an edit and goes on as ``weight`` says."""
        low = (weight & self.mask) >> 3 | letter << self.bits - 3
        return (weight >> self.bits) + cost << self.bits | low

    def read(self, weight: int) -> tuple[int, str]:
        letters = format(weight & self.mask, "o").zfill(self.room).rstrip("0").translate(LETTERS)
        return weight >> self.bits, letters


def least(*weights):
    return min((w for w in weights if w is not None), default=None)


def step(weights: Weights, after: dict, initial: str, truncated: bool, must_go: bool) -> dict:
    """Smallest weight from before a row to the goal for each state, given those from after it.

    Inserts come right before the row's own edit. Two inserts in a row cost more than going without both.
    """

    def edit(letter, cost, to):
        return None if after[to] is None else weights.before(DIGIT[letter], cost, after[to])

    own = {}
    for state in STATES:
        ways = [edit("D", DELETE, state)]
        if not must_go:
            if initial == NEXT[state] or (initial == "s" and not state):
                ways.append(edit("K", TRUNCATED * truncated, initial))
            ways.append(edit("R", REROLE + TRUNCATED * truncated, NEXT[state]))
        own[state] = least(*ways)
    found = {}
    for state in STATES:
        inner = own[NEXT[state]]
        found[state] = least(own[state], None if inner is None else weights.before(DIGIT["I"], INSERT, inner))
    return found


def goal(weights: Weights) -> dict:
    """Weights from the end of a conversation: nothing or an answer is a good end, an open question gets an answer."""
    insert = lambda w: weights.before(DIGIT["I"], INSERT, w)
    return {"": 0, "a": 0, "u": insert(0), "s": insert(insert(0))}


def block_table(rows: list) -> tuple[list, list]:
    """Costs and letters of the best way through a block for each pair of a state before it and one after it."""
    weights = Weights(2 * len(rows) + 2)
    costs, letters = [None] * 16, [None] * 16
    for k, end in enumerate(STATES):
        best = {s: 0 if s == end else None for s in STATES}
        for row in reversed(rows):
            best = step(weights, best, row["role"][:1], row["fault"] == "truncated", row["fault"] in ("blank", "duplicate"))
        for j, start in enumerate(STATES):
            if best[start] is not None:
                costs[4 * j + k], letters[4 * j + k] = weights.read(best[start])
    return costs, letters


def edited(rows, letters: str, state: str):
    """``(role, text, edit)`` of the rows that the letters leave, beginning in a state."""
    left = iter(rows)
    for letter in letters:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        state = row["role"][:1] if letter == "K" else NEXT[state]
        yield (row["role"] if letter == "K" else ROLE[state], "" if row is None else row["text"], letter)


def units(batches):
    """Single rows of folded ones: of equal rows at one place the first may stay, the others repeat it."""
    for batch in batches:
        for row in batch.to_pylist():
            if not row["n"]:
                yield {**row, "fault": None}  # says only that the conversation exists
            for copy in range(row["n"]):
                again = row["fault"] is None and (copy or row["again"])
                gone = again or row["fault"] == "blank"
                fault = "duplicate" if again else row["fault"] or ("truncated" if row["cut"] else None)
                yield {**row, "fault": fault, "text": None if gone else row["text"]}


BLOCKS = (
    "block long, conv string, costs array<long>, letters array<string>, blank long, duplicate long, truncated long, "
    "illegal long, first string, last string, low long, high long, turns long, "
    "rows array<struct<role:string,text:string,fault:string>>"
)


def cut(batches):
    """Blocks of sorted rows; a block has rows of one conversation in this partition, and numbers follow the order."""
    import pyarrow as pa
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33

    def block(held):
        rows = [r for r in held if r["n"]]
        costs, letters = block_table(rows)
        initials = [r["role"][:1] for r in rows]
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        faults = [r["fault"] for r in rows]
        return {
            "block": number, "conv": held[0]["conv"], "costs": costs, "letters": letters,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in RIGHT_PAIRS for a, b in zip(initials, initials[1:])),
            "first": initials[0] if rows else None, "last": initials[-1] if rows else None,
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
            "turns": sum(i == 0 or t != turns[i - 1] for i, t in enumerate(turns)),
            "rows": [{k: r[k] for k in ("role", "text", "fault")} for r in rows],
        }

    held, size, out = [], 0, []
    for row in units(batches):
        if held and (row["conv"] != held[0]["conv"] or len(held) >= BLOCK or size >= BLOCK_BYTES):
            out.append(block(held))
            number, held, size = number + 1, [], 0
        held.append(row)
        size += len(row["text"] or "")
        if len(out) >= 64 or size >= BLOCK_BYTES:
            yield from as_batches(out, pa)
            out = []
    if held:
        out.append(block(held))
    yield from as_batches(out, pa)


def as_batches(rows: list, pa, schema: str = BLOCKS):
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema(schema))


def arrow_schema(ddl: str):
    """Arrow's form of a schema of this module, made without a JVM."""
    import pyarrow as pa

    plain = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

    def kind(name):
        if name in plain:
            return plain[name]
        members = name.removeprefix("array<struct<").removesuffix(">>").split(",")
        return pa.list_(pa.struct([(m.split(":")[0], plain[m.split(":")[1]]) for m in members]))

    return pa.schema([(name, kind(of)) for name, of in (part.split(" ") for part in ddl.split(", "))])


SOLVED = (
    "block long, conv string, start string, end string, letters string, closing string, blocks long, gaps long, blank long, "
    "duplicate long, truncated long, illegal long, cost long, audit string"
)


def solve(batches):
    """Chooses the way through all blocks of each conversation, which come last block first.

    Gives each block its state before it and its letters, and the first one the conversation's figures. Memory
    holds the tables of one conversation's blocks and one weight per state, whose size is that of the audit.
    """
    import pyarrow as pa

    held, out = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv"] != held[0]["conv"]:
                out += solved(held)
                held = []
            held.append(row)
            if len(out) >= 512:
                yield from as_batches(out, pa, SOLVED)
                out = []
    if held:
        out += solved(held)
    yield from as_batches(out, pa, SOLVED)


def solved(blocks: list) -> list:
    """Rows of ``SOLVED`` of one conversation; ``blocks`` are its blocks, last first."""
    weights = Weights(2)
    best, choices = goal(weights), []
    for block in blocks:
        wider = Weights(weights.room + max(map(len, filter(None, block["letters"])), default=0))
        found, chosen = dict.fromkeys(STATES), {}
        for j, start in enumerate(STATES):
            for k, end in enumerate(STATES):
                letters = block["letters"][4 * j + k]
                if letters is None or best[end] is None:
                    continue
                rest = (best[end] & weights.mask) << 3 * (wider.room - weights.room) >> 3 * len(letters)
                cost = block["costs"][4 * j + k] + (best[end] >> weights.bits)
                weight = wider.make(cost, letters) | rest
                if found[start] is None or weight < found[start]:
                    found[start], chosen[start] = weight, (end, letters)
        weights, best = wider, found
        choices.append(chosen)
    cost, audit = weights.read(best[""])
    out, state = [], ""
    for block, chosen in zip(reversed(blocks), reversed(choices)):
        end, letters = chosen[state]
        out.append({**dict.fromkeys(SOLVED_NAMES), "block": block["block"], "conv": block["conv"], "start": state, "end": end})
        out[-1].update(letters=letters, closing="", blocks=len(blocks))
        state = end
    out[-1]["closing"] = {"u": "I", "s": "II"}.get(state, "")
    out[0].update(figures(blocks[::-1]), cost=cost, audit=audit)
    return out


SOLVED_NAMES = [part.split()[0] for part in SOLVED.split(", ")]


def figures(blocks: list) -> dict:
    """Sums over a conversation's blocks in order; pairs and turns that span two blocks count once."""
    told = {f: sum(b[f] for b in blocks) for f in ("blank", "duplicate", "truncated", "illegal")}
    real = [b for b in blocks if b["first"] is not None]
    told["illegal"] += sum(a["last"] + b["first"] not in RIGHT_PAIRS for a, b in zip(real, real[1:]))
    timed = [b for b in blocks if b["low"] is not None]
    turns = sum(b["turns"] for b in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
    told["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
    return told


def folded(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text with its count ``n``, and what is wrong with it.

    ``again`` tells that the role and the text occur at an earlier turn too.
    """
    text = F.col("text")
    last = F.substring(F.btrim(text, F.lit(BLANKS)), -1, 1)
    blank = F.btrim(text, F.lit(BLANKS)) == ""
    same = F.md5(F.to_json(F.struct("conv", "role", "text"), {"ignoreNullFields": "false"}))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = stored(
        rows.select(
            "*",
            same.alias("same"),
            F.when(blank, "blank").alias("fault"),
            (~blank & ~last.isin(".", "!", "?")).alias("cut"),
        ),
        "folded",
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = stored(rows.groupBy("same").agg(F.min(place).alias("first")), "first")
    return rows.join(first, "same").withColumn("again", F.col("first") < place).drop("first")


def blocks_of(rows: DataFrame) -> DataFrame:
    """Sorted blocks of all conversations; ranges of the order are dealt to tasks, so long conversations are split."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "same"]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = folded(rows).repartitionByRange(count, *order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(cut, BLOCKS), "blocks")


class Repair:
    """Repaired conversations of ``rows(conv, turn, role, text, n)``.

    ``n`` says how often a row is there; a row with 0 only says that its conversation exists. ``conv`` is text.
    """

    def __init__(self, rows: DataFrame):
        self.blocks = blocks_of(rows)
        tables = self.blocks.drop("rows")
        count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        last_first = [F.col("conv"), F.col("block").desc()]
        # Only the tables of blocks meet here: one for 256 rows of a long conversation, without texts.
        dealt = tables.repartition(count, "conv").sortWithinPartitions(*last_first)
        self.solved = stored(dealt.mapInArrow(solve, SOLVED), "solved")

    def report(self) -> DataFrame:
        """``conv`` with its figures, cost and audit."""
        return self.solved.filter("cost is not null").select(
            "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
        )

    def pieces(self) -> DataFrame:
        """``conv, block, blocks, messages``: the repaired messages of each block, ``(role, text, edit)`` in order."""

        def apply(batches):
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    out = []
                    for row in batch.slice(at, 64).to_pylist():
                        kept = [*edited(row["rows"], row["letters"], row["start"]), *edited([], row["closing"], row["end"])]
                        messages = [dict(zip(("role", "text", "edit"), m)) for m in kept]
                        out.append({**{k: row[k] for k in ("conv", "block", "blocks")}, "messages": messages})
                    yield from as_batches(out, pa, PIECES)

        chosen = self.solved.select("block", "start", "end", F.col("letters").alias("chosen"), "closing", "blocks")
        rows = self.blocks.select("block", "conv", "rows").join(chosen, "block").withColumnRenamed("chosen", "letters")
        return rows.mapInArrow(apply, PIECES)

    def messages(self) -> DataFrame:
        """One row per repaired message: ``conv, block, at, role, text, edit``; block and at give the order."""
        return self.pieces().select("conv", "block", F.posexplode("messages").alias("at", "m")).select(
            "conv", "block", "at", "m.*"
        )

    def digests(self) -> DataFrame:
        """SHA-256 of each conversation's repaired ``role:text`` lines.

        A conversation of one block is hashed where it lies. The blocks of longer ones stream through one hasher each,
        in order: the digest is one chain over all their bytes.
        """
        lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
        pieces = stored(
            self.pieces().select("conv", "block", "blocks", F.size("messages").alias("n"), F.array_join(lines, "\n").alias("text")),
            "pieces",
        )
        short = pieces.filter("blocks = 1").select("conv", F.sha2("text", 256).alias("repaired_sha256"))

        def chain(batches):
            import hashlib

            import pyarrow as pa

            conv, digest, any_yet = None, None, False
            for batch in batches:
                for row in batch.to_pylist():
                    if digest is None or row["conv"] != conv:
                        if digest is not None:
                            yield from as_batches([{"conv": conv, "repaired_sha256": digest.hexdigest()}], pa, DIGESTS)
                        conv, digest, any_yet = row["conv"], hashlib.sha256(), False
                    if row["n"]:
                        digest.update(b"\n" * any_yet + row["text"].encode())
                        any_yet = True
            if digest is not None:
                yield from as_batches([{"conv": conv, "repaired_sha256": digest.hexdigest()}], pa, DIGESTS)

        count = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        long = pieces.filter("blocks > 1").repartition(count, "conv").sortWithinPartitions("conv", "block")
        return short.unionByName(long.mapInArrow(chain, DIGESTS))


PIECES = "conv string, block long, blocks long, messages array<struct<role:string,text:string,edit:string>>"
DIGESTS = "conv string, repaired_sha256 string"


def damaged(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Rows for ``Repair``, damaged by the remainder of a checksum of conversation and turn; nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word(conv_col), F.lit(":"), word("turn")).cast("binary")) % 20
    gone = kind == 0

    def unless_gone(value: Column, otherwise):
        return F.when(gone, F.lit(otherwise)).otherwise(value)

    text = F.when(kind == 1, "").when(kind == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    return conversations.select(
        F.col(conv_col).cast("string").alias("conv"),
        unless_gone(F.col("turn").cast("long"), None).alias("turn"),
        unless_gone(F.when(kind == 4, "user").otherwise(word("role")), "").alias("role"),
        unless_gone(text, "").alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def repair_report(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Damages all conversations, repairs them and reports: one row per conversation with its figures and digest.

    Null roles and texts are one space. Rows of one turn go by role, then by a digest of the text, and equal rows stand
    side by side. A null turn comes first; null conversation ids are one conversation. Conversations that lost all
    their rows have zeros, an empty audit and the digest of an empty text. An empty table gives no rows. Other columns
    of ``conversations`` may have any names. Texts may be of any length: a block ends after 4 MiB of text, though a
    text itself is never cut.

    Ranges of the sorted rows go to tasks, so a conversation of any length is cut into blocks; only their tables of 16
    weights meet. Its audit is one value of the result, and so is the digest of all its text.
    """
    done = Repair(damaged(conversations, conv_col))
    report, digests = done.report(), done.digests().withColumnRenamed("conv", "__conv")
    told = report.join(digests, report["conv"].eqNullSafe(digests["__conv"]))
    kind = conversations.schema[conv_col].dataType
    return told.withColumn(conv_col, F.col("conv").cast(kind)).select(
        conv_col, *report.columns[1:], "repaired_sha256"
    )
