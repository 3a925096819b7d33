"""Conversations without quotes: quotation linking between messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import stored

BLANK_RUN = "[\\x20\\x09-\\x0D]+"
MESSAGE = ["conv_id", "turn", "digest"]


def normal(text: Column) -> Column:
    """Lower case, runs of ASCII white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), BLANK_RUN, " "))


def passage_key(text: Column) -> Column:
    return F.md5(normal(text))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """Runs of lines of one quote level: ``(conv_id, turn, digest, run, level, text)``; level 0 is the message's own.

    A line's level is the number of ``>`` at its start, with single spaces allowed after each. Windows run inside one
    message only.
    """
    lines = messages.select(*MESSAGE, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "line"))
    mark = F.regexp_extract("line", "^(?:> ?)*", 0)
    lines = lines.select(
        *MESSAGE, "at",
        F.length(F.regexp_replace(mark, " ", "")).alias("level"),
        F.expr("substring(line, length(regexp_extract(line, '^(?:> ?)*', 0)) + 1)").alias("line"),
    )
    order = Window.partitionBy(*MESSAGE).orderBy("at")
    lines = lines.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int"))
    lines = lines.withColumn("run", F.sum("new").over(order))
    runs = lines.groupBy(*MESSAGE, "run", "level").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
    return runs.select(*MESSAGE, "run", "level", F.array_join("l.line", "\n").alias("text"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Reply links and own texts: one row per different message of ``messages(conv_id, turn, role, text)``.

    Returns ``conv_id, turn, role, digest, copies, own_text, n_quotes, n_linked, reply_to, root_turn, depth``. Each
    quoted passage is hashed in normal form and joined to the earliest message of the conversation, before the quoting
    one, whose own text or one of whose own lines it equals. A message replies to the latest turn that its outermost
    quotes link to (``reply_to``; null if none). ``root_turn`` is the start of its reply chain, ``depth`` its place in
    it; ordering by ``root_turn, depth, turn`` puts every message after what it answers.

    Equal rows are one message with ``copies`` above one. A null text is empty. Rows with a null conversation or turn
    are kept and link to nothing. Blank passages link to nothing. Messages of one turn with different texts are
    different messages. An empty table gives no rows; other columns are not read.

    No step needs a conversation in one task: joins and aggregates are keyed by passage or message, and chains are
    followed by doubling, one written table a round.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    body = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws("\x00", F.coalesce("role", F.lit("\x01")), F.when(F.col("text").isNull(), "\x01"), body))
    rows = rows.withColumn("digest", digest)
    rows = rows.groupBy(*MESSAGE).agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("copies")
    )
    runs = stored(quoted_passages(rows), "runs")
    own = runs.filter("level = 0").groupBy(*MESSAGE).agg(
        F.sort_array(F.collect_list(F.struct("run", "text"))).alias("l")
    )
    own = own.select(*MESSAGE, F.regexp_replace(F.array_join("l.text", "\n"), "^[\r\n]+|[\r\n]+$", "").alias("own_text"))
    sources = own.filter("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.explode(F.array_append(F.split("own_text", "\n"), F.col("own_text"))).alias("passage")
    )
    sources = sources.filter(normal(F.col("passage")) != "").groupBy("conv_id", passage_key(F.col("passage")).alias("key"))
    sources = sources.agg(F.min("turn").alias("source_turn"))
    quotes = runs.filter("level > 0").withColumn("key", passage_key(F.col("text")))
    found = quotes.join(sources, ["conv_id", "key"], "left")
    hit = F.when(F.col("source_turn") < F.col("turn"), F.col("source_turn"))
    found = found.groupBy(*MESSAGE).agg(
        F.count("*").alias("n_quotes"),
        F.count(hit).alias("n_linked"),
        F.max(F.when(F.col("level") == 1, hit)).alias("reply_to"),
    )
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"x.{c}")) for c in MESSAGE]
    out = rows.drop("text").alias("m").join(own.alias("x"), same, "left").select("m.*", "x.own_text")
    out = out.alias("m").join(found.alias("x"), same, "left").select("m.*", "x.n_quotes", "x.n_linked", "x.reply_to")
    out = stored(out, "linked")
    links = out.filter("reply_to is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up"))
    chains = chain_roots(links)
    out = out.join(chains, ["conv_id", "turn"], "left")
    linked = F.col("reply_to").isNotNull()
    return out.select(
        "conv_id", "turn", "role", "digest", "copies",
        F.coalesce("own_text", F.lit("")).alias("own_text"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "reply_to",
        F.when(linked, F.col("root_turn")).otherwise(F.col("turn")).alias("root_turn"),
        F.when(linked, F.col("depth")).otherwise(0).cast("long").alias("depth"),
    )


def chain_roots(links: DataFrame) -> DataFrame:
    """Follows ``links(conv_id, turn, up)``, where up is earlier: ``(conv_id, turn, root_turn, depth)`` by doubling."""
    chains = stored(links.select("conv_id", "turn", F.col("up").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        next_up = chains.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("u"), F.col("depth").alias("d"))
        grown = stored(chains.join(next_up, ["conv_id", "root_turn"], "left"), "chains")
        if grown.filter("u is not null").isEmpty():
            return chains
        chains = grown.select(
            "conv_id", "turn", F.coalesce("u", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")
        )


def chat_lines(linked: DataFrame) -> DataFrame:
    """Adds ``chat``, each message as a role line, its own text and an end mark."""
    role = F.coalesce("role", F.lit("unknown"))
    return linked.withColumn("chat", F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("own_text"), F.lit("\n<|end|>\n")))


def as_mail(conversations: DataFrame) -> DataFrame:
    """Conversations in the form of mail threads: each message quotes the turn before it and what that one quoted.

    The turn before is its message with the least text; ``> `` stands before its lines and ``> > `` before those of
    the turn before that.
    """
    said = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def back(n: int) -> DataFrame:
        return said.select(F.col("conv_id"), (F.col("turn") + n).alias("turn"), F.col("said").alias(f"said{n}"))

    def quote(c: str, mark: str) -> Column:
        return F.concat(F.lit(mark), F.regexp_replace(c, "\n", "\n" + mark))

    mail = conversations.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    text = F.concat_ws("\n", quote("said2", "> > "), quote("said1", "> "), F.coalesce("text", F.lit("")))
    return mail.select("conv_id", "turn", "role", text.alias("text"))
