"""Secret scan over a trigram inverted index, in DataFrame expressions only."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import stored
from parcelflow.llm.trigrams import ANY, trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the group that must have at least ``least`` characters.

    Matches are leftmost and do not overlap; those with a shorter group are dropped after matching.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def query(self) -> frozenset:
        return trigram_query(self.pattern)


# The base kinds of the contract. A run of its characters is matched whole, so the least length of
# "access" and "hex" can stand in the pattern itself.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Published formats of credentials.
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("url_login", r"""://[^\x00-\x20:/@"'<>]{1,64}:[^\x00-\x20:/@"'<>]{1,64}@"""),
)
RULES = BASE_RULES + MORE_RULES

HIT = "array<struct<rule:int,at:int,before:int,length:int,counted:int,secret:string>>"


def any_of(wanted) -> str:
    """A pattern that stops before each of the trigrams and captures it; alternatives share their first letter."""
    quote = lambda s: "".join(c if c.isalnum() else f"\\x{ord(c):02x}" if ord(c) < 256 else c for c in s)
    tails = defaultdict(list)
    for gram in sorted(wanted):
        tails[gram[0]].append(quote(gram[1:]))
    return f"(?=({'|'.join(f'{quote(head)}(?:{chr(124).join(rest)})' for head, rest in tails.items())}))"


def trigrams_of(text: Column, wanted=None) -> Column:
    """The different trigrams of a text in lower case, all of them or those wanted."""
    pattern = "(?s)(?=(...))" if wanted is None else any_of(wanted)
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))


def hits(text: Column, number: int, rule: Rule) -> Column:
    """Every match of a rule: place in the list, code points before it since the last match, lengths, the secret.

    The text is split at the matches, so places need no search for each match.
    """
    pattern = F.lit(rule.pattern)
    whole, secret = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (0, rule.group))
    gaps = F.split(text, rule.pattern, -1)
    row = lambda z, i: F.struct(
        F.lit(number).alias("rule"),
        i.cast("int").alias("at"),
        F.length(z["gap"]).alias("before"),
        F.length(z["whole"]).alias("length"),
        F.length(z["secret"]).alias("counted"),
        z["secret"].alias("secret"),
    )
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), secret.alias("secret"))
    found = F.filter(F.transform(zipped, row), lambda h: h["length"].isNotNull())
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(HIT))


def matches(query: frozenset, held: Column) -> Column:
    """Whether an array of trigrams satisfies a Boolean trigram query."""
    options = [reduce_and([F.array_contains(held, g) for g in sorted(option)]) for option in sorted(map(sorted, query))]
    found = options[0]
    for option in options[1:]:
        found = found | option
    return found


def reduce_and(tests: list[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found & test
    return found


def candidates(postings: DataFrame, queries: dict[int, frozenset]) -> DataFrame:
    """``(key, rules)``: the rules whose query the postings of a text satisfy.

    Posting lists are intersected by gathering the trigrams of each key, which are no more than the queries name.
    """
    named = sorted({g for q in queries.values() for option in q for g in option})
    held = postings.filter(F.col("gram").isin(named)).groupBy("key").agg(F.collect_set("gram").alias("held"))
    rules = F.array(*[F.when(matches(q, F.col("held")), F.lit(n)) for n, q in queries.items()])
    return held.select("key", F.array_compact(rules).alias("rules")).filter(F.size("rules") > 0)


def find_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: ``(id, spans)``, one row per input row.

    ``spans`` is an array of ``(start, rule, end, kind, secret)`` by start, then place of the rule in ``rules``; places
    are code points, ends exclusive. Matches of one rule do not overlap, those of different rules may.

    A first pass over the texts takes the trigrams that the rules' queries name and applies the rules that have no
    query. The trigrams become postings sorted by trigram; rules are looked up there, and only texts that satisfy a
    rule's query are read for it again. A second occurrence of a text under the same id is looked at once.

    A null text is empty and has no spans, as an empty one. Rows with equal or null ids are told apart by their texts;
    equal rows get equal spans. An empty table gives no rows. Columns of ``docs`` may have any names; only the id and
    the spans come out. Texts may be of any length: work is linear in it.
    """
    queries = {n: rule.query() for n, rule in enumerate(rules)}
    blind = [n for n, q in queries.items() if q & ANY]
    queries = {n: q for n, q in queries.items() if n not in blind}
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text)))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"))

    named = {g for q in queries.values() for option in q for g in option}
    grams = trigrams_of(F.col("text"), named) if named else F.array().cast("array<string>")
    direct = F.concat(*[hits(F.col("text"), n, rules[n]) for n in blind], F.array().cast(HIT))
    seen = stored(rows.select("id", "key", grams.alias("grams"), direct.alias("hits")), "seen")
    postings = seen.select(F.explode("grams").alias("gram"), "key").sortWithinPartitions("gram")
    postings = stored(postings, "postings")

    looked_up = stored(candidates(postings, queries), "candidates") if queries else None
    found = seen.filter(F.size("hits") > 0).select("key", "hits")
    if looked_up is not None:
        verify = [
            F.when(F.array_contains("rules", n), hits(F.col("text"), n, rules[n])).otherwise(F.array().cast(HIT))
            for n in queries
        ]
        again = rows.join(looked_up, "key").select("key", F.concat(*verify).alias("hits")).filter(F.size("hits") > 0)
        found = found.unionByName(again)
    # Equal rows say the same; one copy of each hit is enough.
    single = found.select("key", F.explode("hits").alias("h")).select("key", "h.*").distinct()
    upto = Window.partitionBy("key", "rule").orderBy("at")
    end = F.sum(F.col("before") + F.col("length")).over(upto)
    placed = single.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    placed = placed.filter(F.col("counted") >= least).select(
        "key", F.struct("start", "rule", "end", kind.alias("kind"), "secret").alias("span")
    )
    spans = stored(placed.groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("spans")), "spans")
    out = seen.select("id", "key").join(spans, "key", "left")
    none = F.array().cast(spans.schema["spans"].dataType)
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def span_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans written as ``kind:start:end``."""
    base = [r.kind for r in BASE_RULES]
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
