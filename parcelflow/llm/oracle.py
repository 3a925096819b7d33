"""SQL twins of the training-data queries, for an independent engine over the same tables."""

from parcelflow.llm.secret_scan import BASE_RULES, RULES

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_matches(number: int, rule) -> str:
    """Matches of one rule of the secret scan, with the gaps before them."""
    pattern = quoted(rule.pattern)
    return f"""SELECT doc_id, {number} AS rule, {quoted(rule.kind)} AS kind, {rule.least} AS least,
           regexp_extract_all(text, {pattern}, 0) AS whole, regexp_extract_all(text, {pattern}, {rule.group}) AS secret,
           string_split_regex(text, {pattern}) AS gaps FROM texts WHERE regexp_matches(text, {pattern})"""




def clustering_round(n: int) -> str:
    """Centers after one more round of the centroid clustering."""
    return f"""m{n} AS MATERIALIZED (
    SELECT vec_id, v, min({SQUARED} * 8 + c) AS best FROM kept CROSS JOIN c{n - 1} GROUP BY vec_id, v
), s{n} AS (
    SELECT best % 8 AS c, i, sum(x) AS s, count(*) AS n
    FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM m{n}) GROUP BY 1, 2
), f{n} AS (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM s{n} GROUP BY c
), c{n} AS MATERIALIZED (
    SELECT o.c, coalesce(f.w::BIGINT[], o.w) AS w FROM c{n - 1} o LEFT JOIN f{n} f ON o.c = f.c
)"""


SQUARED = "list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def edit(letter: str, cost: str, rest: str, line: str = "''") -> str:
    """A path of repairs that begins with one edit; paths compare by cost, then letters."""
    return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 'o': {line} || {rest}.o}}"


FOLLOWS = {"n": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def own_edits(state: str) -> str:
    """The cheapest path from a state before a row, if nothing is inserted right there."""
    then = FOLLOWS[state]
    text = "r.role || ':' || r.text"
    keeps = [f"WHEN r.initial = '{then}' THEN {edit('K', 'r.cut', f'w.{then}', f'chr(10) || {text}')}"]
    if state == "n":
        keeps.append(f"WHEN r.initial = 's' THEN {edit('K', 'r.cut', 'w.s', f'chr(10) || {text}')}")
    rerole = edit("R", "2 + r.cut", f"w.{then}", f"chr(10) || '{NAMES[then]}:' || r.text")
    return (
        f"least({edit('D', '3', f'w.{state}')}, CASE WHEN NOT r.gone THEN CASE {' '.join(keeps)} END END, "
        f"CASE WHEN NOT r.gone THEN {rerole} END) AS {state}"
    )


def with_insert(state: str) -> str:
    then = FOLLOWS[state]
    return f"least({state}, {edit('I', '2', then, f'chr(10) || {quoted(NAMES[then])} || {quoted(chr(58))}')}) AS {state}"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op2_line_dedup": f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM lines
), frequent AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.pos, k.line, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS dropped
    FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op9_warc": f"""
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digests AS (
    SELECT page_id, octet_length(payload) AS bytes, sha1(payload) AS hex FROM payloads
), coded AS (
    SELECT page_id, bytes, hex, translate(
        {" || ".join(f"upper(to_base(('0x' || substr(hex, {1 + 5 * i}, 5))::BIGINT, 32, 4))" for i in range(8))},
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
    FROM digests
), first AS (
    SELECT hex, min(page_id) AS first_id FROM digests GROUP BY hex
)
SELECT c.page_id, c.bytes AS payload_bytes, c.payload_digest,
       CASE WHEN c.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN c.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM coded c JOIN first f ON c.hex = f.hex
""",
    "op7_substring_dedup": """
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), words AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split
), starts AS (
    SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS pos FROM split WHERE len(words) >= 35
), windows AS (
    SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + 34), ' ')) AS passage FROM starts
), counted AS (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY passage) > 1 AS repeated FROM windows
), marked AS (
    SELECT w.doc_id, w.pos, w.word, coalesce(bool_or(coalesce(c.repeated, false)) OVER (
        PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS removed
    FROM words w LEFT JOIN counted c ON w.doc_id = c.doc_id AND w.pos = c.pos
), kept AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed,
           coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op11_secret_scan": f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), found AS (
    {" UNION ALL ".join(rule_matches(n, r) for n, r in enumerate(RULES))}
), numbered AS (
    SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found
), placed AS (
    SELECT doc_id, rule, kind, least, secret[i] AS secret, length(whole[i]) AS size,
           list_sum(list_transform(gaps[:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0) AS start
    FROM numbered
), spans AS (
    SELECT doc_id, rule, kind, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span,
           kind IN ({", ".join(quoted(r.kind) for r in BASE_RULES)}) AS base
    FROM placed WHERE length(secret) >= least
), told AS (
    SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
           string_agg(span, ',' ORDER BY start, rule) FILTER (base) AS base,
           string_agg(span, ',' ORDER BY start, rule) AS spans
    FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(t.n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)},
       sha256(coalesce(t.base, '')) AS base_sha256, coalesce(t.spans, '') AS spans
FROM documents d LEFT JOIN told t ON d.doc_id = t.doc_id
""",
    "op12_centroid_clustering": f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS w FROM kept
    QUALIFY c < 8
), {", ".join(clustering_round(n) for n in range(1, 11))}, assigned AS (
    SELECT vec_id, min({SQUARED} * 8 + c) AS best FROM kept CROSS JOIN c10 GROUP BY vec_id
), told AS (
    SELECT vec_id, (best % 8)::INTEGER AS cluster, (best // 8)::BIGINT AS distance FROM assigned
)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM told JOIN c10 ON c = cluster
""",
    "op13_conversation_repair": f"""
WITH RECURSIVE told AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS letters
    FROM conversations
), bits AS (
    SELECT *, list_prepend(4294967295::BIGINT, flatten(list_transform(letters,
        lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))) AS steps FROM told
), kinds AS (
    SELECT *, xor(list_reduce(steps, lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS kind
    FROM bits
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           left(role, 1) AS initial, trim(text, {BLANKS}) AS bare FROM damaged
), judged AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM placed
), numbered AS (
    SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS cut FROM judged
), walk AS (
    SELECT conv_id, max(i) + 1 AS i, {{'c': 0, 'a': '', 'o': ''}} AS n,
           {{'c': 4, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s,
           {{'c': 2, 'a': 'I', 'o': chr(10) || 'assistant:'}} AS u, {{'c': 0, 'a': '', 'o': ''}} AS a
    FROM numbered GROUP BY conv_id
    UNION ALL
    SELECT conv_id, i, {", ".join(map(with_insert, FOLLOWS))} FROM (
        SELECT r.conv_id, r.i, {", ".join(map(own_edits, FOLLOWS))}
        FROM walk w JOIN numbered r ON r.conv_id = w.conv_id AND r.i = w.i - 1
    )
), figures AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           {", ".join(f"count(*) FILTER (fault = '{f}') AS {f}" for f in ("blank", "duplicate", "truncated"))},
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM numbered GROUP BY conv_id
)
SELECT o.conv_id, {", ".join(f"coalesce(f.{c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
       coalesce(w.n.c, 0)::BIGINT AS cost, coalesce(w.n.a, '') AS audit, sha256(coalesce(substr(w.n.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN figures f ON o.conv_id = f.conv_id LEFT JOIN walk w ON o.conv_id = w.conv_id AND w.i = 1
""",
}
