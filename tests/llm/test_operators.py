"""Each operator beside a brute-force version, on small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelflow.llm import decontaminate, language, quality, quotes, sentencepiece_bpe, simhash, substring_dedup, vectors, warc
from parcelflow.llm.common import components
from parcelflow.llm.line_dedup import dedup_lines
from parcelflow.llm.substring_dedup import dedup_substrings

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog again and again"
DOCS = "doc_id long, text string, lang string, source string, root string, node string, key string"
BLANK = "[\x20\x09-\x0d]+"


def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, repeated and null ids, clashing names."""
    noise = random.Random(3)
    long_text = " ".join(noise.choice("abcdefgh") * noise.randint(1, 9) for _ in range(30_000)) + "\n" + LONG
    texts = [None, "", " \t\n", LONG, LONG, LONG.upper() + " ", f"\x0b{LONG}\n{LONG}\nend", "é🎉 ▁ x", long_text, long_text]
    rows = [(i, t, None, "s", "r", None, "k") for i, t in enumerate(texts)]
    rows += [(3, LONG, None, None, None, None, None), (None, LONG, "en", "s", "r", "n", "k"), (None, None, *[None] * 5)]
    return spark.createDataFrame(rows + [(40, "same id", *["x"] * 5), (40, f"other text\n{LONG}", *["x"] * 5)], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sources(spark):
    return [documents(spark), awkward(spark), awkward(spark).limit(0)]


def by_parts(n, links):
    """Smallest position of each position's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    noise = random.Random(5)
    pairs = [(noise.randrange(300), noise.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect())
    want = by_parts(500, pairs)
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1]}


def test_line_dedup(spark):
    for docs in sources(spark):
        rows = docs.collect()
        trim = lambda line: re.sub(f"^{BLANK}|{BLANK}$", "", line)
        key = lambda line: trim(line).encode().lower().decode()
        holders = defaultdict(set)
        for r in rows:
            for line in (r.text or "").split("\n"):
                if len(key(line)) >= 40:
                    holders[key(line)].add(r.doc_id)
        keeper = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= 5}
        want = []
        for r in rows:
            lines = (r.text or "").split("\n")
            kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == r.doc_id]
            want.append((r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
        got = dedup_lines(docs)
        assert set(docs.columns) < set(got.columns)
        assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr) == sorted(want, key=repr)


def simple_print(text, width):
    words = re.findall(f"[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark):
    for docs in sources(spark):
        rows = docs.collect()
        prints = [simple_print(r.text, 4) for r in rows]
        links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
        part = by_parts(len(rows), links)
        least = {}
        for r, p in zip(rows, part):
            least[p] = min((x for x in (least.get(p), r.doc_id) if x is not None), default=None)
        want = [(r.doc_id, f"{f:016x}", least[p]) for r, f, p in zip(rows, prints, part)]
        assert sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=repr) == sorted(want, key=repr)


def test_anchors_lose_no_link(monkeypatch, spark):
    """Random fingerprints at every distance up to the threshold share an anchor; chunks keep all links."""
    noise = np.random.default_rng(1)
    base = noise.integers(0, 1 << 63, 400, dtype=np.uint64)
    for bits in range(5):
        flip = np.array([sum(1 << int(b) for b in noise.choice(64, bits, replace=False)) for _ in base], np.uint64)
        keys = []
        for fps in (base, base ^ flip):
            held = defaultdict(set)
            for row, key in zip(*simhash.anchors(fps[:, None], 2)):
                held[row].add(key)
            keys.append(held)
        assert all(keys[0][i] & keys[1][i] for i in range(len(base)))
    monkeypatch.setattr(simhash, "CHUNK", 3)
    near = {int(base[0])} | {int(base[0]) ^ (1 << b) ^ (1 << c) for b in range(6) for c in range(6) if b != c}
    distinct = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) * 2 for f in near], "node long, w0 long")
    assert len({r.root for r in components(simhash.fingerprint_links(distinct, 4, 2)).collect()}) == 1


def test_long_fingerprints_find_near_copies(spark):
    """Copies with a word replaced here and there, similarity 0.85 or more, are found; other texts stay alone."""
    noise = random.Random(8)
    word = lambda: "".join(noise.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(150):
        base = [word() for _ in range(noise.randint(250, 600))]
        copy = list(base)
        for _ in range(len(base) // 100):
            copy[noise.randrange(len(copy))] = word()
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(map(str.upper, base[:-1])))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.simhash_groups(docs, width=5, words=7, max_bits=76, piece_bits=2, size=28).collect()
    assert all(len(r.fingerprint) == 112 and r.component_id // 3 == r.doc_id // 3 for r in found)
    assert sum(r.component_id != 3 * (r.doc_id // 3) for r in found) <= 5
    awkward_rows = simhash.simhash_groups(awkward(spark), width=5, words=7, max_bits=76, piece_bits=2, size=28)
    assert awkward_rows.count() == awkward(spark).count()


def test_near_copies_are_decided_by_their_shingles(monkeypatch, spark):
    """Pairs at every similarity around 0.8, a chain and a dense group give the components of the exact pairs."""
    noise = random.Random(8)
    word = lambda: "".join(noise.choice("abcdefghij") for _ in range(6))
    texts = [None, "", " ", "one two", "ONE  two", "one two three four five six seven eight nine", "x " * 400, "x " * 300]
    for i in range(120):
        base = [word() for _ in range(noise.randint(150, 400))]
        cut = int(len(base) * (0.70 + 0.002 * i))  # 0.70 to 0.94
        texts += [" ".join(base), " ".join(base[:cut])]
    base = [word() for _ in range(300)]
    texts += [" ".join(base[k * 20 : k * 20 + 160]) for k in range(8)]  # neighbours at 0.77
    texts += [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(0, 300, 7)]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    want = by_parts(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (512, 5):
        monkeypatch.setattr(simhash, "SET_CHUNK", chunk)
        got = {r.doc_id: r.component_id for r in simhash.jaccard_groups(docs).collect()}
        assert all(want[i] == want[c] for i, c in got.items())  # no false link
        assert sum(got[i] != want[i] for i in got) <= 2
    assert simhash.jaccard_groups(awkward(spark)).count() == awkward(spark).count()
    assert simhash.jaccard_groups(docs.limit(0)).count() == 0


def test_decontamination(spark):
    noise = random.Random(2)
    items = [("".join(noise.choice("abcde ") for _ in range(n))) for n in (60, 90, 150, 14)]
    rows = []
    for i in range(60):
        item = list(items[i % 4])
        for _ in range(i % 14):
            at = noise.randrange(len(item))
            item[at : at + noise.randrange(2)] = noise.choice(["", "z", "yy"])
        text = "".join(noise.choice("fghij ") for _ in range(80))
        rows.append((i, f"{text} {''.join(item)}\n{text}"))
    rows += [(60, None), (61, ""), (None, f"x {items[0].upper()}"), (61, items[1])]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, " "), (None, "never there at all")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def distance(item, text):
        above = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            row = [i]
            for j, b in enumerate(text, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
            above = row
        return min(above)

    want = []
    for i, text in rows:
        for n, item in enumerate(items):
            item = decontaminate.normal(item)
            d = distance(item, decontaminate.normal(text))
            if d <= int(len(item) * decontaminate.ERROR_RATE):
                want.append((i, n, d))
    got = decontaminate.find_leaks(docs, bench)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert decontaminate.find_leaks(awkward(spark), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_language(spark):
    docs = documents(spark)
    held_out = F.col("doc_id") % 5 == 0
    got = language.identify(docs, ~held_out).filter(held_out)
    right, total = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * total
    got = language.identify(awkward(spark), F.lit(True)).collect()
    assert len(got) == 15 and {r.lang_pred for r in got if not re.search("[a-z]", r.text or "", re.I)} == {"und"}
    assert language.identify(docs.limit(0), F.lit(True)).count() == 0


def test_texts_without_letters_have_no_language(spark):
    """Numerals of all kinds, signs and marks are no letters; letters of any script are."""
    texts = ["\u00b2\u00bd", "\u2167", "\u2460 \u0663", "12 _ \u0301 \U0001f389", "\u0f33\U00010107", "\u65e5\u672c", "na\u00efve"]
    rows = [(i, t, "xx") for i, t in enumerate(texts)] + [(100 + i, "some words here", "en") for i in range(30)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") >= 100)
    found = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    for i, text in enumerate(texts):
        assert (found[i] == ("und", 0.0)) == (not any(c.isalpha() for c in text)), text


def test_language_masks_beyond_one_word(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 5, f"l{i:03}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.identify(docs, F.lit(True)).filter("lang <> lang_pred").count() == 0


@pytest.mark.parametrize("dropout", [0.0, 0.1, 1.0])
def test_tokens(spark, dropout):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    for docs in sources(spark):
        got = sentencepiece_bpe.tokenize(docs, dropout=dropout)
        assert got.filter("not lossless or n_pieces <> size(ids)").count() == 0
        for r in got.limit(60).collect() if dropout == 0 else []:
            if "▁" not in (r.text or ""):
                assert r.ids == own.encode(r.text or "")
        again = {tuple(x.ids) for x in sentencepiece_bpe.tokenize(docs, dropout=dropout).collect()}
        assert again == {tuple(x.ids) for x in got.collect()}
        other = {tuple(x.ids) for x in sentencepiece_bpe.tokenize(docs, seed=2, dropout=dropout).collect()}
        assert (other == again) == (dropout != 0.1 or not docs.count())


@pytest.mark.parametrize("limit", [0, 1 << 61, 1 << 63, (1 << 64) - 1])
def test_every_occurrence_draws_for_itself(monkeypatch, limit):
    """Whole texts beside the plain agenda of each occurrence, with little memory and with much."""
    with open(sentencepiece_bpe.MODEL, "rb") as f:
        encoder = sentencepiece_bpe.Encoder(f.read(), 7, limit / 2.0**64)
    encoder.limit = limit
    texts = ["hello    spaces naïve 漢字🎉x internationalization\n\nend ", None, "", "aaaaaaaaaaaa " * 40, "word " * 1000]
    texts += ["x" * 60 + " ▁ y", "word " * 1000, "\n", " "]
    salts = [5, 1, 2, -3, 8, 1 << 62, 9, 0, -(1 << 63)]
    want = []
    for text, salt in zip(texts, salts):
        ids = []
        for place, unit in enumerate(encoder.units(" " + text) if text else []):
            key = sentencepiece_bpe.occurrence_key(7, salt % (1 << 64), place)
            ids += sentencepiece_bpe.segment(encoder.vocab, unit, key, limit)
        want.append(ids)
    for remembered in (0, 10**6):
        monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", remembered)
        got = [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts, salts)]
        assert got == want
        for text, ids in zip(texts, got):
            assert sentencepiece_bpe.decode_ids(encoder.vocab, ids) == (text or "")
    if 0 < limit < 1 << 63:
        kinds = {node for node in encoder.nodes([" internationalization"] * 1000, np.arange(1000).astype(np.uint64))}
        assert len({encoder.pieces[k] for k in kinds}) > 50


def test_occurrences_cost_no_memory():
    """What a worker remembers grows with the units, not with the draws of their occurrences."""
    with open(sentencepiece_bpe.MODEL, "rb") as f:
        encoder = sentencepiece_bpe.Encoder(f.read(), 7, 0.5)
    remembered = lambda: len(pickle.dumps({k: v for k, v in vars(encoder).items() if k not in ("vocab", "units", "pieces")}))
    encoder.encode(["internationalization naïve漢 "], [1])
    before = remembered()
    encoder.encode(["internationalization naïve漢 " * 2000], [2])
    assert remembered() == before and len(set(encoder.pieces)) > 50


def test_tokens_are_made_and_checked_by_one_worker(spark):
    docs = documents(spark).select("doc_id", "text")
    got = sentencepiece_bpe.tokenize(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    apart = docs.withColumn("ids", sentencepiece_bpe.encode(F.col("text"), F.col("doc_id")))
    apart = apart.withColumn("back", sentencepiece_bpe.decode(F.col("ids"))).filter("back = coalesce(text, '')")
    assert sorted(map(repr, apart.select("doc_id", "ids").collect())) == sorted(map(repr, got.select("doc_id", "ids").collect()))


def test_vectors(monkeypatch, spark):
    noise = np.random.default_rng(4)
    centre = noise.standard_normal((12, 64))
    rows = [c + noise.standard_normal(64) * s for c in centre for s in (0, 0.05, 0.2, 0.3, 0.4) for _ in range(4)]
    data = [(i, v.tolist(), None) for i, v in enumerate(rows)]
    data += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] * 64, 1), (904, [1.0], 1)]
    data += [(905, data[0][1], 1), (905, data[1][1], 2), (None, data[0][1], 3)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, root int")

    def brute():
        good = [i for i, d in enumerate(data) if d[1] and len(d[1]) == 64 and None not in d[1] and np.abs(d[1]).sum() > 0]
        v = np.array([data[i][1] for i in good])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        near = v @ v.T >= 0.9
        np.fill_diagonal(near, False)
        part = by_parts(len(data), [(good[i], good[j]) for i, j in zip(*np.nonzero(near))])
        links = dict(zip(good, near.sum(1).tolist()))
        least = {p: min((data[i][0] for i in range(len(data)) if part[i] == p and data[i][0] is not None), default=None) for p in part}
        return [(d[0], links.get(i, 0), least[part[i]], d[0] == least[part[i]]) for i, d in enumerate(data)]

    for chunk in (512, 5):
        monkeypatch.setattr(vectors, "CHUNK", chunk)
        got = sorted(map(tuple, vectors.vector_groups(frame).collect()), key=repr)
        want = sorted(brute(), key=repr)
        found, real = sum(r[1] for r in got), sum(r[1] for r in want)
        assert 0.95 * real <= found <= real  # recall, and no false link
        assert sum(a == b for a, b in zip(got, want)) >= 0.9 * len(want)
    assert vectors.vector_groups(frame.limit(0)).count() == 0


def test_vectors_under_one_id_stay_apart(spark):
    """Different vectors with equal or null ids are linked by what they are, not by their ids."""
    noise = np.random.default_rng(9)
    a, b, c = noise.standard_normal((3, 64))
    close = lambda v: (v + 0.01 * noise.standard_normal(64)).tolist()

    def groups(*rows):
        frame = spark.createDataFrame([(i, np.asarray(v).tolist()) for i, v in rows], "vec_id long, embedding array<double>")
        return sorted(map(tuple, vectors.vector_groups(frame).collect()), key=repr)

    assert groups((5, a), (5, b), (2, close(a))) == [(2, 1, 2, True), (5, 0, 5, True), (5, 1, 2, False)]
    assert groups((1, a), (1, b), (2, close(a)), (3, close(b))) == [(1, 1, 1, True)] * 2 + [(2, 1, 1, False), (3, 1, 1, False)]
    got = groups((None, a), (None, b), (4, close(b)), (4, c), (4, c), (0, close(c)))
    want = [(None, 0, None, True), (None, 1, 4, False), (4, 1, 4, True), (4, 2, 0, False), (4, 2, 0, False), (0, 2, 0, True)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("rows", [10**3, 10**5, 10**7, 10**8])
def test_filters_keep_their_recall(rows):
    """Of pairs at the limit and just above it, hardly any lacks a common filter, whatever the number of filters."""
    filters = vectors.CapFilters(64, rows)
    for cosine in (0.9, 0.92):
        x, y = vectors.pairs_at(cosine, 300, 64, np.random.default_rng(11))
        lists = [filters.passed(v) for v in (x, y)]
        met = sum(len(np.intersect1d(a, b)) > 0 for a, b in zip(*lists))
        print(rows, filters.codes, filters.length, cosine, met / 300, np.mean([len(v) for v in lists[0]]))
        assert met >= 0.97 * 300


def test_substrings(monkeypatch, spark):
    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(i, f"start{i} {passage} end{i} {'a b ' * 30}") for i in range(9)] + [(20, f"{passage}\n{passage}"), (21, "z " * 80)]
    extra = spark.createDataFrame([(i, t, *[None] * 5) for i, t in rows], DOCS)
    from parcelflow.llm import substring_dedup

    for many in (5000, 1):
        monkeypatch.setattr(substring_dedup, "MANY", many)
        for docs in [extra.union(awkward(spark)), *sources(spark)[::2]]:
            texts = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
            seen = defaultdict(int)
            for _, w in texts:
                for i in range(len(w) - 34):
                    seen[b" ".join(w[i : i + 35])] += 1
            want = []
            for i, w in texts:
                gone = set()
                for k in range(len(w) - 34):
                    if seen[b" ".join(w[k : k + 35])] > 1:
                        gone.update(range(k, k + 35))
                want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
            got = dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "text").collect()
            assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?", "x"),
        (1, 1, "assistant", "> How are  YOU?\n\nFine.", "x"),
        (1, 2, "user", "> > Hello there\n> > How are you?\n> Fine.\nGood\n> not said\n", "x"),
        (1, 2, "user", "> > Hello there\n> > How are you?\n> Fine.\nGood\n> not said\n", "x"),
        (1, 3, None, None, None),
        (1, 4, "user", "> Good\nlast", None),
        (2, 0, "user", "> How are you?\nother conversation", None),
        (None, 0, "user", "lost", None),
        (3, None, "user", ">", None),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, source_turn string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(frame).collect()}
    assert len(got) == 8
    see = lambda c, t: (lambda r: (r.own_text, r.n_quotes, r.n_linked, r.reply_to, r.root_turn, r.depth, r.copies))(got[c, t])
    assert see(1, 0) == ("Hello there\nHow are you?", 0, 0, None, 0, 0, 1)
    assert see(1, 1) == ("Fine.", 1, 1, 0, 0, 1, 1)
    assert see(1, 2) == ("Good\n", 3, 2, 1, 0, 2, 2) or see(1, 2) == ("Good", 3, 2, 1, 0, 2, 2)
    assert see(1, 3) == ("", 0, 0, None, 3, 0, 1)
    assert see(1, 4) == ("last", 1, 1, 2, 0, 3, 1)
    assert see(2, 0) == ("other conversation", 1, 0, None, 0, 0, 1)
    assert see(None, 0)[0] == "lost" and see(3, None)[1:4] == (1, 0, None)
    assert quotes.link_quotes(frame.limit(0)).count() == 0
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    chat = quotes.chat_lines(quotes.link_quotes(quotes.as_mail(table)))
    joined = chat.join(table.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    assert joined.filter("own_text <> regexp_replace(text, '^\\n+|\\n+$', '') or (turn > 0 and reply_to is null)").count() == 0


def test_archives(monkeypatch, spark, scratch):
    import base64

    monkeypatch.setattr(warc, "CHUNK_BYTES", 50)
    ends = ["", "\r\n", "\r\n\r\n", "\r", "\n", "\r\n\r\nWARC/1.1\r\n\r\n", "é" * 60, "x" * 50, "y" * 49 + "\r\n\r\n" * 20]
    data = [(i, f"http://h/{i}\n", None if i == 3 else f"page {i % 7}{e}") for i, e in enumerate(ends * 3)]
    data += [(100, None, ""), (101, "u", None), (102, "u", ""), (5, "u", data[5][2]), (None, None, "nobody"), (None, "v", data[5][2])]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    for least in (0, 40):
        warc.write_archives(pages, f"file://{scratch}/a{least}", least_bytes=least)
        got = warc.read_records(warc.read_chunks(spark, f"file://{scratch}/a{least}")).collect()
        want = []
        for i, _, html in data:
            body = (html or "").encode()
            first = min((j for j, _, h in data if (h or "") == (html or "") and j is not None), default=None)
            again = len(body) >= least and first is not None and first != i
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            want.append((i, len(body), digest, "revisit" if again else "response", first if again else None))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    warc.write_archives(pages.limit(0), f"file://{scratch}/none")
    assert warc.read_chunks(spark, f"file://{scratch}/none").count() == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels.filter("doc_id % 3 > 0"), keep_text=False).join(labels.filter("doc_id % 3 = 0"), "doc_id")
    right = (F.col("quality") == 1) & (F.col("toxic") == 0)
    good, total = out.agg(F.sum((right == F.col("keep")).cast("int")), F.count("*")).first()
    assert good >= 0.9 * total
    few = quality.classify(awkward(spark), labels.limit(0))
    assert few.count() == 15 and few.filter("keep is null").count() == 0
    assert set(awkward(spark).columns) < set(few.columns)
    assert quality.classify(awkward(spark), labels).count() == 15
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_site_posteriors_shrink(spark):
    """A sparse site stays near the global mean, a rich one near its own; a path moves on from its host."""
    rows = [("rich", "a", 0.9)] * 400 + [("sparse", "a", 0.9)] * 2 + [("plain", "a", 0.1)] * 400 + [("rich", "b", 0.2)] * 200 + [(None, None, 0.1)] * 50
    frame = spark.createDataFrame(rows, "host string, path string, p double").select(
        "host", "path", F.struct(F.col("p").alias("bad"), F.col("p").alias("toxic")).alias("evidence")
    )
    got = {(r.__getitem__("__host"), r.__getitem__("__path")): r["__site_bad"] for r in quality.site_posteriors(frame, "host", "path").collect()}
    mean = sum(r[2] for r in rows) / len(rows)
    assert abs(got["rich", "a"] - 0.9) < 0.05 and abs(got["rich", "b"] - 0.2) < 0.1
    assert mean < got["sparse", "a"] < 0.85 < got["rich", "a"]
    assert got[None, None] < 0.2


def test_language_grams_cost_little_beside_the_text():
    """Finding the letters of a text must not cost a pattern with hundreds of numerals per character."""
    import time

    from parcelflow.llm.language import grams

    text = "Élan vital, 4 kg ½ of ① ４ ६ ⅷ 日本 x_y " * 10_000
    grams(text)
    began = time.process_time()
    found = grams(text)
    assert time.process_time() - began < 1e-6 * len(text)
    spaced = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    assert (found == grams(spaced)).all() and len(found) == len(spaced) + 2 - 3


def test_sets_share_a_band_if_they_are_similar():
    """Pairs at a Jaccard similarity of 0.8, 90 or 450 shingles, share a band; the rate is close to what is computed."""
    noise = np.random.default_rng(5)
    met = 0
    for k in range(600):
        each = 5 if k % 2 else 25  # 0.8 = 16 / 20
        both = noise.integers(0, 1 << 63, 16 * each, dtype=np.uint64)
        sides = [np.append(both, noise.integers(0, 1 << 63, 2 * each, dtype=np.uint64)) for _ in range(2)]
        met += bool((simhash.set_bands(sides[0]) == simhash.set_bands(sides[1])).any())
    assert met >= 596


def test_unrelated_texts_are_not_dealt(monkeypatch, spark):
    """Texts without a common shingle never meet, so what is dealt does not grow with the square of their number."""
    noise, dealt, real = random.Random(4), [], simhash.paired_chunks

    def spy(*args):
        dealt.append(real(*args).count())
        return real(*args)

    monkeypatch.setattr(simhash, "paired_chunks", spy)
    rows = [(i, " ".join("".join(noise.choices("abcdefgh", k=6)) for _ in range(40))) for i in range(1500)]
    rows.append((9999, rows[0][1] + " end"))
    found = simhash.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found if not r.kept} == {9999}
    assert sum(dealt) <= 2 * simhash.BANDS + 2


def test_words_outside_windows_cost_little():
    """Covers of 2,000 short texts equal brute force and take no pass over the texts for each bit of a mask."""
    import time

    noise = np.random.default_rng(6)
    cases = []
    for _ in range(2000):
        starts = np.sort(noise.choice(300, 12, replace=False))
        cases.append((starts, noise.integers(0, 1 << 28, 12)))
    began = time.process_time()
    found = [substring_dedup.uncovered(400, *case, 35) for case in cases]
    assert time.process_time() - began < 0.8
    for (starts, masks), left in list(zip(cases, found))[:50]:
        hit = {s + i + j for s, m in zip(starts, masks) for i in range(28) if m >> i & 1 for j in range(35)}
        assert [k not in hit for k in range(400)] == left.tolist()
