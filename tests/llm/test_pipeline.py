"""The stages of the corpus pipeline, each on what the one before kept, and the registered queries' contracts."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import decontaminate
from parcelflow.llm.oracle import ORACLE
from parcelflow.llm.queries import QUERIES
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, steps = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{scratch}/{k}")
        steps[name] = spark.read.parquet(f"{scratch}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert steps[name].columns == docs.columns
        before = steps[name]
    kept = {k: {r.doc_id: r for r in v.collect()} for k, v in steps.items()}
    names = list(steps)
    for a, b in zip(names, names[1:]):
        assert set(kept[b]) <= set(kept[a])
    lines, groups = kept["line_dedup"], kept["simhash_near_dedup"]
    words = {i: (r.text or "").encode().lower().split() for i, r in lines.items()}
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    alike = [(i, j) for i in sets for j in sets if j < i and near(sets[i], sets[j])]
    least = {i: i for i in lines}
    for _ in lines:
        before = dict(least)
        for i, j in alike:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            break
    assert set(groups) == {i for i in lines if least[i] == i}
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = kept["benchmark_decontamination"]
    assert not any(t in decontaminate.normal(r.text) for r in clean.values() for _, t in items)
    leaks = [i for i, r in groups.items() if decontaminate.Matcher(items, decontaminate.ERROR_RATE).find(decontaminate.normal(r.text))]
    assert set(clean) == set(groups) - set(leaks)
    assert set(kept["sentencepiece"]) == set(clean) and all(r.lossless for r in kept["sentencepiece"].values())
    assert corpus_pipeline.run(spark, SF).count() == len(clean)


def test_near_dedup_stage_against_all_pairs(spark):
    """The smallest id of each group by exact similarity stays, on the whole documents table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in texts.items()}
    alike = [(i, j) for i in sets for j in sets if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    least = {i: i for i in sets}
    for _ in sets:
        for i, j in alike:
            least[i] = least[j] = min(least[i], least[j])
    got = corpus_pipeline.simhash_near_dedup(spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in sets if least[i] == i)


def test_rows_of_one_or_no_id_are_judged_by_their_texts(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text or "") > 40)
    long_text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(i, long_text(k)) for i, k in [(None, 1), (None, 2), (None, 2), (7, 3), (7, 4), (None, 4), (9, 5), (8, 5)]]
    rows += [(i, f"{long_text(k)} {item} {long_text(k + 1)}") for i, k in [(None, 10), (7, 20)]]
    frame = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.simhash_near_dedup(spark, frame, SF)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = sorted(set(rows) - {(None, long_text(4)), (9, long_text(5))}, key=repr)
    assert got == want and kept.columns == frame.columns
    clean = corpus_pipeline.benchmark_decontamination(spark, frame, SF)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(rows[:-2], key=repr)


def test_stages_on_clashing_columns(spark):
    """Columns named like those of the operators stay what they are, in every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    names = ["first", "leak", "first_digest", "row_digest", "component_id", "kept", "item_id", "node", "root", "id", "line", "at", "p"]
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns
        assert all(r[n] == i for r in got.collect() for i, n in enumerate(names))


def test_stages_send_few_texts_to_python_at_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        for before, after in (("10000", "1000"), ("0", "1000"), ("70", "70")) if name != "line_dedup" else ():
            spark.conf.set(key, before)
            stage(spark, docs, SF)
            assert spark.conf.get(key) == after
    spark.conf.unset(key)


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLE[name], SF) is None


def test_all_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES
