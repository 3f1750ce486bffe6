"""The pipeline against its stages worked out without Spark's operators, and what its stages must keep."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from trailweave.llm import decontaminate, language_id, mix_sources, secret_scan
from trailweave.llm.common import table, words
from trailweave.storage import shared_dir

from .test_dedup import brute_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), [table(spark, SF, "documents")]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / f"{k}-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, stages):
    raw, known, single, clean, safe, mix = ([r.asDict() for r in s.collect()] for s in stages)
    field = language_id.train(stages[0])
    verdict = language_id.verdicts(field, [r["text"] for r in raw], [r["lang"] for r in raw])["accepted"]
    assert {r["doc_id"] for r in known} == {r["doc_id"] for r, ok in zip(raw, verdict, strict=True) if ok}
    gone = brute_simhash([(r["doc_id"], r["text"]) for r in known])
    assert {r["doc_id"] for r in single} == {r["doc_id"] for r in known} - set(gone)
    items = [words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    leaking = {r["doc_id"] for r in single if any(len(i) >= decontaminate.LEAST_ITEM and " ".join(i) in " ".join(words(r["text"])) for i in items)}
    assert {r["doc_id"] for r in clean} <= {r["doc_id"] for r in single} and not leaking & {r["doc_id"] for r in clean}
    assert len(clean) >= len(single) - len(leaking) - 2
    primed = secret_scan.Primed(secret_scan.corpus_identifiers(stages[3]))
    assert {r["doc_id"]: r["text"] for r in safe} == {r["doc_id"]: secret_scan.redacted(r["text"], primed) for r in clean}
    picked = mix_sources.mix_sources(stages[4]).collect()
    assert sorted((r["doc_id"], r["copy"]) for r in mix) == sorted((r["doc_id"], r["copy"]) for r in picked)


def test_run_is_its_stages_and_leaves_its_result_only(spark, stages):
    before = set(os.listdir(shared_dir(spark)))
    key = lambda df: sorted(map(repr, df.select(*stages[5].columns).collect()))
    out = corpus_pipeline.run(spark, SF)
    assert key(out) == key(stages[5])
    assert {x.split("-")[0] for x in set(os.listdir(shared_dir(spark))) - before} == {"mix_sources"}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert stages[5].columns == [*stages[0].columns, "copy"]


def test_odd_rows_pass_every_stage(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the of and words", "en", "a", 16), (3, "the of and words", "en", "a", 16), (None, "the of and more words", None, "b", None)]
    for df in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        for column in ("node", "gone", "copy", "m_text", "m_copy"):
            df = df.selectExpr("*", f"'x' as {column}")
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            df.collect()


def test_leaking_rows_go_by_their_text(spark):
    passage = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    rows = [(None, passage), (1, passage), (1, "a clean text of the same id"), (2, None), (None, "a clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.unionByName(table(spark, SF, "documents").where("doc_id > 50").select("doc_id", "text").limit(40))
    kept = [tuple(r) for r in decontaminate.keep_clean(spark, docs, SF).collect()]
    assert not [r for r in kept if r[1] == passage] and all(r in kept for r in rows[2:])


def test_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in found} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_redaction_counts_identifiers_in_all_documents(spark):
    """An identifier that is frequent in texts without candidates is no secret where it stands beside a sensitive name."""
    name = "warehouseInventoryLedgerReconciliation"
    rows = [(k, f"{name} {k}", "en", "s", 1) for k in range(9)] + [(20, f"token = {name}", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert secret_scan.redacted(rows[-1][1]) != rows[-1][1]
    assert {r["doc_id"]: r["text"] for r in secret_scan.redact(spark, docs, SF).collect()} == {r[0]: r[1] for r in rows}
