"""The pipeline's stages, each against what it has to keep and to change, and the query contracts' columns."""
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evlens.llm import quality, queries
from tests.llm.test_simhash import brute_fingerprint, brute_roots
from tests.llm.test_substring import brute, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append((name, before, docs))
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for name, (a, b) in stages.items():
        if name != "best_fit_packing":
            assert b.dtypes == a.dtypes


def test_quality_rules(spark, stages):
    a, b = stages["quality_rules"]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    kept, wrong, seen = rows(b), 0, 0
    for i, r in rows(a).items():
        facts = quality.base_facts(r["text"] or "")
        if quality.base_failed(facts[0], facts[4]):
            assert i not in kept
            continue
        assert i not in kept or kept[i] == r
        seen += i in good or i in bad
        wrong += (i in good and i not in kept) or (i in bad and i in kept)
    assert wrong <= 0.05 * seen


def test_simhash(stages):
    a, b = stages["simhash_near_dedup"]
    ids = sorted(rows(a))
    roots = brute_roots([brute_fingerprint(rows(a)[i]["text"]) for i in ids], 3)
    assert sorted(rows(b)) == [i for k, i in enumerate(ids) if roots[k] == k]


def test_substring(stages):
    a, b = stages["substring_dedup"]
    want, before, after = brute([(i, r["text"]) for i, r in rows(a).items()], 20), rows(a), rows(b)
    for i, (n, gone, _) in want.items():
        if gone == 0:
            assert after[i] == before[i]
        elif gone == n:
            assert i not in after
        else:
            assert len(words_of(after[i]["text"])) == n - gone and after[i]["n_chars"] == len(after[i]["text"])


def test_secrets(stages):
    a, b = stages["secret_scan"]
    assert set(rows(a)) == set(rows(b))
    before, after = rows(a), rows(b)
    assert all(after[i] == r or "[SECRET]" in after[i]["text"] for i, r in before.items())


def test_packing(stages):
    a, b = stages["best_fit_packing"]
    assert {r["doc_id"] for r in b.collect()} == set(rows(a))
    full = b.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in full) <= 1024


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, version string, kept string"
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    odd = spark.createDataFrame([(1, None, None, None, None, "a", "b"), (2, "", "en", "s", 0, "a", "b"), (None, long, "en", "s", 1, "a", "b"),
                                 (3, long, "en", "s", 1, "a", "b"), (3, long, "en", "s", 1, "a", "b")], schema)
    for table in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            n = len(out.collect())
            if name != "best_fit_packing":
                assert out.columns == table.columns and n <= 5


def test_registered_queries_give_their_contract_columns(spark):
    want = {
        "op1_": "doc_id fingerprint component_id", "op2_": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op3_": "query_id rank vec_id score",
        "op4_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op5_": "doc_id template containment", "op6_": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op7_": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op8_": "doc_id piece start length ids_crc32 sequence_id offset", "op9_": "doc_id held_out lang_pred score",
        "op10_": "doc_id n_words n_removed kept_sha256",
        "op11_": "doc_id held_out n_tokens n_known train_tokens base_score score", "op12_": "item_id rank doc_id score",
        "op13_": "vec_id component n deviation whitened explained identity_error"}
    n_docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in queries.queries().items():
        key = next(k for k in want if name.startswith(k))
        df = query(spark, SF)
        assert set(want[key].split()) <= set(df.columns)
        if key in ("op1_", "op4_", "op6_", "op7_", "op9_", "op10_"):
            assert df.count() == n_docs


def test_which_row_stays_depends_on_the_rows_alone(spark):
    same = " ".join(f"w{i}" for i in range(60))
    table = [(7, same, "a"), (7, same, "b"), (None, same, "c"), (9, same + " end", "d"), (7, "entirely different words in here", "e"),
             (None, "no id and its very own text here", "f"), (None, "no id and its very own text here", "f")]
    frames = [spark.createDataFrame(t, "doc_id long, text string, lang string") for t in (table, table[::-1], table[3:] + table[:3])]
    got = [sorted(map(tuple, corpus_pipeline.simhash_near_dedup(spark, f.repartition(3), SF).collect()), key=repr) for f in frames]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3
    assert sorted((r[0], r[1] == same) for r in got[0] if r[0] is not None) == [(7, False), (7, True)] and got[0][-1][0] is None


def test_a_cluster_without_a_shared_folder_is_an_error():
    from evlens.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session())
