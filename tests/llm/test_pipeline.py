"""The pipeline on a small folder of tables, stage by stage."""

import numpy as np
import pytest

import corpus_pipeline

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = np.random.default_rng(12)
    say = lambda n: " ".join(r.choice(WORDS, n))
    docs, labels = [], []
    for i in range(300):
        t = say(40) + ". " + say(30)
        bad = i % 5 == 0
        docs.append((i, t + (". grobian tau" if bad else "")))
        labels.append((i, 1, int(bad)))
    bench = say(14)
    docs += [(1001, docs[1][1]), (1002, docs[2][1] + " mu"), (1003, f"{say(20)} {bench} {say(9)}"), (1004, f"{say(30)} mail a.b@c.org"), (1005, None), (1006, ""), (None, say(25)), (1007, "grobian"), (1007, "grobian")]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, _d string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "pieces":
            assert docs.columns == columns
    assert 5 not in kept["toxicity"] and 1007 not in kept["toxicity"] and {1, 1001, 1005, 1006, None} <= set(kept["toxicity"])
    assert not {1001, 1002} & set(kept["near_duplicates"]) and {1, 2, 1005, None} <= set(kept["near_duplicates"])
    assert 1003 not in kept["decontamination"] and 1004 in kept["decontamination"]
    assert kept["personal_data"][1004].text.endswith("mail [EMAIL]") and kept["personal_data"][1].text == kept["toxicity"][1].text
    assert all(r.round_trip for r in kept["pieces"].values())
    clean = [i for i in range(300) if i % 5]
    assert sum(i in kept["pieces"] for i in clean) > 0.97 * len(clean)
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: r.ids_crc32 for r in out.collect()} == {i: r.ids_crc32 for i, r in kept["pieces"].items()}


def test_empty_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
