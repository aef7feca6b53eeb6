import json

import pytest

from sieveworks import __main__ as cli
from sieveworks.operators import diagnosis
from sieveworks.plans import gate
from sieveworks.sources import readers, writers


def test_gate(spark):
    assert len(gate.CASES) == 13 and gate.gate(spark) == []
    assert gate.resolves(gate.backend(spark), "100001", "7") and not gate.resolves(gate.backend(spark), "7", "8")


def test_commands(spark, tmp_path, capsys):
    rel, corpus, out = tmp_path / "rel", tmp_path / "corpus", tmp_path / "out"
    rel.mkdir()
    (rel / "sct2_Relationship_Snapshot_X.txt").write_text("id\teffectiveTime\tactive\tmoduleId\tsourceId\tdestinationId\trelationshipGroup\ttypeId\n1\t0\t1\tm\t271782001\t404684003\t0\t116680003\n")
    (rel / "sct2_Concept_Snapshot_X.txt").write_text("id\teffectiveTime\tactive\tmoduleId\n404684003\t0\t1\tm\n271782001\t0\t1\tm\n")
    (rel / "sct2_Description_Snapshot_X.txt").write_text("id\teffectiveTime\tactive\tmoduleId\tconceptId\tlanguageCode\ttypeId\tterm\n7\t0\t1\tm\t271782001\ten\t900000000000003001\tDrowsy (finding)\n")
    for layer, row in {"sct": "TT1\t271782001 | Drowsy | 9 15\tdrowsy\nTT2\t99999999 | x | 0 1\tI", "original": "T1\tADR 9 15\tdrowsy", "meddra": ""}.items():
        (corpus / layer).mkdir(parents=True)
        (corpus / layer / "A.1.ann").write_text(row)
    (corpus / "text").mkdir()
    (corpus / "text" / "A.1.txt").write_text("I feel a drowsy")
    assert cli.main(["build", "--release", str(rel), "--out", str(tmp_path / "v")]) == 0
    common = ["--corpus", str(corpus), "--vocabulary", str(tmp_path / "v"), "--out", str(out)]
    assert cli.main(["run", *common, "--stages", "1-3"]) == 0
    assert "stage 3" in capsys.readouterr().err
    table = spark.read.csv(f"{out}/results", header=True).orderBy("rung").collect()
    assert [r["rung"] for r in table] == ["1", "2"] and table[0].asDict().keys() == dict.fromkeys(writers.RESULT_COLUMNS).keys()
    assert readers.ledger(spark, f"{out}/ledger").count() == 4
    assert cli.main(["calibrate", *common]) == 0 and spark.read.json(f"{out}/calibration").count() > 0
    assert cli.main(["build", "--release", str(tmp_path / "none"), "--out", str(tmp_path / "w")]) == 2
    assert spark.read.json(f"{out}/calibration-counts").first()["n"] == 2 and spark.read.json(f"{out}/calibration-examples").count() == 1
    # A scorer fills the columns that are blank without one.
    assert table[0]["yield"] is None and cli.main(["run", *common, "--scorer", "sieveworks.operators.scoring"]) == 0
    scored = spark.read.csv(f"{out}/results", header=True).orderBy("rung").first()
    assert (scored["yield"], scored["err_per_100"], scored["corrupted"], scored["p95_s"]) == ("1.0", "0.0", "0", "0.0")
    # Faults and backends.
    assert cli.main(["probe", *common]) == 0 and {r["kind"] for r in spark.read.json(f"{out}/probe").collect()} == set(diagnosis.FAULTS)
    assert cli.main(["crosscheck", *common, "--release", str(rel)]) == 0
    assert {r["entity_type"]: (r["n"], r["invisible"], r["pct"]) for r in spark.read.json(f"{out}/crosscheck").collect()} == {"all": (2, 2, 100.0), "reaction": (2, 2, 100.0)}
    # The splits are made once; the vocabulary must know what it should and no more.
    assert cli.main(["init", *common]) == 1
    splits = ["--corpus", str(corpus), "--vocabulary", str(tmp_path / "v"), "--out", str(tmp_path / "splits"), "--probe-codes", "271782001,999999999"]
    assert cli.main(["init", *splits]) == 0 and cli.main(["init", *splits]) == 0
    assert [r["doc_id"] for r in readers.split_ids(spark, str(tmp_path / "splits" / "dev.json")).collect()] == ["A.1"]
    assert cli.main(["init", *splits[:2], "--vocabulary", str(tmp_path / "none"), "--out", str(tmp_path / "x")]) == 2
    # What isn't there ends with 2.
    for corpus_there, vocabulary in ((str(tmp_path / "none"), str(tmp_path / "v")), (str(corpus), str(tmp_path / "none"))):
        assert cli.main(["run", "--corpus", corpus_there, "--vocabulary", vocabulary, "--out", str(tmp_path / "y")]) == 2


def test_vocabulary_is_published_whole_and_once(spark, tmp_path):
    concept = spark.createDataFrame([("1", True, True, True)], "id string, active boolean, is_finding boolean, is_finding_hist boolean")
    terms = spark.createDataFrame([("1", "a", "a", True, 1)], "concept_id string, term string, norm string, fsn boolean, rowid long")
    path = str(tmp_path / "v")
    assert writers.vocabulary(concept, terms, path, release="r1") and not writers.vocabulary(concept.limit(0), terms, path)
    meta = {r["key"]: r["value"] for r in spark.read.json(f"{path}/meta").collect()}
    assert (meta["release"], meta["concepts"], meta["findings"], meta["descriptions"]) == ("r1", "1", "1", "1") and "built" in meta
    assert writers.vocabulary(concept.limit(0), terms, path, force=True) and spark.read.parquet(f"{path}/concept").count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["v"]


def test_missing_layers_are_empty(spark, tmp_path):
    (tmp_path / "text").mkdir()
    docs, gold = readers.load_corpus(spark, str(tmp_path))
    assert docs.count() == 0 and gold.count() == 0
    (tmp_path / "text" / "A.1.txt").write_text("x")
    docs, gold = readers.load_corpus(spark, str(tmp_path))
    assert docs.count() == 1 and gold.count() == 0
    with pytest.raises(FileNotFoundError):
        readers.load_corpus(spark, str(tmp_path / "none"))
    with pytest.warns(UserWarning, match="off"):
        assert readers.optional_code_list(spark, str(tmp_path / "none.csv")) is None


def test_prices(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"models": {"a": {"in": 1.0, "out": 2.0}, "b": {}}}))
    assert readers.prices(str(tmp_path / "m.json"), {"a": {"out": 3.0}}) == {"a": {"in": 1.0, "out": 3.0}, "b": {"in": 0.0, "out": 0.0}}
