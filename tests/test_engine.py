import json
import random

import pytest
from pyspark.sql import functions as F

from sieveworks import schema
from sieveworks.functions import text as X
from sieveworks.operators import alignment, curves, diagnosis, extraction, ledger, scan, splits, stages, vocabulary
from sieveworks.plans import bindings, catalog
from sieveworks.session import shared_folder
from sieveworks.sources import readers, writers
from sieveworks.streaming import ledger_stream

SOURCE = "I feel a bit drowsy & have a little blurred vision, so far no gastric problems."


@pytest.fixture(scope="module")
def vocab(spark):
    concept = spark.createDataFrame(
        [("271782001", True, True, True), ("30989003", False, False, True), ("71388002", True, False, False), ("3384011000036100", True, False, False), ("419723007", False, False, False)], schema.CONCEPT
    )
    terms = [("271782001", "Drowsy (finding)", True), ("271782001", "Drowsy", False), ("271782001", "Somnolence", False), ("30989003", "Knee pain", False), ("71388002", "Procedure", False), ("3384011000036100", "Arthrotec", False), ("419723007", "Mentally dull", False)]
    d = spark.createDataFrame([(c, t, f, i) for i, (c, t, f) in enumerate(terms)], "concept_id string, term string, fsn boolean, rowid long").withColumn("norm", X.normalise_term(F.col("term")))
    return vocabulary.Vocabulary(concept, vocabulary.term_arrays(d))


def rec(sct, text="drowsy", spans=((13, 19),), kind="reaction", meddra=None, confidence=0.9, zone="NEW", n=0):
    return ("D1", kind, text, [tuple(s) for s in spans], sct, meddra, confidence, zone, None, f"D1#{n}", None)


def enriched(spark, vocab, *records, source=SOURCE, meddra=None):
    df = spark.createDataFrame(list(records), schema.RECORD)
    return stages.enrich(df, spark.createDataFrame([("D1", None, source)], schema.DOC), vocab, meddra)


def judge(spark, vocab, record, cfg=None, **more):
    v = enriched(spark, vocab, record, **more).select(stages.verdict(cfg).alias("v")).first()["v"]
    return v["verdict"], v["reason"]


@pytest.mark.parametrize(
    ("record", "cfg", "expected"),
    [
        (rec("271782001"), None, ("ACCEPT", None)),
        (rec("271782001", text="bit drowsy", spans=[(9, 19)]), None, ("BAND", None)),
        (rec("271782001", text="bit drowsy", spans=[(9, 19)]), {"lexical_mode": "contained"}, ("ACCEPT", None)),
        (rec("CONCEPT_LESS"), None, ("BAND", None)),
        (rec(None), None, ("BAND", None)),
        (rec(""), None, ("BAND", None)),
        (rec("999"), None, ("REJECT", "code_unknown")),
        (rec("71388002"), None, ("REJECT", "wrong_semantic_type")),
        (rec("71388002", kind="drug"), None, ("BAND", None)),
        (rec("71388002", kind="drug"), {"finding_scope": "all"}, ("REJECT", "wrong_semantic_type")),
        (rec("30989003"), None, ("BAND", None)),
        (rec("30989003"), {"reject_inactive": True}, ("REJECT", "code_inactive")),
        (rec("419723007"), None, ("BAND", None)),
        (rec("271782001", spans=[(11, 17)]), None, ("REJECT", "span_ungrounded")),
        (rec("271782001", text="gastric problems", spans=[(62, 78)]), None, ("BAND", None)),
        (rec("271782001", text="gastric problems", spans=[(62, 78)]), {"negation_action": "reject"}, ("REJECT", "negated")),
    ],
)
def test_verdict(spark, vocab, record, cfg, expected):
    assert judge(spark, vocab, record, cfg) == expected


def test_other_codes_reject_only_when_asked(spark, vocab):
    codes = spark.createDataFrame([("10013649", "Drowsiness")], "code string, term string")
    bad = rec("271782001", meddra="1")
    assert judge(spark, vocab, bad, meddra=codes) == ("ACCEPT", None)
    assert judge(spark, vocab, bad, {"meddra_check": "reject"}, meddra=codes) == ("REJECT", "meddra_unknown")
    assert judge(spark, vocab, rec("271782001"), {"meddra_check": "reject"}, meddra=codes) == ("ACCEPT", None)


def test_a_code_without_vocabulary_is_an_error_unless_allowed(spark):
    e = enriched(spark, None, rec("1"))
    with pytest.raises(Exception, match="needs a vocabulary"):
        e.select(stages.verdict(vocabulary=False)).collect()
    assert e.select(stages.verdict(allow_no_vocabulary=True, vocabulary=False).alias("v")).first()["v"]["verdict"] == "BAND"


def test_audit_names_what_the_order_hides(spark, vocab):
    a = enriched(spark, vocab, rec("999", spans=[(11, 17)])).select(stages.audit().alias("a")).first()["a"]
    assert a["reasons"] == ["span_ungrounded", "code_unknown"] and a["unevaluable"] == {"negation": "span not grounded"}


def test_a_missing_source_is_empty(spark, vocab):
    df = spark.createDataFrame([("D9", *rec("271782001")[1:])], schema.RECORD)
    e = stages.enrich(df, spark.createDataFrame([], schema.DOC), vocab)
    assert e.select("span_reason").first()[0] == "span_out_of_range"


def test_observe_judges_without_routing_and_final_zones_agree(spark, vocab):
    rows = [rec("271782001"), rec("999", n=1), rec(None, n=2), rec("71388002", n=3)]
    done = {}
    for mode in ("observe", "gate"):
        first = stages.apply_checks(enriched(spark, vocab, *rows), {"mode": mode})
        zones = [r["zone"] for r in first.orderBy("record_id").collect()]
        assert zones == (["NEW"] * 4 if mode == "observe" else ["ACCEPT", "REJECT", "BAND", "REJECT"])
        done[mode] = [tuple(r) for r in stages.apply_abstention(first).select("record_id", "zone", "sct", "withheld_sct").orderBy("record_id").collect()]
    assert done["observe"] == done["gate"]
    assert done["gate"][1] == ("D1#1", "ABSTAIN", None, "999") and done["gate"][0] == ("D1#0", "VERIFIED", "271782001", None)


def test_threshold_and_null_confidence(spark, vocab):
    rows = [rec("271782001", confidence=0.2), rec("271782001", confidence=None, n=1), rec("271782001", confidence=0.5, n=2)]
    out = stages.apply_abstention(stages.apply_checks(enriched(spark, vocab, *rows)), {"tau": 0.5}).orderBy("record_id").collect()
    assert [(r["zone"], r["reason"]) for r in out] == [("ABSTAIN", "low_confidence"), ("VERIFIED", None), ("VERIFIED", None)]


def test_runner_reports_missing_stages(spark, vocab):
    done = stages.run(enriched(spark, vocab, rec("271782001")), [0, 1, 2, 3], [1, 2, 3])
    assert done.order == [1, 2] and done.missing == [3]
    assert stages.ablate(enriched(spark, vocab, rec("271782001")), [0, 1, 2]).order == ["input", 1, 2]


def test_provenance_grows_where_the_zone_changes(spark, vocab):
    before = enriched(spark, vocab, rec("271782001"))
    after = stages.apply_checks(before, {"mode": "gate"})
    assert stages.marked(1, before, after).first()["provenance"] == [(1, "NEW", "ACCEPT", None)]


def test_closure_survives_diamonds_and_cycles(spark):
    edges = spark.createDataFrame([("r", "a", True), ("r", "b", True), ("a", "c", True), ("b", "c", True), ("c", "a", True), ("b", "d", False)], "parent string, child string, active boolean")
    assert sorted(r[0] for r in vocabulary.closure(edges, "r").collect()) == ["a", "b", "c", "d", "r"]
    flags = {r["id"]: (r["is_finding"], r["is_finding_hist"]) for r in vocabulary.with_findings(spark.createDataFrame([("c",), ("d",), ("x",)], "id string"), edges, "r").collect()}
    assert flags == {"c": (True, True), "d": (False, True), "x": (False, False)}


def test_search_refuses_a_reference_list(spark):
    codes = spark.createDataFrame([("1", "Back pain"), ("2", "Pain"), ("3", "Rash")], "code string, term string")
    q = spark.createDataFrame([("pain",), ("",)], "query string")
    with pytest.raises(RuntimeError):
        vocabulary.jaccard_search(codes, q, mode="reference")
    assert [(r["code"], r["score"]) for r in vocabulary.jaccard_search(codes, q).orderBy("place").collect()] == [("2", 1.0), ("1", 0.5)]


def test_contract_and_backends(spark, vocab):
    assert vocabulary.conforms(vocab) == [] and "terms.norms" in vocabulary.conforms(object())
    with pytest.raises(TypeError):
        vocabulary.select(lambda: None, lambda: vocabulary.Vocabulary(vocab.concept, vocab.concept))
    modules = vocab.concept.select("id", "active", F.when(F.col("id") == "271782001", vocabulary.INTERNATIONAL).otherwise("x").alias("module_id"))
    seen = vocabulary.restricted(vocab, modules)
    assert [r["id"] for r in seen.concept.collect()] == ["271782001"] and seen.lossy


def entries(spark, rows):
    full = [("r", g, "d", str(i), z, "judged", why, 1, 2, 1, lat, 0.0, minutes, float(i), None, v) for i, (g, z, why, lat, minutes, v) in enumerate(rows)]
    return spark.createDataFrame(full, schema.LEDGER)


def test_p95_is_the_nearest_rank(spark):
    rows = [(1, "ACCEPT", None, 10.0, 0.0, None)] * 90 + [(1, "BAND", None, 5000.0, 0.0, None)] * 10 + [(2, "BAND", None, float(x), 0.0, None) for x in range(1, 13)] + [(3, "BAND", None, 0.0, 0.0, None)]
    led = entries(spark, rows)
    assert {r["rung"]: r["p95"] for r in ledger.p95(led, ["rung"]).collect()} == {1: 5000.0, 2: 11.0}
    cost = {r["rung"]: r for r in ledger.cost_by_stage(led).collect()}
    assert cost[1]["p95_latency_s"] == 5.0 and cost[3]["p95_latency_s"] == 0.0 and cost[1]["tokens_per_record"] == 3.0


def test_histograms_drop_blanks_but_keep_zones(spark):
    led = entries(spark, [(1, "ACCEPT", "", 1.0, 0.0, None), (1, "BAND", "code_unknown", 1.0, 2.0, "BAND")])
    assert [(r["reason"], r["n"]) for r in ledger.histogram(led, "reason", 1).collect()] == [("code_unknown", 1)]
    assert ledger.histogram(led, "zone").count() == 2 and ledger.totals(led).first()["reviewed"] == 1


def test_sweep_is_monotone_and_free_lunch_needs_a_loss(spark, vocab):
    rows = [rec("271782001", confidence=i / 10, n=i) for i in range(10)]
    judged = stages.apply_checks(enriched(spark, vocab, *rows))
    points = curves.sweep(judged, F.col("confidence") >= 0.5).orderBy("tau").collect()
    assert all(a["answered"] >= b["answered"] for a, b in zip(points, points[1:], strict=False)) and points[0]["answered"] == 10
    assert curves.free_lunch(curves.sweep(judged, F.col("confidence") >= 0.5)).first()["tau"] == 0.5
    assert curves.free_lunch(curves.sweep(judged, F.lit(True))).count() == 0
    curve = spark.createDataFrame([(0.0, 0.0), (0.5, 0.1), (1.0, 0.3)], "coverage double, risk double")
    assert curves.area(curve).first()[0] == pytest.approx((0.5 * 0.05) + (0.5 * 0.2))
    assert curves.area(curve.limit(1)).first()[0] == 0.0


def mentions(spark, rows, key, extra):
    return spark.createDataFrame(rows, f"doc_id string, {key} int, fragments {schema.SPANS}, {extra}")


def test_alignment_cases(spark):
    gold = mentions(spark, [("d", 0, [(0, 10)], ["A"], "single"), ("d", 1, [(0, 10), (20, 25)], ["B"], "concept_less"), ("e", 0, [(5, 9)], [], "concept_less")], "j", "sct array<string>, gold_kind string")
    pred = mentions(spark, [("d", 0, [(0, 10), (20, 25)], "B"), ("d", 1, [(0, 10)], "A"), ("e", 0, [(5, 9)], "Z"), ("f", 0, [(1, 2)], "Q")], "i", "code string")
    for matcher in ("greedy", "optimal"):
        got = alignment.align(pred, gold, 0.5, matcher)
        assert sorted((r["doc_id"], r["i"], r["j"]) for r in got.collect()) == [("d", 0, 1), ("d", 1, 0), ("e", 0, 0)]
    s = alignment.score(pred, gold, alignment.align(pred, gold, 0.5)).first()
    assert (s["span_matched"], s["code_correct"], s["matched_ungradable"], s["spurious"], s["missed"], s["gold_gradable"]) == (3, 1, 2, 1, 0, 1)
    assert alignment.spurious(pred, alignment.align(pred, gold, 0.5)).count() == 1


def test_assignment_beats_every_permutation():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(60):
        r, c = rng.randint(1, 4), rng.randint(1, 5)
        w = [[rng.random() for _ in range(c)] for _ in range(r)]
        best = max(sum(w[i][p[i]] for i in range(r) if p[i] < c) for p in itertools.permutations(range(max(r, c)), r))
        assert sum(w[i][j] for i, j in alignment.assignment(w)) == pytest.approx(best)
    assert alignment.assignment([]) == []


def test_splits(spark):
    docs = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(500)], "doc_id long, stratum string")
    got = splits.assign(docs, 7, 41, 60).collect()
    names = [r["split"] for r in got]
    assert (names.count("dev"), names.count("test"), names.count("pool"), len({r["doc_id"] for r in got})) == (41, 60, 399, 500)
    assert abs(sum(r["stratum"] == "b" for r in got if r["split"] == "test") / 60 - 0.2) < 0.05
    assert sorted(map(tuple, got)) == sorted(map(tuple, splits.assign(docs.repartition(7), 7, 41, 60).collect()))
    assert splits.allocation({"a": 3, "b": 3, "c": 3}, 4) == {"a": 2, "b": 1, "c": 1}


def test_corpus_files(spark, tmp_path):
    for layer, rows in {
        "sct": ["TT1\t271782001 | Drowsy | 9 19\tbit drowsy", "TT9\tCONCEPT_LESS 40 44;54 62\tHair breakage", "TT2\t102498003 | Agony | or 76948002|Severe pain| 260 265\tagony", "TT3\t76948002 | Severe pain |+ 21522001 | Abdominal pain | 21 42\tx", "TT7     42399005 | Renal failure | 411 415;432 440     renal failure", "TT10\t21499005|Feeling agitated 232 249\tFeeling", "TT8\tno offsets\tx"],
        "original": ["T1\tADR 9 19\tbit drowsy", "T7\tDrug 411 415\tx", "#1\tnote"],
        "meddra": ["TT1\t10013649 9 19\tbit drowsy"],
    }.items():
        (tmp_path / layer).mkdir()
        (tmp_path / layer / "ARTHROTEC.1.ann").write_text("\n".join(rows))
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "ARTHROTEC.1.txt").write_text(SOURCE)
    docs, gold = readers.load_corpus(spark, str(tmp_path))
    assert [tuple(r) for r in docs.collect()] == [("ARTHROTEC.1", "ARTHROTEC", SOURCE)]
    got = {r["idx"]: r for r in gold.collect()}
    assert [got[i]["gold_kind"] for i in range(6)] == ["single", "any_of", "all_of", "single", "concept_less", "single"]
    assert got[0]["meddra"] == ["10013649"] and got[0]["src_type"] == "ADR" and got[3]["entity_type"] == "drug" and got[1]["entity_type"] == "reaction"
    assert [tuple(p) for p in got[4]["spans"]] == [(40, 44), (54, 62)] and got[4]["sct"] == [] and got[5]["sct"] == ["21499005"]
    r = readers.gold_as_records(gold).orderBy("record_id").collect()[0]
    assert (r["sct"], r["meddra"], r["confidence"]) == ("271782001", "10013649", 1.0)


def test_release_files(spark, tmp_path):
    (tmp_path / "sct2_Relationship_Snapshot_X.txt").write_text("id\teffectiveTime\tactive\tmoduleId\tsourceId\tdestinationId\trelationshipGroup\ttypeId\n1\t0\t1\tm\t2\t1\t0\t116680003\n2\t0\t1\tm\t3\t1\t0\t9\n")
    (tmp_path / "sct2_Concept_Snapshot_X.txt").write_text('id\teffectiveTime\tactive\tmoduleId\n1\t0\t1\tm\n2\t0\t0\t"m\n')
    (tmp_path / "sct2_Description_Snapshot_X.txt").write_text("id\teffectiveTime\tactive\tmoduleId\tconceptId\tlanguageCode\ttypeId\tterm\n7\t0\t1\tm\t1\ten\t900000000000003001\tPain (finding)\n8\t0\t0\tm\t1\ten\t1\tOld\n")
    (tmp_path / "codes.csv").write_bytes("﻿meddra_code,meddra_term\n1,First\n1, Last \n,none\n".encode())
    at = lambda k: readers.snapshot_file(str(tmp_path), f"sct2_{k}_Snapshot")
    assert [tuple(r) for r in readers.rf2_edges(spark, at("Relationship")).collect()] == [("1", "2", True)]
    assert [tuple(r) for r in readers.rf2_concepts(spark, at("Concept")).collect()] == [("1", True, "m"), ("2", False, '"m')]
    assert [tuple(r) for r in readers.rf2_descriptions(spark, at("Description")).collect()] == [("1", "Pain (finding)", "pain", True, 7)]
    assert [tuple(r) for r in readers.code_list(spark, str(tmp_path / "codes.csv")).collect()] == [("1", "Last")]
    assert readers.optional_code_list(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(FileNotFoundError):
        at("Nothing")


def test_records_round_trip_and_guards(spark, tmp_path):
    df = spark.createDataFrame([rec("271782001")], schema.RECORD)
    writers.records(df, str(tmp_path / "r"))
    assert [tuple(r) for r in readers.records(spark, str(tmp_path / "r")).select(*df.columns).collect()] == [tuple(r) for r in df.collect()]
    ids = spark.createDataFrame([("D1",)], "doc_id string")
    assert readers.guarded(df, ids).count() == 1
    with pytest.raises(ValueError, match="D1"):
        readers.guarded(df, ids.filter("false"))
    with pytest.raises(ValueError):
        readers.items(ids, ids, "test")
    assert readers.stages_of("0-2,5") == [0, 1, 2, 5]


def test_results_and_ledger_files(spark, vocab, tmp_path):
    snap = stages.apply_checks(enriched(spark, vocab, rec("271782001"), rec("999", n=1)))
    rows = ledger.entries(snap, "run", 1)
    writers.ledger(rows, str(tmp_path / "l"))
    back = readers.ledger(spark, str(tmp_path / "l"))
    assert sorted((r["rung"], r["verdict"], r["reason"]) for r in back.collect()) == [(1, "ACCEPT", None), (1, "REJECT", "code_unknown")]
    counted = ledger.snapshot_counts(snap, F.lit(True), "r1_verdict").withColumns({"rung": F.lit(1), "place": F.lit(1)})
    writers.results(ledger.results(counted, ledger.cost_by_stage(back)), str(tmp_path / "res"))
    table = spark.read.csv(str(tmp_path / "res"), header=True).first().asDict()
    assert list(table) == writers.RESULT_COLUMNS and table["accept"] == "1" and table["r1_reject_pct"] == "50.0" and table["ci_low"] is None
    q = ledger_stream.start(ledger_stream.running_costs(ledger_stream.entries(spark, str(tmp_path / "l"))), "costs", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.table("costs").first()["records"] == 2


def test_planted_faults_are_found(spark, vocab):
    rows = [rec("271782001", n=i) for i in range(5)] + [rec("CONCEPT_LESS", n=9)]
    df, src = spark.createDataFrame(rows, schema.RECORD), spark.createDataFrame([("D1", None, SOURCE)], schema.DOC)
    pool = spark.createDataFrame([(0, "71388002")], "place long, id string")
    near = spark.createDataFrame([], "code string, place long, sibling string")
    for kind, expected in {"hallucinated_code": (5, 0, 5), "wrong_type_code": (5, 0, 5), "span_shift": (5, 0, 5), "span_fabricate": (5, 0, 5), "sibling_wrong": (0, 5, 0), "meddra_hallucinated": (0, 5, 0)}.items():
        bad = stages.enrich(diagnosis.plant(df, kind, pool, pool, near), src, vocab).withColumn("verdict", stages.verdict()["verdict"])
        r = diagnosis.detection(bad.withColumn("kind", F.lit(kind)), ["kind"]).first()
        assert (r["n"], r["skipped"], r["rejected"]) == expected, kind


def test_model_output_is_counted_never_repaired(spark):
    docs = spark.createDataFrame([("D1", SOURCE), ("D2", None)], "doc_id string, text string")
    good = json.dumps({"mentions": [{"span_text": "bit drowsy", "start": 0, "end": 3, "code": "1", "confidence": 0.5}, {"span_text": "zebra"}]})
    raw = extraction.call(docs, lambda prompt, text, mode: (good if text else "{bad", 3, 4), "A")
    t = extraction.totals(raw).first()
    assert (t["documents"], t["tokens_in"], t["parse_failures"]) == (2, 6, 1)
    got = extraction.records(raw, docs).orderBy("record_id").collect()
    assert [(r["record_id"], r["spans"][0]["s"], r["offsets"]) for r in got] == [("D1#p0", 9, "search_unique"), ("D1#p1", -1, "not_in_source")]


def test_text_scan(spark):
    files = spark.createDataFrame([("a.py", "key = 'sk-" + "a" * 24 + "'"), ("b.ipynb", '{"output_type": 1}'), ("c.md", "The doctor put me on it, I stopped taking it after 3 days"), ("d", None)], "name string, text string")
    got = sorted((r["name"], r["level"]) for r in scan.scan(files).collect())
    assert got == [("a.py", "BLOCK"), ("b.ipynb", "WARN"), ("c.md", "BLOCK")]
    lines = spark.createDataFrame([("a==1",), ("b>=2",), ("# c",), ("",)], "line string")
    assert [r[0] for r in scan.unpinned(lines).collect()] == ["b>=2"]


def put(spark, folder, name, rows, columns):
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{name}.parquet")


def test_whole_items_are_found_in_any_case(spark, tmp_path):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron."
    docs = [(1, f"so {item} and {item}"), (2, f"x {item.upper()}"), (3, item[:70] + " other words"), (4, "none"), (5, f"pre{item}post"), (6, "a SHORT Item here"), (7, None)]
    put(spark, tmp_path, "documents", docs, "doc_id long, text string")
    put(spark, tmp_path, "benchmark", [(1, item), (2, "short item")], "item_id long, text string")
    got = sorted(tuple(r) for r in catalog.offset_recovery(spark, str(tmp_path)).collect())
    n = len(item)
    assert got == [(1, 1, 3, 3 + n, "search_nearest_of_2"), (2, 1, 2, 2 + n, "search_case_insensitive"), (5, 1, 3, 3 + n, "search_unique"), (6, 2, 2, 12, "search_case_insensitive")]


def test_sweep_scores_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    pred, gold = ([r.asDict() for r in f(spark, folder).collect()] for f in (bindings.predicted_mentions, bindings.gold_mentions))
    spots = lambda r: {x for f in r["fragments"] for x in range(f["s"], f["e"])}
    got = {r["threshold"]: r for r in catalog.theta_sweep(spark, folder).collect()}
    assert sorted(got) == [t / 10 for t in range(1, 10)]
    for threshold, row in got.items():
        matched = right = 0
        for doc in {r["doc_id"] for r in pred}:
            pairs = []
            for p in (r for r in pred if r["doc_id"] == doc):
                for g in (r for r in gold if r["doc_id"] == doc):
                    iou = len(spots(p) & spots(g)) / len(spots(p) | spots(g))
                    pairs += [(-iou, p["i"], g["j"], p, g)] if iou >= threshold else []
            used_p, used_g = set(), set()
            for _, i, j, p, g in sorted(pairs, key=lambda x: x[:3]):
                if i not in used_p and j not in used_g:
                    used_p.add(i), used_g.add(j)
                    matched += 1
                    right += bool(g["sct"]) and g["gold_kind"] in schema.GRADABLE_KINDS and (p["code"] or "") in g["sct"]
        assert (row["span_matched"], row["code_correct"], row["n_pred"], row["n_gold"]) == (matched, right, len(pred), len(gold))


def test_sweep_gives_thresholds_that_match_nothing(spark):
    span = "doc_id string, {} int, fragments array<struct<s:int,e:int>>, {}"
    pred = spark.createDataFrame([("D", 0, [(0, 4)], "1")], span.format("i", "code string"))
    gold = spark.createDataFrame([("D", 0, [(0, 8)], ["1"], "single")], span.format("j", "sct array<string>, gold_kind string"))
    got = [(r["threshold"], r["span_matched"], r["n_pred"], r["missed"]) for r in alignment.sweep_table(pred, gold, [0.5, 0.6]).orderBy("threshold").collect()]
    assert got == [(0.5, 1, 1, 0), (0.6, 0, 1, 1)]


def test_all_issues_of_whole_texts(spark, tmp_path):
    far = "x" * 400_001
    docs = [(1, "sk-" + "a" * 24), (2, "AIza" + "b" * 32), (3, far + " ghp_" + "c" * 32), (4, far + " password = 'abcdefghijklm'"), (5, "seen on askapatient"), (6, "The doctor put me on it, I stopped taking it after 3 days"), (7, "clean"), (8, None)]
    put(spark, tmp_path, "documents", docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in catalog.secret_scan(spark, str(tmp_path)).collect())
    assert got == [
        (1, "BLOCK", "possible service key"), (2, "BLOCK", "possible cloud key"), (3, "BLOCK", "possible repository token"), (4, "BLOCK", "possible hardcoded credential"),
        (5, "WARN", "one phrase of licensed text"), (6, "BLOCK", "reads like licensed text"),
    ]


def test_p95_of_many_different_values(spark):
    rng = random.Random(3)
    draws = {"a": lambda: rng.expovariate(1), "b": lambda: 10 ** rng.uniform(-9, 9), "c": lambda: rng.choice([1.0, 2.0, 1e9]), "d": lambda: -rng.random(), "e": lambda: 5.0, "f": lambda: 0.0}
    rows = [(k, float(f())) for k, f in draws.items() for _ in range(2000)] + [("g", 3.0), ("h", None)]
    want = {}
    for k in {k for k, v in rows if v}:
        values = sorted(v for x, v in rows if x == k and v)
        want[k] = values[min(len(values) - 1, round(0.95 * (len(values) - 1)))]
    got = {r["k"]: r["p95"] for r in ledger.p95(spark.createDataFrame(rows, "k string, latency_ms double"), ["k"]).collect()}
    assert got == want


def test_parts_of_a_document_are_matched_apart(spark):
    rng = random.Random(4)
    span = "doc_id string, {} int, fragments array<struct<s:int,e:int>>"
    made = lambda n: [("D", k, [(s, s + rng.randint(2, 9))]) for k in range(n) for s in [rng.randint(0, 120)]]
    pred, gold = spark.createDataFrame(made(40), span.format("i")), spark.createDataFrame(made(40), span.format("j"))
    whole = alignment.candidates(pred, gold, 0.2)
    parts = alignment.parted(alignment.candidates(pred, gold, 0.2, True))
    assert parts.select("part").distinct().count() > 3
    for f in (alignment.greedy, alignment.optimal):
        a, b = (f(x).toPandas() for x in (whole, parts))
        assert a["iou"].sum() == pytest.approx(b["iou"].sum()) and len(a) == len(b)
        if f is alignment.greedy:
            assert set(map(tuple, a[["i", "j"]].values)) == set(map(tuple, b[["i", "j"]].values))


def test_runs_keep_their_history_and_load_other_stages(spark, vocab, tmp_path, monkeypatch):
    df = enriched(spark, vocab, rec("271782001"), rec("999", n=1))
    done = stages.run(df, [1, 2], [1, 2], {1: {"mode": "gate"}})
    history = {r["record_id"]: [(p["rung"], p["from"], p["to"], p["reason"]) for p in r["provenance"] or []] for r in done.snapshots[2].collect()}
    assert sorted(history.values()) == sorted([[(1, "NEW", "ACCEPT", None), (2, "ACCEPT", "VERIFIED", None)], [(1, "NEW", "REJECT", "code_unknown"), (2, "REJECT", "ABSTAIN", "code_unknown")]])
    (tmp_path / "own_stages").mkdir()
    (tmp_path / "own_stages" / "__init__.py").write_text("")
    (tmp_path / "own_stages" / "r5.py").write_text("apply = lambda df, settings: df")
    (tmp_path / "own_stages" / "r6.py").write_text("import not_there_at_all")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert stages.load(5, "own_stages")("x", {}) == "x" and stages.load(4, "own_stages") is None and stages.load(4, "no_such_package") is None
    with pytest.raises(ModuleNotFoundError):
        stages.load(6, "own_stages")


def test_the_fallback_warns_and_is_remembered(spark, vocab):
    calls = []
    remote = lambda: calls.append(1) or vocabulary.Vocabulary(vocab.concept, vocab.terms, "remote", lossy=True)
    none = lambda: None
    with pytest.warns(UserWarning, match="international"):
        first = vocabulary.select(none, remote)
    assert vocabulary.select(none, remote) is first and len(calls) == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


@pytest.fixture
def plans(monkeypatch):
    """The plans of all frames that are materialised meanwhile."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, own = [], DataFrame.checkpoint
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **b: (seen.append(plan(self)), own(self, *a, **b))[1])
    return seen, plan


def test_no_round_of_the_closure_goes_to_the_driver(spark, plans):
    edges = spark.createDataFrame([("r", "a", True), ("a", "b", False), ("b", "a", True), ("b", "c", True)], "parent string, child string, active boolean")
    concepts = spark.createDataFrame([(c, True) for c in "rabcx"], "id string, active boolean")
    found = vocabulary.with_findings(concepts, edges, "r")
    assert {r["id"]: (r["is_finding"], r["is_finding_hist"]) for r in found.collect()} == {"r": (True, True), "a": (True, True), "b": (False, True), "c": (False, True), "x": (False, False)}
    seen, plan = plans
    assert len(seen) > 4 and not [p for p in [*seen, plan(found)] if "Broadcast" in p]


@pytest.mark.parametrize("name", ["r1_records", "tau_sweep", "lossy_backend", "probe_c4"])
def test_no_table_that_grows_goes_to_the_driver(spark, plans, name):
    """Only the code list of 25 nations and pools may be broadcast by their sizes, and counts of one row."""
    from sieveworks.plans import bindings, catalog

    text = plans[1](catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    built = {"r1_records": 1, "tau_sweep": 1, "lossy_backend": 0, "probe_c4": 1}[name]
    assert text.count("BroadcastHashJoin") == built
    assert "BroadcastHashJoin" not in plans[1](bindings.raw_mentions(spark, "/root/testdata/sf0.001"))


def joined(df):
    """The most rows that a join of the frame made, after it ran."""

    def most(p):
        kind = p.getClass().getSimpleName()
        inner = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        own = p.metrics().apply("numOutputRows").value() if kind.endswith("JoinExec") else 0
        return max([own, *map(most, inner)])

    return most(df._jdf.queryExecution().executedPlan())


def test_reverse_lookup_joins_no_document_with_every_code_of_its_term(spark, tmp_path):
    """30 documents, one of them twice, over 40 parts of one name; the mentions of six are flawed."""
    from sieveworks.plans import catalog

    spark.createDataFrame([(i, "Red Box", "Brand#1", "TIN", 1) for i in range(40)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i % 30, "text") for i in range(31)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.term_reverse_lookup(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted((str(i), 40, "1000000") for i in range(30) if i not in (3, 8, 9, 23, 28, 29))
    assert 0 < joined(found) <= 120


def test_siblings_meet_only_the_first_findings_of_their_word(spark):
    """120 concepts with one last word, and a word that ends a longer one; against enumeration."""
    preferred = {f"{i:03}": f"Kind{i} {'Toothache' if i % 10 == 7 else 'ache' if i % 10 == 8 else 'Headache'}" for i in range(120)}
    concepts = spark.createDataFrame([(c, int(c) % 7 != 0, int(c) % 5 != 0) for c in preferred], "id string, is_finding boolean, active boolean")
    terms = spark.createDataFrame([(c, n) for c, t in preferred.items() for n in (t.lower(), "other " + t.lower())], "concept_id string, norm string")
    gold = spark.createDataFrame(list(preferred.items()), "code string, preferred string")
    found = diagnosis.siblings(terms, concepts, gold)
    want = []
    for code, t in preferred.items():
        same = sorted(c for c, n in preferred.items() if c != code and n.lower().endswith(t.split()[-1].lower()) and int(c) % 7 and int(c) % 5)
        want += [(code, i, c) for i, c in enumerate(same[:8])]
    assert sorted((r["code"], r["place"], r["sibling"]) for r in found.collect()) == sorted(want)
    assert 0 < joined(found) <= 120 * 9


def test_closure_takes_few_jobs_on_deep_graphs(spark):
    chain = [(k, str(i), str(i + 1)) for k in ("now", "ever") for i in range(13) if k == "ever" or i != 7] + [("ever", "5", "2"), ("ever", "13", "0"), ("ever", "1", "9")]
    group = f"closure-{random.random()}"
    spark.sparkContext.setJobGroup(group, "closure")
    rows = sorted(map(tuple, vocabulary.closures(spark.createDataFrame(chain, "kind string, parent string, child string"), "0").collect()))
    spark.sparkContext.setJobGroup("", "")
    assert rows == sorted([("ever", str(i)) for i in range(14)] + [("now", str(i)) for i in range(8)])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 40


def test_rounds_of_the_closure_leave_no_garbage_in_the_driver(spark, plans):
    """A full collection after each round, and no code of stages that the driver would compile; the session's setting is as before."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    key, before = "spark.sql.codegen.wholeStage", full()
    was = spark.conf.get(key)
    edges = spark.createDataFrame([("ever", "r", "a"), ("ever", "a", "b"), ("ever", "b", "a"), ("ever", "b", "c")], "kind string, parent string, child string")
    found = vocabulary.closures(edges, "r")
    assert full() - before >= 3 and spark.conf.get(key) == was
    assert plans[0] and not [p for p in plans[0] if "*(" in p or "WholeStageCodegen" in p]
    assert sorted(r["id"] for r in found.collect()) == ["a", "b", "c", "r"]
    with pytest.raises(Exception, match="nowhere"):
        vocabulary.closures(edges.selectExpr("kind", "parent", "child", "raise_error('nowhere') AS x").filter("x is null").drop("x"), "r")
    assert spark.conf.get(key) == was


def test_enriched_records_shuffle_their_texts_once(spark, plans):
    from sieveworks.plans import bindings

    assert plans[1](bindings.enriched(spark, "/root/testdata/sf0.001").select("doc_id", "cue")).count("documents.parquet") == 1


@pytest.mark.parametrize("name", ["probe_c7", "r1_audit_records", "r1_by_entity", "r1_records", "r1_verdict"])
def test_verdicts_leave_out_what_they_do_not_need(spark, monkeypatch, name):
    """Unused columns would be dropped later, but the driver would have analysed them first, once for each column added."""
    made, match = [], stages.lexical_match
    monkeypatch.setattr(stages.N, "negation_cue", lambda *a: made.append("cue") or F.lit(None).cast("string"))
    monkeypatch.setattr(stages, "lexical_match", lambda norms, text, mode="exact": made.append(mode) or match(norms, text, mode))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert made == ["exact"]
