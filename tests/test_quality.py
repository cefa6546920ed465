from pyspark.sql import functions as F

from earshot.operators import joins as J
from earshot.operators import quality as Q
from earshot.operators import taxonomy as T

COLUMNS = "audio_id string, path string, transcript string, language string, split string, source string, speaker_id string, sample_rate int, duration double"


def index(spark, rows):
    return Q.records(spark.createDataFrame([(i, p, t, "l", s, "src", k, 16000, d) for i, p, t, s, k, d in rows], COLUMNS))


ROWS = [
    ("t1", "p1", "hello world one", "train", "k1", 2.0),
    ("a", "x", "fine sentence here", "test", "k1", 2.0),
    ("b", "x", "other sentence here", "test", "k2", 2.0),
    ("c", "y", "too long audio", "TEST", "k2", 31.0),
    ("d", "z", "has <noise> tag", "test", None, 2.0),
    ("e", "w", "[um]", "test", "", 2.0),
    ("f", "v", "ab", "eval", "k3", 9.0),
    ("g", "u", "Hello,  WORLD one", "test", "k3", 2.0),
    ("h", None, None, "test", "k3", None),
]


def test_first_reason(spark):
    got = {r["audio_id"]: r["reason"] for r in Q.excluded(index(spark, ROWS)).collect()}
    assert got == {"a": None, "b": "duplicate_audio", "c": "gt30s", "d": "tag", "e": "empty_ref", "f": "chars_per_sec", "g": "sentence_overlap", "h": "empty_ref"}


def test_kept_and_excluded_are_all(spark):
    rows = index(spark, ROWS)
    judged = Q.excluded(rows)
    got = Q.reconcile(judged.filter("reason is null"), judged.filter("reason is not null"), rows.filter("split = 'test'")).first()
    assert (got["n_raw"], got["n_kept"], got["n_dropped"], got["n_unknown"], got["n_uneven"]) == (8, 1, 7, 0, 0)


def test_summary_and_overlap(spark):
    rows = index(spark, ROWS)
    s = Q.clean_summary(Q.excluded(rows), rows).first()
    assert (s["n_raw"], s["n_clean"], s["n_speakers"], s["speaker_dependent"]) == (8, 1, 1, True)
    o = Q.overlap_sizes(rows, "speaker_id").first()
    assert (o["n_test"], o["n_shared"]) == (3, 1)


def test_audit_verdicts(spark):
    got = {r["split"]: r for r in Q.audit(index(spark, ROWS)).collect()}
    assert got["test"]["verdict"] == "FAIL" and got["train"]["verdict"] == "FLAG"
    assert got["test"]["F1_gt_30s"] == 1 and got["test"]["H5_empty_text"] == 1


def test_empty_index(spark):
    rows = index(spark, ROWS).limit(0)
    assert Q.excluded(rows).count() == 0 and Q.audit(rows).count() == 0
    assert Q.reconcile(rows, rows, rows).first()["n_raw"] == 0


def test_null_language_is_a_group(spark):
    df = spark.createDataFrame([("a", "p", "x y z", None, "test", "s", "k", 16000, 2.0), ("b", "q", "x y z", None, "train", "s", "k", 16000, 2.0)], COLUMNS)
    assert Q.excluded(Q.records(df)).first()["reason"] == "sentence_overlap"
    assert Q.audit(Q.records(df)).count() == 2


def test_first_match_and_shards(spark):
    left = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (None, 2, "c")], "id int, ordinal int, t string")
    right = spark.createDataFrame([(1, 5, "late"), (1, 3, "first")], "id int, ordinal int, t string")
    assert [tuple(r) for r in J.parallel_pairs(left, right, "id", "ordinal", "t").collect()] == [(1, 0, "a", "first")]
    assert J.unmatched(left, right, "id").count() == 2
    o = J.id_overlap(left, right, "id").first()
    assert (o["n_left"], o["n_right"], o["n_shared"], o["low_overlap"]) == (2, 1, 1, False)
    shards = spark.createDataFrame([("x", 0), ("y", 1), ("y", 1)], "k string, s int")
    manifest = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    m = J.merge_shards(shards, manifest, "k", "s", 2).first()
    assert (m["n_repeated"], m["n_missing"], m["n_unknown"], m["ok"]) == (1, 1, 0, False)
    assert J.merge_shards(manifest.withColumn("s", F.lit(0)), manifest, "k", "s", 1).first()["ok"]
    bad = J.payload_check(manifest.withColumn("t", F.lit("a")), shards.select("k").withColumn("t", F.lit("b")), "k", "t")
    assert sorted(tuple(r) for r in bad.collect()) == [("x", "text differs"), ("y", "text differs"), ("z", "missing")]


def test_taxonomy(spark):
    kind = "benchmark string, model string, lang string, sample_id string, provenance string, errors array<struct<ref_span: string, hyp_span: string, category: string, confidence: double>>, notes string"
    e = lambda c: ("", "", c, 1.0)
    rows = spark.createDataFrame([("b", "m", "sw_ke", "1", "CLEAN", [e("boundary"), e("sub_phonetic")], ""), ("b", "m", "sw_ke", "2", "A2_loop", [e("boundary")], ""), ("b", "m", "sw_ke", "3", None, None, ""), ("b", "m", "sw_ke", "4", "CLEAN", None, "")], kind)
    got = T.per_cell(rows).first()
    assert (got["n_sampled"], got["n_clean"], got["pct_CLEAN"], got["n_errors"], got["pct_boundary"], got["b5_share_of_subs"]) == (4, 2, 50.0, 2, 50.0, 0.0)
    assert T.by_typology(rows).first()["typology"] == "bantu_agglutinative"
    assert T.by_typology(rows.filter("sample_id = '4'")).count() == 0 and T.by_typology(rows.filter("sample_id = '4'"), True).count() == 1
