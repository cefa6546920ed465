import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import joins as J
from earshot.plans import plan as P
from earshot.sources import audio as AU
from earshot.sources import readers as RD
from earshot.sources import writers as WR
from earshot.streaming import incremental as INC


def test_expand_pairs():
    assert P.expand_pairs(["a", "b"], ["a"], "both") == [("b", "a"), ("a", "b")]
    assert P.expand_pairs(["a", "b"], ["c"], "forward", [["c", "a"], {"source": "a", "target": "c"}]) == [("a", "c"), ("b", "c"), ("c", "a")]
    for bad in ({"direction": "x"}, {"pairs": [["a"]]}):
        with pytest.raises(ValueError):
            P.expand_pairs(["a"], ["b"], **bad)


def test_plan_from_config(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"datasets": {"d": {"root": "/x", "asr": {"languages": ["a", "b"]}, "ast": {"anchors": ["e"], "direction": "forward"}}, "n": None}}))
    plan = P.plan_of(spark, P.read_config(str(path)))
    assert [(r["dataset"], r["task"], r["language"], r["source_lang"], r["target_lang"]) for r in plan.orderBy("ordinal").collect()] == [("d", "asr", "a", None, None), ("d", "asr", "b", None, None), ("d", "ast", None, "a", "e"), ("d", "ast", None, "b", "e")]
    available = spark.createDataFrame([("d", "a")], "dataset string, language string")
    supported = spark.createDataFrame([("b",)], "language string")
    assert {r["language"]: r["reason"] for r in P.validate(plan, available, supported).collect()} == {"a": "not supported by model", "b": "not in dataset"}
    (tmp_path / "bad.json").write_text(json.dumps({"asr": {}}))
    with pytest.raises(ValueError):
        P.read_config(str(tmp_path / "bad.json"))


def test_group_glob(spark):
    g = spark.createDataFrame([("cleaned__a",), ("other",)], "group_key string")
    assert [r[0] for r in P.matching(g, "cleaned__*").collect()] == ["cleaned__a"]


def test_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("1\ta.wav\traw \"x\ttext one\tc\ts\tg\nbad\n2\tb.wav\tr\ttext two\n")
    good, bad = RD.mbaza(spark, str(tmp_path / "m.tsv"))
    assert [(r["id"], r["transcript"]) for r in good.orderBy("id").collect()] == [(1, "text one"), (2, "text two")] and bad.count() == 1
    (tmp_path / "n.xml").write_text('<corpus><speaker id="1"><recording audio="a.wav" duration="1.5"><orth>ka [s] ba</orth></recording><recording audio="b.wav" duration="1"><orth>[s]</orth></recording></speaker></corpus>')
    assert [tuple(r) for r in RD.nchlt(spark, str(tmp_path / "n.xml")).collect()] == [("a.wav", 1.5, "ka ba")]
    (tmp_path / "f.tsv").write_text("7\tx.wav\tRaw \"q\tnorm\tph\t32000\tf\n")
    assert tuple(RD.fleurs_index(spark, str(tmp_path / "f.tsv"), "sw_ke", "test").first())[:3] == ("7_32000", "x.wav", "norm")
    assert RD.fleurs_index(spark, str(tmp_path / "f.tsv"), "sw_ke", "test").first()["duration"] == 2.0
    (tmp_path / "b.tsv").write_text("audio\tsentence\na.wav\thello \"there\nb.wav\t\n")
    assert RD.bembaspeech(spark, str(tmp_path / "b.tsv")).count() == 1
    p = tmp_path / "ds" / "predictions"
    p.mkdir(parents=True)
    (p / "m_asr_sw_ke.csv").write_text('sample_id,reference,hypothesis,audio_path\n1,"a, ""b""",,x\n')
    (p / "m_asr_ast_es.csv").write_text("sample_id,reference,hypothesis,audio_path\n1,a,b,x\n")
    got = RD.predictions(spark, str(tmp_path)).collect()
    assert [(r["reference"], r["hypothesis"], r["dataset"], r["model"], r["language"]) for r in got] == [('a, "b"', "", "ds", "m", "sw_ke")]
    k = tmp_path / "ds" / "metrics"
    k.mkdir()
    (k / "a_metrics.json").write_text(json.dumps({"task": "asr", "wer": 1.5}))
    (k / "b_metrics.json").write_text("{broken")
    ok, broken = RD.metrics(spark, str(tmp_path))
    assert ok.first()["wer"] == 1.5 and broken.count() == 1
    (tmp_path / "j.jsonl").write_text('{"sample_id": "1", "provenance": "CLEAN"}\nbad\n{"sample_id": "2", "provenance": null}\n')
    assert RD.judgments(spark, str(tmp_path / "j.jsonl")).count() == 2 and RD.judgments(spark, str(tmp_path / "j.jsonl"), True).count() == 1
    with pytest.raises(KeyError):
        RD.source("nothing")
    assert RD.source("cleaned__x") is RD.manifest
    with pytest.raises(ValueError):
        RD.samples(spark.createDataFrame([("a",)], "language string"), "b")


def test_null_and_empty_survive_csv(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", None), ("2", "b", ""), ("3", "c", 'x, "y"\n')], "sample_id string, reference string, hypothesis string")
    WR.strict_csv(df, str(tmp_path / "out"))
    back = RD.strict_predictions(spark, str(tmp_path / "out"))
    assert {r["sample_id"]: r["hypothesis"] for r in back.collect()} == {"1": None, "2": "", "3": 'x, "y"\n'}


def test_partition_overwrite(spark, tmp_path):
    kind = "experiment string, dataset string, model string, task string, language string, sample_id string, hypothesis string"
    rows = lambda lang, h: spark.createDataFrame([("e", "d", "m", "asr", lang, "1", h)], kind)
    path = str(tmp_path / "p")
    WR.predictions(rows("a", "x").unionByName(rows("b", "y")), path)
    WR.predictions(rows("a", "z"), path)
    assert {r["language"]: r["hypothesis"] for r in spark.read.parquet(path).collect()} == {"a": "z", "b": "y"}


def test_report(spark):
    df = spark.createDataFrame([("a", 1.234, None)], "n string, x double, y double")
    assert WR.report(df).splitlines() == ["n  x", "a  1.23"]


def _wav(path, samples, rate=16000, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(struct.pack(f"<{len(samples)}h", *samples))


def test_audio(spark, tmp_path):
    tone = [int(10000 * np.sin(i / 5)) for i in range(1600)]
    _wav(tmp_path / "a.wav", tone)
    _wav(tmp_path / "b.wav", tone)
    _wav(tmp_path / "c.wav", [0] * 800, 8000)
    (tmp_path / "d.wav").write_bytes(b"no audio")
    got = {r["path"][-5]: r for r in AU.measured(AU.files(spark, str(tmp_path))).collect()}
    assert got["a"]["dur"] == 0.1 and got["a"]["hash"] == got["b"]["hash"] != got["c"]["hash"]
    assert got["c"]["rms_db"] == -200 and not got["d"]["ok"] and got["d"]["error"]
    bad = AU.header_problems(AU.measured(AU.files(spark, str(tmp_path))))
    assert sorted(r["problem"] for r in bad.collect()) == ["sample rate", "unreadable"]
    x = AU.mono((tmp_path / "c.wav").read_bytes())
    assert len(x) == 1600 and AU.log_mel(AU.mono((tmp_path / "a.wav").read_bytes())).shape == (8, 80)
    with pytest.raises(ValueError):
        _wav(tmp_path / "e.wav", [])
        AU.mono((tmp_path / "e.wav").read_bytes(), strict=True)


def test_stream_gives_the_same_rates(spark, data, tmp_path):
    from earshot.operators import scoring as S

    p = spark.read.parquet(f"{data}/predictions.parquet")
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    q = INC.score_arrivals(INC.stream(spark, str(tmp_path / "in"), p, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    a = {tuple(r) for r in INC.rates_so_far(spark, str(tmp_path / "out")).select(*S.CELL, "wer", "num_samples").collect()}
    assert a == {tuple(r) for r in S.corpus_rates(S.utterances(p)).select(*S.CELL, "wer", "num_samples").collect()}


def test_language_codes(spark, data):
    from earshot.functions import languages as L

    languages = spark.read.parquet(f"{data}/languages.parquet")
    got = {r["code"]: r for r in L.codes(languages).collect()}
    assert got["sw_ke"]["whisper"] == "sw" and got["zu_za"]["whisper"] is None and got["cmn_hans_cn"]["nllb"] == "zho_Hans" and got["bem"]["tuned"] == "bemba"
    assert L.code_of(languages, "iso639_1", "sw") == "sw_ke" and L.code_of(languages, "iso639_1", "xx") is None
    pairs = L.translation(languages)
    assert pairs.filter("backbone = 'whisper' and target_lang <> 'en_us'").count() == 0
    assert pairs.filter(F.col("source_lang") == F.col("target_lang")).count() == 0


def test_translation_files(spark, tmp_path):
    p = tmp_path / "ds" / "predictions"
    p.mkdir(parents=True)
    (p / "m_x_ast_cmn_hans_cn_en_us.csv").write_text('sample_id,source_transcription,reference,hypothesis\n1,s,"a, b",\n')
    (p / "m_asr_sw_ke.csv").write_text("sample_id,reference,hypothesis,audio_path\n1,a,b,x\n")
    got = RD.translations(spark, str(tmp_path), ["en_us", "cmn_hans_cn", "sw_ke"])
    row = got.first()
    assert got.count() == 1 and (row["model"], row["source_lang"], row["target_lang"], row["reference"], row["hypothesis"], row["source_transcription"]) == ("m_x", "cmn_hans_cn", "en_us", "a, b", "", "s")
    k = tmp_path / "ds" / "metrics"
    k.mkdir()
    (k / "m_x_ast_cmn_hans_cn_en_us_metrics.json").write_text(json.dumps({"task": "ast", "bleu": 12.5, "source_lang": "cmn_hans_cn"}))
    both = RD.with_metrics(got, RD.metrics(spark, str(tmp_path))[0])
    assert both.first()["bleu"] == 12.5 and RD.cells_like(both, target_lang="en_us", model=None).count() == 1 and RD.cells_like(both, target_lang="sw_ke").count() == 0


def test_cells_are_written_alone(spark, tmp_path):
    kind = "experiment string, dataset string, model string, task string, language string, wer double, cer double"
    path = str(tmp_path / "m")
    WR.metrics(spark.createDataFrame([("e", "d", "m", "asr", "a", 1.0, 2.0), ("e", "d", "m", "asr", "b", 3.0, 4.0)], kind), path)
    WR.metrics(spark.createDataFrame([("e", "d", "m", "asr", "a", 9.0, 2.0)], kind), path)
    old = spark.read.schema(kind).json(path)
    assert {r["language"]: r["wer"] for r in old.collect()} == {"a": 9.0, "b": 3.0}
    WR.update_metrics(old, spark.createDataFrame([("e", "d", "m", "asr", "b", 5.0, 0.5)], "experiment string, dataset string, model string, task string, language string, wer double, spbleu double"), path)
    new = {r["language"]: r for r in spark.read.schema(kind + ", spbleu double").json(path).collect()}
    assert (new["b"]["wer"], new["b"]["cer"], new["b"]["spbleu"], new["a"]["wer"]) == (5.0, 4.0, 0.5, 9.0)
    rows = spark.createDataFrame([("e", "d", "m", "asr", "a", "1", "r", None, "p")], "experiment string, dataset string, model string, task string, language string, sample_id string, reference string, hypothesis string, audio_path string")
    WR.predictions_csv(rows, str(tmp_path / "p"))
    back = spark.read.option("header", True).csv(str(tmp_path / "p")).first()
    assert (back["sample_id"], back["reference"], back["language"]) == ("1", "r", "a")


def test_corpora_are_guarded(spark):
    rows = lambda texts, ids=None: spark.createDataFrame([(str(i if ids is None else ids[i]), t) for i, t in enumerate(texts)], "sample_id string, text string")
    assert RD.checked(rows([" a "] * 5)).first()["text"] == "a"
    assert RD.usable(rows(["a"] * 999 + [None]))[1].first()["problem"] is None
    for bad, why in ((rows(["a"] * 99 + [" "]), "unusable rows"), (rows(["a", "b"], [1, 1]), "repeated ids"), (rows([]).limit(0), "no rows")):
        assert RD.usable(bad)[1].first()["problem"] == why
        with pytest.raises(ValueError):
            RD.checked(bad)


def test_rows_without_ids_are_numbered_by_file(spark, tmp_path):
    root = tmp_path / "data" / "ASR" / "swa"
    root.mkdir(parents=True)
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k, texts in enumerate((["a", "", "c"], ["a", "a"])):
        pq.write_table(pa.table({"id": pa.array([None] * len(texts), pa.string()), "transcription": texts, "speaker_id": ["s"] * len(texts)}), str(root / f"swa-test-{k}.parquet"))
    assert sorted(r["sample_id"] for r in RD.waxal(spark, str(tmp_path), "swa", "test", "sw_ke").collect()) == ["sw_ke_0", "sw_ke_2", "sw_ke_3", "sw_ke_4"]


def test_merged_shards(spark):
    manifest = spark.createDataFrame([(f"k{i}", i) for i in range(9)], "k string, ordinal int")
    shards = manifest.select("k", (F.col("ordinal") % 3).alias("s"), F.concat(F.lit("h"), "ordinal").alias("hypothesis"))
    got = J.merged_shards(shards, manifest, "k", "ordinal", "s", 3)
    assert [r["k"] for r in got.collect()] == [f"k{i}" for i in range(9)] and "s" not in got.columns
    for bad in (shards.filter("s < 2"), shards.unionByName(shards.limit(1)), shards.filter("k <> 'k4'")):
        with pytest.raises(ValueError):
            J.merged_shards(bad, manifest, "k", "ordinal", "s", 3)
    info = spark.createDataFrame([(0, "a"), (1, "b")], "shard int, git string")
    with pytest.raises(ValueError):
        J.merged_shards(shards, manifest, "k", "ordinal", "s", 3, info, ("git",))


def test_batches_are_exact(spark):
    from earshot.operators import taxonomy as T

    rows = spark.createDataFrame([("b", "m", "l", f"s{i}", "r", "h") for i in range(47)], "benchmark string, model string, lang string, sample_id string, reference string, hypothesis string")
    assert sorted(r["n_items"] for r in T.requests(rows).collect()) == [7, 10, 10, 10, 10] and T.requests(rows.limit(0)).count() == 0


def test_small_tables_and_scratch(spark, tmp_path):
    from earshot import runtime

    df = spark.range(5)
    assert "broadcast" in runtime.small(df)._jdf.queryExecution().logical().toString().lower() or runtime.small(df).count() == 5
    with runtime.scratch(spark):
        kept = runtime.materialize(df, "x")
        path = runtime._written[-1].removeprefix("file://")
        assert kept.count() == 5 and __import__("os").path.exists(path)
    assert not __import__("os").path.exists(path)
    shuffled = df.groupBy("id").count()
    assert runtime.spread(shuffled) is shuffled  # asking it would run a job


def test_reports_never_drop_rows(spark):
    with pytest.raises(ValueError):
        WR.report(spark.range(11), limit=10)
    text = WR.report(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "n string, x double"), average=True)
    assert text.splitlines()[-1].split() == ["Average", "1.50"]
