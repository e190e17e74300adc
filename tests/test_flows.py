"""Sources, sinks and flows over a small dataset on disk."""

import gzip
import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import dedup, link, score, segments, summary
from lectern.plans import flows
from lectern.sources import audio, layout, manifests, sinks, tables, textgrid
from lectern.streaming import scoring

GRID = """File type = "ooTextFile"
Object class = "TextGrid"
xmin = 0
xmax = 3
tiers? <exists>
size = 2
item []:
    item [1]:
        class = "IntervalTier"
        name = "CHILD"
        xmin = 0
        xmax = 3
        intervals: size = 4
        intervals [1]:
            xmin = 0
            xmax = 1.0
            text = "ga <um> u"
        intervals [2]:
            xmin = 1.0
            xmax = 1.0
            text = "<enumerator>"
        intervals [3]:
            xmin = 1.0
            xmax = 2.5
            text = "la ""e""
  ka "
        intervals [4]:
            xmin = 2.5
            xmax = 3
    item [2]:
        class = "IntervalTier"
        name = "other"
        xmin = 0
        xmax = 3
        intervals [1]:
            xmin = 0
            xmax = 3
            text = 'hm'
"""


def wav(path, seconds, rate=8000, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        x = (np.sin(np.arange(round(seconds * rate)) / 9) * 9000).astype("<i2")
        w.writeframes(np.repeat(x, channels).tobytes())


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    (root / "0_IAR" / "2_TextGrid" / "a_b_c").mkdir(parents=True)
    (root / "Student_Full_Canonical_EGRA_1.csv").write_text(
        'learner_id,audio_file,audio_type,canonical_text,textgrid\na_b_c,a_b_c-audio_passage_1.wav,passage_num1,"ga u ""la""\nx",a_b_c-audio_passage_1.TextGrid\n'
        "a_b_c,a_b_c-audio_iso_letter_2.wav,iso_letter_2,b m,none.TextGrid\nd_e_f,d_e_f-audio_missing.wav,iso_letter_2,k,\n", encoding="utf-8"
    )
    (root / "Student_MetaData_EGRA_1.csv").write_text("learner_id,gender,region,child_grade,child_age,extra\na_b_c,f,north,2,8,x\nz,m,south,3,nine,y\n")
    (root / "passages.csv").write_bytes("num,text\n\n1,pass\xe9e un\nbad\n2,two,more\n".encode("cp1252"))
    (root / "0_IAR" / "2_TextGrid" / "a_b_c" / "a_b_c-audio_passage_1.TextGrid").write_text(GRID)
    wav(root / "0_Audio" / "a_b_c" / "a_b_c-audio_passage_1.wav", 3)
    wav(root / "0_Audio" / "a_b_c" / "a_b_c-audio_iso_letter_2.wav", 0.5, 16000, 2)
    hyp = [{"audio_filepath": "/x/a_b_c-audio_passage_1.wav", "pred_text": "old"}, {"audio_filepath": "/y/a_b_c-audio_passage_1.wav", "pred_text": "ga u\ne"}, {"pred_text": "no path"}]
    (root / "h1.jsonl.gz").write_bytes(gzip.compress(("\n".join(map(json.dumps, hyp)) + "\n\nnot json\n[1]\n").encode()))
    (root / "h2.jsonl").write_text(json.dumps({"audio_filepath": "/z/a_b_c-audio_iso_letter_2.flac", "pred_text": "ba"}) + "\n")
    return root


def test_csv_sources(spark, data):
    items = tables.read_items(spark, str(data / "Student_Full_Canonical_EGRA_1.csv")).collect()
    assert len(items) == 3 and items[0].canonical_text == 'ga u "la"\nx'
    learners = {r.learner_id: r for r in tables.read_learners(spark, str(data / "Student_MetaData_EGRA_1.csv")).collect()}
    assert learners["a_b_c"].child_age == 8 and learners["z"].child_age is None and learners["z"].extra == "y"
    assert [tuple(r) for r in tables.read_passages(spark, str(data / "passages.csv")).collect()] == [("num", "text"), ("1", "passée un"), ("2", "two")]


def test_manifests(spark, data, tmp_path):
    paths = [str(data / "h1.jsonl.gz"), str(data / "h2.jsonl")]
    got = {r.audio_stem: r.hyp_text for r in manifests.read_manifests(spark, paths).collect()}
    assert got == {"a_b_c-audio_passage_1": "ga u\ne", "a_b_c-audio_iso_letter_2": "ba"}
    assert tuple(manifests.bad_lines(spark, paths[0]).first()) == (2, 3)
    rows = [{"a": 1}, {"b": [2, {"c": 3}]}, {"d": "x } {"}]
    forms = {"lines": "\n".join(map(json.dumps, rows)), "array": json.dumps([*rows, 5]), "one": json.dumps(rows[0], indent=1), "pretty": "junk {" + "".join(json.dumps(r, indent=2) + " ,\n" for r in rows) + "}{"}
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        got = [json.loads(r.json) for r in manifests.read_json_objects(spark, str(tmp_path / name)).orderBy("ord").collect()]
        assert got == (rows[:1] if name == "one" else rows), name
    (tmp_path / "bad").write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception, match="not JSON"):
        manifests.read_strict(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "scored").write_text('{"audio_filepath": "a", "text": "x"}\n')
    with pytest.raises(Exception, match="pred_text"):
        manifests.read_scored(spark, str(tmp_path / "scored")).collect()
    (tmp_path / "eval").write_text('{"audio_filepath": "r/a.wav", "pred_text": null, "wer": "0.5", "ref_text": "é"}\n{"audio_filepath": " ", "x": 1}\n{"audio_filepath": "b"}\n')
    r = {x.audio_stem: x for x in manifests.read_eval_manifest(spark, str(tmp_path / "eval")).collect()}
    assert (r["a"].manifest_hyp_present, r["a"].hyp_text, r["a"].wer, r["a"].ref_text, r["b"].manifest_hyp_present) == (True, "", 0.5, "é", False) and len(r) == 2
    assert [x.path for x in manifests.paths_of(spark, str(tmp_path / "eval")).orderBy("ord").collect()] == ["r/a.wav", "b"]


def test_textgrid(spark, data):
    rows = textgrid.read_intervals(spark, str(data)).orderBy("idx").collect()
    assert [(r.idx, r.tier, r.xmin, r.xmax, r.text) for r in rows] == [(0, "CHILD", 0, 1, "ga <um> u"), (1, "CHILD", 1, 1, "<enumerator>"), (2, "CHILD", 1, 2.5, 'la "e"\nka'), (3, "other", 0, 3, "hm")]
    assert textgrid.tier_text(textgrid.read_intervals(spark, str(data))).first().ref_text == 'ga u la "e" ka'


def test_audio(spark, data):
    listed = audio.list_files(spark, str(data))
    assert [p.path.rsplit("/", 1)[1] for p in listed.collect()] == ["a_b_c-audio_iso_letter_2.wav", "a_b_c-audio_passage_1.wav"]
    files = audio.read_files(spark, str(data / "0_Audio"))
    assert sorted(r.duration for r in audio.durations(files).collect()) == [0.5, 3.0]
    x, rate = audio.samples(files.where("path like '%letter%'").first().content, 8000)
    assert rate == 8000 and len(x) == 4000
    junk = spark.createDataFrame([("bad", b"RIFF")], "path string, content binary")
    model = lambda: lambda batch, rate: [f" {len(b)} " if len(b) > 4000 else "" for b in batch]
    got = {r.audio_filepath.rsplit("/", 1)[-1]: r for r in audio.transcribe(files.unionByName(junk), model).collect()}
    assert got["a_b_c-audio_passage_1.wav"].pred_text == "24000" and got["a_b_c-audio_iso_letter_2.wav"].pred_text == "" and got["bad"].error and got["bad"].duration is None
    cuts = files.select(F.col("path").alias("wav"), F.lit("p.wav").alias("audio_filepath"), F.lit(100).cast("long").alias("first_sample"), F.lit(900).cast("long").alias("last_sample"))
    assert {audio.header_duration(bytes(r.content)) for r in audio.pieces(files, cuts).collect()} == {0.1, 0.05}
    rows = spark.createDataFrame([(listed.first().path, None), ("/no/where.wav", None), ("x", 7.0)], "audio_filepath string, duration double")
    assert sorted(r.duration for r in audio.duration_or_zero(rows).collect()) == [0.0, 0.5, 7.0]


def test_layout(spark, data, tmp_path):
    found = layout.find_layout(spark, str(data))
    assert found.items_csv.endswith("Canonical_EGRA_1.csv") and found.grids.endswith("0_IAR/2_TextGrid") and found.audio.endswith("0_Audio")
    with pytest.raises(FileNotFoundError):
        layout.find_layout(spark, str(tmp_path))
    assert layout.table_location({"A_URL": "s3://x"}, "A") == "s3://x"
    with pytest.raises(KeyError):
        layout.table_location({}, "A")


def test_build_and_score(spark, data, tmp_path):
    found = layout.find_layout(spark, str(data))
    built = flows.build_manifest(spark, found, [str(data / "h1.jsonl.gz"), str(data / "h2.jsonl")], str(data / "passages.csv"))
    rows = {r.audio_filepath.rsplit("_", 2)[-2] + r.audio_filepath.rsplit("_", 1)[-1]: r for r in built.collect()}
    assert len(rows) == 2
    one = rows["passage1.wav"]
    assert (one.duration, one.pred_text, one.ref_text, one.can_text) == (3.0, "ga u\ne", 'ga u la "e" ka', "passée un")
    assert rows["letter2.wav"].can_text == "ba ma" and rows["letter2.wav"].ref_text == ""
    sinks.write_cleaned(built, str(tmp_path / "clean"), drop_empty=False)
    scored, categories = flows.score_manifest(spark, str(tmp_path / "clean"), str(data / "Student_MetaData_EGRA_1.csv"))
    got = {r.audio_type: r for r in scored.collect()}
    assert got["passage_passage"].gender == "f" and got["passage_passage"].REF == "ga u la e ka" and got["passage_passage"].N_ref_hyp == 5
    assert (got["letters_isolated"].C_can_hyp, got["letters_isolated"].I_ref_hyp, got["letters_isolated"].N_ref_hyp) == (1, 1, 0)
    table = {r.category: r for r in categories.collect()}
    assert len(table) == 8 and table["passage_passage"].wer == 40.0 and table["syllables_grid"].n == 0 and table["letters_isolated"].accuracy == 0
    assert "[global]" in sinks.summary_text(categories)
    assert summary.long_scores(categories).where("category = 'passage_passage' and metric = 'wer'").first().value == 40.0
    assert tuple(sinks.clean_stats(built).first()) == (2, 0, 1, 1)
    only_ref, only_can = flows.offline_manifests(built.select(F.lit("l").alias("learner_id"), F.col("audio_filepath").alias("audio_file"), F.lit("x").alias("audio_type"), F.col("can_text").alias("canonical_text"), "ref_text"), spark.createDataFrame([("/r/l/a_b_c-audio_passage_1.wav", "h", 1)], "audio_filepath string, pred_text string, ord int"), "/r")
    assert only_ref.count() == only_can.count() == 1
    sinks.write_jsonl(only_ref, str(tmp_path / "ref"))
    each, rate = flows.cross_check(spark, str(tmp_path / "ref"))
    assert each.first().wer == 1.0 and rate.first().rate == 1.0
    with pytest.raises(Exception, match="exceeds"):
        flows.cross_check(spark, str(tmp_path / "ref"), tolerance=0.5)[1].collect()
    stream = scoring.scored_stream(spark, str(tmp_path / "clean"))
    q = scoring.write_scored(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert scoring.running_rates(spark.read.parquet(str(tmp_path / "out"))).count() == 2


def test_segment_flow(spark, data, tmp_path):
    path = next(p.path for p in audio.list_files(spark, str(data)).collect() if "passage" in p.path)
    (tmp_path / "m").write_text(json.dumps({"audio_filepath": path, "can_text": "c"}) + "\n" + json.dumps({"audio_filepath": "/q/z_z_z-audio.wav"}) + "\n")
    cut, reasons = flows.segment_manifest(spark, str(tmp_path / "m"), str(data), "out")
    got = cut.orderBy("first_sample", "last_sample").collect()
    assert [(r.audio_filepath.rsplit("_", 1)[1], r.duration, r.first_sample, r.last_sample) for r in got] == [("segment1.wav", 1.0, 0, 8000), ("segment3.wav", 3.0, 0, 24000), ("segment2.wav", 1.5, 8000, 20000)]
    assert {r.reason: r.n for r in reasons.collect()} == {"used": 1, "missing_annotation": 1}
    flows.update_manifest(spark, str(tmp_path / "m"), [str(data / "h2.jsonl")]).collect()


def test_links(spark):
    items = spark.createDataFrame([("a", "nan"), ("b", "mine"), (None, None), ("c", None)], "audio_stem string, hyp_text string")
    hyps = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "theirs"), (None, "never")], "audio_stem string, hyp_text string")
    assert sorted((r.audio_stem or "", r.hyp_text) for r in link.attach_hypotheses(items, hyps).collect()) == [("", ""), ("a", "one"), ("a", "two"), ("b", "mine"), ("c", "")]
    assert {r.hyp_text for r in link.attach_hypotheses(items.select("audio_stem"), hyps).collect()} == {"one", "two", "theirs", ""}
    with pytest.raises(ValueError):
        link.attach_hypotheses(items, hyps, "size")
    with pytest.raises(KeyError):
        link.attach_hypotheses(items, hyps, "name")
    d = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (None, 5, "z")], "k int, ord int, v string")
    assert sorted(r.v for r in dedup.keep_first(d, ["k"], ["ord"]).collect()) == ["y", "z"]
    assert sorted(r.v for r in dedup.keep_last(d, ["k"], ["ord"]).collect()) == ["x", "z"]


def test_segments_in_both_profiles(spark, data):
    rows = [("l", f, "passage_num1", c, r, h, i) for i, (f, c, r, h) in enumerate([("x_segment10.wav", "can", "ten", "h10"), ("x_segment2.wav", " ", "two", ""), ("x.wav", "", "last", None), ("y.wav", "ka", "ka", "ka"), ("y2_segment1.wav", None, " ", " ")])]
    df = spark.createDataFrame(rows, "learner_id string, audio_file string, audio_type string, canonical_text string, ref_text string, hyp_text string, ord int")
    got = {r.audio_file: r for r in segments.merge_segments(df).collect()}
    assert set(got) == {"x.wav", "y.wav", "y2.wav"}
    assert (got["x.wav"].ref_text, got["x.wav"].hyp_text, got["x.wav"].canonical_text, got["x.wav"].ord) == ("two ten last", "h10", " ", 0)
    v1 = {r.audio_file: r for r in score.with_advanced(score.score_rows_v1(df, tables.read_learners(spark, str(data / "Student_MetaData_EGRA_1.csv")))).collect()}
    first = v1["x.wav"]
    assert first.CAN_FG == "can" and first.REF_FG == "last two ten" and first.HYP_FG == "h10" and first.N_can_ref == 3 and v1["x_segment2.wav"].N_can_ref is None
    assert v1["y.wav"].EGRA_COR == 1 and v1["y.wav"].MAE_EGRA_COR == 0 and v1["y.wav"].MER == 0.0
    assert v1["x.wav"].WER_ref_hyp == 100.0 and v1["y2_segment1.wav"].WER_ref_hyp is None and v1["y2_segment1.wav"].MER is None
    assert not v1["x.wav"].has_hyp and math.isclose(v1["y.wav"].Bias_Baseline_MAE, abs(100 - (100 + 0) / 2))
    cat = score.with_categories(score.with_advanced(score.score_rows_v1(df)))
    assert "Mistakes" in sinks.summary_text_v1(summary.global_v1(cat), summary.task_blocks_v1(cat))
    walk = summary.walkthrough(score.score_rows_v1(df).withColumn("ord", F.monotonically_increasing_id())).collect()
    assert len(walk) == 1 and walk[0].HYP.strip()


def test_small_rates(spark):
    pairs = spark.createDataFrame([("a, b. c?", "a b, c?"), ("x", "x")], "t string, h string")
    got = summary.punctuation_error_rate(pairs, "t", "h").first()
    assert (got.errors, got.length) == (1, 3) or (got.errors, got.length) == (2, 3)
    assert summary.corpus_error_rate(pairs, "t", "h", characters=True).first().length == 9
    assert summary.real_time_factor(spark.createDataFrame([(3.0,), (None,)], "duration double"), 2.0).first().rtfx == 1.5
    tags = spark.createDataFrame([("u", "ccs"), ("u", "d"), ("v", "")], "k string, tags string")
    assert sorted(tuple(r) for r in summary.tag_frequencies(tags, "tags", "k").collect()) == [("u", "c", 2), ("u", "d", 1), ("u", "s", 1)]
    scored = spark.createDataFrame([("l1", "f", "n", 1, 3), ("l1", "m", "s", 2, 3), (None, "f", "n", 1, 4)], "learner_id string, gender string, region string, child_grade int, child_age int")
    assert tuple(summary.overview(scored).first()) == (3, 1)
    assert summary.filtered(scored, regions=["n"], genders=["f"], age=3).count() == 1 and summary.filtered(scored).count() == 3
    assert [r.region for r in summary.options(scored, "region").collect()] == ["n", "s"]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="C_can_ref"):
        summary.pair_summary(spark.createDataFrame([(1,)], "S_can_ref int"), "can_ref")


def test_layout_at_any_depth(spark, tmp_path):
    deep = tmp_path / "x" / "y"
    hub = deep / "0IAR" / "z"
    (hub / "2_TextGrid" / "ann").mkdir(parents=True)
    (deep / "0_Audio").mkdir()
    for p in (deep / "Student_Full_Canonical_EGRA2.csv", tmp_path / "x" / "a" / "Student_Full_Canonical_EGRA9.csv", tmp_path / "Student_MetaData_EGRA.csv", tmp_path / "Student_Full_Canonical_1.csv"):
        p.parent.mkdir(exist_ok=True)
        p.write_text("a\n")
    got = layout.find_layout(spark, str(tmp_path), "ann")
    assert got.items_csv == str(tmp_path / "x" / "a" / "Student_Full_Canonical_EGRA9.csv") and got.grids == str(hub / "2_TextGrid" / "ann")
    assert got.audio == str(tmp_path / "0_Audio")  # not in the hub, so only a name
    with pytest.raises(FileNotFoundError):
        layout.find_layout(spark, str(tmp_path), "nobody")


def test_manifests_keep_the_order_of_paths(spark, tmp_path):
    for name, texts in (("b", "12"), ("a", "3")):
        (tmp_path / name).mkdir()
        for i, t in enumerate(texts):
            (tmp_path / name / f"{i}.jsonl").write_text("".join(json.dumps({"audio_filepath": "s.wav", "pred_text": f"{t}{k}"}) + "\n" for k in range(3)))
    paths = [str(tmp_path / "b"), str(tmp_path / "a" / "0.jsonl")]
    rows = manifests.read_manifest(spark, paths).orderBy("ord").collect()
    assert [r.hyp_text for r in rows] == ["10", "11", "12", "20", "21", "22", "30", "31", "32"]
    assert [r.hyp_text for r in manifests.read_manifests(spark, paths).collect()] == ["32"] and [r.hyp_text for r in manifests.read_manifests(spark, paths[::-1]).collect()] == ["22"]


def test_pieces_are_written_and_transcribed(spark, data, tmp_path):
    files = audio.read_files(spark, str(data / "0_Audio"))
    intervals = files.select(F.col("path").alias("wav"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), F.lit(a).alias("xmin"), F.lit(b).alias("xmax"), F.lit("x").alias("text")) for i, a, b in ((0, 0.0, 0.25), (1, 0.25, 0.4))])).alias("i")).select("wav", "i.*")
    cuts = segments.cut(files.select(F.col("path").alias("wav"), F.lit(None).cast("long").alias("samples")), intervals, str(tmp_path / "cut"), 8000)
    assert audio.write_pieces(audio.pieces(files, cuts, 8000)) == 4 == audio.write_pieces(audio.pieces(files, cuts, 8000))
    assert sorted(r.duration for r in audio.durations(audio.read_files(spark, str(tmp_path / "cut"))).collect()) == [0.15, 0.15, 0.25, 0.25]
    model = lambda: lambda batch, rate: [[str(len(b)), "?", "!"] for b in batch]
    got = flows.transcribe_segments(files, intervals, model).collect()
    assert [(r.pred_text, r.duration) for r in got] == [("2000 1200", 0.4)] * 2
    best = audio.transcribe(audio.by_duration(files).select("path", "content"), model, n_best=2).collect()
    assert all(len(r.n_best) == 1 and len(r.n_best[0]) == 2 for r in best)
    assert audio.Decoding("rnnt").of(("ctc", "rnnt")) == "rnnt"
    with pytest.raises(ValueError):
        audio.Decoding("rnnt").of(("ctc",))


def test_reports(spark, tmp_path):
    from datetime import datetime

    df = spark.createDataFrame([(1, "b", "c d", "c", "c x", "passage_num1", "a", 0)], "extra int, audio_file string, CAN string, REF string, HYP string, audio_type string, learner_id string, ord int")
    out = sinks.with_all_columns(df)
    assert out.columns[: len(sinks.REPORT_COLUMNS)] == list(sinks.REPORT_COLUMNS) and out.columns[-2:] == ["extra", "ord"] and out.first().WER_can_ref is None
    assert sinks.in_order(df).columns == ["learner_id", "audio_type", "audio_file", "CAN", "REF", "HYP", "extra", "ord"]
    assert sinks.stamped("/out/", datetime(2024, 1, 2, 3, 4, 5)) == "/out/exp_2024_01_02_03_04_05"
    text = sinks.walkthrough_text(summary.walkthrough(df))
    assert "   2: - | d | d" in text and "   2: x | d | s" in text
    sinks.write_text(spark, text, str(tmp_path / "walk"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "walk"), wholetext=False).collect()).count("CAN to") == 2
    assert "No row" in sinks.walkthrough_text(summary.walkthrough(df.limit(0)))
