import json

from prosaic.operators import control
from prosaic.sources import files


def test_texts_and_layers(spark, tmp_path):
    (tmp_path / "ch_01.md").write_text("# One\nfirst")
    (tmp_path / "ch_12.md").write_text("twelfth\n")
    (tmp_path / "voice.md").write_text("v")
    folder = str(tmp_path)
    assert {r.chapter: r.text for r in files.chapters(spark, folder).collect()} == {1: "# One\nfirst", 12: "twelfth\n"}
    assert files.chapter(spark, folder, 12).first().text == "twelfth\n" and files.chapter(spark, folder, 3).first().text == ""
    assert {r.layer: r.text for r in files.layers(spark, folder).collect()} == {"voice": "v", "world": "", "characters": "", "outline": "", "canon": ""}
    assert files.texts(spark, f"{folder}/none*.md").count() == 0
    title = files.novel_title(files.load_file(spark, f"{folder}/outline.md"), files.chapter(spark, folder, 1))
    assert title.first().title == "One"


def test_logs(spark, tmp_path):
    cut = {"quote": "q", "type": "FAT", "reason": "r", "action": "CUT", "rewrite": None}
    (tmp_path / "ch03_cuts.json").write_text(json.dumps({"cuts": [cut], "overall_fat_percentage": 20}, indent=1))
    (tmp_path / "ch07_cuts.json").write_text("{broken")
    got = {r.chapter: r for r in files.cuts(spark, str(tmp_path)).collect()}
    assert got[3].cuts[0].quote == "q" and got[7].cuts is None and got[7]._corrupt_record
    assert [r.chapter for r in files.cut_chapters(spark, str(tmp_path)).collect()] == [3, 7]
    (tmp_path / "panel.json").write_text(json.dumps({"readers": {"a": {"worst_scene": "Ch 1"}}}))
    assert [tuple(r) for r in files.panel(spark, str(tmp_path / "panel.json")).collect()] == [("a", "worst_scene", "Ch 1")]
    (tmp_path / "voices.json").write_text(json.dumps({"B": {"voice_id": "1"}, "A": {"voice_id": "2"}}))
    assert [(r.seq, r.speaker, r.voice_id) for r in files.voices(spark, str(tmp_path / "voices.json")).orderBy("seq").collect()] == [(0, "B", "1"), (1, "A", "2")]
    (tmp_path / "20250101_ch03.json").write_text(json.dumps({"engagement": {"score": 6, "fix": "f"}, "overall_score": 6.5}))
    one = files.evaluations(spark, str(tmp_path / "*_ch03.json"), ["engagement", "continuity"]).first()
    assert one.overall_score == 6.5 and list(one.dims) == ["engagement"] and one.dims["engagement"].score == "6"


def test_state_and_experiments(spark, tmp_path):
    path = str(tmp_path / "state")
    assert files.state(spark, path).first().phase == "foundation"
    saved = control.with_defaults(spark.createDataFrame([("revision", 3)], "phase string, revision_cycle int"))
    files.save_state(saved, path)
    files.save_state(saved, path)
    got = files.state(spark, path).first()
    assert (got.phase, got.revision_cycle, got.novel_score, got.debts) == ("revision", 3, 0.0, [])
    log = str(tmp_path / "log")
    assert files.experiments(spark, log).count() == 0
    rows = spark.createDataFrame([("abc", "ch01", "7.5", 1200, "keep", "first"), ("def", "ch02", "?", 900, "forced", "second")], "commit string, phase string, score string, word_count int, status string, description string")
    files.append_experiments(rows, log)
    files.append_experiments(rows.limit(1), log)
    assert files.experiments(spark, log).count() == 3 and files.experiments(spark, log).filter("score = '?'").count() == 1
