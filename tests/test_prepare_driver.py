"""M15 end to end: raw CSV bundle -> processed tables, sequences, manifest."""

import json

from tests.test_features_golden import DAYS, LOG, TEXTS

from rectide.operators import protocol
from rectide.plans.prepare import prepare_watch_dataset
from rectide.sources import files


def _write(path, header, rows):
    path.write_text(header + "\n" + "\n".join(",".join(str(v) for v in r) for r in rows) + "\n")


def test_prepare_watch_dataset(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    _write(raw / "small_matrix.csv", "user_id,video_id,timestamp,watch_ratio", LOG)
    _write(raw / "kuairec_caption_category.csv", "video_id,caption,category", TEXTS)
    _write(raw / "item_daily_features.csv", "video_id,author_id,video_duration,show_cnt,play_cnt,like_cnt,comment_cnt,share_cnt", DAYS)
    _write(raw / "user_features.csv", "user_id,user_active_degree", [(31, "daily"), (33, "weekly")])
    out = tmp_path / "out"
    counters = prepare_watch_dataset(spark, str(raw), str(out)).collect()[0]
    assert (counters.interactions, counters.sequences, counters.candidates) == (19, 2, 8)
    seqs = [json.loads(line) for f in sorted((out / "user_sequences.jsonl").glob("part-*.json")) for line in f.read_text().splitlines() if line]
    by_user = {s["user_id"]: s for s in seqs}
    assert by_user["31"]["item_ids"] == ["201", "204", "206", "202", "207"]
    assert by_user["33"]["test_history_item_ids"] == ["202", "207", "204", "203", "205"]
    back = files.read_sequences(spark, str(out / "user_sequences.jsonl"))
    m, c = protocol.read_manifest(spark, str(out / "candidate_manifest"))
    assert sum(r.violations for r in protocol.sequence_violations(back, c).collect()) == 0
    assert m.collect()[0].candidate_count == 8
    items = spark.read.parquet(str(out / "items.parquet"))
    assert items.count() == 8
