"""stream_upsert: each batch is one run, however many files hold it, and no file holds all of it."""

import json
import random

from keystrata.plans import catalogue


def test_a_batch_of_many_files_is_one_run(spark, tmp_path, monkeypatch):
    rng, model = random.Random(7), {}
    events = [(k, rng.randrange(50), rng.choice(["click", "view", "error"]), float(k)) for k in range(9000)]
    for k, user, kind, value in events:
        model[user] = (user, k, kind, value)
    rng.shuffle(events)
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalogue, "_folder", lambda _, name: str(tmp_path / name))
    got = [tuple(r) for r in catalogue.stream_upsert(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(r for r in model.values() if r[2] != "error")
    manifest = json.loads(max((tmp_path / "stream/db").glob("manifest-*")).read_text())
    assert len(manifest["tables"]["events"]["runs"]) == 2
    files = [spark.read.parquet(str(f)).count() for f in (tmp_path / "stream/in").glob("*.parquet")]
    assert sum(files) == 9000 and max(files) < 3000  # a file of the later batch, 6000 rows, is of one task
