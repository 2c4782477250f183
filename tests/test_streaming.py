import json

from helpers import rows

from gatewarden.sources import identity_logs
from gatewarden.streaming import ingest


def line(i, hour, day=1, kind="user.session.start"):
    return json.dumps(
        {"uuid": i, "eventType": kind, "published": f"2024-01-{day:02d}T{hour:02d}:00:00Z", "actor": {"id": "a"},
         "outcome": {"result": "SUCCESS"}, "client": {"ipAddress": f"10.0.0.{hour}"}}
    )


def land(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    land(source, "1.json", [line("x", 1), line("y", 2), line("z", 3, kind="system.noise")])
    stream = lambda: ingest.without_repeats(ingest.stream_feed(spark, "okta", str(source)))
    ingest.run_available(stream(), out, mark)
    land(source, "2.json", [line("y", 2), line("w", 4)])
    ingest.run_available(stream(), out, mark)
    got = rows(spark.read.parquet(out), "source_event_id", "event_type")
    batch = identity_logs.normalise_okta(
        identity_logs.read_json_log(spark, str(source), identity_logs.OKTA_EVENT)
    ).dropDuplicates(["source_event_id"])
    assert got == rows(batch, "source_event_id", "event_type") == [("w", "auth.login"), ("x", "auth.login"), ("y", "auth.login")]


def test_first_run_starts_a_day_back(spark, tmp_path):
    source = tmp_path / "in"
    land(source, "1.json", [line("old", 1, day=1), line("new", 1, day=3)])
    events = ingest.stream_feed(spark, "okta", str(source), as_of="2024-01-03 12:00:00")
    out = str(tmp_path / "out")
    ingest.run_available(events, out, str(tmp_path / "mark"))
    assert rows(spark.read.parquet(out), "source_event_id") == [("new",)]


def test_daily_summary_counts_late_rows(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    land(source, "1.json", [line("a", 1), line("b", 2), line("c", 1, day=5)])
    build = lambda: ingest.daily_summary(ingest.stream_feed(spark, "okta", str(source)))
    ingest.run_available(build(), out, mark)
    land(source, "2.json", [line("late", 3), line("d", 1, day=9)])
    query = ingest.run_available(build(), out, mark)
    got = [(str(r["day"])[:10], r["total_events"]) for r in spark.read.parquet(out).orderBy("day").collect()]
    assert got[0] == ("2024-01-01", 2)
    assert ingest.dropped_late_rows(query) >= 1
