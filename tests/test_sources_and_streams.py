import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.table import VersionedTable
from stratum.sources import incremental, landing, readers
from stratum.streaming import queries as streams


@pytest.fixture
def base(tmp_path):
    return tmp_path


def drop(folder, name, rows):
    landing.write_atomic(folder, name, "".join(json.dumps(r) + "\n" for r in rows))


def loader(spark, base, **how):
    reg = incremental.SchemaRegistry(spark, f"file://{base}/schema")
    target = VersionedTable(spark, f"file://{base}/t")
    kw = {"kind": "json", "registry": reg, "target": target, "checkpoint": f"file://{base}/cp", "hints": T._parse_datatype_string("id bigint, n int")} | how
    return target, lambda: incremental.load_stream(spark, f"file://{base}/in", **kw)


def test_incremental_load_takes_new_files_once(spark, base):
    drop(base / "in", "a.json", [{"id": 1, "n": 5}])
    target, load = loader(spark, base)
    load(), load()
    assert target.read().count() == 1
    drop(base / "in", "b.json", [{"id": 2, "n": 6}])
    load()
    assert sorted((r.id, r.n) for r in target.read().collect()) == [(1, 5), (2, 6)]


def test_new_columns_stop_once_then_load(spark, base):
    drop(base / "in", "a.json", [{"id": 1, "n": 5, "extra": "x"}])
    target, load = loader(spark, base)
    with pytest.raises(Exception, match="new fields"):
        load()
    load()
    assert target.read().first().extra == "x"


def test_settling_loop(spark, base):
    drop(base / "in", "a.json", [{"id": 1, "extra": "x"}])
    target, load = loader(spark, base)
    incremental.load_until_settled(load)
    assert target.read().count() == 1


def test_rescue_and_fail_modes(spark, base):
    drop(base / "in", "a.json", [{"id": 1, "n": "bad", "extra": 7}, {"id": 2, "n": 3}])
    target, load = loader(spark, base, mode="rescue")
    load()
    rows = {r.id: r for r in target.read().collect()}
    assert json.loads(rows[1]._rescued_data) == {"n": "bad", "extra": "7"} and rows[1].n is None and rows[2]._rescued_data is None
    _, strict = loader(spark, base, mode="failOnNewColumns", checkpoint=f"file://{base}/cp2")
    for _ in range(2):
        with pytest.raises(Exception, match="new fields"):
            strict()
    with pytest.raises(ValueError):
        loader(spark, base, mode="whatever")[1]()


def test_csv_stream(spark, base):
    landing.write_atomic(base / "in", "a.csv", 'id,n\n1,"5"\n2,\n')
    target, load = loader(spark, base, kind="csv")
    load()
    assert sorted((r.id, r.n) for r in target.read().collect()) == [(1, 5), (2, None)]


def test_csv_stream_keeps_quoted_line_breaks_and_other_headers(spark, base):
    landing.write_atomic(base / "in", "a.csv", 'id,note\n1,"two\nlines, ""said"" x"\n2,\n')
    landing.write_atomic(base / "in", "b.csv", "note,id\nswapped,3\n")
    landing.write_atomic(base / "in", "c.csv", "id,note\n4,a,too many\n")
    target, load = loader(spark, base, kind="csv", hints=T._parse_datatype_string("id bigint, note string"))
    load()
    rows = {r.id: r for r in target.read().collect()}
    assert rows[1].note == 'two\nlines, "said" x' and rows[2].note is None and rows[3].note == "swapped"
    assert rows[4]._corrupt_record == "4,a,too many" and rows[1]._corrupt_record is None and len(rows) == 4


def test_malformed_json_is_kept(spark, base):
    landing.write_atomic(base / "in", "a.json", '{"id": 1, "n": 2}\n{"id": 2, "n"\n[3]\nplain\n\n')
    target, load = loader(spark, base)
    load()
    assert sorted(r._corrupt_record or "" for r in target.read().collect()) == ["", "[3]", "plain", '{"id": 2, "n"']
    rescue, again = loader(spark, base, mode="rescue", checkpoint=f"file://{base}/cp2", target=VersionedTable(spark, f"file://{base}/t2"))
    again()
    got = VersionedTable(spark, f"file://{base}/t2").read()
    assert {json.loads(r._rescued_data)["_corrupt_record"] for r in got.filter("id IS NULL").collect()} == {"[3]", "plain", '{"id": 2, "n"'}


def test_a_batch_that_was_committed_is_not_loaded_again(spark, base):
    import shutil

    drop(base / "in", "a.json", [{"id": 1, "n": 5}])
    target, load = loader(spark, base)
    load()
    # A crash after the commit and before the checkpoint's own: the batch runs again.
    for f in (base / "cp" / "commits").iterdir():
        f.unlink()
    load()
    assert target.read().count() == 1
    shutil.rmtree(base / "cp")


def test_many_new_fields_settle_at_once(spark, base):
    drop(base / "in", "a.json", [{"id": 1, **{f"f{k}": k for k in range(1500)}}])
    target, load = loader(spark, base)
    incremental.load_until_settled(load, retries=1)
    assert len(target.read().columns) == 1504


def test_copy_into(spark, base):
    landing.write_atomic(base / "in", "a.csv", "id,n\n1,5\n")
    t = VersionedTable(spark, f"file://{base}/t")
    read = lambda paths: spark.read.option("header", True).csv(paths)
    run = lambda **how: incremental.copy_into(spark, t, f"file://{base}/in", read, select=["cast(id as int) AS id"], **how)
    assert run() == {"files": 1, "rows": 1} and run() == {"files": 0, "rows": 0}
    landing.write_atomic(base / "in", "b.csv", "id,n\n2,6\n")
    landing.write_atomic(base / "in", "c.csv", "id,n\n3,6\n")
    assert run(max_files=1) == {"files": 2, "rows": 2} and t.read().count() == 3
    assert t.loaded().count() == 3 and run(force=True)["files"] == 3


def test_copy_into_is_one_commit(spark, base, monkeypatch):
    landing.write_atomic(base / "in", "a.csv", "id\n1\n")
    t = VersionedTable(spark, f"file://{base}/t")
    run = lambda: incremental.copy_into(spark, t, f"file://{base}/in", lambda p: spark.read.option("header", True).csv(p))

    def crash(*_):
        raise RuntimeError("crash")

    monkeypatch.setattr(VersionedTable, "_write_log", crash)
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.undo()
    assert run() == {"files": 1, "rows": 1} and run() == {"files": 0, "rows": 0} and t.read().count() == 1


def test_readers(spark, base):
    landing.write_atomic(base / "csv", "a.csv", "id,n\n1,x\n")
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises
        readers.csv_strict(spark, f"file://{base}/csv", "id int, n int", header=True).collect()
    assert dict(readers.csv_inferred(spark, f"file://{base}/csv").dtypes)["id"] == "int"
    got = readers.with_file_metadata(readers.csv_strings(spark, f"file://{base}/csv")).first()
    assert got._input_file_name == "a.csv" and got.id == "1"
    landing.write_atomic(base / "doc", "d.json", '{\n "a": {"b": [1, 2]}\n}')
    assert readers.json_document(spark, f"file://{base}/doc").first().a.b == [1, 2]


def test_landing(base):
    with pytest.raises(ValueError):
        landing.snapshot(base, {"data": {}}, required=("data.stations",))
    assert landing.snapshot(base, {"data": {"stations": []}}, required=("data.stations",)).exists()
    assert [len(b) for b in landing.batches([{"i": i} for i in range(5)], max_bytes=1000, max_events=2)] == [2, 2, 1]
    with pytest.raises(ValueError):
        list(landing.batches([{"i": "x" * 100}], max_bytes=50, max_events=9))
    assert landing.replay(base / "m", [{"id": 1}, {"id": 2}], key="id") == 2


def test_watermark_dedup_drops_late_rows(spark, base):
    rows = lambda *ts: [{"event_id": i, "at": t} for i, t in ts]
    q = None
    steps = (("1", rows(("a", "2024-01-05T00:00:00Z"), ("a", "2024-01-05T00:00:00Z"))), ("2", rows(("b", "2024-01-10T00:00:00Z"))), ("3", rows(("c", "2024-01-01T00:00:00Z"), ("a", "2024-01-10T00:00:00Z"))))
    # Unbounded, a key is remembered for ever; else until the watermark has passed it.
    for bounded, want in ((False, ["a", "b"]), (True, ["a", "a", "b"])):
        for name, data in steps:
            drop(base / f"in{bounded}", f"{name}.json", data)
            df = streams.file_stream(spark, f"file://{base}/in{bounded}", "event_id string, at timestamp", max_files=1)
            q = streams.append_to(streams.deduplicate(df, ["event_id"], event_time="at", bounded=bounded), f"file://{base}/out{bounded}", f"file://{base}/cp{bounded}")
        assert sorted(r.event_id for r in spark.read.parquet(f"file://{base}/out{bounded}").collect()) == want
    assert streams.progress_rows(spark, q, "dedup").count() >= 1


def test_enrich_messages_and_rate_limit(spark, base):
    landing.replay(base / "m", [{"id": str(i)} for i in range(6)], key="id", max_events=2)
    df = readers.messages_from_files(spark, f"file://{base}/m", max_files=1).select(F.col("key").cast("string").alias("k"))
    static = spark.createDataFrame([("1", "one")], "k string, name string")
    q = streams.append_to(streams.enrich(df, static, "k"), f"file://{base}/out", f"file://{base}/cp")
    assert spark.read.parquet(f"file://{base}/out").filter("reference_matched").count() == 1
    assert streams.progress_rows(spark, q, "q").filter("input_rows > 0").count() == 3


def test_upsert_each_batch_bears_a_replay(spark, base):
    t = VersionedTable(spark, f"file://{base}/t")
    t.overwrite(spark.createDataFrame([(1, 1)], "k bigint, n bigint"))
    drop(base / "in", "a.json", [{"k": 1, "n": 2}, {"k": 2, "n": 3}])
    for checkpoint in ("cp1", "cp2"):
        df = streams.file_stream(spark, f"file://{base}/in", "k bigint, n bigint")
        streams.upsert_each_batch(df, lambda batch: t.merge(batch, keys=["k"]), f"file://{base}/{checkpoint}")
    assert sorted((r.k, r.n) for r in t.read().collect()) == [(1, 2), (2, 3)]


def test_rate_limit_grid(spark, base):
    for i in range(4):
        drop(base / "in", f"{i}.json", [{"k": i}])

    def run(n):
        return streams.append_to(streams.file_stream(spark, f"file://{base}/in", "k bigint", max_files=n), f"file://{base}/out{n}", f"file://{base}/cp{n}")

    got = {r.max_files: (r.batches, r.rows) for r in streams.benchmark(run, [1, 2, 4], spark).collect()}
    assert got == {1: (4, 4), 2: (2, 4), 4: (1, 4)}


def test_windows_triggers_and_table_stream(spark, base):
    assert streams.trigger_of("once") == {"once": True} and streams.trigger_of("5 seconds") == {"processingTime": "5 seconds"}
    drop(base / "in", "a.json", [{"k": "a", "at": "2024-01-01T00:00:10Z"}, {"k": "a", "at": "2024-01-01T00:00:50Z"}, {"k": "b", "at": "2024-01-05T00:00:00Z"}])
    drop(base / "in", "b.json", [{"k": "z", "at": "2024-01-09T00:00:00Z"}])
    df = streams.file_stream(spark, f"file://{base}/in", "k string, at timestamp", max_files=1)
    streams.append_to(df, f"file://{base}/copy", f"file://{base}/cp0")
    again = streams.table_stream(spark, f"file://{base}/copy", df.schema)
    q = streams.append_to(streams.windowed_counts(again, event_time="at", by=["k"], size="1 minute"), f"file://{base}/out", f"file://{base}/cp1")
    assert {(r.k, r.events) for r in spark.read.parquet(f"file://{base}/out").collect()} >= {("a", 2)}
    assert streams.status(q)["active"] is False
    streams.stop(q)
