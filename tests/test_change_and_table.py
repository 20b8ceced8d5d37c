import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from stratum.operators import change
from stratum.operators.table import ConcurrentCommit, SchemaMismatch, VersionedTable


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/t"


def products(spark, rows):
    return change.add_record_hash(spark.createDataFrame(rows, "stock_code string, description string, unit_price double"), ["description", "unit_price"])


BASE = [("85123A", "holder", 2.55), ("71053", "lantern", 3.39)]
CHANGED = [("85123A", "holder", 3.25), ("71053", "lantern", 3.39), ("84029G", "bottle", 3.75)]


def test_hash_needs_columns_and_is_stable(spark):
    df = products(spark, BASE)
    assert [len(r[0]) for r in df.select("_record_hash").collect()] == [64, 64]
    with pytest.raises(ValueError):
        change.add_record_hash(df, [])
    with pytest.raises(ValueError):
        change.add_record_hash(df, ["nope"])


def test_deduplicate_latest_prefers_values_to_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 2), ("b", None, 3)], "k string, at int, v int")
    want = {("a", 2), ("b", 3)}
    assert {(r.k, r.v) for r in change.deduplicate_latest(df, ["k"], ["at"]).collect()} == want
    assert {(r.k, r.v) for r in change.latest_by(df, ["k"], ["at"]).collect()} == want


def test_classify(spark):
    got = change.classify(products(spark, CHANGED), products(spark, BASE), keys=["stock_code"], hash_column="_record_hash")
    assert {r.stock_code: r._action for r in got.collect()} == {"85123A": "UPDATE", "71053": "UNCHANGED", "84029G": "INSERT"}


def test_merge_and_replay(spark, path):
    t = VersionedTable(spark, path)
    t.overwrite(products(spark, BASE))
    how = {"keys": ["stock_code"], "hash_column": "_record_hash"}
    first = t.merge(products(spark, CHANGED), **how)
    assert (first.metrics["numTargetRowsInserted"], first.metrics["numTargetRowsUpdated"]) == (1, 1)
    before = t.fingerprint()
    again = t.merge(products(spark, CHANGED), **how)
    assert (again.metrics["numTargetRowsInserted"], again.metrics["numTargetRowsUpdated"]) == (0, 0)
    assert t.fingerprint() == before and before[0] == 3
    assert t.read(0).count() == 2
    assert [r.operation for r in t.history().collect()] == ["MERGE", "MERGE", "WRITE"]


def test_merge_refuses_ambiguous_sources(spark, path):
    t = VersionedTable(spark, path)
    t.overwrite(products(spark, BASE))
    with pytest.raises(change.MergeError):
        t.merge(products(spark, [*CHANGED, CHANGED[0]]), keys=["stock_code"])
    with pytest.raises(change.MergeError):
        t.merge(products(spark, [(None, "x", 1.0)]), keys=["stock_code"])


def test_update_and_insert_expressions(spark):
    target = spark.createDataFrame([(1, 10, "old")], "k int, n int, note string")
    source = spark.createDataFrame([(1, 5), (2, 7)], "k int, n int")
    got = change.upsert(source, target, keys=["k"], update_expressions={"n": "t.n + s.n", "note": "'updated'"}, insert_expressions={"note": "'new'"})
    assert sorted(map(tuple, got.collect())) == [(1, 15, "updated", "UPDATE"), (2, 7, "new", "INSERT")]


def test_insert_only_is_replay_safe(spark, path):
    t = VersionedTable(spark, path)
    t.overwrite(products(spark, BASE))
    for want in (1, 0):
        assert t.insert_new(products(spark, CHANGED), ["stock_code"]).metrics["numOutputRows"] == want
    assert t.read().count() == 3


def dimension(spark):
    return products(spark, BASE).withColumns({"version_number": F.lit(1), "effective_from": F.lit("2024-01-01").cast("timestamp"), "effective_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True)})


def test_scd2_closes_and_inserts_once(spark, path):
    t = VersionedTable(spark, path)
    t.overwrite(dimension(spark))
    how = {"key": "stock_code", "attributes": ["description", "unit_price"], "hash_column": "_record_hash", "effective_at": "timestamp'2024-02-01'"}
    assert t.scd2(products(spark, CHANGED), **how) == {"closed_rows": 1, "inserted_rows": 2}
    assert t.scd2(products(spark, CHANGED), **how) == {"closed_rows": 0, "inserted_rows": 0}
    rows = {(r.stock_code, r.version_number): (r.is_current, r.effective_to) for r in t.read().collect()}
    assert rows[("85123A", 1)] == (False, dt.datetime(2024, 2, 1)) and rows[("85123A", 2)] == (True, None)
    assert set(change.scd2_invariants(t.read(), "stock_code").first().asDict().values()) == {0}
    assert change.as_of(t.read(), "timestamp'2024-02-01'").count() == 3
    assert change.as_of(t.read(), "timestamp'2024-01-31'").count() == 2


def test_scd2_invariants_see_a_superseded_open_row(spark):
    d = dimension(spark).filter("stock_code = '71053'")
    bad = d.unionByName(d.withColumns({"version_number": F.lit(2), "effective_from": F.lit("2024-03-01").cast("timestamp")}))
    got = change.scd2_invariants(bad, "stock_code").first()
    assert got.interval_gaps == 1 and got.keys_without_one_current == 1


def test_scd2_invariants_do_not_depend_on_the_order_of_rows(spark):
    """Repeated version numbers: closed and then open, and two of one start."""
    row = lambda key, version, start, end: (key, version, start, end, end is None)
    rows = [row("a", 1, 1, 2), row("a", 1, 2, None), row("b", 1, 1, 3), row("b", 1, 1, None), row("b", 2, 3, None), row("c", 1, 1, 2), row("c", 2, 2, None)]
    want = {"keys_without_one_current": 1, "keys_with_repeated_versions": 2, "interval_gaps": 2, "backward_intervals": 0, "open_end_mismatches": 0, "version_skips": 2}
    for given in itertools.chain([rows, rows[::-1]], (rows[i:] + rows[:i] for i in range(1, len(rows)))):
        df = spark.createDataFrame(given, "k string, version_number int, effective_from int, effective_to int, is_current boolean").coalesce(1)
        assert change.scd2_invariants(df, "k").first().asDict() == want


def test_scd1_keeps_created_at(spark):
    stamp = {c: F.lit("2024-01-01").cast("timestamp") for c in ("created_at", "updated_at")}
    got = change.scd1(products(spark, CHANGED), products(spark, BASE).withColumns(stamp), key="stock_code", mutable=["description", "unit_price"], hash_column="_record_hash", at="2024-02-01")
    rows = {r.stock_code: (r.created_at.month, r.updated_at.month) for r in got.collect()}
    assert rows == {"85123A": (1, 2), "71053": (1, 1), "84029G": (2, 2)}
    assert set(change.scd1_invariants(got, "stock_code").first().asDict().values()) == {0}


def test_append_is_checked_before_it_writes(spark, path):
    t = VersionedTable(spark, path)
    t.overwrite(spark.createDataFrame([(1, "a")], "k int, v string"))
    with pytest.raises(SchemaMismatch):
        t.append(spark.createDataFrame([(2, "b", 1)], "k int, v string, x int"))
    with pytest.raises(SchemaMismatch):
        t.append(spark.createDataFrame([("2", "b")], "k string, v string"))
    assert t.versions() == [0] and t.read().count() == 1


def test_schema_evolution(spark, path):
    t = VersionedTable(spark, path)
    t.overwrite(spark.createDataFrame([(1, "a")], "k int, v string"))
    t.append(spark.createDataFrame([(2, "b", 1)], "k bigint, v string, x int"), merge_schema=True)
    assert dict(t.read().dtypes) == {"k": "bigint", "v": "string", "x": "int"}
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", None), (2, "b", 1)]


def test_rename_and_drop_do_not_mix_up_files(spark, path):
    t = VersionedTable(spark, path)
    t.overwrite(spark.createDataFrame([(1, "a")], "k int, v string"))
    t.rename_column("v", "w")
    t.append(spark.createDataFrame([(2, "b", "new")], "k int, w string, v string"), merge_schema=True)
    assert sorted(map(tuple, t.read().select("k", "w", "v").collect())) == [(1, "a", None), (2, "b", "new")]
    t.drop_column("w")
    t.add_column("w", "string")
    assert {r.w for r in t.read().collect()} == {None}
    with pytest.raises(SchemaMismatch):
        t.drop_column("nope")


def test_not_null_and_create(spark, path):
    t = VersionedTable(spark, path)
    t.create(spark.createDataFrame([], "k int, v string").schema, not_null=["k"])
    assert t.read().count() == 0
    with pytest.raises(Exception, match="NOT NULL"):
        t.append(spark.createDataFrame([(None, "a")], "k int, v string"))
    assert t.versions() == [0]
    with pytest.raises(FileExistsError):
        t.create(t.schema())


def test_two_writers_of_one_version(spark, path):
    t = VersionedTable(spark, path)
    t.overwrite(spark.createDataFrame([(1,)], "k int"))
    stale = t.commit_of()
    t.append(spark.createDataFrame([(2,)], "k int"))
    with pytest.raises(ConcurrentCommit):
        t._next("WRITE", stale, schema=t.schema(), folders=stale.folders, metrics={})


def test_delete_compact_vacuum(spark, path):
    t = VersionedTable(spark, path)
    t.overwrite(spark.createDataFrame([(i, None if i == 0 else "x") for i in range(10)], "k int, v string"), files=4)
    assert t.delete("k >= 5").metrics["numDeletedRows"] == 5
    assert t.delete("v = 'y'").metrics["numDeletedRows"] == 0
    before = t.fingerprint()
    t.compact(1, cluster=["k"])
    assert t.fingerprint() == before and t.detail()["numFiles"] == 1
    with pytest.raises(ValueError):
        t.vacuum(retain_hours=1)
    assert len(t.vacuum(retain_hours=-1, enforce=False)) == 3
    t.vacuum(retain_hours=-1, dry_run=False, enforce=False)
    assert t.fingerprint() == before


def test_a_racing_writer_is_not_overwritten(spark, path, monkeypatch):
    """A commit between planning and publishing makes every planned write fail."""
    t = VersionedTable(spark, path)
    t.overwrite(products(spark, BASE))
    other = VersionedTable(spark, path)
    folder, racing = t._folder, []

    def slow(*args, **how):
        name = folder(*args, **how)
        if not racing:
            racing.append(other.append(products(spark, [(f"R{other.commit_of().version}", "raced", 1.0)])))
        return name

    monkeypatch.setattr(t, "_folder", slow)
    for write in (lambda: t.merge(products(spark, CHANGED), keys=["stock_code"]), lambda: t.insert_new(products(spark, CHANGED), ["stock_code"]), lambda: t.delete("stock_code = '71053'"), lambda: t.compact(1), lambda: t.append(products(spark, CHANGED))):
        racing.clear()
        with pytest.raises(ConcurrentCommit):
            write()
    assert t.read().count() == 2 + 5 and t.read().filter("description = 'raced'").count() == 5


def test_torn_entry_is_skipped(spark, path, tmp_path):
    t = VersionedTable(spark, path)
    t.overwrite(spark.createDataFrame([(1,)], "k int"))
    (tmp_path / "t" / "_log" / f"{1:020d}.json").write_text('{"version": 1, "time')
    assert t.read().count() == 1 and t.versions() == [0]
    t.append(spark.createDataFrame([(2,)], "k int"))
    assert t.read().count() == 2 and t.versions() == [0, 2]


def test_many_appends_are_one_scan(spark, path):
    t = VersionedTable(spark, path)
    for i in range(13):
        t.append(spark.createDataFrame([(i, "x")], "k int, v string"))
    t.append(spark.createDataFrame([(13, "x")], "k bigint, v string"), merge_schema=True)
    assert sorted(r.k for r in t.read().collect()) == list(range(14))
    assert t.read()._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 1
    assert "Union" not in t.read()._jdf.queryExecution().optimizedPlan().toString()
    assert [sorted(r.k for r in rows.collect()) for _, rows in t.appended(11)] == [[12], [13]]
    t.compact(1)
    assert t.appended(13) == [] and t.read(3).count() == 4


def test_create_as_with_properties_and_partitions(spark, path):
    t = VersionedTable(spark, path)
    t.create_as(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), properties={"owner": "me"}, partition_by=["v"])
    t.append(spark.createDataFrame([(3, "c")], "k int, v string"))
    assert t.detail()["properties"] == {"owner": "me"} and sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(FileExistsError):
        t.create_as(spark.createDataFrame([(1,)], "k int"))


def test_numbered_batches_are_taken_once(spark, path):
    t = VersionedTable(spark, path)
    for number in (0, 0, 1, 0, 1):
        t.append(spark.createDataFrame([(number,)], "k int"), batch=("app", number))
    assert sorted(r.k for r in t.read().collect()) == [0, 1]


def test_changes_rewrite_only_the_files_they_touch(spark, path):
    t = VersionedTable(spark, path)
    t.overwrite(spark.range(100).selectExpr("cast(id as int) k", "'old' v"), files=5, cluster=["k"])
    first = t.commit_of().folders
    assert t.detail()["numFiles"] == 5
    done = t.merge(spark.createDataFrame([(3, "new"), (200, "new")], "k int, v string"), keys=["k"])
    assert done.metrics["numTargetRowsInserted"] == done.metrics["numTargetRowsUpdated"] == 1
    assert done.metrics["numOutputRows"] < 50
    assert sum(f.startswith(first[0] + "/") for f in done.folders) == 4
    gone = t.delete("k between 90 and 99")
    assert gone.metrics["numDeletedRows"] == 10 and sum(f.startswith(first[0] + "/") for f in gone.folders) == 3
    assert {r.k: r.v for r in t.read().collect()} == {k: "new" if k in (3, 200) else "old" for k in [*range(90), 200]}
    assert t.read(0).count() == 100 and t.read(1).count() == 101
    assert t.delete("k > 1000").metrics == {"numDeletedRows": 0, "numOutputRows": 0}
    whole = t.fingerprint()
    # What the last version does not need goes, file by file where a folder is needed in part.
    dead = t.vacuum(retain_hours=-1, dry_run=False, enforce=False)
    assert sum(f.startswith(first[0] + "/") for f in dead) == 2 and first[0] not in dead
    assert t.fingerprint() == whole
    t.compact(1)
    assert t.fingerprint() == whole


def test_changes_of_partitioned_tables_and_renamed_columns(spark, path):
    t = VersionedTable(spark, path)
    rows = [(k, f"{'a:%b c'[k % 6]}{k % 3}") for k in range(12)]
    t.create_as(spark.createDataFrame(rows, "k int, v string"), partition_by=["v"])
    t.rename_column("k", "key")
    t.merge(spark.createDataFrame([(0, "zero"), (50, "new")], "key int, v string"), keys=["key"])
    t.delete("key = 1 or v = 'new'")
    want = {k: "zero" if k == 0 else v for k, v in rows if k != 1}
    assert {r.key: r.v for r in t.read().collect()} == want
    t.append(spark.createDataFrame([(60, "more")], "key int, v string"))
    t.delete("v is null or key = 60")
    assert {r.key: r.v for r in t.read().collect()} == want
