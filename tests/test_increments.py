from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillspark.plans import maintenance
from tillspark.session import work_dir
from tillspark.sources.increments import JSON, Snapshots, tree

ROW = "id string, total long, note string"


def rows(spark, count=200, **changed):
    return spark.createDataFrame(
        [(f"r{n}", changed.get(f"r{n}", n), None if n % 7 else "") for n in range(count)], ROW)


def snapshots(spark, name="snap"):
    return Snapshots(spark, work_dir(spark, name), 8)


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_one_changed_row_rewrites_one_bucket(spark):
    kept = snapshots(spark)
    first = kept.backup({"receipts": rows(spark)}).collect()
    assert [tuple(r) for r in first] == [("receipts", 8, 8)]
    root = kept.manifest()["tree"]["root"]
    again = kept.backup({"receipts": rows(spark).repartition(5)}).collect()
    assert again[0].rewritten == 0 and kept.manifest()["version"] == 1
    edit = kept.backup({"receipts": rows(spark, r17=-1)}).collect()
    assert edit[0].rewritten == 1 and kept.manifest()["tree"]["root"] != root
    assert listed(kept.read("receipts")) == listed(rows(spark, r17=-1))
    assert [tuple(r) for r in kept.verify().collect()] == [("receipts", 200, True)]
    kept.vacuum()
    assert listed(kept.read("receipts")) == listed(rows(spark, r17=-1))


def test_null_and_empty_texts_and_columns_differ(spark):
    kept = snapshots(spark)
    table = spark.createDataFrame([("a", 1, None), (None, 2, "x"), (None, 2, "x")], ROW)
    kept.backup({"t": table})
    assert listed(kept.read("t")) == listed(table)
    empty = spark.createDataFrame([("a", 1, ""), (None, 2, "x"), (None, 2, "x")], ROW)
    assert kept.backup({"t": empty}).head().rewritten == 1
    renamed = empty.withColumnRenamed("note", "other")
    report = kept.backup({"t": renamed}).head()
    assert report.rewritten == report.buckets
    assert kept.backup({"t": renamed.limit(0)}).head().rewritten == 0
    assert kept.read("t").count() == 0


def test_restore_copies_what_differs_and_refuses_damage(spark):
    kept, live = snapshots(spark), snapshots(spark, "live")
    kept.backup({"receipts": rows(spark)})
    live.backup({"receipts": rows(spark, 205, r3=-3)})
    copied = kept.restore(live).head().copied
    assert 1 <= copied <= 6
    assert listed(live.read("receipts")) == listed(rows(spark))
    assert kept.restore(live).head().copied == 0
    # A live bucket that was changed behind its manifest is found and replaced.
    folder = next(iter(live.manifest()["folders"]["receipts"].values()))
    rows(spark, 1).select("id", "total", "note").write.mode("append").parquet(
        f"{live.root}/{folder}")
    assert len(live.damaged("receipts")) >= 1
    assert kept.restore(live).head().copied >= 1
    assert listed(live.read("receipts")) == listed(rows(spark))
    folder = next(iter(kept.manifest()["folders"]["receipts"].values()))
    rows(spark, 1).write.mode("append").parquet(f"{kept.root}/{folder}")
    assert not kept.verify().head().matches
    with pytest.raises(ValueError, match="integrity"):
        kept.restore(live)


def test_a_backup_that_ends_before_the_switch_changes_nothing(spark, monkeypatch):
    kept = snapshots(spark)
    kept.backup({"receipts": rows(spark)})
    monkeypatch.setattr(Snapshots, "publish", lambda self, manifest: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.backup({"receipts": rows(spark, r1=-1)})
    monkeypatch.undo()
    assert listed(kept.read("receipts")) == listed(rows(spark))
    assert kept.verify().head().matches


def test_values_that_json_writes_alike_differ(spark):
    """JSON gives milliseconds of a time; hashes pass over nulls and signs of zero."""
    kept, kind = snapshots(spark), "id string, at timestamp_ntz, x double, list array<string>"
    base = ("a", datetime(2001, 1, 1, 0, 0, 0, 123456), 0.0, ["p", None])
    kept.backup({"t": spark.createDataFrame([base], kind)})
    for changed in ((datetime(2001, 1, 1, 0, 0, 0, 123457), *base[2:]), (base[1], -0.0, base[3]),
                    (None, *base[2:]), (base[1], base[2], [None, "p"]), (*base[1:3], None)):
        after = spark.createDataFrame([("a", *changed)], kind)
        assert kept.backup({"t": after}).head().rewritten == 1
        assert str(kept.read("t").collect()) == str(after.collect())


def test_a_copy_reads_its_buckets_only_and_needs_no_shuffle(spark):
    kept = snapshots(spark)
    kept.backup({"receipts": rows(spark)})
    some = kept._in_folders("receipts", ["1", "5"])
    assert "Exchange" not in some._jdf.queryExecution().executedPlan().toString()
    wanted = kept._dealt(rows(spark), ["1", "5"])
    assert listed(some) == listed(wanted) and 0 < some.count() < 200


def test_a_snapshot_hashed_by_json_is_verified_and_restored(spark):
    kept, live = snapshots(spark), snapshots(spark, "live")
    kept.backup({"receipts": rows(spark)})
    old = kept.manifest()
    del old["hashes"]
    old["digests"] = {"receipts": kept.digests(rows(spark), way=JSON)}
    old["version"], old["tree"] = 2, tree(old["digests"])
    kept.publish(old)
    live.backup({"receipts": rows(spark, r3=-3)})
    assert kept.verify().head().matches
    kept.restore(live)
    assert listed(live.read("receipts")) == listed(rows(spark)) and live.verify().head().matches
    assert kept.restore(live).head().copied == 0
    assert kept.backup({"receipts": rows(spark)}).head().rewritten == 8


def test_restore_queries_make_their_tables_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        made.add(1)
        return value

    def table(s, d):
        return rows(s, 40).repartition(2).select(
            seen("id").alias("id"), F.col("total").alias("totalMinor"),
            F.lit("BUILDING").alias("categoryId"), F.lit(1).alias("position"))
    monkeypatch.setattr(maintenance.adapter, "receipts", table)
    monkeypatch.setattr(maintenance.adapter, "receipt_items", table)
    back = maintenance._restored("receipts", "id", "totalMinor")(spark, "")
    assert listed(back) == listed(rows(spark, 40).select("id", "total"))
    assert made.value == 80


def test_a_whole_backup_shuffles_no_rows(spark):
    """Few buckets are brought together, all of them are written where their rows are."""
    kept, table = snapshots(spark), rows(spark).repartition(5)
    every = [str(b) for b in range(8)]
    for wanted, shuffles in ((every, 1), (every[:4], 1), (every[:3], 2)):
        dealt = kept._dealt(table, wanted)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == shuffles  # one is the repartition above
        assert {str(r["_bucket"]) for r in dealt.collect()} == set(wanted)
    kept.backup({"receipts": table})
    assert listed(kept.read("receipts")) == listed(table)
    edit = kept.backup({"receipts": rows(spark, r17=-1).repartition(5)}).head()
    assert edit.rewritten == 1 and kept.verify().head().matches
    assert listed(kept.read("receipts")) == listed(rows(spark, r17=-1))
