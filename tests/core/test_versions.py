"""Tables with versions: changes appear together or not at all, and touch only the files they must."""

import pytest
from pyspark.sql import functions as F

from tracewright.session import fresh_path
from tracewright.sources.versions import Conflict, Store


@pytest.fixture
def store(spark):
    made = Store(spark, fresh_path(spark, "store"))
    begun = made.begin()
    begun.append("scans", spark.range(8).select(F.col("id").alias("scan_id"), (F.col("id") % 3).alias("user_id")).repartition(2))
    begun.append("findings", spark.range(40).select("id", (F.col("id") % 8).alias("scan_id"), F.lit("open").alias("state")).repartitionByRange(4, "id"))
    begun.commit()
    return made


def ids(df):
    return sorted(r.id for r in df.collect())


def test_cascade_and_triage_together(spark, store):
    change = store.begin()
    gone = change.read("scans").where("user_id = 1")
    change.remove("findings", gone, ["scan_id"])
    change.delete("scans", F.col("user_id") == 1)
    change.update("findings", F.col("id") < 4, {"state": F.lit("triaged")})
    assert len(ids(store.read("findings"))) == 40 and store.read("scans").count() == 8  # nothing is seen yet
    assert change.commit() == 2
    left = store.read("findings")
    assert ids(left) == [i for i in range(40) if i % 8 % 3 != 1] and store.read("scans").count() == 5
    assert ids(left.where("state = 'triaged'")) == [0, 2, 3]
    assert len(ids(store.read("findings", 1))) == 40  # as it was


def test_killed_writer_changes_nothing(spark, store):
    change = store.begin()
    change.delete("findings", F.lit(True))
    change.append("scans", spark.createDataFrame([(100, 1)], "scan_id bigint, user_id bigint"))
    del change  # its files lie there, no version names them
    assert len(ids(store.read("findings"))) == 40 and store.read("scans").count() == 8 and store.versions() == [1]


def test_second_of_two_writers_fails(store):
    one, two = store.begin(), store.begin()
    one.delete("findings", F.col("id") == 1)
    two.delete("findings", F.col("id") == 2)
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert ids(store.read("findings")) == [i for i in range(40) if i != 1]


def test_only_touched_files_are_written(store):
    before = {r.file for r in store.files("findings").collect()}
    change = store.begin()
    change.delete("findings", F.col("id") == 5)
    change.commit()
    after = {r.file for r in store.files("findings").collect()}
    assert len(before) == 4 and len(before & after) == 3


def test_nulls_empties_and_missing_columns(spark, store):
    change = store.begin()
    change.append("findings", spark.createDataFrame([(90,)], "id bigint"))
    change.delete("findings", F.col("scan_id") == 0)  # null for the new row, which stays
    change.delete("findings", F.col("id") == 1000)
    change.commit()
    assert ids(store.read("findings")) == [i for i in range(40) if i % 8] + [90]
    change = store.begin()
    change.delete("findings", F.lit(True))
    change.delete("findings", F.lit(True))
    change.commit()
    assert store.read("findings").collect() == [] and store.read("findings").columns == ["id", "scan_id", "state"]
    with pytest.raises(KeyError):
        store.read("nothing")
