import pytest

from memloom import scratch


class _Stub:
    """A session of a cluster without the setting."""

    def __init__(self, master):
        self.conf = type("Conf", (), {"get": lambda self, k, d=None: d, "set": lambda self, k, v: None})()
        self.sparkContext = type("Context", (), {"master": master, "_jsc": self})()

    def sc(self):
        return self

    def getCheckpointDir(self):  # noqa: N802
        return self

    def isDefined(self):  # noqa: N802
        return False


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_folder(_Stub(master))
    assert scratch.shared_folder(_Stub("local[2]"))


def test_tables_are_replaced_dropped_and_swept(spark):
    table = scratch.Scratch(spark, "check")
    first = table.write(spark.range(3), "a")
    assert first.count() == 3
    second = table.write(first.filter("id > 0"), "a")
    assert second.count() == 2 and not scratch.exists(spark, f"{table.root}/a-1") and scratch.exists(spark, f"{table.root}/a-2")
    table.write(spark.range(1), "b")
    table.drop("b", "never written")
    assert not scratch.exists(spark, f"{table.root}/b-3")
    scratch.sweep(spark)
    assert not scratch.exists(spark, table.root)


def test_once_by_key(spark, monkeypatch):
    from memloom import tables

    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (None, "c"), (3, None), (1, "a")], "id long, t string")
    want = [(1, "a"), (2, "b"), (3, None)]
    assert sorted(map(tuple, tables.once_by_key(df, "id").collect())) == want
    monkeypatch.setattr(tables, "SENT_KEYS", 0)
    assert sorted(map(tuple, tables.once_by_key(df, "id").collect())) == want
    assert tables.once_by_key(df.limit(0), "id").count() == 0 and tables.once_by_key(df.filter("id = 2"), "id").count() == 1
