import pytest

from sparkloom.functions import session


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 100, [1, 2], [("a", 1)]) for i in range(50)], "a long, b string, c array<int>, d array<struct<e: string, f: int>>")
    hinted = lambda: "broadcast" in session.bounded(df)._jdf.queryExecution().logical().toString().lower()
    assert hinted()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 5_000)
    assert not hinted()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 49)
    assert not hinted()


def test_stored_tables_are_read_back_and_dropped(spark):
    kept = session.stored(spark.range(5), "numbers")
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    session.dropped(kept)
    with pytest.raises(Exception, match="(?i)not.exist|no such file|FileNotFound"):
        kept.collect()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, name, usual=None):
            return usual

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
