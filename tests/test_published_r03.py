"""Finding F12 of round 3: what publishing a table costs."""

import tempfile

import pytest

from shelfwise.operators import keyed, snapshots


def test_different_hashes_settle_a_key(spark, monkeypatch):
    def never(*_):
        raise AssertionError("the keys themselves were compared")

    monkeypatch.setattr(keyed, "key_report", never)
    keyed.assert_keyed(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int"), ["k", "v"])
    keyed.assert_keyed(spark.createDataFrame([], "k string"), ["k"])


@pytest.mark.parametrize(("values", "said"), [(["a", "a"], "2 rows, 1 keys, 0 rows"), (["a", None], "2 rows, 2 keys, 1 rows")])
def test_no_key_is_reported_in_full(spark, values, said):
    with pytest.raises(ValueError, match=said):
        keyed.assert_keyed(spark.createDataFrame([(v,) for v in values], "k string"), ["k"])


def test_equal_hashes_are_no_verdict(spark, monkeypatch):
    monkeypatch.setattr(keyed, "_hashes_identify", lambda *_: False)
    keyed.assert_keyed(spark.createDataFrame([("a",), ("b",)], "k string"), ["k"])


def test_folders_of_a_version_are_listed_once(spark):
    staged = snapshots.stage(spark.range(3), f"{tempfile.mkdtemp(prefix='run-', dir='/tmp')}/t", ("id",))
    assert staged.read() is staged.read() and staged.publish().count() == 3
