"""Written steps: what a query leaves in the shared folder is what its result reads."""

import os

import pytest

from pixelspark import session
from pixelspark.plans import telemetry_queries  # noqa: F401
from pixelspark.plans.queries import QUERIES
from pixelspark.session import _step_of, discard, shared_dir, tidy, written


@pytest.fixture(autouse=True)
def own_folder(monkeypatch, tmp_path):
    monkeypatch.setattr(session, "_root", lambda spark: f"file://{tmp_path}")


def left(spark):
    root = shared_dir(spark).rsplit("/", 1)[0].removeprefix("file://")
    return {f for f in os.listdir(root) if f.startswith("pixelspark-")}


@pytest.mark.parametrize("name", ["a8_blobs", "w9_throttle", "w11_assign_runs", "s1_read_images", "s10_written_export", "s11_latest_image", "t1_tracked_stream", "t4_throttle_stream", "a13_registry_stream"])
def test_a_query_leaves_what_its_result_reads(spark, sf, name):
    before = left(spark)
    out = QUERIES[name](spark, sf)
    stay = {_step_of(f) for f in out.inputFiles()} - {None}
    assert left(spark) - before == stay
    assert out.count() > 0


def test_tidy_calls_nest(spark):
    before = left(spark)

    @tidy
    def inner():
        written(spark.range(3), "unread")
        return written(spark.range(5), "read")

    @tidy
    def outer():
        kept = inner()
        assert len(left(spark) - before) == 1
        return written(kept.where("id > 1"), "result")

    out = outer()
    assert out.count() == 3 and len(left(spark) - before) == 1
    discard(out)
    assert left(spark) == before


def test_a_local_session_without_a_named_folder_has_its_own(spark, monkeypatch):
    class Unset:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default: default)

    monkeypatch.undo()
    assert session._root(Unset()) == session._root(Unset()) and os.path.isdir(session._root(Unset()).removeprefix("file://"))
