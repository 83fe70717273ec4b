"""Files, layouts, live feeds, streams and parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavesift.operators.engines import DM, State
from wavesift.plans.params import Entry, Param, Schema, as_param
from wavesift.sources import files
from wavesift.sources.frames import FRAMES, moonflower, prepare, quickscan
from wavesift.sources.layouts import scan_layout
from wavesift.streaming.live import EOS, WAIT, FrameFeed, feed_of


def test_frames_round_trip_and_partitions(spark, tmp_path):
    frames = quickscan(spark, 50, 8)
    files.write_frames(frames, str(tmp_path), "a", 20)
    assert files.read_frames(spark, str(tmp_path), "a").count() == 50
    some = files.read_frames(spark, str(tmp_path), "a", [2])
    assert some.count() == 10
    assert "PartitionFilters: [isnotnull(scan" in some._jdf.queryExecution().toString()


@pytest.mark.parametrize("ready,calls,want", [(50, (30, 30, 30), (30, 20, EOS)), (30, (10, 30, 30), (10, 20, WAIT))])
def test_feed(spark, ready, calls, want):
    frames = quickscan(spark, 50, 4)
    feed = FrameFeed(lambda: ready, lambda a, b: frames.filter(F.col("frame_idx").between(a, b - 1)), total=50)
    got = [feed.next(n) for n in calls]
    assert tuple(g if isinstance(g, str) else g.count() for g in got) == want


def test_feed_waits_for_enough(spark):
    frames = quickscan(spark, 5, 4)
    assert feed_of(frames, total=50, min_frames=10).next(20) == WAIT
    assert feed_of(frames, total=5, min_frames=10).next(20).count() == 5


def test_images(spark, tmp_path):
    a = np.arange(12, dtype=float).reshape(3, 4)
    (tmp_path / "x.edf").write_bytes(files.encode_edf(a))
    row = files.read_images(spark, f"{tmp_path}/*.edf", (1, 3, 0, 2)).first()
    assert np.array_equal(np.frombuffer(row["intensity"], "<f4").reshape(2, 2), a[1:3, 0:2])
    assert files.decode_image(np.arange(9, dtype="<u2").tobytes(), "raw")[0].shape == (3, 3)


def test_json_trees():
    tree = {"a": np.arange(6).reshape(2, 3), "b": {"c": [1, 2 + 1j, "x"]}, "d": None}
    out = files.loads(files.dumps(tree))
    assert np.array_equal(out["a"], tree["a"]) and out["b"] == tree["b"] and out["d"] is None
    assert list(files.loads(files.dumps(tree), "d")) == ["d"]


def test_layouts():
    y, x = np.arange(3.0), np.arange(4.0)
    grid = scan_layout((3, 4), y, x)
    assert grid == scan_layout((12,), y, x) == scan_layout((3, 4), *np.meshgrid(y, x, indexing="ij"))
    assert [i for i, *_ in scan_layout((12,), y, x, box=((1, 2), (0, 1)), skip=2)] == [4, 8]
    assert [i for i, *_ in scan_layout((12,), y, x, keep=np.arange(12) % 5 == 0, order=[2, 0])] == [10, 0]
    with pytest.raises(ValueError):
        scan_layout((5,), y, x)


def test_prepare(spark):
    raw = quickscan(spark, 2, 8)
    out = prepare(raw, 6, None, 3, 2, dark=np.full((8, 8), 0.25), flat=np.full((8, 8), 0.5)).first()
    assert out["n"] == 3 and np.allclose(np.frombuffer(out["intensity"], "<f4"), 1.5)


def test_params():
    p = Param(a=1)
    p["b.c"] = 2
    assert p.b.c == p["b.c"] == 2 and p.get("b.x", 5) == 5
    p.update({"b": {"d": 3}}, in_place_depth=1)
    assert p.b.to_dict() == {"c": 2, "d": 3}
    with pytest.raises(AttributeError):
        p.nothing
    assert as_param({"x": {"y": 1}}).x.y == 1


def test_schema():
    s = Schema().add("a.n", Entry(3, ("int",), low=1, high=5)).add("a.kind", Entry("x", ("str",), choices=("x", "y"))).add("e.*.n", Entry(0, ("int",)))
    s.link("b", "a")
    assert s.defaults().to_dict() == {"a": {"n": 3, "kind": "x"}, "e": {}, "b": {"n": 3, "kind": "x"}}
    found = s.check({"a": {"n": 9, "kind": "z", "more": 1}, "e": {"q": {"n": 1}}, "b": 1})
    assert {k: v[0] for k, v in found.items()} == {"a": "PASS", "a.n": "FAIL", "a.kind": "FAIL", "a.more": "UNKNOWN", "e": "PASS", "e.q": "PASS", "e.q.n": "PASS", "b": "INVALID"}
    with pytest.raises(ValueError):
        s.validate({"a": {"n": True}})


class _Base:
    """A scan.

    Defaults:

    [steps]
    default = 5
    type = int
    lowlim = 1
    help = how many
      steps it takes

    [label]
    default = a
    type = str
    """


class _Own(_Base):
    """
    [steps]
    default = 7
    type = int
    lowlim = 1

    [box.size]
    default = (2, 3)
    type = tuple, None
    """


def test_schema_from_docstrings_and_options():
    base, own = Schema().add_class(_Base), Schema().add_class(_Own)
    assert base.at("steps").help == "how many steps it takes" and base.defaults() == {"steps": 5, "label": "a"}
    assert own.defaults().to_dict() == {"steps": 7, "label": "a", "box": {"size": (2, 3)}}
    got = own.from_arguments(["--steps", "9", "--label", "12", "--box.size", "(4, 5)"])
    assert got.to_dict() == {"steps": 9, "label": "12", "box": {"size": (4, 5)}}
    with pytest.raises(ValueError):
        own.from_arguments(["--steps", "0"])
    with pytest.raises(ValueError):
        own.from_arguments(["--steps", "__import__('os')"])
