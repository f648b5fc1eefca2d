"""Versions of several tables: whole or not at all, whatever fails between."""

import datetime
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from terrafolio.operators import checks
from terrafolio.sources import publish
from terrafolio.sources.publish import Blocked, Table


def frame(spark, n, start=0):
    return spark.range(start, start + n).select("id", (F.col("id") * 1.5).alias("preco"), F.when(F.col("id") % 2 == 0, "x").alias("nota"))


def read(spark, root):
    return {name: sorted(r["id"] for r in publish.current(spark, root, name).collect()) for name in ("sales", "state", "panel")}


def tables(spark, n, start=0, **rules):
    return {
        "sales": Table(frame(spark, n, start), rules={"positive": F.col("preco") >= 0, **rules}, most_change=0.3),
        "state": Table(frame(spark, n, start), "json", ["id"]),
        "panel": Table(frame(spark, n, start), "csv", ["id"]),
    }


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/site"


def test_a_version_is_read_whole_until_the_next_is_whole(spark, root, tmp_path):
    with pytest.raises(FileNotFoundError):
        publish.current(spark, root, "sales")
    first = publish.publish_version(tables(spark, 10), root)
    whole = {name: list(range(10)) for name in ("sales", "state", "panel")}
    assert read(spark, root) == whole
    lines = [x for f in sorted((tmp_path / "site/versions" / first / "state").glob("part*")) for x in f.read_text().splitlines()]
    assert len(lines) == 10 and lines == sorted(lines)
    # the second table can't be written: the first one of that version isn't seen
    failing = tables(spark, 10, 100)
    failing["state"] = Table(frame(spark, 10).withColumn("bad", F.raise_error(F.lit("no state")).cast("string")))
    with pytest.raises(Exception, match="no state"):
        publish.publish_version(failing, root)
    assert read(spark, root) == whole and not list((tmp_path / "site/staging").iterdir())
    second = publish.publish_version(tables(spark, 12, 100), root)
    assert read(spark, root)["panel"] == list(range(100, 112))
    assert sorted(r["id"] for r in publish.current(spark, root, "sales", first).collect()) == list(range(10))
    assert publish.current(spark, root, "panel").schema == publish.current(spark, root, "sales").schema
    assert publish.prune(root, 1) == [first] and read(spark, root)["state"] == list(range(100, 112))
    assert [m["version"] for m in publish.markers(root)] == [second]


def test_a_failure_after_the_move_leaves_the_old_version(spark, root, monkeypatch):
    publish.publish_version(tables(spark, 10), root)
    monkeypatch.setattr(publish, "json", SimpleNamespace(dumps=lambda *_: 1 / 0, loads=json.loads))
    with pytest.raises(ZeroDivisionError):
        publish.publish_version(tables(spark, 11, 100), root)
    monkeypatch.undo()
    assert read(spark, root)["sales"] == list(range(10))
    assert len(publish.prune(root, 5)) == 1 and read(spark, root)["sales"] == list(range(10))


def test_rules_and_changes_block(spark, root):
    publish.publish_version(tables(spark, 10), root)
    with pytest.raises(Blocked) as e:
        publish.publish_version(tables(spark, 10, 5, small=F.col("preco") < 15, noted=F.col("nota") == "x"), root)
    assert e.value.found == {"sales.small": 5}  # a null note breaks no rule
    with pytest.raises(Blocked, match="rows 10 -> 14"):
        publish.publish_version(tables(spark, 14), root)
    unequal = lambda staged: checks.violations({"same": staged["sales"].join(staged["state"], "id", "left_anti")})
    broken = tables(spark, 12)
    broken["state"] = Table(frame(spark, 9))
    with pytest.raises(Blocked) as e:
        publish.publish_version(broken, root, unequal)
    assert e.value.found == {"same": 3}
    assert read(spark, root)["sales"] == list(range(10))
    publish.publish_version(tables(spark, 12), root, unequal, datetime.datetime(2999, 1, 1))
    assert read(spark, root)["sales"] == list(range(12))
