"""Bundles: equal bytes, checked manifests, nothing left of a failed write."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeloom.sources import bundle


def files(spark, n=40):
    return spark.range(n).select(F.concat(F.lit("a/"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("path"), F.when(F.col("id") % 9 == 0, None).otherwise(F.repeat(F.lit("é"), F.col("id").cast("int"))).cast("binary").alias("content"))


def digests(folder: Path) -> dict:
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.iterdir() if not p.name.startswith(".")}


def test_two_runs_give_equal_bytes(spark, tmp_path):
    for name, rows in (("one", files(spark)), ("two", files(spark).repartition(7))):
        bundle.write(rows, str(tmp_path / name), 3)
    one, two = digests(tmp_path / "one"), digests(tmp_path / "two")
    assert one == two and sorted(one) == ["manifest.json", "part-00000.zip", "part-00001.zip", "part-00002.zip"]
    got = {(r["path"], r["size"], r["sha256"]) for r in bundle.contents(spark, str(tmp_path / "one")).collect()}
    assert got == {(f"a/{i:03d}", len(t), hashlib.sha256(t).hexdigest()) for i in range(40) for t in [b"" if i % 9 == 0 else "é".encode() * i]}
    assert bundle.verify(spark, str(tmp_path / "one")).collect() == []
    (tmp_path / "one" / "part-00001.zip").write_bytes(b"x")
    (tmp_path / "one" / "part-00002.zip").unlink()
    (tmp_path / "one" / "part-00009.zip").write_bytes(b"y")
    assert {tuple(r) for r in bundle.verify(spark, str(tmp_path / "one")).collect()} == {("part-00001.zip", "changed"), ("part-00002.zip", "missing"), ("part-00009.zip", "unknown")}


@pytest.mark.parametrize("bad", ["a/003", "../x", "/x", ""])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    rows = files(spark).union(spark.createDataFrame([(bad, b"x")], "path string, content binary"))
    with pytest.raises(Exception, match="no path for a bundle"):
        bundle.write(rows, str(tmp_path / "out"), 3)
    assert not list((tmp_path / "out").glob("**/*.*"))
