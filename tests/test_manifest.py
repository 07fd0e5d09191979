"""Manifests and vector shards come back whole or not at all."""

from pathlib import Path

import pytest

from quarrykit.sources.manifest import MEDIA, read_manifest, read_vectors, write_manifest, write_vectors

ROWS = [("a/b.png", 3, "image", "a"), ("é \"q\".png", 0, "image", "__root__"), ("c/d.webm", 9, "video", None), ("c/d.webm", 9, "video", None)]


def lines(path):
    return [p for p in (Path(path) / "media").glob("*.json") if p.stat().st_size]


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    write_manifest(spark.createDataFrame([(*r, 1) for r in ROWS], MEDIA + ", more int"), path, "c1")
    assert sorted(map(str, (tuple(r) for r in read_manifest(spark, path, "c1").collect()))) == sorted(map(str, ROWS))
    with pytest.raises(ValueError, match="another configuration"):
        read_manifest(spark, path, "c2")
    file = lines(path)[0]
    whole = file.read_text()
    first, rest = whole.split("\n", 1)
    for sum_file in file.parent.glob(".*.crc"):
        sum_file.unlink()
    file.write_text(whole + first + "\n")
    with pytest.raises(ValueError, match="records"):
        read_manifest(spark, path, "c1")
    file.write_text(first.replace("image", "imagE").replace("video", "videO") + "\n" + rest)
    with pytest.raises(ValueError, match="digest"):
        read_manifest(spark, path, "c1")
    file.write_text(whole)
    assert read_manifest(spark, path, "c1").count() == 4


@pytest.mark.parametrize("row", [("../x", 1, "image", "a"), ("/x", 1, "image", "a"), (None, 1, "image", "a"), ("x", -1, "image", "a"), ("x", None, "image", "a")])
def test_unsafe_records(spark, tmp_path, row):
    path = str(tmp_path / "m")
    write_manifest(spark.createDataFrame([row], MEDIA), path, "c")
    with pytest.raises(Exception, match="unsafe or broken record"):
        read_manifest(spark, path, "c").collect()


def test_no_header(spark, tmp_path):
    path = str(tmp_path / "m")
    write_manifest(spark.createDataFrame([], MEDIA), path, "c")
    assert read_manifest(spark, path, "c").count() == 0
    for p in (Path(path) / "header").iterdir():
        p.unlink()
    with pytest.raises(ValueError, match="no header"):
        read_manifest(spark, path, "c")


def test_vectors(spark, tmp_path):
    t = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(20)], "vec_id long, v array<double>")
    path = str(tmp_path / "v")
    write_vectors(t, path, "m")
    ids = spark.createDataFrame([(3,), (3,), (7,)], "vec_id long")
    assert sorted(tuple(r) for r in read_vectors(spark, path, "m", ids).collect()) == [(3, [3.0, 0.5]), (7, [7.0, 0.5])]
    assert read_vectors(spark, path, "m").count() == 20
    with pytest.raises(ValueError, match="lacks"):
        read_vectors(spark, path, "m", spark.createDataFrame([(99,)], "vec_id long"))
    spark.createDataFrame([(3, [3.0, 0.25])], "vec_id long, v array<float>").write.mode("append").parquet(path + "/rows")
    with pytest.raises(ValueError, match="not those of its header"):
        read_vectors(spark, path, "m")


@pytest.mark.parametrize("rows", [[(1, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [float("nan")])], [(1, None)], [(None, [1.0])], [(1, [None])]])
def test_bad_vectors_are_not_written(spark, tmp_path, rows):
    path = tmp_path / "v"
    with pytest.raises(ValueError, match="ids occur twice"):
        write_vectors(spark.createDataFrame(rows, "vec_id long, v array<double>"), str(path), "m")
    assert not path.exists()
