"""Volumes by slabs against headers and arrays made by hand."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimulake.errors import ResourceError
from stimulake.sources import volumes


def nifti(path, a, order="<", code=4, kind="i2", slope=0.0, offset=0.0, s_code=1, q_code=0):
    raw = bytearray(360)
    struct.pack_into(f"{order}i", raw, 0, 348)
    struct.pack_into(f"{order}8h", raw, 40, a.ndim, *a.shape, *[1] * (7 - a.ndim))
    struct.pack_into(f"{order}h", raw, 70, code)
    struct.pack_into(f"{order}8f", raw, 76, -1, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into(f"{order}3f", raw, 108, 360, slope, offset)
    struct.pack_into(f"{order}2h", raw, 252, q_code, s_code)
    struct.pack_into(f"{order}6f", raw, 256, 0, 0, 1, 10, 20, 30)  # half a turn around z
    struct.pack_into(f"{order}12f", raw, 280, *range(12))
    raw[344:348] = b"n+1\0"
    path.write_bytes(bytes(raw) + a.astype(order + kind).tobytes(order="F"))


def mgh(path, a, good=1):
    head = struct.pack(">7i", 1, *a.shape, *[1] * (4 - a.ndim), 3, 0) + struct.pack(">h15f", good, 1, 2, 3, -1, 0, 0, 0, 0, -1, 0, 1, 0, 5, 6, 7)
    path.write_bytes(head.ljust(284, b"\0") + a.astype(">f4").tobytes(order="F"))


def test_headers_of_both_kinds(spark, tmp_path):
    a = np.arange(120).reshape(4, 5, 6)
    nifti(tmp_path / "a.nii", a, ">", slope=2.0, offset=1.0)
    v = volumes.Volume.of(str(tmp_path / "a.nii"))
    assert (v.shape, v.dtype, v.start, v.slope, v.offset) == ((4, 5, 6, 1), ">i2", 360, 2.0, 1.0) and v.affine[:3].ravel().tolist() == list(range(12))
    nifti(tmp_path / "q.nii", a, s_code=0, q_code=1)
    assert np.allclose(volumes.Volume.of(str(tmp_path / "q.nii")).affine, [[-2, 0, 0, 10], [0, -3, 0, 20], [0, 0, -4, 30], [0, 0, 0, 1]])
    nifti(tmp_path / "n.nii", a, s_code=0)
    assert np.allclose(volumes.Volume.of(str(tmp_path / "n.nii")).affine, np.diag([2, 3, 4, 1]))
    mgh(tmp_path / "b.mgh", a)
    v = volumes.Volume.of(str(tmp_path / "b.mgh"))
    axes = np.array([[-1, 0, 0], [0, 0, 1], [0, -1, 0]]) * [1, 2, 3]
    assert v.shape == (4, 5, 6, 1) and np.allclose(v.affine[:3, :3], axes) and np.allclose(v.affine[:3] @ [2, 2.5, 3, 1], [5, 6, 7])
    for name, data in (("z.nii", b"\x1f\x8b" + bytes(400)), ("s.nii", b"abc"), ("x.nii", bytes(400))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ResourceError):
            volumes.Volume.of(str(tmp_path / name))


def test_planes_voxels_and_masks(spark, tmp_path):
    a = np.random.default_rng(1).integers(-99, 99, size=(4, 5, 6, 2))
    nifti(tmp_path / "a.nii", a, slope=0.5, offset=3.0)
    mgh(tmp_path / "b.mgh", a[..., 0])
    path = str(tmp_path / "a.nii")
    reader = volumes.SlabReader({"path": path, "partitionbytes": "80"})
    assert [(p.frame, p.low, p.high) for p in reader.partitions()] == [(f, k, k + 2) for f in (0, 1) for k in (0, 2, 4)]
    planes = volumes.read_planes(spark, path, 80).where("k >= 2 AND k < 5 AND frame = 1")
    got = {(r["i"], r["j"], r["k"]): r["value"] for r in volumes.voxels(planes).collect()}
    assert got == {(i, j, k): a[i, j, k, 1] * 0.5 + 3 for i in range(4) for j in range(5) for k in (2, 3, 4)}
    mask = spark.createDataFrame([(1, 2, 3), (0, 0, 4), (1, 2, 3)], "i int, j int, k int")
    inside = {(r["i"], r["j"], r["k"], r["value"]) for r in volumes.masked(spark, str(tmp_path / "b.mgh"), mask).collect()}
    assert inside == {(1, 2, 3, float(a[1, 2, 3, 0])), (0, 0, 4, float(a[0, 0, 4, 0]))}
    assert volumes.masked(spark, path, mask.limit(0)).count() == 0
    assert volumes.read_planes(spark, path).where("k = 77").count() == 0


def test_volume_written_by_planes(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 0, 1.5), (3, 4, 5, -2.0), (3, 4, 5, -3.0), (1, 2, 3, None)], "i int, j int, k int, value double")
    path = str(tmp_path / "out" / "v.nii")
    affine = np.array([[2.0, 0, 0, 1], [0, 3, 0, 2], [0, 0, 4, 3], [0, 0, 0, 1]])
    volumes.write_volume(cells, path, (4, 5, 6), affine, fill=0.0)
    v = volumes.Volume.of(path)
    assert v.shape == (4, 5, 6, 1) and np.allclose(v.affine, affine) and [p.name for p in (tmp_path / "out").iterdir()] == ["v.nii"]
    found = volumes.voxels(volumes.read_planes(spark, path)).where(F.col("value") != 0).collect()
    assert {(r["i"], r["j"], r["k"], r["value"]) for r in found if r["value"] == r["value"]} == {(0, 0, 0, 1.5), (3, 4, 5, -2.0)}
    volumes.write_volume(cells.limit(0), str(tmp_path / "empty.nii"), (2, 2, 2))
    assert volumes.voxels(volumes.read_planes(spark, str(tmp_path / "empty.nii"))).where("NOT isnan(value)").count() == 0
    with pytest.raises(ResourceError):
        volumes.write_volume(cells, str(tmp_path / "bad.nii"), (2, 2, 2))
