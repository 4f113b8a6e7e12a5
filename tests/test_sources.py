import numpy as np
import pytest
from pyspark.sql import functions as F

from stimulake.errors import ResourceError
from stimulake.sources import formats, npy
from stimulake.streaming.moments import windowed_moments

SF = "/root/testdata/sf0.001"


def test_npy_round_trip(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(7, 2, 3))
    np.save(tmp_path / "a.npy", a)
    wide = formats.read_npy(spark, str(tmp_path / "*.npy"))
    got = {r["row"]: r["values"] for r in wide.collect()}
    assert all(np.allclose(got[i], a[i].ravel()) for i in range(7))
    back = formats.to_wide(formats.to_long(wide, ["row"]), ["row"])
    assert {r["row"]: r["values"] for r in back.collect()} == got


def test_colour_table_images_sessions(spark, tmp_path):
    (tmp_path / "t.ctab").write_text("0  none 0 0 0\n1\tV1 255 0 0\n\nbad\nx y\n")
    assert sorted(tuple(r) for r in formats.read_colour_table(spark, str(tmp_path / "t.ctab")).collect()) == [(0, "none"), (1, "V1")]
    (tmp_path / "img" / "b").mkdir(parents=True)
    for name in ("img/z.jpg", "img/b/a.JPEG", "img/c.txt"):
        (tmp_path / name).write_bytes(b"12")
    assert [r["path"].rsplit("/", 1)[1] for r in formats.list_images(spark, str(tmp_path / "img")).collect()] == ["a.JPEG", "z.jpg"]
    for i in (2, 1):
        spark.range(i).write.parquet(str(tmp_path / f"s{i}"))
    both = formats.read_sessions(spark, [str(tmp_path / "s2"), str(tmp_path / "s1")])
    assert sorted(tuple(r) for r in both.collect()) == [(0, 1), (0, 2), (1, 2)]
    with pytest.raises(ResourceError):
        formats.read_sessions(spark, [])


def test_write_responses_prunes(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("unit"), (F.col("id") % 2).alias("subject"))
    formats.write_responses(df, str(tmp_path / "r"))
    read = spark.read.parquet(str(tmp_path / "r")).where("subject = 1")
    assert read.count() == 5 and "PartitionFilters: [isnotnull(subject" in read._jdf.queryExecution().toString()


def test_card():
    pytest.importorskip("yaml")
    card = formats.read_card("model_id: m\nmodality: eeg\ntraining_dataset: t\nparameters:\n  subject: {valid_values: [1]}\n  selection: {properties: {roi: {}}}\n")
    assert (card.model_id, card.selection_keys, card.parameters) == ("m", ("roi",), {"subject": {"valid_values": [1]}})


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_moments(stream).writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"], round(r["mean"], 9), round(r["var"], 6)) for r in df.collect())
    assert key(spark.table("moments")) == key(windowed_moments(events))


def test_readers_by_extension(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.ones((2, 3)))
    spark.range(4).write.parquet(str(tmp_path / "b.parquet"))
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d.ctab").write_text("1 V1\n")
    (tmp_path / "e.json").write_text('{"x": 1}\n')
    (tmp_path / "f.PNG").write_bytes(b"1")
    counts = {n: formats.read_by_extension(spark, str(tmp_path / n)).count() for n in ("a.npy", "b.parquet", "c.csv", "d.ctab", "e.json", "f.PNG")}
    assert counts == {"a.npy": 2, "b.parquet": 4, "c.csv": 1, "d.ctab": 1, "e.json": 1, "f.PNG": 1}
    for name in ("g.mat", "npy", "dir.npy/x"):
        with pytest.raises(ResourceError):
            formats.read_by_extension(spark, str(tmp_path / name))


def test_npy_reads_only_what_is_asked_for(spark, tmp_path):
    """Ten rows of a sparse file of 3 GB, which would not fit a cell; then ranges of columns, several files, and types."""
    width, rows = 1500, 250_000
    with open(tmp_path / "big.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (rows, 30, 50)})
        start = f.tell()
        for row in (0, 7, rows - 1):
            f.seek(start + row * width * 8)
            f.write(np.full(width, row + 0.5).tobytes())
    df = npy.read_npy(spark, str(tmp_path / "big.npy"), columns=(10, 14))
    got = {r["row"]: r["values"] for r in df.where(F.col("row").isin(0, 7, rows - 1, rows)).collect()}
    assert got == {0: [0.5] * 4, 7: [7.5] * 4, rows - 1: [rows - 0.5] * 4}
    whole = npy.read_npy(spark, str(tmp_path / "big.npy")).where("row >= 3 AND row < 9 AND row <> 5")
    assert sorted((r["row"], len(r["values"])) for r in whole.collect()) == [(r, width) for r in (3, 4, 6, 7, 8)]
    assert whole.where("row = 100").count() == 0


def test_npy_partitions_types_and_errors(spark, tmp_path):
    reader = npy.NpyReader({"path": str(tmp_path), "partitionbytes": "64"})
    a = np.arange(40, dtype=np.int16).reshape(10, 4)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", a[:0])
    np.save(tmp_path / "c.npy", np.float32(3))
    list(reader.pushFilters([]))
    parts = reader.partitions()
    assert [p.runs for p in parts] == [[(0, 8)], [(8, 10)], [(0, 1)]]
    assert [b.num_rows for p in parts for b in reader.read(p)] == [8, 2, 1]
    got = sorted((r["file"].rsplit("/", 1)[1], r["row"], r["values"]) for r in npy.read_npy(spark, str(tmp_path), partition_bytes=10).collect())
    assert got == [("a.npy", i, a[i].tolist()) for i in range(10)] + [("c.npy", 0, [3.0])]
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(Exception, match="by columns"):
        npy.read_npy(spark, str(tmp_path / "f.npy")).collect()
    with pytest.raises(Exception, match="no array files"):
        npy.read_npy(spark, str(tmp_path / "none*.npy")).collect()
    (tmp_path / "x.npy").write_bytes(b"no array")
    with pytest.raises(ResourceError):
        npy.Header.of(str(tmp_path / "x.npy"))


def test_npy_written_parts(spark, tmp_path):
    a = np.random.default_rng(3).normal(size=(50, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "row long, values array<double>").repartitionByRange(4, "row")
    out = str(tmp_path / "out")
    npy.write_npy(df, out)
    parts = sorted((tmp_path / "out").glob("part-*.npy"))
    assert len(parts) == 4 and not list((tmp_path / "out").glob(".*"))
    rows = np.concatenate([np.load(p.with_suffix(".index")) for p in parts])
    assert sorted(rows) == list(range(50)) and np.array_equal(np.vstack([np.load(p) for p in parts])[np.argsort(rows)], a)
    with pytest.raises(Exception, match="already"):
        npy.write_npy(df, out)
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "row long, values array<double>").coalesce(1)
    with pytest.raises(Exception, match="same length"):
        npy.write_npy(ragged, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("part*"))
    npy.write_npy(df.limit(2), out, mode="overwrite")
    assert npy.read_npy(spark, out).count() == 2
