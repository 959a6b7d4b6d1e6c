"""Readers, the report, and streams."""

import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plateloom.model import OBJECT, FilterSpec, dataset_from_list
from plateloom.operators import image
from plateloom.sources import cellprofiler, images, report
from plateloom.streaming import stateless


def fileset_a(folder, name, cells=3, extra=""):
    head1 = "Image\tcell\tnucl\tcell" + ("\tcell" if extra else "")
    head2 = "ImageNumber\tObjectNumber\tParent_cell\tArea_Size" + (f"\t{extra}" if extra else "")
    rows = [f"1\t{i + 1}\t{i}\t{1.5 * i if i else 'NA'}" + ("\t1" if extra else "") for i in range(cells)]
    (folder / f"{name}_cell.txt").write_text("\n".join([head1, head2, *rows]) + "\n")
    (folder / f"{name}_Image.txt").write_text("ImageNumber\tMetadata_plate\tAreaOccupied_cell\n1\tP1\t5.5\n")
    (folder / f"{name}_Object relationships.txt").write_text("First Image Number\tFirst Object Number\tSecond Image Number\tSecond Object Number\n1\t1\t1\t2\n")


def test_plain_filesets(spark, tmp_path):
    for i, (cells, extra) in enumerate([(3, ""), (1, ""), (4, ""), (2, "More")]):
        fileset_a(tmp_path, f"f{i}", cells, extra)
    with pytest.warns(UserWarning, match="other columns"):
        out = cellprofiler.read_cellprofiler_dir(spark, str(tmp_path), skip_orl=False)
    cells = out["cells"].toPandas()
    assert len(cells) == 7  # a fileset with one cell counts as empty, one has another column
    assert set(cells["cell_ObjectNumber_Global"]) == {"FS1_I1_O1", "FS1_I1_O2", "FS1_I1_O3", *(f"FS3_I1_O{i}" for i in range(1, 5))}
    assert sorted(cells["cell_Area_Size"].dropna()) == [1.5, 1.5, 3.0, 3.0, 4.5]
    assert out["orl"].select("Second_ObjectNumber_Global").first()[0] == "FS1_I1_O2"
    assert {r.id: r.category for r in out["features"].collect()}["cell_Area_Size"] == "Area"
    d = dataset_from_list(out)
    assert d.assay().feature_names == ["cell_Area_Size"] and d.image_assays["image.data"].columns == ["image_id", "AreaOccupied_cell"]
    with pytest.warns(UserWarning):
        assert cellprofiler.read_cellprofiler_dir(spark, str(tmp_path), max_per_well=3)["cells"].count() == 3
    with pytest.raises(ValueError):
        cellprofiler.read_cellprofiler_dir(spark, str(tmp_path), n=[1])


def test_zipped_fileset(spark, tmp_path):
    path = tmp_path / "w1.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("features/w1_cell.txt", "ImageNumber\tObjectNumber\tArea\n1\t1\t10\n1\t2\t20\n1\t3\t30\n")
        z.writestr("features/w1_Image.txt", "ImageNumber\tMetadata_well\n1\tA01\n")
        z.writestr("features/w1_Experiment.txt", "Key\tValue\na\tb\n")
        z.writestr("features/w1_mito.txt", "ImageNumber\tObjectNumber\tParent_cell\tLen\tGap\n1\t1\t1\t2\t1\n1\t2\t1\t4\tNA\n1\t3\t0\t99\t1\n1\t4\t2\t6\t5\n1\t5\t9\t1\t1\n")
        z.writestr("features/w1_spot.txt", "ImageNumber\tObjectNumber\tParent_cell\tLen\n")
    out = cellprofiler.read_cellprofiler_fileset_b(spark, str(path), 2)
    got = {r.cell_ObjectNumber: r for r in out["cells"].collect()}
    assert [got[i].mito_Len for i in (1, 2, 3)] == [3.0, 6.0, None] and got[1].mito_QC_Object_Count == 2
    assert got[1].mito_Gap is None and got[2].mito_Gap == 5.0 and got[1].spot_Len is None
    assert got[2].cell_ObjectNumber_Global == "FS2_I1_O2"
    assert {r.cell_ObjectNumber: r.mito_Gap for r in cellprofiler.read_cellprofiler_fileset_b(spark, str(path), na_rm=True)["cells"].collect()}[1] == 1.0
    loose = cellprofiler.read_cellprofiler_fileset_b(spark, str(path), merging_strategy="none")
    assert loose["children"]["mito"].count() == 5 and "mito_Len" not in loose["cells"].columns


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    stacks = {}
    for plate, row, column, field in (("P1", "A", "1", "f1"), ("P1", "B", "12", "f1"), ("P2", "A", "3", "f2")):
        folder = tmp_path / plate / row / column
        folder.mkdir(parents=True)
        stacks[f"{plate}:{row}{int(column):02d}:{field}"] = x = rng.uniform(size=(30, 40, 2, 3))
        with (folder / f"{field}.ome.tiff").open("wb") as f:
            np.save(f, x)
    index = images.build_img_index(spark, str(tmp_path))
    assert {r.key for r in index.collect()} == set(stacks) and images.build_img_index(spark, str(tmp_path), ["P2"]).count() == 1
    places = spark.createDataFrame([("o1", 10.0, 5.0, "P1:A01:f1"), ("o2", 39.0, 29.0, "P1:A01:f1"), ("o3", 20.0, 15.0, "P2:A03:f2"), ("o4", 1.0, 1.0, "none")], "object_id string, x double, y double, key string")
    got = {r[OBJECT]: image.to_array(r.dims, r.data) for r in images.read_imgs(places, index, 4).collect()}
    assert set(got) == {"o1", "o2", "o3"}
    assert np.array_equal(got["o1"], stacks["P1:A01:f1"][1:10, 6:15]) and got["o2"].shape == (5, 5, 2, 3)
    flat = {r[OBJECT]: r.dims for r in images.read_imgs(places, index, 4, channels=[1], max_project=True).collect()}
    assert flat["o1"] == [9, 9, 1]
    move = np.array([[1.0, 0, 2], [0, 1, 1], [0, 0, 1]])
    matrices = spark.createDataFrame([(k, move.tolist()) for k in stacks], "key string, matrix array<array<double>>")
    both = {r[OBJECT]: image.to_array(r.dims, r.data) for r in images.read_imgs(places, index, 4, further=[(index, matrices)]).collect()}
    assert np.array_equal(both["o1"][:, :, 2:], stacks["P1:A01:f1"][0:9, 4:13])
    (tmp_path / "m.bin").write_bytes(images.binmat_bytes(move))
    assert images.read_binmat(spark, str(tmp_path / "m.bin")).first().matrix == move.tolist()
    with pytest.raises(ValueError):
        images.parse_binmat(images.binmat_bytes(move)[:-1])


def test_report(spark, tmp_path):
    text = report.log_state({"n": 3, "table": spark.range(50), "frame": pd.DataFrame({"a": [1]}), "list": list(range(30)), "map": {"k": 1}}, str(tmp_path / "log.txt"), 5)
    assert "== table" in text and "  ..." in text and (tmp_path / "log.txt").read_text() == text
    with pytest.raises(ValueError):
        report.log_state({"": 1}, str(tmp_path / "x"))


def test_streams(spark, tmp_path):
    rows = [(str(i), float(i), "a" if i % 2 else "b") for i in range(40)]
    batch = spark.createDataFrame(rows, "object_id string, v double, g string")
    batch.write.parquet(str(tmp_path / "in"))
    stats = stateless.freeze(batch, ["v"], "g").persist()
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    scaled = stateless.scaled(stateless.passing(stream, [FilterSpec("low", "^v$", "filter_vec_min", 10)], OBJECT), stats, ["v"], "g")
    query = stateless.transformed(scaled, {}).writeStream.format("memory").queryName("scaled_cells").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("scaled_cells")
    assert got.count() == 30
    spread = batch.filter("g = 'a'").agg(F.avg("v"), F.stddev_samp("v")).first()
    assert np.isclose(got.filter("object_id = '39'").first().v, (39 - spread[0]) / spread[1])
