"""The manifest names a table that is a folder of part files once, as its SQL does."""

from pathlib import Path

from ledgerloom.plans import load_queries

FOLDER = Path("/root/testdata/sf0.001")


def test_a_folder_of_part_files_is_one_file(spark, tmp_path):
    for f in FOLDER.glob("*.parquet"):
        if f.stem not in ("orders", "nation"):
            (tmp_path / f.name).symlink_to(f)
    orders, nation = spark.read.parquet(str(FOLDER / "orders.parquet")), spark.read.parquet(str(FOLDER / "nation.parquet"))
    orders.repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    nation.limit(0).write.parquet(str(tmp_path / "nation.parquet"))
    got = {r.file_name: r for r in load_queries()["file_manifest"](spark, str(tmp_path)).collect()}
    assert len(got) == 14 and got["orders.parquet"].rows == orders.count()
    assert got["nation.parquet"].rows == 0 and got["nation.parquet"].score is None
