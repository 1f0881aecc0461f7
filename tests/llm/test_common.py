"""The shared folder."""

from spanloom.llm import common


def test_shared_folder_is_qualified(spark):
    """A setting without a scheme means the default file system, whichever that is."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    default = hadoop.get("fs.defaultFS")
    assert common.qualified(spark, "/tmp/x/") == "file:/tmp/x" and common.shared_dir(spark).startswith("file:/")
    try:
        hadoop.set("fs.viewfs.mounttable.other.link./tmp", "file:///tmp")
        hadoop.set("fs.defaultFS", "viewfs://other/")  # a default that is not local
        assert common.qualified(spark, "/tmp/x/") == "viewfs://other/tmp/x" and common.qualified(spark, "file:///tmp/x") == "file:/tmp/x"
    finally:
        hadoop.set("fs.defaultFS", default)


def test_staged_tables_are_read_back(spark):
    df = common.staged(spark.range(5).toDF("x"), "part")
    assert sorted(r["x"] for r in df.collect()) == [0, 1, 2, 3, 4] and all("part-" in f for f in df.inputFiles())
    common.discard(df)
