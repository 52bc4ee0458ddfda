import pytest
from pyspark.sql import functions as F

from screenloom import cli
from screenloom.operators import model_io, validate
from screenloom.sources import readers, sinks


def test_evaluate_and_hierarchy(spark, tmp_path):
    gt = spark.createDataFrame([("a", i, 10 * i, 0, 9, 9, "Text", "t") for i in range(3)], "screen_id string, seq long, x int, y int, w int, h int, label string, text string").withColumn("score", F.lit(None).cast("double"))
    path, out = str(tmp_path / "gt"), str(tmp_path / "out")
    gt.write.parquet(path)
    cli.main(["evaluate", "--in", path, "--predictions", path, "--out", out])
    got = {r.metric: r.value for r in spark.read.parquet(out).collect()}
    assert got == {"page_iou": 1, "page_recall": 1, "label_page_iou": 1, "map": 1, "recall_label": 1, "recall_any": 1, "ned": 0}
    gt.withColumn("klass", F.col("label")).write.mode("overwrite").parquet(path + "2")
    cli.main(["hierarchy", "--in", path + "2", "--out", out])
    assert {r.parent for r in spark.read.parquet(out).collect()} == {None}


def test_models_on_data_sets(spark, tmp_path):
    gt = spark.createDataFrame([("a", i, 10 * i, 0, 9, 9, "Text", "t") for i in range(4)], "screen_id string, seq long, x int, y int, w int, h int, label string, text string").withColumn("score", F.lit(1.0))
    for name, least in (("one", 0), ("two", 2)):
        gt.where(f"seq >= {least}").write.parquet(str(tmp_path / f"gt_{name}"))
        gt.write.parquet(str(tmp_path / f"all_{name}"))
        gt.where("seq < 3").write.parquet(str(tmp_path / f"some_{name}"))
    out = str(tmp_path / "out")
    args = ["evaluate", "--in", *(f"{n}={tmp_path}/gt_{n}" for n in ("one", "two")), "--predictions", f"all={tmp_path}/all_{{dataset}}", f"some={tmp_path}/some_{{dataset}}", "--out", out, "--metrics", "recall", "f1", "recall_nolabel"]
    with pytest.warns(UserWarning, match="f1"):
        cli.main(args)
    got = {(r.dataset, r.model, r.metric): r.value for r in spark.read.parquet(out).collect()}
    assert got == {(d, m, x): v for d, m, v in (("one", "all", 1), ("one", "some", 0.75), ("two", "all", 1), ("two", "some", 0.5)) for x in ("recall_label", "recall_any")}
    assert cli.named(["a=/x/y", "/p/q=r/"]) == [("a", "/x/y"), ("q=r", "/p/q=r/")]
    with pytest.raises(SystemExit):
        cli.named(["/x/a", "/y/a"])


def test_configs(spark):
    rows = [("none", None), ("empty", ""), ("quoted", '"path": \'/d/\'\ntrain: "t"\nval: v\ntest: w # x\nnc: 1\nnames: [a]'), ("json", '{"path": "/d", "train": "t", "nested": {"nc": 1}}')]
    there = spark.createDataFrame([("/d/t",), ("/d/v",)], "p string")
    got = {r.path: (r.missing, r.absent, r.valid) for r in validate.configs(spark.createDataFrame(rows, "path string, text string"), there).collect()}
    every = list(validate.CONFIG_KEYS)
    assert got == {"none": (every, [], False), "empty": (every, [], False), "quoted": ([], ["/d/w"], True), "json": (["val", "nc", "names"], [], False)}
    assert validate.configs(spark.createDataFrame([], "path string, text string"), there).count() == 0


def test_crops_and_run_ids(spark):
    box = lambda x, y, w, h, s=1.0: tuple(spark.range(1).select(model_io.crop_of(*map(F.lit, (x, y, w, h, 100, 50)), s).alias("c")).first().c or ())
    assert box(-5, 3, 20, 10) == (0, 3, 20, 10) and box(90, 45, 20, 10) == (90, 45, 10, 5)
    assert box(100, 0, 5, 5) == box(0, 0, 0, 5) == box(0, 60, 5, 5) == () and box(1, 3, 5, 7, 0.5) == (0, 2, 2, 4)
    run = lambda names: spark.range(1).select(sinks.run_id(F.lit(names).cast("array<string>") if names is None else F.array(*map(F.lit, names)), F.lit(9), sinks.dataset_token(F.lit("/a/Some Set!/"), "raw", tag=F.lit("Nightly run")), F.lit("c55"))).first()[0]
    assert run(None) == "m0-model_n9_ds-raw-some-set-nightly-_map-c55"
    assert run(["A b", "", "é"]) == "m3-a-b+unknown_n9_ds-raw-some-set-nightly-_map-c55" and "_n9" in run(list("abcdefg")) and run(list("abcdefg")).startswith("m7-a+b+c+d+e+2_")


def test_class_config():
    assert readers.class_config("a\n\n b ") == ["a", "b"] and readers.class_config('["x"]') == ["x"]
    assert readers.class_config('{"categories": [{"id": 2, "name": "q"}, {"id": 1, "name": "p"}]}') == ["p", "q"] and readers.class_config('{"classes": ["z"]}') == ["z"]


def test_class_config_yaml():
    pytest.importorskip("yaml")
    assert readers.class_config("# x\n- a b\n- 3\n") == ["a b", "3"] and readers.class_config("classes:\n  - q\n  - r\n") == ["q", "r"]
    assert readers.class_config("a: b\nc") == ["a: b", "c"]
