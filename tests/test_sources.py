import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ozalid.plans import pipeline
from ozalid.sources import formats, images, tables
from ozalid.streaming import predict as stream

HEADER = "query_id,image,question,choice_A,choice_B,choice_C,choice_D,more\r\n"


def test_metadata_csv(spark, tmp_path):
    body = 'q1, a.png ,"What\x92s ""this""\nhere",yes, no ,,  ,x\r\nq2,,,a,b,c,d,\r\n'
    (tmp_path / "dev_metadata.csv").write_bytes((HEADER + body).encode("latin-1"))
    rows = {r["query_id"]: r for r in tables.read_metadata(spark, str(tmp_path)).collect()}
    assert rows["q1"]["image"] == "a.png" and rows["q1"]["question"] == 'What’s "this"\nhere'
    assert [(c["letter"], c["text"]) for c in rows["q1"]["choices"]] == [("A", "yes"), ("B", "no")]
    assert rows["q2"]["image"] is None and len(rows["q2"]["choices"]) == 4
    with pytest.raises(FileNotFoundError):
        tables.read_metadata(spark, str(tmp_path / "none"))


def test_items_in_three_layouts(spark, tmp_path):
    folder = tmp_path / "QA_information" / "Open-access"
    folder.mkdir(parents=True)
    items = [{"question_id": f"i{n}", "question": "q", "option_A": "x", "other": 1} for n in range(3)]
    (folder / "a.json").write_text(json.dumps(items))
    (folder / "b.json").write_text("\n " + json.dumps(items, indent=2))
    (folder / "c.json").write_text("\n\n".join(json.dumps(i) for i in items) + "\n")
    assert tables.list_datasets(spark, str(tmp_path)) == ["a", "b", "c"]
    df, missing = tables.read_datasets(spark, str(tmp_path), ["a", "b", "c", "d"])
    assert missing == ["d"] and {(r["dataset"], r["n"]) for r in df.groupBy("dataset").agg(F.count("*").alias("n")).collect()} == {("a", 3), ("b", 3), ("c", 3)}
    assert df.first()["gt_answer"] is None
    with pytest.raises(FileNotFoundError):
        tables.read_datasets(spark, str(tmp_path), ["d"])
    with pytest.raises(FileNotFoundError):
        tables.require_root(spark, str(tmp_path / "none"))


def touch(root, *names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")


def test_adapters(spark, tmp_path):
    ct, flat, cases, us = (tmp_path / k for k in ("ct", "flat", "cases", "us"))
    touch(ct, "studies/CT-1/a.nii.gz", "ct_3/x.nii", "other/y.nii", "CT-0/note.txt")
    touch(flat, "imagesTr/B1.nii.gz", "imagesTr/._junk.nii.gz", "imagesTs/B2.nii.gz")
    touch(cases, "P1/P1_flair.nii", "P1/P1_a.nii", "P1/P1_seg.nii", "P2/P2_t1.nii")
    touch(us, "Benign/b (1).png", "Benign/b (1)_mask.png", "malignant/m.png", "normal/n.png", "odd/o.png")
    assert sorted(r["letter"] for r in tables.graded_scans(tables._names(spark, str(ct))).collect()) == ["B", "D"]
    assert tables.brain_scans(tables._names(spark, str(flat))).count() == 1
    assert sorted(r["path"].rsplit("/", 1)[1] for r in tables.brain_scans(tables._names(spark, str(cases))).collect()) == ["P1_flair.nii", "P2_t1.nii"]
    got = tables.prepare_items(spark, "BUSI", str(us)).collect()
    assert sorted(r["question_id"] for r in got) == ["BUSI_00000", "BUSI_00001", "BUSI_00002"]
    assert {r["split"] for r in got} == {"train", "eval"} and {r["option_D"] for r in got} == {None}
    assert {r["gt_answer"] for r in got} == set(tables.BREAST_OPTIONS)
    tables.write_items(tables.prepare_items(spark, "BUSI", str(us)), str(tmp_path / "out"))
    again = tables.read_items(spark, [str(tmp_path / "out" / "split=train"), str(tmp_path / "out" / "split=eval")])
    assert again.count() == 3
    tables.write_split_files(tables.prepare_items(spark, "BUSI", str(us)), str(tmp_path / "files"), "BUSI")
    assert sorted(p.name for p in (tmp_path / "files").glob("*.json")) == ["BUSI_eval.json", "BUSI_train.json"]
    assert tables.read_items(spark, [str(tmp_path / "files" / "BUSI_train.json"), str(tmp_path / "files" / "BUSI_eval.json")]).filter("gt_answer IS NOT NULL").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q1", None, "B", True, 0.5, "radiology", None, 4, False, "", 1.0, None, None)], "query_id string, answer string, gold string, correct boolean, inference_time double, predicted_modality string, predicted_intent string, n_choices int, fallback_triggered boolean, fallback_reason string, top1_logit double, top2_logit double, logit_margin double")
    tables.write_csv(tables.submission(df), str(tmp_path / "s"), single=True)
    assert (tmp_path / "s").read_bytes() == b"query_id,answer,inference_time\r\nq1,A,0.5000\r\n"
    tables.write_csv(tables.diagnostic(df), str(tmp_path / "d"), single=True)
    assert (tmp_path / "d").read_bytes().split(b"\r\n")[1] == b"q1,,B,True,0.5,radiology,,4,False,,1.0,,"


def gray(n):
    return (np.arange(64 * 64).reshape(64, 64) * n % 251).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    files = {"a.png": formats.write_png(gray(3)), "broken.png": b"junk", "v.nii": formats.write_nifti(np.random.default_rng(1).random((8, 9, 20)).astype(np.float32)), "one.dcm": formats.write_dicom(gray(7)), "noname": formats.write_dicom(gray(5)), "readme.txt": b"text"}
    files |= {f"series/s{n}.dcm": formats.write_dicom(gray(n + 1).astype(np.uint16), number=n) for n in range(4)}
    files |= {"ch/x_red.png": formats.write_png(gray(2)), "ch/x_green (1).png": formats.write_png(gray(4))}
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)


def test_pictures(spark, folder):
    got = {r["sample"].rsplit("/", 1)[1]: r for r in images.pictures(spark, folder).collect()}
    assert set(got) == {"a.png", "broken.png", "v.nii", "one.dcm", "noname", "series", "ch"}
    assert got["broken.png"]["data"] is None and "DecodeError" in got["broken.png"]["load_error"]
    sizes = {k: (r["height"], r["width"]) for k, r in got.items() if r["data"] is not None}
    assert sizes == {"a.png": (64, 64), "v.nii": (8, 27), "one.dcm": (64, 64), "noname": (64, 64), "series": (64, 192), "ch": (908, 908)}


def test_pipeline_keeps_every_query(spark, folder):
    prepared = pipeline.prepared(images.pictures(spark, folder)).withColumn("sample", F.element_at(F.split("sample", "/"), -1))
    c = lambda *t: [(k, v) for k, v in zip("ABCD", t, strict=False)]
    rows = [("1", "a.png", "grade?", c("x", "y")), ("2", "broken.png", "q", c("x", "y")), ("3", None, None, c("x", "y")), ("4", "a.png", "q", c("x", "y", "z")), ("5", "v.nii", "q", c("w", "x", "y", "z"))]
    queries = spark.createDataFrame(rows, "query_id string, sample string, question string, choices array<struct<letter:string,text:string>>")

    def scorer(df, pictures):
        each = df.select("query_id", F.explode("choices").alias("c"))
        return each.select("query_id", "c.letter", F.lit("v").alias("variant"), F.ascii("c.letter").cast("double").alias("logit"), F.when(F.col("query_id") == "5", 9.0).otherwise(1.0).alias("seconds"))

    got = {r["query_id"]: (r["answer"], r["fallback_reason"]) for r in pipeline.predict(queries, prepared, scorer).collect()}
    assert got == {"1": ("B", ""), "2": ("B", "image_load_failed"), "3": ("B", "image_load_failed"), "4": ("A", "malformed_choices"), "5": ("A", "inference_timeout")}
    full = {r["query_id"]: r for r in pipeline.predict(queries, prepared, scorer).collect()}
    assert full["4"]["predicted_modality"] is None and full["4"]["predicted_intent"] is None and full["4"]["n_choices"] == 3
    assert full["5"]["top1_logit"] is None and full["5"]["predicted_modality"] is not None and full["3"]["predicted_modality"] is not None
    calls = []
    first = {r["query_id"]: r["answer"] for r in pipeline.predict_letters(queries, prepared, lambda df, p: (calls.append(df), scorer(df, p))[1]).collect()}
    assert first == {"1": "B", "2": "A", "3": "A", "4": "A", "5": "A"} and [sorted(r["query_id"] for r in c.collect()) for c in calls] == [["1", "5"]]
    log = pipeline.evaluate(pipeline.predict(queries, prepared, scorer), queries.select("query_id", F.lit("B").alias("gt_answer"), "choices"))
    assert log.filter("correct").count() == 3


def test_stream(spark, tmp_path, sf):
    src = tmp_path / "in"
    d = spark.read.parquet(f"{sf}/dev_metadata.parquet").select("query_id", "image", "question", *[f"choice_{k}" for k in "ABCD"], "loaded_at")
    d.repartition(3).write.parquet(str(src))
    df = stream.queries_stream(spark, str(src))
    answer = lambda b: b.select("query_id", F.lit("A").alias("answer"), F.lit(0.5).alias("inference_time"))
    stream.run(df, answer, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == d.select("query_id").distinct().count() == got.select("query_id").distinct().count()


def test_canvas_that_fails(spark, monkeypatch):
    """What fails on the gray canvas, too, gets the fallback letter and nothing else."""
    data = bytes(8 * 8 * 3)
    pictures = spark.createDataFrame([("p", 8, 8, data, None), ("gone", None, None, None, "no file")], f"sample string, {images.PICTURE}")
    rows = pipeline.prepared(pictures, {"no such option": 1}).collect()
    assert all(r["stream"] is not None for r in rows)
    failed = spark.createDataFrame([("p", None, None, None, None, None, None, "stage"), ("gone", None, None, None, None, None, "no file", None)], "sample string, stream string, subtype string, height int, width int, data binary, load_error string, stage_error string")
    queries = spark.createDataFrame([(n, n, "q", [("A", "x"), ("B", "y")]) for n in ("p", "gone")], "query_id string, sample string, question string, choices array<struct<letter:string,text:string>>")

    def scorer(df, pictures):
        return df.select("query_id", F.lit("B").alias("letter"), F.lit("v").alias("variant"), F.lit(1.0).alias("logit"))

    got = pipeline.predict(queries, failed, scorer).collect()
    assert {(r["answer"], r["fallback_reason"], r["predicted_modality"], r["top1_logit"]) for r in got} == {("A", "pipeline_failed_on_gray_canvas", None, None)}
