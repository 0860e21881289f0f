import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.operators import annotations as an
from tallymark.operators.fingerprint import combined_fingerprint, tree_fingerprint
from tallymark.operators.validation import missing_paths
from tallymark.sources import annotations, files, logs, manifests, receipts, sinks
from tallymark.sources import lines as lines_source


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


GOOD = '{"id":"a","path":"p","label":1,"origin":"script","identity_a":"ignored"}'


def test_manifest_modes(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", f"\n// note\n  {GOOD}  \n{{broken\n")
    lenient = manifests.manifest_read(spark, path, schemas.FORGERY_MANIFEST, "lenient").collect()
    assert [r.id for r in lenient] == ["a"] and lenient[0].manifest.endswith("m.jsonl")
    with pytest.raises(manifests.ManifestError, match="broken"):
        manifests.manifest_read(spark, path, schemas.FORGERY_MANIFEST)
    clean = write(tmp_path / "c.jsonl", GOOD)
    assert manifests.manifest_read(spark, clean, schemas.FORGERY_MANIFEST).count() == 1
    with pytest.raises(AnalysisException):
        manifests.manifest_read(spark, str(tmp_path / "absent.jsonl"), schemas.FORGERY_MANIFEST)


def test_manifest_nested_values(spark, tmp_path):
    row = {"id": "r", "path": "p", "profiles": {"github": "g"}, "gt_discrepancies": [{"field": "skills"}],
           "anchors": {"github_login": "g", "public_repos": 3, "repo_names": ["x"], "llm_used": False}}
    path = write(tmp_path / "r.jsonl", json.dumps(row))
    got = manifests.manifest_read(spark, path, schemas.RESUME_MANIFEST).first()
    assert got.anchors.public_repos == 3 and got.gt_discrepancies == [{"field": "skills"}]
    ocr = {"id": "o", "path": "p", "doc_type": "alb_id", "gt_text": "", "gt_fields": {"n": "1", "obj": {"k": 1}}}
    path = write(tmp_path / "o.jsonl", json.dumps(ocr))
    got = manifests.manifest_read(spark, path, schemas.OCR_MANIFEST).first()
    assert got.gt_fields == {"n": "1", "obj": '{"k":1}'}


def test_manifest_round_trip(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", GOOD)
    df = manifests.manifest_read(spark, path, schemas.FORGERY_MANIFEST).drop("manifest")
    manifests.manifest_write(df, str(tmp_path / "out"))
    again = manifests.manifest_read(spark, str(tmp_path / "out"), schemas.FORGERY_MANIFEST).drop("manifest")
    assert again.collect() == df.collect()


def test_inventory_and_missing_paths(spark, tmp_path):
    root = tmp_path / "data"
    for name in ("img/a.JPG", "img/b.png", "masks/m.png", "images_pre_holdout/o.png", "_holdout_x/h.png", "img/c.txt"):
        write(root / name, name)
    found = files.file_inventory(spark, str(root))
    assert {r.rel_path for r in found.collect()} == {"img/a.JPG", "img/b.png"}
    assert "content" not in found.columns
    everything = files.file_inventory(spark, str(root), exclude_masks=False)
    manifest = spark.createDataFrame(
        [("1", "img/a.JPG", "masks/m.png"), ("2", "img/zz.png", None)], "id string, path string, mask_path string"
    )
    gone = missing_paths(manifest, everything, ["path", "mask_path"]).collect()
    assert [(r.id, r.column, r.path) for r in gone] == [("2", "path", "img/zz.png")]


def test_digests_checksums_and_tree_fingerprint(spark, tmp_path):
    root = tmp_path / "data"
    contents = {"a.txt": "alpha", "sub/b.txt": "beta"}
    for name, text in contents.items():
        write(root / name, text)
    digests = files.file_digests(spark, str(root))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    level = {}
    for name, text in sorted(contents.items()):
        prefix = hashlib.md5(name.encode()).hexdigest()[:8]
        level.setdefault(prefix, []).append(f"{name}\0{sha(text)}\0")
    for digits in (6, 4, 2, 0):
        above = {}
        for prefix, entries in sorted(level.items()):
            above.setdefault(prefix[:digits], []).append(f"{prefix}\0{sha(''.join(entries))}\0")
        level = above
    line = sha("".join(level[""]))
    tree = tree_fingerprint(digests)
    assert tree.first().fingerprint == line
    both = combined_fingerprint([("x", tree), ("y", tree)]).first()[0]
    assert both == hashlib.sha256(f"x:{line}\ny:{line}".encode()).hexdigest()

    md5 = hashlib.md5(b"alpha").hexdigest()
    catalog = write(tmp_path / "md5.txt", f"# list\n{md5.upper()} *a.txt\n{'0' * 32}  sub/b.txt\nshort x\n\n")
    checked = files.checksum_verify(
        digests.withColumnRenamed("rel_path", "name"), files.checksum_catalog_read(spark, catalog)
    )
    assert {r.name: r.status for r in checked.collect()} == {"a.txt": "ok", "sub/b.txt": "mismatch"}


def test_latency_log(spark, tmp_path):
    text = (
        "timeStamp,elapsed,label,success,Latency\n"
        "1,100,x,true,7\n2,,x,FALSE,50\n3,abc,x,true,9\n4,,x,1,\n5,30,x,,9\n"
    )
    rows = logs.latency_log_read(spark, write(tmp_path / "a.jtl", text)).collect()
    assert [(r.ts_ms, r.elapsed_ms, r.success) for r in rows] == [
        (1, 100.0, True), (2, 50.0, False), (5, 30.0, False),
    ]
    rows = logs.latency_log_read(spark, write(tmp_path / "b.jtl", "elapsed_ms\n12.5\n")).collect()
    assert [(r.elapsed_ms, r.success) for r in rows] == [(12.5, True)]


def test_results_and_requests(spark, tmp_path):
    assert logs.results_read(spark, str(tmp_path / "none.json")) is None
    summary = spark.createDataFrame([("cer", 0.1, True)], "task string, value double, passed boolean")
    items = spark.range(3)
    sinks.result_json_write(summary, items, str(tmp_path / "r"))
    back = logs.results_read(spark, str(tmp_path / "r" / "summary")).first()
    assert (back.task, back.value, back.passed, back.infeasible) == ("cer", 0.1, True, None)
    assert spark.read.parquet(str(tmp_path / "r" / "items")).count() == 3
    manifest = spark.createDataFrame([("a", "x/y.pdf")], "id string, path string")
    sinks.request_csv_export(manifest, str(tmp_path / "q"), "/data/")
    sent = spark.read.option("header", "true").csv(str(tmp_path / "q"))
    assert sent.columns == ["id", "filepath"] and sent.first().filepath == "/data/x/y.pdf"


def test_annotation_files_in_both_layouts(spark, tmp_path):
    def region(shape, attrs):
        return {"shape_attributes": shape, "region_attributes": attrs}

    face = region({"name": "polygon", "all_points_x": [5, 1, 9], "all_points_y": [2, 8, 4]}, {"field_name": "face"})
    name = region({"name": "rect", "x": 1, "y": 1, "width": 2, "height": 2}, {"name": "surname", "value": "Doe"})
    photo = region({"name": "rect", "x": 0, "y": 0, "width": 9, "height": 9}, {"name": "photo", "value": "p"})
    project = {"_via_img_metadata": {
        "k1": {"filename": "00.jpg", "regions": [photo, face, name]},
        "k2": {"filename": "01.jpg", "regions": [name]},
    }}
    write(tmp_path / "ann" / "code.json", json.dumps(project, indent=1))
    write(tmp_path / "ann" / "single.json", json.dumps({"filename": "07.jpg", "regions": [face]}))
    regions = annotations.annotation_read(spark, str(tmp_path / "ann"))
    assert regions.count() == 5
    assert {(r.file, r.n) for r in regions.groupBy("file").count().withColumnRenamed("count", "n").collect()} == {
        ("00.jpg", 3), ("01.jpg", 1), ("07.jpg", 1),
    }
    path = [r.annotation for r in regions.select("annotation").distinct().collect() if "code" in r.annotation][0]
    images = spark.createDataFrame(
        [(path, "code", "00", "00.tif"), (path, "code", "01", "01.tif"), (path, "code", "99", "99.tif")],
        "annotation string, code string, idx string, filename string",
    )
    fields = {r.idx: r.fields for r in an.image_fields(regions, images).collect()}
    # 99 has no entry: the whole file's fields are its own.
    assert fields == {"00": {"surname": "Doe"}, "01": {"surname": "Doe"}, "99": {"surname": "Doe"}}
    boxes = {r.idx: r.face_box for r in an.image_face_boxes(regions, images).collect()}
    assert boxes == {"00": [1, 2, 9, 7], "99": [1, 2, 9, 7]}


def test_image_joins_gather_no_side_in_the_driver(spark):
    """Small by the size of its files, an image list may hold many rows: no join broadcasts it."""
    entry, one = F.col("id").cast("int").alias("entry"), F.expr("concat('f', id div 100)").alias("annotation")
    regions = spark.range(3).select(
        one, entry, F.format_string("%d.jpg", "id").alias("file"), F.lit(0).alias("ordinal"),
        F.lit(None).cast("string").alias("shape"), F.create_map(F.lit("name"), F.lit("n"), F.lit("value"), entry.cast("string")).alias("attrs"),
    )
    images = spark.range(1, 10, 8).select(
        one, F.lit("c").alias("code"), F.col("id").cast("string").alias("idx"), F.lit("x").alias("filename")
    )
    built = an.image_fields(regions, images)
    assert "Broadcast" not in built._jdf.queryExecution().executedPlan().toString()
    assert {r.idx: r.fields for r in built.collect()} == {"1": {"n": "1"}, "9": {"n": "2"}}


def test_annotation_oddities(spark, tmp_path):
    """Entries keep the file's order, other fields and kinds do no harm, broken files give no rows."""
    text = json.dumps({"_via_settings": {"x": [1]}, "_via_img_metadata": {
        "z": {"filename": "9.jpg", "size": 3, "regions": [
            {"shape_attributes": {"name": "circle", "cx": 1, "r": "two"}, "region_attributes": {"name": "n", "value": 5}},
            {"region_attributes": None, "extra": {"deep": [1, {"a": None}]}},
        ], "file_attributes": {"note": "é"}},
        "a": {"filename": "9x.jpg", "regions": []},
        "m": {"filename": None, "regions": {"not": "a list"}},
    }})
    write(tmp_path / "ann" / "odd.json", text)
    write(tmp_path / "ann" / "broken.json", '{"_via_img_metadata": ')
    write(tmp_path / "ann" / "empty.json", "")
    write(tmp_path / "ann" / "none.json", "{}")
    rows = annotations.annotation_read(spark, str(tmp_path / "ann"))
    odd = rows.where("annotation LIKE '%odd.json'").orderBy("entry", "ordinal").collect()
    assert [(r.entry, r.file, r.ordinal) for r in odd] == [
        (0, "9.jpg", 0), (0, "9.jpg", 1), (1, "9x.jpg", None), (2, None, None),
    ]
    assert odd[0].attrs == {"name": "n", "value": "5"} and odd[0].shape.name == "circle" and odd[1].attrs == {}
    assert rows.where("annotation NOT LIKE '%odd.json' AND ordinal IS NOT NULL").isEmpty()


def test_no_rows_of_images_times_regions(spark):
    """A file of many regions that many images share: images join one summary of it."""
    regions = spark.range(300).selectExpr(
        "if(id < 0, 'g', 'f') AS annotation", "0 AS entry", "'other.jpg' AS file", "int(id) AS ordinal",
        "cast(null AS struct<name: string>) AS shape", "map('name', 'n' || id % 5, 'value', string(id)) AS attrs",
    )
    images = spark.range(200).selectExpr("if(id < 0, 'g', 'f') AS annotation", "'c' AS code", "'i' || id AS idx", "'x' AS filename")
    found = an.image_fields(regions, images)
    rows = found.collect()
    assert len(rows) == 200 and {r.fields["n4"] for r in rows} == {"299"}
    metrics = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in metrics and "BroadcastNestedLoopJoin" not in metrics


def test_receipts(spark, tmp_path):
    lines = spark.range(100).select(F.concat(F.lit("línea "), F.col("id").cast("string")).alias("l")).repartition(4)
    path = str(tmp_path / "out")
    receipts.write_lines(lines, path, "txt", header="head")
    files_told = receipts.read_receipt(spark, path).orderBy("name").collect()
    assert [r.name for r in files_told] == [f"part-0000{i}.txt" for i in range(4)] and sum(r.rows for r in files_told) == 100
    for told in files_told:
        data = (tmp_path / "out" / told.name).read_bytes()
        assert (told.length, told.sha256) == (len(data), hashlib.sha256(data).hexdigest()) and data.startswith(b"head\n")
    with pytest.raises(receipts.WrittenBefore):
        receipts.write_lines(lines, path)
    (tmp_path / "out" / "part-00001.txt").write_text("changed")
    (tmp_path / "out" / "part-00002.txt").unlink()
    write(tmp_path / "out" / "other.txt", "x")
    assert {r.name: r.status for r in receipts.verify_receipt(spark, path).collect()} == {
        "part-00000.txt": "ok", "part-00001.txt": "mismatch", "part-00002.txt": "missing",
        "part-00003.txt": "ok", "other.txt": "extra",
    }
    receipts.write_lines(lines.limit(3).coalesce(1), path, mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["_receipt.json", "part-00000.txt"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    receipts.write_lines(spark.range(3).coalesce(1), path)
    before = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    value = F.when(F.col("id") == 399, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("id").cast("string"))
    broken = spark.range(400).repartition(4).select(value.alias("v"))
    with pytest.raises(Exception, match="broken row"):
        receipts.write_lines(broken, path, mode="overwrite")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == before
    with pytest.raises(Exception, match="broken row"):
        receipts.write_lines(broken, str(tmp_path / "new"))
    assert receipts.read_receipt(spark, str(tmp_path / "new")).isEmpty()
    assert not [p for p in (tmp_path / "new").rglob("*") if p.is_file()]


def test_rejected_lines(spark, tmp_path):
    text = "timeStamp,elapsed,label,success\n1,100,x,true\n2,,x,true\n3,abc,x,true\n4,50\n5,,x,true,9,9\n"
    path = write(tmp_path / "a.jtl", text)
    assert [r.elapsed_ms for r in logs.latency_log_read(spark, path).orderBy("ts_ms").collect()] == [100.0, 50.0]
    rejects = {(r.reason, r.text) for r in logs.latency_log_rejects(spark, path).collect()}
    assert rejects == {("no value", '2,,x,true'), ("not a number", "3,abc,x,true"), ("wrong columns", "5,,x,true,9,9")}
    good = '{"task":"cer","metric":"cer_field","value":0.1,"passed":true}'
    path = write(tmp_path / "r.json", f'{good}\n{{"task": \n{{"task":"x","value":"high"}}\n')
    assert [r.task for r in logs.results_read(spark, path).collect()] == ["cer"]
    assert sorted(r.text for r in logs.results_rejects(spark, path).collect()) == ['{"task": ', '{"task":"x","value":"high"}']
    assert logs.results_rejects(spark, str(tmp_path / "none.json")) is None


def test_digests_of_files_in_blocks(spark, tmp_path):
    write(tmp_path / "d" / "a b%20.bin", "x" * 10_001)
    write(tmp_path / "d" / "sub" / "short", "y")
    found = {r.rel_path: r for r in files.file_digests(spark, str(tmp_path / "d"), block=100).collect()}
    assert set(found) == {"a b%20.bin", "sub/short"}
    for name, text in (("a b%20.bin", b"x" * 10_001), ("sub/short", b"y")):
        assert (found[name].length, found[name].md5) == (len(text), hashlib.md5(text).hexdigest())
        assert found[name].sha256 == hashlib.sha256(text).hexdigest()


def test_bad_lines_by_number(spark, tmp_path):
    """Lines of files that are cut into many splits, against a loop over the lines."""
    wanted = []
    kinds = ["", "// note", "{bad", "[1]", '{"id":"a","label":"two"}', '{"id":"a"} more', '{"id":"a"}],[1', "null",
             "{'id':'a'}", '{"id":"a"}},{"b":1', '{"id":"a","id":"b"}']
    reasons = [None, None, "invalid JSON", "not an object", "wrong type", "invalid JSON", "invalid JSON", "not an object",
               "invalid JSON", "invalid JSON", None]
    for f in range(2):
        lines = []
        for i in range(900):
            kind = (i * 7 + f) % 40
            lines.append(kinds[kind] if kind < len(kinds) else f"  {GOOD} ")
            if kind < len(kinds) and reasons[kind]:
                wanted.append((f"m{f}.jsonl", i + 1, reasons[kind]))
        path = tmp_path / "many" / f"m{f}.jsonl"
        path.parent.mkdir(exist_ok=True)
        path.write_text(("\r\n" if f else "\n").join(lines), newline="")
    keys = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        splits = lines_source.split_offsets(spark, str(tmp_path / "many"))
        assert splits.count() > 20
        found = manifests.bad_lines(spark, str(tmp_path / "many"), schemas.FORGERY_MANIFEST).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.manifest.rsplit("/", 1)[1], r.line, r.reason) for r in found) == sorted(wanted)
    with pytest.raises(manifests.ManifestError, match=r"m0.jsonl:2: not an object: null"):
        manifests.manifest_read(spark, str(tmp_path / "many" / "m0.jsonl"), schemas.FORGERY_MANIFEST, shown=3)


def test_files_are_sorted_by_as_many_tasks_as_rows_need(spark):
    """More tasks than the session's eight, each key in one file, lines in order."""
    from pathlib import Path

    from tallymark.plans.queries_sources import written

    rows = spark.range(400_000).select(F.expr("id % 90").alias("part"), "id", F.col("id").cast("string").alias("value"))
    found = sorted(Path(written(rows, "part", ["id"], "sorted").removeprefix("file:")).glob("part=*/part-*"))
    assert len(found) == 90 and len({f.name.split("-")[1] for f in found}) > 8
    lines = [int(x) for x in found[0].read_text().split()]
    assert lines == sorted(lines) and len(lines) in (4444, 4445)
