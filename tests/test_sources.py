import pytest

from gatewright.sources import files


def test_csv_header_must_match(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("task,candidate\nx,y\n")
    with pytest.raises(ValueError, match="header"):
        files.read_csv(spark, str(path), files.CHEAP_LOG)


def test_logs_join(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(",".join(files.CHEAP_LOG.names) + "\n" + "".join(f"t,c,{r},0,{i},s{i},yes,no,0.5,1,1\n" for r in range(2) for i in range(3)))
    cheap = files.read_csv(spark, str(path), files.CHEAP_LOG)
    log = spark.createDataFrame([("t", "m", i, f"s{i}", "yes", "yes", "yes", 1, 1, 1, 0, 0.1, 0.2, "") for i in range(3)], files.EXPENSIVE_LOG)
    assert files.join_logs(cheap, log).count() == 6
    with pytest.raises(ValueError, match="more than once"):
        files.join_logs(cheap, log.union(log))
    with pytest.raises(ValueError, match="differ"):
        files.join_logs(cheap, log.replace("s1", "other", ["text_sha256"]))
    with pytest.raises(ValueError, match="unlike items"):
        files.join_logs(cheap.where("not (repeat = 1 and item_idx = 2)"), log)


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert files.append_rows(rows, str(tmp_path / "x"), ["k"]) == 2
    assert files.append_rows(rows, str(tmp_path / "x"), ["k"]) == 0
    assert files.append_rows(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), str(tmp_path / "x"), ["k"]) == 1


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "task string, v int")
    patch = spark.createDataFrame([("a", 9)], "task string, v int")
    assert sorted(map(tuple, files.upsert(base, patch, "task", ["a"]).collect())) == [("a", 9), ("b", 3)]
    with pytest.raises(ValueError):
        files.upsert(base, patch, "task", ["b"])


def test_upload(spark, tmp_path):
    path = tmp_path / "u.jsonl"
    path.write_text('{"text": "a", "label": "x"}\n{"query": "b", "intent": "y"}\nnonsense\n{"text": "c"}\n')
    got = files.validate_upload(spark, str(path))
    assert got == {"rows": 4, "bad": 2, "classes": {"x": 1, "y": 1}, "problems": []}


def test_published(spark):
    rows = spark.createDataFrame([("t", "m1", "f1", 0.5), ("t", "m2", "f1", 0.7), ("t", "m1", "acc", 0.9)], "task string, model string, metric string, score double")
    assert tuple(files.best_published(rows).first()) == ("t", "f1", 0.7, "m2")


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, v string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i long, v string")
    assert files.fingerprint(a, ["i", "v"]) == files.fingerprint(b, ["v", "i"])
    assert files.fingerprint(a, ["v"], "i") == files.fingerprint(b, ["v"], "i") != files.fingerprint(a.replace("x", "y"), ["v"], "i")


def test_fold_columns(spark):
    rows = spark.createDataFrame([("t", 1.0, None)], "task string, published__a double, published__b double")
    assert files.fold_columns(rows, "published__", "published").first()["published"] == {"a": "1.0"}


def test_registered_sources(spark):
    files.register("tiny")(lambda s: s.range(3))
    assert files.load(spark, "tiny").count() == 3
    with pytest.raises(ValueError):
        files.register("tiny")
    with pytest.raises(KeyError, match="tiny"):
        files.load(spark, "huge")
