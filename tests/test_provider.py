"""Asking a model once, rows page by page, and archives of logs."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from ridgeline.plans import provider
from ridgeline.sources import archives, paged, readers


def test_prompts_are_asked_once_over_all_runs(spark, tmp_path):
    log = str(tmp_path / "log")

    def answer(prompts):
        with open(log, "a") as f:
            f.write("".join(f"{p}\n" for p in prompts))
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(i, f"p{i % 6}" if i < 11 else None) for i in range(12)], "id long, prompt string").repartition(3)
    store = str(tmp_path / "store")
    got = provider.ask(rows, answer, store, batch=2, per_job=3)
    assert got.count() == 12 and {(r.id, r.response) for r in got.collect()} == {(i, f"P{i % 6}" if i < 11 else None) for i in range(12)}
    assert sorted(open(log).read().split()) == [f"p{i}" for i in range(6)]
    more = spark.createDataFrame([(1, "p1"), (2, "new")], "id long, prompt string")
    assert {(r.id, r.response) for r in provider.ask(more, answer, store).collect()} == {(1, "P1"), (2, "NEW")}
    assert sorted(open(log).read().split()) == ["new", *[f"p{i}" for i in range(6)]]
    assert provider.ask(rows.limit(0), answer, str(tmp_path / "none")).count() == 0


def test_a_rerun_asks_only_for_what_a_broken_run_did_not_store(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id long, prompt string")
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    keys = [r.k for r in rows.select(F.sha2("prompt", 256).alias("k"), F.pmod(F.xxhash64(F.sha2("prompt", 256)), F.lit(4)).alias("job")).filter("job = 2").select(F.col("k")).collect()]
    broken = {f"p{i}" for i in range(40) if rows.filter(F.col("id") == i).select(F.sha2("prompt", 256)).first()[0] == keys[0]}

    def fails(prompts):
        if broken & set(prompts):
            raise RuntimeError("no answer")
        return ["a"] * len(prompts)

    with pytest.raises(Exception, match="no answer"):
        provider.ask(rows, fails, store, per_job=10)
    kept = provider.stored_answers(spark, store).count()
    assert 0 < kept < 40

    def counts(prompts):
        with open(log, "a") as f:
            f.write("x" * len(prompts))
        return ["b"] * len(prompts)

    assert provider.ask(rows, counts, store, per_job=10).filter("response is null").count() == 0
    assert len(open(log).read()) == 40 - kept
    with pytest.raises(Exception, match="got 0 answers"):
        provider.ask(rows, lambda prompts: [], str(tmp_path / "other"))


def test_jobs_run_at_a_time_each_into_its_own_folder(spark, tmp_path):
    rows = spark.range(300).select("id", F.format_string("p%d", "id").alias("prompt"))
    store = tmp_path / "store"
    got = provider.ask(rows, lambda p: [x.upper() for x in p], str(store), per_job=10)
    assert got.filter("response = upper(prompt)").count() == 300 and provider.stored_answers(spark, str(store)).count() == 300
    sizes = [spark.read.parquet(str(f)).count() for f in store.iterdir() if f.is_dir()]
    assert 20 < len(sizes) <= 30 and sum(sizes) == 300


def write_page(folder, number, rows):
    (folder / f"page={number}").mkdir(parents=True)
    (folder / f"page={number}" / "part-0.txt").write_text(json.dumps(rows))


def test_pages_have_stable_numbers_and_gaps_are_errors(spark, tmp_path, monkeypatch):
    for p in range(13):
        write_page(tmp_path / "full", p, [{"row_idx": p * 4 + i, "row": {"q": f"é{p}", "n": i}} for i in range(4 if p < 12 else 2)])
    df = paged.read_pages(spark, str(tmp_path / "full"), 50, 4)
    assert df.rdd.getNumPartitions() == 2
    rows = sorted(df.collect())
    assert [r.row_idx for r in rows] == list(range(50)) and json.loads(rows[49].row) == {"q": "é12", "n": 1}
    assert paged.read_pages(spark, str(tmp_path / "full"), 0, 4).collect() == []
    with pytest.raises(Exception, match="page 12 has 2 rows"):
        paged.read_pages(spark, str(tmp_path / "full"), 52, 4).collect()
    with pytest.raises(Exception, match="positive"):
        paged.read_pages(spark, str(tmp_path / "full"), 5, 0).collect()


def test_failed_pages_are_tried_again():
    calls = []

    def fetch(path, number):
        calls.append(number)
        if len(calls) < 3:
            raise ConnectionError("busy")
        return [{"row_idx": 1, "row": {}}]

    assert paged.with_retries(fetch, "x", 7, wait=0) == [{"row_idx": 1, "row": {}}] and calls == [7, 7, 7]
    with pytest.raises(TimeoutError):
        paged.with_retries(lambda *_: (_ for _ in ()).throw(TimeoutError()), "x", 1, tries=2, wait=0)


def test_written_pages_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i == 3 else f"t\n{i}") for i in range(25)], "id long, text string").withColumn("number", F.col("id") + 1)
    paged.write_pages(rows, "number", f"{tmp_path}/w", 10)
    got = sorted(paged.read_pages(spark, f"{tmp_path}/w", 25, 10).collect())
    assert [json.loads(r.row) for r in got] == [{"id": i, "text": None if i == 3 else f"t\n{i}"} for i in range(25)]


def tar(path, members):
    with tarfile.open(path, "w:gz") as t:
        for name, text in members:
            info = tarfile.TarInfo(name)
            data = text.encode()
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)


def test_raw_logs_from_an_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "LINES", 3)
    bar = readers.K.LOG_SEPARATOR
    head = bar.join(["SystemAlertId", "AlertName", "AlertSeverity", "Description"])
    body = [bar.join([f"a{i}", "Name", "High", f'"two\nlines ""{i}"""']) for i in range(8)]
    tar(tmp_path / "logs.tar.gz", [("data/incidents/incident_5/SecurityAlert.csv", "\n".join([head, *body[:5]]) + "\n"), ("./data/incidents/incident_34/SecurityAlert/SecurityAlert_1.csv", "\n".join([head, *body[5:]])), ("data/empty.txt", "")])
    root = f"{tmp_path}/out"
    assert archives.extract(spark, f"{tmp_path}/logs.tar.gz", root) == ["data/incidents/incident_34/SecurityAlert/SecurityAlert_1.csv", "data/incidents/incident_5/SecurityAlert.csv"]
    got = readers.security_table(spark, f"{root}/data", "incident_5").orderBy("SystemAlertId").collect()
    assert [(r.SystemAlertId, r.Description) for r in got] == [(f"a{i}", f'two\nlines "{i}"') for i in range(5)]
    assert readers.security_table(spark, f"{root}/data", "incident_34").count() == 3


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x"])
def test_unsafe_members_are_refused(spark, tmp_path, name):
    tar(tmp_path / "bad.tar.gz", [("fine.txt", "line"), (name, "evil")])
    with pytest.raises(Exception, match="unsafe path"):
        archives.extract(spark, f"{tmp_path}/bad.tar.gz", f"{tmp_path}/out")
    assert not (tmp_path / "x").exists()


def test_sketch_is_never_under_and_seldom_over(spark):
    from ridgeline.operators import gate

    df = spark.range(3000).select(F.concat(F.lit("k"), F.expr("id * id % 700")).alias("k"))
    rows = gate.sketch_estimates(df, "k", width=400, depth=4).collect()
    assert all(r.estimate >= r["count"] for r in rows) and sum(r["count"] for r in rows) == 3000
    exact = gate.sketch_estimates(df, "k").collect()
    assert sum(r.estimate == r["count"] for r in exact) == len(exact)
