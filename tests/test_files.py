"""Sources that need real files, streams, and brute-force checks of the policy."""

import json
import os
import random

from pyspark.sql import functions as F

from stopwise.operators import audit, ingest, policy
from stopwise.sources import files
from stopwise.streaming import online


def _doc(instance, model, resolved=True):
    return {
        "instance_id": instance,
        "messages": [
            {"role": "user", "content": "task"},
            {"role": "assistant", "content": "go", "tool_calls": [{"id": "1", "function": "bash", "arguments": {"command": "pytest"}}]},
            {"role": "assistant", "tool_calls": [{"id": "2", "function": {"name": "run", "arguments": '{"command": "ls"}'}}]},
            {"role": "tool", "content": "3 passed"},
        ],
        "info": {"resolved": resolved, "docent": {"model_label": model}, "submission": None},
    }


def test_scan_documents_quarantines_and_maps(spark, tmp_path):
    for model, name, text in (
        ("m1", "i1", json.dumps(_doc("i1", "m1"), indent=1)),
        ("m1", "i2", "{not json"),
        ("m2", "i1", json.dumps(_doc("i1", "m2", 1))),
        ("m2", "i3", json.dumps([1, 2])),
    ):
        os.makedirs(tmp_path / model / name)
        (tmp_path / model / name / f"{name}.traj.json").write_text(text)
    (tmp_path / "m1" / "notes.txt").write_text("ignored")
    checked = ingest.quarantine(files.scan_traj_json(spark, str(tmp_path)))
    got = {r.file: (r.model_dir, r.stage, r.reason) for r in checked.collect()}
    assert got == {
        "m1/i1/i1.traj.json": ("m1", None, None),
        "m1/i2/i2.traj.json": ("m1", "read_json", "INVALID_JSON"),
        "m2/i1/i1.traj.json": ("m2", "field_validation", "MISSING_RESOLVED_BOOL"),
        "m2/i3/i3.traj.json": ("m2", "field_validation", "NOT_A_JSON_OBJECT"),
    }
    run = ingest.to_contract(ingest.passed(checked)).first()
    assert run.traj_id == "m1::i1" and run.resolved and run.patch == ""
    assert [m.action for m in run.messages] == [None, "pytest", '{"command": "ls"}', None]
    assert run.messages[2].tool_calls[0].name == "run"
    manifest = {r.model: (r.files, r.misplaced_files) for r in files.dataset_manifest(files.digest_files(spark, str(tmp_path), "*.traj.json")).collect()}
    assert manifest == {"m1": (2, 0), "m2": (2, 0)}


def test_key_from_file_name_ignores_other_files(spark, tmp_path):
    for name in ("pair-0001.csv", "pair-0102.csv", "pair-0001.per_agent.csv", "parity.csv"):
        (tmp_path / name).write_text("traj_id,score\n1,0.5\n")
    rows = files.scan_keyed_by_filename(spark, str(tmp_path), r"/(pair-\d{4})\.csv$", "traj_id bigint, score double")
    assert sorted(r.pair_id for r in rows.collect()) == ["pair-0001", "pair-0102"]


def test_manifest_states(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    found = files.digest_files(spark, str(tmp_path))
    noted = found.where("file <> 'c'").withColumn("sha256", F.when(F.col("file") == "a", "x").otherwise(F.col("sha256")))
    noted = noted.unionByName(noted.limit(1).withColumn("file", F.lit("gone")))
    row = audit.verify_manifest(found, noted).first()
    assert (row.matched, row.mismatched, row.missing, row.unlisted, row.all_match) == (1, 1, 1, 1, False)


def _brute(rows, threshold, consecutive):
    streak = {"success": 0, "failure": 0}
    previous = None
    for step, s, f in sorted(rows):
        hits = []
        for head, score in (("success", s), ("failure", f)):
            follows = previous is not None and step == previous + 1
            streak[head] = (streak[head] + 1 if follows else 1) if score >= threshold else 0
            if streak[head] >= consecutive:
                hits.append((-score, head != "success", head))
        previous = step
        if hits:
            best = sorted(hits)[0]
            return best[2], step, -best[0]
    return "undecided", -1, None


def test_policy_against_brute_force(spark):
    rng = random.Random(7)
    runs = {i: [(k, rng.choice([0.5, 0.9, 0.95]), rng.choice([0.5, 0.9, 0.95])) for k in range(rng.randint(1, 9)) if rng.random() < 0.9] for i in range(300)}
    flat = [(i, k, 9, s, f) for i, rows in runs.items() for k, s, f in rows]
    preds = spark.createDataFrame(flat, "traj_id int, prefix_step_idx int, n_steps_total int, p_success double, p_failure double")
    for consecutive in (1, 2, 3):
        got = {r.traj_id: (r.decision, r.decision_step, r.decision_score) for r in policy.apply_stop_policy(preds, threshold=0.9, consecutive=consecutive).collect()}
        want = {i: _brute(rows, 0.9, consecutive) for i, rows in runs.items() if rows}
        assert got == want


def test_incremental_ingest_reads_files_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    row = ("t", "n", "task", "m", "a", 1, '[{"src":"agent"}]', 1)
    for key in (1, 2):
        spark.createDataFrame([(*row[:-1], key)], online.TRIALS).write.mode("append").parquet(source)
        online.ingest_trials(spark, source, target, state).awaitTermination()
        assert sorted(r.row_key for r in spark.read.parquet(target).collect()) == list(range(1, key + 1))


def test_online_decisions_equal_batch(spark, tmp_path):
    schema = "traj_id int, prefix_step_idx int, n_steps_total int, p_success double, p_failure double"
    spark.createDataFrame([(1, 0, 2, 0.5, 0.5), (1, 1, 2, 0.97, 0.5), (2, 0, 1, 0.5, 0.5)], schema).write.parquet(str(tmp_path / "s"))
    stream = online.online_decisions(spark.readStream.schema(schema).parquet(str(tmp_path / "s")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("online").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.traj_id: r.decision for r in spark.sql("select * from online").collect()}
    assert got == {1: "success", 2: "undecided"}


def test_a_broken_file_costs_no_other(spark, tmp_path):
    import hashlib

    for name, content in (("m1/a.traj.json", b"{}"), ("m1/b.traj.json", b"\xff{}"), ("m2/c.traj.json", b""), ("m2/long.traj.json", b"x" * 100)):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "m2" / "gone.traj.json").symlink_to(tmp_path / "nowhere")
    rows = {r.file: r for r in files.run_files(spark, str(tmp_path), "*.traj.json", longest=50, partition_bytes=60).collect()}
    assert {f: (r.document, r.error) for f, r in rows.items() if "gone" not in f} == {
        "m1/a.traj.json": ("{}", None),
        "m1/b.traj.json": (None, "NOT_UTF8"),
        "m2/c.traj.json": ("", None),
        "m2/long.traj.json": (None, "TOO_LONG"),
    }
    assert rows["m2/long.traj.json"].sha256 == hashlib.sha256(b"x" * 100).hexdigest() and rows["m2/long.traj.json"].bytes == 100
    os.makedirs(tmp_path / "empty")
    assert files.run_files(spark, str(tmp_path / "empty"), "*").count() == 0


def test_digest_of_a_file_beyond_the_row_limit(spark, tmp_path):
    """2 GB and a little, without holding it on disk or in a row."""
    import hashlib

    size = (1 << 31) + 5
    with open(tmp_path / "large.bin", "wb") as file:
        file.truncate(size)
    digest = hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(bytes(1 << 20))
    digest.update(bytes(size & (1 << 20) - 1))
    assert [tuple(r) for r in files.digest_files(spark, str(tmp_path), "*.bin").collect()] == [("large.bin", size, digest.hexdigest())]


def test_written_files_read_back(spark, tmp_path):
    rows = [(f"m{i % 3}/f{i}.txt", f"text {i}".encode()) for i in range(40)] + [("m0/null.txt", None)]
    files.write_run_files(spark.createDataFrame(rows, "file string, content binary").repartition(4), str(tmp_path / "out"))
    got = {r.file: r.document for r in files.run_files(spark, str(tmp_path / "out"), "*").collect()}
    assert got == {f: (c or b"").decode() for f, c in rows}
