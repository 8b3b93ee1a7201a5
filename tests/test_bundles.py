"""Files in bundles: small files don't take a disk block each, and a member is read like a loose file."""

import os

from stopwise.sources import files, run_files


def _disk(path):
    return sum(os.stat(os.path.join(d, f)).st_blocks * 512 for d, _, names in os.walk(path) for f in names)


def test_small_files_take_their_bytes(spark, tmp_path):
    rows = [(f"m{i % 3}/a long folder name {i % 7}/f{i}.traj.json", b'{"n": %d}' % i * 20) for i in range(3000)]
    rows += [("m0/broken.traj.json", b"\xff{}"), ("m0/other.txt", b"x"), ("m0/none.traj.json", None)]
    path = str(tmp_path / "out")
    files.write_run_files(spark.createDataFrame(rows, "file string, content binary").repartition(3), path)
    assert _disk(path) < sum(len(c or b"") for _, c in rows)
    os.makedirs(f"{path}/m9")
    with open(f"{path}/m9/loose.traj.json", "w") as file:
        file.write("{}")
    got = {r.file: (r.document, r.error) for r in files.run_files(spark, path, "*.traj.json").collect()}
    want = {f: ((c or b"").decode(), None) for f, c in rows if f.endswith(".json") and "broken" not in f}
    assert got == want | {"m0/broken.traj.json": (None, "NOT_UTF8"), "m9/loose.traj.json": ("{}", None)}


def test_large_writes_are_cut_into_bundles(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    writer = run_files.Writer({"path": path}, ["file", "content"])
    monkeypatch.setattr(run_files, "BUNDLE_BYTES", 1000)
    written = writer.write(iter([(f"f{i}", b"x" * 400) for i in range(10)]))
    assert len(written.names) == 4 and not [n for n in os.listdir(path) if n.endswith(run_files.BUNDLE)]
    writer.commit([written, None])
    assert sorted(os.listdir(path)) == sorted(written.names)
    with open(f"{path}/torn{run_files.BUNDLE}", "wb") as file:
        file.write(b"no archive")
    rows = {r.file: r for r in files.digest_files(spark, path).collect()}
    assert len(rows) == 11 and rows["f9"].bytes == 400 and rows[f"torn{run_files.BUNDLE}"].sha256 is None
