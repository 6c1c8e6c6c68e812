import hashlib
import os

import pytest

from factloom.operators import inspection
from factloom.sources import files

pytestmark = pytest.mark.usefixtures("small_plans")

ROLES = ("response_file",)
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture
def tree(spark, tmp_path):
    for n, b in {"a.cpp": b"a", "b.h": b"b", "c.rsp": b"c"}.items():
        (tmp_path / n).write_bytes(b)
    recorded = spark.createDataFrame(
        [("u1", "a.cpp", "source", sha(b"a")), ("u1", "b.h", "header", sha(b"b")), ("u2", "b.h", "header", sha(b"b")), ("u3", "c.rsp", "response_file", sha(b"old")), ("u4", "gone.h", "header", sha(b"g"))],
        "unit string, path_key string, role string, recorded string",
    )
    currency = spark.createDataFrame([("u1", True), ("u2", False)], "unit string, verified boolean")
    states = spark.createDataFrame([("u1", "fresh", "fresh", "unknown", None, ""), ("u2", "fresh", "unknown", "fresh", None, "seen"), ("u3", "stale", "fresh", "unknown", None, ""), ("other", "fresh", "fresh", "fresh", None, "")], inspection.STATE)
    return str(tmp_path), recorded, currency, states


def shown(found):
    return {r.unit: (r.semantic, r.compile_context, r.uht, r.reasons) for r in found.states.collect()}


def test_complete(tree):
    root, recorded, currency, states = tree
    got = inspection.inspect(recorded, currency, states, root, ROLES, 600)
    assert got.outcome == "complete" and got.checked == 4
    assert shown(got) == {
        "u1": ("fresh", "fresh", "unknown", ""), "u2": ("unknown", "unknown", "unknown", "the build isn't verified"), "u3": ("stale", "stale", "unknown", "modified c.rsp"),
        "u4": ("stale", "unknown", "unknown", "deleted gone.h"), "other": ("fresh", "fresh", "fresh", ""),
    }


def test_a_change_between_passes(tree):
    root, recorded, currency, states = tree

    def change():
        with open(os.path.join(root, "a.cpp"), "wb") as f:
            f.write(b"new")

    got = inspection.inspect(recorded, currency, states, root, ROLES, 600, between=change)
    assert got.outcome == "complete" and shown(got)["u1"][0] == "stale"


def test_every_downgrade(tree):
    """Fresh becomes unknown, stale stays, what was seen to be stale is recorded, nothing becomes fresh."""
    root, recorded, currency, states = tree
    got = inspection.inspect(recorded, currency, states, root, ROLES, 0.0)
    line = "the last inspection was incomplete: budget_exhausted"
    assert got.outcome == "budget_exhausted" and got.checked == 0
    assert shown(got) == {"u1": ("unknown", "unknown", "unknown", line), "u2": ("unknown", "unknown", "unknown", f"seen\n{line}"), "u3": ("stale", "unknown", "unknown", line), "other": ("unknown", "unknown", "unknown", line)}
    told = iter([1, 2, 2])
    got = inspection.inspect(recorded, currency, states, root, ROLES, 600, generation=lambda: next(told))
    assert got.outcome == "generation_changed" and shown(got)["u1"][0] == "unknown" and "u4" not in shown(got)  # another generation's units aren't judged
    found = inspection.conclude(got.inputs, currency, ROLES, inspection.F.lit(None))
    assert {r.unit: r.semantic for r in inspection.downgraded(states, "x", found).collect()} == {"u1": "unknown", "u2": "unknown", "u3": "stale", "u4": "stale", "other": "unknown"}


def test_many_reasons_are_counted(spark):
    rows = [("u", f"p{k:02}", "header", "x", "y", "y") for k in range(25)]
    got = inspection.reasons(spark.createDataFrame(rows, "unit string, path_key string, role string, recorded string, first string, second string")).first().reasons.split("\n")
    assert len(got) == 21 and got[0] == "modified p00" and got[-1] == "and 5 more"


def test_chunks_large_unreadable_and_late_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 1000)
    big = os.urandom(1_000_003)
    (tmp_path / "big").write_bytes(big)
    with open(tmp_path / "huge", "wb") as f:  # more than a cell can hold; sparse, so it takes no disk
        f.truncate((1 << 31) + 10)
    (tmp_path / "dir").mkdir()
    paths = spark.createDataFrame([("big",), ("dir",), ("no",), (None,)], "path string")
    got = {r.path: (r.size, r.hash, r.state) for r in files.hashes(paths, str(tmp_path)).collect()}
    assert got == {"big": (1_000_003, sha(big), "present"), "dir": (None, None, "absent"), "no": (None, None, "absent"), None: (None, None, "absent")}
    monkeypatch.setattr(files, "CHUNK", 1 << 20)
    r = files.hashes(spark.createDataFrame([("huge",)], "path string"), f"file://{tmp_path}").first()
    want = hashlib.sha256()
    for _ in range(1 << 11):
        want.update(bytes(1 << 20))
    want.update(bytes(10))
    assert (r.size, r.hash) == ((1 << 31) + 10, want.hexdigest())

    class Broken(files.pafs.PyFileSystem):
        def __init__(self):
            pass

        def get_file_info(self, path):
            return files.pafs.FileInfo(path, files.pafs.FileType.File)

        def open_input_stream(self, path, **_):
            raise PermissionError(path)

    assert files.hash_file(Broken(), "x") == (None, None, "unreadable")
    assert files.hash_file(files.pafs.LocalFileSystem(), str(tmp_path / "big"), 1.0) == (None, None, "late")
