import os
import subprocess

import pytest

from sigilite.catalog import Config
from sigilite.operators.scan import scan
from sigilite.sources.decode import decode_bytes, decode_text, text_encoding
from sigilite.sources.git import GitError, coverage_warnings, read_history, read_staged
from sigilite.sources.tree import read_tree

GH = "gh" + "p_" + "Zq8vKd3LxWm5RtYp7NcB2HfJ9sGuTe4QaVwX"


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "utf-16", "utf-32"])
def test_marks(spark, name):
    from pyspark.sql import functions as F

    raw = f"ção {GH}".encode(name)
    assert decode_bytes(raw) == f"ção {GH}"
    df = spark.createDataFrame([(bytearray(raw),)], "content binary")
    assert df.select(decode_text(F.col("content"))).first()[0] == f"ção {GH}"


def test_binary(spark):
    from pyspark.sql import functions as F

    raws = [b"%PDF-1.7 x", b"ab\0c", b"plain", b"x" * 9000 + b"\0", b"\xff\xfe", b"", None, b"bad \xff\xff utf"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, content binary").orderBy("i")
    assert [r[0] for r in df.select(text_encoding(F.col("content"))).collect()] == ["binary", "binary", "utf-8", "utf-8", "utf-16", "utf-8", None, "utf-8"]
    got = [r[0] for r in df.select(decode_text(F.col("content"))).collect()]
    assert got == [decode_bytes(r) for r in raws]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    for name, data in {
        "src/a.py": f"x = '{GH}'\n".encode(), ".env": b"API_KEY=Cliente1234#\n", "node_modules/b.js": GH.encode(), "env2/pyvenv.cfg": b"", "env2/c.py": GH.encode(),
        "yarn.lock": GH.encode(), "logo.png": b"x", "big.txt": b"y" * 3000, "blob.dat": b"\0\0", "wide.txt": f"﻿{GH}".encode("utf-16-le"),
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (tmp_path / "outside.py").write_text(GH)
    os.symlink(tmp_path / "outside.py", root / "link.py")
    os.symlink(root, root / "src" / "again")
    return root


def test_tree(spark, tree):
    df = read_tree(spark, [str(tree)], Config(max_file_size=2000))
    rows = {os.path.relpath(r.path, tree): r.skip_reason for r in df.collect()}
    assert rows == {"src/a.py": None, ".env": None, "node_modules": "directory", "env2": "directory", "yarn.lock": "noise", "logo.png": "binary", "big.txt": "size", "blob.dat": "binary", "wide.txt": None}
    assert {(os.path.basename(r.path), r.rule_id) for r in scan(df).collect()} == {("a.py", "github-token"), (".env", "dotenv-assignment"), ("wide.txt", "github-token")}
    assert read_tree(spark, [str(tree / "src/a.py")] * 2).count() == 2


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b.c", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git(repo, "init", "-q", "-b", "main")
    (repo / "a.py").write_text(f"x = '{GH}'\n")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "first")
    (repo / "a.py").write_text("x = 1\n")
    git(repo, "commit", "-qam", f"removed {GH[:-1]}Y")
    (repo / ".env").write_text("API_KEY=Cliente1234#\n")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "oops")
    git(repo, "rm", "-q", ".env")
    git(repo, "commit", "-q", "--amend", "--allow-empty", "-m", "clean")
    git(repo, "tag", "-a", "v1", "-m", f"note {GH[:-1]}Z")
    (repo / "big.txt").write_text("z" * 5000)
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "big")
    return repo


def test_history(spark, repo):
    df = read_history(spark, str(repo), Config(max_file_size=4000))
    found = {(r.path.split(" ")[0] + (" " + r.path.split(" ")[1] if r.path.startswith("<") else ""), r.rule_id) for r in scan(df).collect()}
    # the amended environment file is reachable from nowhere, so it has no name
    assert found == {("a.py", "github-token"), ("<commit message", "github-token"), ("<tag message", "github-token"), ("<loose object", "dotenv-assignment")}
    assert [r.path for r in df.where("skip_reason = 'size'").collect()] == ["big.txt"]
    assert coverage_warnings(str(repo)) == []


def test_shallow_and_clone(spark, repo, tmp_path):
    subprocess.run(["git", "clone", "-q", "--depth", "1", f"file://{repo}", str(tmp_path / "c")], check=True, capture_output=True)
    with pytest.raises(GitError):
        read_history(spark, str(tmp_path / "c"))
    assert read_history(spark, str(tmp_path / "c"), allow_shallow=True).count() > 0
    (warning,) = coverage_warnings(str(tmp_path / "c"))
    assert str(repo) not in warning
    with pytest.raises(GitError):
        read_history(spark, str(tmp_path))


def test_staged(spark, repo):
    (repo / "new.py").write_text(f"k = '{GH}'\n")
    (repo / "not_staged.py").write_text(GH)
    git(repo, "add", "new.py")
    git(repo, "mv", "a.py", "b.py")
    df = read_staged(spark, str(repo))
    assert {r.path for r in df.collect()} == {"new.py", "b.py"}
    assert [r.path for r in scan(df).collect()] == ["new.py"]
