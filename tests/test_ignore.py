"""Ignore files, against git on a made-up tree."""

import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.sources import ignore

IGNORES = {
    ".gitignore": "# comment\n*.log\n!keep.log\n/top\nbuild/\ndocs/*.txt\n**/gen\nsrc/**/tmp.*\n\\#odd\n\\!odd\ntrail \nspace\\ \nq?.x\n[ab].y\n[!ab].z\nall/**\n!all/stay\n\n   \nfoo/**/bar\n",
    "src/.gitignore": "!*.log\nlocal\n/only\n*.tmp\n!deep/\n",
    "src/deep/.gitignore": "*\n!*.ts\n",
    "build/.gitignore": "!*\n",
}
PATHS = """a.log keep.log x/a.log x/keep.log top x/top top2/top/y build/a x/build/b build2 x/build docs/a.txt docs/d/a.txt docs/a.md gen x/y/gen x/gen/a src/tmp.a src/p/q/tmp.b tmp.c #odd !odd trail space q1.x q12.x a.y c.y a.z c.z all/a all/stay all/b/stay
src/a.log src/x/local src/local/k local src/only src/x/only only src/x.tmp src/deep/a.ts src/deep/a.js src/deep/sub/a.ts foo/bar foo/a/bar foo/a/b/bar/c foo/bars""".split() + ["space "]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p in PATHS:
        at = root / p
        try:
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text("x")
        except OSError:  # a file stands where a folder would, or the other way round
            continue
    for p, t in IGNORES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    return root


def test_ignored_like_git(spark, tree):
    there = [str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file() and ".git/" not in str(p.relative_to(tree)) + "/"]
    assert len(there) > 45
    said = subprocess.run(["git", "-C", str(tree), "ls-files", "-z", "--others", "--ignored", "--exclude-standard"], capture_output=True, text=True, check=True).stdout.split("\0")
    files = spark.createDataFrame([(p, IGNORES.get(p, "x")) for p in there], "path string, text string").repartition(3)
    got = {r.path for r in ignore.ignored(files, ignore.ignore_rules(files)).collect()}
    assert got == {p for p in said if p} and len(got) > 20
    left = {r.path for r in ignore.not_ignored(files, files.where("path = 'a.log'")).collect()}
    assert left == (set(there) - got) | {"a.log"}


def test_no_rules(spark):
    files = spark.createDataFrame([("a", "x"), ("b/c", None)], "path string, text string")
    assert ignore.not_ignored(files).count() == 2 and ignore.not_ignored(files.limit(0)).count() == 0
    assert ignore.ignored(files.select(F.lit(None).cast("string").alias("path")), ignore.ignore_rules(files)).count() == 0
