"""The partitioned directory source against the scan on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from corpuloom.sources import files, tree


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rng = random.Random(3)
    (root / ".gitignore").write_text("*.log\n!keep.log\nbuild/\n/top.txt\n")
    (root / "top.txt").write_text("x")
    (root / "empty").mkdir()
    places = [root]
    for _ in range(60):
        place = rng.choice(places) / rng.choice(["a", "b", "build", "src", "docs", "deep er"])
        place.mkdir(exist_ok=True)
        places.append(place)
    for place in places[::7]:
        (place / ".ignore").write_text(rng.choice(["*.md\n", "!*.log\n", "a/\n", "sub/*.py\n"]))
    for n in range(400):
        (rng.choice(places) / f"f{n}{rng.choice(['.py', '.md', '.log', '.txt', '', '.PNG', '.tar.gz', '.'])}").write_bytes(b"x" * rng.randint(0, 2000))
    (root / "keep.log").write_text("kept")
    (root / ".hidden.py").write_text("hidden")
    (root / "link.py").symlink_to(root / "keep.log")
    (root / ".git").mkdir()
    (root / ".git" / "config").write_text("x")
    return root


@pytest.mark.parametrize("parts", [1, 3, 40, 1000])
@pytest.mark.parametrize("no_ignore", [False, True])
def test_tree_equals_scan(spark, folder, parts, no_ignore):
    want = sorted(map(tuple, files.scan(spark, str(folder), no_ignore=no_ignore).collect()))
    got = sorted(map(tuple, tree.scan_tree(spark, str(folder), no_ignore=no_ignore, parts=parts).collect()))
    assert got == want and len(got) > 50


def test_filters_reach_the_walk(spark, folder):
    whole = tree.scan_tree(spark, str(folder), enrich=False)
    some = tree.scan_tree(spark, str(folder), enrich=False, kind=["code", "text"], ext=[".py", ".md"], min_size=100, max_size=1500)
    want = whole.where(F.col("kind").isin("code", "text") & F.col("ext").isin(".py", ".md") & F.col("size").between(100, 1500))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.collect())) and some.count() > 5
    found = tree.tree(spark, str(folder)).where("kind = 'code' AND size > 100 AND path LIKE '%f1%'")
    plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.split("\n") if "Filter " in line and "Scan" not in line]
    assert left and not any("kind" in line or "size" in line for line in left) and any("Contains(path" in line for line in left)


def test_readers_take_only_what_they_can():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    reader = tree.TreeReader({"path": "/x"})
    rest = list(reader.pushFilters([EqualTo(("kind",), "code"), In(("ext",), (".py", ".rs")), EqualTo(("ext",), ".py"), GreaterThan(("size",), 5), LessThanOrEqual(("size",), 9), StringContains(("path",), "x"), EqualTo(("path",), "y")]))
    assert [type(f).__name__ for f in rest] == ["StringContains", "EqualTo"]
    assert reader.names == {"kind": {"code"}, "ext": {".py"}} and (reader.low, reader.high) == (6, 9)


def test_partitions_are_bounded_and_cover(folder):
    walk = tree.Walk(str(folder), False)
    for wanted in (1, 5, 50):
        roots = walk.roots(wanted)
        assert len({f for f, _ in roots}) == len(roots)
        reader = tree.TreeReader({"path": str(folder), "parts": str(wanted)})
        assert len(reader.partitions()) <= wanted


def test_a_root_that_is_no_folder(spark, folder):
    with pytest.raises(Exception, match="no folder"):
        tree.tree(spark, str(folder / "keep.log")).collect()
