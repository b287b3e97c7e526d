"""J09 by line position against a simulation of whole files."""

import datetime as dt
import difflib
import random

from pyspark.sql import functions as F

from vulnlake.operators import lines as ln
from vulnlake.operators import patches as pt

DAY = dt.datetime(2024, 1, 1)


def history(seed, name, commits, known=True):
    """Random edits of a file of few distinct lines: patches, and the origin of every removed line."""
    r = random.Random(seed)
    text, origin, patches, want = [], [], [], {}
    if not known:  # lines from before the first commit
        text = [r.choice("abc") for _ in range(12)]
        origin = ["blame_error"] * 12
    for n in range(commits):
        sha, new = f"{name}{n:04d}", list(text)
        for _ in range(r.randrange(1, 5)):
            at, cut = r.randrange(len(new) + 1), r.choice([0, 0, 1, 2, 5])
            new[at:at + cut] = [r.choice("abc}") for _ in range(r.choice([0, 1, 1, 3, 8]))]
        if new == text:
            new.append("tail")
        if r.random() < 0.04:
            new = []
        moved = difflib.SequenceMatcher(None, text, new, autojunk=False)
        ends = []
        for tag, a, b, c, d in moved.get_opcodes():
            ends += origin[a:b] if tag == "equal" else [sha] * (d - c)
            if tag != "equal":
                want.update({(sha, i + 1): origin[i] for i in range(a, b)})
        body = list(difflib.unified_diff(text, new, f"a/{name}.c", f"b/{name}.c", lineterm="", n=r.choice([0, 1, 3])))
        if body:
            patches.append((sha, "o/r", DAY + dt.timedelta(hours=n * 7), "\n".join(body) + "\n"))
        text, origin = new, ends
    return patches, want


def test_by_position_equals_simulation(spark, monkeypatch):
    monkeypatch.setattr(ln, "TOGETHER", 8)
    files = [history(1, "long", 37), history(2, "old", 23, known=False), history(3, "one", 1), history(4, "two", 2), history(5, "pair", 8)]
    patches = [p for f, _ in files for p in f]
    want = {k: v for _, w in files for k, v in w.items()}
    df = spark.createDataFrame(patches, "sha string, repo string, ts timestamp, text string")
    lines = pt.patch_lines(df, ["sha", "repo", "ts"]).withColumnRenamed("path", "file")
    got = ln.introducing_commits_by_line(lines, ["sha", "old_no"]).collect()
    assert {(r.sha, r.old_no): r.introducing_commit for r in got} == want and len(got) == len(want)
    assert len(want) > 100 and sum(v == "blame_error" for v in want.values()) > 5


def test_text_alone_misleads(spark):
    """Of two equal lines the removed one is the older: matching by text names the newer commit."""
    from vulnlake.operators import asof
    patches = [("c1", "@@ -0,0 +1,1 @@\n+x\n"), ("c2", "@@ -0,0 +1,2 @@\n+x\n+y\n"), ("fix", "@@ -3,1 +2,0 @@\n-x\n")]
    df = spark.createDataFrame([(s, "r", DAY + dt.timedelta(days=i), f"--- a/f\n+++ b/f\n{t}") for i, (s, t) in enumerate(patches)], "sha string, repo string, ts timestamp, text string")
    lines = pt.patch_lines(df, ["sha", "repo", "ts"]).withColumnRenamed("path", "file")
    assert [r.introducing_commit for r in ln.introducing_commits_by_line(lines, ["sha"]).collect()] == ["c1"]
    assert [r.introducing_commit for r in asof.introducing_commits_from_lines(lines, ["sha", "text"]).collect()] == ["c2"]
    assert [r.introducing_commit for r in asof.introducing_commits_from_lines(lines, ["sha", "text"], method="position").collect()] == ["c1"]


def test_no_lines(spark):
    empty = spark.createDataFrame([], "repo string, file string, ts timestamp, sha string, pos int, sign string, old_no long, new_no long")
    assert ln.introducing_commits_by_line(empty, ["sha"]).count() == 0
    only = spark.createDataFrame([("r", "f", DAY, "s", 1, "-", 4, None), (None, "f", DAY, "s", 1, "-", 4, None)], empty.schema)
    assert [r.introducing_commit for r in ln.introducing_commits_by_line(only, ["sha"]).collect()] == ["blame_error"]


def test_maps_of_blocks_hold_few_points(spark):
    """Composed maps: a block's points never exceed those of its halves, and unchanged borders vanish."""
    patches, _ = history(7, "f", 64)
    lines = pt.patch_lines(spark.createDataFrame(patches, "sha string, repo string, ts timestamp, text string"), ["sha", "repo", "ts"])
    d = lines.where("sign <> ' '").select(F.struct("repo", "path").alias("_f"), F.expr("cast(substr(sha, 2) as long)").alias("_c"), "pos", "sign", "old_no", "new_no")
    points = ln.change_points(d)
    n = points.count()
    for _ in range(3):
        points = ln.composed(points)
        assert points.count() <= n
        n = points.count()
