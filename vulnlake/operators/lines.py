"""Line-position tracking: which commit introduced a line, by position instead of text.

A commit's diff of a file is a map from line numbers after it to line numbers before it: ranges with a
constant shift, and ranges that the commit introduced.  The maps of 2, 4, 8, ... consecutive
commits of a file are composed pairwise, in log depth.  A line is traced back through the largest
blocks of commits that end before it; where a block says "introduced here", its halves are
asked, down to one commit.  All files and all lines go through the same few joins; no file is
walked commit by commit in one task, and repeated or moved lines do not mislead it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.operators.asof import asof_last
from vulnlake.operators.windows import rank_in_group
from vulnlake.session import checkpoint_dir

#: Stands for the shift of a line that its block of commits introduced.
NEW = -(1 << 62)
#: Lines of a file that one task looks up together.
TOGETHER = 4096


def change_points(lines: DataFrame) -> DataFrame:
    """(_f, block, start, shift) of single commits, from their added and removed lines (_f, _c, pos,
    sign, old_no, new_no): from line ``start`` after the commit on, a line was ``shift`` further down
    before it, or is ``NEW``."""
    w = Window.partitionBy("_f", "_c").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plus, minus = (F.col("sign") == "+").cast("long"), (F.col("sign") == "-").cast("long")
    d = lines.withColumn("_p", F.sum(plus).over(w)).withColumn("_m", F.sum(minus).over(w))
    shift = F.col("_m") - F.col("_p")
    at = F.col("old_no") + F.col("_p") - F.col("_m") + 1  # where a removed line would be
    point = lambda start, s, n: F.struct(start.alias("start"), s.alias("shift"), F.col("pos").cast("long").alias("pos"), F.lit(n).alias("n"))
    points = F.when(F.col("sign") == "+", F.array(point(F.col("new_no"), F.lit(NEW), 0), point(F.col("new_no") + 1, shift, 1))) \
        .otherwise(F.array(point(at, shift, 0)))
    first = lines.select("_f", "_c").distinct().select("_f", "_c", F.lit(1).cast("long").alias("start"), F.lit(0).cast("long").alias("shift"),
                                                       F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("n"))
    every = d.select("_f", "_c", F.explode(points).alias("x")).select("_f", "_c", "x.*").unionByName(first)
    last = every.groupBy("_f", "_c", "start").agg(F.max_by("shift", F.struct("pos", "n")).alias("shift"))
    return joined_up(last.select("_f", F.col("_c").alias("block"), "start", "shift"))


def joined_up(points: DataFrame) -> DataFrame:
    """The points at which the shift really changes."""
    w = Window.partitionBy("_f", "block").orderBy("start")
    d = points.withColumn("_was", F.lag("shift").over(w))
    return d.where(F.col("_was").isNull() | (F.col("_was") != F.col("shift"))).drop("_was")


def composed(points: DataFrame) -> DataFrame:
    """Maps of blocks of commits -> maps of pairs of neighbouring blocks; one without its pair is left out."""
    w = Window.partitionBy("_f", "block").orderBy("start")
    d = points.withColumn("_end", F.lead("start").over(w)).withColumn("_up", F.expr("shiftright(block, 1)")).withColumn("_later", (F.col("block") % 2) == 1)
    paired = points.where("block % 2 = 1").select("_f", F.expr("shiftright(block, 1)").alias("_up")).distinct()
    new = d.where(F.col("_later") & (F.col("shift") == NEW)).select("_f", F.col("_up").alias("block"), "start", "shift")
    # both blocks' points by line number between them: the earlier block's own, the later one's shifted
    d = d.where(~(F.col("_later") & (F.col("shift") == NEW))).withColumn("_at", F.when(F.col("_later"), F.col("start") + F.col("shift")).otherwise(F.col("start")))
    run = Window.partitionBy("_f", "_up").orderBy("_at", "_later").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = (d.withColumn("_below", F.last(F.when(~F.col("_later"), F.col("shift")), ignorenulls=True).over(run))
         .withColumn("_above", F.last(F.when(F.col("_later"), F.struct("start", "shift", "_end")), ignorenulls=True).over(run)))
    both = lambda a, b: F.when(b == NEW, F.lit(NEW)).otherwise(a + b)
    later = d.where("_later").select("_f", F.col("_up").alias("block"), "start", both(F.col("shift"), F.col("_below")).alias("shift"))
    inside = (F.col("_at") > F.col("_above.start") + F.col("_above.shift")) & \
        (F.col("_above._end").isNull() | (F.col("_at") < F.col("_above._end") + F.col("_above.shift")))
    earlier = d.where(~F.col("_later") & F.coalesce(inside, F.lit(False))).select(
        "_f", F.col("_up").alias("block"), (F.col("_at") - F.col("_above.shift")).alias("start"), both(F.col("_above.shift"), F.col("shift")).alias("shift"))
    every = later.unionByName(earlier).unionByName(new)
    return joined_up(every.join(paired.withColumnRenamed("_up", "block"), ["_f", "block"], "left_semi"))


def shift_at(queries: DataFrame, points: DataFrame) -> DataFrame:
    """``queries`` (_f, block, line, ...) with ``shift``: what their block's map says of their line."""
    return asof_last(queries, points, ["_f", "block"], "line", "start", "shift", inclusive=True,
                     bucket=lambda at: F.floor(at / TOGETHER), out="shift")


def introducing_commits_by_line(lines: DataFrame, payload: list[str], repo: str = "repo", path: str = "file", ts: str = "ts",
                                sha: str = "sha", pos: str = "pos", sign: str = "sign", old_no: str = "old_no", new_no: str = "new_no") -> DataFrame:
    """J09 by position: for each removed line the commit that put that very line into the file.

    ``lines``: the diff lines of every commit of the files (X02: position, sign, line numbers before and after);
    commits of a file are ordered by (``ts``, ``sha``).  A line older than the first commit
    given gets ``blame_error``.  Rows without repository, path or sha take no part.  One pass for
    each doubling of the commits of the longest history, each cut in the shared checkpoint folder."""
    checkpoint_dir(lines.sparkSession)
    d = (lines.where(F.col(sign).isin("+", "-") & F.col(repo).isNotNull() & F.col(path).isNotNull() & F.col(sha).isNotNull())
         .select(F.struct(F.col(repo).alias("repo"), F.col(path).alias("path")).alias("_f"), F.col(ts).alias("_ts"), F.col(sha).alias("_sha"),
                 F.col(pos).alias("pos"), F.col(sign).alias("sign"), F.col(old_no).cast("long").alias("old_no"), F.col(new_no).cast("long").alias("new_no"),
                 F.struct(*payload).alias("_row")))
    commits = rank_in_group(d.select("_f", "_ts", "_sha").distinct(), "_f", "_ts", "_sha", bucket="month")
    commits = commits.select("_f", "_ts", "_sha", (F.col("rank") - 1).cast("long").alias("_c")).checkpoint()
    d = d.join(commits, ["_f", "_ts", "_sha"]).checkpoint()
    most = commits.agg(F.max("_c")).first()[0] or 0
    depth = max(0, int(most).bit_length() - 1)
    levels = [change_points(d.drop("_row")).checkpoint()]
    for _ in range(depth):
        levels.append(composed(levels[-1]).checkpoint())

    q = d.where("sign = '-'").select("_f", "_row", F.col("old_no").alias("line"), F.col("_c").alias("_left"),
                                     F.lit(None).cast("int").alias("_level"), F.lit(None).cast("long").alias("block"))
    columns = q.columns
    new = F.col("shift") == NEW
    for i, points in enumerate(levels):  # back through whole blocks, smallest first
        here = F.col("_level").isNull() & (F.expr(f"shiftright(_left, {i}) & 1") == 1)
        asked = q.where(here).withColumn("block", F.expr(f"shiftright(_left, {i}) - 1"))
        found = shift_at(asked, points).withColumn("line", F.when(new, F.col("line")).otherwise(F.col("line") + F.col("shift"))) \
            .withColumn("_left", F.when(new, F.col("_left")).otherwise(F.col("_left") - (1 << i))) \
            .withColumn("_level", F.when(new, F.lit(i))).withColumn("block", F.when(new, F.col("block")))
        q = q.where(~here).unionByName(found.select(*columns)).checkpoint()
    for i in range(depth, 0, -1):  # into the half that introduced it
        here = F.coalesce(F.col("_level") == i, F.lit(False))
        asked = q.where(here).withColumn("block", F.col("block") * 2 + 1)
        found = shift_at(asked, levels[i - 1]).withColumn("line", F.when(new, F.col("line")).otherwise(F.col("line") + F.col("shift"))) \
            .withColumn("block", F.when(new, F.col("block")).otherwise(F.col("block") - 1)).withColumn("_level", F.lit(i - 1))
        q = q.where(~here).unionByName(found.select(*columns)).checkpoint()
    origin = commits.select("_f", F.col("_c").alias("block"), F.col("_sha").alias("introducing_commit"))
    out = q.join(origin, ["_f", "block"], "left")
    return out.select("_row.*", F.coalesce(F.col("introducing_commit").cast("string"), F.lit("blame_error")).alias("introducing_commit"))
