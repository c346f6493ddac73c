"""Change sets of working trees from their status listings (row N6).

A listing is what ``git status --porcelain`` prints: two letters (what is
staged, what is not), a space and a path. Renames name both paths; paths with odd characters
are quoted. A workspace of several repositories has one listing for each, and
its paths begin with the repository's folder.

Defined results: a null listing is empty; lines that are no entries are passed
over; a null folder is the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unquoted(path: Column) -> Column:
    inner = F.regexp_extract(path, r'^"((?:\\.|[^"\\])*)"$', 1)
    return F.when(path.startswith('"'), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(path)


def _kind(letter: Column) -> Column:
    return F.when(letter.isin("A", "C"), "added").when(letter == "D", "deleted").when(letter == "R", "renamed").when(letter.isin("M", "T", "U"), "modified")


def status_changes(listings: DataFrame) -> DataFrame:
    """listings (folder, status) -> path, old_path (of renames), stage (staged, unstaged or untracked), change; a path can be both staged and not."""
    line = F.explode(F.regexp_extract_all(F.coalesce("status", F.lit("")), F.lit(r"(?m)^[ MTADRCU?!]{2} [^\n]+$"), F.lit(0)))
    rows = listings.select(F.coalesce("folder", F.lit("")).alias("folder"), line.alias("line"))
    x, y, rest = F.substring("line", 1, 1), F.substring("line", 2, 1), F.expr("substring(line, 4)")
    renamed = (x == "R") | (y == "R") | (x == "C") | (y == "C")
    pair = F.split(rest, " -> ", 2)
    rows = rows.select("folder", x.alias("x"), y.alias("y"), F.when(renamed & (F.size(pair) == 2), F.get(pair, F.lit(0))).alias("old"), F.when(renamed & (F.size(pair) == 2), F.get(pair, F.lit(1))).otherwise(rest).alias("new"))
    under = lambda c: F.when(c.isNotNull(), F.when(F.col("folder") == "", _unquoted(c)).otherwise(F.concat("folder", F.lit("/"), _unquoted(c))))
    each = F.when(F.col("x") == "?", F.array(F.struct(F.lit("untracked").alias("stage"), F.lit("added").alias("change")))).otherwise(
        F.filter(F.array(F.struct(F.lit("staged").alias("stage"), _kind(F.col("x")).alias("change")), F.struct(F.lit("unstaged").alias("stage"), _kind(F.col("y")).alias("change"))), lambda s: s["change"].isNotNull())
    )
    return rows.where("x <> '!'").select(under(F.col("new")).alias("path"), under(F.col("old")).alias("old_path"), F.explode(each).alias("c")).select("path", "old_path", "c.stage", "c.change")


def files_to_index(changes: DataFrame) -> DataFrame:
    """path and whether it is read again or taken out of the index: a rename takes out its old path."""
    gone = F.max(F.col("change") == "deleted").alias("gone")
    now = changes.groupBy("path").agg(gone).select("path", F.when(F.col("gone"), "remove").otherwise("index").alias("action"))
    moved = changes.where("change = 'renamed' AND old_path IS NOT NULL").select(F.col("old_path").alias("path")).distinct()
    return now.unionByName(moved.join(now.select("path"), "path", "left_anti").withColumn("action", F.lit("remove")))
