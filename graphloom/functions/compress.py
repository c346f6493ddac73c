"""What a diff or a test run says, as rows and totals (row J, text compressors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files, or failed tests, that a total names.
MOST_NAMED = 20


def _numbered(texts: DataFrame) -> DataFrame:
    """id, line, s of each line of ``texts`` (id, text)."""
    return texts.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line", "s"))


def diff_files(texts: DataFrame) -> DataFrame:
    """id, path, added, removed of every file that a diff changes, each file once.

    A file begins at ``diff --git`` or at ``---`` with ``+++`` below it; added
    and removed lines count inside hunks only. A deleted file keeps its old
    path. Where a text has no file header, its ``path | n ++-`` lines count: n
    is split as the signs are. Null and empty texts give no row.
    """
    by_line = Window.partitionBy("id").orderBy("line")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("s")
    header = s.startswith("diff --git ") | (s.startswith("--- ") & F.coalesce(F.lead("s").over(by_line).startswith("+++ "), F.lit(False)))
    place = F.when(header, "file").when(s.startswith("@@ "), "hunk")
    side = lambda c, letter: F.when(c.startswith(letter + "/"), F.substr(c, F.lit(3))).otherwise(c)
    after = F.substring_index(F.substr(s, F.lit(5)), "\t", 1)  # of "--- path" and "+++ path", without a date
    lines = _numbered(texts).withColumn("mark", place).withColumn("place", F.last("mark", ignorenulls=True).over(so_far))
    path = (
        F.when(s.startswith("diff --git "), F.substring_index(s, " b/", -1))
        .when((F.col("place") == "file") & s.startswith("--- ") & (after != "/dev/null"), side(after, "a"))
        .when((F.col("place") == "file") & s.startswith("+++ ") & (after != "/dev/null"), side(after, "b"))
    )
    lines = lines.withColumn("path", F.last(path, ignorenulls=True).over(so_far))
    inside = F.col("place") == "hunk"
    sign = lambda x: F.sum(F.when(inside & s.startswith(x), 1).otherwise(0)).alias({"+": "added", "-": "removed"}[x])
    hunks = lines.where("path is not null").groupBy("id", "path").agg(sign("+"), sign("-"))

    cells = F.split(s, "\\|")
    right = F.split(F.trim(F.element_at(cells, -1)), " +")
    n, signs = F.element_at(right, 1).try_cast("long"), F.try_element_at(right, F.lit(2))
    plus = F.length(F.replace(signs, F.lit("-"), F.lit(""))) / F.length(signs)
    stat = lines.where("place is null").withColumn("n", F.when(F.size(cells) == 2, n)).where("n is not null")
    added = F.coalesce(F.round(F.col("n") * plus), F.lit(0)).cast("long")
    stat = stat.select("id", F.trim(cells[0]).alias("path"), added.alias("added"), (F.col("n") - added).alias("removed"))
    stat = stat.join(hunks.select("id").distinct(), "id", "left_anti").groupBy("id", "path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return hunks.unionByName(stat)


def diff_totals(texts: DataFrame, most: int = MOST_NAMED) -> DataFrame:
    """id, files, added, removed and one line about the files with the most changes, of every text."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.col("added") + F.col("removed")), "path"))
    said = F.format_string("%s +%d -%d", "path", "added", "removed")
    files = diff_files(texts).withColumn("rank", rank)
    named = F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", said.alias("said")))))
    out = files.groupBy("id").agg(F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.array_join(F.transform(named, lambda x: x["said"]), "; ").alias("named"))
    return texts.select("id").distinct().join(out, "id", "left").fillna(0, ["files", "added", "removed"]).fillna("", ["named"])


def test_results(texts: DataFrame) -> DataFrame:
    """id, test, status (ok, failed or ignored) of every ``test name ... status`` line; a test named twice has its last status."""
    parts = F.split("s", " \\.\\.\\. ")
    first = F.lower(F.regexp_extract(F.element_at(parts, -1), "^(\\p{L}+)", 1))
    lines = _numbered(texts).where(F.trim("s").startswith("test ") & (F.size(parts) == 2))
    found = lines.select("id", "line", F.trim(F.substr(F.trim(parts[0]), F.lit(5))).alias("test"), first.alias("status")).where(F.col("status").isin("ok", "failed", "ignored"))
    return found.groupBy("id", "test").agg(F.max_by("status", "line").alias("status"))


def test_totals(texts: DataFrame, most: int = MOST_NAMED) -> DataFrame:
    """id, passed, failed, ignored and the first failed tests by name, of every text."""
    count = lambda status: F.count(F.when(F.col("status") == status, 1)).alias({"ok": "passed"}.get(status, status))
    bad = F.sort_array(F.collect_list(F.when(F.col("status") == "failed", F.col("test"))))
    out = test_results(texts).groupBy("id").agg(count("ok"), count("failed"), count("ignored"), F.array_join(F.slice(bad, 1, most), "; ").alias("named"))
    return texts.select("id").distinct().join(out, "id", "left").fillna(0, ["passed", "failed", "ignored"]).fillna("", ["named"])


def shortened(text: Column, most: int) -> Column:
    """The first and last characters of a long text around a mark that says how many are left out."""
    half = F.lit(most // 2)
    cut = F.concat(F.substr(text, F.lit(1), half), F.format_string("[%d left out]", F.length(text) - 2 * half), F.substr(text, F.length(text) - half + 1))
    return F.when(F.length(text) > most, cut).otherwise(text)
