"""Line dedup by distinct-site spread.

A line (trimmed of spaces) is boilerplate if it stands on `min_sites` or more
distinct sites; every one of its occurrences is removed.  A HyperLogLog sketch
of sites for each line hash merges by aggregation; only lines whose estimate
lies within three standard errors (and one site) of the threshold are counted
exactly.  Lines travel as hashes with coordinates, never as text; while the
lines in question are at most BROADCAST_ROWS, they go to the occurrences, and
no occurrence is shuffled by its line.

Defined results: a null text has no lines and stays null; blank lines are
never removed; with `spare_whole`, a text that would lose all its lines keeps
them; with `spare_copies` it does so only if the whole text stands in rows of
several ids (it is a copy, not boilerplate, and left to document dedup); rows whose site is null spread no line, yet lose boilerplate;
repeated rows add nothing to the spread; null ids are kept; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specblock.llm.common import broadcast_if_small
from specblock.session import cut

MIN_SITES = 8
#: Relative standard error of the sketches.
ERROR = 0.05
BROADCAST_ROWS = 500_000


def lines_of(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def occurrences(rows: DataFrame) -> DataFrame:
    """(id, tag, site, pos, h, h2) of every line that is not blank."""
    exploded = rows.select("id", "tag", "site", F.posexplode(lines_of("text")).alias("pos", "line"))
    line = F.trim("line")
    return exploded.where(line != "").select("id", "tag", "site", "pos", F.xxhash64(line).alias("h"), F.hash(line).alias("h2"))


def boilerplate(occ: DataFrame, min_sites: int, error: float = ERROR) -> DataFrame:
    """(h, h2) of the lines that stand on min_sites or more distinct sites."""
    margin = 1 + 3 * error * min_sites
    spread = occ.groupBy("h", "h2").agg(F.approx_count_distinct("site", error).alias("est"))
    spread = cut(spread.where(F.col("est") >= min_sites - margin))
    near = cut(spread.where(F.col("est") <= min_sites + margin).select("h", "h2"))
    exact = occ.join(broadcast_if_small(near, BROADCAST_ROWS), ["h", "h2"], "left_semi").where("site is not null").groupBy("h", "h2", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h", "h2").agg(F.sum("one").alias("n")).where(F.col("n") >= min_sites)
    return spread.where(F.col("est") > min_sites + margin).select("h", "h2").union(exact.select("h", "h2"))


def dedup_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, keep: list[str] | None = None, spare_whole: bool = False, spare_copies: bool = False, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """The columns keep of every row (the id alone by default), kept_text, n_lines and n_removed."""
    keep = [id_col] if keep is None else keep
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(id_col).alias("id"), F.hash(text_col).alias("tag"), F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    occ = occurrences(rows)
    drop = cut(boilerplate(occ, min_sites))
    gone = occ.join(broadcast_if_small(drop, BROADCAST_ROWS), ["h", "h2"], "left_semi").groupBy("id", "tag").agg(F.collect_set("pos").alias("gone"))
    gone = gone.withColumnsRenamed({"id": "__id", "tag": "__tag"}).hint("shuffle_hash")
    if spare_copies:
        # Whole texts travel as hashes; rows that repeat an id add nothing.
        whole = rows.where("text is not null").groupBy(F.xxhash64("text").alias("__whole"), "id").agg(F.lit(1).alias("one")).groupBy("__whole").agg(F.sum("one").alias("__ids"))
        copies = cut(whole.where("__ids > 1").select("__whole", F.lit(True).alias("copied")))
        rows = rows.withColumn("__whole", F.xxhash64("text")).join(broadcast_if_small(copies, BROADCAST_ROWS), "__whole", "left")
    # Lines travel split, in place of the text: each is then read once, however many there are.
    rows = rows.withColumn("lines", lines_of("text")).drop("text", "site")
    joined = rows.join(gone, rows["id"].eqNullSafe(gone["__id"]) & (rows["tag"] == gone["__tag"]), "left")
    lines = F.col("lines")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    untouched = F.col("gone").isNull()
    lost = F.size("gone") == F.size(F.filter(lines, lambda line: F.trim(line) != ""))
    if spare_whole:
        untouched = untouched | lost
    if spare_copies:
        untouched = untouched | (F.col("copied").isNotNull() & lost)
    return joined.select(
        "kept.*",
        F.when(untouched, F.array_join(lines, "\n")).otherwise(left).alias("kept_text"),
        F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(untouched, 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
