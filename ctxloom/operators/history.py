"""Version history: commits, authors and files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions import text as X
from ctxloom.operators.resolve import edge

MOST_FILES, LEAST_TOGETHER = 25, 2


def parse_log(log: DataFrame, repo: str) -> DataFrame:
    """``log`` (value: text of git log with a NUL before each record and unit separators in its header): sha, author, email, epoch, subject, files.

    Records with fewer than five header fields or without files are left out.
    """
    record = log.select(F.explode(F.split("value", "\u0000")).alias("r")).where("length(r) > 0")
    lines = record.select(F.split("r", "\n").alias("l"))
    head = F.split(F.col("l")[0], "\u001f")
    files = F.filter(F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: F.replace(F.trim(x), F.lit("\\"), F.lit("/"))), lambda x: F.length(x) > 0)
    rows = lines.select(head.alias("h"), files.alias("files")).where("size(h) >= 5 and size(files) > 0")
    return rows.select(F.lit(repo).alias("repo"), F.col("h")[0].alias("sha"), F.col("h")[1].alias("author"), F.col("h")[2].alias("email"), F.col("h")[3].cast("long").alias("epoch"), F.col("h")[4].alias("subject"), "files")


def authors(commits: DataFrame) -> DataFrame:
    """(email, name, commits): the name of an author's first commit, and how many commits they have."""
    return commits.groupBy("email").agg(F.min_by("author", F.struct("epoch", "sha")).alias("name"), F.count_distinct("sha").alias("commits"))


def modified_by(changes: DataFrame) -> DataFrame:
    """``changes`` (file, commit), each pair once, as precise edges."""
    return changes.select("file", "commit").distinct().select(*edge("file", "commit", "modified_by", 1.0, "precise"))


def cochange_pairs(changes: DataFrame, most_files: int = MOST_FILES, least: int = LEAST_TOGETHER) -> DataFrame:
    """``changes`` (file, commit) to (a, b, n, weight): unordered pairs of files with ``least`` commits in common or more, weight ln(1 + n).

    Commits of more than ``most_files`` files say nothing about pairs and are skipped, so a commit gives at most most_files squared / 2 pairs.
    """
    once = changes.select("file", "commit").distinct()
    sized = once.withColumn("size", F.count("*").over(Window.partitionBy("commit"))).where(F.col("size") <= most_files)
    grouped = sized.groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files"))
    left = grouped.select("files", F.posexplode("files").alias("k", "a"))
    pairs = left.select("a", F.explode(F.slice("files", F.col("k") + 2, F.size("files"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("weight", F.log1p("n"))


def cochange_edges(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))
    return both.select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit("co_changed_with").alias("kind"), F.lit("precise").alias("provenance"), F.lit(1.0).alias("confidence"), "weight")


def cochange_scores(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score): what changes together with ``seeds`` (id) and their files; a partner gets 1, a symbol in it half, over the largest."""
    kind = lambda k: edges.where(F.col("kind") == k)
    homes = seeds.select(F.col("id").alias("src")).join(kind("defined_in"), "src").select(F.col("dst").alias("id"))
    sources = seeds.select("id").unionByName(homes)
    partners = sources.select(F.col("id").alias("src")).join(kind("co_changed_with"), "src").select(F.col("dst").alias("id"))
    inside = partners.select(F.col("id").alias("src")).join(kind("contains"), "src").select(F.col("dst").alias("id"), F.lit(0.5).alias("s"))
    sums = partners.withColumn("s", F.lit(1.0)).unionByName(inside).groupBy("id").agg(F.sum("s").alias("s"))
    top = sums.agg(F.greatest(F.max("s"), F.lit(1e-6)).alias("top"))
    return sums.crossJoin(F.broadcast(top)).select("id", (F.col("s") / F.col("top")).alias("score"))  # top is one row


def commit_nodes(commits: DataFrame) -> DataFrame:
    return commits.select(X.node_id("commit", "repo", "sha").alias("id"), F.col("subject").alias("name"), "repo", F.col("epoch").alias("mtime"))
