"""Third-party files in a source tree: files vote by name and banner, votes raise whole folders, folders carry their files.

Folders meet files by the prefixes of their paths: a path becomes one row for each folder above it, which is a few rows, and
joins are on equal prefixes. Counts of a folder are aggregated before they meet anything, so a folder with very many files is no task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that hold other people's code by their name, and folders below which a library often has one of its own.
VENDOR_FOLDER = r"(?i)(^|/)(vendors?|third[-_]?party|bower_components|node_modules|jspm_packages|external[-_]libs)(/|$)"
ASSET_PARENTS = ["scripts", "content", "js", "css", "styles", "assets", "lib", "libs", "plugins"]
ASSET = r"(?i)\.(js|css|mjs|scss|less)$"
#: A version at the end of a folder's name.
VERSIONED = r"(?i)[-_.]v?[0-9]+(\.[0-9]+)+$"
#: What the first lines of a library say.
BANNER = r"(?is)^\s*(/\*!|//CdnPath=|/\*+[^*]{0,200}(@license|@preserve|licensed under|\(c\) [0-9]{4}))"


def folders_above(path: Column) -> Column:
    """The folders that a path is in, from the outermost on; none for a file at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def stem_of(path: Column) -> Column:
    """A file's name without extension, build (.min, .debug, .slim, .bundle) and version, in lower case."""
    name = F.regexp_replace(F.lower(F.substring_index(path, "/", -1)), r"\.(js|css|mjs|scss|less)$", "")
    return F.regexp_replace(F.regexp_replace(name, r"[.-](min|debug|slim|bundle|prod)\b", ""), r"[-_.]v?[0-9]+(\.[0-9]+)*$", "")


def under(files: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """The rows of ``files`` in or below any of the folders, or named by one (an ignored file); each once, compared without case."""
    above = F.transform(F.concat(folders_above(F.col(path)), F.array(path)), lambda x: F.lower(x))
    asked = folders.select(F.lower(F.regexp_replace(folder, "/+$", "")).alias("__folder")).where("__folder <> ''").distinct()
    found = files.select(path, F.explode(above).alias("__folder")).join(asked, "__folder", "left_semi").select(path).distinct()
    return files.join(found, path, "left_semi")


def own_votes(files: DataFrame, packages: DataFrame, path: str, head: str) -> DataFrame:
    """(path, asset, vote): whether a file is an asset, and what its own name or first lines say: folder, tooling, package, banner, sibling or null.

    ``packages`` (package) are the client packages that the projects declare. A sibling is another build of a file in its folder that is voted for by package or
    banner, or a companion named after it in the folder that has its name.
    """
    asset = F.col(path).rlike(ASSET)
    declared = packages.select(F.explode(F.array(F.lower("package"), F.lower(F.substring_index("package", ".", 1)))).alias("stem")).where(F.length("stem") > 2).distinct().withColumn("declared", F.lit(True))
    rows = files.select(F.col(path).alias("path"), F.col(head).alias("head"), asset.alias("asset"), stem_of(F.col(path)).alias("stem"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder")).join(declared, "stem", "left")
    vote = F.when(F.col("path").rlike(VENDOR_FOLDER), "folder").when(F.col("asset") & F.col("path").rlike(r"(?i)(\.intellisense|-vsdoc)\.js$"), "tooling").when(F.col("asset") & F.col("declared").isNotNull(), "package").when(F.col("asset") & F.col("head").rlike(BANNER), "banner")
    rows = rows.withColumn("vote", vote)
    leaders = rows.where("vote IN ('package', 'banner')").select("folder", "stem").distinct()
    same = leaders.withColumn("same", F.lit(True))
    named = leaders.where(F.lower(F.substring_index("folder", "/", -1)) == F.col("stem")).groupBy("folder").agg(F.first("stem").alias("family"))
    rows = rows.join(same, ["folder", "stem"], "left").join(named, "folder", "left")
    beside = F.col("asset") & (F.col("same").isNotNull() | F.col("stem").startswith(F.concat("family", F.lit("-"))) | F.col("stem").startswith(F.concat("family", F.lit("."))))
    return rows.select("path", "asset", F.coalesce("vote", F.when(beside, "sibling")).alias("vote"))


def library_folders(votes: DataFrame, least: int = 3) -> DataFrame:
    """(folder, assets, voted): folders that hold a copied library.

    Those whose name ends in a version and that hold an asset voted for, and those right inside a folder for assets in
    which at least ``least`` assets, and half of all, are voted for. Of folders in each other only the outermost is given.
    """
    counts = votes.where("asset").select(F.explode(folders_above(F.col("path"))).alias("folder"), "vote").groupBy("folder").agg(F.count("*").alias("assets"), F.count("vote").alias("voted"))
    name, parent = F.substring_index("folder", "/", -1), F.lower(F.regexp_extract("folder", r"([^/]*)/[^/]*$", 1))
    found = counts.where((name.rlike(VERSIONED) & (F.col("voted") > 0)) | (parent.isin(ASSET_PARENTS) & (F.col("voted") >= least) & (2 * F.col("voted") >= F.col("assets"))))
    inside = found.select("folder", F.explode(folders_above(F.col("folder"))).alias("outer")).join(found.select(F.col("folder").alias("outer")), "outer", "left_semi").select("folder").distinct()
    return found.join(inside, "folder", "left_anti")


def vendored(files: DataFrame, packages: DataFrame, path: str = "path", head: str = "head", least: int = 3) -> DataFrame:
    """(path, why) of the files that are other people's: why is their own vote, or library for those in a folder that the votes raise."""
    votes = own_votes(files, packages, path, head)
    raised = under(votes.where("vote IS NULL"), "path", library_folders(votes, least), "folder")
    return votes.where("vote IS NOT NULL").select("path", F.col("vote").alias("why")).union(raised.select("path", F.lit("library")))
