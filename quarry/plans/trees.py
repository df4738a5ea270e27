"""Queries over trees of files whose paths and first lines come from table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import vendored as V
from quarry.plans.registry import query

#: Files of each part: in a folder for its size below Scripts, in a versioned folder, a build beside them, and the project's own.
_FILES = """f(path, head) AS (SELECT 'app' || p_partkey % 7 || '/Scripts/' || CASE WHEN p_size % 3 = 0 THEN 'plug' ELSE 'own' END || p_size || '/w' || p_partkey || '.js', CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 OR p_partkey % 11 = 0 THEN '/*! lib v' || p_size || ' | MIT */' ELSE 'var x' || p_partkey END FROM part
UNION ALL SELECT 'app' || p_partkey % 7 || '/Scripts/' || CASE WHEN p_size % 3 = 0 THEN 'plug' ELSE 'own' END || p_size || '/w' || p_partkey || '.min.js', 'var y' FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT 'app' || p_partkey % 7 || '/ui/kit-' || p_size || '.0/' || p_brand || '.css', CASE WHEN p_size > 40 THEN '/*! kit */' ELSE 'a{}' END FROM part GROUP BY ALL
UNION ALL SELECT 'app' || p_partkey % 7 || '/vendor/v' || p_partkey || '.cs', 'class V' FROM part WHERE p_partkey % 13 = 0
UNION ALL SELECT 'app' || p_partkey % 7 || '/js/jquery-' || p_size || '.1.js', 'x' FROM part WHERE p_partkey % 17 = 0 GROUP BY ALL
UNION ALL SELECT 'app' || p_partkey % 7 || '/src/M' || p_partkey || '.cs', '/*! not an asset */' FROM part)"""
_VOTES = r"""v AS (SELECT *, regexp_matches(path, '\.(js|css)$') AS asset, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(path, '[^/]*$')), '\.(js|css)$', ''), '[.-]min\b', ''), '[-_.]v?[0-9]+(\.[0-9]+)*$', '') AS stem FROM f),
w AS (SELECT *, CASE WHEN contains(path, '/vendor/') THEN 'folder' WHEN asset AND stem = 'jquery' THEN 'package' WHEN asset AND starts_with(head, '/*!') THEN 'banner' END AS vote FROM v),
o AS (SELECT w.path, asset, folder, coalesce(vote, CASE WHEN asset AND s.stem IS NOT NULL THEN 'sibling' END) AS vote FROM w LEFT JOIN (SELECT DISTINCT folder, stem FROM w WHERE vote IN ('package', 'banner')) s USING (folder, stem)),
l AS (SELECT folder, count(*) AS assets, count(vote) AS voted FROM o WHERE asset GROUP BY 1 HAVING regexp_matches(folder, '/kit-[0-9]+\.0$') AND count(vote) > 0 OR regexp_matches(folder, '/Scripts/[^/]*$') AND count(vote) >= 3 AND 2 * count(vote) >= count(*))"""


def _files(t):
    p, n, b = F.col("p_partkey"), F.col("p_size"), F.col("p_brand")
    app, plug = F.concat(F.lit("app"), p % 7), F.when(n % 3 == 0, "plug").otherwise("own")
    path = lambda *x: F.concat(app, *[F.lit(y) if isinstance(y, str) else y for y in x]).alias("path")
    banner = F.when((n % 3 == 0) & (p % 2 == 0) | (p % 11 == 0), F.concat(F.lit("/*! lib v"), n, F.lit(" | MIT */"))).otherwise(F.concat(F.lit("var x"), p))
    parts = [
        t.part.select(path("/Scripts/", plug, n, "/w", p, ".js"), banner.alias("head")), t.part.where(p % 4 == 1).select(path("/Scripts/", plug, n, "/w", p, ".min.js"), F.lit("var y")),
        t.part.select(path("/ui/kit-", n, ".0/", b, ".css"), F.when(n > 40, "/*! kit */").otherwise("a{}")).distinct(), t.part.where(p % 13 == 0).select(path("/vendor/v", p, ".cs"), F.lit("class V")),
        t.part.where(p % 17 == 0).select(path("/js/jquery-", n, ".1.js"), F.lit("x")).distinct(), t.part.select(path("/src/M", p, ".cs"), F.lit("/*! not an asset */")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


@query(f"WITH {_FILES}, {_VOTES} SELECT path, coalesce(vote, 'library') AS why FROM o WHERE vote IS NOT NULL OR folder IN (SELECT folder FROM l)")
def vendored_files(t):
    return V.vendored(_files(t), t.region.limit(1).select(F.lit("jQuery.UI").alias("package")))


@query(f"WITH {_FILES}, {_VOTES} SELECT folder, assets, voted FROM l")
def library_folders(t):
    return V.library_folders(V.own_votes(_files(t), t.region.limit(1).select(F.lit("jQuery.UI").alias("package")), "path", "head"))


@query(f"WITH {_FILES} SELECT path FROM f WHERE starts_with(path, 'app3/') OR regexp_matches(path, '^app[0-9]/Scripts/own[0-9]*[13]/') OR path IN (SELECT 'app' || p_partkey % 7 || '/src/M' || p_partkey || '.cs' FROM part WHERE p_partkey % 5 = 0)")
def git_ignored(t):
    p, n = F.col("p_partkey"), F.col("p_size")
    app = F.concat(F.lit("app"), p % 7)
    ignored = t.part.where(n % 10 == 1).select(F.concat(app, F.lit("/Scripts/own"), n, F.lit("/")).alias("folder")).union(t.part.where(n % 10 == 3).select(F.concat(app, F.lit("/scripts/OWN"), n)))
    ignored = ignored.union(t.part.where(p % 5 == 0).select(F.concat(app, F.lit("/src/M"), p, F.lit(".cs")))).union(t.part.where(p % 7 == 3).select(F.lit("app3/")))
    return V.under(_files(t), "path", ignored, "folder").select("path")
