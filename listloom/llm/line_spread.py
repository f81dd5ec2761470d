"""Line deduplication by spread: lines found on many sites are boilerplate and stay in one place only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.llm.common import stored

MIN_SITES = 5
#: Sketches of 2**12 buckets are within 2 % as a rule; lines whose estimate is between half the
#: threshold and twice the threshold are counted exactly.
SKETCH_BITS = 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_places(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """(doc_id, mark, place, a, b, site): every line that holds more than spaces, by a 128-bit hash of the line without outer spaces."""
    named = F.concat(F.lit("="), F.coalesce(F.col(site).cast("string"), F.lit("")))  # as sketches leave out empty strings
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), named.alias("site"), F.posexplode(_lines(F.col(text))).alias("place", "line"))
    line = F.trim("line")
    return rows.where(line != "").select("doc_id", "mark", "place", F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"), "site")


def wide_lines(places: DataFrame, min_sites: int) -> DataFrame:
    """(a, b, first): lines on at least ``min_sites`` sites, with their first place by doc_id."""
    spread = places.groupBy("a", "b").agg(
        F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "place")).alias("first"))
    # a line that occurs fewer times than that is on fewer sites
    judged = stored(spread.where(F.col("n") >= min_sites).select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    near = judged.where(F.col("sites").between(min_sites / 2, min_sites * 2))
    # one row per line and site before the join: the hottest line has as many rows as there are sites
    exact = (places.select("a", "b", "site").distinct().join(near.select("a", "b"), ["a", "b"], "left_semi")
             .groupBy("a", "b").count().where(F.col("count") >= min_sites).select("a", "b"))
    return judged.where(F.col("sites") > min_sites * 2).select("a", "b", "first").union(near.join(exact, ["a", "b"], "left_semi").select("a", "b", "first"))


def drop_wide_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with lines found on ``min_sites`` or more sites cut from ``text``, but for their first place.

    A line is what stands between line breaks, compared without outer spaces. Sketches of sites per line
    merge by aggregation; lines near the threshold are counted exactly. The first place goes by doc_id and
    position, so nothing is lost from the whole. Blank lines stay. All rows and columns stay; documents
    may become shorter or empty. One more column, ``n_removed`` (lines cut), is appended; a column of that
    name in ``docs`` is replaced.

    A null text stays null. A null site is a site of its own, the same as "". Rows that agree in id and
    text are one document listed twice: both keep what one keeps. Null ids come first. An empty table
    gives an empty result.
    """
    places = stored(line_places(docs, doc_id, text, site), "line-places")
    wide = wide_lines(places, min_sites)
    base = docs.drop("n_removed")
    # names that no column of the table has
    own_id, own_mark, cut = (name + "_" * max(map(len, base.columns)) for name in ("id", "mark", "cut"))
    doomed = (places.join(wide, ["a", "b"]).where(~F.struct("doc_id", "mark", "place").eqNullSafe(F.col("first")))
              .groupBy(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)).agg(F.collect_set("place").alias(cut)))
    joined = base.join(doomed, F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_mark)), "left")
    lines = _lines(F.col(text))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut)), lambda i: F.get(lines, i))
    return joined.select(*(F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) if c == text else F.col(f"`{c}`") for c in base.columns),
                         F.coalesce(F.size(cut), F.lit(0)).alias("n_removed"))


#: The rows of ``op10_line_spread`` in DuckDB SQL.
LINE_SPREAD_SQL = f"""
WITH places AS (
    SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents
), wide AS (
    SELECT trim(line) AS line, min((doc_id, place)) AS first FROM places WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}
), marked AS (
    SELECT p.doc_id, p.place, p.line, w.line IS NOT NULL AND (p.doc_id, p.place) <> w.first AS cut FROM places p LEFT JOIN wide w ON trim(p.line) = w.line
)
SELECT d.doc_id, m.n_lines, m.n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.text, '') END AS text
FROM documents d LEFT JOIN (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT cut) AS text
    FROM marked GROUP BY doc_id) m USING (doc_id)
"""
