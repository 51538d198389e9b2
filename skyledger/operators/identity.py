"""Station ids that differ from file to file: their variants, which of them are observed, reports.

Ids are trimmed text; empty ones and the words for missing values are null. All work is done on distinct
ids, which then go back to the rows by one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Texts that stand for a missing id, id columns in order of preference, networks by a part
# of their name and the column that holds their id, the network whose files join two ids in one.
MISSING = ("", "nan", "none", "nat")
ID_COLUMNS = ("module_final", "src_id", "station_id", "_id", "station", "id")
NETWORK_COLUMNS = (("ows", "src_id"), ("netatmo", "module_final"), ("wunderground", "module_final"))
JOINED_IDS = "netatmo"
#: Ways to read an id column as a whole, by name: the separator, and which side of it counts.
ALIASES = {"raw": None, "after_last_underscore": ("_", -1), "before_first_underscore": ("_", 1), "after_last_doublepipe": ("||", -1), "after_last_slash": ("/", -1)}


def cleaned(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def variants(c: Column) -> Column:
    """What an id may be called elsewhere, the likeliest first: as it is, behind its last and before its
    first underscore. Null if it is missing."""
    text = cleaned(c)
    parts = F.filter(F.transform(F.split(text, "_"), lambda p: F.trim(p)), lambda p: p != "")
    ends = F.when(F.contains(text, F.lit("_")), F.array(F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(1))))
    every = F.concat(F.array(text), F.coalesce(ends, F.array().cast("array<string>")))
    return F.when(text.isNotNull(), F.array_distinct(F.filter(every, lambda v: v.isNotNull())))


def known(observed: DataFrame, column: str = "station_id") -> DataFrame:
    return observed.select(cleaned(F.col(column)).alias("_known")).where("_known IS NOT NULL").distinct()


def resolve(ids: DataFrame, observed: DataFrame, column: str = "station_id", network: str | None = None) -> DataFrame:
    """A row per distinct id (and network): its canonical form and how sure it is.

    The variants of an id and the observed ids are the two sides of a graph; an edge is a variant that is
    observed. canonical: the likeliest variant with an edge; without one, what is behind the underscore
    where the network joins ids, else the id as it is. n_matches: observed ids that it may be. status:
    ``missing``, ``unknown`` (no match), ``unique`` (one) or ``ambiguous`` (several). n_sharing: ids that
    have this canonical form, more than one if different ids would be taken for the same station."""
    net = F.lower(F.trim(F.col(network).cast("string"))) if network else F.lit(None).cast("string")
    own = ids.select(F.col(column).cast("string").alias("station_id"), net.alias("network")).distinct().withColumn("_v", variants(F.col("station_id")))
    edges = own.select("station_id", "network", "_v", F.posexplode_outer("_v").alias("_rank", "_name"))
    met = edges.join(known(observed), F.col("_name") == F.col("_known"), "left")
    found = met.groupBy("station_id", "network", "_v").agg(F.count("_known").alias("n_matches"), F.min_by("_known", F.when(F.col("_known").isNotNull(), F.col("_rank"))).alias("_first"))
    apart = F.when(F.coalesce(F.col("network") == JOINED_IDS, F.lit(False)) & (F.size("_v") > 1), F.try_element_at("_v", F.lit(2))).otherwise(F.try_element_at("_v", F.lit(1)))
    status = F.when(F.col("_v").isNull(), "missing").when(F.col("n_matches") == 0, "unknown").when(F.col("n_matches") == 1, "unique").otherwise("ambiguous")
    out = found.select("station_id", "network", F.coalesce("_first", apart).alias("canonical"), "n_matches", status.alias("status"))
    shared = out.groupBy("canonical").agg(F.countDistinct(F.trim("station_id")).alias("n_sharing"))
    return out.join(shared, "canonical", "left").select(*out.columns, F.when(F.col("canonical").isNotNull(), F.col("n_sharing")).alias("n_sharing"))


def canonicalize(df: DataFrame, observed: DataFrame, column: str = "station_id", network: str | None = None) -> DataFrame:
    """The rows with their id in its canonical form. The mapping has a row an id; rows with a missing
    id keep a null."""
    names = resolve(df, observed, column, network).select(F.col("station_id").alias("_id"), F.col("network").alias("_net"), F.col("canonical").alias("_canonical"))
    net = F.lower(F.trim(F.col(network).cast("string"))) if network else F.lit(None).cast("string")
    keyed = df.withColumns({"_key": F.col(column).cast("string"), "_of": net})
    out = keyed.join(names, F.col("_key").eqNullSafe(F.col("_id")) & F.col("_of").eqNullSafe(F.col("_net")), "left")
    return out.withColumn(column, F.col("_canonical")).select(*df.columns)


def _alias(c: Column, how: tuple[str, int] | None) -> Column:
    return c if how is None else F.trim(F.substring_index(c, *how))


def overlap(named: DataFrame, observed: DataFrame, examples: int = 5) -> DataFrame:
    """named: name, value. A row a name: n_ids (distinct values), n_observed, n_overlap, overlap_observed
    and overlap_ids (shares), the first ``examples`` observed values in order."""
    own = named.where("value IS NOT NULL").distinct()
    met = own.join(known(observed), F.col("value") == F.col("_known"), "left")
    counts = met.groupBy("name").agg(F.count("*").alias("n_ids"), F.count("_known").alias("n_overlap"))
    # Spark keeps the first few of each partition before it deals them out by name.
    first = met.where("_known IS NOT NULL").withColumn("_k", F.row_number().over(W.partitionBy("name").orderBy("value"))).where(F.col("_k") <= examples)
    first = first.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("examples"))
    every = known(observed).agg(F.count("*").alias("n_observed"))  # one row
    out = counts.join(first, "name", "left").join(F.broadcast(every))
    share = lambda total: F.round(F.try_divide(F.col("n_overlap"), F.col(total)), 6)
    return out.select("name", "n_ids", "n_observed", "n_overlap", share("n_observed").alias("overlap_observed"), share("n_ids").alias("overlap_ids"), F.coalesce("examples", F.lit("")).alias("examples"))


def alias_report(df: DataFrame, observed: DataFrame, column: str = "station_id") -> DataFrame:
    """How well each reading of the whole id column meets the observed ids; readings whose separator
    occurs nowhere are left out. chosen: the best one, of ties the first; the ids as they are if none
    meets any."""
    ids = df.select(cleaned(F.col(column)).alias("_id")).where("_id IS NOT NULL").distinct()
    named = ids.select("_id", F.explode(F.array(*(F.struct(F.lit(i).alias("order"), F.lit(n).alias("name"), _alias(F.col("_id"), how).alias("value"), F.lit(how is None).alias("_raw")) for i, (n, how) in enumerate(ALIASES.items())))).alias("_a"))
    named = named.select("_id", "_a.*")
    used = named.groupBy("name", "order").agg(F.max((F.col("_raw") | (F.col("value") != F.col("_id"))).cast("int")).alias("_used")).where("_used = 1")
    rows = overlap(named.select("name", "value"), observed).join(used.select("name", "order"), "name")
    best = rows.agg(F.min_by("name", F.struct(-F.col("n_overlap"), F.col("order"))).alias("_best"))  # one row; raw comes first of ties
    return rows.join(F.broadcast(best)).withColumn("chosen", F.col("name") == F.col("_best")).drop("_best", "order")


def variant_report(df: DataFrame, observed: DataFrame, column: str = "station_id", network: str | None = None) -> DataFrame:
    """How well the ids meet the observed ones as they are, by their first and second other variant
    (where there is none, as they are), and in canonical form."""
    r = resolve(df, observed, column, network).where("canonical IS NOT NULL").withColumn("_v", variants(F.col("station_id")))
    raw = F.trim("station_id")
    named = {"exact": raw, "underscore_suffix": F.coalesce(F.try_element_at("_v", F.lit(2)), raw), "underscore_prefix": F.coalesce(F.try_element_at("_v", F.lit(3)), raw), "canonical": F.col("canonical")}
    rows = r.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in named.items()))).alias("_n")).select("_n.*")
    return overlap(rows, observed).drop("examples")


def column_scores(df: DataFrame, observed: DataFrame) -> DataFrame:
    """name, n_overlap: how many observed ids each possible id column has. One pass over all of them."""
    there = [c for c in ID_COLUMNS if c in df.columns]
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.trim(F.col(c).cast("string")).alias("value")) for c in there))).alias("_p")).select("_p.*").distinct()
    met = pairs.join(known(observed), F.col("value") == F.col("_known"), "left")
    return met.groupBy("name").agg(F.count("_known").alias("n_overlap"))


def station_column(df: DataFrame, observed: DataFrame | None = None, network: str = "", explicit: str | None = None) -> str:
    """The column to join stations by: the given one; else the one with most observed ids, of ties the
    most preferred; else the network's usual one, ``station_id``, or the most preferred there is."""
    there = [c for c in ID_COLUMNS if c in df.columns]
    if explicit is not None or not there:
        if explicit not in df.columns:
            raise KeyError(f"no column {explicit or 'of ids'} in {df.columns}")
        return explicit
    if observed is not None:
        scores = {r["name"]: r["n_overlap"] for r in column_scores(df, observed).collect()}  # a row a candidate
        best = max(there, key=lambda c: scores.get(c, 0))
        if scores.get(best, 0):
            return best
    usual = [c for part, c in NETWORK_COLUMNS if part in network.lower() and c in there]
    return (usual + ["station_id"] * ("station_id" in there) + there)[0]
