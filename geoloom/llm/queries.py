"""Queries of the llm operators over their whole tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.clusters import compact_groups, describe, grid_clusters
from geoloom.llm.language import document_languages, segments, unnamed_languages
from geoloom.llm.packing import fill_report, materialised_sizes, pack
from geoloom.llm.percentiles import grouped_percentiles
from geoloom.llm.tokenise import decode_corpus, encode_corpus, token_counts
from geoloom.operators.wide import attribute_key

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Rank error of the percentiles as a share of a group's values.
EPS = 0.001
#: Link distance of the clusters in metres.
LINK = 200.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spelt_results(spark: SparkSession, d: str) -> DataFrame:
    """result_df with varname spelt as in the catalogue where it belongs to an entry, and the loading day."""
    names = table(spark, d, "geovar_types").select(attribute_key(F.col("varname")).alias("key"), F.col("varname").alias("spelt"))
    rows = table(spark, d, "result_df").withColumn("key", attribute_key(F.col("varname")))
    return rows.join(names, "key", "left").select(
        F.coalesce("spelt", "varname").alias("varname"), "year", "value", F.to_date("loaded_at").alias("day")
    )


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return grouped_percentiles(spelt_results(spark, d), ["varname", "year"], "value", PERCENTILES, part_by="day", eps=EPS)


def p2_days(spark: SparkSession, d: str) -> DataFrame:
    """The same for each loading day by itself."""
    return grouped_percentiles(spelt_results(spark, d), ["varname", "year", "day"], "value", PERCENTILES, eps=EPS)


def p2_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Every percentile held against the exact ranks of all rows: whether it lies within the stated and the promised bound."""
    rows = spelt_results(spark, d).where("value is not null and not isnan(value)").select("varname", "year", "value")
    found = grouped_percentiles(spelt_results(spark, d), ["varname", "year"], "value", PERCENTILES, part_by="day", eps=EPS)
    found = found.select(F.col("varname").alias("v"), F.col("year").alias("y"), "n", "p", "percentile", "rank_error")
    met = rows.join(found, F.col("varname").eqNullSafe(F.col("v")) & F.col("year").eqNullSafe(F.col("y")))
    ranks = met.groupBy("varname", "year", "p", "n", "rank_error").agg(
        F.count(F.when(F.col("value") < F.col("percentile"), 1)).alias("below"),
        F.count(F.when(F.col("value") <= F.col("percentile"), 1)).alias("upto"),
        F.count("*").alias("all"),
    )
    rank = F.greatest(F.ceil(F.col("p") * F.col("n")), F.lit(1))
    off = F.greatest(F.lit(0), F.col("below") + 1 - rank, rank - F.col("upto"))
    within = (off <= F.col("rank_error")) & (F.col("rank_error") <= EPS * F.col("n")) & (F.col("n") == F.col("all"))
    return ranks.groupBy("varname", "year").agg(F.max("n").alias("n"), F.count("*").alias("n_percentiles"), F.bool_and(within).alias("within"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return compact_groups(grid_clusters(table(spark, d, "centroid_df"), LINK), LINK)


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster of at least three linked ids, however thin its cells, its size and most typical ids."""
    return describe(grid_clusters(table(spark, d, "centroid_df"), LINK), at_least=3)


def p5_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of the same clusters."""
    return p5_clusters(spark, d).select("cluster_id", "size")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return decode_corpus(encode_corpus(table(spark, d, "documents")))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialised_sizes(token_counts(table(spark, d, "documents")))
    return pack(sizes, table(spark, d, "containers"))


def p7_bins(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(_packed(spark, d))


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per container: documents placed, bins above capacity, documents split without need, gaps in a document's pieces."""
    packed = _packed(spark, d)
    over = packed.groupBy("container", "capacity", "bin").agg(F.sum("size").alias("s")).where("s > capacity").groupBy("container").agg(F.count("*").alias("n_over"))
    docs = packed.groupBy("container", "capacity", "doc_id").agg(F.count("*").alias("k"), F.max("piece").alias("last"), F.sum("size").alias("s"))
    docs = docs.groupBy("container").agg(
        F.count("*").alias("n_docs"),
        F.count(F.when((F.col("k") > 1) & (F.col("s") <= F.col("capacity")), 1)).alias("n_needless"),
        F.count(F.when(F.col("k") != F.col("last") + 1, 1)).alias("n_gaps"),
    )
    return docs.join(over, "container", "left").select("container", "n_docs", F.coalesce("n_over", F.lit(0)).alias("n_over"), "n_needless", "n_gaps")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return unnamed_languages(docs, segments(docs))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document."""
    docs = table(spark, d, "documents")
    return document_languages(docs, segments(docs))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every segment."""
    return segments(table(spark, d, "documents"))


_KEY = r"regexp_replace(translate(replace(replace(lower({c}), ' ', ''), chr(9), ''), '-', '_'), '(^|[^0-9])0+([0-9])', '\1\2', 'g')"

QUERIES = {
    "p2_percentiles": p2_percentiles,
    "p2_days": p2_days,
    "p2_within_bound": p2_within_bound,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p5_sizes": p5_sizes,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_bins": p7_bins,
    "p7_report": p7_report,
    "p7_sound": p7_sound,
    "p8_found": p8_found,
    "p8_documents": p8_documents,
    "p8_segments": p8_segments,
}

ORACLES = {
    "p2_within_bound": f"""
      with names as (select varname as spelt, {_KEY.format(c='varname')} as k from geovar_types),
      r as (select coalesce(spelt, varname) as varname, year from
            (select varname, year, {_KEY.format(c='varname')} as k from result_df where value is not null and not isnan(value)) left join names using (k))
      select varname, year, count(*) as n, {len(PERCENTILES)} as n_percentiles, true as within from r group by varname, year""",
    "p5_found": f"""
      with p as (select distinct id, x, y from centroid_df where id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)),
      n as (select distinct a.id, b.id as other from p a join p b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {LINK * LINK}),
      s as (select id, list(other order by other) as near, min(other) as cluster_id, count(*) as k from n group by id),
      g as (select near, count(*) as members from s group by near)
      select cluster_id, id from s join g using (near) where members = k and k >= 3""",
    "p5_sizes": f"""
      with recursive p as (select distinct id, x, y from centroid_df where id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)),
      n as materialized (select distinct a.id, b.id as other from p a join p b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {LINK * LINK}),
      reach as (select id, other from n union select reach.id, n.other from reach join n on n.id = reach.other),
      c as (select id, min(other) as cluster_id from reach group by id)
      select cluster_id, count(*) as size from c group by cluster_id having count(*) >= 3""",
    "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
    "p7_sound": "select container, (select count(*) from documents) as n_docs, 0 as n_over, 0 as n_needless, 0 as n_gaps from containers",
}
