"""Import of feature layers: cleaning, duplicates, divided roads, change sets, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import even_points, feature_pieces
from pathloom.operators.components import connected_components, shared_folder
from pathloom.operators.spatial import line_pairs, within


def clean_name(*names: Column) -> Column:
    """The first of the names that is neither null, empty when trimmed, nor a placeholder."""
    tidy = lambda n: F.nullif(F.trim(n), F.lit(""))
    return F.coalesce(*[F.when(F.upper(tidy(n)) != "N/A", tidy(n)) for n in names])


def counted_path(kind: Column, counted: list[str]) -> tuple[Column, Column]:
    ok = F.coalesce(kind.isin(counted), F.lit(False))
    return ok, F.when(~ok, F.concat(F.lit("type "), F.coalesce(kind, F.lit("none"))))


def counted_road(city: Column, own: str) -> tuple[Column, Column]:
    ok = F.coalesce(city == own, F.lit(False))
    return ok, F.when(~ok, F.lit("outside city"))


def global_id(value: Column) -> Column:
    """Upper case in braces, as layers write their keys."""
    return F.concat(F.lit("{"), F.upper(F.regexp_replace(F.trim(value), "[{}]", "")), F.lit("}"))


def duplicates(df: DataFrame, hash_col: str, order_col: str, keep: list[str]) -> DataFrame:
    """``df`` with ``rn`` (1 for the kept row of each hash, the lowest by ``order_col``) and ``kept_*`` of the kept row."""
    by = Window.partitionBy(hash_col).orderBy(order_col)
    out = df
    for name in keep:
        out = out.withColumn(f"kept_{name}", F.first(name).over(by))
    return out.withColumn("rn", F.row_number().over(by))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(key)


def changes(stored: DataFrame, staging: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """``(key, change)``: added, removed, changed (any of ``compare`` differs, nulls compared) or same."""
    s = stored.select(key, *[F.col(x).alias(f"s_{x}") for x in compare], F.lit(True).alias("_s"))
    t = staging.select(key, *[F.col(x).alias(f"t_{x}") for x in compare], F.lit(True).alias("_t"))
    differ = F.lit(False)
    for x in compare:
        differ = differ | ~F.col(f"s_{x}").eqNullSafe(F.col(f"t_{x}"))
    kind = F.when(F.col("_s").isNull(), "added").when(F.col("_t").isNull(), "removed").when(differ, "changed").otherwise("same")
    return s.join(t, key, "full_outer").select(key, kind.alias("change"))


def upsert(stored: DataFrame, staging: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Stored rows with staging's values where both have the key, and staging's new rows, with ``inserted``."""
    t = staging.select(*key, *[F.col(x).alias(f"_{x}") for x in values], F.lit(True).alias("_t"))
    both = stored.select(*key, *values, F.lit(True).alias("_s")).join(t, key, "full_outer")
    return both.select(*key, *[F.when(F.col("_t"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) for x in values], F.col("_s").isNull().alias("inserted"))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    by = Window.partitionBy(*key).orderBy(*[F.col(x).desc() for x in order])
    return df.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def with_geometry(features: DataFrame, geom: str = "geom") -> tuple[DataFrame, DataFrame]:
    """``(features with a geometry, those whose geometry is null or has no parts)``."""
    there = F.coalesce(F.size(geom) > 0, F.lit(False))
    return features.where(there), features.where(~there)


def tiny_parts(segments: DataFrame, min_m: float) -> DataFrame:
    """``(id, part, part_m)``: parts of counted segments that are too short for nodes."""
    return feature_pieces(segments.where("counted")).where(F.col("last") & (F.col("part_m") < min_m)).select("id", "part", "part_m")


def nodeless(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counted segments without a node."""
    return segments.where("counted").join(nodes.select(F.col("segment_id").alias("id")), "id", "left_anti")


def other_srid(rows: DataFrame, networks: DataFrame) -> DataFrame:
    """Rows whose ``srid`` is not that of their network ``(network_id, srid)``, which is null for an unknown network."""
    own = networks.select("network_id", F.col("srid").alias("network_srid"))
    return rows.join(own, "network_id", "left").where(~F.col("srid").eqNullSafe(F.col("network_srid")))


def delete(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """``(rows that stay, rows deleted)``; a null condition deletes nothing."""
    gone = F.coalesce(condition, F.lit(False))
    return df.where(~gone), df.where(gone)


def touching(features: DataFrame, on: tuple[str, ...] = (), reach: float = 1.0) -> DataFrame:
    """``(key, other)``, both ways: features within ``reach`` of each other, those that cross too, of equal ``on``."""
    parts = feature_pieces(features, "key").withColumnRenamed("id", "key")
    parts = parts.join(features.select("key", *on), "key") if on else parts
    one = line_pairs(parts, reach, "key", on).select(F.col("a").alias("key"), F.col("b").alias("other"))
    return one.unionByName(one.select(F.col("other").alias("key"), F.col("key").alias("other")))


def second_carriageways(features: DataFrame, divided: list[str], reach: float = 40.0, share: float = 0.8, every: float = 5.0, max_rounds: int = 1000) -> DataFrame:
    """Keys of the twins of divided roads: ``(key)``.

    Counted features of one divided name form chains where they touch (within 1 m). In order of name, longest chain
    first, least chain key, then object id, a feature is a twin if ``share`` of its sample points lie within ``reach``
    of features kept before it that it does not touch. A round settles every feature whose earlier neighbours are all
    settled, so there are as many rounds as the longest run of neighbours in that order, and no name is one group.
    """
    shared_folder(features.sparkSession)
    roads = features.where(F.col("counted") & F.col("name").isin(divided)).select("key", "oid", "name", "length_m", "geom").checkpoint()
    parts = feature_pieces(roads, "key").withColumnRenamed("id", "key").join(roads.select("key", "name"), "key")
    other = parts.select(F.col("key").alias("other"), "name", "x1", "y1", "x2", "y2")
    points = even_points(parts, every, ("key", "part"), ("name",)).withColumn("sample", F.struct("part", "seq"))
    touch = touching(roads, ("name",)).checkpoint()
    chain = connected_components(touch, "key", "other").withColumnRenamed("vertex", "key")
    rows = roads.join(chain, "key", "left").select("key", "oid", "length_m", F.coalesce("component", "key").alias("chain"))
    chain_m = rows.groupBy("chain").agg(F.sum("length_m").alias("chain_m"))
    place = rows.join(chain_m, "chain").select("key", F.struct((-F.col("chain_m")).alias("m"), "chain", "oid", "key").alias("place"))
    near = within(points, other, reach, ("name",)).where("key != other").select("key", "other", "sample").distinct().join(touch, ["key", "other"], "left_anti")
    near = near.join(place, "key").join(place.select(F.col("key").alias("other"), F.col("place").alias("other_place")), "other").where("other_place < place").select("key", "other", "sample").checkpoint()
    before = near.select("key", "other").distinct().checkpoint()
    total = points.groupBy("key").agg(F.count("*").alias("total")).checkpoint()
    settled = roads.select("key").join(before.select("key").distinct(), "key", "left_anti").withColumn("twin", F.lit(False)).checkpoint()
    left = before.select("key").distinct().checkpoint()
    for _ in range(max_rounds):
        if left.isEmpty():
            return settled.where("twin").select("key")
        waits = before.join(left.select(F.col("key").alias("other")), "other", "left_semi").select("key").distinct()
        ready = left.join(waits, "key", "left_anti")
        kept = settled.where("not twin").select(F.col("key").alias("other"))
        covered = near.join(ready, "key", "left_semi").join(kept, "other", "left_semi").groupBy("key").agg(F.count_distinct("sample").alias("n"))
        found = ready.join(covered, "key", "left").join(total, "key").select("key", F.coalesce((F.col("n") > 0) & (F.col("n") >= share * F.col("total")), F.lit(False)).alias("twin"))
        settled = settled.unionByName(found).checkpoint()
        left = left.join(settled, "key", "left_anti").checkpoint()
    raise RuntimeError(f"twins did not settle in {max_rounds} rounds")


def apply_exclusions(segments: DataFrame, by_key: DataFrame, by_name: DataFrame, duplicate_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(segments with excluded and exclusion_reason, warnings)``.

    ``by_key`` (layer, key, name, reason) goes through ``duplicate_of`` (layer, dropped_key, canonical_key) first;
    ``by_name`` (layer, name, reason) takes all of a road's segments, compared trimmed and in any case. Warnings: a
    key that was mapped, one that no segment has, and one whose segment has another name than the entry expects.
    """
    mapped = by_key.join(duplicate_of.withColumnRenamed("dropped_key", "key"), ["layer", "key"], "left").withColumn("use_key", F.coalesce("canonical_key", "key"))
    found = mapped.join(segments.select("layer", F.col("source_key").alias("use_key"), F.col("name").alias("now_name"), F.lit(True).alias("there")), ["layer", "use_key"], "left")
    same = F.upper(F.trim("name")) == F.upper(F.trim("now_name"))
    warn = found.select("layer", "key", F.array_compact(F.array(F.when(F.col("canonical_key").isNotNull(), F.lit("duplicate")), F.when(F.col("there").isNull(), F.lit("orphan")), F.when(F.col("there") & F.col("name").isNotNull() & ~F.coalesce(same, F.lit(False)), F.lit("renamed")))).alias("w")).select("layer", "key", F.explode("w").alias("warning"))
    names = by_name.select("layer", F.upper(F.trim("name")).alias("_n"), F.col("reason").alias("n_reason"))
    keys = mapped.groupBy("layer", F.col("use_key").alias("source_key")).agg(F.min("reason").alias("k_reason"))
    out = segments.drop("excluded", "exclusion_reason").withColumn("_n", F.upper(F.trim("name"))).join(keys, ["layer", "source_key"], "left").join(names.groupBy("layer", "_n").agg(F.min("n_reason").alias("n_reason")), ["layer", "_n"], "left")
    reason = F.coalesce("k_reason", "n_reason")
    lost = names.join(segments.select("layer", F.upper(F.trim("name")).alias("_n")), ["layer", "_n"], "left_anti").select("layer", F.col("_n").alias("key"), F.lit("orphan").alias("warning"))
    return out.withColumn("excluded", reason.isNotNull()).withColumn("exclusion_reason", reason).drop("_n", "k_reason", "n_reason"), warn.unionByName(lost)
