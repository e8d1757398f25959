"""Vehicles that drive the same stops share a route."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.functions import scalars as X
from fleetlag.session import cut_lineage


def route_ids(plan: DataFrame, min_shared: float = 0.5) -> DataFrame:
    """``tr_id, route``: in ascending order of ids a vehicle joins the first route owner that
    covers at least ``min_shared`` of its stops, or owns a route itself.

    Vehicles with the very same stops are collapsed first, so copies cost nothing. The rest is
    decided in rounds: a vehicle is ready once, for each of its rarest stops that any sufficient
    overlap must touch, no smaller undecided vehicle serves that stop. All ready vehicles are
    decided together and only the new owners are compared with the undecided, so pairs of
    ordinary vehicles are never formed.
    """
    visits = plan.select("tr_id", X.stop_key("lat", "lon").alias("key")).distinct()
    # Order-free signature of a stop set: count and two sums of independent hashes.
    signature = visits.groupBy("tr_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("s1"),
        F.sum(F.xxhash64("key", F.lit(7)).cast("decimal(38,0)")).alias("s2"),
    )
    same = ["size", "s1", "s2"]
    leaders = signature.groupBy(*same).agg(F.min("tr_id").alias("leader"))
    member = cut_lineage(signature.join(leaders, same).select("tr_id", "leader", "size"))

    lead = member.where("tr_id = leader").select("tr_id", "size")
    stops = cut_lineage(_ranked_stops(visits.join(lead, "tr_id"), min_shared))
    undecided = stops.select("tr_id").distinct()
    owners = covered = None
    while True:
        undecided = cut_lineage(undecided)
        if undecided.isEmpty():
            break
        open_stops = stops.join(undecided, "tr_id", "left_semi")
        smallest = open_stops.groupBy("key").agg(F.min("tr_id").alias("first"))
        blocked = (
            open_stops.where("decisive").join(smallest, "key").where("first < tr_id").select("tr_id")
        )
        ready = undecided.join(blocked.distinct(), "tr_id", "left_anti")
        if covered is None:
            routed = ready.withColumn("route", F.col("tr_id"))
        else:
            best = covered.groupBy("tr_id").agg(F.min("owner").alias("owner"))
            routed = ready.join(best, "tr_id", "left").select(
                "tr_id", F.coalesce("owner", "tr_id").alias("route")
            )
        routed = cut_lineage(routed)
        owners = routed if owners is None else owners.unionByName(routed)
        undecided = cut_lineage(undecided.join(routed, "tr_id", "left_anti"))
        fresh = routed.where("tr_id = route").select(F.col("tr_id").alias("owner"))
        shared = (
            stops.join(undecided, "tr_id", "left_semi")
            .join(stops.select(F.col("tr_id").alias("owner"), "key").join(fresh, "owner"), "key")
            .where("owner < tr_id")
            .groupBy("tr_id", "owner", "size")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") / F.col("size") >= min_shared)
            .select("tr_id", "owner")
        )
        shared = cut_lineage(shared)
        covered = shared if covered is None else covered.unionByName(shared)
    routes = owners.select(F.col("tr_id").alias("leader"), "route")
    return member.join(routes, "leader").select("tr_id", "route")


def _ranked_stops(visits: DataFrame, min_shared: float) -> DataFrame:
    """Stops of each vehicle with ``decisive``: the rarest ones that any overlap of at least
    ``min_shared`` has to touch (all but the most frequent ``need − 1``)."""
    usage = visits.groupBy("key").agg(F.count(F.lit(1)).alias("users"))
    need = F.ceil(F.col("size") * min_shared)
    # A vehicle's distinct stops: bounded by its network, not by the length of its history.
    per_vehicle = visits.join(usage, "key").groupBy("tr_id", "size").agg(
        F.sort_array(F.collect_list(F.struct("users", "key"))).alias("keys")
    )
    return per_vehicle.select(
        "tr_id", "size", F.posexplode("keys").alias("rank", "k")
    ).select("tr_id", "size", "k.key", (F.col("rank") < F.col("size") - need + 1).alias("decisive"))
