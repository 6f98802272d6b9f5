"""Detections that are made one event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.stats import haversine, local_magnitude


@dataclass
class Association:
    """The rows that an association adds, detections as they are afterwards, and requests that were refused."""

    events: DataFrame
    estimates: DataFrame
    detections: DataFrame
    refused: DataFrame


def associate(requests: DataFrame, detections: DataFrame, stations: DataFrame, events: int, prefix: str = "EVT-") -> Association:
    """Requests (request, origin_time, latitude, longitude, depth_km, detection_ids) over detections and stations.

    A request is refused, for the first reason that holds, if it has fewer than two detections, a time that is no RFC 3339
    time, a detection that isn't there or has an event already, or detections of one station only. Others make an event
    each, numbered after `events` in the order of requests, with an estimate of magnitude for each detection and their
    mean. A detection that several requests want goes to the first of them.
    """
    asked = requests.select("request", "latitude", "longitude", F.posexplode("detection_ids").alias("pos", "detection_id"))
    known = detections.select("detection_id", "channel_id", "station_id", "amplitude", F.col("event_id").alias("had"))
    known = known.join(stations.select("station_id", F.col("latitude").alias("slat"), F.col("longitude").alias("slon")), "station_id")
    first = asked.groupBy("detection_id").agg(F.min("request").alias("owner"))
    rows = asked.join(known, "detection_id", "left").join(first, "detection_id")
    taken = (F.coalesce("had", F.lit("")) != "") | (F.col("owner") != F.col("request"))
    seen = rows.groupBy("request").agg(F.count_if(F.col("station_id").isNull()).alias("absent"), F.count_if(F.col("station_id").isNotNull() & taken).alias("taken"), F.countDistinct("station_id").alias("stations"))
    valid = F.trim("origin_time").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    n = F.size("detection_ids")
    why = (
        F.when(n < 2, "at least two detections are required").when(~F.coalesce(valid, F.lit(False)), "origin time must be RFC 3339").when(F.col("absent") > 0, "not found")
        .when(F.col("taken") > 0, "already associated").when(F.col("stations") < 2, "detections must span two stations")
    )
    judged = requests.join(seen, "request", "left").withColumn("reason", why)
    good = judged.where("reason is null")
    from larkspur.operators.updates import numbered

    named = numbered(good.select(F.col("request")), "request", 10_000, "%d", "place").select("request", F.concat(F.lit(prefix), F.lpad((F.col("place").cast("long") + events).cast("string"), F.lit(6), F.lit("0"))).alias("event_id"))
    far = haversine(F.col("latitude"), F.col("longitude"), F.col("slat"), F.col("slon"))
    estimates = rows.join(named, "request").select(F.concat("event_id", F.lit("-M"), (F.col("pos") + 1).cast("string")).alias("estimate_id"), "event_id", "detection_id", "channel_id", local_magnitude(F.col("amplitude"), far).alias("value"), F.lit("ML").alias("mag_type"), F.lit(0.0).alias("residual"))
    mean = estimates.groupBy("event_id").agg(F.avg("value").alias("magnitude"), F.count("*").alias("detection_count"))
    new = good.join(named, "request").join(mean, "event_id")
    new = new.select("event_id", "origin_time", "latitude", "longitude", "depth_km", "magnitude", F.lit("ML").alias("magnitude_type"), F.lit("automatic").alias("review_status"), "detection_count")
    changed = estimates.select("detection_id", F.col("event_id").alias("new"))
    after = detections.join(changed, "detection_id", "left").withColumn("event_id", F.coalesce("new", "event_id")).select(*detections.columns)
    return Association(new, estimates.drop("detection_id"), after, judged.where("reason is not null").select("request", "reason"))
