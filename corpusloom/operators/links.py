"""Linking producers to consumers, and calls to the endpoint that fits best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLVED, PENDING = "RESOLVED", "PENDING"


def match_links(producers: DataFrame, consumers: DataFrame, producer: str, consumer: str, topic: str = "topic", topics: str = "topics", pattern: str | None = None) -> DataFrame:
    """(topic, producer, consumer, status) of all links of one broker.

    producers: one row per producer and topic.  consumers: one row per consumer with an
    array of topics.  Equal topics make a RESOLVED link.  A producer of a topic nobody
    reads is PENDING without consumer.  A consumer none of whose topics is produced gives
    one PENDING row per topic; one that subscribes by pattern never matches.
    """
    left = producers.select(F.col(topic).alias("topic"), F.col(producer).alias("producer"))
    by_pattern = F.col(pattern) if pattern else F.lit(False)
    right = consumers.select(F.col(consumer).alias("consumer"), F.explode(topics).alias("topic"), by_pattern.alias("by_pattern"))
    plain = right.where(~F.col("by_pattern"))
    met = left.join(plain, "topic").select("topic", "producer", "consumer", F.lit(RESOLVED).alias("status"))
    lone_producers = left.join(plain.select("topic").distinct(), "topic", "left_anti").select("topic", "producer", F.lit(None).cast(right.schema["consumer"].dataType).alias("consumer"), F.lit(PENDING).alias("status"))
    linked = plain.join(left.select("topic").distinct(), "topic", "left_semi").select("consumer").distinct()
    lone = right.join(linked, "consumer", "left_anti")
    lone_consumers = lone.select("topic", F.lit(None).cast(left.schema["producer"].dataType).alias("producer"), "consumer", F.lit(PENDING).alias("status"))
    return met.unionByName(lone_producers).unionByName(lone_consumers)


def producer_links(producers: DataFrame, consumers: DataFrame, producer: str, topic: str = "topic", topics: str = "topics", pattern: str | None = None) -> DataFrame:
    """(topic, producer, status): each producer and topic once, with the status that match_links gives them.

    Where only producers are asked for, this makes no row for each pair of a producer and a consumer.
    """
    by_pattern = F.col(pattern) if pattern else F.lit(False)
    plain = consumers.where(~by_pattern).select(F.explode(topics).alias("topic")).distinct().withColumn("_read", F.lit(True))
    left = producers.select(F.col(topic).alias("topic"), F.col(producer).alias("producer")).distinct()
    return left.join(plain, "topic", "left").select("topic", "producer", F.when(F.col("_read"), RESOLVED).otherwise(PENDING).alias("status"))


def rabbit_producers(producers: DataFrame, routing_key: str = "routing_key", exchange: str = "exchange") -> DataFrame:
    """Producers with the topic of their link: the routing key, or the exchange where that is blank."""
    blank = F.trim(F.coalesce(F.col(routing_key), F.lit(""))) == ""
    return producers.drop("topic").withColumn("topic", F.when(blank, F.col(exchange)).otherwise(F.col(routing_key)))


def lead(path: Column) -> Column:
    """The first segment of a path that is not empty."""
    return F.get(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(0))


def last(path: Column) -> Column:
    return F.get(F.reverse(F.filter(F.split(path, "/"), lambda s: s != "")), F.lit(0))


def segment_keys(call: Column, endpoint: Column, ends: bool = False) -> list[tuple[Column, Column]]:
    """Pairs of (array of a call's keys, an endpoint's key) that meet wherever a path score can be above 0.

    Matching paths agree in their first segment, or the endpoint has a variable or an
    expression there; with ``ends`` they can also agree in their last one alone.  A call
    that begins with an expression fits any endpoint of as many segments.
    """
    free = lambda s: F.coalesce(s.rlike(r"^\{[^}]+\}$") | s.contains("${"), F.lit(True))
    count = lambda p: F.size(F.split(F.regexp_replace(p, "/+$", ""), "/")).cast("string")
    first = F.when(F.coalesce(lead(call).contains("${"), F.lit(True)), F.array()).otherwise(F.array(lead(call)))
    keys = [(F.array_append(first, F.lit("*")), F.when(free(lead(endpoint)), F.lit("*")).otherwise(lead(endpoint)))]
    keys.append((F.when(F.coalesce(lead(call).contains("${"), F.lit(True)), F.array(count(call))).otherwise(F.array().cast("array<string>")), count(endpoint)))
    if ends:
        keys.append((F.array_compact(F.array(last(call))), F.coalesce(last(endpoint), F.lit(""))))
    keys.append((F.array(call), endpoint))
    return keys


def best_match(calls: DataFrame, endpoints: DataFrame, call: str, endpoint: str, on: list[Column], score: Column, ordinal: str, least: float | None = None, keys: list[tuple[Column, Column]] | None = None) -> DataFrame:
    """Each call with its best endpoint: highest score, then lowest ordinal.

    on: equalities that both sides must meet.  keys: pairs of a call's keys and an
    endpoint's key; a pair of rows is scored if one of them meets, so no verb makes a
    product of its calls and endpoints.  Without ``least``, calls whose best score is 0
    stay as PENDING with no endpoint and score 0; with it, only links of at least that
    score are returned.  The best endpoint of a call is an aggregate (max of score and
    negated ordinal), which is combined before the shuffle.
    """
    same = [c for c in calls.columns if c in endpoints.columns]
    if same:
        raise ValueError(f"columns on both sides: {same}")
    rank, name = (-F.col(ordinal)).alias("rank"), F.col(endpoint).alias("endpoint")
    none = calls.select("*", F.struct(F.lit(0.0).alias("confidence"), F.lit(None).cast(endpoints.select(rank).schema["rank"].dataType).alias("rank"), F.lit(None).cast(endpoints.schema[endpoint].dataType).alias("endpoint")).alias("_best"))
    scored = none
    for wanted, key in keys or [(F.array(F.lit("")), F.lit(""))]:
        left, right = calls.withColumn("_key", F.explode(wanted)), endpoints.withColumn("_of", key)
        met = left.join(right, [F.col("_key") == F.col("_of"), *on])
        scored = scored.unionByName(met.select(*calls.columns, F.struct(F.coalesce(score, F.lit(0.0)).alias("confidence"), rank, name).alias("_best")))
    found = scored.groupBy(*[F.col(c) for c in calls.columns]).agg(F.max("_best").alias("_best")).select(*calls.columns, "_best.confidence", "_best.endpoint")
    if least is not None:
        return found.where(F.col("confidence") >= least)
    hit = F.col("confidence") > 0
    return found.select(*calls.columns, F.when(hit, F.col("endpoint")).alias("endpoint"), "confidence", F.when(hit, RESOLVED).otherwise(PENDING).alias("status"))


def consecutive_edges(steps: DataFrame, flow: str, order: str, node: str) -> DataFrame:
    """(flow, order, source, target) for each step and the next one of its flow."""
    following = F.lead(node).over(Window.partitionBy(flow).orderBy(order))
    return steps.select(flow, order, F.col(node).alias("source"), following.alias("target")).where("target IS NOT NULL")
