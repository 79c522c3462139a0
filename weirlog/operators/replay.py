"""Replaying messages against a trained model: exact, canonical, prefix and nearest-template lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical_key, tokens
from ..plans.staging import dimension

UNKNOWN_EVENT, UNKNOWN_TEMPLATE = "E99", "<*>"
SIZE_BAND, GOOD_ENOUGH = 12, 0.85


def nearest_templates(strings: DataFrame, events: DataFrame, *, band: int = SIZE_BAND, enough: float = GOOD_ENOUGH, inclusive: bool = False, unknown: str = UNKNOWN_EVENT) -> DataFrame:
    """(masked, event_id): for each different string, the first event in order whose similarity passes `enough`, else the
    first of the most similar ones, else `unknown`.

    Candidates share a token: posting lists join on tokens, shared tokens are counted by (string, event). Set sizes may
    differ by `band`. events (event_ord, event_id, event_template) is a model's table of at most some thousand rows.
    """
    t = events.select("event_ord", "event_id", F.array_distinct(tokens(F.col("event_template"))).alias("set"))
    t = t.select("event_ord", "event_id", F.size("set").alias("m"), F.explode("set").alias("token"))
    s = strings.select("masked", F.array_distinct(tokens(F.col("masked"))).alias("set"))
    p = s.select("masked", F.size("set").alias("n"), F.explode("set").alias("token"))
    common = p.join(t, "token").where(F.abs(F.col("n") - F.col("m")) <= band).groupBy("masked", "n", "event_ord", "event_id", "m").agg(F.count("*").alias("both"))
    score = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    passes = score >= enough if inclusive else score > enough
    scored = common.select("masked", "event_id", "event_ord", score.alias("score"), passes.alias("passes"))
    best = scored.groupBy("masked").agg(
        F.min_by("event_id", F.when(F.col("passes"), F.col("event_ord"))).alias("first"), F.max_by("event_id", F.struct("score", -F.col("event_ord"))).alias("top"),
    )
    return strings.select("masked").join(best, "masked", "left").select("masked", F.coalesce("first", "top", F.lit(unknown)).alias("event_id"))


def replay(rows: DataFrame, trained: DataFrame, events: DataFrame, *, bound: int | None = None, **options) -> DataFrame:
    """rows (idx, masked, ...) with event_id, event_template and source (exact or nearest).

    trained (masked, event_id, event_template or not) is the model's cache, bounded by its training limit and broadcast behind a
    check, so rows that it knows are not shuffled, however many share a string. The others are resolved once per different
    string. Templates are joined to strings, not to rows. bound: how many rows trained has at most, where that is known;
    else they are counted.
    """
    cache = trained if "event_template" in trained.columns else with_template(trained, events, bound=bound)
    cache = dimension(cache.select(F.col("masked").alias("t"), "event_id", "event_template"), bound=bound)
    known = rows.join(cache, F.col("masked") == F.col("t"), "left").drop("t")
    hits, misses = known.where("event_id is not null").withColumn("source", F.lit("exact")), known.where("event_id is null").drop("event_id", "event_template")
    found = with_template(nearest_templates(misses.select("masked").distinct(), events, **options), events, bound=bound).withColumnRenamed("masked", "t")
    rest = misses.join(found, F.col("masked") == F.col("t")).drop("t").withColumn("source", F.lit("nearest"))
    return hits.unionByName(rest).select(*rows.columns, "event_id", "source", "event_template")


def with_template(rows: DataFrame, events: DataFrame, unknown: str = UNKNOWN_TEMPLATE, bound: int | None = None) -> DataFrame:
    names = dimension(events.select(F.col("event_id").alias("e"), "event_template").distinct(), bound=bound)
    return rows.join(names, F.col("event_id") == F.col("e"), "left").drop("e").withColumn("event_template", F.coalesce("event_template", F.lit(unknown)))


def replay_canonical(rows: DataFrame, trained: DataFrame, events: DataFrame, *, enough: float = GOOD_ENOUGH, bound: int | None = None, **options) -> DataFrame:
    """As replay, with a second look at canonical keys: source is exact, canonical, memo or nearest.

    trained (masked, event_id, cluster_id): a key of trained strings stands for the one of the lowest cluster. Of the
    rest, the first row of each key (by idx) is resolved by similarity and all its key's later rows take its event.
    """
    cache = dimension(trained.select(F.col("masked").alias("t"), F.col("event_id").alias("e1")), bound=bound)
    keys = trained.select(canonical_key(F.col("masked")).alias("k"), "event_id", "cluster_id").groupBy("k").agg(F.min_by("event_id", "cluster_id").alias("e2"))
    r = rows.join(cache, F.col("masked") == F.col("t"), "left").drop("t").withColumn("canonical", canonical_key(F.col("masked")))
    r = r.join(dimension(keys, bound=bound), F.col("canonical") == F.col("k"), "left").drop("k")
    done = r.where("e1 is not null or e2 is not null").withColumns({"event_id": F.coalesce("e1", "e2"), "source": F.when(F.col("e1").isNotNull(), "exact").otherwise("canonical")})
    open_ = r.where("e1 is null and e2 is null")
    first = open_.groupBy("canonical").agg(F.min("idx").alias("first_idx"), F.min_by("masked", "idx").alias("first_masked"))
    found = nearest_templates(first.select(F.col("first_masked").alias("masked")).distinct(), events, enough=enough, inclusive=True, **options)
    named = first.join(found, F.col("first_masked") == F.col("masked")).select(F.col("canonical").alias("k"), "first_idx", "event_id")
    rest = open_.join(named, F.col("canonical") == F.col("k")).drop("k")
    rest = rest.withColumn("source", F.when(F.col("idx") == F.col("first_idx"), "nearest").otherwise("memo")).drop("first_idx")
    out = done.unionByName(rest.select(*done.columns)).drop("e1", "e2", "canonical")
    return with_template(out, events, bound=bound)


def replay_counters(replayed: DataFrame) -> DataFrame:
    """(rows, cache_hits, fallbacks) of a canonical replay."""
    near = F.count_if(F.col("source") == "nearest")
    return replayed.agg(F.count("*").alias("rows"), (F.count("*") - near).alias("cache_hits"), near.alias("fallbacks"))


def prefix_matches(strings: DataFrame, trained: DataFrame, bound: int | None = None) -> DataFrame:
    """(masked, event_id, matched, n): the longest trained token sequence that begins each string, if it covers half of it.

    Every prefix of a string is looked up in the trained sequences by an equi-join; of equal sequences the last
    trained one counts. strings are different strings; event_id is null without a match.
    """
    t = trained.select(tokens(F.col("masked")).alias("seq"), "event_id", "cluster_id").where(F.size("seq") > 0)
    t = t.groupBy(F.array_join("seq", " ").alias("prefix")).agg(F.max_by("event_id", "cluster_id").alias("event_id"))
    s = strings.select("masked", tokens(F.col("masked")).alias("seq"))
    n = F.size("seq")
    p = s.where(n > 0).select("masked", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("matched"), "seq")
    p = p.select("masked", "n", "matched", F.array_join(F.slice("seq", 1, F.col("matched")), " ").alias("prefix"))
    best = p.join(dimension(t, bound=bound), "prefix").where(F.col("matched") >= 0.5 * F.col("n")).groupBy("masked").agg(F.max_by("event_id", "matched").alias("event_id"), F.max("matched").alias("matched"))
    out = s.select(F.col("masked").alias("m"), F.size("seq").alias("n"))
    return out.join(best, F.col("m") == F.col("masked"), "left").select(F.col("m").alias("masked"), "event_id", F.coalesce("matched", F.lit(0)).alias("matched"), "n")


def replay_prefix(rows: DataFrame, trained: DataFrame, events: DataFrame, *, bound: int | None = None, **options) -> DataFrame:
    """rows with event_id, event_template and source (prefix or nearest), resolved once per different string."""
    strings = rows.select("masked").distinct()
    hit = prefix_matches(strings, trained, bound)
    near = nearest_templates(hit.where("event_id is null").select("masked"), events, **options)
    found = hit.where("event_id is not null").select("masked", "event_id", F.lit("prefix").alias("source")).unionByName(near.withColumn("source", F.lit("nearest")))
    return with_template(rows.join(found.withColumnRenamed("masked", "t"), F.col("masked") == F.col("t")).drop("t"), events, bound=bound)
