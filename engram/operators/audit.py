"""Audit trails: bursts of events, reports, and principals and resources that do not belong."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pattern, event types, threshold, minutes, risk.
PATTERNS = (
    ("brute_force", ("login_failed",), 5, 5, 0.8),
    ("privilege_escalation", ("permission_granted", "role_assigned"), 3, 10, 0.9),
    ("data_exfiltration", ("read",), 100, 5, 0.7),
    ("mass_deletion", ("delete",), 10, 5, 0.9),
    ("api_abuse", ("api_key_used",), 1000, 1, 0.6),
)


def trailing_counts(events: DataFrame, keys: list[str], us: str, width_us: int, out: str = "n") -> DataFrame:
    """Add to each event the number of events of the same keys in the width before it, itself and both ends included.

    Events are cut into slots as long as the width and each is lent to the next slot too, so a window holds two slots'
    events and never all of a key's; null keys count together.
    """
    slot = F.floor((F.col(us) - F.pmod(F.col(us), F.lit(width_us))) / width_us)
    lent = events.withColumn("_at", slot).withColumn("_slot", F.explode(F.array(F.col("_at"), F.col("_at") + 1)))
    back = Window.partitionBy(*keys, "_slot").orderBy(us).rangeBetween(-width_us, 0)
    return lent.withColumn(out, F.count("*").over(back)).filter("_at = _slot").drop("_slot", "_at")


def anomalies(events: DataFrame, id_col: str, principal: str, us: str, kind: Column, patterns: Sequence[tuple] = PATTERNS) -> DataFrame:
    """Events that complete a burst: id, principal, pattern, n, risk. Each event type belongs to one pattern.

    All patterns are counted in one pass: times are stretched so that every pattern's minutes are as long as the longest.
    """
    longest = max(minutes for *_, minutes, _ in patterns)
    rule = F.lit(None).cast("struct<pattern:string,threshold:int,stretch:int,risk:double>")
    for name, kinds, threshold, minutes, risk in patterns:
        if longest % minutes:
            raise ValueError(f"{longest} minutes are no multiple of the {minutes} of {name}")
        rule = F.when(kind.isin(*kinds), F.struct(F.lit(name).alias("pattern"), F.lit(threshold).alias("threshold"), F.lit(longest // minutes).alias("stretch"), F.lit(risk).alias("risk"))).otherwise(rule)
    own = events.select(F.col(id_col).alias("id"), F.col(principal).alias("principal_id"), F.col(us).alias("us"), rule.alias("rule")).filter("rule IS NOT NULL AND us IS NOT NULL")
    timed = own.select("id", "principal_id", "rule.pattern", "rule.threshold", "rule.risk", (F.col("us") * F.col("rule.stretch")).alias("at"))
    counted = trailing_counts(timed, ["principal_id", "pattern"], "at", longest * 60_000_000)
    return counted.filter("n >= threshold").select("id", "principal_id", "pattern", "n", "risk")


def by_type(events: DataFrame, kind: Column) -> DataFrame:
    """Counts per event type: events, failures, principals, high risk (0.8 and more), highest risk."""
    return events.groupBy(kind.alias("event_type")).agg(
        F.count("*").alias("events"), F.count_if(F.col("result") != "success").alias("failures"), F.count_distinct("principal_id").alias("principals"), F.count_if(F.col("risk_score") >= 0.8).alias("high_risk"), F.max("risk_score").alias("max_risk")
    )


def left_logged_in(events: DataFrame, principal: str, us: str, kind: Column) -> DataFrame:
    """Principals whose last login or logout is a login: principal, since_us."""
    seen = events.filter(kind.isin("login", "logout") & F.col(principal).isNotNull() & F.col(us).isNotNull())
    last = seen.groupBy(F.col(principal).alias("principal_id")).agg(F.max(F.col(us) * 2 + F.when(kind == "logout", 1).otherwise(0)).alias("last"))
    return last.filter("last % 2 = 0").select("principal_id", (F.col("last") / 2).cast("long").alias("since_us"))
