"""The flight story in one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from feathergrid.operators.rolling import DAY, leaky_frame, with_rolling
from feathergrid.operators.joins import lookup
from feathergrid.functions.timefns import epoch_seconds
from feathergrid.plans.registry import query
from feathergrid.session import table


@query(
    "flagship_rolling_rate_by_nation",
    """
    with f as (
      select l_partkey, l_suppkey, cast(epoch(l_shipdate) as bigint) as t,
             case when l_returnflag = 'R' then 1 else 0 end as late from lineitem),
    r as (
      select l_suppkey, late, avg(late) over (partition by l_partkey order by t
             range between 2592000 preceding and current row) as rolling_average from f)
    select n_name, count(*) as flights, sum(late)::bigint as late_flights, round(avg(late), 6) as late_rate,
           round(avg(rolling_average), 6) as mean_rolling_average,
           round(avg(case when rolling_average >= 0.5 then late end), 6) as late_rate_after_bad_month
    from r join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by n_name
    """,
)
def flagship(spark, d):
    f = table(spark, d, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        epoch_seconds(F.col("l_shipdate")).alias("t"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("late"),
    )
    # the report needs no single rows: collapse to (key, second, supplier) first
    per_second = f.groupBy("l_partkey", "t", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("late").alias("late")
    )
    rolled = with_rolling(
        per_second, ["l_partkey"], "t", {"late": F.col("late"), "seen": F.col("n")}, {"month": leaky_frame(30 * DAY)}
    )
    rate = F.col("late_month") / F.col("seen_month")
    bad = rate >= 0.5
    nations = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")
    ).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    joined = lookup(rolled, nations, "l_suppkey")
    return joined.groupBy("n_name").agg(
        F.sum("n").alias("flights"),
        F.sum("late").alias("late_flights"),
        F.round(F.sum("late") / F.sum("n"), 6).alias("late_rate"),
        F.round(F.sum(rate * F.col("n")) / F.sum("n"), 6).alias("mean_rolling_average"),
        F.round(F.try_divide(F.sum(F.when(bad, F.col("late"))), F.sum(F.when(bad, F.col("n")))), 6).alias(
            "late_rate_after_bad_month"
        ),
    )
