"""Preparation, split and evaluation queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from feathergrid.ml import evaluate as E
from feathergrid.ml import prep as M
from feathergrid.plans import roles
from feathergrid.plans.registry import query
from feathergrid.session import table

FL = roles.FLIGHTS_SQL
KEY = ["l_orderkey", "l_linenumber", "l_extendedprice"]
KEYS = ", ".join(KEY)


@query(
    "m1_index_categoricals",
    """with i as (select o_orderpriority, row_number() over (order by count(*) desc, o_orderpriority) - 1 as idx
         from orders where o_orderstatus = 'F' and o_orderpriority <> '5-LOW' group by 1)
       select o_orderkey, coalesce(idx, (select count(*) from i))::double as o_orderpriority_idx
       from orders left join i using (o_orderpriority)""",
)
def m1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    train = o.where("o_orderstatus = 'F' and o_orderpriority <> '5-LOW'")
    return M.index_categoricals(train, o, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority_idx")


@query(
    "m2_one_hot",
    """with i as (select o_orderstatus, row_number() over (order by count(*) desc, o_orderstatus) - 1 as idx
         from orders group by 1)
       select o_orderkey, (idx = 0)::integer::double as c0, (idx = 1)::integer::double as c1, (idx = 2)::integer::double as c2
       from orders join i using (o_orderstatus)""",
)
def m2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    hot = M.one_hot(M.index_categoricals(o, o, ["o_orderstatus"]), ["o_orderstatus_idx"])
    return hot.select("o_orderkey", *[F.get("o_orderstatus_idx_class", F.lit(i)).alias(f"c{i}") for i in range(3)])


@query(
    "m3_impute_median",
    f"""select {KEYS}, coalesce(weather_delay, (select median(weather_delay) from ({FL}))) as weather_delay,
        coalesce(dep_del15, (select median(dep_del15) from ({FL})))::double as dep_del15 from ({FL})""",
)
def m3(spark, d):
    f = roles.flights(spark, d).select(*KEY, "weather_delay", "dep_del15")
    return M.impute_median(f, ["weather_delay", "dep_del15"])


@query(
    "m4_assemble",
    f"select {KEYS}, 3 as size, round(l_quantity + l_discount + l_tax, 6) as total from lineitem",
)
def m4(spark, d):
    li = M.assemble(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    parts = vector_to_array("features")
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return li.select(*KEY, F.size(parts).alias("size"), F.round(total, 6).alias("total"))


@query(
    "m5_standardize",
    f"""select {KEYS}, round((l_quantity - (select avg(l_quantity) from lineitem)) / (select stddev_samp(l_quantity) from lineitem), 6)
        as z0, round((l_discount - (select avg(l_discount) from lineitem)) / (select stddev_samp(l_discount) from lineitem), 6)
        as z1 from lineitem""",
)
def m5(spark, d):
    li = M.standardize(M.assemble(table(spark, d, "lineitem"), ["l_quantity", "l_discount"]))
    z = vector_to_array("scaled")
    return li.select(*KEY, F.round(z[0], 6).alias("z0"), F.round(z[1], 6).alias("z1"))


@query(
    "m6_holdout_by_time",
    """select case when year(l_shipdate) = 2001 then 'test' else 'train' end as part, count(*) as n,
       min(year(l_shipdate))::integer as first_year, max(year(l_shipdate))::integer as last_year from lineitem group by 1""",
)
def m6(spark, d):
    li = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("yr"))
    train, test = M.holdout_by_time(li, F.col("yr"), 2001)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("yr").alias("first_year"), F.max("yr").alias("last_year")
    )


@query(
    "m7_stratified_split",
    """select doc_id, lang, case when (rn - 1) / n < 0.8 then 'train' when (rn - 1) / n < 0.9 then 'val' else 'test' end
       as data_type from (select doc_id, lang, row_number() over (partition by lang order by md5('42:' || doc_id::varchar),
       doc_id) as rn, count(*) over (partition by lang) as n from documents)""",
)
def m7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return M.stratified_split(docs, "lang", ["doc_id"], 42, {"train": 0.8, "val": 0.1, "test": 0.1})


_FRACTION = "('0x' || left(md5('{seed}:' || {key}::varchar), 8))::bigint / 4294967296.0"


@query(
    "m8_random_split",
    f"""select o_orderkey, case when {_FRACTION.format(seed=1, key='o_orderkey')} < 0.6 then 'train'
        when {_FRACTION.format(seed=1, key='o_orderkey')} < 0.8 then 'val' else 'test' end as data_type from orders""",
)
def m8(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return M.random_split(o, ["o_orderkey"], 1, {"train": 0.6, "val": 0.2, "test": 0.2})


_LABELLED = "select event_id, case when event_type in ('error', 'signup') then 1 else 0 end as y from events"


def labelled(spark, d):
    flag = F.when(F.col("event_type").isin("error", "signup"), 1).otherwise(0)
    return table(spark, d, "events").select("event_id", flag.alias("y"))


@query(
    "m9_oversample_minority",
    f"""with e as ({_LABELLED}), r as (select count(*) filter (y = 0) / count(*) filter (y = 1) as ratio from e)
        select event_id, y from (select event_id, y, unnest(range(case when y = 0 then 1 else floor(ratio)::bigint +
        case when {_FRACTION.format(seed=123, key='event_id')} < ratio - floor(ratio) then 1 else 0 end end)) from e, r)""",
)
def m9(spark, d):
    return M.oversample_minority(labelled(spark, d), "y", ["event_id"], 123)


@query("m9_oversample_poisson")
def m9b(spark, d):
    return M.oversample_poisson(labelled(spark, d), "y", 123).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m10_fold_column",
    "select o_orderkey, (year(o_orderdate) - 1995)::integer as fold from orders",
)
def m10(spark, d):
    o = table(spark, d, "orders")
    return M.fold_column(o, F.year("o_orderdate"), range(1995, 2002)).select("o_orderkey", "fold")


@query(
    "m12_walk_forward_windows",
    """with m as (select date_trunc('month', l_shipdate)::date as month, count(*) as n,
         sum(case when l_returnflag = 'R' then 1 else 0 end) as y from lineitem group by 1),
       w as (select cycle, (f + to_months(cycle::integer))::date as train_start,
         (f + to_months(cycle::integer + 24))::date as train_stop, (f + to_months(cycle::integer + 36))::date as predict_start,
         (f + to_months(cycle::integer + 37))::date as predict_stop
         from (select min(month) as f from m), (select unnest(range(40)) as cycle)),
       t as (select cycle, sum(n)::bigint as train_rows, sum(y)::bigint as train_hits from w join m on month >= train_start and
         month < train_stop group by 1),
       p as (select cycle, sum(n)::bigint as predict_rows from w join m on month >= predict_start and month < predict_stop group by 1)
       select cycle::integer as cycle, cast(train_start as varchar) as train_start, cast(predict_start as varchar) as predict_start,
         train_rows, train_hits, predict_rows from w join t using (cycle) join p using (cycle)""",
)
def m12(spark, d):
    li = table(spark, d, "lineitem")
    hit = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    # windows are whole months: 24 copies of a monthly total instead of 24 copies of every row
    monthly = li.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("y")
    )
    windows = M.walk_forward_windows(monthly, "month", cycles=40, train_years=2)
    train = M.assign_cycles(monthly, "month", windows, "train_start", "train_stop").groupBy("cycle").agg(
        F.sum("n").alias("train_rows"), F.sum("y").alias("train_hits")
    )
    predict = M.assign_cycles(monthly, "month", windows, "predict_start", "predict_stop").groupBy("cycle").agg(
        F.sum("n").alias("predict_rows")
    )
    out = windows.join(train, "cycle").join(predict, "cycle")
    return out.select(
        "cycle",
        F.col("train_start").cast("string").alias("train_start"),
        F.col("predict_start").cast("string").alias("predict_start"),
        "train_rows",
        "train_hits",
        "predict_rows",
    )


# --- evaluation of a fixed scoring rule ------------------------------------------------------------
_SCORED = """select l_orderkey, l_linenumber, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax,
    case when l_returnflag = 'R' then 1 else 0 end as label,
    case when l_discount * 10 + l_quantity / 50 > 1.1 then 1 else 0 end as prediction,
    round(l_discount * 10 + l_quantity / 50, 6) as score from lineitem"""


def scored(spark, d):
    s = F.col("l_discount") * 10 + F.col("l_quantity") / 50
    return table(spark, d, "lineitem").select(
        *KEY,
        "l_shipdate",
        "l_quantity",
        "l_discount",
        "l_tax",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(s > 1.1, 1).otherwise(0).alias("prediction"),
        F.round(s, 6).alias("score"),
    )


_CLASSED = """select o_orderkey, o_orderstatus as label, case when o_totalprice < 100000 then 'O'
    when o_custkey % 3 = 0 then 'F' else 'P' end as prediction from orders"""


def classed(spark, d):
    said = F.when(F.col("o_totalprice") < 100000, "O").when(F.col("o_custkey") % 3 == 0, "F").otherwise("P")
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"), said.alias("prediction"))


_PER = f"""c as (select label, prediction, count(*) as n from ({_CLASSED}) group by 1, 2),
    a as (select label, sum(n) as support, sum(case when label = prediction then n else 0 end) as hit from c group by 1),
    s as (select prediction as label, sum(n) as said from c group by 1),
    m as (select label, support, coalesce(hit / said, 0) as p, hit / support as r from a left join s using (label)),
    f as (select *, coalesce(2 * p * r / (p + r), 0) as f from m)"""


@query(
    "m19_label_metrics",
    f"""with {_PER} select label, support::bigint as support, round(p, 6) as "precision", round(r, 6) as recall,
        round(f, 6) as f from f""",
)
def m19a(spark, d):
    out = E.label_metrics(classed(spark, d), "label", "prediction")
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query(
    "m19_class_metrics",
    f"""with {_PER} select sum(support)::bigint as n, round(sum(p * support) / sum(support), 6) as weighted_precision,
        round(sum(r * support) / sum(support), 6) as weighted_recall, round(sum(f * support) / sum(support), 6) as weighted_f,
        round(sum(r * support) / sum(support), 6) as accuracy from f""",
)
def m19b(spark, d):
    out = E.class_metrics(classed(spark, d), "label", "prediction")
    cols = ["weighted_precision", "weighted_recall", "weighted_f", "accuracy"]
    return out.select("n", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "m20_confusion_matrix",
    f"""select label, count(*) filter (prediction = 'F') as "F", count(*) filter (prediction = 'O') as "O",
        count(*) filter (prediction not in ('F', 'O')) as other from ({_CLASSED}) group by 1""",
)
def m20a(spark, d):
    return E.confusion_matrix(classed(spark, d), "label", "prediction", ["F", "O"])


@query(
    "m20_binary_confusion",
    f"""select count(*) filter (label = 1 and prediction = 1) as tp, count(*) filter (label = 0 and prediction = 1) as fp,
        count(*) filter (label = 1 and prediction = 0) as fn, count(*) filter (label = 0 and prediction = 0) as tn
        from ({_SCORED})""",
)
def m20b(spark, d):
    return E.binary_confusion(scored(spark, d), "label", "prediction")


@query(
    "m21_roc_auc",
    f"""with s as ({_SCORED}), r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0
          as rk from s), t as (select sum(label) as p, count(*) - sum(label) as q, sum(case when label = 1 then rk end) as rs from r)
        select p::bigint as positives, q::bigint as negatives, round((rs - p * (p + 1) / 2) / (p * q), 9) as auc from t""",
)
def m21(spark, d):
    return E.roc_auc(scored(spark, d), "label", "score").withColumn("auc", F.round("auc", 9))


@query(
    "m21_roc_points",
    f"""with s as ({_SCORED}), g as (select score, sum(label) as p, count(*) - sum(label) as q from s group by 1)
        select score, round(sum(q) over w / sum(q) over (), 6) as fpr, round(sum(p) over w / sum(p) over (), 6) as tpr
        from g window w as (order by score rows between current row and unbounded following)""",
)
def m21b(spark, d):
    out = E.roc_points(scored(spark, d), "label", "score")
    return out.select("score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "m22_per_class_accuracy",
    f"""select label, sum((label = prediction)::integer)::bigint as "right", count(*) as n,
        round(avg((label = prediction)::integer), 6) as accuracy from ({_CLASSED}) group by 1""",
)
def m22(spark, d):
    out = E.per_class_accuracy(classed(spark, d), "label", "prediction")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("m23_misclassified_rows", f"select * from ({_CLASSED}) where label <> prediction and label = 'F'")
def m23(spark, d):
    return E.misclassified_rows(classed(spark, d), "label", "prediction", "F")


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _permuted_sql(feature, seed):
    h = "md5('{s}:' || event_id::varchar)"
    return f"""select r.y, r.value, r.k, x.{feature} as shuffled from (select *, row_number() over (order by
        {h.format(s=seed)}, event_id) as rn from base) r join (select {feature}, row_number() over (order by
        {h.format(s=seed + 1)}, event_id) as rn from base) x using (rn)"""


def _rule(value, k):
    return f"case when {value} * 2 + {k} > 90 then 1 else 0 end"


_BASE = """base as materialized (select event_id, value, json_extract(props, '$.k')::double as k,
    case when value * 2 + json_extract(props, '$.k')::double + event_id % 17 > 95 then 1 else 0 end as y from events)"""


@query(
    "m24_permutation_importance",
    f"""with {_BASE}, b as (select avg(({_rule('value', 'k')} = y)::integer) as a from base)
        select 'value' as feature, round((select a from b) - avg(({_rule('shuffled', 'k')} = y)::integer), 6) as importance
        from ({_permuted_sql('value', 5)})
        union all select 'k', round((select a from b) - avg(({_rule('value', 'shuffled')} = y)::integer), 6)
        from ({_permuted_sql('k', 7)})""",
)
def m24(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, d, "events").select("event_id", "value", k.alias("k"))
    y = F.when(F.col("value") * 2 + F.col("k") + F.col("event_id") % 17 > 95, 1).otherwise(0)
    rule = F.when(F.col("value") * 2 + F.col("k") > 90, 1).otherwise(0)
    out = E.permutation_importance(e.withColumn("y", y), ["event_id"], ["value", "k"], "y", rule, 5)
    return out.withColumn("importance", F.round("importance", 6))


_CYCLES = """select strftime(l_shipdate, '%Y-%m') as cycle, unnest(['quantity', 'discount', 'tax']) as feature,
    unnest([corr(l_quantity, l_extendedprice), corr(l_discount, l_extendedprice), corr(l_tax, l_extendedprice)]) as importance
    from lineitem group by 1"""


@query(
    "m24_importance_summary",
    f"""with m as (select feature, avg(abs(importance)) as v from ({_CYCLES}) group by 1)
        select feature, round(v, 6) as value_score, round((v - (select min(v) from m)) / (select max(v) - min(v) from m), 6)
        as scaled from m""",
)
def m24b(spark, d):
    li = table(spark, d, "lineitem")
    cycles = li.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("cycle")).agg(
        *[F.corr(f"l_{c}", "l_extendedprice").alias(c) for c in ("quantity", "discount", "tax")]
    )
    out = E.importance_summary(cycles.unpivot(["cycle"], ["quantity", "discount", "tax"], "feature", "importance"))
    return out.select("feature", F.round("value_score", 6).alias("value_score"), F.round("scaled", 6).alias("scaled"))


@query(
    "m32_target_encode",
    """with t as (select l_suppkey, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem where year(l_shipdate) < 2000
         and l_suppkey % 10 <> 3), g as (select avg(y) as m from t), s as (select l_suppkey, sum(y) as s, count(*) as n from t group by 1)
       select l_orderkey, l_linenumber, l_extendedprice, round(coalesce((s + 5.0 * m) / (n + 5.0), m), 8) as l_suppkey_enc
       from lineitem left join s using (l_suppkey), g""",
)
def m32(spark, d):
    li = table(spark, d, "lineitem").select(*KEY, "l_suppkey", "l_shipdate", "l_returnflag")
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    train = li.where((F.year("l_shipdate") < 2000) & (F.col("l_suppkey") % 10 != 3)).withColumn("y", y)
    out = M.target_encode(train, li, "l_suppkey", "y", smoothing=5.0)
    return out.select(*KEY, F.round("l_suppkey_enc", 8).alias("l_suppkey_enc"))


_RACE = {
    "every trade": ("1", lambda: F.lit(1)),
    "perfect": ("case when l_discount - 0.04 > 0 then 1 else 0 end", lambda: F.when(F.col("resp") > 0, 1).otherwise(0)),
    "rule": ("prediction", lambda: F.col("prediction")),
}


def _race_sql(model, action):
    return f"""select '{model}' as model, avg((({action}) = (l_discount - 0.04 > 0)::integer)::integer) as accuracy,
        (with p as (select l_shipdate, sum(l_quantity * (l_discount - 0.04) * ({action})) as p from ({_SCORED}) group by 1),
         s as (select count(*) as n, sum(p) as sp, sqrt(sum(p * p)) as sq from p)
         select least(greatest(sp / sq * sqrt(250.0 / n), 0), 6) * sp from s) as utility from ({_SCORED})"""


@query(
    "m33_horse_race_table",
    "select model, round(accuracy, 6) as accuracy, round(utility, 4) as utility from ("
    + " union all ".join(_race_sql(m, a) for m, (a, _) in _RACE.items())
    + ")",
)
def m33(spark, d):
    trades = scored(spark, d).withColumn("resp", F.col("l_discount") - 0.04)
    trades = trades.withColumn("truth", F.when(F.col("resp") > 0, 1).otherwise(0))
    rows = [
        E.horse_race_row(trades.withColumn("action", act()), m, "truth", "action", "l_shipdate", "l_quantity", "resp")
        for m, (_, act) in _RACE.items()
    ]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.select("model", F.round("accuracy", 6).alias("accuracy"), F.round("utility", 4).alias("utility"))


@query(
    "m36_baseline_log_odds",
    f"select round(ln(avg(label) / (1 - avg(label))), 6) as intercept from ({_SCORED})",
)
def m36(spark, d):
    return E.baseline_log_odds(scored(spark, d), "label").withColumn("intercept", F.round("intercept", 6))
