"""Model queries: each returns a small table of metrics."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from feathergrid.ml import evaluate as E
from feathergrid.ml import models as M
from feathergrid.ml import neighbors as N
from feathergrid.ml import prep
from feathergrid.plans import roles
from feathergrid.plans.registry import query
from feathergrid.plans.solving import newton_ctes
from feathergrid.session import spread, table

NUM = ["l_quantity", "l_discount", "l_tax", "weather_delay"]
CAT = ["carrier", "dest"]


#: Rows in a partition of a fit: a forest keeps a number per tree beside each, so that splits of a packed file are too large.
ROWS = 500_000


def delays(spark, d):
    """Flights with a known label that depends on the features, and a fold per year."""
    f = roles.flights(spark, d).where(F.col("dep_del15").isNotNull())
    signal = F.col("l_quantity") / 50 + F.col("l_discount") * 5 + F.col("dep_del15") * 0.5 + F.col("carrier") * 0.05
    return f.select(
        *NUM,
        F.col("carrier").cast("string").alias("carrier"),
        F.col("dest").cast("string").alias("dest"),
        "yr",
        "dep_t",
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "fl_date",
        F.col("dep_del15").alias("late"),
        F.when(signal > 1.3, 1.0).otherwise(0.0).alias("label"),
        (F.col("yr") - 1995).alias("fold"),
    )


def parts(spark, d):
    """Past years to train, the last year held out."""
    rows = spread(delays(spark, d), "l_orderkey", ROWS).select(*CAT, *NUM, "label", "yr")
    return prep.holdout_by_time(rows.cache(), F.col("yr"), 2001)


@query("m11_timeseries_cv")
def m11(spark, d):
    train = spread(delays(spark, d), "l_orderkey", ROWS).select(*CAT, *NUM, "label", "fold").cache()
    folds = train.agg(F.max("fold")).first()[0]
    return M.timeseries_cv(train, "logistic", "label", "fold", folds, CAT, NUM, M.GRIDS["logistic"])[1]


@query("m13_logistic_regression")
def m13(spark, d):
    train, test = parts(spark, d)
    return M.grid_scores(train, test, "logistic", "label", CAT, NUM, M.all_maps("logistic"))


@query("m14_random_forest")
def m14(spark, d):
    train, test = parts(spark, d)
    return M.grid_scores(train, test, "forest", "label", CAT, NUM, [{"numTrees": 20, "maxDepth": 4}])


@query("m15_linear_svm")
def m15(spark, d):
    train, test = parts(spark, d)
    return M.grid_scores(train, test, "svm", "label", CAT, NUM, M.all_maps("svm"))


@query("m16_gbt")
def m16(spark, d):
    train, test = parts(spark, d)
    return M.grid_scores(train, test, "boosted", "label", CAT, NUM, M.all_maps("boosted"))


_GD_STEPS = 50


def _gd_sql():
    names = ["l_quantity", "l_discount", "l_tax"]
    z = ", ".join(f"({c} - avg({c}) over ()) / stddev_samp({c}) over () as z{i}" for i, c in enumerate(names, 1))
    base = f"""base as materialized (select {z}, case when l_returnflag = 'R' and l_discount > 0.03 then 1 else 0 end as y
        from lineitem), m as (select avg(y) as p, count(*) as n from base)"""
    ctes = [base, "w0 as (select ln(p / (1 - p)) as w0, 0.0 as w1, 0.0 as w2, 0.0 as w3 from m)"]
    prob = "1 / (1 + exp(-(w0 + w1 * z1 + w2 * z2 + w3 * z3)))"
    for s in range(1, _GD_STEPS + 1):
        grads = ", ".join(
            f"any_value(w{i}) - 0.1 * (sum(({prob} - y){f' * z{i}' if i else ''}) / count(*)"
            + (f" + 0.05 * sign(any_value(w{i})) / count(*) + 0.05 * any_value(w{i}) / count(*)" if i else "")
            + f") as w{i}"
            for i in range(4)
        )
        ctes.append(f"w{s} as materialized (select {grads} from base, w{s - 1})")
    rows = " union all ".join(
        f"""select {s} as step, sum(-(y * ln({prob}) + (1 - y) * ln(1 - {prob}))) / count(*)
            + 0.05 / count(*) * (abs(any_value(w1)) + abs(any_value(w2)) + abs(any_value(w3)))
            + 0.05 / (2 * count(*)) * (pow(any_value(w1), 2) + pow(any_value(w2), 2) + pow(any_value(w3), 2)) as loss
            from base, w{s}"""
        for s in range(1, _GD_STEPS + 1)
    )
    return f"with {', '.join(ctes)} select step, round(loss, 8) as loss from ({rows})"


@query("m17_logistic_gd", _gd_sql())
def m17(spark, d):
    from feathergrid.operators.aggs import zscore

    li = table(spark, d, "lineitem")
    y = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.03), 1).otherwise(0)
    names = ["l_quantity", "l_discount", "l_tax"]
    z = zscore(spread(li.select("l_orderkey", *names, y.alias("y")), "l_orderkey"), names)
    _, losses = M.logistic_gd(z, "y", names, _GD_STEPS)
    rows = [(i, round(v, 8)) for i, v in enumerate(losses, 1)]
    return spark.createDataFrame(rows, "step int, loss double")


#: 50 draws of a search space of a continuous and a discrete parameter.
_DRAWS = M.random_search({"penalty": M.LogUniform(1e-4, 1.0), "positive_weight": [0.5, 1.0, 2.0, 4.0]}, n_iter=50)
_SEARCHED = ["l_quantity", "l_discount", "carrier", "late"]


def _search_sql(steps=8):
    """All draws' ridge logistic models by unrolled Newton steps, and their scores on the last year."""
    draws = ", ".join(f"({i}, {d['penalty']!r}::double, {d['positive_weight']!r}::double)" for i, d in enumerate(_DRAWS))
    scaled = ", ".join(f"({c} - m.{c}_m) / m.{c}_s as v{i}" for i, c in enumerate(_SEARCHED, 1))
    stats = ", ".join(f"avg({c}) as {c}_m, stddev_samp({c}) as {c}_s" for c in _SEARCHED)
    eta = " + ".join(f"b{i} * v{i}" for i in range(5))
    return f"""with f as ({roles.FLIGHTS_SQL}),
        known as materialized (select yr, l_quantity::double as l_quantity, l_discount::double as l_discount, carrier::double as carrier,
          dep_del15::double as late, case when l_quantity / 50 + l_discount * 5 + dep_del15 * 0.5::double + carrier * 0.05::double > 1.3::double then 1.0 else 0.0 end as hit
          from f where dep_del15 is not null),
        m as materialized (select count(*) as rows_, {stats} from known where yr <> 2001),
        z as materialized (select yr, hit::double as hit, 1.0::double as v0, {scaled} from known, m),
        draws as materialized (select draw, penalty, penalty * rows_ as pen, positive_weight from (values {draws}) t(draw, penalty, positive_weight), m),
        tr as materialized (select draw, pen, hit * positive_weight as y, case when hit > 0.5 then positive_weight else 1.0 end as n,
          v0, v1, v2, v3, v4 from z, draws where yr <> 2001),
        {newton_ctes('tr', 5, steps, keys='draw', ridge='any_value(pen)', trials='n')}
        select draw, round(any_value(penalty), 8) as penalty, any_value(positive_weight) as positive_weight,
          round(avg(case when ({eta} >= 0) = (hit > 0.5) then 1.0 else 0.0 end), 6) as accuracy,
          round(avg(ln(1 + exp({eta})) - hit * ({eta})), 6) as loss
        from z, draws join b{steps} using (draw) where yr = 2001 group by draw"""


@query("m18_random_search", _search_sql())
def m18(spark, d):
    rows = delays(spark, d).select(
        "yr", "l_quantity", "l_discount", F.col("carrier").cast("int").alias("carrier"), F.col("late").alias("late"), "label"
    )
    train, test = prep.holdout_by_time(rows, F.col("yr"), 2001)
    found = M.logistic_search(train, test, "label", _SEARCHED, _DRAWS)
    return found.select("draw", F.round("penalty", 8).alias("penalty"), "positive_weight", *[F.round(c, 6).alias(c) for c in ("accuracy", "loss")])


@query("m24_feature_importance")
def m24(spark, d):
    train, _ = parts(spark, d)
    model = M.fit(train, "forest", "label", CAT, NUM, numTrees=100, maxDepth=4)
    return M.feature_importance(spark, model, [*CAT, *NUM])


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(
        "vec_id",
        "embedding",
        "label",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.when(F.col("label") < 5, 1.0).otherwise(0.0).alias("y"),
    )


def halves(df, key):
    return df.where(F.col(key) % 2 == 0), df.where(F.col(key) % 2 == 1)


@query("m25_pca")
def m25(spark, d):
    return M.pca_variance(vectors(spark, d), "features", 60)[1]


_VALUES = """v as materialized (select vec_id, (label < 5)::integer as y, unnest(embedding)::double as x,
    generate_subscripts(embedding, 1) as j from embeddings),
  t as (select * from v where vec_id % 2 = 0), q as (select * from v where vec_id % 2 = 1),
  c as materialized (select y, count(distinct vec_id) as n from t group by 1),
  pi as (select y, ln(n + 1.0) - ln((select sum(n) from c) + 2.0) as p from c)"""


def _bayes_sql(theta, score):
    return f"""with {_VALUES}, {theta}, s as (select q.vec_id, th.y, any_value(pi.p) + sum({score}) as s from q join th on th.j = q.j
        join pi on pi.y = th.y group by 1, 2)
      select vec_id, y::double as prediction from s qualify row_number() over (partition by vec_id order by s desc, y) = 1"""


@query(
    "m26_naive_bayes_bernoulli",
    _bayes_sql(
        """th as materialized (select j, t.y, ln(sum((x > 0)::integer) + 1.0) - ln(any_value(n) + 2.0) as one,
           ln(any_value(n) - sum((x > 0)::integer) + 1.0) - ln(any_value(n) + 2.0) as zero from t join c on c.y = t.y group by 1, 2)""",
        "case when x > 0 then one else zero end",
    ),
)
def m26(spark, d):
    train, test = halves(vectors(spark, d), "vec_id")
    return M.naive_bayes(train, test, "y", "features", "bernoulli").select("vec_id", "prediction")


@query(
    "m26_naive_bayes_multinomial",
    _bayes_sql(
        """r as materialized (select j, min(x) as lo, max(x) as hi from t group by 1),
           w as (select j, y, sum((x - lo) / (hi - lo)) as w from t join r using (j) group by 1, 2),
           th as materialized (select w.j, y, lo, hi, ln(w + 1.0) - ln(sum(w) over (partition by y)
             + count(*) over (partition by y)) as theta from w join r on r.j = w.j)""",
        "theta * greatest((x - lo) / (hi - lo), 0)",
    ),
)
def m26b(spark, d):
    train, test = halves(vectors(spark, d), "vec_id")
    return M.naive_bayes(train, test, "y", "features", "multinomial").select("vec_id", "prediction")


@query(
    "m27_tfidf_nb",
    r"""with d as (select *, doc_id % 5 = 0 as held from documents),
       w as (select doc_id, lang, held, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'),
             lambda x: length(x) >= 2)) as term from d),
       tf as (select doc_id, lang, held, term, count(*) as tf from w group by all),
       nd as (select count(*) as n, count(distinct lang) as k from d where not held),
       idf as materialized (select term, ln(((select n from nd) + 1) / (count(*) + 1.0)) as idf from tf where not held group by 1),
       wt as materialized (select tf.*, tf * idf as w from tf join idf using (term)),
       nm as materialized (select doc_id, sqrt(sum(w * w)) as norm, sum(w) as s from wt group by 1),
       mass as materialized (select lang as c, term, sum(w / norm) as mass from wt join nm using (doc_id) where not held and norm > 0
             group by 1, 2),
       cls as (select lang as c, ln(count(*) + 1.0) - ln((select n + k from nd)) as prior, -ln(coalesce((select sum(mass) from mass m
             where m.c = lang), 0) + (select count(*) from idf)) as rest from d where not held group by 1),
       hits as (select doc_id, c, sum(w * ln(1 + mass)) as hit from wt join mass using (term) where held group by 1, 2),
       p as (select d.doc_id, d.lang as label, cls.c as prediction, row_number() over (partition by d.doc_id order by prior + case when
             norm > 0 then (coalesce(hit, 0) + rest * s) / norm else 0 end desc, cls.c) as k from d join cls on d.held
             left join nm on nm.doc_id = d.doc_id left join hits on hits.doc_id = d.doc_id and hits.c = cls.c),
       q as (select label, prediction from p where k = 1),
       per as (select label, count(*) as support, count(*) filter (label = prediction) as hit,
             (select count(*) from q z where z.prediction = q.label) as said from q group by 1)
       select label, support, round(case when said = 0 then 0 else hit / said end, 6) as precision, round(hit / support, 6) as recall,
             round(case when hit = 0 then 0 else 2 * hit / (said + support) end, 6) as f from per""",
)
def m27(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    out = M.tfidf_nb(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0"), "doc_id", "text", "lang")
    metrics = E.label_metrics(out, "lang", "prediction")
    return metrics.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query(
    "m28_knn_classify",
    """with e as (select vec_id, embedding::double[] as v, label from embeddings),
       n as (select q.vec_id, t.label, row_number() over (partition by q.vec_id order by list_distance(q.v, t.v), t.vec_id) as r
             from e q, e t where q.vec_id % 2 = 1 and t.vec_id % 2 = 0),
       c as (select vec_id, k, label, count(*) as votes from n, (select unnest([1, 3, 5, 7, 9]) as k) where r <= k group by 1, 2, 3)
       select vec_id, k, label::double as prediction from c
       qualify row_number() over (partition by vec_id, k order by votes desc, label) = 1""",
)
def m28(spark, d):
    train, test = halves(table(spark, d, "embeddings"), "vec_id")
    return N.knn_classify(train, test, "vec_id", "embedding", "label", [1, 3, 5, 7, 9])


def squared(spark, d):
    f = VectorAssembler(inputCols=NUM, outputCol="features", handleInvalid="skip").transform(
        delays(spark, d).na.fill(0.0, subset=["weather_delay"])
    )
    rows = spread(f, "l_orderkey", ROWS).select("features", "label", "yr", "fl_date", "l_quantity", "l_discount")
    return prep.holdout_by_time(rows.cache(), F.col("yr"), 2001)


@query("m29_linear_models_as_classifier")
def m29(spark, d):
    train, test = squared(spark, d)
    return E.metrics_table(
        {n: E.class_metrics(M.linear_as_classifier(train, test, "label", n), "label", "prediction") for n in M.LINEAR_MODELS}
    )


@query("m30_gmm_class_conditional")
def m30(spark, d):
    v = vectors(spark, d)
    small = PCA(k=4, inputCol="features", outputCol="pc").fit(v).transform(v)
    train, test = halves(small, "vec_id")
    out = M.gmm_class_conditional(train, test, "y", "pc", k=2)
    return E.class_metrics(out, "y", "prediction")


@query("m31_select_from_model")
def m31(spark, d):
    train, _ = squared(spark, d)
    rows = [(how, NUM[i]) for how in ("mean", "nonzero") for i in M.select_from_model(train, "label", how)[0]]
    return spark.createDataFrame(rows, "rule string, feature string")


@query("m33_horse_race_fitted")
def m33(spark, d):
    train, test = squared(spark, d)
    rows = None
    for name in M.LINEAR_MODELS:
        out = M.linear_as_classifier(train, test, "label", name)
        trades = out.withColumn("resp", F.col("l_discount") - 0.04)
        one = E.horse_race_row(trades, name, "label", "prediction", "fl_date", "l_quantity", "resp")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    "m34_temporal_slices",
    """select floor((rn - 1) / 10000)::bigint as slice, count(*) as n, min(o_orderkey) as first_key from
       (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as rn from orders) group by 1""",
)
def m34a(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    sliced = M.temporal_slices(o, ["o_orderdate", "o_orderkey"], 10_000)
    return sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("m34_temporal_grid_eval")
def m34b(spark, d):
    f = delays(spark, d)
    size = -(-f.count() // 8)
    order = ["dep_t", "l_orderkey", "l_linenumber", "l_extendedprice"]
    sliced = M.temporal_slices(f, order, size).cache()
    # all rounds that eight slices allow, the last test slice cut short where it has to be
    moving = M.temporal_grid_eval(sliced, "label", "logistic", NUM, 2, 1, 2)
    moving = moving.unionByName(M.temporal_grid_eval(sliced.withColumn("slice", F.col("slice") - 6), "label", "logistic", NUM, 1, 1, 1))
    growing = M.temporal_grid_eval(sliced, "label", "logistic", NUM, 2, 2, 3, growing=True)
    return moving.withColumn("kind", F.lit("moving")).unionByName(growing.withColumn("kind", F.lit("growing")))


@query("m35_rf_regressor")
def m35(spark, d):
    train, test = squared(spark, d)
    return M.rf_regressor(train, test, "label", numTrees=100, maxDepth=4)
