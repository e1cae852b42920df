"""Regression and time-series table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feathergrid.operators import regress as D
from feathergrid.operators import series as S
from feathergrid.operators.binomial import POISSON, PRIME, ROUNDS, Z95
from feathergrid.plans.registry import query
from feathergrid.plans.solving import hash_sql, hessian_sql, inverse_diagonal_sql, newton_ctes, pairs, solve_sql
from feathergrid.plans.windows import acf_sql
from feathergrid.session import table


def two_predictors_sql(source, y, a, b):
    """Least squares of y on a and b in closed form: one row of coefficients, errors and fit."""
    return f"""(select n, my - b1 * ma - b2 * mb as b0, b1, b2, rss, syy, rss / (n - 3) as s2,
      sqrt(rss / (n - 3) * (1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) as se0,
      sqrt(rss / (n - 3) * sbb / det) as se1, sqrt(rss / (n - 3) * saa / det) as se2 from (
      select *, syy - b1 * say - b2 * sby as rss from (
      select *, (sbb * say - sab * sby) / det as b1, (saa * sby - sab * say) / det as b2 from (
      select *, saa * sbb - sab * sab as det from (
      select count(*) as n, avg({y}) as my, avg({a}) as ma, avg({b}) as mb, var_pop({a}) * count(*) as saa,
      var_pop({b}) * count(*) as sbb, covar_pop({a}, {b}) * count(*) as sab, covar_pop({a}, {y}) * count(*) as say,
      covar_pop({b}, {y}) * count(*) as sby, var_pop({y}) * count(*) as syy from {source})))))"""


def _terms_sql(source, y, a, b, digits=4):
    one = two_predictors_sql(source, y, a, b)
    return " union all ".join(
        f"select '{name}' as term, round(b{i}, {digits}) as estimate, round(se{i}, {digits}) as std_error, "
        f"round(b{i} / se{i}, {digits}) as t from {one}"
        for i, name in ((0, "(intercept)"), (1, a), (2, b))
    )


def _rounded(df, digits=4):
    return df.select("term", *[F.round(c, digits).alias(c) for c in ("estimate", "std_error", "t")])


@query("d1_ols_summary", _terms_sql("lineitem", "l_extendedprice", "l_quantity", "l_discount"))
def d1(spark, d):
    return _rounded(D.ols_summary(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])[0])


@query(
    "d1_ols_fit",
    f"""select n, round(1 - rss / syy, 6) as r2, round(1 - (rss / (n - 3)) / (syy / (n - 1)), 6) as adj_r2
        from {two_predictors_sql('lineitem', 'l_extendedprice', 'l_quantity', 'l_discount')}""",
)
def d1b(spark, d):
    fit = D.ols_summary(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])[1]
    return spark.createDataFrame([(fit["n"], round(fit["r2"], 6), round(fit["adj_r2"], 6))], "n long, r2 double, adj_r2 double")


_VIF = "select l_quantity as a, l_extendedprice as b, l_extendedprice * 0.5 + l_quantity * 500 + l_tax * 300000 as c from lineitem"


@query(
    "d2_vif",
    f"""with r as (select corr(a, b) as ab, corr(a, c) as ac, corr(b, c) as bc from ({_VIF})),
        q as (select *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc as det from r)
        select 'a' as term, round((1 - bc * bc) / det, 3) as vif from q union all
        select 'b', round((1 - ac * ac) / det, 3) from q union all select 'c', round((1 - ab * ab) / det, 3) from q""",
)
def d2(spark, d):
    li = table(spark, d, "lineitem")
    c = F.col("l_extendedprice") * 0.5 + F.col("l_quantity") * 500 + F.col("l_tax") * 300000
    cols = li.select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), c.alias("c"))
    return D.vif(cols, ["a", "b", "c"]).withColumn("vif", F.round("vif", 3))


@query(
    "d3_breusch_pagan",
    """with f as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem),
       e as (select pow(l_extendedprice - a - b * l_quantity, 2) as e2, l_quantity from lineitem, f)
       select round(count(*) * regr_r2(e2, l_quantity), 4) as statistic, 1 as df from e""",
)
def d3(spark, d):
    out = D.breusch_pagan(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return out.select(F.round("statistic", 4).alias("statistic"), "df")


@query(
    "d4_factor_dummies",
    "select o_orderkey, "
    + ", ".join(f"case when year(o_orderdate) = {y} then 1 else 0 end as yr_{y}" for y in range(1996, 2002))
    + " from orders",
)
def d4(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"))
    return D.factor_dummies(o, "yr", range(1995, 2002), "yr_").drop("yr")


def _trials(spark, d):
    """Returned lines by quantity and tax: one row per covariate pattern."""
    won = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    hard = F.when(F.col("l_discount") > 0.05, 0).otherwise(won)
    return table(spark, d, "lineitem").groupBy("l_quantity", "l_tax").agg(
        F.sum(hard).alias("won"), F.count(F.lit(1)).alias("n")
    ).withColumn("q2", F.col("l_quantity") * F.col("l_quantity")).withColumn("qt", F.col("l_quantity") * F.col("l_tax"))


_TRIALS = """select *, l_quantity * l_quantity as q2, l_quantity * l_tax as qt from (
    select l_quantity, l_tax, sum(case when l_returnflag = 'R' and l_discount <= 0.05 then 1 else 0 end)::double as y,
    count(*)::double as n from lineitem group by 1, 2)"""
_LOGIT = "ln(sum(y) / (sum(n) - sum(y)))"


def _pattern_rows(*xs):
    columns = ", ".join(f"{x}::double as v{i}" for i, x in enumerate(("1.0", *xs)))
    return f"(select y, n, l_quantity, l_tax, {columns} from ({_TRIALS}))"


def _glm_sql(xs, steps=9, offset=""):
    """Coefficients with standard errors of a binomial model on covariate patterns."""
    k, rows = len(xs) + 1, _pattern_rows(*xs)
    fit = newton_ctes("pr", k, steps, trials="n", start=_LOGIT, offset=offset)
    inverse = inverse_diagonal_sql(hessian_sql("pr", k, f"b{steps}", "n", offset), k)
    terms = " union all ".join(f"select {i} as i, '{t}' as term, b{i} as b from b{steps}" for i, t in enumerate(("(intercept)", *xs)))
    return f"""with pr as materialized {rows}, {fit}, t as ({terms}), s as ({inverse})
        select term, round(b, 5) as estimate, round(sqrt(d), 5) as std_error, round(b / sqrt(d), 4) as z from t join s using (i)"""


def _glm_shape(df):
    return df.select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"), F.round("z", 4).alias("z"))


@query("d5_binomial_glm", _glm_sql(["l_quantity", "l_tax", "qt"]))
def d5(spark, d):
    return _glm_shape(D.binomial_glm(_trials(spark, d), "won", "n", ["l_quantity", "l_tax", "qt"])[0])


@query("d5_binomial_glm_offset", _glm_sql(["l_tax"], offset="l_quantity / 40"))
def d5_offset(spark, d):
    rows = _trials(spark, d).withColumn("shift", F.col("l_quantity") / 40)
    return _glm_shape(D.binomial_glm(rows, "won", "n", ["l_tax"], offset="shift")[0])


def _deviance_sql(size, model):
    eta = " + ".join(f"b{i} * v{i}" for i in range(size))
    terms = "case when y > 0 then y * ln(y / mu) else 0 end + case when n > y then (n - y) * ln((n - y) / (n - mu)) else 0 end"
    return f"(select 2 * sum({terms}) as dev from (select *, n / (1 + exp(-({eta}))) as mu from pr, {model}))"


@query(
    "d6_likelihood_ratio",
    f"""with pr as materialized {_pattern_rows("l_quantity", "l_tax", "q2")},
        {newton_ctes("pr", 2, 9, trials="n", start=_LOGIT, name="small")},
        {newton_ctes("pr", 4, 9, trials="n", start=_LOGIT, name="big")},
        x as (select s.dev - b.dev as dev from {_deviance_sql(2, "small9")} s, {_deviance_sql(4, "big9")} b)
        select round(dev, 5) as deviance, 2 as df, round(exp(-dev / 2), 6) as p from x""",
)
def d6(spark, d):
    out = D.likelihood_ratio(_trials(spark, d), "won", "n", ["l_quantity"], ["l_quantity", "l_tax", "q2"])
    return out.select(F.round("deviance", 5).alias("deviance"), "df", F.round("p", 6).alias("p"))


@query(
    "d7_wald_interval",
    f"""with pr as materialized {_pattern_rows("l_quantity")}, {newton_ctes("pr", 2, 9, trials="n", start=_LOGIT)},
        h as ({hessian_sql("pr", 2, "b9", "n")}),
        e as (select x, b0 + b1 * x as eta, sqrt((a1_1 - 2 * x * a0_1 + x * x * a0_0) / (a0_0 * a1_1 - a0_1 * a0_1)) as sd
          from h, b9, (select unnest([1.0, 25.0, 50.0])::double as x))
        select x, round(1 / (1 + exp(-eta)), 6) as probability, round(1 / (1 + exp(-(eta - {Z95} * sd))), 6) as lower,
          round(1 / (1 + exp(-(eta + {Z95} * sd))), 6) as upper from e""",
)
def d7(spark, d):
    out = D.wald_interval(_trials(spark, d), "won", "n", "l_quantity", [1, 25, 50])
    return out.select("x", *[F.round(c, 6).alias(c) for c in ("probability", "lower", "upper")])


def _bootstrap_sql(source, at, replicates=1000, seed=7):
    """Percentile intervals over refits; ``source`` has x, y, n and key."""
    reached = " + ".join(f"(z >= {edge})::integer" for edge in POISSON)
    lanes = hash_sql(f"select i as rep, i + {seed * 1_000_003} as lane from range(1, {replicates + 1}) r(i)", "lane", ROUNDS, PRIME)
    keyed = hash_sql(f"select * replace (key % {PRIME} as key) from (select x, y, n, key::bigint as key from ({source}))", "key", ROUNDS, PRIME)
    drawn = hash_sql("select rep, x, y, n, xor(key, lane) as z from keyed, lanes", "z", ROUNDS, PRIME)
    points = ", ".join(f"{float(v)}" for v in at)
    full = newton_ctes("pr", 2, 9, trials="n", start=_LOGIT, name="f")
    refit = newton_ctes("wt", 2, 5, keys="rep", trials="n", first="select rep, b0, b1 from lanes, f9")
    return f"""with keyed as materialized ({keyed}), lanes as materialized ({lanes}),
        pr as (select y, n, 1.0::double as v0, x as v1 from keyed), {full},
        wt as materialized (select rep, y * w as y, n * w as n, 1.0::double as v0, x as v1 from (
          select *, {reached} as w from ({drawn})) where w > 0), {refit}
        select x, count(*) as replicates, round(quantile_cont(p, 0.05), 6) as lower, round(quantile_cont(p, 0.95), 6) as upper
        from (select x, 1 / (1 + exp(-(b0 + b1 * x))) as p from b5, (select unnest([{points}])::double as x)) group by 1"""


def _interval_shape(df):
    return df.select("x", "replicates", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query(
    "d8_bootstrap_ci",
    _bootstrap_sql(f"select l_quantity::double as x, y, n, l_quantity * 1000 + round(l_tax * 100) as key from ({_TRIALS})", [1, 25, 50]),
)
def d8(spark, d):
    rows = _trials(spark, d).withColumn("key", (F.col("l_quantity") * 1000 + F.round(F.col("l_tax") * 100)).cast("long"))
    return _interval_shape(D.bootstrap_ci(rows, "won", "n", "l_quantity", [1, 25, 50], key="key"))


@query(
    "d8_bootstrap_ci_rows",
    _bootstrap_sql(
        """select l_extendedprice::double / 10000 as x, case when l_returnflag = 'R' then 1.0 else 0.0 end::double as y,
           1.0::double as n, l_orderkey * 10 + l_linenumber as key from lineitem""",
        [1, 5, 9],
    ),
)
def d8_rows(spark, d):
    """Every row resampled, on a covariate with nearly as many values as rows."""
    rows = table(spark, d, "lineitem").select(
        (F.col("l_extendedprice") / 10000).alias("x"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("won"),
        F.lit(1).alias("n"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"),
    )
    return _interval_shape(D.bootstrap_ci(rows, "won", "n", "x", [1, 5, 9], key="key"))


@query("d8_bootstrap_ci_parametric")
def d8b(spark, d):
    rows = _trials(spark, d).withColumn("key", (F.col("l_quantity") * 1000 + F.round(F.col("l_tax") * 100)).cast("long"))
    return D.bootstrap_ci(rows, "won", "n", "l_quantity", [1, 25, 50], parametric=True, key="key")


_PANEL = """select o_custkey, year(o_orderdate) as yr, sum(o_totalprice) / 1000 as y, count(*) as x1,
    sum(case when o_orderstatus = 'F' then 1 else 0 end) as x2 from orders group by 1, 2"""


def panel(spark, d):
    """Customer by year."""
    closed = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(
        (F.sum("o_totalprice") / 1000).alias("y"), F.count(F.lit(1)).alias("x1"), F.sum(closed).alias("x2")
    )


_WITHIN = f"""(select o_custkey, y - avg(y) over g as y, x1 - avg(x1) over g as x1, x2 - avg(x2) over g as x2
    from ({_PANEL}) window g as (partition by o_custkey))"""


@query(
    "d9_fixed_effects",
    f"""with f as (select *, (select count(distinct o_custkey) from orders) as g from {two_predictors_sql(_WITHIN, 'y', 'x1', 'x2')})
        select 'x1' as term, round(b1, 6) as estimate, round(se1 * sqrt((n - 3.0) / (n - g - 2)), 6) as std_error from f
        union all select 'x2', round(b2, 6), round(se2 * sqrt((n - 3.0) / (n - g - 2)), 6) from f""",
)
def d9(spark, d):
    fit, _ = D.fixed_effects(panel(spark, d), "o_custkey", "y", ["x1", "x2"])
    out = fit.table(spark).where(F.col("term") != "(intercept)")
    return _rounded(out, 6).drop("t")


_YEARS = [f"yr_{y}" for y in range(1996, 2002)]
_WITHIN_YEARS = f"""select o_custkey, {', '.join(f'{c} - avg({c}) over g as v{i}' for i, c in enumerate(['x1', 'x2', *_YEARS]))},
    y - avg(y) over g as y from (select *, {', '.join(f"case when yr = {c[3:]} then 1.0 else 0.0 end::double as {c}" for c in _YEARS)}
    from ({_PANEL})) window g as (partition by o_custkey)"""


def _years_sql():
    k = len(_YEARS) + 2
    a = ", ".join(f"sum(v{i} * v{j}) as a{i}_{j}" for i, j in pairs(k))
    r = ", ".join(f"sum(v{i} * y) as r{i}" for i in range(k))
    system = f"select {a}, {r}, count(*) as n, count(distinct o_custkey) as g, sum(y * y) as yy from w"
    terms = " union all ".join(f"select {i} as i, '{t}' as term, b{i} as b, r{i} as r from s, f" for i, t in enumerate(["x1", "x2", *_YEARS]))
    return f"""with w as materialized ({_WITHIN_YEARS}), s as materialized ({system}), f as materialized ({solve_sql('s', k)}),
        t as materialized ({terms}), d as ({inverse_diagonal_sql('s', k)}),
        v as (select (any_value(yy) - sum(b * r)) / (any_value(n) - any_value(g) - {k}) as s2 from t, s)
        select term, round(b, 6) as estimate, round(sqrt(s2 * d), 6) as std_error, round(b / sqrt(s2 * d), 4) as t from t join d using (i), v"""


@query("d9_fixed_effects_with_years", _years_sql())
def d9b(spark, d):
    fit, _ = D.fixed_effects(panel(spark, d), "o_custkey", "y", ["x1", "x2"], "yr", range(1995, 2002))
    out = fit.table(spark).where(F.col("term") != "(intercept)")
    return _rounded(out, 6).withColumn("t", F.round("t", 4))


@query("d10_pooled_ols", _terms_sql(f"({_PANEL})", "y", "x1", "x2", 6))
def d10(spark, d):
    return _rounded(D.ols(panel(spark, d), "y", ["x1", "x2"]).table(spark), 6)


_WITHIN1 = f"""(select o_custkey, y - avg(y) over g as y, x1 - avg(x1) over g as x1 from ({_PANEL})
    window g as (partition by o_custkey))"""


@query(
    "d11_robust_se_clustered",
    f"""with w as {_WITHIN1}, b as (select sum(x1 * y) / sum(x1 * x1) as b, sum(x1 * x1) as s from w),
        g as (select sum(x1 * (y - b * x1)) as u from w, b group by o_custkey)
        select 'x1' as term, round(any_value(b), 6) as estimate, round(sqrt(sum(u * u)) / any_value(s), 6) as std_error from g, b""",
)
def d11(spark, d):
    fit, within = D.fixed_effects(panel(spark, d), "o_custkey", "y", ["x1"])
    return _rounded(D.clustered_se(within, fit, "o_custkey", "y"), 6).drop("t")


@query(
    "d11_robust_se_hc3",
    f"""with p as ({_PANEL}), f as (select regr_slope(y, x1) as b, regr_intercept(y, x1) as a, avg(x1) as m, count(*) as n,
          var_pop(x1) * count(*) as s from p),
        h as (select x1 - m as d, (y - a - b * x1) / (1 - 1.0 / n - (x1 - m) * (x1 - m) / s) as e, s, b from p, f)
        select 'x1' as term, round(any_value(b), 6) as estimate, round(sqrt(sum(d * d * e * e)) / any_value(s), 6) as std_error from h""",
)
def d11b(spark, d):
    rows = panel(spark, d)
    fit = D.ols(rows, "y", ["x1"])
    return _rounded(D.hc3_se(rows, fit, "y"), 6).drop("t")


@query(
    "d11_robust_se_arellano_hc3",
    f"""with w as {_WITHIN1}, b as (select sum(x1 * y) / sum(x1 * x1) as b, sum(x1 * x1) as s from w),
        g as (select sum(x1 * (y - b * x1) / (1 - x1 * x1 / s)) as u from w, b group by o_custkey)
        select 'x1' as term, round(any_value(b), 6) as estimate, round(sqrt(sum(u * u)) / any_value(s), 6) as std_error from g, b""",
)
def d11c(spark, d):
    fit, within = D.fixed_effects(panel(spark, d), "o_custkey", "y", ["x1"])
    return _rounded(D.clustered_se(within, fit, "o_custkey", "y", leverage=True), 6).drop("t")


_SERIES = """select 0 as one, date_trunc('month', o_orderdate)::date as month, avg(o_totalprice) / 1000 as y from orders
    where o_orderdate < timestamp '2001-07-01' group by 2"""
_T = f"(select *, pow(t, 2) as t2, ln(y) as ly from (select y, month, (row_number() over (order by month))::double as t from ({_SERIES})))"


def monthly(spark, d):
    """One row per month."""
    o = table(spark, d, "orders").where(F.col("o_orderdate") < F.expr("timestamp_ntz '2001-07-01'"))
    return o.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(
        (F.avg("o_totalprice") / 1000).alias("y")
    ).select(F.lit(0).alias("one"), "month", "y")


_AIC = "n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * {k}"


def _simple_sql(name, y):
    return f"""select '{name}' as model, rss as sse, {_AIC.format(k=3)} as aic from (select count(*) as n,
        var_pop({y}) * count(*) * (1 - regr_r2({y}, t)) as rss from {_T})"""


@query(
    "d12_trend_season_regression",
    f"""select model, round(sse, 6) as sse, round(aic, 6) as aic from ({_simple_sql('linear', 'y')} union all
        {_simple_sql('log', 'ly')} union all select 'quadratic', rss, {_AIC.format(k=4)} from {two_predictors_sql(_T, 'y', 't', 't2')})""",
)
def d12(spark, d):
    out = D.trend_season_regression(monthly(spark, d), ["one"], "month", "y")[1]
    known = out.where(F.col("model") != "seasonal")
    return known.select("model", F.round("sse", 6).alias("sse"), F.round("aic", 6).alias("aic"))


@query(
    "d12_seasonal_regression",
    f"""with s as materialized (select y, t, month(month) as m from {_T}), g as (select m, avg(y) as my, avg(t) as mt from s group by 1),
        b as (select sum((t - mt) * y) / sum((t - mt) * (t - mt)) as b from s join g using (m)),
        c as (select m, my - b * mt as level from g, b)
        select 't' as term, round(b, 6) as estimate from b union all
        select '(intercept)', round(level, 6) from c where m = 1 union all
        select 'm' || m, round(level - (select level from c where m = 1), 6) from c where m > 1""",
)
def d12b(spark, d):
    fits, _ = D.trend_season_regression(monthly(spark, d), ["one"], "month", "y")
    return _rounded(fits["seasonal"].table(spark), 6).select("term", "estimate")


_SEASONAL = f"""s as materialized (select month, y, ly, t, month(month) as m from {_T}),
    g as (select m, avg(y) as my, avg(t) as mt from s group by 1),
    b as (select sum((t - mt) * y) / sum((t - mt) * (t - mt)) as b from s join g using (m)),
    q as (select b0, b1, b2 from {two_predictors_sql(_T, 'y', 't', 't2')}),
    l as (select regr_slope(y, t) as lb, regr_intercept(y, t) as la, regr_slope(ly, t) as gb, regr_intercept(ly, t) as ga from s),
    r as (select month, unnest(['linear', 'quadratic', 'log', 'seasonal']) as model,
      unnest([la + lb * t, b0 + b1 * t + b2 * t * t, ga + gb * t, my + b * (t - mt)]) as fitted, unnest([y, y, ly, y]) as seen
      from s join g using (m), b, q, l)"""


@query(
    "d12_fitted_and_residuals",
    f"""with {_SEASONAL} select cast(month as varchar) as month, model, round(fitted, 6) as fitted,
        round(seen - fitted, 6) + 0.0 as residual from r""",
)
def d12_rows(spark, d):
    out = D.trend_fitted(monthly(spark, d), ["one"], "month", "y")
    return out.select(
        F.col("month").cast("string").alias("month"), "model", F.round("fitted", 6).alias("fitted"), (F.round("residual", 6) + 0.0).alias("residual")
    )


@query(
    "d12_all_models",
    f"""with {_SEASONAL}, e as (select model, count(*) as n, sum(pow(seen - fitted, 2)) as rss,
          case model when 'quadratic' then 4 when 'seasonal' then 14 else 3 end as k from r group by 1)
        select model, round(rss, 6) as sse, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * k, 5) as aic from e""",
)
def d12_models(spark, d):
    out = D.trend_season_regression(monthly(spark, d), ["one"], "month", "y")[1]
    return out.select("model", F.round("sse", 6).alias("sse"), F.round("aic", 5).alias("aic"))


_FC = f"""with s as materialized (select * from {_T}), f as (select regr_slope(y, t) as b, regr_intercept(y, t) as a, count(*) as n,
    max(month) as last from s), fc as (select (last + to_months(h::integer))::date as month, a + b * (n + h) as y
    from f, (select unnest(range(1, 7)) as h))"""


@query("d13_trend_forecast", f"{_FC} select cast(month as varchar) as month, round(y, 6) as y from fc")
def d13(spark, d):
    s = monthly(spark, d)
    fit = D.ols(D.trend_columns(s, ["one"], "month"), "y", ["t"])
    out = D.trend_forecast(s, "month", "y", fit, 6)
    return out.select(F.col("month").cast("string").alias("month"), F.round("y", 6).alias("y"))


@query(
    "d14_forecast_accuracy",
    f"""{_FC}, act as (select date_trunc('month', o_orderdate)::date as month, avg(o_totalprice) / 1000 as a from orders group by 1),
        e as (select a, a - y as e from act join fc using (month))
        select count(*) as n, round(avg(e), 6) as me, round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e)), 6) as mae,
        round(avg(100 * e / a), 6) as mpe, round(avg(abs(100 * e / a)), 6) as mape from e""",
)
def d14(spark, d):
    s = monthly(spark, d)
    fit = D.ols(D.trend_columns(s, ["one"], "month"), "y", ["t"])
    forecast = D.trend_forecast(s, "month", "predicted", fit, 6)
    actual = table(spark, d, "orders").groupBy(
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")
    ).agg((F.avg("o_totalprice") / 1000).alias("y"))
    out = D.forecast_accuracy(actual, forecast, ["month"], "y", "predicted")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("me", "rmse", "mae", "mpe", "mape")])


@query(
    "d15_ljung_box",
    f"""select one, round(max(n) * (max(n) + 2) * sum(rho * rho / (n - lag)), 6) as q, count(*) as lags
        from ({acf_sql(_SERIES, 'one', 'month', 'y', 10)}) group by 1""",
)
def d15(spark, d):
    table_ = S.acf(monthly(spark, d), ["one"], ["month"], "y", 10)
    return D.ljung_box(table_, ["one"]).withColumn("q", F.round("q", 6))


@query(
    "d16_classical_decompose",
    f"""with s as (select month, y from ({_SERIES})), t as (select month, y, case when count(y) over (order by month rows between
          6 preceding and 6 following) = 13 then (sum(y) over (order by month rows between 5 preceding and 5 following)
          + (lag(y, 6) over (order by month) + lead(y, 6) over (order by month)) / 2) / 12 end as trend from s),
        m as (select month(month) as m, avg(y - trend) as s from t group by 1), c as (select m, s - avg(s) over () as seasonal from m)
        select cast(month as varchar) as month, round(trend, 6) as trend, round(seasonal, 6) as seasonal,
        round(y - trend - seasonal, 6) as remainder from t join c on c.m = month(month)""",
)
def d16(spark, d):
    out = D.classical_decompose(monthly(spark, d), ["one"], "month", "y")
    return out.select(
        F.col("month").cast("string").alias("month"), *[F.round(c, 6).alias(c) for c in ("trend", "seasonal", "remainder")]
    )


@query(
    "d17_rates_per_capita",
    """select c_nationkey, round(sum(c_acctbal) / count(*), 6) as per_head, case when count(*) filter (c_acctbal < 0) > 0 then
       round(100.0 * count(*) filter (c_mktsegment = 'BUILDING') / count(*) filter (c_acctbal < 0), 6) end as per_debtor
       from customer group by 1""",
)
def d17(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.sum("c_acctbal").alias("balance"),
        F.count(F.lit(1)).alias("heads"),
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("builders"),
        F.count_if(F.col("c_acctbal") < 0).alias("debtors"),
    )
    out = D.rates_per_capita(c, {"per_head": ("balance", "heads", 1.0), "per_debtor": ("builders", "debtors", 100.0)})
    return out.select("c_nationkey", F.round("per_head", 6).alias("per_head"), F.round("per_debtor", 6).alias("per_debtor"))
