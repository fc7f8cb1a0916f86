"""Scenario runs, what-ifs and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewise import constants as K
from tidewise.functions import scalar as C
from tidewise.operators import scenario as N
from tidewise.registry import query
from tidewise.sources import tables as S


def impacts(spark, sets=K.PRESETS):
    return N.sector_impacts(S.sensitivity(spark), S.shocks(spark, sets))


def exposed(spark, d, sets=K.PRESETS):
    return N.exposures(S.fund_weights(spark, d), S.sector_dim(spark), impacts(spark, sets))


def run_sql(view: str = "preset_impacts") -> str:
    """CTEs that end in ``run``: one row per portfolio and scenario."""
    return f"""im AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY impact, ord) AS rank,
          count(*) OVER (PARTITION BY scenario) AS sectors, avg(impact) OVER (PARTITION BY scenario) AS mean_impact FROM {view}),
      ex AS (SELECT portfolio, scenario, sord, etf, sector, ord, w, impact, rank, sectors FROM fund_weights JOIN sector_dim USING (etf)
             JOIN im USING (sector, ord)),
      p1 AS (SELECT *, CASE WHEN rank <= 3 AND w > 0.05 THEN w * 0.3 ELSE 0 END AS give, rank > sectors - 3 AS best FROM ex),
      p2 AS (SELECT *, sum(give) OVER ps AS pool, count(*) FILTER (best) OVER ps AS k FROM p1 WINDOW ps AS (PARTITION BY portfolio, scenario)),
      p3 AS (SELECT *, w - give + CASE WHEN best THEN pool / k ELSE 0 END AS raw FROM p2),
      p4 AS (SELECT *, raw / sum(raw) OVER (PARTITION BY portfolio, scenario) AS causal_w FROM p3),
      run AS (SELECT portfolio, scenario, sord, sum(w * impact) AS current, sum(causal_w * impact) AS causal, avg(impact) AS traditional,
              (sum(w * impact) - sum(causal_w * impact)) * 100 AS vs_current, (avg(impact) - sum(causal_w * impact)) * 100 AS vs_traditional
              FROM p4 GROUP BY 1, 2, 3)"""


@query(
    "sector_impacts",
    "N1 J4",
    f"""WITH {run_sql()} SELECT scenario, sector, impact, count(*) AS holders, sum(w) AS held FROM ex GROUP BY 1, 2, 3""",
    r="impact held:5",
)
def sector_impacts(spark, d):
    e = exposed(spark, d)
    return e.groupBy("scenario", "sector", "impact").agg(F.count(F.lit(1)).alias("holders"), F.sum("w").alias("held"))


@query(
    "portfolio_impact",
    "N2 J5",
    f"WITH {run_sql()} SELECT portfolio, scenario, sum(w * impact) AS impact, avg(impact) AS equal FROM ex GROUP BY 1, 2",
    r="impact:11 equal:11",
)
def portfolio_impact(spark, d):
    i = F.col("impact")
    return exposed(spark, d).groupBy("portfolio", "scenario").agg(F.sum(F.col("w") * i).alias("impact"), F.avg(i).alias("equal"))


@query(
    "causal_weights",
    "N3 T4",
    f"WITH {run_sql()} SELECT portfolio, scenario, etf, w, causal_w FROM p4",
    r="w causal_w",
)
def causal_weights(spark, d):
    return N.reweight(exposed(spark, d)).select("portfolio", "scenario", "etf", "w", "causal_w")


@query(
    "worst_and_best_sectors",
    "T4",
    f"""WITH {run_sql()} SELECT scenario, rank, sector, count(*) AS holders FROM ex WHERE rank <= 3 OR rank > sectors - 3 GROUP BY 1, 2, 3""",
)
def worst_and_best_sectors(spark, d):
    e = exposed(spark, d).filter((F.col("rank") <= 3) | (F.col("rank") > F.col("sectors") - 3))
    return e.groupBy("scenario", "rank", "sector").agg(F.count(F.lit(1)).alias("holders"))


@query(
    "scenario_run",
    "N4 N8",
    f"WITH {run_sql()} SELECT * EXCLUDE (sord) FROM run",
    r="current:11 causal:11 traditional:11 vs_current:9 vs_traditional:9",
)
def scenario_run(spark, d):
    return N.simulate(exposed(spark, d)).drop("sord")


@query(
    "scenario_breakdown",
    "N4",
    f"""WITH {run_sql()} SELECT portfolio, scenario, etf, array_to_string(list_transform(string_split(sector, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS sector,
        w * 100 AS weight, impact * w * 100 AS current, impact * causal_w * 100 AS causal,
        impact * 100 / count(*) OVER (PARTITION BY portfolio, scenario) AS traditional, impact * 100 AS raw_impact FROM p4""",
    r="weight current causal traditional raw_impact",
)
def scenario_breakdown(spark, d):
    return N.breakdown(exposed(spark, d))


@query(
    "immediate_actions",
    "N5 T5",
    f"""WITH {run_sql()}, red AS (SELECT portfolio, scenario, 'reduce' AS action, etf, w * 100 AS current_weight, w * 30 AS suggested, rank FROM ex
          WHERE rank <= 3 AND impact < -0.02 AND w > 0.05),
        best AS (SELECT scenario, etf, rank FROM im JOIN sector_dim USING (sector) WHERE rank > sectors - 2 AND impact > 0.01),
        inc AS (SELECT p.portfolio, p.scenario, 'increase' AS action, b.etf, coalesce(x.w, 0) * 100 AS current_weight, 5.0 AS suggested, b.rank
          FROM (SELECT DISTINCT portfolio, scenario FROM ex) p JOIN best b ON b.scenario = p.scenario
          LEFT JOIN ex x ON x.portfolio = p.portfolio AND x.scenario = p.scenario AND x.etf = b.etf),
        al AS (SELECT * FROM red UNION ALL SELECT * FROM inc)
        SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY portfolio, scenario ORDER BY rank) AS place FROM al) WHERE place <= 5""",
    r="current_weight suggested",
)
def immediate_actions(spark, d):
    return N.immediate_actions(exposed(spark, d), S.sector_dim(spark), impacts(spark))


@query(
    "strategic_shifts",
    "N5 T5",
    f"""WITH {run_sql()}, s AS (SELECT scenario, CASE WHEN factor = 'interest_rates' AND change > 0.01 THEN 'Rate Protection'
          WHEN factor = 'inflation' AND change > 0.02 THEN 'Inflation Hedge' WHEN factor = 'gdp_growth' AND change < -0.01 THEN 'Defensive Positioning' END AS strategy,
          CASE WHEN factor = 'inflation' OR abs(change) > 0.02 THEN 'high' ELSE 'medium' END AS confidence, pos FROM presets),
        h AS (SELECT scenario, 'Hedging' AS strategy, 'medium' AS confidence, 99 AS pos FROM im WHERE rank = 1 AND mean_impact < -0.03),
        u AS (SELECT * FROM s WHERE strategy IS NOT NULL UNION ALL SELECT * FROM h),
        t AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY pos) AS place FROM u)
        SELECT t.scenario, strategy, confidence, place, count(*) AS portfolios FROM t JOIN run ON run.scenario = t.scenario WHERE place <= 3 GROUP BY 1, 2, 3, 4""",
)
def strategic_shifts(spark, d):
    s = N.strategic_shifts(S.shocks(spark, K.PRESETS), impacts(spark))
    runs = exposed(spark, d).select("portfolio", "scenario").distinct()
    return runs.join(s, "scenario").groupBy("scenario", "strategy", "confidence", "place").agg(
        F.count(F.lit(1)).alias("portfolios")
    )


@query(
    "scenario_comparison",
    "N6 A20",
    f"""WITH {run_sql()} SELECT portfolio, arg_min(scenario, (current, sord)) AS worst_scenario, arg_max(scenario, (current, sord)) AS best_scenario,
        avg(current) * 100 AS average_impact, avg(vs_current) AS average_causal_improvement FROM run GROUP BY 1""",
    r="average_impact average_causal_improvement",
)
def scenario_comparison(spark, d):
    return N.compare(N.simulate(exposed(spark, d)))


@query(
    "regime_analysis",
    "N7",
    f"""WITH {run_sql('regime_impacts')} SELECT portfolio, arg_max(scenario, (current, -sord)) AS best_regime, arg_min(scenario, (current, sord)) AS worst_regime,
        avg(vs_current) AS causal_advantage FROM run GROUP BY 1""",
    r="causal_advantage",
)
def regime_analysis(spark, d):
    return N.compare_regimes(N.simulate(exposed(spark, d, K.REGIME_SHOCKS)))


@query(
    "regime_tilt",
    "N9",
    f"""WITH {run_sql('regime_impacts')}, t AS (SELECT *, row_number() OVER (PARTITION BY portfolio, scenario ORDER BY ord) AS i FROM ex),
        c AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY portfolio, scenario) AS e FROM t WHERE i <= 4),
        x AS (SELECT portfolio, scenario, impact * e AS a, impact * e * CASE WHEN impact < -0.02 THEN 0.7 WHEN impact > 0.02 THEN 1.3 ELSE 1 END AS b FROM c)
        SELECT portfolio, scenario, sum(a) * 100 AS traditional, sum(b) * 100 AS causal, (sum(b) - sum(a)) * 100 AS improvement FROM x GROUP BY 1, 2""",
    r="traditional causal improvement",
)
def regime_tilt(spark, d):
    return N.regime_tilt(exposed(spark, d, K.REGIME_SHOCKS))


def _q(sector: str) -> str:
    a, b, c = K.SENSITIVITY[sector][:3]
    return f"({a} * rates + {b} * inflation + {c} * gdp)"


@query(
    "quick_shift",
    "N10",
    "WITH i AS (SELECT request, unnest([0, 1, 2, 3]) AS k, unnest([0.35, 0.25, 0.15, 0.25]) AS w, unnest(["
    + ", ".join(_q(s) for s, *_ in N.QUICK)
    + """]) AS impact FROM what_ifs),
       r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY impact, k) AS rn FROM i),
       m AS (SELECT request, max(w) FILTER (rn = 1) * 0.3 AS moved FROM r GROUP BY 1)
       SELECT r.request, sum(impact * w) AS current, sum(impact * CASE WHEN rn = 1 THEN w - moved WHEN rn = 4 THEN w + moved ELSE w END) AS causal,
              sum(impact * 0.25) AS traditional FROM r JOIN m USING (request) GROUP BY 1""",
    r="current:10 causal:10 traditional:10",
)
def quick_shift(spark, d):
    return N.quick_shift(S.what_ifs(spark, d))


@query(
    "quick_advice",
    "N11",
    """WITH l AS (SELECT request, list_filter([
         CASE WHEN rates > 1 THEN 'Reduce Technology exposure by ' || CAST(floor(abs(rates) * 3 + 0.5) AS INTEGER) || '%' END,
         CASE WHEN rates > 1 THEN 'Reduce Financials exposure by ' || CAST(floor(abs(rates) * 2 + 0.5) AS INTEGER) || '%' END,
         CASE WHEN inflation > 1 THEN 'Increase Energy allocation by ' || CAST(floor(inflation * 4 + 0.5) AS INTEGER) || '%' END,
         CASE WHEN gdp < -1 THEN 'Shift to defensive sectors (Healthcare, Utilities)' END,
         'Diversify into rate-resistant assets'], lambda x: x IS NOT NULL)[1:3] AS v FROM what_ifs)
       SELECT request, CAST(unnest(range(len(v))) AS INTEGER) AS place, unnest(v) AS advice FROM l""",
)
def quick_advice(spark, d):
    return N.quick_advice(S.what_ifs(spark, d))


@query(
    "tilt_by_effect",
    "X7",
    """WITH e AS (SELECT request, sector, coef * rates * 0.01 AS ate FROM what_ifs CROSS JOIN (SELECT sector, coef FROM sensitivity WHERE factor = 'interest_rates')),
       w AS (SELECT request, sector, greatest(0.05, 1.0 / 11 + CASE WHEN ate > 0 THEN 0.05 WHEN ate < -0.02 THEN -0.05 ELSE 0 END) AS w FROM e)
       SELECT request, sector, w / sum(w) OVER (PARTITION BY request) AS w FROM w""",
    r="w",
)
def tilt_by_effect(spark, d):
    return N.tilt_by_effect(S.what_ifs(spark, d))


@query(
    "rule_allocation",
    "X8",
    """WITH c AS (SELECT c_custkey AS portfolio, (c_acctbal - 4500) / 5500 AS s, c_nationkey / 24 AS risk FROM customer)
       SELECT portfolio, least(50, greatest(5, 25 + CASE WHEN s < -0.5 THEN -10 WHEN s > 0 THEN 5 ELSE 0 END)) AS allocation,
              CASE WHEN risk <= 0.3 THEN 'min_volatility' WHEN risk >= 0.7 THEN 'max_returns' ELSE 'max_sharpe' END AS objective FROM c""",
    r="allocation:2",
)
def rule_allocation(spark, d):
    c = S.table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("portfolio"),
        N.rule_allocation((F.col("c_acctbal") - 4500) / 5500).alias("allocation"),
        N.objective_for(F.col("c_nationkey") / 24).alias("objective"),
    )


@query(
    "tilted_weights",
    "X9",
    "WITH t AS (SELECT request, "
    + ", ".join(f"greatest(0.05, {base} + 0.05 * {_q(s)}) AS {etf}" for s, _, base, etf in N.QUICK)
    + """, 0.1 AS XLP FROM what_ifs)
      SELECT request, XLK / s AS XLK, XLV / s AS XLV, XLE / s AS XLE, XLF / s AS XLF, XLP / s AS XLP FROM (SELECT *, XLK + XLV + XLE + XLF + XLP AS s FROM t)""",
    r="XLK XLV XLE XLF XLP",
)
def tilted_weights(spark, d):
    return N.tilted_weights(S.what_ifs(spark, d))


@query(
    "quick_mean",
    "A28",
    """SELECT request, avg(coef * rates) AS impact FROM what_ifs CROSS JOIN (SELECT coef FROM sensitivity WHERE factor = 'interest_rates') GROUP BY 1""",
    r="impact",
)
def quick_mean(spark, d):
    return N.quick_mean(S.what_ifs(spark, d))


_FORECAST = """fc AS (SELECT 'interest_rates' AS factor, avg(l_discount) * 2 AS change FROM lineitem UNION ALL SELECT 'gdp_growth', -avg(l_tax) * 2 FROM lineitem
   UNION ALL SELECT 'oil_price', avg(l_quantity) / 100 FROM lineitem)"""


@query(
    "treatment_recommendations",
    "X6 T3",
    f"""WITH {_FORECAST}, hit AS (SELECT sector, sum(coef * change) AS impact, count(*) FILTER (abs(coef * change) > 0.01) AS drivers FROM sensitivity JOIN fc USING (factor) GROUP BY 1),
        r AS (SELECT portfolio, sector, w, impact, drivers, CASE WHEN impact < -0.05 AND w > 0.1 THEN 'reduce' WHEN impact > 0.05 AND w < 0.3 THEN 'increase' END AS action
              FROM fund_weights JOIN sector_dim USING (etf) JOIN hit USING (sector)),
        s AS (SELECT *, CASE WHEN action = 'reduce' THEN -impact * w ELSE impact * 0.1 END AS suggested_change, CASE WHEN abs(impact) > 0.1 THEN 'high' ELSE 'medium' END AS confidence
              FROM r WHERE action IS NOT NULL),
        t AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY abs(suggested_change) DESC, sector) AS place FROM s)
        SELECT * EXCLUDE (w) FROM t WHERE place <= 5""",
    r="impact suggested_change:5",
)
def treatment_recommendations(spark, d):
    li = S.table(spark, d, "lineitem")
    row = li.agg(
        (F.avg("l_discount") * 2).alias("interest_rates"),
        (-F.avg("l_tax") * 2).alias("gdp_growth"),
        (F.avg("l_quantity") / 100).alias("oil_price"),
    )
    forecast = row.unpivot([], ["interest_rates", "gdp_growth", "oil_price"], "factor", "change")
    w = S.fund_weights(spark, d).join(S.sector_dim(spark).select("etf", "sector"), "etf").drop("etf")
    return N.treatment_recommendations(w, S.sensitivity(spark), forecast).drop("w")
