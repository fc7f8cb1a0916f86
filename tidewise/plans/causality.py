"""Causal discovery and treatment effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewise import constants as K
from tidewise.functions import scalar as C
from tidewise.operators import causal as D
from tidewise.operators import effects as E
from tidewise.operators import features as X
from tidewise.operators import portfolio as P
from tidewise.operators import stats as M
from tidewise.plans.windows import matrix_sql
from tidewise.registry import query
from tidewise.sources import tables as S

SYMBOLS = list(S.SEGMENT_ETF)
CONF = ["SP500_Return", "SP500_Volatility_21d"]
TREATMENTS = ["Fed_Funds_Rate_Change", "CPI_Change", "GDP_Change", "Unemployment_Rate_Change", "VIX_Change"]


def panel(spark, d):
    """One row per date, one column of returns per symbol."""
    return X.returns_wide(P.aligned_returns(S.bars(spark, d), SYMBOLS), "r", SYMBOLS)


PANEL = (
    "pn AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos, "
    + ", ".join(f"max(r) FILTER (symbol = '{s}') AS {s}" for s in SYMBOLS)
    + " FROM aligned GROUP BY ts), pl AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM aligned)"
)

GRANGER1 = f"""{PANEL}, t AS (SELECT x.symbol AS cause, y.symbol AS effect, y.r AS y, yl.r AS y1, xl.r AS x1
    FROM pl y JOIN pl yl ON yl.symbol = y.symbol AND yl.pos = y.pos - 1 JOIN pl xl ON xl.pos = y.pos - 1 JOIN (SELECT DISTINCT symbol FROM pl) x ON x.symbol = xl.symbol
    WHERE x.symbol <> y.symbol),
  c AS (SELECT cause, effect, count(*) AS n, corr(y, y1) AS a, corr(y, x1) AS b, corr(y1, x1) AS g FROM t GROUP BY 1, 2),
  u AS (SELECT *, (a * a + b * b - 2 * a * b * g) / (1 - g * g) AS ru FROM c)"""


@query(
    "granger_lag_one",
    "C1 W20",
    f"WITH {GRANGER1} SELECT cause, effect, (ru - a * a) / ((1 - ru) / (n - 3)) AS f_statistic, n + 1 AS sample_size FROM u",
    r="f_statistic",
)
def granger_lag_one(spark, d):
    g = D.granger_lags(panel(spark, d), SYMBOLS, 1)
    return g.select("cause", "effect", "f_statistic", "sample_size")


def _sweep(lag: int) -> str:
    """F statistic of every ordered pair at one lag: covariances with own lags, then the cause's, eliminated one after the other."""
    names = ["y", *[f"y{k}" for k in range(1, lag + 1)], *[f"x{k}" for k in range(1, lag + 1)]]
    cell = lambda a, b: f"{a}_{b}" if names.index(a) <= names.index(b) else f"{b}_{a}"
    pairs = lambda left: [(a, b) for i, a in enumerate(left) for b in left[i:]]
    lags = ", ".join(f"lag(r, {k}) OVER (PARTITION BY symbol ORDER BY pos) AS r{k}" for k in range(1, lag + 1))
    own = ", ".join(f"y.r{k} AS y{k}, x.r{k} AS x{k}" for k in range(1, lag + 1))
    sql = f"""w{lag} AS (SELECT symbol, pos, r, {lags} FROM pl),
  t{lag} AS (SELECT x.symbol AS cause, y.symbol AS effect, y.r AS y, {own} FROM w{lag} y JOIN w{lag} x ON x.pos = y.pos AND x.symbol <> y.symbol WHERE y.pos > {lag}),
  e{lag}_0 AS (SELECT cause, effect, count(*) AS n, {", ".join(f"covar_pop({a}, {b}) AS {cell(a, b)}" for a, b in pairs(names))} FROM t{lag} GROUP BY 1, 2)"""
    left, before = list(names), []
    for step, gone in enumerate(names[1:], 1):
        if step == lag + 1:
            before = [", y_y AS restricted"]
        elif step > lag + 1:
            before = [", restricted"]
        left.remove(gone)
        cells = ", ".join(f"{cell(a, b)} - {cell(a, gone)} * {cell(b, gone)} / {cell(gone, gone)} AS {cell(a, b)}" for a, b in pairs(left))
        sql += f",\n  e{lag}_{step} AS (SELECT cause, effect, n, {cells}{''.join(before)} FROM e{lag}_{step - 1})"
    return sql


def _statistic(lag: int) -> str:
    return f"SELECT cause, effect, {lag} AS lag, (restricted - y_y) / {lag} / (y_y / (n - {2 * lag + 1})) AS f_statistic, n + {lag} AS sample_size FROM e{lag}_{2 * lag}"


@query(
    "granger_statistics",
    "C1 C2 T8",
    f"WITH {PANEL}, " + ",\n".join(_sweep(k) for k in range(1, 6)) + "\n" + " UNION ALL ".join(_statistic(k) for k in range(1, 6)),
    r="f_statistic",
)
def granger_statistics(spark, d):
    return D.granger_lags(panel(spark, d), SYMBOLS, 5).select("cause", "effect", "lag", "f_statistic", "sample_size")


@query("granger_tests", "C1 T8")
def granger_tests(spark, d):
    return D.best_lag(D.granger_lags(panel(spark, d), SYMBOLS))


@query("granger_matrix", "C2 J6")
def granger_matrix(spark, d):
    return D.granger_matrix(D.granger_lags(panel(spark, d), SYMBOLS), SYMBOLS)


@query("sector_macro_granger", "C9")
def sector_macro_granger(spark, d):
    m = X.feature_matrix(spark, d)
    sectors = [f"{s}_Return_1d" for s in X.SECTORS]
    macros = ["VIX_Change", "SP500_Return", "Treasury_10Y"]
    return D.best_lag(D.granger_lags(m, [*sectors, *macros], causes=macros, effects=sectors))


LAGCORR = f"""{PANEL}, k AS (SELECT unnest(range(1, 11)) AS k),
  c AS (SELECT x.symbol AS cause, y.symbol AS effect, k, corr(x.r, y.r) AS r, count(*) AS n FROM pl y JOIN k ON true JOIN pl x ON x.pos = y.pos - k AND x.symbol <> y.symbol
        GROUP BY 1, 2, 3 HAVING count(*) > 30),
  b AS (SELECT cause, effect, arg_max(k, (round(abs(r), 12), -k)) AS optimal_lag, arg_max(r, (round(abs(r), 12), -k)) AS correlation, arg_max(n, (round(abs(r), 12), -k)) AS n FROM c GROUP BY 1, 2)"""


@query(
    "lagged_correlation",
    "C3",
    f"WITH {LAGCORR} SELECT cause, effect, CAST(optimal_lag AS INTEGER) AS optimal_lag, correlation, n FROM b",
    r="correlation",
)
def lagged_correlation(spark, d):
    return D.lagged_correlation(panel(spark, d), SYMBOLS).drop("p_value", "is_causal")


@query(
    "significant_pairs",
    "A23 F9",
    f"""WITH {LAGCORR} SELECT count(*) FILTER (abs(correlation) * sqrt((n - 2) / (1 - correlation * correlation)) > 1.9606) AS significant, count(*) AS tests FROM b""",
)
def significant_pairs(spark, d):
    c = D.lagged_correlation(panel(spark, d), SYMBOLS)
    return c.agg(F.count_if(F.col("p_value") < 0.05).alias("significant"), F.count(F.lit(1)).alias("tests"))


@query(
    "variable_pairs",
    "J6",
    """SELECT a.symbol AS a, b.symbol AS b, corr(a.r, b.r) AS corr, count(*) AS n FROM aligned a JOIN aligned b ON a.ts = b.ts AND a.symbol <> b.symbol GROUP BY 1, 2""",
    r="corr",
)
def variable_pairs(spark, d):
    return M.correlation(panel(spark, d), M.pair_columns(SYMBOLS, ordered=True))


_LI = ["l_quantity", "l_discount", "charge", "tax_paid"]
_LX = """lx AS (SELECT l_quantity, l_discount, l_quantity * (1 - l_discount) AS charge, l_quantity * (1 - l_discount) * l_tax AS tax_paid FROM lineitem)"""


def _charges(spark, d):
    li = S.table(spark, d, "lineitem").withColumn("charge", F.col("l_quantity") * (1 - F.col("l_discount")))
    return li.select("l_quantity", "l_discount", "charge", (F.col("charge") * F.col("l_tax")).alias("tax_paid"))



@query(
    "correlation_structure",
    "C5",
    f"WITH {_LX}, c AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS cause, '{b}' AS effect, corr({a}, {b}) AS correlation, count(*) AS sample_size FROM lx"
        for i, a in enumerate(_LI)
        for b in _LI[i + 1 :]
    )
    + ") SELECT * FROM c WHERE abs(correlation) > 0.3",
    r="correlation",
)
def correlation_structure(spark, d):
    return D.correlation_structure(_charges(spark, d), _LI)


TE = f"""{PANEL}, rg AS (SELECT symbol, min(r) AS lo, max(r) AS hi FROM pl GROUP BY 1),
  bn AS (SELECT symbol, pos, least(9, greatest(0, ceil((r - lo) / ((hi - lo) / 10)) - 1)) AS b FROM pl JOIN rg USING (symbol)),
  ob AS (SELECT x.symbol AS source, y.symbol AS target, y.b AS y, yp.b AS yp, x.b AS xp FROM bn y JOIN bn yp ON yp.symbol = y.symbol AND yp.pos = y.pos - 1
         JOIN bn x ON x.pos = y.pos - 1 AND x.symbol <> y.symbol),
  nn AS (SELECT source, target, count(*) AS n FROM ob GROUP BY 1, 2),
  """ + ", ".join(
    f"""h{i} AS (SELECT source, target, -sum(m / n * log2(m / n + 1e-10)) AS h FROM (SELECT source, target, {c}, count(*) AS m FROM ob GROUP BY ALL) JOIN nn USING (source, target) GROUP BY 1, 2)"""
    for i, c in enumerate(("y, yp", "yp", "y, yp, xp", "yp, xp"))
)


@query(
    "transfer_entropy",
    "C6 A26",
    f"""WITH {TE} SELECT source, target, h0.h - h1.h - h2.h + h3.h AS transfer_entropy, n FROM h0 JOIN h1 USING (source, target) JOIN h2 USING (source, target)
        JOIN h3 USING (source, target) JOIN nn USING (source, target)""",
    r="transfer_entropy",
)
def transfer_entropy(spark, d):
    return D.transfer_entropy(D.binned_pairs(panel(spark, d), SYMBOLS))


@query("transfer_entropy_test", "C6")
def transfer_entropy_test(spark, d):
    return D.transfer_entropy_test(D.binned_pairs(panel(spark, d), SYMBOLS))


@query(
    "chi_square_tests",
    "C4",
    """WITH v AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(l_linenumber AS VARCHAR) AS c, count(*) AS m FROM lineitem GROUP BY 1, 2, 3),
       t AS (SELECT 0 AS test, '' AS z, a AS x, b AS y, m FROM v UNION ALL SELECT 1, '', a, c, m FROM v UNION ALL SELECT 2, c, a, b, m FROM v),
       o AS (SELECT test, z, x, y, sum(m) AS o FROM t GROUP BY 1, 2, 3, 4), r AS (SELECT test, z, x, sum(o) AS r FROM o GROUP BY 1, 2, 3),
       c AS (SELECT test, z, y, sum(o) AS c FROM o GROUP BY 1, 2, 3), n AS (SELECT test, z, sum(o) AS n, count(DISTINCT x) - 1 AS dx, count(DISTINCT y) - 1 AS dy FROM o GROUP BY 1, 2),
       e AS (SELECT r.test, r.z, r.x, c.y, r * c / n AS e FROM r JOIN c ON c.test = r.test AND c.z = r.z JOIN n ON n.test = r.test AND n.z = r.z),
       q AS (SELECT e.test, sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS statistic FROM e LEFT JOIN o ON o.test = e.test AND o.z = e.z AND o.x = e.x AND o.y = e.y GROUP BY 1),
       f AS (SELECT test, CAST(sum(dx * dy) AS BIGINT) AS dof, CAST(sum(n) AS DOUBLE) AS n FROM n GROUP BY 1)
       SELECT CAST(q.test AS INTEGER) AS test, statistic, dof, n FROM q JOIN f USING (test)""",
    r="statistic",
)
def chi_square_tests(spark, d):
    li = S.table(spark, d, "lineitem")
    cells = li.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("m"))
    cells = cells.withColumn("l_linenumber", F.col("l_linenumber").cast("string"))
    tests = [
        ("l_returnflag", "l_linestatus", ()),
        ("l_returnflag", "l_linenumber", ()),
        ("l_returnflag", "l_linestatus", ("l_linenumber",)),
    ]
    return D.independence_tests(cells, tests).select("test", "statistic", "dof", "n")


@query("pc_edges", "C4 P6")
def pc_edges(spark, d):
    li = _charges(spark, d)
    edges = D.pc_algorithm(li, _LI)
    n = li.agg(F.count(F.lit(1))).scalar()
    return edges.withColumn("n", n)


@query("all_evidence", "C7 U2")
def all_evidence(spark, d):
    return D.all_evidence(panel(spark, d), SYMBOLS)


_EV = """pv AS (SELECT event_type AS effect, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cause, 'm' || (user_id % 3) AS method,
  CASE WHEN event_type = 'view' THEN NULL ELSE value / 500 END AS p_value, value < 40 AS is_causal FROM events)"""


def _event_evidence(spark, d):
    from tidewise.operators import series as W

    ev = S.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    layout = W.block_layout(ev, ("user_id",), ("ts", "event_id"))
    ev = W.windowed(ev, layout, [lambda w: {"cause": F.lag("event_type").over(w)}], back=1)
    return ev.filter(F.col("cause").isNotNull()).select(
        "cause",
        F.col("event_type").alias("effect"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("method"),
        F.when(F.col("event_type") != "view", F.col("value") / 500).alias("p_value"),
        (F.col("value") < 40).alias("is_causal"),
    )


@query(
    "consensus_edges",
    "C8 A13",
    f"""WITH {_EV} SELECT cause, effect, count(*) AS evidence_count, count(DISTINCT method) AS methods, avg(p_value) AS mean_p, 1 - avg(p_value) AS strength
        FROM pv WHERE cause IS NOT NULL AND is_causal GROUP BY 1, 2 HAVING count(*) >= 2""",
    r="mean_p strength",
)
def consensus_edges(spark, d):
    return D.consensus(_event_evidence(spark, d), 2)


@query(
    "vote_share",
    "A14 U3",
    f"""WITH {_EV}, v AS (SELECT cause, effect, count(*) AS votes FROM pv WHERE cause IS NOT NULL AND is_causal GROUP BY 1, 2)
        SELECT * FROM (SELECT *, votes / max(votes) OVER () AS confidence FROM v) WHERE confidence >= 0.5""",
    r="confidence",
)
def vote_share(spark, d):
    return D.vote_share(_event_evidence(spark, d))


def _graph(spark, d):
    c = S.table(spark, d, "customer")
    n = S.table(spark, d, "nation")
    r = S.table(spark, d, "region")
    name = lambda k, x: F.concat(F.lit(k), x.cast("string"))
    cn = c.join(n, c.c_nationkey == n.n_nationkey)
    region = F.col("n_regionkey").alias("graph")
    kind = F.when(F.col("c_custkey") % 100 == 7, "mystery").otherwise("asset")
    nodes = (
        cn.select(region, name("c", F.col("c_custkey")).alias("id"), kind.alias("type"))
        .unionByName(n.select(region, name("n", F.col("n_nationkey")).alias("id"), F.lit("economic").alias("type")))
        .unionByName(r.select(F.col("r_regionkey").alias("graph"), name("r", F.col("r_regionkey")).alias("id"), F.lit("outcome").alias("type")))
    )
    edges = (
        cn.filter(F.col("c_custkey") % 50 != 3)
        .select(region, name("c", F.col("c_custkey")).alias("src"), name("n", F.col("n_nationkey")).alias("dst"))
        .unionByName(n.select(region, name("n", F.col("n_nationkey")).alias("src"), name("r", F.col("n_regionkey")).alias("dst")))
        .unionByName(
            n.filter("n_regionkey IN (1, 2) AND n_nationkey < 10").select(
                region, name("r", F.col("n_regionkey")).alias("src"), name("n", F.col("n_nationkey")).alias("dst")
            )
        )
        .unionByName(
            n.filter("n_regionkey = 2").select(region, F.lit("ghost").alias("src"), name("n", F.col("n_nationkey")).alias("dst"))
        )
    )
    return nodes, edges


_GRAPH = """nd AS (SELECT n_regionkey AS graph, 'c' || c_custkey AS id, CASE WHEN c_custkey % 100 = 7 THEN 'mystery' ELSE 'asset' END AS type FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'economic' FROM nation UNION ALL SELECT r_regionkey, 'r' || r_regionkey, 'outcome' FROM region),
  eg AS (SELECT n_regionkey AS graph, 'c' || c_custkey AS src, 'n' || n_nationkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 <> 3
    UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey FROM nation
    UNION ALL SELECT n_regionkey, 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey < 10
    UNION ALL SELECT n_regionkey, 'ghost', 'n' || n_nationkey FROM nation WHERE n_regionkey = 2),
  reach(graph, a, b) AS (SELECT graph, src, dst FROM eg WHERE src NOT LIKE 'c%' UNION SELECT reach.graph, a, dst FROM reach JOIN eg ON eg.graph = reach.graph AND eg.src = b)"""


@query(
    "graph_validation",
    "C10 J9 U4",
    f"""WITH RECURSIVE {_GRAPH}, n AS (SELECT graph, count(*) AS node_count, count(*) FILTER (type NOT IN ('economic', 'asset', 'outcome')) AS unknown_types FROM nd GROUP BY 1),
        e AS (SELECT graph, count(*) AS edge_count FROM eg GROUP BY 1),
        ends AS (SELECT DISTINCT graph, src AS id, 'source' AS side FROM eg UNION SELECT graph, dst, 'target' FROM eg),
        u AS (SELECT graph, count(*) AS unknown_endpoints FROM ends WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.graph = ends.graph AND nd.id = ends.id) GROUP BY 1),
        x AS (SELECT graph, count(*) AS disconnected FROM nd WHERE NOT EXISTS (SELECT 1 FROM ends WHERE ends.graph = nd.graph AND ends.id = nd.id) GROUP BY 1),
        c AS (SELECT DISTINCT graph FROM reach WHERE a = b)
        SELECT n.graph, node_count, unknown_types, coalesce(edge_count, 0) AS edge_count, coalesce(unknown_endpoints, 0) AS unknown_endpoints, coalesce(disconnected, 0) AS disconnected,
          c.graph IS NOT NULL AND coalesce(unknown_endpoints, 0) = 0 AS has_cycle,
          NOT (c.graph IS NOT NULL AND coalesce(unknown_endpoints, 0) = 0) AND coalesce(unknown_endpoints, 0) = 0 AS is_valid
        FROM n LEFT JOIN e ON e.graph = n.graph LEFT JOIN u ON u.graph = n.graph LEFT JOIN x ON x.graph = n.graph LEFT JOIN c ON c.graph = n.graph""",
)
def graph_validation(spark, d):
    return D.validate(*_graph(spark, d))


# ---------------------------------------------------------------- effects


def _det(rows):
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def ols2(y: str, t: str, c1: str, c2: str) -> str:
    """SQL coefficient of t in y ~ 1 + t + c1 + c2, by Cramer's rule on covariances."""
    x = (t, c1, c2)
    cov = lambda a, b: f"covar_pop({a}, {b})"
    full = [[cov(a, b) for b in x] for a in x]
    with_y = [[cov(a, y), *[cov(a, b) for b in x[1:]]] for a in x]
    return f"{_det(with_y)} / {_det(full)}"


def ols1(y: str, t: str, c: str) -> str:
    cov = lambda a, b: f"covar_pop({a}, {b})"
    return f"({cov(t, y)} * {cov(c, c)} - {cov(c, y)} * {cov(t, c)}) / ({cov(t, t)} * {cov(c, c)} - {cov(t, c)} * {cov(t, c)})"


_EFFECTS = ", ".join(
    f"{ols2(f'{s}_Return_1d', t, *CONF)} AS e_{i}_{j}" for i, s in enumerate(X.SECTORS) for j, t in enumerate(TREATMENTS)
)
EFFECTS = f"""{matrix_sql()}, ew AS (SELECT {_EFFECTS}, count(*) AS n FROM fm),
  ef AS ({' UNION ALL '.join(f"SELECT '{s}_Return_1d' AS outcome, '{t}' AS treatment, e_{i}_{j} AS ate, n AS sample_size FROM ew" for i, s in enumerate(X.SECTORS) for j, t in enumerate(TREATMENTS))}),
  tr AS (SELECT lower(replace(outcome, '_Return_1d', '')) AS sector, CASE treatment WHEN 'Fed_Funds_Rate_Change' THEN 'interest_rates' WHEN 'CPI_Change' THEN 'inflation'
    WHEN 'GDP_Change' THEN 'gdp_growth' WHEN 'Unemployment_Rate_Change' THEN 'unemployment' ELSE 'vix' END AS factor, ate, round(least(1, greatest(-1, ate * 100)), 3) AS coef FROM ef),
  am AS (SELECT s.sector, s.ord, s.factor, s.ford, coalesce(t.coef, s.coef) AS coef, t.coef IS NOT NULL AS is_trained FROM sensitivity s LEFT JOIN tr t ON t.sector = s.sector AND t.factor = s.factor)"""


def effects(spark, d):
    return E.macro_sector_effects(X.feature_matrix(spark, d), list(X.SECTORS), TREATMENTS, CONF)


@query(
    "macro_sector_effects",
    "E8 E1 E2",
    f"WITH {EFFECTS} SELECT outcome, treatment, ate, sample_size FROM ef",
    r="ate:5",
)
def macro_sector_effects(spark, d):
    return effects(spark, d).select("outcome", "treatment", "ate", "sample_size")


@query(
    "top_effects",
    "T7 F9",
    f"""WITH {EFFECTS}, p AS (SELECT outcome, treatment, ate, row_number() OVER (ORDER BY abs(ate) DESC) AS place FROM ef WHERE abs(ate) > 0.01) SELECT * FROM p WHERE place <= 10""",
    r="ate:5",
)
def top_effects(spark, d):
    from tidewise.operators import market as Q

    e = effects(spark, d).filter(F.abs("ate") > 0.01).select("outcome", "treatment", "ate")
    return Q.top(e, [F.abs("ate").desc(), "outcome", "treatment"], 10)


@query(
    "sensitivity_matrix",
    "E9 P9 P18",
    f"""WITH {EFFECTS} SELECT sector, {", ".join(f"coalesce(max(coef) FILTER (factor = '{f}'), 0) AS {f}" for f in K.FACTORS)} FROM tr GROUP BY 1""",
    r=" ".join(K.FACTORS),
)
def sensitivity_matrix(spark, d):
    return E.wide_matrix(E.sensitivity_matrix(spark, effects(spark, d)), list(K.FACTORS))


def active(spark, d):
    return E.active_matrix(E.sensitivity_matrix(spark, effects(spark, d)), S.sensitivity(spark))


@query("active_matrix", "E12", f"WITH {EFFECTS} SELECT * FROM am", r="coef")
def active_matrix(spark, d):
    return active(spark, d)


@query(
    "sensitivity_summary",
    "A12",
    f"""WITH {EFFECTS} SELECT factor, avg(coef) AS mean, stddev_pop(coef) AS std, arg_max(sector, (coef, -ord)) AS most_positive, arg_min(sector, (coef, ord)) AS most_negative FROM am GROUP BY 1""",
    r="mean std",
)
def sensitivity_summary(spark, d):
    return E.matrix_summary(active(spark, d))


@query(
    "matrix_completeness",
    "V1",
    f"""WITH {EFFECTS} SELECT 'matrix_cells' AS component, count(*) AS n, count(*) = 77 AS passed FROM am
        UNION ALL SELECT 'trained_cells', count(*) FILTER (is_trained), count(*) FILTER (is_trained) >= 1 FROM am
        UNION ALL SELECT 'missing_cells', count(*) FILTER (coef IS NULL), count(*) FILTER (coef IS NULL) = 0 FROM am
        UNION ALL SELECT 'matrix_rows', count(*), count(*) >= 100 FROM fm""",
)
def matrix_completeness(spark, d):
    a = active(spark, d)
    c = a.agg(
        F.count(F.lit(1)).alias("matrix_cells"),
        F.count_if("is_trained").alias("trained_cells"),
        F.count_if(F.col("coef").isNull()).alias("missing_cells"),
    ).unpivot([], ["matrix_cells", "trained_cells", "missing_cells"], "component", "n")
    rows = X.feature_matrix(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("matrix_rows").alias("component"), "n")
    n = F.col("n")
    ok = (
        F.when(F.col("component") == "matrix_cells", n == 77)
        .when(F.col("component") == "trained_cells", n >= 1)
        .when(F.col("component") == "missing_cells", n == 0)
        .otherwise(n >= 100)
    )
    return c.unionByName(rows).withColumn("passed", ok)


@query(
    "effect_lookup",
    "E11 P11",
    f"""WITH {EFFECTS}, rq AS (SELECT DISTINCT CASE event_type WHEN 'click' THEN 'interest_rates' WHEN 'view' THEN 'oil_price' ELSE 'vix' END AS treatment,
          ['Tech', 'finance', 'Real Estate', 'Consumer-Staples', 'unknown'][user_id % 5 + 1] AS outcome FROM events),
        al AS (SELECT *, CASE outcome WHEN 'Tech' THEN 'technology' WHEN 'finance' THEN 'financials' WHEN 'Real Estate' THEN 'real_estate' WHEN 'Consumer-Staples' THEN 'consumer_staples' ELSE 'unknown' END AS sector FROM rq),
        jn AS (SELECT al.*, coalesce(tr.ate, s.coef, 0) AS effect, CASE WHEN tr.ate IS NOT NULL THEN 'trained' ELSE 'coefficients' END AS source FROM al
          LEFT JOIN tr ON tr.sector = al.sector AND tr.factor = al.treatment LEFT JOIN sensitivity s ON s.sector = al.sector AND s.factor = al.treatment)
        SELECT *, 0.15 * abs(effect) + 0.03 AS se, effect - 1.96 * (0.15 * abs(effect) + 0.03) AS ci_lower, effect + 1.96 * (0.15 * abs(effect) + 0.03) AS ci_upper FROM jn""",
    r="effect:5 se:5 ci_lower:5 ci_upper:5",
)
def effect_lookup(spark, d):
    ev = S.table(spark, d, "events")
    t = F.when(F.col("event_type") == "click", "interest_rates").when(F.col("event_type") == "view", "oil_price").otherwise("vix")
    names = F.array(*[F.lit(x) for x in ("Tech", "finance", "Real Estate", "Consumer-Staples", "unknown")])
    rq = ev.select(t.alias("treatment"), names[(F.col("user_id") % 5).cast("int")].alias("outcome")).distinct()
    long = effects(spark, d).select(
        F.lower(F.regexp_replace("outcome", "_Return_1d$", "")).alias("sector"), F.col("treatment").alias("source"), "ate"
    )
    return E.lookup(rq, S.to_factor(spark, long, "source"), S.sensitivity(spark)).drop("p_value")


@query(
    "subgroup_effects",
    "E5",
    f"""WITH m AS (SELECT quantile_cont(l_tax, 0.5) AS mt, quantile_cont(l_linenumber, 0.5) AS ml FROM lineitem),
        x AS (SELECT l.*, 'l_tax_' || CASE WHEN l_tax <= mt THEN 'low' ELSE 'high' END AS subgroup FROM lineitem l CROSS JOIN m
              UNION ALL SELECT l.*, 'l_linenumber_' || CASE WHEN l_linenumber <= ml THEN 'low' ELSE 'high' END FROM lineitem l CROSS JOIN m)
        SELECT subgroup, {ols1('l_extendedprice', 'l_quantity', 'l_discount')} AS ate, count(*) AS sample_size FROM x GROUP BY 1 HAVING count(*) > 50""",
    r="ate:4",
)
def subgroup_effects(spark, d):
    li = S.table(spark, d, "lineitem")
    e = E.cate_subgroups(li, "l_extendedprice", "l_quantity", ["l_discount"], ["l_tax", "l_linenumber"])
    return e.select("subgroup", "ate", "sample_size")


@query(
    "ols_effect",
    "E1 E2",
    f"SELECT 'l_extendedprice' AS outcome, 'l_quantity' AS treatment, {ols2('l_extendedprice', 'l_quantity', 'l_discount', 'l_tax')} AS ate, count(*) AS sample_size FROM lineitem",
    r="ate:4",
)
def ols_effect(spark, d):
    e = E.ols_effects(S.table(spark, d, "lineitem"), [("l_extendedprice", "l_quantity", ["l_discount", "l_tax"])])
    return e.select("outcome", "treatment", "ate", "sample_size")


@query("bootstrap_effect", "E1")
def bootstrap_effect(spark, d):
    li = S.table(spark, d, "lineitem")
    row = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return E.bootstrap_ols(li, "l_extendedprice", "l_quantity", ["l_discount", "l_tax"], row)


@query("placebo_effect", "E2")
def placebo_effect(spark, d):
    li = S.table(spark, d, "lineitem")
    row = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return E.placebo(li, "l_extendedprice", "l_quantity", ["l_discount"], row)


@query("dml_effect", "E3")
def dml_effect(spark, d):
    m = X.feature_matrix(spark, d)
    res = E.residuals(m, ["Technology_Return_1d", "SP500_Return"], ["VIX_Change", "Treasury_10Y"], F.unix_date("ts"))
    return E.dml(res, "Technology_Return_1d", "SP500_Return")


@query("ipw_effect", "E4")
def ipw_effect(spark, d):
    li = S.table(spark, d, "lineitem")
    row = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return E.ipw(li, "l_extendedprice", "l_quantity", ["l_discount", "l_tax"], row)


@query(
    "weighted_difference",
    "E4",
    """WITH x AS (SELECT l_extendedprice AS y, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS t, least(0.99, greatest(0.01, 0.2 + l_discount * 8)) AS p FROM lineitem)
       SELECT sum(t / p * y) / sum(t / p) - sum((1 - t) / (1 - p) * y) / sum((1 - t) / (1 - p)) AS ate, count(*) AS n FROM x""",
    r="ate:4",
)
def weighted_difference(spark, d):
    li = S.table(spark, d, "lineitem")
    t = (F.col("l_quantity") > 25).cast("double")
    return E.weighted_difference(li, F.col("l_extendedprice"), t, 0.2 + F.col("l_discount") * 8)


@query("effect_modifiers", "E6")
def effect_modifiers(spark, d):
    m = X.feature_matrix(spark, d)
    res = E.residuals(m, ["Energy_Return_1d", "SP500_Return"], ["VIX_Change"], F.unix_date("ts"))
    return E.cate_modifiers(res, "Energy_Return_1d", "SP500_Return", ["VIX", "Treasury_10Y"])


@query(
    "estimate_effect",
    "E7 F4",
    f"""SELECT CASE WHEN count(*) >= 100 THEN 'backdoor_linear' ELSE 'insufficient_data' END AS method, {ols1('l_extendedprice', 'l_quantity', 'l_discount')} AS ate,
        count(*) AS sample_size FROM lineitem""",
    r="ate:4",
)
def estimate_effect(spark, d):
    li = S.table(spark, d, "lineitem")
    row = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return E.estimate(li, "l_extendedprice", "l_quantity", ["l_discount"], row).select("method", "ate", "sample_size")


@query("unmeasured_confounding", "E10")
def unmeasured_confounding(spark, d):
    li = S.table(spark, d, "lineitem")
    row = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return E.unmeasured(li, "l_extendedprice", "l_quantity", ["l_discount"], row)
