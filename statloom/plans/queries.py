"""Queries over the test tables, one or more for each operator, with their SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.functions import dist, text
from statloom.functions.expressions import association_grade, d, p_stars
from statloom.operators import audit, bivariate, boosting, catalog, cleaning, describe, factorial, guards, literature, multilevel, order, privacy, regression, reliability, results, survival
from statloom.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = b"a key for tests"


def query(sql: str | None = None, doubles: str = "", digits: int = 6):
    """Registers a query under its function's name. Its double columns are rounded alike in Spark and in SQL, as sums
    over partitions differ in the last digits."""
    names = doubles.split()

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = function(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
            return out.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})

        QUERIES[function.__name__] = run
        if sql:
            replaced = ", ".join(f"round({c}, {digits}) + 0e0 AS {c}" for c in names)
            SQL[function.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if names else sql
        return function

    return add


def _wilson(share: str, n: str, sign: str) -> str:
    z = "1.959964e0"
    bound = f"({share} + {z}*{z}/(2e0*{n}) {sign} {z}*sqrt({share}*(1e0-{share})/{n} + {z}*{z}/(4e0*{n}*{n})))/(1e0+{z}*{z}/{n})"
    return f"greatest(0e0, {bound})" if sign == "-" else f"least(1e0, {bound})"


# descriptive statistics


@query(
    f"""WITH k AS (SELECT l_returnflag AS category, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1),
    t AS (SELECT category, n, CAST(n AS DOUBLE) AS weighted, CAST(n AS DOUBLE)/sum(n) OVER () AS share, CAST(sum(n) OVER () AS DOUBLE) AS n_effective FROM k)
    SELECT category, n, weighted, share, n_effective, {_wilson('share', 'n_effective', '-')} AS low, {_wilson('share', 'n_effective', '+')} AS high FROM t""",
    "weighted share n_effective low high",
)
def wilson_freq(t):
    return describe.frequencies(t("lineitem"), "l_returnflag")


@query(
    f"""WITH k AS (SELECT l_shipmode_ AS category, count(*) AS n, sum(w) AS weighted, sum(w*w) AS ww FROM (SELECT l_linestatus AS l_shipmode_, l_quantity AS w FROM lineitem) GROUP BY 1),
    t AS (SELECT category, n, weighted, weighted/sum(weighted) OVER () AS share, (sum(weighted) OVER ())*(sum(weighted) OVER ())/sum(ww) OVER () AS n_effective FROM k)
    SELECT category, n, weighted, share, n_effective, {_wilson('share', 'n_effective', '-')} AS low, {_wilson('share', 'n_effective', '+')} AS high FROM t""",
    "weighted share n_effective low high", 5,
)
def weighted_freq_kish(t):
    return describe.frequencies(t("lineitem"), "l_linestatus", "l_quantity")




@query(
    """WITH v AS (UNPIVOT (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME variable VALUE x),
    m AS (SELECT variable, avg(x) AS mean FROM v GROUP BY 1),
    c AS (SELECT v.variable, x, x - mean AS e FROM v JOIN m ON v.variable = m.variable)
    SELECT variable, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max,
    avg(e*e*e)/power(avg(e*e), 1.5e0) AS skewness, avg(e*e*e*e)/power(avg(e*e), 2e0) - 3e0 AS kurtosis FROM c GROUP BY 1""",
    "mean sd min q1 median q3 max skewness kurtosis", 5,
)
def describe_quant(t):
    return describe.quantitative(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    """SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS weight, sum(l_quantity*l_extendedprice)/sum(l_quantity) AS mean,
    sqrt((sum(l_quantity*l_extendedprice*l_extendedprice)/sum(l_quantity) - power(sum(l_quantity*l_extendedprice)/sum(l_quantity), 2e0))*sum(l_quantity)/(sum(l_quantity)-1e0)) AS sd FROM lineitem GROUP BY 1""",
    "weight mean sd", 3,
)
def weighted_mean_sd(t):
    return describe.weighted_mean(t("lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])


@query(
    """WITH m AS (SELECT o_orderstatus AS s, avg(o_totalprice) AS m FROM orders GROUP BY 1),
    a AS (SELECT s, CAST(count(*) AS DOUBLE) AS n, avg(power(o_totalprice-m,3e0))/power(avg(power(o_totalprice-m,2e0)),1.5e0) AS g1, avg(power(o_totalprice-m,4e0))/power(avg(power(o_totalprice-m,2e0)),2e0) AS b2 FROM orders JOIN m ON o_orderstatus = s GROUP BY 1 HAVING count(*) >= 20),
    b AS (SELECT *, g1*sqrt((n+1)*(n+3)/(6e0*(n-2))) AS y, 3e0*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS beta2 FROM a),
    c AS (SELECT *, sqrt(2e0*(beta2-1))-1e0 AS w2, (b2 - 3e0*(n-1)/(n+1))/sqrt(24e0*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x, 6e0*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6e0*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS r FROM b),
    e AS (SELECT *, asinh(y/sqrt(2e0/(w2-1)))/sqrt(0.5e0*ln(w2)) AS z_skew, 6e0+8e0/r*(2e0/r+sqrt(1e0+4e0/(r*r))) AS a FROM c),
    f AS (SELECT *, (1e0-2e0/a)/(1e0+x*sqrt(2e0/(a-4e0))) AS i FROM e),
    g AS (SELECT *, (1e0-2e0/(9e0*a)-sign(i)*power(abs(i), 1e0/3e0))/sqrt(2e0/(9e0*a)) AS z_kurt FROM f)
    SELECT s AS o_orderstatus, CAST(n AS BIGINT) AS n, z_skew, z_kurt, z_skew*z_skew+z_kurt*z_kurt AS k2, exp(-(z_skew*z_skew+z_kurt*z_kurt)/2e0) AS p FROM g""",
    "z_skew z_kurt k2 p", 5,
)
def dagostino_k2(t):
    return describe.dagostino(t("orders"), "o_totalprice", ["o_orderstatus"])


@query(
    """WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3, min(c_acctbal) AS low, max(c_acctbal) AS high, CAST(count(*) AS DOUBLE) AS n FROM customer),
    b AS (SELECT low, high, CAST(greatest(1e0, ceil(log2(n)+1e0), CASE WHEN q3 > q1 THEN ceil((high-low)/(2e0*(q3-q1)/power(n, 1e0/3e0))) ELSE 1e0 END) AS INTEGER) AS bins FROM q),
    c AS (SELECT CAST(least(bins-1, floor((c_acctbal-low)/(high-low)*bins)) AS INTEGER) AS bin, low, high, bins FROM customer, b)
    SELECT bin, low+bin*((high-low)/bins) AS "from", low+(bin+1)*((high-low)/bins) AS "to", count(*) AS n FROM c GROUP BY bin, low, high, bins""",
)
def histogram_bins(t):
    return describe.histogram(t("customer"), "c_acctbal")


@query(
    """WITH q AS (SELECT c_mktsegment AS g, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
    SELECT g AS "group", min(CASE WHEN c_acctbal >= q1-1.5e0*(q3-q1) AND c_acctbal <= q3+1.5e0*(q3-q1) THEN c_acctbal END) AS low, q1, median, q3,
    max(CASE WHEN c_acctbal >= q1-1.5e0*(q3-q1) AND c_acctbal <= q3+1.5e0*(q3-q1) THEN c_acctbal END) AS high, CAST(count(*) FILTER (WHERE NOT (c_acctbal >= q1-1.5e0*(q3-q1) AND c_acctbal <= q3+1.5e0*(q3-q1))) AS BIGINT) AS outside
    FROM customer JOIN q ON c_mktsegment = g GROUP BY g, q1, median, q3""",
    "low q1 median q3 high", 4,
)
def box_plot_groups(t):
    return describe.box_plot(t("customer"), "c_acctbal", "c_mktsegment")


@query("SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, corr(l_quantity, l_extendedprice) AS r FROM lineitem", "slope intercept r", 4)
def scatter_line(t):
    return describe.scatter_line(t("lineitem"), "l_quantity", "l_extendedprice")


@query("WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS clusters, avg(n) AS mean_size, min(n) AS min_size, max(n) AS max_size FROM s", "mean_size")
def cluster_sizes(t):
    return describe.cluster_sizes(t("lineitem"), "l_suppkey")


@query("""WITH s AS (SELECT o_custkey, count(DISTINCT c_mktsegment) AS a, count(DISTINCT o_orderstatus) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT 'c_mktsegment' AS variable, max(a) <= 1 AS contextual FROM s UNION ALL SELECT 'o_orderstatus', max(b) <= 1 FROM s""")
def contextual_vars(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return describe.contextual(joined, "o_custkey", ["c_mktsegment", "o_orderstatus"])


@query(
    """SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem""",
    "r",
)
def corr_matrix(t):
    return describe.correlations(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    """WITH v AS (SELECT count(*) AS n, var_samp(l_quantity) AS a, var_samp(l_discount) AS b, var_samp(l_tax) AS c, var_samp(l_quantity+l_discount+l_tax) AS s, var_samp(l_discount+l_tax) AS s1, var_samp(l_quantity+l_tax) AS s2, var_samp(l_quantity+l_discount) AS s3 FROM lineitem)
    SELECT NULL AS item, n, 1.5e0*(1e0-(a+b+c)/s) AS alpha FROM v UNION ALL SELECT 'l_quantity', n, 2e0*(1e0-(b+c)/s1) FROM v UNION ALL SELECT 'l_discount', n, 2e0*(1e0-(a+c)/s2) FROM v UNION ALL SELECT 'l_tax', n, 2e0*(1e0-(a+b)/s3) FROM v""",
    "alpha",
)
def cronbach_alpha(t):
    return describe.cronbach(t("lineitem"), ["l_quantity", "l_discount", "l_tax"])


# audit, typing, privacy


@query(
    """WITH e AS (SELECT event_id, nullif(event_type, 'view') AS event_type, CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM e)
    SELECT 'event_id' AS variable, count(*) FILTER (WHERE event_id IS NULL) AS n_missing, count(*) FILTER (WHERE event_id IS NULL)/max(n) AS rate, count(*) FILTER (WHERE event_id IS NULL)/max(n) > 0.05e0 AS flagged FROM e, n
    UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL), count(*) FILTER (WHERE event_type IS NULL)/max(n), count(*) FILTER (WHERE event_type IS NULL)/max(n) > 0.05e0 FROM e, n
    UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL), count(*) FILTER (WHERE value IS NULL)/max(n), count(*) FILTER (WHERE value IS NULL)/max(n) > 0.05e0 FROM e, n""",
    "rate",
)
def missing_audit(t):
    e = t("events").select("event_id", F.nullif("event_type", F.lit("view")).alias("event_type"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"))
    return audit.missing(e)


@query(
    """WITH v AS (UNPIVOT (SELECT CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders) ON o_totalprice, o_custkey INTO NAME variable VALUE x),
    q AS (SELECT variable, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1)
    SELECT v.variable, n, count(*) FILTER (WHERE greatest(q1-x, x-q3) > 3e0*(q3-q1)) AS extreme, count(*) FILTER (WHERE greatest(q1-x, x-q3) > 1.5e0*(q3-q1) AND NOT greatest(q1-x, x-q3) > 3e0*(q3-q1)) AS mild FROM v JOIN q ON v.variable = q.variable GROUP BY 1, 2""",
)
def tukey_outliers(t):
    return audit.outliers(t("orders"), ["o_totalprice", "o_custkey"])


@query("""SELECT 'p_brand' AS variable, p_brand AS category, count(*) AS n FROM part GROUP BY 2 HAVING count(*) < 90 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 HAVING count(*) < 90""")
def rare_categories(t):
    return audit.rare_categories(t("part"), ["p_brand", "p_type"], 90)


@query("WITH g AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n-1) AS BIGINT) AS duplicates FROM g")
def duplicate_rows(t):
    return audit.duplicate_rows(t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query(
    """WITH c AS (SELECT count(*) FILTER (WHERE event_id % 11 = 0 AND m) AS a, count(*) FILTER (WHERE event_id % 11 = 0 AND NOT m) AS b, count(*) FILTER (WHERE event_id % 11 <> 0 AND m) AS c, count(*) FILTER (WHERE event_id % 11 <> 0 AND NOT m) AS d FROM (SELECT event_id, value > 50 IS NOT TRUE AS m FROM events)),
    f AS (SELECT *, CAST(a+b+c+d AS DOUBLE) AS n, CAST(a AS DOUBLE)*d - CAST(b AS DOUBLE)*c AS g FROM c)
    SELECT a, b, c, d, n*power(greatest(0e0, abs(g)-n/2e0), 2e0)/(CAST(a+b AS DOUBLE)*(c+d)*(a+c)*(b+d)) AS chi2 FROM f""",
    "chi2",
)
def missingness_outcome(t):
    e = t("events").select(F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("v"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("y"))
    return audit.missingness_by_outcome(e, "v", "y")


@query("""SELECT 'c_custkey' AS variable, CASE WHEN count(DISTINCT c_custkey) > 0.95*count(*) AND count(*) >= 20 THEN 'identifier' END AS kind, 'ignore' AS role, count(c_custkey) AS n_valid, 0::BIGINT AS n_missing, count(DISTINCT c_custkey) AS n_unique FROM customer
    UNION ALL SELECT 'c_name', CASE WHEN count(DISTINCT c_name) > 0.95*count(*) AND count(*) >= 20 THEN 'identifier' END, 'ignore', count(c_name), 0, count(DISTINCT c_name) FROM customer
    UNION ALL SELECT 'c_nationkey', CASE WHEN count(DISTINCT c_nationkey) > 12 AND min(c_nationkey) = 0 THEN 'count' END, 'use', count(c_nationkey), 0, count(DISTINCT c_nationkey) FROM customer
    UNION ALL SELECT 'c_acctbal', 'continuous', 'use', count(c_acctbal), 0, count(DISTINCT c_acctbal) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'nominal', 'use', count(c_mktsegment), 0, count(DISTINCT c_mktsegment) FROM customer""")
def infer_kinds(t):
    return catalog.infer(t("customer"))


def _scan_sql(name: str, named: str) -> str:
    share = lambda pattern: f"avg(CAST(regexp_matches({name}, '{pattern}') AS DOUBLE))"
    return f"SELECT '{name}' AS variable, {share(privacy.EMAIL)} AS share_email, {share(privacy.PHONE)} AS share_phone, avg(length(regexp_replace({name}, '[^0-9]', '', 'g'))) AS digits, {named} AS named FROM customer"


@query(
    f"WITH s AS ({_scan_sql('c_name', chr(39) + 'direct' + chr(39))} UNION ALL {_scan_sql('c_mktsegment', 'NULL')}) SELECT variable, share_email, share_phone, CASE WHEN share_email > 0.5 OR share_phone > 0.8 AND digits >= 8 THEN 'direct' ELSE named END AS finding FROM s",
    "share_email share_phone",
)
def identifier_scan(t):
    return privacy.scan_identifiers(t("customer"))


@query()
def pseudonymize(t):
    return t("customer").select("c_custkey", privacy.pseudonym(F.col("c_name"), KEY).alias("pseudonym"))


@query("SELECT o_orderkey, CASE WHEN regexp_matches(c, '^[=+\\-@\\t\\r|]') AND NOT regexp_matches(c, '^-?[0-9 .,]+%?$') THEN '''' || c ELSE c END AS cell FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '=' || o_orderstatus WHEN 1 THEN '-1 250,5' WHEN 2 THEN '@SUM' ELSE o_orderpriority END AS c FROM orders)")
def formula_guard(t):
    c = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("="), "o_orderstatus")).when(F.col("o_orderkey") % 4 == 1, "-1 250,5").when(F.col("o_orderkey") % 4 == 2, "@SUM").otherwise(F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", cleaning.formula_guard(c).alias("cell"))


@query("WITH e AS (SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id FROM events) SELECT count(*) AS n_total, count(*) FILTER (WHERE value IS NOT NULL AND user_id IS NOT NULL) AS n_used, 1e0 - count(*) FILTER (WHERE value IS NOT NULL AND user_id IS NOT NULL)/CAST(count(*) AS DOUBLE) AS left_out FROM e", "left_out")
def complete_cases(t):
    e = t("events").select(F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"))
    return cleaning.complete_cases(e, ["value", "user_id"])[1]


@query("""SELECT c_custkey, c_mktsegment, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS "c_mktsegment[BUILDING]", CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS "c_mktsegment[MACHINERY]" FROM customer""")
def dummy_design(t):
    return cleaning.dummies(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"], "AUTOMOBILE")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN n_name ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def value_labels(t):
    labels = t("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return cleaning.apply_labels(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", labels)


# tests between two variables

_CELLS = """WITH k AS (SELECT o_orderpriority AS x, o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT x, sum(n) AS rt FROM k GROUP BY 1), c AS (SELECT y, sum(n) AS ct FROM k GROUP BY 1),
    f AS (SELECT r.x, c.y, coalesce(k.n, 0) AS n, rt, ct, sum(rt) OVER (PARTITION BY c.y) AS total FROM r CROSS JOIN c LEFT JOIN k ON k.x = r.x AND k.y = c.y), e AS (SELECT *, CAST(rt AS DOUBLE)*CAST(ct AS DOUBLE)/CAST(total AS DOUBLE) AS expected FROM f)"""


@query(f"{_CELLS} SELECT x, y, n, CAST(rt AS BIGINT) AS row_total, CAST(ct AS BIGINT) AS col_total, CAST(total AS BIGINT) AS total, expected FROM e", "expected")
def crosstab_cells(t):
    return bivariate.crosstab(t("orders"), "o_orderpriority", "o_orderstatus")


@query(f"{_CELLS} SELECT sum((n-expected)*(n-expected)/expected) AS chi2, CAST(8 AS BIGINT) AS df, CAST(max(total) AS BIGINT) AS n, sqrt(sum((n-expected)*(n-expected)/expected)/(max(total)*2e0)) AS cramer_v, exp(-sum((n-expected)*(n-expected)/expected)/2e0)*(1e0+sum((n-expected)*(n-expected)/expected)/2e0+power(sum((n-expected)*(n-expected)/expected)/2e0,2e0)/2e0+power(sum((n-expected)*(n-expected)/expected)/2e0,3e0)/6e0) AS p FROM e", "chi2 cramer_v p")
def crosstab_cramer(t):
    c = bivariate.chi_square(t("orders"), "o_orderpriority", "o_orderstatus")
    return c.select("chi2", "df", "n", "cramer_v", dist.p_chi2(F.col("chi2"), F.col("df")).alias("p"))


_TWO = "WITH c AS (SELECT CAST(count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'R') AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE l_linestatus <> 'F' AND l_returnflag = 'R') AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE l_linestatus <> 'F' AND l_returnflag <> 'R') AS DOUBLE) AS d FROM lineitem)"


@query(
    f"{_TWO}, k AS (SELECT *, CASE WHEN least(a,b,c,d) = 0 THEN 0.5e0 ELSE 0e0 END AS h FROM c), s AS (SELECT *, ln((a+h)*(d+h)/((b+h)*(c+h))) AS l, sqrt(1e0/(a+h)+1e0/(b+h)+1e0/(c+h)+1e0/(d+h)) AS se FROM k) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, a*d/nullif(b*c, 0e0) AS odds_ratio, exp(l-1.96e0*se) AS low, exp(l+1.96e0*se) AS high FROM s",
    "odds_ratio low high", 5,
)
def odds_ratio_ci(t):
    return bivariate.two_by_two(t("lineitem"), "l_linestatus", "F", "l_returnflag", "R")


@query()
def fisher_exact(t):
    few = t("labels").where(F.col("quality").isNotNull())
    return bivariate.fisher(few, "quality", "1", "toxic", "1")


@query()
def monte_carlo_chi2(t):
    return bivariate.monte_carlo_chi_square(t("orders"), "o_orderpriority", "o_orderstatus")


@query(
    """WITH k AS (SELECT CAST(substr(o_orderpriority,1,1) AS DOUBLE) AS x, CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 2e0 ELSE 3e0 END AS y, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
    p AS (SELECT sum(CASE WHEN a.y < b.y THEN a.n*b.n ELSE 0e0 END) AS concordant, sum(CASE WHEN a.y > b.y THEN a.n*b.n ELSE 0e0 END) AS discordant, sum(a.n*b.n) AS pairs FROM k a JOIN k b ON a.x < b.x) SELECT concordant, discordant, (concordant-discordant)/pairs AS somers_d FROM p""",
    "concordant discordant somers_d",
)
def somers_d(t):
    y = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return bivariate.somers(t("orders"), F.substring("o_orderpriority", 1, 1), y)


_G2 = "WITH g AS (SELECT l_linestatus AS g, CAST(count(*) AS DOUBLE) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g ORDER BY g LIMIT 1), b AS (SELECT * FROM g ORDER BY g DESC LIMIT 1), j AS (SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM a, b)"


@query(
    f"{_G2}, k AS (SELECT *, m1-m2 AS gap, (m1-m2)/sqrt(((n1-1e0)*v1+(n2-1e0)*v2)/(n1+n2-2e0)) AS d FROM j) SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, gap AS difference, gap/sqrt(v1/n1+v2/n2) AS t, power(v1/n1+v2/n2,2e0)/(power(v1/n1,2e0)/(n1-1e0)+power(v2/n2,2e0)/(n2-1e0)) AS df, d AS cohen_d, d-1.96e0*sqrt((n1+n2)/(n1*n2)+d*d/(2e0*(n1+n2))) AS d_low, d+1.96e0*sqrt((n1+n2)/(n1*n2)+d*d/(2e0*(n1+n2))) AS d_high FROM k",
    "difference t df cohen_d d_low d_high", 4,
)
def welch_t(t):
    return bivariate.welch_t(t("lineitem"), "l_extendedprice", "l_linestatus")


_GROUPS = "WITH g AS (SELECT c_mktsegment AS g, CAST(count(*) AS DOUBLE) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1)"


@query(
    f"{_GROUPS}, s AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(n) AS n, sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n) AS b, sum((n-1e0)*v) AS w FROM g) SELECT k-1e0 AS df1, n-k AS df2, b/(k-1e0)/(w/(n-k)) AS f, b/(b+w) AS eta2, greatest(0e0, (b-(k-1e0)*w/(n-k))/(b+w+w/(n-k))) AS omega2 FROM s",
    "df1 df2 f eta2 omega2", 5,
)
def anova_omega2(t):
    return bivariate.anova(t("customer"), "c_acctbal", "c_mktsegment")


@query(
    f"{_GROUPS}, w AS (SELECT *, n/v AS w FROM g), a AS (SELECT *, sum(w) OVER () AS ws, sum(w*m) OVER ()/sum(w) OVER () AS grand FROM w), s AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(n) AS n, sum(w*(m-grand)*(m-grand)) AS q, sum(power(1e0-w/ws,2e0)/(n-1e0)) AS l FROM a), f AS (SELECT *, q/(k-1e0)/(1e0+2e0*(k-2e0)/(k*k-1e0)*l) AS f FROM s) SELECT k-1e0 AS df1, (k*k-1e0)/(3e0*l) AS df2, f, greatest(0e0, (k-1e0)*(f-1e0)/((k-1e0)*(f-1e0)+n)) AS omega2 FROM f",
    "df1 df2 f omega2", 5,
)
def welch_anova(t):
    return bivariate.welch_anova(t("customer"), "c_acctbal", "c_mktsegment")


@query(
    """WITH m AS (SELECT c_mktsegment AS s, quantile_cont(c_acctbal, 0.5) AS med FROM customer GROUP BY 1), z AS (SELECT s, abs(c_acctbal-med) AS x FROM customer JOIN m ON c_mktsegment = s),
    g AS (SELECT s, CAST(count(*) AS DOUBLE) AS n, avg(x) AS m, var_samp(x) AS v FROM z GROUP BY 1), t AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(n) AS n, sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n) AS b, sum((n-1e0)*v) AS w FROM g) SELECT k-1e0 AS df1, n-k AS df2, b/(k-1e0)/(w/(n-k)) AS w FROM t""",
    "df1 df2 w", 5,
)
def levene_median(t):
    return bivariate.levene(t("customer"), "c_acctbal", "c_mktsegment")


def _ranks(table: str, value: str, group: str) -> str:
    return f"WITH r AS (SELECT {group} AS g, {value} AS v, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1)/2e0 AS r FROM {table}), t AS (SELECT sum(CAST(n AS DOUBLE)*n*n - n) AS ties FROM (SELECT count(*) AS n FROM r GROUP BY v)), s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS rs FROM r GROUP BY 1)"


@query(
    _ranks("orders", "o_totalprice", "o_orderpriority") + ", k AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(n) AS n, sum(rs*rs/n) AS s FROM s), h AS (SELECT k, n, (12e0/(n*(n+1e0))*s-3e0*(n+1e0))/(1e0-ties/(n*n*n-n)) AS h FROM k, t) SELECT h, k-1e0 AS df, h/((n*n-1e0)/(n+1e0)) AS epsilon2, exp(-h/2e0)*(1e0+h/2e0) AS p FROM h",
    "h df epsilon2 p", 5,
)
def kruskal_eps2(t):
    k = bivariate.kruskal(t("orders"), "o_totalprice", "o_orderpriority")
    return k.withColumn("p", dist.p_chi2(F.col("h"), F.col("df")))


@query(
    _ranks("lineitem", "l_quantity", "l_linestatus") + ", a AS (SELECT * FROM s ORDER BY g LIMIT 1), b AS (SELECT * FROM s ORDER BY g DESC LIMIT 1), u AS (SELECT a.n AS n1, b.n AS n2, a.rs-a.n*(a.n+1e0)/2e0 AS u, ties FROM a, b, t) SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u, greatest(0e0, abs(u-n1*n2/2e0)-0.5e0)/sqrt(n1*n2/12e0*(n1+n2+1e0-ties/((n1+n2)*(n1+n2-1e0)))) AS z, -(1e0-2e0*u/(n1*n2)) AS effect FROM u",
    "u z effect", 5,
)
def mannwhitney_u(t):
    return bivariate.mann_whitney(t("lineitem"), "l_quantity", "l_linestatus")


@query(
    _ranks("customer", "c_acctbal", "c_mktsegment") + ", n AS (SELECT sum(n) AS n FROM s) SELECT a.g AS a, b.g AS b, (a.rs/a.n-b.rs/b.n)/sqrt((n.n*(n.n+1e0)/12e0-ties/(12e0*(n.n-1e0)))*(1e0/a.n+1e0/b.n)) AS z FROM s a JOIN s b ON a.g < b.g, n, t",
    "z", 5,
)
def dunn_pairs(t):
    return bivariate.dunn(t("customer"), "c_acctbal", "c_mktsegment").select("a", "b", "z")


def _normal_p(z: str) -> str:
    """Two-sided p of a normal statistic, by Simpson's rule over 2,000 steps of its density."""
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END"
    end = f"least(abs({z}), 40e0)"
    return f"greatest(0e0, 1e0 - 2e0*{end}/6000e0/sqrt(2e0*pi())*list_sum(list_transform(range(0, 2001), lambda i: {weight}*exp(-power({end}*i/2000e0, 2e0)/2e0))))"


@query(
    _ranks("customer", "c_acctbal", "c_mktsegment") + f""", n AS (SELECT sum(n) AS n FROM s), z AS (SELECT a.g AS a, b.g AS b, (a.rs/a.n-b.rs/b.n)/sqrt((n.n*(n.n+1e0)/12e0-ties/(12e0*(n.n-1e0)))*(1e0/a.n+1e0/b.n)) AS z FROM s a JOIN s b ON a.g < b.g, n, t),
    p AS (SELECT a, b, {_normal_p('z')} AS p FROM z), o AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, a, b) AS i FROM p)
    SELECT a, b, p, least(1e0, max((m-i+1)*p) OVER (ORDER BY i)) AS p_holm FROM o""",
    "p p_holm",
)
def dunn_p_values(t):
    """The p of each pair of groups and Holm's, which leave no pair's error to chance."""
    return bivariate.dunn(t("customer"), "c_acctbal", "c_mktsegment").select("a", "b", "p", "p_holm")


_PARTLY = ["CASE WHEN event_id % 11 <> 0 THEN value END AS often", "CASE WHEN event_id % 40 <> 0 THEN value END AS seldom", "CASE WHEN event_id % 3 <> 0 OR value < 40 THEN value END AS tied", "value", "event_type"]


@query(
    f"""WITH e AS (SELECT {', '.join(_PARTLY)} FROM events), r AS (SELECT often IS NULL AS m1, tied IS NULL AS m2, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1)/2e0 AS r FROM e WHERE value IS NOT NULL),
    t AS (SELECT sum(power(n, 3e0) - n) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM e WHERE value IS NOT NULL GROUP BY value)),
    g AS (SELECT 'often' AS variable, CAST(count(*) FILTER (m1) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT m1) AS DOUBLE) AS n2, sum(r) FILTER (m1) AS rs FROM r UNION ALL SELECT 'tied', count(*) FILTER (m2), count(*) FILTER (NOT m2), sum(r) FILTER (m2) FROM r),
    u AS (SELECT *, n1+n2 AS n, rs-n1*(n1+1e0)/2e0 AS u FROM g, t), z AS (SELECT *, greatest(0e0, abs(u-n1*n2/2e0)-0.5e0)/sqrt(n1*n2/12e0*(n+1e0-ties/(n*(n-1e0)))) AS z FROM u),
    s AS (SELECT 'often' AS variable, avg(CAST(often IS NULL AS DOUBLE)) AS rate FROM e UNION ALL SELECT 'tied', avg(CAST(tied IS NULL AS DOUBLE)) FROM e UNION ALL SELECT 'seldom', avg(CAST(seldom IS NULL AS DOUBLE)) FROM e)
    SELECT variable, rate, 'Mann-Whitney' AS test, u AS statistic, {_normal_p('z')} AS p, {_normal_p('z')} < 0.05e0 AS related FROM z JOIN s USING (variable) WHERE rate > 0.05e0""",
    "rate statistic p",
)
def missingness_numbers(t):
    """Whether the value of events differs where a column that is partly missing has none; one column is missing too seldom."""
    e = t("events").selectExpr(*_PARTLY)
    return audit.missingness_tests(e.drop("event_type"), "value", True)


@query(
    f"""WITH e AS (SELECT {', '.join(_PARTLY)} FROM events), c AS (SELECT event_type AS y, tied IS NULL AS m, CAST(count(*) AS DOUBLE) AS o FROM e WHERE event_type IS NOT NULL GROUP BY 1, 2),
    y AS (SELECT y, sum(o) AS ny FROM c GROUP BY 1), m AS (SELECT m, sum(o) AS nm FROM c GROUP BY 1), x AS (SELECT coalesce(o, 0e0) AS o, nm*ny/(SELECT sum(o) FROM c) AS x FROM y CROSS JOIN m LEFT JOIN c USING (y, m)),
    k AS (SELECT sum((o-x)*(o-x)/x) AS chi2, (SELECT count(*) FROM y) - 1 AS df FROM x), r AS (SELECT avg(CAST(tied IS NULL AS DOUBLE)) AS rate FROM e)
    SELECT 'tied' AS variable, rate, 'chi-square' AS test, chi2 AS statistic FROM k, r WHERE df > 1""",
    "rate statistic",
)
def missingness_categories(t):
    """Whether the kinds of events differ where a column that is partly missing has no value."""
    e = t("events").selectExpr(*_PARTLY)
    return audit.missingness_tests(e, "event_type", False, ["tied"]).drop("p", "related")


@query()
def games_howell_pairs(t):
    return bivariate.games_howell(t("customer"), "c_acctbal", "c_mktsegment")


@query()
def tukey_pairs(t):
    return bivariate.tukey_kramer(t("customer"), "c_acctbal", "c_mktsegment")


@query(
    """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity)-1)/2e0 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice)-1)/2e0 AS ry FROM lineitem),
    c AS (SELECT count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS rho FROM r) SELECT n, r, tanh(atanh(r)-1.96e0/sqrt(n-3e0)) AS r_low, tanh(atanh(r)+1.96e0/sqrt(n-3e0)) AS r_high, rho FROM c""",
    "r r_low r_high rho",
)
def correlation_ci(t):
    return bivariate.correlation(t("lineitem"), "l_quantity", "l_extendedprice")


@query(
    """WITH k AS (SELECT l_returnflag AS g, l_shipmonth AS y, count(*) AS n FROM (SELECT l_returnflag, month(l_shipdate) AS l_shipmonth FROM lineitem) GROUP BY 1, 2)
    SELECT g AS x, CAST(y AS VARCHAR) AS y, n, n/sum(n) OVER (PARTITION BY g) AS share FROM k""",
    "share",
)
def row_percent(t):
    rows = t("lineitem").select("l_returnflag", F.month("l_shipdate").alias("m"))
    cells = bivariate.crosstab(rows, "l_returnflag", "m").where("n > 0")
    return cells.select("x", "y", "n", (d(F.col("n")) / d(F.col("row_total"))).alias("share"))


_PS = "WITH p AS (SELECT c_nationkey AS k, exp(-abs(avg(c_acctbal) - 4500e0)/400e0) AS p FROM customer GROUP BY 1), i AS (SELECT *, CAST(count(*) OVER () AS DOUBLE) AS m, CAST(row_number() OVER (ORDER BY p, k) AS DOUBLE) AS i FROM p)"


@query(
    f"{_PS} SELECT k AS variable, p, least(1e0, min(p*m/i) OVER (ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh, least(1e0, max((m-i+1e0)*p) OVER (ORDER BY p, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_holm FROM i",
    "p p_bh p_holm",
)
def bh_holm_adjust(t):
    p = t("customer").groupBy(F.col("c_nationkey").alias("variable")).agg(F.exp(-F.abs(F.avg("c_acctbal") - 4500.0) / 400.0).alias("p"))
    return order.adjust_p(p)


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal)/10000e0 < 0.05e0 THEN 'none' WHEN abs(c_acctbal)/10000e0 < 0.10e0 THEN 'very weak' WHEN abs(c_acctbal)/10000e0 < 0.20e0 THEN 'weak' WHEN abs(c_acctbal)/10000e0 < 0.40e0 THEN 'moderate' WHEN abs(c_acctbal)/10000e0 < 0.80e0 THEN 'strong' ELSE 'very strong' END AS grade, CASE WHEN abs(c_acctbal)/100000e0 < 0.01e0 THEN '***' WHEN abs(c_acctbal)/100000e0 < 0.05e0 THEN '**' WHEN abs(c_acctbal)/100000e0 < 0.1e0 THEN '*' ELSE 'ns' END AS stars FROM customer")
def effect_grades(t):
    return t("customer").select("c_custkey", association_grade(F.col("c_acctbal") / 10000.0).alias("grade"), p_stars(F.abs("c_acctbal") / 100000.0).alias("stars"))


@query(
    """WITH k AS (SELECT CAST(substr(o_orderpriority,1,1) AS DOUBLE) AS x, CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 2e0 ELSE 3e0 END AS y, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
    c AS (SELECT a.n AS n, sum(sign((a.x-b.x)*(a.y-b.y))*b.n) AS s, sum(b.n) AS apart FROM k a JOIN k b ON a.x <> b.x GROUP BY a.x, a.y, a.n),
    o AS (SELECT sum(n*s) AS s, sum(n*apart) AS pairs, sum(n*s*s) AS ss, sum(n) AS n FROM c) SELECT s/pairs AS somers_d, s/sqrt(4e0*(ss-s*s/n)) AS z FROM o""",
    "somers_d z",
)
def somers_z(t):
    y = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return bivariate.somers_test(t("orders"), F.substring("o_orderpriority", 1, 1), y).drop("p")


@query()
def chosen_test_orders(t):
    """The flagship: which test suits the order price across statuses, and its result."""
    return bivariate.compare_groups(t("orders"), "o_totalprice", "o_orderpriority")


# models


@query("SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem", "slope intercept r2", 4)
def ols_simple(t):
    rows = t("lineitem")
    fit = regression.ols(rows, "l_extendedprice", ["l_quantity"])
    return rows.sparkSession.createDataFrame([(float(fit.coef[1]), float(fit.coef[0]), float(fit.extra["r2"]))], "slope double, intercept double, r2 double")


def _least_squares(table: str, y: str, xs: list[str]) -> str:
    """CTEs g0 ... gk that sweep X'X (a), X'y (b) to its inverse and the estimates, and c, the HC3 covariance, each in one row.

    The sweep of pivot p turns it to 1/p, its row to r/p, its column to -c/p, and subtracts c r/p from all others.
    """
    k = len(xs) + 1
    x = ["1e0", *[f"CAST({c} AS DOUBLE)" for c in xs]]
    cells = [(f"a{i}_{j}", i, j) for i in range(k) for j in range(k)] + [(f"b{i}", i, k) for i in range(k)]
    name = {(i, j): n for n, i, j in cells}
    value = lambda j: f"CAST({y} AS DOUBLE)" if j == k else x[j]
    steps = ["g0 AS (SELECT " + ", ".join(f"sum({x[i]}*{value(j)}) AS {n}" for n, i, j in cells) + f", count(*) AS n FROM {table})"]
    for p in range(k):
        pivot = name[p, p]

        def swept(i: int, j: int, p: int = p, pivot: str = pivot) -> str:
            if i == p:
                return f"1e0/{pivot}" if j == p else f"{name[p, j]}/{pivot}"
            return f"-{name[i, p]}/{pivot}" if j == p else f"{name[i, j]}-{name[i, p]}*{name[p, j]}/{pivot}"

        steps.append(f"g{p + 1} AS (SELECT " + ", ".join(f"{swept(i, j)} AS {n}" for n, i, j in cells) + f", n FROM g{p})")
    fitted = " + ".join(f"b{i}*{x[i]}" for i in range(k))
    leverage = " + ".join(f"a{i}_{j}*{x[i]}*{x[j]}" for i in range(k) for j in range(k))
    steps.append(f"w AS (SELECT {', '.join(f'{x[i]} AS x{i}' for i in range(k))}, power(({value(k)} - ({fitted}))/(1e0 - ({leverage})), 2e0) AS w FROM {table}, g{k})")
    steps.append("m AS (SELECT " + ", ".join(f"sum(w*x{i}*x{j}) AS m{i}_{j}" for i in range(k) for j in range(k)) + " FROM w)")
    steps.append("c AS (SELECT " + ", ".join(f"b{i}, sqrt({' + '.join(f'a{i}_{u}*m{u}_{v}*a{v}_{i}' for u in range(k) for v in range(k))}) AS s{i}" for i in range(k)) + f" FROM g{k}, m)")
    return ", ".join(steps)


def _terms(table: str, y: str, xs: list[str]) -> str:
    """A SELECT of term, estimate, se of least squares with HC3 errors."""
    each = " UNION ALL ".join(f"SELECT '{n}' AS term, b{i} AS estimate, s{i} AS se FROM c" for i, n in enumerate(["(intercept)", *xs]))
    return f"WITH {_least_squares(table, y, xs)} SELECT * FROM ({each})"


def _with_p(terms: str) -> str:
    return f"SELECT *, {_normal_p('estimate/se')} AS p FROM ({terms})"


@query(f"SELECT term, estimate, se, estimate/se AS z, p, estimate - 1.96e0*se AS low, estimate + 1.96e0*se AS high FROM ({_with_p(_terms('lineitem', 'l_extendedprice', ['l_quantity', 'l_discount', 'l_tax']))})", "estimate se z p low high", 3)
def ols_hc3(t):
    rows = t("lineitem")
    return regression.ols(rows, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).table(rows.sparkSession)


@query(
    """WITH c AS (SELECT CAST(l_linestatus = 'F' AS DOUBLE) AS x, CAST(l_returnflag = 'R' AS DOUBLE) AS y FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'),
    k AS (SELECT avg(y) FILTER (WHERE l_quantity > 25) AS p1, avg(y) FILTER (WHERE l_quantity <= 25) AS p0 FROM (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS y, l_quantity FROM lineitem))
    SELECT 'a' AS term, ln(p0/(1e0-p0)) AS estimate FROM k UNION ALL SELECT 'b', ln(p1/(1e0-p1))-ln(p0/(1e0-p0)) FROM k""",
    "estimate", 5,
)
def logit_one_factor(t):
    """With one binary covariate the estimates have a closed form, which the SQL states."""
    rows = t("lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") > 25).cast("double").alias("x"))
    fit = regression.logistic(rows, "y", ["x"])
    return rows.sparkSession.createDataFrame([("a", float(fit.coef[0])), ("b", float(fit.coef[1]))], "term string, estimate double")


@query()
def logit_table(t):
    rows = t("lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") > 25).cast("double").alias("big"), F.round(F.col("l_discount") * 100).alias("discount"))
    return regression.logistic(rows, "y", ["big", "discount"]).table(rows.sparkSession, exponentiate=True)


@query("WITH m AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT ln(avg(n)) AS estimate FROM m", "estimate", 5)
def poisson_intercept(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg("l_tax").alias("x"))
    fit, one = regression._glm(rows, "n", [], "poisson", regression.poisson_step)
    one.unpersist()
    return rows.sparkSession.createDataFrame([(float(fit.coef[0]),)], "estimate double")


@query()
def multinomial_table(t):
    rows = t("lineitem").select("l_returnflag", F.floor(F.col("l_quantity") / 10).cast("double").alias("q"))
    return regression.multinomial(rows, "l_returnflag", ["q"]).table(rows.sparkSession)


@query()
def ordinal_table(t):
    rows = t("orders").select((F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("x"))
    return regression.ordinal(rows, "y", ["x"]).table(rows.sparkSession)


@query("SELECT 'l_discount' AS variable, 1e0/(1e0-corr(l_quantity, l_discount)*corr(l_quantity, l_discount)) AS vif FROM lineitem UNION ALL SELECT 'l_quantity', 1e0/(1e0-corr(l_quantity, l_discount)*corr(l_quantity, l_discount)) FROM lineitem", "vif")
def vif_two(t):
    rows = t("lineitem")
    return rows.sparkSession.createDataFrame(sorted(regression.vif(rows, ["l_quantity", "l_discount"]).items()), "variable string, vif double")


def _predicted(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("double").alias("y"), (0.2 + F.col("l_quantity") / 400.0).alias("fitted"))


@query(
    """WITH p AS (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS y, 0.2e0 + l_quantity/400e0 AS f, ntile(10) OVER (ORDER BY 0.2e0 + l_quantity/400e0, l_orderkey, l_linenumber) AS b FROM lineitem),
    g AS (SELECT b, CAST(count(*) AS DOUBLE) AS n, sum(y) AS o, sum(f) AS e FROM p GROUP BY 1) SELECT sum((o-e)*(o-e)/(e*(1e0-e/n))) AS chi2, count(*)-2 AS df FROM g""",
    "chi2", 5,
)
def hosmer_lemeshow(t):
    return regression.hosmer_lemeshow(_predicted(t), ["l_orderkey", "l_linenumber"])


@query(
    """WITH r AS (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS y, rank() OVER (ORDER BY 0.2e0 + l_quantity/400e0) + (count(*) OVER (PARTITION BY 0.2e0 + l_quantity/400e0)-1)/2e0 AS r FROM lineitem),
    s AS (SELECT sum(CASE WHEN y = 1 THEN r END) AS r, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM r) SELECT (r-n1*(n1+1e0)/2e0)/(CAST(n1 AS DOUBLE)*n0) AS auc, n1 AS events, n0 AS others FROM s""",
    "auc",
)
def auc_ranks(t):
    return regression.auc(_predicted(t))


@query("SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS events, least(count(*) FILTER (WHERE l_returnflag = 'R'), count(*) FILTER (WHERE l_returnflag <> 'R'))/3e0 AS per_parameter FROM lineitem", "per_parameter")
def events_per_parameter(t):
    e = F.col("l_returnflag") == "R"
    return t("lineitem").agg(F.count_if(e).alias("events"), (F.least(F.count_if(e), F.count_if(~e)) / 3.0).alias("per_parameter"))


_CHANGE = "CASE WHEN crude_p < 0.05e0 AND adjusted_p >= 0.05e0 THEN 'confounded' WHEN crude_p >= 0.05e0 AND adjusted_p < 0.05e0 THEN 'revealed' ELSE 'same' END"
_CRUDE = " UNION ALL ".join(f"SELECT * FROM ({_with_p(_terms('lineitem', 'l_extendedprice', [x]))})" for x in ("l_quantity", "l_discount"))


@query(
    f"""SELECT term, c.estimate AS crude, c.p AS crude_p, a.estimate AS adjusted, a.p AS adjusted_p, {_CHANGE} AS change FROM ({_CRUDE}) c JOIN ({_with_p(_terms('lineitem', 'l_extendedprice', ['l_quantity', 'l_discount']))}) a USING (term) WHERE term <> '(intercept)'""",
    "crude crude_p adjusted adjusted_p", 3,
)
def crude_vs_adjusted(t):
    return regression.crude_and_adjusted(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "linear")


@query(
    f"SELECT 1 AS model, term, estimate, p FROM ({_with_p(_terms('lineitem', 'l_extendedprice', ['l_quantity']))}) UNION ALL SELECT 2, term, estimate, p FROM ({_with_p(_terms('lineitem', 'l_extendedprice', ['l_quantity', 'l_discount', 'l_tax']))})",
    "estimate p", 3,
)
def nested_models(t):
    return regression.nested(t("lineitem"), "l_extendedprice", [["l_quantity"], ["l_discount", "l_tax"]], "linear")


@query()
def lmm_stages(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_totalprice").alias("y"), (F.col("o_orderstatus") == "F").cast("double").alias("x"), (F.col("c_nationkey") % 2).cast("double").alias("z"), F.col("c_nationkey").alias("g"))
    return multilevel.staged(rows, "y", ["x"], ["z"], "g", False)


@query()
def slope_stages(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_totalprice").alias("y"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("g"))
    return multilevel.staged(rows, "y", ["x"], [], "g", False, "x")


@query()
def bootstrap_optimism(t):
    rows = t("lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") / 50.0).alias("a"), "l_discount", (F.col("l_extendedprice") / 1e5).alias("b"))
    b = reliability.bootstrap(rows, "y", ["a", "l_discount", "b"], True)
    return rows.sparkSession.createDataFrame([(k, float(v)) for k, v in b.items()], "measure string, value double")


# factorial analyses and survival


@query()
def pca_axes(t):
    rows = t("lineitem")
    found = factorial.pca(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rows.sparkSession.createDataFrame([(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(found["eigenvalues"], found["shares"], strict=True))], "axis int, eigenvalue double, share double")


@query("WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem) SELECT 1 AS axis, 1e0+r AS eigenvalue, (1e0+r)/2e0 AS share FROM r UNION ALL SELECT 2, 1e0-r, (1e0-r)/2e0 FROM r", "eigenvalue share")
def pca_pair(t):
    """Of two columns the eigenvalues have a closed form, which the SQL states."""
    rows = t("lineitem")
    found = factorial.pca(rows, ["l_quantity", "l_extendedprice"])
    return rows.sparkSession.createDataFrame([(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(found["eigenvalues"], found["shares"], strict=True))], "axis int, eigenvalue double, share double")


@query()
def mca_axes(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = factorial.mca(rows, ["l_returnflag", "l_linestatus", "o_orderpriority"])
    return rows.sparkSession.createDataFrame([(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(found["inertia"], found["corrected"], strict=True))], "axis int, inertia double, corrected double")


@query(
    """WITH k AS (SELECT c_mktsegment AS c, CAST(c_nationkey % 4 AS VARCHAR) AS v, CAST(count(*) AS DOUBLE) AS njk FROM customer GROUP BY 1, 2), m AS (SELECT *, sum(njk) OVER (PARTITION BY c) AS nk, sum(njk) OVER (PARTITION BY v) AS nj, sum(njk) OVER () AS n FROM k)
    SELECT c AS class, 'q' AS variable, v AS category, njk/nk AS value, nj/n AS overall, (njk-nk*nj/n)/sqrt(nk*nj/n*(1e0-nj/n)*(n-nk)/(n-1e0)) AS v FROM m
    UNION ALL SELECT * FROM (WITH a AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS s2 FROM customer), b AS (SELECT c_mktsegment AS c, CAST(count(*) AS DOUBLE) AS nk, avg(c_acctbal) AS mk FROM customer GROUP BY 1) SELECT c, 'c_acctbal', NULL, mk, m, (mk-m)/sqrt((n-nk)/(n-1e0)*s2/nk) FROM a, b)""",
    "value overall v", 5,
)
def vtest_profile(t):
    rows = t("customer").withColumn("q", F.col("c_nationkey") % 4)
    return factorial.class_profile(rows, "c_mktsegment", ["q"], ["c_acctbal"])


def _times(t) -> DataFrame:
    days = F.datediff("l_shipdate", "o_orderdate")
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(days.alias("days"), (F.col("l_returnflag") == "R").cast("int").alias("returned"), "l_linestatus", "l_quantity", "l_discount").where("days >= 0")


_TIMES = "WITH s AS (SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS t, CAST(l_returnflag = 'R' AS INTEGER) AS e, l_linestatus AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) >= 0)"


@query(
    f"{_TIMES}, p AS (SELECT g, t, sum(e) AS d, count(*) AS m FROM s GROUP BY 1, 2), r AS (SELECT *, sum(m) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM p), l AS (SELECT *, CASE WHEN d < n THEN ln(1e0-CAST(d AS DOUBLE)/n) ELSE 0e0 END AS l, CASE WHEN d = n THEN 1 ELSE 0 END AS z FROM r) SELECT g AS \"group\", t, CAST(d AS BIGINT) AS d, CAST(n AS BIGINT) AS at_risk, CASE WHEN sum(z) OVER w > 0 THEN 0e0 ELSE exp(sum(l) OVER w) END AS survival FROM l WINDOW w AS (PARTITION BY g ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "survival",
)
def km_curve(t):
    return survival.kaplan_meier(survival.subjects(_times(t), "days", "returned", "l_linestatus"))


@query(
    f"{_TIMES}, p AS (SELECT t, CAST(sum(e) AS DOUBLE) AS d, CAST(sum(CASE WHEN g = 'F' THEN e ELSE 0 END) AS DOUBLE) AS d1, count(*) AS m, count(*) FILTER (WHERE g = 'F') AS m1 FROM s GROUP BY 1), r AS (SELECT *, CAST(sum(m) OVER w AS DOUBLE) AS n, CAST(sum(m1) OVER w AS DOUBLE) AS n1 FROM p WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), z AS (SELECT sum(d1 - d*n1/n) AS z, sum(CASE WHEN n > 1 THEN d*(n-d)/(n-1e0)*n1/n*(1e0-n1/n) ELSE 0e0 END) AS v FROM r WHERE d > 0) SELECT z*z/v AS chi2, 1 AS df FROM z",
    "chi2", 5,
)
def logrank_2(t):
    return survival.log_rank(survival.subjects(_times(t), "days", "returned", "l_linestatus")).drop("p")


@query()
def cox_table(t):
    return survival.cox(_times(t).withColumn("big", (F.col("l_quantity") > 25).cast("double")), "days", "returned", ["big", "l_discount"])


@query()
def hazards_test(t):
    return survival.proportional_hazards(_times(t).withColumn("big", (F.col("l_quantity") > 25).cast("double")), "days", "returned", ["big", "l_discount"])


@query()
def concordance_index(t):
    return survival.concordance(_times(t), "days", "returned", "l_quantity")


# text


#: The references that occur in pages; the ampersand comes last, so that what it yields isn't decoded again.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"))


def _replace_sql(c: str) -> str:
    for entity, char in _REFERENCES:
        c = f"replace({c}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


@query("SELECT page_id, trim(regexp_replace(" + _replace_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')") + ", '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages")
def strip_tags(t):
    return t("pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


_FOLD = "strip_accents(lower(text))"


@query(f"WITH k AS (SELECT doc_id, trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g')) AS k FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM k WHERE length(k) >= 8) SELECT doc_id, text AS title FROM r JOIN documents USING (doc_id) WHERE n = 1")
def title_dedupe(t):
    works = t("documents").select("doc_id", F.col("text").alias("title"), F.lit(None).cast("string").alias("doi"))
    return literature.dedupe(works, "doc_id").select("doc_id", "title")


_KEY = f"trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH k AS (SELECT doc_id, text, {_KEY} AS k FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM k WHERE length(k) >= 8) SELECT doc_id, text FROM r WHERE n = 1")
def text_dedupe(t):
    """Documents, the first of each folded whole text."""
    works = t("documents").select("doc_id", F.col("text").alias("title"), F.lit(None).cast("string").alias("doi"))
    return literature.dedupe(works, "doc_id").select("doc_id", F.col("title").alias("text"))


@query()
def sentence_split(t):
    return t("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("at", "sentence"))


@query()
def rule_extract(t):
    return literature.extract_parts(t("documents").select("doc_id", "text"), "text").select("doc_id", "objective", "method", "result", "limits")


@query("SELECT doc_id, 0.6e0*((doc_id % 100)/100e0) + 0.3e0*least(ln(1e0+n_chars/greatest(1e0, CAST(doc_id % 12 AS DOUBLE)))/4e0, 1e0) + 0.1e0*CAST(lang = 'en' AS DOUBLE) AS score FROM documents ORDER BY 2 DESC, 1 LIMIT 30", "score")
def rank_score_topk(t):
    value = literature.score((F.col("doc_id") % 100) / 100.0, F.col("n_chars"), F.col("doc_id") % 12, F.col("lang") == "en")
    return literature.rank(t("documents").select("doc_id", "n_chars", "lang"), value, "doc_id").select("doc_id", "score")


@query()
def tfidf_themes(t):
    works = t("benchmark").select("item_id", F.lit(None).cast("string").alias("title"), "text")  # items have no title
    return literature.themes(works, "item_id", "title", "text")[0]


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"SELECT conv_id, turn, regexp_matches(text, '{_re2(text.CAUSAL)}') AS causal, regexp_matches(text, '{_re2(text.INJECTION)}') AS injection FROM conversations")
def text_flags(t):
    return t("conversations").select("conv_id", "turn", text.is_causal(F.col("text")).alias("causal"), text.is_injection(F.col("text")).alias("injection"))


@query()
def number_guard(t):
    docs = t("documents").select("doc_id", "text")
    allowed = t("documents").select(F.col("n_chars").alias("fact"))
    return guards.unsupported_numbers(guards.quoted_numbers(docs, "doc_id", "text"), allowed, "doc_id")


@query("SELECT doc_id, len(list_distinct(list_filter(str_split_regex(" + _FOLD + ", '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w)))) AS n FROM documents")
def token_sets(t):
    return t("documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT doc_id, len(list_distinct(list_filter(str_split_regex(strip_accents(lower(text)), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w)))) AS n FROM documents")
def text_token_sets(t):
    """How many distinct words each whole text has."""
    return t("documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


# joins, sets, top-k, time


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_orphans(t):
    return results.dangling(t("documents"), "doc_id", t("labels"), "doc_id").select("doc_id")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS projects FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def users_with_counts(t):
    return results.with_counts(t("customer").select("c_custkey", "c_name"), "c_custkey", t("orders"), "o_custkey", "projects")


@query("SELECT p_type AS category FROM part GROUP BY 1 INTERSECT SELECT p_type FROM part WHERE p_size > 25")
def observed_categories(t):
    return results.present_categories(t("part"), "p_type", F.col("p_size") > 25)


@query("WITH k AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM k) SELECT p_brand, p_type, n, rank FROM r WHERE rank <= 2")
def top_categories(t):
    k = t("part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))
    return k.withColumn("rank", rank.cast("long")).where("rank <= 2")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_window(t):
    return stateful.window_counts(t("events"), "user_id", "ts", 3600).select("event_id", "user_id", "in_window")


@query("WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM s GROUP BY 1, 2")
def session_gap(t):
    return stateful.sessions(t("events"), "user_id", "ts")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAYS")
def ttl_purge(t):
    return stateful.retained(t("events"), "ts", 10, "2024-01-20 00:00:00").select("event_id")


@query("WITH q AS (SELECT quantile_cont(l_quantity, 0.05) AS a, quantile_cont(l_quantity, 0.35) AS b, quantile_cont(l_quantity, 0.65) AS c, quantile_cont(l_quantity, 0.95) AS e FROM lineitem) SELECT l_orderkey, l_linenumber, (power(greatest(0e0, l_quantity-a),3e0) - power(greatest(0e0, l_quantity-c),3e0)*(e-a)/(e-c) + power(greatest(0e0, l_quantity-e),3e0)*(c-a)/(e-c))/((e-a)*(e-a)) AS s1, (power(greatest(0e0, l_quantity-b),3e0) - power(greatest(0e0, l_quantity-c),3e0)*(e-b)/(e-c) + power(greatest(0e0, l_quantity-e),3e0)*(c-b)/(e-c))/((e-a)*(e-a)) AS s2 FROM lineitem, q", "s1 s2")
def spline_columns(t):
    rows = t("lineitem")
    a, b = reliability.spline_basis(F.col("l_quantity"), reliability.spline_knots(rows, "l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", a.alias("s1"), b.alias("s2"))


@query(None, "importance")
def boosted_importance(t):
    """What held-out AUC loses when a variable comes from another order's row, for whether an order is fulfilled."""
    rows = t("orders").select((F.col("o_orderstatus") == "F").cast("double").alias("y"), d(F.col("o_totalprice")).alias("price"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_custkey")
    return boosting.importance(rows, "y", ["price", "year", "month"], True, "o_custkey", {"price": ["price"], "date": ["year", "month"]}, boosting.Settings(rounds=3, rate=0.3))


def _sql_quantile(p: str) -> str:
    """The normal quantile of p in SQL."""

    def ratio(r: str, tables) -> str:
        sums = []
        for table in tables:
            total = f"{table[-1]!r}e0" if "e" not in repr(table[-1]) else repr(table[-1])
            for c in table[-2::-1]:
                total = f"({total} * {r} + {c!r}{'' if 'e' in repr(c) else 'e0'})"
            sums.append(total)
        return f"{sums[0]} / {sums[1]}"

    far = f"(sqrt(-ln(least({p}, 1e0 - ({p})))) - 1.6e0)"
    return f"CASE WHEN abs({p} - 0.5e0) <= 0.425e0 THEN ({p} - 0.5e0) * {ratio(f'(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))', dist.CENTRE)} ELSE sign({p} - 0.5e0) * {ratio(far, dist.SIDES)} END"


@query(
    f"""WITH r AS (SELECT c_nationkey AS nation, CAST(c_acctbal AS DOUBLE) AS x FROM customer WHERE c_acctbal IS NOT NULL),
    v AS (SELECT nation, x, row_number() OVER (PARTITION BY nation ORDER BY x) AS i, count(*) OVER (PARTITION BY nation) AS n FROM r),
    q AS (SELECT *, {_sql_quantile('((i - 0.375e0) / (n + 0.25e0))')} AS m FROM v),
    s AS (SELECT nation, n, sum(m * m) AS mm, sum(m * x) AS mx, var_pop(x) * n AS ss, max(m) AS high, max(m) FILTER (i = n - 1) AS second, max(x) FILTER (i = n) - max(x) FILTER (i = 1) AS outer_, max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS inner_, 1e0 / sqrt(n) AS u FROM q GROUP BY nation, n),
    a AS (SELECT *, high / sqrt(mm) + 0.221157e0*u - 0.147981e0*u*u - 2.07119e0*u*u*u + 4.434685e0*u*u*u*u - 2.706056e0*u*u*u*u*u AS a1, second / sqrt(mm) + 0.042981e0*u - 0.293762e0*u*u - 1.752461e0*u*u*u + 5.682633e0*u*u*u*u - 3.582633e0*u*u*u*u*u AS a2 FROM s WHERE n BETWEEN 6 AND 5000)
    SELECT nation, n, power(a1 * outer_ + a2 * inner_ + (mx - high * outer_ - second * inner_) / sqrt((mm - 2e0*high*high - 2e0*second*second) / (1e0 - 2e0*a1*a1 - 2e0*a2*a2)), 2) / ss AS w FROM a""",
    "w",
)
def shapiro_by_group(t):
    """Shapiro-Wilk of the balances of each nation's customers."""
    return describe.shapiro(t("customer"), "c_acctbal", ["c_nationkey"], 6).select(F.col("c_nationkey").alias("nation"), "n", "w")


_BY_NATION = "SELECT n_regionkey AS g, row_number() OVER (ORDER BY avg(CAST(c_acctbal AS DOUBLE))) AS r, count(*) OVER () AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 1) GROUP BY n_nationkey, n_regionkey"


@query(
    f"""WITH RECURSIVE v AS ({_BY_NATION}), sizes AS (SELECT count(*) FILTER (g = 0) AS n1, count(*) FILTER (g = 1) AS n2, CAST(sum(r) FILTER (g = 0) AS DOUBLE) - count(*) FILTER (g = 0) * (count(*) FILTER (g = 0) + 1) / 2e0 AS u FROM v),
    w(i, k, s) AS (SELECT 0, 0, 0 UNION ALL SELECT w.i + 1, w.k + pick, w.s + pick * (w.i + 1) FROM w, (VALUES (0), (1)) p(pick), sizes WHERE w.i < n1 + n2),
    us AS (SELECT s - n1 * (n1 + 1) / 2e0 AS x FROM w, sizes WHERE i = n1 + n2 AND k = n1)
    SELECT n1, n2, u, least(1e0, 2e0 * (SELECT count(*) FROM us, sizes z WHERE x <= least(z.u, z.n1 * z.n2 - z.u)) / (SELECT count(*) FROM us)) AS p, true AS exact FROM sizes""",
    "u p",
    9,
)
def mannwhitney_exact(t):
    """Mean balances of the nations of two regions: few groups, no ties, so U's exact distribution."""
    per = t("customer").join(t("nation").where("n_regionkey in (0, 1)"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_regionkey").agg(F.avg(d(F.col("c_acctbal"))).alias("mean"))
    return bivariate.mann_whitney_p(per, "mean", "n_regionkey").select("n1", "n2", "u", "p", "exact")


@query(None)
def ward_classes(t):
    """Sizes of the classes of line items by price and quantity: Ward's method on leaves of the whole table."""
    rows = t("lineitem").select(F.monotonically_increasing_id().alias("id"), (d(F.col("l_quantity")) / 50.0).alias("a"), (d(F.col("l_extendedprice")) / 100000.0).alias("b"))
    classes, _ = factorial.classify(rows, ["a", "b"], "id")
    return classes.groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS cluster, count(*) AS n, 0e0 AS score, true AS within FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY c_nationkey", "score", 5)
def logistic_effects(t):
    """Random intercepts of nations in a logit of customers' balances. At a posterior's mode its slope is nil: the sum of
    residuals is the effect over the variance; and its error is below the standard deviation between nations."""
    rows = t("customer").select(F.col("c_nationkey").cast("string").alias("nation"), (F.col("c_acctbal") > 1000 * (F.col("c_nationkey") % 7)).cast("double").alias("y"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("x")).dropna()
    model = multilevel.logistic_mixed(rows, "y", ["x"], "nation")
    effects = multilevel.random_effects(rows, "y", ["x"], "nation", model)
    eta = float(model.fit.coef[0]) + float(model.fit.coef[1]) * F.col("x") + F.col("effect")
    sums = rows.join(effects, F.col("nation") == F.col("cluster")).groupBy("cluster", "n", "effect", "se").agg(F.sum(F.col("y") - 1.0 / (1.0 + F.exp(-eta))).alias("s"))
    return sums.select("cluster", "n", (F.col("s") - F.col("effect") / model.between).alias("score"), F.col("se").between(0.0, math.sqrt(model.between)).alias("within"))
