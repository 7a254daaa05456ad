"""Queries over result tables, look-ups and text rules, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import text
from statloom.functions.expressions import d
from statloom.functions.lineage import shared_folder
from statloom.operators import audit, bivariate, cleaning, describe, guards, privacy, regression, results, survival
from statloom.plans.queries import KEY, SQL, query
from statloom.sources.literature import read_literature, write_index
from statloom.streaming import stateful

# Tests with p values made from counts, one for each priority and status.
_TESTS = """tests AS (SELECT o_orderpriority || '/' || o_orderstatus AS variable, (count(*) % 97) / 970e0 AS p FROM orders GROUP BY o_orderpriority, o_orderstatus)"""
_USED = _TESTS + """, r AS (SELECT *, row_number() OVER (ORDER BY p, variable) AS i, count(*) OVER () AS m FROM tests),
 u AS (SELECT variable, p, least(1e0, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_used FROM r)"""


def _tests(t):
    per = t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return per.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("variable"), ((F.col("n") % 97) / F.lit(970.0)).alias("p"))


def _adjusted(t):
    from statloom.operators.order import adjust_p

    return results.corrected(adjust_p(_tests(t)), "bh")


@query(f"WITH {_USED} SELECT variable, p, p_used FROM u", "p p_used", 9)
def correction_choice(t):
    return _adjusted(t)


@query(f"WITH {_USED} SELECT count(*) AS tests, count_if(p < 0.05e0) AS before, count_if(p_used < 0.05e0) AS after FROM u")
def significant_counts(t):
    return results.significant_counts(_adjusted(t), 0.05)


@query(f"WITH {_TESTS} SELECT variable, p FROM tests ORDER BY p, variable LIMIT 3", "p", 9)
def top_tests(t):
    return results.top_tests(_tests(t))


_TERMS = "terms AS (SELECT p_type AS variable, p_brand AS term, (count(*) % 89) / 890e0 AS p FROM part GROUP BY 1, 2)"


def _terms(t):
    return t("part").groupBy(F.col("p_type").alias("variable"), F.col("p_brand").alias("term")).agg(((F.count("*") % 89) / F.lit(890.0)).alias("p"))


@query(f"WITH {_TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY p, term) AS n FROM terms) SELECT variable, term, p FROM r WHERE n = 1 ORDER BY p, variable LIMIT 4", "p", 9)
def strongest_levels(t):
    return results.strongest_levels(_terms(t))


@query("WITH s AS (SELECT l_linenumber AS axis, sum(l_quantity) AS v FROM lineitem GROUP BY 1), q AS (SELECT axis, v / sum(v) OVER () AS share FROM s) SELECT axis, share, sum(share) OVER (ORDER BY axis ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulated FROM q", "share cumulated", 9)
def cumulated_shares(t):
    s = t("lineitem").groupBy(F.col("l_linenumber").alias("axis")).agg(F.sum("l_quantity").alias("v"))
    total = s.agg(F.sum("v").alias("all"))
    return results.cumulated(s.crossJoin(total).select("axis", (F.col("v") / F.col("all")).alias("share")), "axis", "share")  # one row


@query("WITH k AS (SELECT o_orderpriority AS g, year(o_orderdate) AS y, count(*) AS v FROM orders GROUP BY 1, 2), s AS (SELECT g, v - lag(v) OVER (PARTITION BY g ORDER BY y) AS step FROM k) SELECT g, count(step) AS steps, CASE WHEN bool_and(step > 0) THEN 'rising' WHEN bool_and(step < 0) THEN 'falling' END AS trend FROM s GROUP BY g UNION ALL SELECT 'up', 2, 'rising'")
def ordered_trend(t):
    levels = t("orders").groupBy(F.col("o_orderpriority").alias("g"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("v"))
    up = levels.sparkSession.createDataFrame([("up", 1, 1), ("up", 2, 3), ("up", 3, 4)], "g string, y int, v long")
    return results.trend(levels.unionByName(up), "g", "y", "v")


@query("SELECT c_custkey, avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS nation_mean FROM customer", "nation_mean", 6)
def cluster_mean(t):
    return results.with_cluster_mean(t("customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal", "nation_mean").select("c_custkey", "nation_mean")


_SHARES = "k AS (SELECT p_type AS variable, p_brand AS category, count(*) AS n FROM part GROUP BY 1, 2), f AS (SELECT variable, category, n / (sum(n) OVER (PARTITION BY variable)) AS share FROM k)"


@query(f"WITH {_SHARES}, r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY share DESC, category) AS rank FROM f) SELECT variable, category, share, rank FROM r WHERE rank <= 2", "share", 9)
def leading_categories(t):
    k = t("part").groupBy(F.col("p_type").alias("variable"), F.col("p_brand").alias("category")).agg(F.count("*").alias("n"))
    total = k.groupBy("variable").agg(F.sum("n").alias("all"))
    return results.leading_categories(k.join(total, "variable").select("variable", "category", (d(F.col("n")) / F.col("all")).alias("share")))


@query("WITH c AS (SELECT o_orderpriority AS x, o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT x, y, sum(n) OVER (PARTITION BY x) AS row_total, n / (sum(n) OVER (PARTITION BY x)) AS share FROM c) SELECT y, arg_min(x, (share, x)) AS low_group, min(share) AS low, arg_max(x, (share, x)) AS high_group, max(share) AS high FROM s WHERE row_total >= 10 GROUP BY y", "low high", 9)
def extreme_groups(t):
    cells = bivariate.crosstab(t("orders"), "o_orderpriority", "o_orderstatus").where("n > 0")
    return results.extreme_groups(cells.withColumn("share", d(F.col("n")) / d(F.col("row_total"))))


@query("WITH k AS (SELECT CAST(p_size AS BIGINT) % 3 AS axis, p_type AS category, count(*) AS n, sum(p_partkey % 7 - 3) AS coordinate FROM part GROUP BY 1, 2), m AS (SELECT *, n / (sum(n) OVER (PARTITION BY axis)) AS contribution FROM k), a AS (SELECT *, avg(contribution) OVER (PARTITION BY axis) AS mean, CASE WHEN coordinate < 0 THEN 'negative' ELSE 'positive' END AS side FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY axis, side ORDER BY contribution DESC, category) AS rank FROM a WHERE contribution > mean + 1e-12) SELECT axis, category, side, contribution, rank FROM r WHERE rank <= 4", "contribution", 9)
def top_contributions(t):
    k = t("part").groupBy((F.col("p_size").cast("long") % 3).alias("axis"), F.col("p_type").alias("category")).agg(F.count("*").alias("n"), F.sum(F.col("p_partkey") % 7 - 3).alias("coordinate"))
    total = k.groupBy("axis").agg(F.sum("n").alias("all"))
    return results.top_contributions(k.join(total, "axis").withColumn("contribution", d(F.col("n")) / F.col("all")))


@query("WITH k AS (SELECT p_brand AS term, count(*) AS importance FROM part GROUP BY 1), b AS (SELECT term, row_number() OVER (ORDER BY importance DESC, term) AS place FROM k) SELECT a.term AS a, b.term AS b FROM b a JOIN b b ON a.place < b.place WHERE b.place <= 4")
def candidate_pairs(t):
    return results.candidate_pairs(t("part").groupBy(F.col("p_brand").alias("term")).agg(F.count("*").alias("importance")))


@query("WITH m AS (SELECT c_nationkey AS unit, avg(c_acctbal) AS estimate FROM customer GROUP BY 1) SELECT unit, estimate, row_number() OVER (ORDER BY estimate, unit) AS place FROM m", "estimate")
def caterpillar_order(t):
    return results.sorted_effects(t("customer").groupBy(F.col("c_nationkey").alias("unit")).agg(F.avg("c_acctbal").alias("estimate")))


_AUTHOR = "CASE s_suppkey % 3 WHEN 0 THEN 'É' ELSE 'e' END || s_name"


@query(f"WITH w AS (SELECT s_suppkey AS key, {_AUTHOR} AS author, 2000 + s_nationkey AS year FROM supplier), c AS (SELECT * FROM w WHERE key IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) SELECT key, author, year, row_number() OVER (ORDER BY strip_accents(lower(author)), year, key) AS place FROM c")
def cited_bibliography(t):
    s = t("supplier")
    works = s.select(F.col("s_suppkey").alias("key"), F.concat(F.when(F.col("s_suppkey") % 3 == 0, "É").otherwise("e"), "s_name").alias("author"), (2000 + F.col("s_nationkey")).alias("year"))
    return results.bibliography(works, s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("key")))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def newest_first(t):
    return results.newest(t("orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("SELECT 'n' AS section, n_name AS key FROM nation UNION SELECT 'r', r_name FROM region UNION SELECT 'n', n_name FROM nation WHERE n_regionkey = 1")
def union_facts(t):
    n = t("nation").select(F.lit("n").alias("section"), F.col("n_name").alias("key"))
    return results.union_facts(n, t("region").select(F.lit("r").alias("section"), F.col("r_name").alias("key")), t("nation").where("n_regionkey = 1").select(F.lit("n").alias("section"), F.col("n_name").alias("key")))


@query("SELECT p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def distinct_in_order(t):
    return results.distinct_in_order(t("part"), "p_type", "p_partkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey <= 10 AND p_brand IS NOT NULL) OR p_brand IS NULL")
def except_points(t):
    return results.without(t("part").select("p_partkey", "p_brand"), t("part").where("p_partkey <= 10"), "p_brand")


@query("SELECT p_brand AS category, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey <= 10) GROUP BY 1")
def unseen_categories(t):
    return results.unseen_categories(t("part"), "p_brand", t("part").where("p_partkey <= 10").select(F.col("p_brand").alias("category")).distinct())


@query("WITH s AS (SELECT o_orderkey AS token, o_custkey AS user_id, CAST(o_orderkey % 40000 AS BIGINT) AS created, CAST(o_orderkey % 40000 + o_orderkey % 1000 AS BIGINT) AS seen FROM orders) SELECT token, user_id, c_name AS name FROM s JOIN customer ON c_custkey = user_id WHERE 15000 - seen <= 1800 AND 15000 - created <= 2000")
def session_users(t):
    created = F.col("o_orderkey") % 40000
    sessions = t("orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("user_id"), created.alias("created"), (created + F.col("o_orderkey") % 1000).alias("seen"))
    return results.session_user(sessions, t("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), F.lit(15000), 1800, 2000)


_RUNS = "runs AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'done' END AS status FROM orders)"


def _runs(t):
    return t("orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))


@query(f"WITH {_RUNS} SELECT o_custkey, count_if(status = 'running') AS running, count_if(status = 'running') < 2 AS admitted FROM runs GROUP BY 1")
def admission_counts(t):
    return results.admissions(_runs(t), "o_custkey", "status", 2)


@query(f"WITH {_RUNS} SELECT o_orderkey, o_custkey, CASE status WHEN 'running' THEN 'error' ELSE status END AS status FROM runs")
def interrupted_runs(t):
    return results.recovered(_runs(t), "status")


@query("SELECT p_partkey, p_type AS variable, p_brand AS level, coalesce(CASE WHEN p_type IN (SELECT p_type FROM part WHERE p_partkey <= 2) THEN 'Type ' || p_type END, p_type) || ': ' || p_brand AS text FROM part")
def term_labels(t):
    labels = t("part").where("p_partkey <= 2").select(F.col("p_type").alias("variable"), F.concat(F.lit("Type "), "p_type").alias("label")).distinct()
    return results.term_labels(t("part").select("p_partkey", F.col("p_type").alias("variable"), F.col("p_brand").alias("level")), labels)


@query("WITH v AS (SELECT DISTINCT p_type AS variable FROM part), c AS (SELECT DISTINCT p_type AS variable, p_brand AS category FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY category) AS n FROM c), l AS (SELECT variable, string_agg(category, ', ' ORDER BY category) AS categories FROM r WHERE n <= 8 GROUP BY 1) SELECT v.variable, CASE v.variable WHEN 'ECONOMY' THEN 'outcome' ELSE 'other' END AS role, l.categories FROM v LEFT JOIN l USING (variable)")
def variable_catalogue(t):
    part = t("part")
    roles = part.sparkSession.createDataFrame([("ECONOMY", "outcome")], "variable string, role string")
    return results.catalogue(part.select(F.col("p_type").alias("variable")).distinct(), roles, part.select(F.col("p_type").alias("variable"), F.col("p_brand").alias("category")).distinct())


@query("""WITH a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Answer: {"n": ' || p_size || ', "name": "' || p_brand || '"} end' WHEN 1 THEN 'none' ELSE '{"n": ' || p_size || '}' END AS said FROM part), j AS (SELECT p_partkey, regexp_extract(said, '(?s)(\\{.*\\})', 1) AS j FROM a) SELECT p_partkey, CASE WHEN j <> '' THEN CAST(json_extract(j, '$.n') AS BIGINT) END AS n, CASE WHEN j <> '' THEN json_extract_string(j, '$.name') END AS name FROM j""")
def json_answers(t):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(F.lit('Answer: {"n": '), size, F.lit(', "name": "'), "p_brand", F.lit('"} end'))).when(k == 1, "none").otherwise(F.concat(F.lit('{"n": '), size, F.lit("}")))
    return t("part").select("p_partkey", results.json_answer(said, "n long, name string").alias("j")).select("p_partkey", "j.n", "j.name")


@query("SELECT o_custkey AS key, coalesce(min(CASE WHEN o_orderstatus <> 'F' THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END), 'fallback') AS text, bool_or(o_orderstatus <> 'F') AS accepted FROM orders GROUP BY 1")
def guarded_texts(t):
    rows = t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("attempt"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("text"), F.lit("fallback").alias("fallback"), "o_orderstatus")
    return results.guarded(rows.drop("o_orderstatus"), "key", rows.where("o_orderstatus = 'F'"))


@query("SELECT o_orderstatus AS action, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS variables FROM orders GROUP BY 1")
def journal_by_action(t):
    return results.journal_by_action(t("orders").select(F.col("o_orderpriority").alias("variable"), F.col("o_orderstatus").alias("action")))


# privacy and cleaning


def _hmac_sql(column: str) -> str:
    pads = [bytes(b ^ k for b in KEY.ljust(64, b"\0")) for k in (0x5C, 0x36)]
    outer, inner = ("'" + "".join(f"\\x{b:02X}" for b in p) + "'::BLOB" for p in pads)
    return f"sha256({outer} || unhex(sha256({inner} || encode({column}))))"


@query(f"SELECT c_custkey, 'P' || substr({_hmac_sql('c_name')}, 1, 10) AS pseudonym FROM customer")
def pseudonyms(t):
    return t("customer").select("c_custkey", privacy.pseudonym(F.col("c_name"), KEY).alias("pseudonym"))


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def token_digests(t):
    return t("customer").select("c_custkey", privacy.token_digest(F.col("c_name")).alias("digest"))


_ADDRESS = "CASE c_custkey % 4 WHEN 0 THEN '10.0.' || c_nationkey || '.' || (c_custkey % 250) WHEN 1 THEN '2001:DB8:' || c_nationkey || '::' || (c_custkey % 100) WHEN 2 THEN '2001:db8:0:' || c_nationkey || ':1:2:3:' || (c_custkey % 100) ELSE '::1' END"


@query(f"SELECT c_custkey, {_ADDRESS} AS address, CASE c_custkey % 4 WHEN 0 THEN {_ADDRESS} WHEN 1 THEN CASE c_nationkey WHEN 0 THEN '2001:db8::/64' ELSE '2001:db8:' || c_nationkey || '::/64' END WHEN 2 THEN CASE c_nationkey WHEN 0 THEN '2001:db8::/64' ELSE '2001:db8:0:' || c_nationkey || '::/64' END ELSE '::/64' END AS network FROM customer")
def network_keys(t):
    a = F.expr(_ADDRESS)
    return t("customer").select("c_custkey", a.alias("address"), privacy.network_key(a).alias("network"))


_WORDS = "CASE p_partkey % 6 WHEN 0 THEN ' NA ' WHEN 1 THEN 'none' WHEN 2 THEN '.' WHEN 3 THEN 'Missing' WHEN 4 THEN '-' ELSE p_brand END"


@query(f"SELECT p_partkey, CASE WHEN trim({_WORDS}) IN ('', 'NA', 'N/A', 'na', 'NaN', '.', 'NSP', 'nsp') THEN NULL ELSE trim({_WORDS}) END AS word FROM part")
def null_words(t):
    return t("part").select("p_partkey", cleaning.null_words(F.expr(_WORDS)).alias("word"))


_FIGURE = "CASE p_partkey % 4 WHEN 0 THEN '1 ' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ',5' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'x' || p_size ELSE '-' || p_size || '.25' END"


@query(f"SELECT p_partkey, TRY_CAST(replace(replace({_FIGURE}, ' ', ''), ',', '.') AS DOUBLE) AS number FROM part", "number")
def written_numbers(t):
    return t("part").select("p_partkey", cleaning.number(F.expr(_FIGURE.replace("VARCHAR", "STRING"))).alias("number"))


# text


_RUN = r"[-−]?[0-9]{1,3}(?:\p{Zs}[0-9]{3}\b)+[\p{L}\p{N}_.,]*|[-−]?[\p{L}\p{N}_.,]+"
_NUMBERS = rf"""list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '([\p{{L}}\p{{N}}_.,])[-−]', '\1|', 'g'), '([0-9])[.,](\p{{L}})', '\1|\2', 'g'), '{_RUN}'),
 lambda x: regexp_replace(regexp_replace(x, '\p{{Zs}}', '', 'g'), '[.,]+$', '')), lambda x: regexp_matches(x, '^[-−]?[0-9]+([.,][0-9]+)?$'))"""


@query(f"WITH n AS (SELECT doc_id, unnest({_NUMBERS}) AS x FROM documents) SELECT doc_id, CAST(translate(x, ',−', '.-') AS DOUBLE) AS value, CAST(length(regexp_extract(x, '[.,]([0-9]+)$', 1)) AS BIGINT) AS decimals FROM n", "value")
def numbers_in_texts(t):
    return guards.quoted_numbers(t("documents"), "doc_id", "text").select("doc_id", "value", F.col("decimals").cast("long").alias("decimals"))


@query(f"""WITH n AS (SELECT DISTINCT doc_id, unnest({_NUMBERS}) AS x FROM documents), v AS (SELECT DISTINCT doc_id, CAST(translate(x, ',−', '.-') AS DOUBLE) AS value, CAST(length(regexp_extract(x, '[.,]([0-9]+)$', 1)) AS BIGINT) AS decimals FROM n),
 need AS (SELECT * FROM v WHERE NOT (decimals = 0 AND abs(value) <= 10)), f AS (SELECT DISTINCT CAST(n_chars AS DOUBLE) AS fact FROM documents WHERE n_chars IS NOT NULL)
 SELECT doc_id, value, decimals FROM need WHERE (decimals = 0 AND value NOT IN (SELECT fact FROM f)) OR (decimals > 0 AND NOT (round(value) IN (SELECT fact FROM f) AND abs(value - round(value)) <= 0.5e0 / pow(10e0, decimals) + 1e-9))""", "value")
def unsupported_numbers(t):
    docs = t("documents")
    found = guards.unsupported_numbers(guards.quoted_numbers(docs, "doc_id", "text"), docs.where("n_chars is not null").select(F.col("n_chars").alias("fact")), "doc_id")
    return found.select("doc_id", "value", F.col("decimals").cast("long").alias("decimals")).distinct()


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s, ' ')), lambda s: length(s) > 20)"


@query(f"WITH s AS (SELECT doc_id, {_SENTENCES} AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(range(len(l))) AS at, unnest(l) AS sentence FROM s")
def sentences_in_order(t):
    return t("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("at", "sentence"))


# tests and models


@query("""WITH c AS (SELECT count_if(quality = 1 AND toxic = 1) AS a, count_if(quality = 1 AND toxic <> 1) AS b, count_if(quality <> 1 AND toxic = 1) AS c, count_if(quality <> 1 AND toxic <> 1) AS d FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
 m AS (SELECT *, a + b AS r1, c + d AS r2, a + c AS k, a + b + c + d AS n FROM c), k AS (SELECT *, unnest(range(CAST(greatest(0, k - r2) AS BIGINT), CAST(least(r1, k) + 1 AS BIGINT))) AS x FROM m),
 p AS (SELECT *, exp(lgamma(r1 + 1e0) - lgamma(x + 1e0) - lgamma(r1 - x + 1e0) + lgamma(r2 + 1e0) - lgamma(k - x + 1e0) - lgamma(r2 - k + x + 1e0) - lgamma(n + 1e0) + lgamma(k + 1e0) + lgamma(n - k + 1e0)) AS w FROM k)
 SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, least(1e0, sum(w) FILTER (w <= (SELECT w FROM p WHERE x = a) * (1 + 1e-7))) AS p FROM p""", "p", 6)
def fisher_table(t):
    few = t("labels").where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return bivariate.fisher(few, "quality", "1", "toxic", "1").select("a", "b", "c", "d", "p")


@query("""WITH p AS (SELECT CAST(p_size AS DOUBLE) AS t, CAST(p_partkey % 3 = 0 AS INT) AS e, CAST(p_retailprice AS DOUBLE) AS s FROM part)
 SELECT sum(CASE WHEN a.s > b.s THEN 1e0 WHEN a.s = b.s THEN 0.5e0 ELSE 0e0 END) / count(*) AS concordance, CAST(count(*) AS DOUBLE) AS pairs FROM p a JOIN p b ON a.t < b.t WHERE a.e = 1""", "concordance pairs", 9)
def exact_concordance(t):
    rows = t("part").select(F.col("p_size").alias("t"), (F.col("p_partkey") % 3 == 0).cast("int").alias("e"), F.col("p_retailprice").alias("s"))
    return survival.concordance(rows, "t", "e", "s")


_LINE = """m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my FROM r), s AS (SELECT any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((x-mx)*(x-mx)) AS sxx, sum((x-mx)*(y-my)) AS sxy FROM r, m),
 b AS (SELECT *, sxy/sxx AS slope, my - sxy/sxx*mx AS icpt FROM s)"""


@query(f"""WITH r AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem), {_LINE},
 w AS (SELECT x, pow((y - icpt - slope*x) / (1e0 - 1e0/n - (x-mx)*(x-mx)/sxx), 2) AS w, mx, sxx, n, slope, icpt FROM r, b)
 SELECT 'l_quantity' AS term, any_value(slope) AS estimate, sqrt(sum(w*(x-mx)*(x-mx))) / any_value(sxx) AS se FROM w
 UNION ALL SELECT '(intercept)', any_value(icpt), sqrt(sum(w*pow(1e0/n - mx*(x-mx)/sxx, 2))) FROM w""", "estimate se", 4)
def robust_line(t):
    rows = t("lineitem")
    return regression.ols(rows, "l_extendedprice", ["l_quantity"]).table(rows.sparkSession).select("term", "estimate", "se")


@query(f"""WITH r AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, l_suppkey AS g FROM lineitem), {_LINE},
 e AS (SELECT g, sum(y - icpt - slope*x) AS s0, sum((y - icpt - slope*x)*(x - mx)) AS s1, any_value(mx) AS mx, any_value(sxx) AS sxx, any_value(n) AS n, any_value(slope) AS slope FROM r, b GROUP BY g)
 SELECT 'l_quantity' AS term, any_value(slope) AS estimate, sqrt(sum(s1*s1) * count(*)/(count(*)-1e0) * (any_value(n)-1e0)/(any_value(n)-2e0)) / any_value(sxx) AS se FROM e""", "estimate se", 4)
def clustered_line(t):
    rows = t("lineitem")
    return regression.ols(rows, "l_extendedprice", ["l_quantity"], "l_suppkey").table(rows.sparkSession).select("term", "estimate", "se").where("term <> '(intercept)'")


@query("""WITH r AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, l_suppkey AS g FROM lineitem), m AS (SELECT avg(y) AS p, count(*) AS n FROM r), s AS (SELECT g, sum(y - p) AS s, any_value(p) AS p, any_value(n) AS n FROM r, m GROUP BY g)
 SELECT '(intercept)' AS term, ln(any_value(p)/(1e0-any_value(p))) AS estimate, sqrt(sum(s*s) * count(*)/(count(*)-1e0)) / (any_value(n)*any_value(p)*(1e0-any_value(p))) AS se FROM s""", "estimate se", 6)
def clustered_logit(t):
    rows = t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_suppkey")
    fit = regression.clustered(rows, "y", [], "l_suppkey", regression.logistic(rows, "y", []))
    return fit.table(rows.sparkSession).select("term", "estimate", "se")


@query("SELECT o_orderpriority AS \"group\", count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1", "mean sd q1 median q3", 4)
def quantiles_by_group(t):
    return bivariate.group_quantiles(t("orders"), "o_totalprice", "o_orderpriority")


@query("SELECT count(*) AS n_total, count(lang) AS n_used, 1e0 - count(lang) / count(*) AS left_out FROM documents", "left_out", 9)
def left_out_share(t):
    return cleaning.complete_cases(t("documents"), ["lang"])[1]


@query("SELECT l_returnflag AS category, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem) AS share FROM lineitem GROUP BY 1", "share", 9)
def plain_frequencies(t):
    return describe.frequencies(t("lineitem"), "l_returnflag").select("category", "n", "share")


@query("WITH d AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM d")
def repeated_answers(t):
    return audit.duplicate_rows(t("lineitem").select("l_returnflag", "l_linestatus"))


# sessions


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 w AS (SELECT user_id, i, us, us AS began, CAST(1 AS BIGINT) AS session FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, e.us, CASE WHEN e.us - w.us <= {12 * 3600 * 10**6} AND e.us - w.began <= {72 * 3600 * 10**6} THEN w.began ELSE e.us END, CASE WHEN e.us - w.us <= {12 * 3600 * 10**6} AND e.us - w.began <= {72 * 3600 * 10**6} THEN w.session ELSE w.session + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
 SELECT user_id, session, CAST(min(us) AS BIGINT) AS start_us, CAST(max(us) AS BIGINT) AS end_us, count(*) AS n FROM w GROUP BY 1, 2""")
def session_limits(t):
    """Sessions of at most three days whose events are at most 12 hours apart, as the table has few events a user."""
    return stateful.limited_sessions(t("events"), "user_id", "ts", 12 * 60, 72)


# sources


@query("SELECT CAST(1990 + doc_id % 30 AS INTEGER) AS year, source AS kind, count(*) AS n, count(DISTINCT doc_id) AS dois, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS citations FROM documents WHERE doc_id % 30 >= 15 GROUP BY 1, 2")
def literature_pages(t):
    """Works made of all documents, written as a service's pages; those of the later years are read back."""
    works = t("documents").select(F.concat(F.lit("10.9/"), "doc_id").alias("doi"), F.concat_ws(" ", "lang", "doc_id").alias("title"), (1990 + F.col("doc_id") % 30).cast("int").alias("year"), F.col("n_chars").alias("citations"), F.col("source").alias("kind"))
    folder = shared_folder(works.sparkSession)
    write_index(works, folder)
    back = read_literature(works.sparkSession, folder, ("doi", "year", "citations", "kind"), first_year=2005)
    return back.groupBy("year", "kind").agg(F.count("*").alias("n"), F.count_distinct("doi").alias("dois"), F.sum("citations").alias("citations"))


#: Queries of the same rows.
SQL["pseudonymize"], SQL["sentence_split"] = SQL["pseudonyms"], SQL["sentences_in_order"]
