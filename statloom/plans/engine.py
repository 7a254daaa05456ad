"""A declarative analysis: roles and choices in, typed result tables out."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.operators import audit, bivariate, boosting, catalog, describe, factorial, hypotheses, multilevel, privacy, regression, reliability, survival
from statloom.operators.cleaning import complete_cases, event_level, reference_level
from statloom.functions.expressions import category_text
from statloom.operators.order import adjust_p
from statloom.operators.results import top_contributions

NUMERIC = ("count", "continuous")


@dataclass(frozen=True)
class AnalysisPlan:
    """What to analyse. Unknown keys of a JSON plan are dropped."""

    outcome: str | None = None
    explanatory: tuple[str, ...] = ()
    cluster: str | None = None
    level2: tuple[str, ...] = ()
    weight: str | None = None
    duration: str | None = None
    event: str | None = None
    event_level: str | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    orders: dict[str, list[str]] = field(default_factory=dict)
    privacy: dict[str, str] = field(default_factory=dict)
    analyses: tuple[str, ...] = ("audit", "describe", "bivariate", "model")
    hypotheses: tuple[dict, ...] = ()
    scales: dict[str, list[str]] = field(default_factory=dict)
    row_key: str | None = None
    random_slope: str | None = None
    alpha: float = 0.05
    nonparametric: bool = False
    boosting_rounds: int = 300

    @classmethod
    def from_json(cls, text: str) -> AnalysisPlan:
        given = {k: v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__}
        for k in ("explanatory", "level2", "analyses", "hypotheses"):
            if k in given:
                given[k] = tuple(given[k])
        return cls(**given)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def coded(df: DataFrame, plan: AnalysisPlan, kinds: dict[str, catalog.Variable]) -> tuple[DataFrame, list[str]]:
    """df with numeric columns for the explanatory variables, and their names: numbers as they are, categories as 0/1."""
    xs = []
    for x in plan.explanatory:
        if kinds[x].kind in NUMERIC:
            xs.append(x)
            continue
        names = catalog.categories(df, x, plan.orders.get(x))
        # categories() allows no more of them
        counts = {r["c"]: r["n"] for r in df.where(F.col(x).isNotNull()).groupBy(category_text(F.col(x)).alias("c")).agg(F.count("*").alias("n")).orderBy("c").collect()}
        reference = reference_level({c: counts.get(c, 0) for c in names}, kinds[x].kind)
        for level in names:
            if level != reference:
                name = f"{x}[{level}]"
                df = df.withColumn(name, F.when(F.col(x).isNotNull(), (category_text(F.col(x)) == level).cast("double")))
                xs.append(name)
    return df, xs


def plain_names(df: DataFrame, xs: list[str]) -> tuple[DataFrame, list[str]]:
    """df with a column under a plain name for each of xs, and these names."""
    quoted = [c.replace("[", "_").replace("]", "_").replace(" ", "_") for c in xs]
    return df.select("*", *[F.col(f"`{c}`").alias(q) for c, q in zip(xs, quoted, strict=True) if q != c]), quoted


def varying(df: DataFrame, xs: list[str], needed: list[str]) -> list[str]:
    """The columns of xs that have more than one value among the rows complete for xs and the needed ones."""
    if not xs:
        return []
    spread = df.na.drop(subset=[*needed, *xs]).agg(*[(F.min(f"`{c}`") < F.max(f"`{c}`")).alias(c) for c in xs]).first()
    return [c for c in xs if spread[c]]


def covariates(df: DataFrame, plan: AnalysisPlan, kinds: dict[str, catalog.Variable]) -> tuple[DataFrame, list[str]]:
    """df with the coded explanatory variables that vary among the subjects at risk, under plain names."""
    wide, xs = coded(df, plan, kinds)
    return plain_names(wide, varying(wide, xs, [plan.duration, plan.event]))


def numeric_columns(df: DataFrame, plan: AnalysisPlan, kinds: dict[str, catalog.Variable]) -> tuple[DataFrame, str, list[str], str]:
    """Rows with a coded outcome _y and numeric model columns: numbers as they are, categories as 0/1 columns."""
    outcome, kind = plan.outcome, kinds[plan.outcome].kind
    model = regression.model_kind(kind)
    if kind == "binary":
        yes = event_level(catalog.categories(df, outcome), plan.event_level)
        df = df.withColumn("_y", F.when(F.col(outcome).isNotNull(), (category_text(F.col(outcome)) == yes).cast("double")))
    elif kind == "ordinal":
        names = catalog.categories(df, outcome, plan.orders.get(outcome))
        df = df.withColumn("_y", (F.array_position(F.array(*[F.lit(c) for c in names]), category_text(F.col(outcome))) - 1).cast("double"))
    else:
        df = df.withColumn("_y", F.col(outcome))
    df, xs = coded(df, plan, kinds)
    return df, model, varying(df, xs, ["_y"]), "_y"


def _order(df: DataFrame, plan: AnalysisPlan, kinds: dict[str, catalog.Variable], x: str, other: str) -> list[str] | None:
    """The order of x's levels where it may count as ordered against other: both ordinal, or one ordinal and one binary."""
    pair = {kinds[x].kind, kinds[other].kind}
    return catalog.categories(df, x, plan.orders.get(x)) if "ordinal" in pair and pair <= {"ordinal", "binary"} else None


def associations(df: DataFrame, plan: AnalysisPlan, kinds: dict[str, catalog.Variable]) -> DataFrame:
    """The chosen test of the outcome with each explanatory variable, with adjusted p values."""
    out = None
    number = kinds[plan.outcome].kind in NUMERIC
    for x in plan.explanatory:
        other = kinds[x].kind in NUMERIC
        if number and other:
            row = bivariate.compare_numbers(df, x, plan.outcome, plan.nonparametric)
        elif number:
            row = bivariate.compare_groups(df, plan.outcome, x, plan.nonparametric).withColumn("variable", F.lit(x))
        elif other:
            row = bivariate.compare_groups(df, x, plan.outcome, plan.nonparametric)
        else:
            row = bivariate.compare_categories(df, x, plan.outcome, _order(df, plan, kinds, x, plan.outcome), _order(df, plan, kinds, plan.outcome, x))
        out = row if out is None else out.unionByName(row)
    return adjust_p(out)


def post_hoc(df: DataFrame, plan: AnalysisPlan, kinds: dict[str, catalog.Variable], tests: DataFrame) -> DataFrame | None:
    """variable, test, a, b, statistic, p: pairs of groups, for tests across three or more that hold after correction."""
    out = None
    number = kinds[plan.outcome].kind in NUMERIC
    for r in tests.where((F.col("p_bh") < plan.alpha) & (F.col("n_groups") >= 3)).select("variable", "test").collect():  # one row a variable
        value, group = (plan.outcome, r["variable"]) if number else (r["variable"], plan.outcome)
        pairs = bivariate.post_hoc(df, value, group, r["test"])
        if pairs is not None:
            pairs = pairs.select(F.lit(r["variable"]).alias("variable"), "*")
            out = pairs if out is None else out.unionByName(pairs)
    return out


#: Complete rows that a model needs, and the share of rows left out above which a warning is given.
LEAST_ROWS, MOST_LEFT_OUT = 20, 0.1


def diagnostics(rows: DataFrame, y: str, xs: list[str], fit: regression.Fit) -> dict[str, float]:
    """What speaks for or against a fitted model, by its kind; events_per_parameter counts the rarer outcome."""
    found = {f"vif {c}": v for c, v in regression.vif(rows, xs).items()}
    if fit.kind in ("logistic", "firth"):
        # a hash of the whole row orders equal fitted values, so that y doesn't
        told = regression.predictions(rows.withColumn("_place", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])), y, xs, fit, ["_place"])
        fit_test = regression.hosmer_lemeshow(told, ["_place"]).first()
        area = regression.auc(told).first()
        p = dist.chi2_sf(fit_test["chi2"], fit_test["df"]) if fit_test["chi2"] is not None and fit_test["df"] > 0 else None
        found |= {"hosmer_lemeshow": fit_test["chi2"], "hosmer_lemeshow_p": p, "auc": area["auc"], "events_per_parameter": min(area["events"], area["others"]) / len(xs)}
    if fit.kind == "linear":
        found |= regression.linear_diagnostics(rows, y, xs)
    return {k: float(v) for k, v in found.items() if v is not None}


def reliability_tables(rows: DataFrame, plan: AnalysisPlan, y: str, xs: list[str], owner: dict[str, str], model: str, left_out: float) -> dict[str, DataFrame]:
    """Cross-validation against boosted trees, importance of the variables, the specification search that it leads, and
    the scorecard. owner: the variable that each column of xs stands for."""
    spark, binary = rows.sparkSession, model == "logistic"
    groups: dict[str, list[str]] = {}
    for x in xs:
        groups.setdefault(owner[x], []).append(x)
    measures, importance = boosting.cross_validated(rows, y, xs, binary, plan.cluster, groups, boosting.Settings(rounds=plan.boosting_rounds))
    found = {r["variable"]: r["importance"] for r in importance.collect()}  # a row a variable
    per = {r["model"]: r["m"] for r in measures.groupBy("model").agg(F.avg("measure").alias("m")).collect()}
    boot = reliability.bootstrap(rows, y, xs, binary)
    vif = regression.vif(rows, xs)
    values = {"left_out": left_out, "vif_max": max(vif.values()) if vif else None, "boosting_gain": per["boosted"] - per["usual"]}
    if binary:
        values |= {"auc_corrected": boot["corrected"], "calibration_slope": boot["slope"]}
    return {
        "cross_validation": measures, "importance": spark.createDataFrame(list(found.items()), "variable string, importance double"),
        "specification": reliability.specification_search(rows, y, xs, model, importance={x: found[owner[x]] for x in xs}),
        "bootstrap": spark.createDataFrame([(k, float(v)) for k, v in boot.items()], "measure string, value double"), "reliability": reliability.scorecard(spark, values),
    }


def run(df: DataFrame, plan: AnalysisPlan, key: bytes = b"") -> dict[str, DataFrame]:
    """Result tables by name. Privacy actions come first, then typing, then the analyses asked for."""
    spark = df.sparkSession
    df, journal = privacy.apply_actions(df, plan.privacy, key)
    kinds = catalog.variables(df, plan.kinds)
    results = {
        "variables": spark.createDataFrame([(v.name, v.kind, v.role, v.n_valid, v.n_missing, v.n_unique) for v in kinds.values()], "variable string, kind string, role string, n_valid long, n_missing long, n_unique long"),
        "privacy": spark.createDataFrame(journal, "variable string, action string"),
    }
    used = [v.name for v in kinds.values() if v.role == "use"]
    if "audit" in plan.analyses:
        results["missing"] = audit.missing(df)
        results["duplicates"] = audit.duplicate_rows(df)
        if plan.outcome:
            results["missingness"] = audit.missingness_tests(df, plan.outcome, kinds[plan.outcome].kind in NUMERIC, [c for c in used if c != plan.outcome], plan.alpha)
        numbers = [c for c in used if kinds[c].kind in NUMERIC]
        if numbers:
            results["outliers"] = audit.outliers(df, numbers)
    if "describe" in plan.analyses:
        numbers = [c for c in used if kinds[c].kind in NUMERIC]
        if numbers:
            results["numbers"] = describe.quantitative(df, numbers)
            results["normality"] = describe.normality(df, numbers)
        tables = [describe.frequencies(df, c, plan.weight).withColumn("variable", F.lit(c)) for c in used if kinds[c].kind in ("binary", "nominal", "ordinal")]
        for t in tables:
            results["frequencies"] = results["frequencies"].unionByName(t) if "frequencies" in results else t
    tests = terms = None
    if plan.outcome and plan.explanatory and "bivariate" in plan.analyses:
        tests = results["tests"] = associations(df, plan, kinds)
        pairs = post_hoc(df, plan, kinds, tests)
        if pairs is not None:
            results["post_hoc"] = pairs
    if plan.outcome and plan.explanatory and "model" in plan.analyses:
        wide, model, xs, y = numeric_columns(df, plan, kinds)
        wide, quoted = plain_names(wide, xs)
        rows, told = complete_cases(wide, [y, *quoted])
        left = told.first()
        results["cases"] = told.withColumn("warning", F.when(F.col("left_out") > MOST_LEFT_OUT, "many rows left out"))
        if quoted and left["n_used"] >= LEAST_ROWS:
            fit = regression.fit_kind(rows, y, quoted, model, plan.cluster)
            results["coefficients"] = fit.table(spark)
            owner = {q: c.split("[")[0] for c, q in zip(xs, quoted, strict=True)}
            named = F.coalesce(*[F.when(F.col("term") == q, v) for q, v in owner.items()])
            terms = results["coefficients"].where("term <> '(intercept)'").select(named.alias("variable"), "term", "estimate", "p")
            if model in ("logistic", "linear"):
                results["diagnostics"] = spark.createDataFrame(list(diagnostics(rows, y, quoted, fit).items()), "measure string, value double")
            if model in ("logistic", "poisson"):
                results["fit"] = spark.createDataFrame([(k, float(v)) for k, v in regression.fit_measures(fit).items()], "measure string, value double")
            if model in ("logistic", "linear", "poisson") and len(quoted) > 1:
                results["crude_adjusted"] = regression.crude_and_adjusted(rows, y, quoted, model, plan.alpha)
            if model == "ordinal":
                results["parallel_lines"] = spark.createDataFrame([(k, float(v)) for k, v in regression.brant(rows, y, quoted).items()], "measure string, value double")
            if plan.level2 and model != "multinomial":
                second = [q for q, v in owner.items() if v in plan.level2]
                first = [q for q in quoted if q not in second]
                if first and second:
                    results["nested"] = regression.nested(rows, y, [first, second], model)
            if model in ("logistic", "linear") and "reliability" in plan.analyses:
                results |= reliability_tables(rows, plan, y, quoted, owner, model, left["left_out"])
            if plan.cluster and "multilevel" in plan.analyses and model in ("logistic", "linear"):
                second = [q for q, v in owner.items() if v in plan.level2]
                results["multilevel"] = multilevel.staged(rows, y, [q for q in quoted if q not in second], second, plan.cluster, model == "logistic", plan.random_slope)
                whole = (multilevel.logistic_mixed if model == "logistic" else multilevel.linear_mixed)(rows, y, quoted, plan.cluster)
                effects = results["context_effects"] = multilevel.random_effects(rows, y, quoted, plan.cluster, whole)
                results["context_extremes"] = multilevel.extreme_clusters(effects)
    if plan.duration and plan.event and "survival" in plan.analyses:
        subjects = survival.subjects(df, plan.duration, plan.event)
        curve = results["survival"] = survival.kaplan_meier(subjects)
        results["survival_medians"] = survival.medians(curve)
        groups = [x for x in plan.explanatory if kinds[x].kind not in NUMERIC]
        for x in groups:
            told = survival.log_rank(survival.subjects(df, plan.duration, plan.event, x)).select(F.lit(x).alias("variable"), "*")
            results["log_rank"] = results["log_rank"].unionByName(told) if "log_rank" in results else told
        if plan.explanatory:
            wide, xs = covariates(df, plan, kinds)
            if xs:
                results["cox"], results["proportional_hazards"] = survival.cox_tables(wide, plan.duration, plan.event, xs)
    if "factorial" in plan.analyses:
        numbers = [c for c in used if kinds[c].kind in NUMERIC]
        if len(numbers) >= 3:
            found = factorial.pca(df, numbers)
            results["components"] = spark.createDataFrame([(i + 1, float(v), float(s), float(q), i < found["retained"]) for i, (v, s, q) in enumerate(zip(found["eigenvalues"], found["shares"], found["noise"], strict=True))], "axis int, eigenvalue double, share double, noise double, retained boolean")
        names = [c for c in used if kinds[c].kind in ("binary", "nominal", "ordinal")]
        if len(names) >= 3:
            found = factorial.mca(df, names)
            results["mca"] = spark.createDataFrame([(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(found["inertia"], found["corrected"], strict=True))], "axis int, inertia double, corrected double")
            points = [(i + 1, c, float(found["coordinates"][j, i]), float(found["contributions"][j, i]), float(found["cos2"][j, i])) for i in range(len(found["inertia"])) for j, c in enumerate(found["categories"])]
            results["mca_categories"] = spark.createDataFrame(points, "axis int, category string, coordinate double, contribution double, cos2 double")
            results["mca_leading"] = top_contributions(results["mca_categories"])
            if plan.row_key and len(found["inertia"]) >= 2:
                scores = factorial.mca_scores(df, names, found, [plan.row_key])
                classes, _ = factorial.classify(scores, ["axis1", "axis2"], plan.row_key)
                results["classes"] = classes
                results["profiles"] = factorial.top_profiles(factorial.class_profile(df.join(classes, plan.row_key), "class", names, numbers))
    for name, items in plan.scales.items():
        told = describe.cronbach(df, items).select(F.lit(name).alias("scale"), "*")
        results["scales"] = results["scales"].unionByName(told) if "scales" in results else told
    if plan.hypotheses and (tests is not None or terms is not None):
        declared = spark.createDataFrame([(i, h.get("text", ""), h.get("variable"), h.get("direction")) for i, h in enumerate(plan.hypotheses)], "id int, text string, variable string, direction int")
        empty_tests, empty_terms = spark.createDataFrame([], "variable string, p double"), spark.createDataFrame([], "variable string, term string, estimate double, p double")
        results["verdicts"] = hypotheses.verdicts(declared, tests if tests is not None else empty_tests, terms if terms is not None else empty_terms, plan.alpha)
    return results


def facts(results: dict[str, DataFrame]) -> DataFrame:
    """section, key, value of every number in the result tables: a long, machine-readable form."""
    out = None
    for name, table in results.items():
        numbers = [c for c, k in table.dtypes if k in ("double", "bigint", "int", "float")]
        texts = [c for c, k in table.dtypes if k == "string"]
        if not numbers:
            continue
        label = F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("")) for c in texts]) if texts else F.lit("")
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in numbers]))
        part = table.select(F.lit(name).alias("section"), label.alias("label"), cells.alias("x")).select("section", F.concat_ws("/", F.nullif("label", F.lit("")), "x.c").alias("key"), F.col("x.v").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
