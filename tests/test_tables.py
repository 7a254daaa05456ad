import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from statloom.functions import text
from statloom.operators import bivariate, catalog, cleaning, guards, hypotheses, literature, privacy
from statloom.plans.engine import AnalysisPlan, facts, run
from statloom.sources import tables
from statloom.sources.simulated import survey
from statloom.streaming import stateful


def test_delimited_with_decimal_commas(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a;b 2;c\n" + "\n".join(f"{k};{k},5;x{k}" for k in range(5)) + "\nNA;;\n", encoding="utf-8")
    df = tables.read_table(spark, str(path))
    assert df.columns == ["a", "b_2", "c"] and dict(df.dtypes)["b_2"] == "double" and df.count() == 5
    assert tables.sniff("a\tb\n1\t2")[0] == "\t" and tables.sniff("a,b\n1,2") == (",", False)
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.exe")


def test_names_levels_and_guards(spark):
    assert cleaning.clean_names(["a b", "a b", "1x", "é!", ""]) == ["a_b", "a_b_2", "v_1x", "é", "column"]
    assert cleaning.reference_level({"yes": 9, "no": 1}, "binary") == "no" and cleaning.reference_level({"b": 2, "a": 2}, "nominal") == "a"
    assert cleaning.event_level(["no", "yes"]) == "yes" and cleaning.event_level(["a", "b"], "a") == "a"
    cells = ["=HYPERLINK(1)", "@SUM", "-3,5", "12,5 %", "plain", None, "|x"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(cleaning.formula_guard(F.col("c"))).collect()]
    assert got == ["'=HYPERLINK(1)", "'@SUM", "-3,5", "12,5 %", "plain", None, "'|x"]


def test_pseudonyms_equal_hmac(spark):
    for key in (b"k", b"long" * 40):
        got = spark.createDataFrame([("é",), (None,)], "v string").select(privacy.pseudonym(F.col("v"), key).alias("p")).collect()
        assert got[0]["p"] == "P" + hmac.new(key, "é".encode(), hashlib.sha256).hexdigest()[:10] and got[1]["p"] is None
    df = tables.encrypt(spark.createDataFrame([("secret",)], "v string"), "v", b"0" * 16, "p1")
    assert tables.decrypt(df, "v", b"0" * 16, "p1").first()["v"] == "secret"


def test_text_guards(spark):
    docs = spark.createDataFrame([(1, "We found 12.3 % of 1 250 cases (Noël, 2020) and 7 more in 2019."), (2, "It was 99.9, says Smith et al. (2001).")], "id int, t string")
    quoted = guards.quoted_numbers(docs, "id", "t")
    allowed = spark.createDataFrame([(12.34,), (1250.0,), (2020.0,), (2019.0,)], "fact double")
    bad = {(r["id"], r["value"]) for r in guards.unsupported_numbers(quoted, allowed, "id").collect()}
    assert bad == {(2, 99.9), (2, 2001.0)}
    known = spark.createDataFrame([("noel", 2020)], "name string, year int")
    assert [(r["id"], r["name"]) for r in guards.unknown_citations(docs, "id", "t", known).collect()] == [(2, "Smith")]
    terms = spark.createDataFrame([("odds ratio",), ("ratio test",)], "term string")
    found = guards.glossary_terms(spark.createDataFrame([(1, "An Odds-Ratio, that is.")], "id int, t string"), "id", "t", terms).collect()
    assert [r["term"] for r in found] == ["odds ratio"]


def test_bibliography(spark):
    page = '{"results":[{"doi":"https://doi.org/10.1/a","title":"A <i>title</i> here","publication_year":2020,"authorships":[{"author":{"display_name":"Ann B Smith"}},{"author":{"display_name":"Jo Roe"}}],"primary_location":{"source":{"display_name":"J"}},"cited_by_count":3,"abstract_inverted_index":{"two":[1],"one":[0,2]},"open_access":{"is_oa":true}}]}'
    works = literature.with_citations(literature.parse_index_records(spark.createDataFrame([(page,)], "value string"))).first()
    assert works["abstract"] == "one two one" and works["citation"] == "Smith and Roe (2020)" and works["reference"].startswith("Smith, A. B., & Roe, J. (2020). A title here.")
    items = '{"message":{"items":[{"DOI":"10.2/B","title":["Second title"],"author":[{"family":"Li","given":"X"}],"published":{"date-parts":[[2018,2]]},"container-title":["K"],"is-referenced-by-count":1}]}}'
    other = literature.parse_registry_records(spark.createDataFrame([(items,)], "value string")).first()
    assert (other["doi"], other["year"], other["authors"]) == ("10.2/b", 2018, ["X Li"])
    twice = spark.createDataFrame([(1, "10.1/a", "Some longer title"), (2, None, "some LONGER title!"), (3, "10.1/A", "Another title"), (4, "", "short")], "id int, doi string, title string")
    assert [r["id"] for r in literature.dedupe(twice, "id").collect()] == [1]


def test_text_columns(spark):
    df = spark.createDataFrame([("Été. The aim is to test this properly. Results show an increase in many things! Ok.",)], "t string")
    r = literature.extract_parts(df, "t").first()
    assert r["objective"].startswith("The aim") and r["result"].startswith("Results show") and r["limits"] is None
    assert df.select(text.title_key(F.lit("Été: à l'eau")).alias("k")).first()["k"] == "ete a l eau"
    assert df.select(text.within_budget(F.array(F.lit("aa"), F.lit("bb"), F.lit("c")), 5).alias("k")).first()["k"] == "aa bb"
    assert df.select(text.clean_markdown(F.lit("# T\n\n\n\n- **a** b\r\n  c ")).alias("k")).first()["k"] == "a b\nc"


def test_hypotheses(spark):
    h = spark.createDataFrame([(1, "Education increases use of contraception"), (2, "weather decides")], "id int, text string")
    v = spark.createDataFrame([("edu", "Education level"), ("age", "Age in years")], "variable string, label string")
    declared = hypotheses.guess(h, v).select("id", "variable", "direction")
    tests = spark.createDataFrame([("edu", 0.001)], "variable string, p double")
    terms = spark.createDataFrame([("edu", "edu[high]", -0.5, 0.01)], "variable string, term string, estimate double, p double")
    got = {r["id"]: r["verdict"] for r in hypotheses.verdicts(declared, tests, terms).collect()}
    assert got == {1: "contradicted", 2: "not verifiable"}


def test_engine(spark):
    df = survey(spark, 40, 20)
    plan = AnalysisPlan.from_json('{"outcome": "outcome", "explanatory": ["x", "group", "z"], "duration": "time", "event": "event", "cluster": "cluster", "unknown": 1, "analyses": ["audit", "describe", "bivariate", "model", "survival"], "kinds": {"x": "continuous", "z": "binary"}, "hypotheses": [{"text": "x raises", "variable": "x", "direction": 1}]}')
    out = run(df, plan)
    assert AnalysisPlan.from_json(plan.to_json()) == plan
    tests = {r["variable"]: r for r in out["tests"].collect()}
    assert tests["x"]["p_bh"] < 0.001 and tests["group"]["test"] == "chi-square"
    assert out["verdicts"].first()["verdict"] == "confirmed"
    levels = {r["group"]: r["count"] for r in df.groupBy("group").count().collect()}
    reference, terms = min(levels, key=lambda g: (-levels[g], g)), {r["term"] for r in out["coefficients"].collect()}
    assert out["survival"].count() > 100 and terms == {"x", *(f"group_{g}_" for g in levels if g != reference), "(intercept)"} | {t for t in terms if t.startswith("z")}
    assert out["log_rank"].first()["variable"] == "group" and out["cox"].where("term = 'x'").first()["coef"] == pytest.approx(0.5, abs=0.2)
    assert out["proportional_hazards"].where("p < 0 or p > 1").count() == 0
    told = {r["measure"]: r["value"] for r in out["diagnostics"].collect()}
    assert told["auc"] > 0.6 and told["vif x"] < 1.2 and told["hosmer_lemeshow"] >= 0 and told["events_per_parameter"] > 50
    assert out["cases"].first()["warning"] is None
    assert facts({"coefficients": out["coefficients"]}).count() == out["coefficients"].count() * 6


def test_engine_pairs_and_axes(spark):
    df = survey(spark, 30, 20).withColumn("size", F.when(F.col("x") < -0.5, "low").when(F.col("x") < 0.5, "mid").otherwise("top")).withColumn("yes", F.when(F.col("outcome") == 1, "yes").otherwise("no"))
    plan = AnalysisPlan(outcome="score", explanatory=("size",), analyses=("bivariate", "factorial"), kinds={"size": "ordinal", "yes": "binary", "group": "nominal", "score": "continuous"}, orders={"size": ["low", "mid", "top"]}, row_key="id", scales={"both": ["x", "score"]})
    out = run(df, plan)
    pairs = out["post_hoc"].collect()
    assert {(r["a"], r["b"]) for r in pairs} == {("low", "mid"), ("low", "top"), ("mid", "top")} and all(r["test"] in ("Dunn", "Games-Howell", "Tukey-Kramer") and r["p"] < 0.05 for r in pairs)
    assert out["mca"].count() >= 2 and out["classes"].count() == df.count() and out["profiles"].count() > 0 and out["scales"].count() == 3
    ordered = run(df, AnalysisPlan(outcome="yes", explanatory=("size",), analyses=("bivariate",), kinds=plan.kinds, orders=plan.orders))["tests"].first()
    assert ordered["test"] == "Somers" and ordered["effect"] > 0.1 and ordered["p_bh"] < 0.001


def test_streams(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))

    def result(make, name, mode="append"):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.sql(f"SELECT * FROM {name}")

    limited = result(lambda s: stateful.rate_limit(s, "user_id", "ts", 86400, 2), "limited", "update").collect()
    assert len(limited) == events.count()
    by = {}
    for r in sorted(limited, key=lambda r: r["ts_us"]):
        own = by.setdefault(r["key"], [])
        assert r["admitted"] == (sum(t >= r["ts_us"] - 86400 * 10**6 for t in own) < 2)
        if r["admitted"]:
            own.append(r["ts_us"])
    once = result(lambda s: stateful.first_seen(s, "user_id", "ts", "3650 days"), "once")
    assert once.count() == events.select("user_id").distinct().count()
    windows = result(lambda s: stateful.stream_window_counts(s, "user_id", "ts", "1 hour", "1 hour"), "windows")
    assert 0 < windows.count() <= events.count()
    sessions = result(lambda s: stateful.stream_sessions(s, "user_id", "ts"), "sessions")
    assert 0 < sessions.count() <= events.count()


def test_tables_out(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2.0)], "a string, b double")
    assert tables.write_tables({"t": df}, str(tmp_path / "o")).count() == 1
    assert spark.read.csv(str(tmp_path / "o" / "t"), header=True).first()["a"] == "'=1+1"
    tables.append_log(spark, str(tmp_path / "log"), "me", "did")
    tables.append_log(spark, str(tmp_path / "log"), "me", "did")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_identifiers_beyond_the_first_rows(spark):
    rows = [("x", None)] * 300 + [("a@b.org", "+33 6 12 34 56 78")] * 700
    df = spark.createDataFrame(rows, "v string, w string").coalesce(1)
    got = {r["variable"]: r for r in privacy.scan_identifiers(df).collect()}
    assert got["v"]["share_email"] == 0.7 and got["v"]["finding"] == "direct"
    assert got["w"]["share_phone"] == 1.0 and got["w"]["finding"] == "direct"
    assert privacy.scan_identifiers(df.select(F.lit(1).alias("n"))).count() == 0


def test_shared_openings_stay_apart(spark, tmp_path):
    from statloom.plans.queries import QUERIES

    opening = "All rights reserved. " * 5
    rows = [(1, opening + "one"), (2, opening + "two"), (3, opening + "One!")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in QUERIES["text_dedupe"](spark, str(tmp_path)).collect()) == [1, 2]


def test_tokens_of_whole_texts(spark, tmp_path):
    from statloom.plans.queries import QUERIES

    spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(500)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["text_token_sets"](spark, str(tmp_path)).first()["n"] == 500


def test_null_words_are_few(spark):
    texts = ["none", "Missing", "-", "?", "null", "NA", " na ", "N/A", "NaN", ".", "", "NSP", "n/a"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(cleaning.null_words(F.col("t"))).collect()]
    assert got == ["none", "Missing", "-", "?", "null", *[None] * 7, "n/a"]
    assert cleaning.clean_names(["a-b c", "1x", "a-b c"]) == ["a-b_c", "v_1x", "a-b_c_2"]


def test_network_keys(spark):
    import ipaddress

    def plain(a):
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return a[:64]
        if ip.version == 4 or ip.ipv4_mapped:
            return str(ip if ip.version == 4 else ip.ipv4_mapped)
        return str(ipaddress.ip_network(f"{ip}/64", strict=False))

    some = ["1.2.3.4", "2001:db8::1", "2001:0DB8:0:0:1::9", "::1", "::", "fe80::1:2:3:4", "2001:db8:1:2:3:4:5:6", "::ffff:10.0.0.1", "0:0:1:0::", "1::", "1:0:0:2::", "a:b", "not an address", "x" * 90, "1:2:3:4:5:6:7:8:9"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in some], "t string").select(privacy.network_key(F.col("t"))).collect()]
    want = [plain(a) for a in some]
    same = [g == w or ("/64" in g and ipaddress.ip_network(g, strict=False) == ipaddress.ip_network(w)) for g, w in zip(got, want, strict=True)]
    assert all(same), list(zip(some, got, want, same, strict=True))


def test_numbers_as_written(spark):
    cases = {
        "2 518 rows, 24,5 % to 54.4": [2518, 24.5, 54.4], "from 10-20 or -3,5": [10, 20, -3.5], "a1 b_2 3c 1e5": [], "1 234 5678": [1234, 5678],
        "2015 123": [2015, 123], "ends at 5.Next 7,": [5, 7], "(x, 2015)": [2015], "\u22124,25 and 1\u202f000,5": [-4.25, 1000.5], "": [], "well-known-3": [3],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.numbers(F.col("t")).alias("n"), text.decimals(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases
    assert {r["t"]: r["d"] for r in rows}["2 518 rows, 24,5 % to 54.4"] == [0, 1, 1]


def test_sessions_end_after_eight_hours(spark):
    day = "2024-01-01 "
    times = [f"{day}00:00:00", *[f"{day}{h:02d}:{m:02d}:00" for h in range(10) for m in (20, 40, 59)]]
    df = spark.createDataFrame([("a", t) for t in times] + [("b", f"{day}01:00:00"), ("b", f"{day}01:31:00"), ("b", f"{day}02:01:00"), (None, times[0])], "k string, ts string")
    got = {(r["k"], r["session"]): (r["end_us"] - r["start_us"], r["n"]) for r in stateful.limited_sessions(df, "k", "ts").collect()}
    assert got[("b", 1)] == (0, 1) and got[("b", 2)] == (30 * 60 * 10**6, 2)
    assert got[("a", 1)][0] == (7 * 60 + 59) * 60 * 10**6 and sum(n for (k, _), (_, n) in got.items() if k == "a") == len(times)


def test_symmetric_numbers_get_pearson(spark):
    rows = [(float(k - 50), float((k - 50) + (k % 2) - 0.5)) for k in range(101)]
    assert bivariate.compare_numbers(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()["test"] == "Pearson"
    few = spark.createDataFrame([(v, v * 2 + (i % 3) * 0.1) for i, v in enumerate([-1.6, -1.1, -0.8, -0.5, -0.3, -0.1, 0.1, 0.3, 0.5, 0.8, 1.1, 1.6])], "x double, y double")
    assert bivariate.compare_numbers(few, "x", "y").first()["test"] == "Pearson"


def test_number_checks_read_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    texts = ["It rose by 12.34 to 57, then 3.1", "In 2020 it was 1 250,5 or x77", "a1-5 and 12.3", None, "no number"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").mapInPandas(watched, "id long, t string")
    allowed = spark.createDataFrame([(12.341,), (57.4,), (1250.5,), (2021.0,)], "fact double")
    bad = guards.unsupported_numbers(guards.quoted_numbers(docs, "id", "t"), allowed, "id").collect()
    assert sorted((r["id"], r["value"], r["decimals"]) for r in bad) == [(0, 3.1, 1), (1, 2020.0, 0)]
    assert seen.value == len(texts)


def test_distinct_values_are_counted_without_widening_rows(spark):
    rows = [(i, float(i % 3) * (-1.0) ** i, f"n{i % 5}" if i % 2 else None, None, i % 7, [i]) for i in range(60)]
    df = spark.createDataFrame(rows, "`a.b` long, x double, s string, none string, k int, list array<int>")
    found = catalog.infer(df)
    assert [(r["variable"], r["n_valid"], r["n_missing"], r["n_unique"]) for r in found.collect()] == [("a.b", 60, 0, 60), ("x", 60, 0, 5), ("s", 30, 30, 5), ("none", 0, 60, 0), ("k", 60, 0, 7)]
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert catalog.infer(df.limit(0)).where("n_unique = 0 and kind = 'nominal'").count() == 5
