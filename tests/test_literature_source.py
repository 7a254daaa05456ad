import json

import pytest
from pyspark.sql import functions as F

from statloom.sources.literature import read_literature, write_index


def save(folder, name, *pages):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(p) if isinstance(p, dict) else p for p in pages))


def index(title, year, kind="article", **more):
    return {"title": title, "publication_year": year, "type": kind, **more}


@pytest.fixture
def folder(tmp_path):
    full = index("On <i>a</i> &amp;lt; b", 2021, doi="https://doi.org/10.1/X", cited_by_count=7, open_access={"is_oa": True}, abstract_inverted_index={"we": [0, 3], "see": [1], "what": [2]}, authorships=[{"author": {"display_name": "Ada Oz"}}, {"author": None}], primary_location={"source": {"display_name": "J"}})
    save(tmp_path, "index/year=2021/a.json", {"results": [full, index("Second", 2021, "book")]}, {"results": []}, {"meta": {}})
    save(tmp_path, "index/year=2019/a.json", {"results": [index("Third", 2019)]})
    save(tmp_path, "index/year=__HIVE_DEFAULT_PARTITION__/a.json", {"results": [{"display_name": "No year", "type": None}]})
    save(tmp_path, "registry/year=2020/a.json", {"message": {"items": [{"DOI": "10.2/y", "title": ["Fourth"], "issued": {"date-parts": [[None]]}, "published-online": {"date-parts": [[2020, 5]]}, "author": [{"family": "Oz", "given": "Ada"}, {"name": "A group"}]}]}})
    return tmp_path


def titles(df):
    return sorted(r["title"] for r in df.collect())


def test_fields_and_missing_ones(spark, folder):
    works = {r["title"]: r for r in read_literature(spark, str(folder)).collect()}
    full = works["On  a  &lt; b"]
    assert (full["doi"], full["year"], full["citations"], full["abstract"], full["authors"], full["journal"], full["open_access"]) == ("10.1/X", 2021, 7, "we see what we", ["Ada Oz"], "J", True)
    assert works["No year"]["year"] is None and works["No year"]["citations"] == 0 and works["Third"]["authors"] == []
    assert len(works) == 4 and {r["service"] for r in works.values()} == {"index"}


def test_pages_of_other_years_are_not_opened(spark, folder):
    save(folder, "index/year=2018/broken.json", "{no json")
    read = lambda **more: read_literature(spark, str(folder), **more)
    assert titles(read(first_year=2020, kinds=["book", "report"])) == ["Second"] and titles(read(first_year=2019, last_year=2020)) == ["Third"]
    assert read(first_year=2020).rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="broken.json is no JSON"):
        read().collect()


def test_uses_of_one_frame_keep_their_filters(spark, folder):
    works = read_literature(spark, str(folder))
    assert titles(works.where("year = 2019").union(works.where("year = 2021 and kind = 'book'"))) == ["Second", "Third"]
    assert works.count() == 4


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda folder: read_literature(spark, str(folder), push=True)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_reach_the_source_where_the_session_says_so(pushing, folder):
    save(folder, "index/year=2018/broken.json", "{no json")
    recent = pushing(folder).where("year >= 2020 and kind = 'book'")
    assert "Filter (" not in recent._jdf.queryExecution().toString().split("== Physical Plan ==")[1]  # the scan has taken all of them
    assert "Filter (" in pushing(folder).where("journal = 'J'")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert titles(recent) == ["Second"] and titles(pushing(folder).where("year in (2019, 2021) and year < 2020")) == ["Third"]
    assert titles(pushing(folder).where("year > 2018 and length(title) = 5")) == ["Third"]


def test_pushed_nulls_and_contradictions(pushing, folder):
    assert titles(pushing(folder).where("year is null")) == ["No year"] and titles(pushing(folder).where("kind is null")) == ["No year"]
    assert titles(pushing(folder).where("year = 2021 and year = 2019")) == []
    assert titles(pushing(folder).where("not year = 2019")) == ["On  a  &lt; b", "Second"]


def test_nulls_and_contradictions(spark, folder):
    works = read_literature(spark, str(folder))
    assert titles(works.where("year is null")) == ["No year"]
    assert titles(works.where("year = 2021 and year = 2019")) == [] and titles(works.where("kind is null")) == ["No year"]
    assert titles(works.where("not year = 2019")) == ["On  a  &lt; b", "Second"]


def test_chosen_columns(spark, folder):
    works = read_literature(spark, str(folder), ["title", "year"])
    assert works.columns == ["title", "year"] and works.where("year = 2019").collect()[0]["title"] == "Third"
    with pytest.raises(Exception, match="no such columns"):
        read_literature(spark, str(folder), ["colour"])


def test_registry_where_there_is_no_index(spark, folder, tmp_path_factory):
    (folder / "index").rename(folder / "away")
    row = read_literature(spark, str(folder)).where("year between 2020 and 2020").collect()[0]
    assert (row["doi"], row["title"], row["year"], row["authors"], row["service"]) == ("10.2/y", "Fourth", 2020, ["Ada Oz"], "registry")
    with pytest.raises(Exception, match="no pages"):
        read_literature(spark, str(tmp_path_factory.mktemp("none"))).collect()


def test_written_pages_come_back(spark, tmp_path):
    works = spark.range(500).select(F.concat(F.lit("10.3/"), "id").alias("doi"), F.concat(F.lit("Ti\ntle é "), "id").alias("title"), (2000 + F.col("id") % 7).cast("int").alias("year"), "id", F.when(F.col("id") % 2 == 0, "book").alias("kind")).withColumnRenamed("id", "citations")
    write_index(works, str(tmp_path))
    back = read_literature(spark, str(tmp_path), works.columns)
    key = lambda r: r["citations"]
    assert sorted(back.collect(), key=key) == [r for r in works.orderBy("citations").collect()]
    write_index(works.limit(0), str(tmp_path))
    assert read_literature(spark, str(tmp_path)).count() == 0
