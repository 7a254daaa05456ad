"""Bibliographic records and short texts: parsing, keys, deduplication, ranking, extraction, themes."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import STOP_WORDS, initials, inverted_text, sentences, short_citation, shorten, strip_tags, title_key

SHORTEST_TITLE = 8
KEPT = 30
SEED = 42
#: Cue words of the parts of an abstract.
OBJECTIVE = r"(?i)\b(aim|objective|purpose|goal|we (study|investigate|examine))"
METHOD = r"(?i)\b(method|sample|survey|data (were|was|are)|regression|model|trial|interview)"
RESULT = r"(?i)\b(result|found|find|show|significant|associated|increase|decrease)"
LIMITS = r"(?i)\b(limit|caution|bias|generali[sz]e|further research)"


def dedupe(works: DataFrame, order: str) -> DataFrame:
    """The first record of each DOI, then the first of each title key; short keys and null titles go. `order` ranks arrival.

    Records meet by the SHA-256 of their DOI or key, and each task sends no more than its first record of each, so a text
    is shuffled at most once as a value and a key that many records share makes no task large. Records without a DOI only
    meet by title. Of records that arrive alike one stays; a null order arrives first.
    """
    doi = F.nullif(F.lower(F.trim("doi")), F.lit(""))
    place = F.struct(F.col(order).isNotNull(), F.col(order))  # never null, as min_by leaves out nulls
    record = F.struct(*[F.col(f"`{c}`") for c in works.columns])

    def first(rows: DataFrame, key: Column) -> DataFrame:
        return rows.groupBy(F.sha2(key, 256).alias("_key")).agg(F.min_by(record, place).alias("_record")).select("_record.*")

    once = works.where(doi.isNull()).unionByName(first(works.where(doi.isNotNull()), doi))
    key = title_key(F.col("title"))
    return first(once.where(F.length(key) >= SHORTEST_TITLE), key)


def score(relevance: Column, citations: Column, age: Column, has_abstract: Column) -> Column:
    """Relevance 60 %, citations a year 30 % (on a log scale, at most 1), an abstract 10 %."""
    per_year = F.log1p(citations.cast("double") / F.greatest(F.lit(1.0), age.cast("double")))
    return 0.6 * relevance + 0.3 * F.least(per_year / 4.0, F.lit(1.0)) + 0.1 * has_abstract.cast("double")


def rank(works: DataFrame, value: Column, key: str, keep: int = KEPT) -> DataFrame:
    return works.withColumn("score", value).orderBy(F.desc("score"), key).limit(keep)


def parse_index_records(payload: DataFrame, column: str = "value") -> DataFrame:
    """Records of a JSON page with results[] and inverted abstracts."""
    author = "array<struct<author:struct<display_name:string>>>"
    kind = f"struct<results:array<struct<doi:string,title:string,publication_year:int,authorships:{author},primary_location:struct<source:struct<display_name:string>>,cited_by_count:int,abstract_inverted_index:map<string,array<int>>,open_access:struct<is_oa:boolean>,type:string,biblio:struct<volume:string,issue:string,first_page:string,last_page:string>>>>"
    rows = payload.select(F.explode(F.from_json(column, kind)["results"]).alias("r"))
    return rows.select(
        F.regexp_replace("r.doi", "^https?://doi.org/", "").alias("doi"), strip_tags(F.col("r.title")).alias("title"), F.col("r.publication_year").alias("year"),
        F.transform("r.authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("r.primary_location.source.display_name").alias("journal"),
        F.coalesce("r.cited_by_count", F.lit(0)).alias("citations"), inverted_text(F.col("r.abstract_inverted_index")).alias("abstract"), F.col("r.open_access.is_oa").alias("open_access"),
    )


def parse_registry_records(payload: DataFrame, column: str = "value") -> DataFrame:
    """Records of a JSON page with message.items[]; the year is the first of three dates that is there."""
    date = "struct<`date-parts`:array<array<int>>>"
    kind = f"struct<message:struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<family:string,given:string>>,issued:{date},published:{date},created:{date},`container-title`:array<string>,`is-referenced-by-count`:int,abstract:string>>>>"
    rows = payload.select(F.explode(F.from_json(column, kind)["message"]["items"]).alias("r"))
    year = F.coalesce(*[F.get(F.get(F.col(f"r.{c}.date-parts"), F.lit(0)), F.lit(0)) for c in ("issued", "published", "created")])
    return rows.select(
        F.lower("r.DOI").alias("doi"), strip_tags(F.get("r.title", F.lit(0))).alias("title"), year.alias("year"),
        F.transform("r.author", lambda a: F.concat_ws(" ", a["given"], a["family"])).alias("authors"), F.get(F.col("r.container-title"), F.lit(0)).alias("journal"),
        F.coalesce(F.col("r.is-referenced-by-count"), F.lit(0)).alias("citations"), strip_tags(F.col("r.abstract")).alias("abstract"), F.lit(None).cast("boolean").alias("open_access"),
    )


def surnames(authors: Column) -> Column:
    return F.transform(authors, lambda a: F.element_at(F.split(F.trim(a), r"\s+"), -1))


def with_citations(works: DataFrame) -> DataFrame:
    """works with citation and an APA-like reference."""
    given = lambda a: F.array_join(F.slice(F.split(F.trim(a), r"\s+"), 1, F.greatest(F.lit(0), F.size(F.split(F.trim(a), r"\s+")) - 1)), " ")
    names = F.transform("authors", lambda a: F.concat_ws(", ", F.element_at(F.split(F.trim(a), r"\s+"), -1), F.nullif(initials(given(a)), F.lit(""))))
    listed = F.when(F.size(names) > 1, F.concat(F.array_join(F.slice(names, 1, F.size(names) - 1), ", "), F.lit(", & "), F.element_at(names, -1))).when(F.size(names) == 1, names[0]).otherwise("Anonymous")
    text = F.concat_ws(" ", listed, F.concat(F.lit("("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit(").")), F.concat("title", F.lit(".")), F.concat("journal", F.lit(".")), F.concat(F.lit("https://doi.org/"), F.nullif("doi", F.lit(""))))
    return works.withColumn("citation", short_citation(surnames(F.col("authors")), F.col("year"))).withColumn("reference", text)


def extract_parts(works: DataFrame, text: str) -> DataFrame:
    """works with objective (first cue, else the first sentence), method (first), result (last) and limits (first)."""
    s = F.col("_sentences")
    hit = lambda cue: F.filter(s, lambda x: x.rlike(cue))
    first, last = lambda a: F.get(a, F.lit(0)), lambda a: F.get(a, F.size(a) - 1)
    out = works.withColumn("_sentences", sentences(F.col(text)))
    return out.select("*", shorten(F.coalesce(first(hit(OBJECTIVE)), first(s))).alias("objective"), shorten(first(hit(METHOD))).alias("method"), shorten(F.when(F.size(hit(RESULT)) > 0, last(hit(RESULT)))).alias("result"), shorten(first(hit(LIMITS))).alias("limits")).drop("_sentences")


def query_words(keywords: Column) -> Column:
    """A search text without e-mail addresses, long numbers and punctuation, words once, at most 300 characters."""
    out = F.regexp_replace(keywords, r"\S+@\S+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\d{5,}", " "), r"[^\p{L}\p{N}\s-]", " ")
    return F.substring(F.array_join(F.array_distinct(F.filter(F.split(out, r"\s+"), lambda w: w != "")), " "), 1, 300)


def themes(works: DataFrame, key: str, title: str, text: str, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """key and theme of each record, and the four strongest terms of each theme: TF-IDF of words and pairs, then k-means.

    The title counts twice; fewer than six records are one theme.
    """
    n = works.count()
    if n < 6:
        return works.select(key, F.lit(0).alias("theme")), works.sparkSession.createDataFrame([], "theme int, rank int, term string, weight double")
    k = k or max(2, min(5, n // 6))
    rows = works.select(key, F.concat_ws(" ", title, title, text).alias("_text"))
    rows = RegexTokenizer(inputCol="_text", outputCol="_all", pattern=r"\p{L}{3,}", gaps=False).transform(rows)
    rows = StopWordsRemover(inputCol="_all", outputCol="_words", stopWords=list(STOP_WORDS)).transform(rows)
    rows = NGram(n=2, inputCol="_words", outputCol="_pairs").transform(rows).withColumn("_terms", F.concat("_words", "_pairs"))
    counts = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=3000, maxDF=0.8).fit(rows)
    tf = counts.transform(rows)
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(tf).transform(tf)
    unit = Normalizer(inputCol="_idf", outputCol="features").transform(weighted).select(key, "features")
    model = KMeans(k=k, seed=SEED, initSteps=5).fit(unit)
    top = [(t, r + 1, counts.vocabulary[i], float(c[i])) for t, c in enumerate(model.clusterCenters()) for r, i in enumerate(c.argsort()[::-1][:4])]
    return model.transform(unit).select(key, F.col("prediction").alias("theme")), works.sparkSession.createDataFrame(top, "theme int, rank int, term string, weight double")
