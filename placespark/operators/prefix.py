"""Suggestions: a prefix index (the best places of every prefix, globally and by geohash), kept up as places change, and for queries
that it can't answer for sure the whole corpus, by words and their beginnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.functions.analysis import STANDARD, WHOLE_WORDS, WORDS_AND_GRAMS
from placespark.functions.category import nameable, with_type_query
from placespark.functions.geo import gauss_decay, geohash, haversine_m
from placespark.functions.text import normal_text, prefixes, suggestion_form
from placespark.intermediate import written
from placespark.operators import clauses, search
from placespark.operators.nearby import log1p10

#: Places indexed, suggestions of a prefix, prefix lengths, most boost and popularity, articles left out.
PLACES = 100_000
TOP_K = 30
SHORTEST, LONGEST = 2, 6
BOOST = (0.1, 10.0)
MOST_POPULARITY = 1000.0
ARTICLES = "^(?:the|el|al|la|le|les|ال) "
#: Fixed values of the corpus search: weights of fields by beginnings of words, of names by words in order (the last begun, or all
#: whole), of rank and popularity, and of the two decays with their scale and offset in metres.
BEGUN = {"name": 5.0, "name_en": 5.0, "name_fr": 5.0, "addr_street": 3.0, "addr_city": 2.0, "full_address": 2.0}
PHRASE_BEGUN, PHRASE_WHOLE = 8.0, 10.0
RANK, POPULARITY = 2.0, 1.5
DECAYS = [(25.0, 300_000.0, 50_000.0), (3.0, 15_000.0, 2_000.0)]
TYPE = "category_text"


def index_score(rank: Column, popularity: Column) -> Column:
    return F.coalesce(rank, F.lit(0.0)) * 10 + F.log1p(F.coalesce(popularity, F.lit(0.0))) * 5


def prominent(places: DataFrame, n: int = PLACES) -> DataFrame:
    """The n places of highest rank, then popularity, then least id."""
    return places.orderBy(F.desc("offline_rank"), F.desc("popularity"), "osm_id").limit(n)


def _entries(places: DataFrame) -> DataFrame:
    """(osm_id, score, prefix, scope): every prefix of every place, globally and in its geohash."""
    forms = F.array_distinct(F.filter(F.array(*[suggestion_form(F.col(c)) for c in ("name", "name_en", "name_fr") if c in places.columns]), lambda s: s != ""))
    rows = places.select("osm_id", index_score(F.col("offline_rank"), F.col("popularity")).alias("score"), geohash(F.col("lat"), F.col("lon")).alias("cell"), F.explode(prefixes(forms, SHORTEST, LONGEST)).alias("prefix"))
    return rows.select("osm_id", "score", "prefix", F.explode(F.array_distinct(F.filter(F.array(F.lit("global"), F.col("cell")), lambda c: c.isNotNull()))).alias("scope"))


def build_prefix_index(places: DataFrame, n: int | None = PLACES, k: int = TOP_K) -> DataFrame:
    """(scope, prefix, osm_id, score, rank): the k best places of each prefix, in scope 'global' and in their geohash; of
    the n most prominent places, or of all (None)."""
    rows = _entries(places if n is None else prominent(places, n))
    order = Window.partitionBy("scope", "prefix").orderBy(F.desc("score"), "osm_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _longest(rows: DataFrame, depth: int, whole: Column) -> DataFrame:
    """rows' best `depth` of each prefix with rank and whole: whether a list that was whole until now still holds all."""
    group = Window.partitionBy("scope", "prefix")
    ranked = rows.withColumn("whole", whole).withColumn("rank", F.row_number().over(group.orderBy(F.desc("score"), "osm_id"))).where(F.col("rank") <= depth + 1)
    ranked = ranked.withColumn("whole", F.col("whole") & (F.max("rank").over(group) <= depth)).where(F.col("rank") <= depth)
    return ranked.select("scope", "prefix", "osm_id", "score", "rank", "whole")


def build_kept_index(places: DataFrame, k: int = TOP_K, runners: int = TOP_K) -> DataFrame:
    """The prefix index of the places with `runners` more of each prefix, to be kept up: (scope, prefix, osm_id, score, rank, whole)."""
    return _longest(_entries(places), k + runners, F.lit(True))


def served(index: DataFrame, k: int = TOP_K) -> DataFrame:
    """What a kept index serves: the prefix index itself."""
    return index.where(F.col("rank") <= k).drop("whole")


def refresh_index(index: DataFrame, places: DataFrame, changed: DataFrame, k: int = TOP_K, runners: int = TOP_K) -> DataFrame:
    """A kept index after places changed: what build_kept_index would serve, from the changed places' prefixes only.

    places are all places as they are now; changed (osm_id) are those that came, went or differ. Lists of other prefixes stay. In a list
    that leaves places out, those can't be better than its last one was, so new entries count only down to there, and runners-up move
    up. Only where less than k remain are a prefix's places looked up again, in all places. Ids in changed that are nowhere, and
    repeated ones, change nothing.
    """
    ids = changed.select("osm_id").where("osm_id IS NOT NULL").distinct()
    key = ["scope", "prefix"]
    new = written(_entries(places.join(ids, "osm_id", "left_semi")))
    touched = written(index.join(ids, "osm_id", "left_semi").select(key).unionByName(new.select(key)).distinct())
    old = index.join(touched, key, "left_semi")
    until = old.groupBy(key).agg(F.max(F.struct(-F.col("score"), F.col("osm_id"))).alias("last"), F.first("whole").alias("was_whole"))
    rows = old.join(ids, "osm_id", "left_anti").select(*key, "osm_id", "score").unionByName(new.select(*key, "osm_id", "score")).join(until, key, "left")
    rows = rows.withColumn("was_whole", F.coalesce("was_whole", F.lit(True))).where(F.col("was_whole") | (F.struct(-F.col("score"), F.col("osm_id")) <= F.col("last")))
    moved = written(_longest(rows, k + runners, F.col("was_whole")))
    left = moved.groupBy(key).agg(F.count("*").alias("left"))
    short = written(until.where(~F.col("was_whole")).join(left, key, "left").where(F.coalesce("left", F.lit(0)) < k).select(key))
    again = _longest(_entries(places).join(short, key, "left_semi"), k + runners, F.lit(True))
    return index.join(touched, key, "left_anti").unionByName(moved.join(short, key, "left_anti")).unionByName(again)


def match_tier(form: Column, name: Column) -> Column:
    """1 the whole name, 0.8 its beginning, 0.6 the beginning of its first word after an article, 0.4 of any word, else 0."""
    name = suggestion_form(name)
    bare = F.regexp_replace(name, ARTICLES, "")
    words = F.split(name, " ")
    return F.when((name == form) | (bare == form), 1.0).when(F.startswith(name, form) | F.startswith(bare, form), 0.8).when(F.startswith(F.get(F.split(bare, " "), F.lit(0)), form), 0.6).when(F.exists(words, lambda w: F.startswith(w, form)), 0.4).otherwise(0.0)


def suggestion_label(name: Column, city: Column) -> Column:
    """Name and city, unless the name holds it."""
    return F.when(city.isNull() | (city == "") | F.contains(name, city), name).otherwise(F.concat_ws(", ", name, city))


def suggest(queries: DataFrame, index: DataFrame, places: DataFrame, limit: int = 10) -> DataFrame:
    """For each query (query, q, optional bias point) the best places of its prefix: tier, score, rank, geo_local, confident.

    The bucket is the prefix of at most LONGEST letters, globally and in the bias point's geohash; places that match by
    no tier go. confident says that the bucket was full and the best tier at least 0.8.
    """
    asked = queries.withColumn("form", suggestion_form(F.col("q"))).where(F.length("form") >= SHORTEST)
    asked = asked.withColumn("prefix", F.rtrim(F.substring("form", 1, LONGEST)))
    cell = F.when(F.col("bias_lat").isNotNull(), geohash(F.col("bias_lat"), F.col("bias_lon")))
    scoped = asked.withColumn("scope", F.explode(F.filter(F.array(F.lit("global"), cell), lambda s: s.isNotNull())))
    found = scoped.join(index.select("scope", "prefix", "osm_id"), ["scope", "prefix"])
    found = found.groupBy("query", "form", "bias_lat", "bias_lon", "osm_id").agg(F.max((F.col("scope") != "global").cast("int")).alias("local"))
    rows = found.join(places, "osm_id")
    names = [c for c in ("name", "name_en", "name_fr") if c in places.columns]
    tier = F.greatest(F.lit(0.0), *[F.coalesce(match_tier(F.col("form"), F.col(c)), F.lit(0.0)) for c in names])
    away = haversine_m(F.col("bias_lat"), F.col("bias_lon"), F.col("lat"), F.col("lon"))
    score = F.round(100 * F.col("tier") + 3 * F.col("offline_rank") + 2 * F.log1p("popularity") + 15 * gauss_decay(away, 15_000.0, 2_000.0, missing=0.0), 6)
    rows = rows.withColumn("tier", tier).where("tier > 0").withColumn("score", score)
    whole = Window.partitionBy("query")
    rows = rows.withColumn("confident", (F.count("*").over(whole) >= limit) & (F.max("tier").over(whole) >= 0.8))
    ranked = rows.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("score"), "osm_id"))).where(F.col("rank") <= limit)
    return ranked.select("query", "osm_id", "tier", "score", "rank", (F.col("local") == 1).alias("geo_local"), "confident")


def with_popularity(places: DataFrame, feedback: DataFrame) -> DataFrame:
    """places with the boosts of feedback (osm_id, boost) added: each within BOOST, the sum up to MOST_POPULARITY."""
    boosts = feedback.groupBy("osm_id").agg(F.sum(F.least(F.greatest("boost", F.lit(BOOST[0])), F.lit(BOOST[1]))).alias("boosts"))
    grown = F.least(F.col("popularity") + F.coalesce("boosts", F.lit(0.0)), F.lit(MOST_POPULARITY))
    return places.join(boosts, "osm_id", "left").withColumn("popularity", grown).drop("boosts")


def _worth() -> Column:
    return 1 + RANK * F.coalesce("offline_rank", F.lit(0.0)) + POPULARITY * log1p10(F.coalesce("popularity", F.lit(0.0)))


def corpus_index(places: DataFrame, block: int = clauses.BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks of words and their beginnings in the places' names, addresses and types, ordered by the most that they can count for.

    A place's factor is at most its worth with both decays at their greatest, so this doesn't depend on where a query is asked.
    """
    fields = [f for f in (*BEGUN, TYPE) if f in places.columns]
    index = written(search.postings(places, fields, chains=dict.fromkeys(fields, WORDS_AND_GRAMS)))
    ceilings = places.select(F.col("osm_id").alias("doc"), (_worth() + sum(w for w, _, _ in DECAYS)).alias("ceiling"))
    return clauses.impact_index(index, search.corpus_statistics(index), block, ceilings)


def _begun_phrases(asked: DataFrame) -> DataFrame:
    """(query, token, pos, n) of queries: whole words, and the last one's beginning, which a whole word has too."""
    whole, begun = search.query_tokens(asked, "norm", WHOLE_WORDS), search.query_tokens(asked, "norm", STANDARD)
    last = F.col("pos") == F.col("n") - 1
    return whole.where(~last).unionByName(begun.where(last).unionByName(whole.where(last & (F.length("token") > 16) | last & (F.length("token") == 2))))


def suggest_from_corpus(queries: DataFrame, impacts: tuple[DataFrame, DataFrame], places: DataFrame, limit: int = 10) -> DataFrame:
    """(query, osm_id, score, rank, confidence): the best of all places for each query (query, q, optional bias_lat, bias_lon).

    A place scores the sum of the query's beginnings of words in its best field, of its name's words in the query's order with the last
    one begun, and of those with all whole; times 1, its rank and popularity, and two decays by distance from the bias point, one for the
    region and one for the surroundings. A query that is a word for a type of place gets two lists, by name (without villages, roads and
    the like) and by type, interleaved. Beginnings have 2 to 15 characters; a last word of one or of over 15 characters must be whole.
    Queries without words get nothing; places without point are near everything, as far as a decay counts; ties go to the smaller id.
    """
    fields = [f for f in BEGUN if f in places.columns]
    names = [f for f in fields if f.startswith("name")]
    asked = with_type_query(queries).withColumn("norm", normal_text(F.col("q")))
    points = [F.col(c).alias(c) if c in queries.columns else F.lit(None).cast("double").alias(c) for c in ("bias_lat", "bias_lon")]
    asked = written(asked.select("query", "norm", "asks_type", *points))
    kinds = [F.col(c).alias(c) if c in places.columns else F.lit(None).cast("string").alias(c) for c in ("category_key", "category_value")]
    docs = places.select(F.col("osm_id").alias("doc"), "lat", "lon", _worth().alias("worth"), *kinds)
    away = haversine_m(F.col("bias_lat"), F.col("bias_lon"), F.col("lat"), F.col("lon"))
    near = sum(w * gauss_decay(away, scale, offset) for w, scale, offset in DECAYS)
    factor = F.col("worth") + F.when(F.col("bias_lat").isNull() | F.col("bias_lon").isNull(), 0.0).otherwise(near)
    begun = search.query_tokens(asked, "norm", STANDARD)
    by_name = clauses.Tree(
        [
            clauses.Words(begun, {f: BEGUN[f] for f in fields}), clauses.Words(_begun_phrases(asked), dict.fromkeys(names, PHRASE_BEGUN), ordered=True),
            clauses.Words(search.query_tokens(asked, "norm", WHOLE_WORDS), dict.fromkeys(names, PHRASE_WHOLE), ordered=True),
        ],
        minimum=1, condition=nameable(F.col("asks_type"), F.col("category_key"), F.col("category_value")), factor=factor,
    )
    lists = [clauses.best(by_name, impacts, limit, asked, docs)]
    if TYPE in places.columns:
        types = clauses.Tree([clauses.Words(search.query_tokens(asked.where("asks_type"), "norm", STANDARD), {TYPE: 1.0})], factor=factor)
        lists.append(clauses.best(types, impacts, limit, asked, docs))
    rows = written(reduce(DataFrame.unionByName, [r.withColumn("list", F.lit(i)) for i, r in enumerate(lists)]))
    placed = search.interleaved(rows.where("list = 0"), rows.where("list = 1"), limit)
    own = rows.groupBy("query", "doc").agg(F.min_by("score", F.struct("rank", "list")).alias("score"))
    most = rows.groupBy("query").agg(F.max("score").alias("most"))
    out = placed.join(own, ["query", "doc"]).join(most, "query")
    share = F.when(F.col("most") > 0, F.round(F.least(F.col("score") / F.col("most"), F.lit(1.0)), 4)).otherwise(0.0)
    return out.select("query", F.col("doc").alias("osm_id"), "score", F.col("place").alias("rank"), share.alias("confidence"))


def corpus_label(name: Column, name_en: Column, address: Column) -> Column:
    """The English name, or else the name, and the address if it says more."""
    name, address = F.coalesce(F.nullif(name_en, F.lit("")), name, F.lit("")), F.coalesce(address, F.lit(""))
    return F.when((address == "") | (address == name), name).when(name == "", address).otherwise(F.concat_ws(", ", name, address))


def suggest_with_fallback(queries: DataFrame, index: DataFrame, impacts: tuple[DataFrame, DataFrame], places: DataFrame, limit: int = 10) -> DataFrame:
    """(query, osm_id, score, rank, source): the prefix index where it is confident, for all other queries the corpus."""
    sure = written(suggest(queries, index, places, limit).where("confident").select("query", "osm_id", "score", "rank", F.lit("index").alias("source")))
    rest = suggest_from_corpus(queries.join(sure.select("query").distinct(), "query", "left_anti"), impacts, places, limit)
    return sure.unionByName(rest.select("query", "osm_id", "score", "rank", F.lit("corpus").alias("source")))
