"""Text search queries over the documents, the benchmark's first words and the parts' names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placespark.functions import analysis
from placespark.functions.text import fold_marks, looks_like_address, normal_text, street_form, suggestion_form, tokens, with_ordinals_swapped
from placespark.intermediate import written
from placespark.operators import clauses, search
from placespark.plans.fixtures import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TOK = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
POST = f"""WITH w AS (SELECT p_partkey AS doc, {TOK.format('p_name')} AS ws FROM part), o AS (SELECT doc, len(ws) AS field_length, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM w),
x AS (SELECT token, doc, count(*) AS tf, any_value(field_length) AS field_length FROM o GROUP BY 1, 2), l AS (SELECT count(*) AS docs, avg(len(ws)) AS average FROM w WHERE len(ws) > 0), st AS (SELECT token, count(*) AS df FROM x GROUP BY 1),
q0 AS (SELECT DISTINCT substr(p_name, 1, 9) AS query FROM part), q1 AS (SELECT query, {TOK.format('query')} AS ws FROM q0), q AS (SELECT query, len(ws) AS n, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM q1)"""
BM25 = "ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * field_length / average))"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("osm_id"), F.col("p_name").alias("name"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.substring("name", 1, 9)
    return search.query_tokens(parts(spark, sf_dir).select(q.alias("query")).distinct().withColumn("q", F.col("query")))


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index = search.postings(parts(spark, sf_dir), ["name"])
    return index, search.corpus_statistics(index)


@query(f"""WITH w AS (SELECT doc_id, {TOK.format('text')} AS ws FROM documents), o AS (SELECT doc_id, unnest(ws) AS token FROM w) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS n FROM o GROUP BY 1""")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return rows.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("n"))


@query(POST + f" SELECT query, doc, round(sum({BM25}), 5) AS score FROM q JOIN x USING (token) JOIN st USING (token), l GROUP BY query, doc")
def bm25_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match(asked(spark, sf_dir), *indexed(spark, sf_dir)).select("query", "doc", F.round("score", 5).alias("score"))


@query(POST + " SELECT query, doc FROM q JOIN x USING (token) GROUP BY query, doc, n HAVING count(*) = n")
def match_all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match(asked(spark, sf_dir), *indexed(spark, sf_dir), every=True).select("query", "doc")


@query(POST + ", s AS (SELECT query, n, doc, o.pos - q.pos AS start, count(DISTINCT q.pos) AS got FROM q JOIN o USING (token) GROUP BY ALL) SELECT DISTINCT query, doc FROM s WHERE got = n")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrases(asked(spark, sf_dir), indexed(spark, sf_dir)[0]).select("query", "doc")


@query(POST + ", j AS (SELECT query, n, q.pos, doc, o.pos - q.pos AS start FROM q JOIN o ON CASE WHEN q.pos = n - 1 THEN starts_with(o.token, q.token) ELSE o.token = q.token END) SELECT DISTINCT query, doc FROM (SELECT query, n, doc, start, count(DISTINCT pos) AS got FROM j GROUP BY ALL) WHERE got = n")
def phrase_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrases(asked(spark, sf_dir), indexed(spark, sf_dir)[0], last_is_prefix=True).select("query", "doc")


@query(POST + ", e AS (SELECT DISTINCT token FROM q), v AS (SELECT e.token AS asked, st.token, damerau_levenshtein(e.token, st.token) AS edits FROM e, st WHERE left(e.token, 1) = left(st.token, 1)) SELECT DISTINCT asked, token, edits FROM v WHERE edits <= CASE WHEN length(asked) < 3 THEN 0 WHEN length(asked) < 6 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY asked ORDER BY edits, token) <= 30")
def fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_tokens(asked(spark, sf_dir), indexed(spark, sf_dir)[1]).select("asked", "token", "edits").distinct()


@query(f"""WITH w AS (SELECT p_partkey AS doc, 'name' AS field, {TOK.format('p_name')} AS ws FROM part UNION ALL SELECT p_partkey, 'name_en', {TOK.format('p_brand')} FROM part UNION ALL SELECT p_partkey, 'tags_text', {TOK.format('p_type')} FROM part),
o AS (SELECT doc, field, len(ws) AS field_length, unnest(ws) AS token FROM w), x AS (SELECT field, token, doc, count(*) AS tf, any_value(field_length) AS field_length FROM o GROUP BY 1, 2, 3),
l AS (SELECT field, count(*) AS docs, avg(len(ws)) AS average FROM w WHERE len(ws) > 0 GROUP BY 1), df AS (SELECT field, token, count(*) AS df FROM x GROUP BY 1, 2), bl AS (SELECT token, max(df) AS df FROM df GROUP BY 1),
q0 AS (SELECT DISTINCT concat_ws(' ', substr(p_name, 1, 9), p_brand) AS query FROM part), q1 AS (SELECT query, {TOK.format('query')} AS ws FROM q0), q AS (SELECT DISTINCT query, len(ws) AS n, unnest(ws) AS token FROM q1),
b AS (SELECT query, doc, token, n, max({BM25}) AS score FROM q JOIN x USING (token) JOIN bl USING (token) JOIN l USING (field) GROUP BY ALL),
s AS (SELECT query, doc, round(sum(score), 5) AS score FROM b GROUP BY query, doc, n HAVING count(*) >= greatest(floor(n * 0.75), 1))
SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def cross_field_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("osm_id"), F.col("p_name").alias("name"), F.col("p_type").alias("tags_text"), F.col("p_brand").alias("name_en"))
    fields = ["name", "name_en", "tags_text"]
    kept, members = search.without_copies(docs, fields)
    index = written(search.postings(kept, fields, "doc"))
    q = kept.select(F.concat_ws(" ", F.substring("name", 1, 9), "name_en").alias("query")).distinct().withColumn("q", F.col("query"))
    scores = search.cross_fields(search.query_tokens(q), index, search.corpus_statistics(index, kept))
    return search.top_members(search.top(scores.withColumn("score", F.round("score", 5)), 10), members, 10)


@query()
def forward_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name, shortened, looked up among all places."""
    places = table(spark, sf_dir, "places").withColumns({"name_en": F.lower("name"), "tags_text": F.col("category_value"), "addr_housenumber": F.regexp_extract("osm_id", r"(\d+)", 1)})
    index = written(search.postings(places, ["name", "name_en", "tags_text"]))
    queries = table(spark, sf_dir, "points").select(F.col("p_id").cast("string").alias("query"), F.concat(F.lit("Customer#"), F.lpad(F.col("p_id").cast("string"), 9, "0")).alias("q"), F.col("p_lat").alias("bias_lat"), F.col("p_lon").alias("bias_lon"), F.col("p_id").cast("string").alias("asked_number"))
    found = search.forward_geocode(queries, places.select("osm_id", "lat", "lon", "offline_rank", "popularity", "addr_housenumber"), index, search.corpus_statistics(index))
    return found.select("query", "doc", "final", "rank", "confidence")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) AS cosine FROM v a, v b WHERE a.vec_id % 20 = 0)
SELECT query, doc, cosine, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""")
def vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.vector_candidates(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q_vector")), v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector")), 20)


@query("""WITH r AS (SELECT o_custkey % 100 AS query, o_orderkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, 0 AS list FROM orders UNION ALL
SELECT o_custkey % 100, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS INTEGER), 1 FROM orders), b AS (SELECT query, doc, min((rank, list)) AS slot FROM r WHERE rank <= 20 GROUP BY 1, 2)
SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY slot, doc) AS INTEGER) AS place FROM b QUALIFY place <= 10""")
def interleaved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("query"), F.col("o_orderkey").alias("doc"), F.col("o_totalprice").alias("score"))
    return search.interleaved(search.top(o, 20), search.top(o.withColumn("score", -F.col("doc")), 20), 10)


@query("SELECT c_custkey, c_name AS norm, lower(trim(regexp_replace(c_name, '[^\\p{L}\\p{N}\\s]+', ' ', 'g'))) AS suggestion, lower(c_name) AS street, FALSE AS is_address, CAST(NULL AS VARCHAR) AS swapped FROM customer")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", normal_text(name).alias("norm"), suggestion_form(name).alias("suggestion"), street_form(name).alias("street"), looks_like_address(name).alias("is_address"), with_ordinals_swapped(name).alias("swapped"))


STREETS = "شارع|طريق|حارة|حاره|ميدان|زقاق|street|road|avenue|ave|ش|st|rd"


@query(f"""SELECT doc_id, md5(strip_accents(text)) AS folded, md5(regexp_replace(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '^(?:{STREETS}) (.)', '\\1')) AS street, CAST(len({TOK.format('text')}) AS BIGINT) AS n_tokens FROM documents""")
def text_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of whole texts in four languages."""
    text = F.coalesce("text", F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold_marks(text)).alias("folded"), F.md5(street_form(text)).alias("street"), F.size(tokens(text)).cast("bigint").alias("n_tokens"))


def _map(table: dict[str, tuple[str, ...]]) -> str:
    return f"MAP {{{', '.join(f"'{k}': {list(v)}" for k, v in sorted(table.items()))}}}"


MARKS = {".": "\ue000", ":": "\ue001", "·": "\ue002", ",": "\ue003", ";": "\ue004"}


def stream_sql(source: str, chain: analysis.Chain) -> str:
    """DuckDB list of (pos, tokens) for each row of source (id, text): joining signs become private letters, so that words are what stands between others."""
    clean = f"translate(coalesce(text, ''), '{analysis.TATWEEL}{analysis.HARAKAT}''’ʼ', '')"
    for inside, signs in (("\\p{L}", ".:·"), ("\\p{Nd}", ".,;")):
        for sign in signs:
            left = "[\\p{L}\\p{M}]" if inside == "\\p{L}" else inside
            for _ in range(2):
                clean = f"regexp_replace({clean}, '({left})[{sign}]({inside})', '\\1{MARKS[sign]}\\2', 'g')"
    words = f"regexp_extract_all(regexp_replace({clean}, '([\\p{{Han}}\\p{{Hiragana}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}_{''.join(MARKS.values())}]+')"
    words = f"list_filter({words}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{Nd}}\\p{{Nl}}]'))"
    words = f"flatten(list_transform({words}, lambda w: regexp_extract_all(w, '.{{1,255}}')))"
    word = f"translate(translate(lower(w), '{''.join(MARKS.values())}', '{''.join(MARKS)}'), 'إأآىة', 'ااايه')"
    some = f"coalesce({_map(chain.alternatives())}[{word}], [{word}])" if chain.synonyms else f"[{word}]"
    fold = "replace(replace(replace(replace(replace(translate(strip_accents(v), 'øđðłħıŧ', 'oddlhit'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), 'ĳ', 'ij')"
    some = f"list_transform({some}, lambda v: {fold})"
    if chain.grams:
        some = f"flatten(list_transform({some}, lambda v: list_transform(list_filter(range(2, 16), lambda k: k <= length(v)), lambda k: substring(v, 1, k))))"
    return f"SELECT id, list_transform({words}, lambda w: list_sort(list_distinct({some}))) AS stream FROM {source}"


ANALYSED = " UNION ALL ".join(
    f"SELECT id AS doc_id, '{name}' AS chain, CAST(len(stream) AS BIGINT) AS positions, CAST(coalesce(list_sum(list_transform(stream, lambda s: len(s))), 0) AS BIGINT) AS tokens, md5(array_to_string(list_transform(stream, lambda s: array_to_string(s, '|')), ' ')) AS digest FROM ({stream_sql('(SELECT doc_id AS id, text FROM documents)', chain)})"
    for name, chain in analysis.CHAINS.items() if name != "address_search"
)


@query(ANALYSED)
def analysed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts read by three analyser chains."""
    docs = table(spark, sf_dir, "documents").repartition("doc_id")
    streams = [docs.select("doc_id", F.lit(name).alias("chain"), analysis.stream(F.col("text"), chain).alias("s")) for name, chain in analysis.CHAINS.items() if name != "address_search"]
    tokens = F.aggregate("s", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x))
    digest = F.md5(F.array_join(F.transform("s", lambda x: F.array_join(x, "|")), " "))
    return reduce(DataFrame.unionByName, streams).select("doc_id", "chain", F.size("s").cast("bigint").alias("positions"), tokens.alias("tokens"), digest.alias("digest"))


@query(f"""WITH d AS ({stream_sql("(SELECT p_partkey AS id, concat_ws(' ', p_name, CASE p_partkey % 4 WHEN 0 THEN 'St.' WHEN 1 THEN 'street' WHEN 2 THEN 'bd' ELSE 'Boulevard' END) AS text FROM part)", analysis.STANDARD)}),
o AS (SELECT id AS doc, len(stream) AS field_length, unnest(stream) AS alts FROM d), x AS (SELECT token, doc, count(*) AS tf, any_value(field_length) AS field_length FROM (SELECT doc, field_length, unnest(alts) AS token FROM o) GROUP BY 1, 2),
l AS (SELECT count(*) AS docs, avg(len(stream)) AS average FROM d WHERE len(stream) > 0), st AS (SELECT token, count(*) AS df FROM x GROUP BY 1),
q1 AS ({stream_sql("(SELECT DISTINCT concat(split_part(p_name, ' ', 1), CASE p_partkey % 2 WHEN 0 THEN ' Str' ELSE ' blvd' END, CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'x st' END) AS id, concat(split_part(p_name, ' ', 1), CASE p_partkey % 2 WHEN 0 THEN ' Str' ELSE ' blvd' END, CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'x st' END) AS text FROM part)", analysis.STANDARD)}),
q2 AS (SELECT id AS query, len(stream) AS n, unnest(stream) AS alts, unnest(range(len(stream))) AS pos FROM q1), q AS (SELECT query, n, pos, unnest(alts) AS token FROM q2),
c AS (SELECT query, pos, max(df) AS df FROM q JOIN st USING (token) GROUP BY 1, 2), h AS (SELECT query, pos, n, doc, sum(tf) AS tf, any_value(field_length) AS field_length FROM q JOIN x USING (token) GROUP BY 1, 2, 3, 4),
s AS (SELECT query, doc, n, count(*) AS matched, round(sum({BM25}), 5) AS score FROM h JOIN c USING (query, pos), l GROUP BY 1, 2, 3) SELECT query, doc, score FROM s WHERE matched = n""")
def synonym_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' first words with one street word, among names that end with another: all positions match by any of their alternatives."""
    part, of = table(spark, sf_dir, "part"), lambda *words: F.get(F.array(*map(F.lit, words)), F.col("p_partkey").cast("int") % len(words))
    docs = part.select(F.col("p_partkey").alias("osm_id"), F.concat_ws(" ", "p_name", of("St.", "street", "bd", "Boulevard")).alias("name"))
    index = written(search.postings(docs, ["name"], chains={"name": analysis.STANDARD}))
    text = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), of(" Str", " blvd"), of("", "x st", "x st"))
    queries = part.select(text.alias("query")).distinct().withColumn("q", F.col("query"))
    found = search.match_alternatives(search.query_tokens(queries, chain=analysis.STANDARD), index, search.corpus_statistics(index), every=True)
    return found.select("query", "doc", F.round("score", 5).alias("score"))


def _sloppy_sql(slop: int) -> str:
    text = "concat_ws(' ', p_name, p_type, p_brand)"
    return f"""WITH w AS (SELECT p_partkey AS doc, {TOK.format(text)} AS ws FROM part), o AS (SELECT doc, unnest(ws) AS token, unnest(range(len(ws))) AS at FROM w),
q0 AS (SELECT DISTINCT [ws[2], ws[3], ws[1]] AS three FROM w WHERE len(ws) >= 3 UNION SELECT DISTINCT [ws[1], ws[3], ws[2]] FROM w WHERE len(ws) >= 3), j AS (
SELECT array_to_string(three, ' ') AS query, a.doc, greatest(a.at, b.at - 1, c.at - 2) - least(a.at, b.at - 1, c.at - 2) AS distance FROM q0 JOIN o a ON a.token = three[1] JOIN o b ON b.token = three[2] AND b.doc = a.doc JOIN o c ON c.token = three[3] AND c.doc = a.doc
WHERE a.at <> b.at AND b.at <> c.at AND a.at <> c.at) SELECT query, doc, CAST(min(distance) AS INTEGER) AS distance FROM j WHERE distance <= {slop} GROUP BY 1, 2"""


def _sloppy(spark: SparkSession, sf_dir: str, slop: int) -> DataFrame:
    """The second, third and first word of parts' texts, and the first, third and second, as phrases of some slop."""
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("osm_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    kept, members = search.without_copies(docs, ["name"])
    w = tokens(F.col("name"))
    three = kept.select(w.alias("w")).where("size(w) >= 3").select(F.explode(F.array(*[F.array(*[F.get("w", F.lit(i)) for i in places]) for places in ((1, 2, 0), (0, 2, 1))])).alias("t"))
    queries = three.select(F.array_join("t", " ").alias("query")).distinct().withColumn("q", F.col("query"))
    found = search.sloppy_phrases(search.query_tokens(queries), written(search.postings(kept, ["name"], "doc")), slop)
    return written(found).join(members, "doc").select("query", F.col("member").alias("doc"), "distance")


@query(_sloppy_sql(2))
def sloppy_phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sloppy(spark, sf_dir, 2)


@query(_sloppy_sql(3))
def sloppier_phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sloppy(spark, sf_dir, 3)


TREE_SQL = f"""WITH w AS (SELECT p_partkey AS doc, 'name' AS field, {TOK.format('p_name')} AS ws FROM part UNION ALL SELECT p_partkey, 'name_en', {TOK.format('p_brand')} FROM part UNION ALL SELECT p_partkey, 'tags_text', {TOK.format('p_type')} FROM part),
o AS (SELECT doc, field, len(ws) AS field_length, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM w), x AS (SELECT field, token, doc, count(*) AS tf, any_value(field_length) AS field_length FROM o GROUP BY 1, 2, 3),
l AS (SELECT field, count(*) AS docs, avg(len(ws)) AS average FROM w WHERE len(ws) > 0 GROUP BY 1), df AS (SELECT field, token, count(*) AS df FROM x GROUP BY 1, 2), imp AS (SELECT field, token, doc, {BM25} AS impact FROM x JOIN df USING (field, token) JOIN l USING (field)),
q0 AS (SELECT DISTINCT concat_ws(' ', substr(p_name, 1, 14), p_brand) AS query, substr(p_name, 1, 14) AS own, p_brand AS want FROM part),
t AS (SELECT query, want, 0 AS clause, unnest({TOK.format('query')}) AS token FROM q0 UNION ALL SELECT query, want, 1, unnest({TOK.format('own')}) FROM q0), q AS (SELECT query, want, clause, token, count(*) AS times FROM t GROUP BY ALL),
f AS (SELECT query, want, clause, doc, field, sum(impact * times * CASE field WHEN 'name' THEN 4 WHEN 'name_en' THEN 2 ELSE 1 END) AS s FROM q JOIN imp USING (token) WHERE clause = 0 OR field = 'name' GROUP BY ALL),
c AS (SELECT query, want, clause, doc, max(s) AS s FROM f GROUP BY ALL), p AS (SELECT query, unnest({TOK.format('own')}) AS token, unnest(range(len({TOK.format('own')}))) AS pos, len({TOK.format('own')}) AS n FROM q0),
ph AS (SELECT DISTINCT query, doc FROM (SELECT query, n, doc, o.pos - p.pos AS start, count(DISTINCT p.pos) AS got FROM p JOIN o ON o.token = p.token AND o.field = 'name' GROUP BY ALL) WHERE got = n),
s AS (SELECT c.query, c.doc, round(sum(c.s) + max(CASE WHEN ph.doc IS NOT NULL THEN 10 ELSE 0 END), 6) AS score FROM c JOIN part ON p_partkey = c.doc AND p_brand = c.want LEFT JOIN ph ON ph.query = c.query AND ph.doc = c.doc GROUP BY 1, 2 HAVING max(clause) = 1)
SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""


@query(TREE_SQL)
def clause_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names' beginnings with a brand: words over three fields, words of the name required, the name's phrase, only of that brand."""
    part = table(spark, sf_dir, "part")
    docs = part.select(F.col("p_partkey").alias("osm_id"), F.col("p_name").alias("name"), F.col("p_type").alias("tags_text"), F.col("p_brand").alias("name_en"), F.col("p_brand").alias("brand"))
    fields = ["name", "name_en", "tags_text"]
    kept, members = search.without_copies(docs, [*fields, "brand"])
    index = written(search.postings(kept, fields, "doc").unionByName(clauses.exact_postings(kept, ["brand"], "doc")))
    queries = kept.select(F.concat_ws(" ", F.substring("name", 1, 14), "brand").alias("query"), F.substring("name", 1, 14).alias("own"), F.col("brand").alias("want")).distinct()
    own = search.query_tokens(queries, "own")
    tree = clauses.Tree(
        [clauses.Words(search.query_tokens(queries, "query"), {"name": 4.0, "name_en": 2.0, "tags_text": 1.0}), clauses.Words(own, {"name": 4.0}, required=True), clauses.Words(clauses.exact_word(queries, "want"), {"brand": 0.0}, required=True)],
        [clauses.Phrase(own, ("name",), 10.0)],
    )
    best = clauses.best(tree, clauses.impact_index(index, search.corpus_statistics(index, kept)), 10)
    return search.top_members(best, members, 10)


@query(f"""WITH w AS (SELECT doc_id AS doc, {TOK.format('text')} AS ws FROM documents), o AS (SELECT doc, len(ws) AS field_length, unnest(ws) AS token FROM w), x AS (SELECT token, doc, count(*) AS tf, any_value(field_length) AS field_length FROM o GROUP BY 1, 2),
l AS (SELECT count(*) AS docs, avg(len(ws)) AS average FROM w WHERE len(ws) > 0), df AS (SELECT token, count(*) AS df FROM x GROUP BY 1), q AS (SELECT item_id AS query, token, count(*) AS times FROM (SELECT item_id, unnest({TOK.format('text')}) AS token FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query, doc, round(sum({BM25} * times), 6) AS score FROM q JOIN x USING (token) JOIN df USING (token), l GROUP BY 1, 2) SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""")
def best_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's best documents by its words, common ones among them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("osm_id"), "text")
    asked = search.query_tokens(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), "text")
    return search.best_by_scan(asked, docs, "text", 20)
