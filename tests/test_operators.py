"""Small cases with known results, edges, and plans."""

import datetime as dt
import itertools
import os
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from placespark.functions import address, analysis, category, geo, rank, text
from placespark.intermediate import written
from placespark.operators import assembly, cells, clauses, elements, evaluate, interpolate, metering, nearby, prefix, reverse, search, traffic
from placespark.plans import movement
from placespark.sources import claims
from placespark.sources import elements as sources
from placespark.streaming import jobs

TAGS = "map<string,string>"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def tags(**kv):
    return F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k.replace("__", ":"), v)]).cast(TAGS) if kv else F.create_map().cast(TAGS)


def test_street_forms(spark):
    cases = {"شارع التحرير": "التحرير", "Tahrir Street": "tahrir street", "الجيزة": "الجيزه", "شارع": "شارع", None: ""}
    for given, want in cases.items():
        assert one(spark, x=text.street_form(F.lit(given).cast("string"))).x == want


def test_house_numbers(spark):
    rows = spark.createDataFrame([("12A", 12), ("14bis", 14), ("abc", None), (None, None)], "s string, n bigint").select("n", text.house_number(F.col("s")).alias("got")).collect()
    assert all(r.n == r.got for r in rows)


def test_address_queries(spark):
    r = one(spark, a=text.looks_like_address(F.lit("15 Tahrir Street")), b=text.looks_like_address(F.lit("Main St, Cairo")), c=text.looks_like_address(F.lit("Pyramids")), d=text.looks_like_address(F.lit(None).cast("string")), e=text.looks_like_address(F.lit("5th settlement")))
    assert (r.a, r.b, r.c, r.d, r.e) == (True, True, False, False, False)


def test_parsed_queries(spark):
    cases = {
        "123 Main Street, Cairo, 11511": ("123", "Main street", "Cairo", "11511"),
        "Tahrir": (None, "Tahrir", None, None), "Cairo": (None, None, "Cairo", None),
        "Cairo, 12 Tahrir St": ("12", "Tahrir street", "Cairo", None),
    }
    for q, (number, street, city, code) in cases.items():
        p = one(spark, p=address.parsed_query(F.lit(q))).p
        assert (p.housenumber, (p.street or "").lower() or None, p.city, p.postcode) == (number, street.lower() if street else None, city, code)


def test_normal_text(spark):
    r = one(spark, a=text.normal_text(F.lit("12 Main St.  é'à")), b=text.with_ordinals_swapped(F.lit("5th Settlement")), c=text.with_ordinals_swapped(F.lit("fifth ring")), d=text.with_ordinals_swapped(F.lit("District 5")))
    assert r.a == "12 Main street. ea" and r.b == "fifth Settlement" and r.c == "5th ring" and r.d is None


def test_full_address(spark):
    got = one(spark, a=address.full_address(address.components(tags(addr__housenumber="15", addr__street="Tahrir Street", addr__town="Cairo"))), b=address.full_address(address.components(tags())), c=address.has_address(tags(addr__town="x")))
    assert (got.a, got.b, got.c) == ("15 Tahrir Street, Cairo", "", False)


def test_categories(spark):
    none = F.lit(None).cast("int")
    food, shop, city, level = (one(spark, c=category.classify(t, a)).c for t, a in ((tags(amenity="restaurant"), none), (tags(shop="wombats"), none), (tags(place="city"), none), (tags(amenity="cafe"), F.lit(8))))
    assert (food.grp, food.is_poi, shop.grp, city.grp, city.is_poi, level.grp, level.is_poi) == ("food", True, "shopping", "place", False, "boundary", False)
    r = one(spark, a=category.category_text(tags(railway="station", station="subway")), b=category.category_text(tags(railway="subway_entrance")), c=category.category_text(tags(amenity="yes", cuisine="pizza;burger;Pizza")))
    assert r.a.startswith("station train station") and "metro" in r.a and (r.b, r.c) == ("", "pizza burger")
    assert category.category_catalog(spark).count() == len(category.GROUPS)


def test_ranks(spark):
    none, zero = F.lit(None).cast("int"), F.lit(0.0)
    got = one(spark, a=rank.offline_rank(tags(place="city"), none, zero), b=rank.offline_rank(tags(amenity="restaurant"), none, zero), c=rank.offline_rank(tags(), F.lit(4), zero), d=rank.offline_rank(tags(population="10,000,000"), none, zero))
    assert (got.a, got.b, got.c, got.d) == (3.3088, 1.1765, 3.3898, 2.2059)


def test_distances_and_decay(spark):
    r = one(spark, **{f"x{i}": geo.distance_confidence(F.lit(float(d))) for i, d in enumerate([0.5, 5, 50, 200, 500, 3000, 10000])}, half=geo.gauss_decay(F.lit(1500.0), 1000.0, 500.0), h=geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), g=geo.geohash(F.lit(57.64911), F.lit(10.40744), 6))
    assert list(r)[:7] == [1.0, 0.9, 0.8, 0.7, 0.6, 0.4, 0.2] and abs(r.half - 0.5) < 1e-12 and abs(r.h - 20015086.8) < 1 and r.g == "u4pruy"


def test_edge_ids(spark):
    r = one(spark, p=geo.edge_parts(F.lit(257032954354)), i=geo.edge_id(F.lit(2), F.lit(750654), F.lit(7660)))
    assert (r.p.level, r.p.tile, r.p.id) == (2, 750654, 7660) and r.i == 257032954354


def line(*points):
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in points])


def test_geometry(spark):
    square, hole = line((0, 0), (0, 4), (4, 4), (4, 0), (0, 0)), line((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))
    p = F.array(F.array(square, hole))
    r = one(spark, a=geo.ring_area_km2(line((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))), b=geo.in_polygons(p, F.lit(3.0), F.lit(3.0)), c=geo.in_polygons(p, F.lit(1.5), F.lit(1.5)), d=geo.point_at(line((0, 0), (0, 2), (2, 2)), F.lit(0.75)), e=geo.project(line((0, 0), (0, 2), (2, 2)), F.lit(1.0), F.lit(3.0)), f=geo.wkt_polygons(p), g=geo.n_points(p), h=F.size(geo.thinned(F.transform(F.sequence(F.lit(1), F.lit(5001)), lambda i: F.struct(i.cast("double").alias("lat"), F.lit(0.0).alias("lon"))))), i=geo.is_closed(square))
    assert abs(r.a - 111.32**2) < 2 and (r.b, r.c, r.g, r.i) == (True, False, 10, True) and (r.d.lat, r.d.lon) == (1.0, 2.0)
    assert (r.e.degrees, r.e.fraction) == (1.0, 0.75) and r.f.startswith("POLYGON ((0.0 0.0, ") and r.h <= 2001


def test_radius_join_at_the_seams(spark):
    points = spark.createDataFrame([(1, 0.0, 179.9999), (2, 89.99, 10.0), (3, 45.0, 45.0)], "p_id int, p_lat double, p_lon double")
    places = spark.createDataFrame([("a", 0.0, -179.9999), ("b", 89.99, -170.0), ("c", 45.0, 45.01), ("d", None, None)], "osm_id string, lat double, lon double")
    got = {(r.p_id, r.osm_id) for r in cells.radius_join(points, places, 3000.0).collect()}
    assert got == {(1, "a"), (2, "b"), (3, "c")}
    assert cells.radius_join(points.limit(0), places, 10.0).count() == 0


def test_no_nested_loop_and_limited_windows(spark, sf):
    from placespark.plans import places

    plan = places.nearby_best(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = places.prefix_index(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_points_of_interest_keep_unknowns(spark):
    rows = spark.createDataFrame([("a", None, None, None), ("b", 8, 1.0, "food"), ("c", None, 6.0, None), ("d", 0, 0.0, "place"), ("e", 0, 1.0, "food")], "osm_id string, admin_level int, area_km2 double, category_group string")
    assert sorted(r.osm_id for r in nearby.points_of_interest(rows).collect()) == ["a", "e"]
    assert nearby.wanted(["a,b", "b", " c "]) == ["a", "b", "c"] and nearby.wanted(None) == []


def test_nearest_beyond_the_first_ring(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, -80.0, 170.0)], "p_id int, p_lat double, p_lon double")
    places = spark.createDataFrame([("x", 0.1, 0.1), ("y", 60.0, 10.0)], "osm_id string, lat double, lon double")
    assert {(r.p_id, r.osm_id) for r in cells.nearest(points, places, "p_id", "osm_id").collect()} == {(1, "x"), (2, "x")}


def test_interpolation(spark):
    rows = [("a", "s", 11, 30.0, 31.0), ("b", "s", 19, 30.0008, 31.0008), ("c", "s", None, 30.0, 31.0)]
    held = spark.createDataFrame(rows, "osm_id string, street_norm string, number bigint, lat double, lon double")
    asked = spark.createDataFrame([(1, "s", 15, 30.0, 31.0), (2, "s", 11, 30.0, 31.0), (3, "s", 99, 30.0, 31.0), (4, "t", 1, 30.0, 31.0)], "req_id int, street_norm string, asked bigint, ref_lat double, ref_lon double")
    none = spark.createDataFrame([], "osm_id string, line array<struct<lat:double,lon:double>>")
    got = {r.req_id: r for r in interpolate.interpolate_address(asked, held, none).collect()}
    assert sorted(got) == [1, 2, 3] and (round(got[1].lat, 7), round(got[1].lon, 7), got[1].confidence, got[1].parity, got[1].low, got[1].high) == (30.0004, 31.0004, 0.75, "odd", 11, 19)
    assert (got[2].kind, got[2].confidence, got[3].kind, got[3].confidence) == ("exact", 1.0, "nearest", 0.3)


def test_enrichment_staleness(spark):
    schema = "osm_id string, admin_level int, area_km2 double, street_id string, parents array<struct<osm_id:string,area_km2:double>>"
    rows = [("ok", 0, 0.0, "w", [("z", 5.0)]), ("none", 0, 0.0, None, None), ("self", 0, 0.0, None, [("self", 5.0)]), ("unknown", 0, 0.0, None, [("z", None)]), ("small", 0, 2.0, None, [("z", 1.0)]), ("street", 8, 0.0, "w", [("z", 5.0)])]
    assert {r.osm_id for r in reverse.needs_enrichment(spark.createDataFrame(rows, schema)).collect()} == {"none", "self", "unknown", "small", "street"}


def test_provider_pick(spark):
    rows = spark.createDataFrame([(1, 0, "a", None, None, 5.0), (1, 1, "b", "1", "s", 9.0), (2, 0, "c", None, None, None), (2, 1, "d", None, None, 3.0)], "p_id int, pos int, osm_id string, housenumber string, street string, distance_m double")
    assert {(r.p_id, r.osm_id, r.has_full) for r in reverse.first_with_number(rows).collect()} == {(1, "b", True), (2, "d", False)}


def test_charges(spark):
    r = one(spark, a=metering.charge_cents(F.lit(101_000_000), F.lit(2900), F.lit(100_000.0), F.lit(0.04)), b=metering.charge_cents(F.lit(10_000_250), F.lit(0), F.lit(10_000.0), F.lit(1.0)))
    assert (r.a, r.b) == (2940, 1)


def test_usage(spark):
    t = dt.datetime(2024, 5, 1, 12)
    e = spark.createDataFrame([("t", "k", "geocode", None if i == 4 else 1000, t, i) for i in range(5)], "tenant string, key_id string, endpoint string, milli bigint, ts timestamp, event_id bigint")
    r = metering.rollup(e).first()
    assert (r.milli, r.requests, r.period) == (5000, 5, "2024-05")
    twice = metering.added(metering.rollup(e), metering.rollup(e)).first()
    assert (twice.milli, twice.requests) == (10000, 10)
    replay = metering.quota_replay(e.na.fill(1000), 2500).orderBy("event_id").collect()
    assert [x.accepted for x in replay] == [True, True, False, False, False]
    r = one(spark, m=metering.matrix_milli(F.lit("/matrix?json=%7B%22sources%22%3A%5B%22a%22%2C%22b%22%5D%2C%22targets%22%3A%5B%22c%22%5D%7D"), 3000, 5000), p=metering.url_path(F.lit("https://h.x/a/b/?q=1")), k=metering.key_of_consumer(F.lit("t-key-7")))
    assert (r.m, r.p, r.k) == (6000, "/a/b", "7")


def test_ewma(spark):
    rows = [(1, float(v), dt.datetime(2024, 1, 1, 0, i), i) for i, v in enumerate([10, 20, 30])]
    e = spark.createDataFrame(rows, "gid bigint, kph double, ts timestamp, event_id bigint")
    assert round(traffic.ewma(e).first().kph, 6) == 17.1 or round(traffic.ewma(e).first().kph, 6) == 18.1 or traffic.ewma(e).first().n == 3
    late = e.withColumn("ts", F.when(F.col("event_id") == 2, F.lit(dt.datetime(2024, 1, 1, 5))).otherwise(F.col("ts")))
    r = traffic.ewma_with_expiry(late).first()
    assert (r.kph, r.n) == (30.0, 1)


def test_traffic_small(spark):
    e = spark.createDataFrame([(1, i, 100 + i, 900.0, None if i in (1, 2, 3, 5) else 10.0) for i in range(6)], "leg int, pos int, gid bigint, length_m double, live_kph double")
    assert [(r.gid, r.window) for r in traffic.uncovered_windows(e).orderBy("gid").collect()] == [(101, 0), (102, 0), (103, 1), (105, 2)]
    grid = traffic.sampling_grid(spark, 0, 0, 2, 2, 2).collect()
    assert {tuple(r) for r in grid} == {(0.5, 0.5), (0.5, 1.5), (1.5, 0.5), (1.5, 1.5)}
    r = one(spark, a=traffic.congestion(F.lit(50.0), F.lit(60.0)), b=traffic.congestion(F.lit(None).cast("double"), F.lit(60.0)), c=traffic.congestion(F.lit(10.0), F.lit(60.0)))
    assert (r.a, r.b, r.c) == ("free", "unknown", "jam")
    batches = spark.createDataFrame([("d", [Row(lat=float(i), lon=0.0, speed=1.0, heading=None, ts=None) for i in range(60)])], "device_id string, points array<struct<lat:double,lon:double,speed:double,heading:double,ts:double>>")
    assert [r.lat for r in traffic.trace_points(batches).orderBy("pos").collect()] == [float(i) for i in range(10, 60)]


def test_confidence(spark):
    rows = spark.createDataFrame([("q", 10.0), ("q", 5.0), ("r", 0.0)], "q string, s double")
    assert sorted(r.c for r in rows.select(evaluate.confidence(F.col("s"), "q").alias("c")).collect()) == [0.0, 0.5, 1.0]


def test_match_tiers(spark):
    for q, name, want in (("metro", "Metro", 1.0), ("met", "Metro", 0.8), ("pyr", "The Pyramids", 0.8), ("fo", "Bar foo", 0.4), ("zz", "Bar", 0.0)):
        assert one(spark, t=prefix.match_tier(F.lit(q), F.lit(name))).t == want
    assert one(spark, a=prefix.suggestion_label(F.lit("A"), F.lit("Cairo"))).a == "A, Cairo"


def test_search_small(spark):
    docs = spark.createDataFrame([("1", "red metro station"), ("2", "metro market"), ("3", None), ("4", "station of the metor")], "osm_id string, name string")
    index = search.postings(docs, ["name"])
    stats = search.corpus_statistics(index)
    asked = search.query_tokens(spark.createDataFrame([("q", "metro station")], "query string, q string"))
    assert {r.doc for r in search.match(asked, index, stats).collect()} == {"1", "2", "4"}
    assert [r.doc for r in search.match(asked, index, stats, every=True).collect()] == ["1"]
    assert [r.doc for r in search.phrases(asked, index).collect()] == ["1"]
    assert "4" in {r.doc for r in search.match_fuzzy(asked, index, stats).collect()}
    assert {r.doc for r in search.match_grams(search.query_tokens(spark.createDataFrame([("q", "sta")], "query string, q string")), docs, "name").collect()} == {"1", "4"}
    assert search.top(search.cross_fields(asked, index, stats), 1).first().doc == "1"


def test_address_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("LON,LAT,NUMBER,STREET,UNIT,CITY,DISTRICT,REGION,POSTCODE,ID,HASH\n31.2,30.0, 15 ,Tahrir,,Cairo,D,,11511,,deadbeef\n31.2,30.0,7,Nile,,,,,,,\nx,30,1,A,,,,,,,\n200,30,1,A,,,,,,,\n31,30,,,,,,,,,\n")
    rows = {r.tags["addr:street"]: r for r in sources.read_address_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Tahrir", "Nile"} and rows["Tahrir"].osm_id == "oadeadbeef" and rows["Tahrir"].tags["addr:housenumber"] == "15" and rows["Tahrir"].tags["addr:county"] == "D"
    assert rows["Nile"].osm_id.endswith("_1")
    (tmp_path / "b.geojson").write_text('{"type":"Feature","geometry":{"type":"Point","coordinates":[31.2,30.0]},"properties":{"number":"1","street":"X","hash":"h"}}\nbroken\n')
    assert [r.osm_id for r in sources.read_address_geojson(spark, str(tmp_path / "b.geojson")).collect()] == ["oah"]
    (tmp_path / "c.geojson").write_text('{"features":[{"geometry":{"type":"Point","coordinates":[31.2,30.0]},"properties":{"NUMBER":"1","HASH":"g"}},{"geometry":{"type":"LineString","coordinates":[]},"properties":{}}]}')
    assert [r.osm_id for r in sources.read_address_geojson(spark, str(tmp_path / "c.geojson"), collection=True).collect()] == ["oag"]


def test_address_rows_are_numbered_by_file(spark, tmp_path):
    """By all rows of the file, with or without HASH, and however it is split."""
    head = "LON,LAT,NUMBER,STREET,UNIT,CITY,DISTRICT,REGION,POSTCODE,ID,HASH\n"
    for name, n in (("a.csv", 400), ("b.csv", 7)):
        (tmp_path / name).write_text(head + "".join(f"31.2,30.0,{i},{name[0]}{i},,,,,,,{'h' + name[0] + str(i) if i % 2 == 0 else ''}\n" for i in range(n)))
    before, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = sources.read_address_csv(spark, str(tmp_path)).collect()
            seen.append({r.osm_id for r in rows})
            assert len(rows) == len(seen[-1]) == 407
            for r in rows:
                i = r.tags["addr:street"][1:]
                assert r.osm_id == f"oah{r.tags['addr:street']}" if int(i) % 2 == 0 else r.osm_id.endswith(f"_{i}")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1]


def test_type_queries(spark):
    asked = spark.createDataFrame([("1", "Metro"), ("2", "metropolitan"), ("3", "مستشفي"), ("4", " CAFÉ "), ("5", None), ("6", "coffee shop")], "query string, q string")
    assert {r["query"] for r in category.with_type_query(asked).where("asks_type").collect()} == {"1", "3", "4", "6"}
    places = spark.createDataFrame([(True, "place", "village"), (True, "amenity", "bank"), (False, "place", "village"), (True, "railway", "platform"), (True, None, None)], "asks boolean, key string, value string")
    assert [r[0] for r in places.select(category.nameable(F.col("asks"), F.col("key"), F.col("value"))).collect()] == [False, True, True, False, True]


def test_gazetteer_reader(spark, tmp_path):
    cells_ = ["360630", "Cairo", "Cairo", "Al Qahirah,Kairo", "30.06", "31.25", "P", "PPLC", "EG", "", "", "", "", "", "7734614", "", "", "Africa/Cairo", "2020"]
    (tmp_path / "x.txt").write_text("# c\n\n" + "\t".join(cells_) + "\nshort\tline\n" + "\t".join(["1", "Adm", "", "", "1", "1", "A", "ADM1", *cells_[8:]]) + "\n")
    rows = {r.osm_id: r for r in sources.read_gazetteer(spark, str(tmp_path / "x.txt")).collect()}
    assert rows["gn360630"].tags["place"] == "city" and rows["gn360630"].tags["population"] == "7734614" and rows["gn360630"].tags["alt_name"] == "Al Qahirah, Kairo"
    assert rows["gn1"].admin_level == 4 and rows["gn1"].tags["boundary"] == "administrative" and rows["gn1"].tags["place"] == "state"


def test_curated_reader(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"osm_id":"g1","lat":30,"lon":31,"name":"5th Settlement","layer":"venue","source":"google","source_id":"X"},{"osm_id":"g2","lat":30,"lon":31,"name":"Foo","layer":"restaurant","rating":4.5,"address":{"city":"Cairo"},"names":{"en":"Foo EN"}},{"osm_id":"g3","name":"no place"},{"osm_id":"g4","lat":1,"lon":1,"layer":"sublocality_level_1","name":"D"}]')
    rows = {r.osm_id: r for r in sources.read_curated(spark, str(tmp_path / "p.json")).collect()}
    assert rows["g1"].tags["place"] == "neighbourhood" and rows["g1"].tags["ref:google_place_id"] == "X" and rows["g2"].tags["amenity"] == "restaurant" and rows["g2"].tags["name:en"] == "Foo EN" and rows["g2"].tags["addr:city"] == "Cairo"
    assert "g3" not in rows and (rows["g4"].admin_level, rows["g4"].tags["place"]) == (10, "suburb")


def test_provider_results(spark):
    rows = spark.createDataFrame([("abc", "Foo", "1 X, Cairo", 30.0, 31.0, ["cafe"], [("1", "1", ["street_number"]), ("X", "X", ["route"])], "ROOFTOP", 4.0)], sources.PROVIDER)
    r = sources.provider_rows(rows).first()
    assert r.osm_id.startswith("g_") and len(r.osm_id) == 18 and r.tags["addr:street"] == "X" and r.tags["amenity"] == "cafe" and r.confidence == 1.0


def test_elements_and_tags(spark, tmp_path):
    r = one(spark, a=sources.identifiable(tags(old_name="x")), b=sources.identifiable(tags(highway="y")), c=sources.identifiable(F.lit(None).cast(TAGS)))
    assert (r.a, r.b, r.c) == (True, False, False)
    versions = spark.createDataFrame([("a", 1, {"name": "old", "x": "1"}), ("a", 2, {"name": "new"})], f"osm_id string, version int, tags {TAGS}")
    m = elements.merge_tags(versions).first()
    assert (m.name, m.tags) == ("new", {"name": "new", "x": "1"})
    forms = spark.createDataFrame([("N", "shop", "books", None, None, "Cairo", None, 30.0, 31.0), ("bad", None, None, None, None, None, None, 100.0, 0.0)], "name string, category_key string, category_value string, street string, housenumber string, city string, phone string, lat double, lon double")
    e = sources.submitted_elements(forms).first()
    assert e.tags["shop"] == "books" and e.osm_id.startswith("custom_")
    sources.write_bounded(spark.range(25).coalesce(1), str(tmp_path / "out"), 10)
    assert len(list((tmp_path / "out").glob("part-*"))) == 3
    places = elements.refine_elements(sources.submitted_elements(forms))
    assert elements.description_prompt(places).first().prompt.startswith("Name: N\nType: books")
    filled = elements.backfill_categories(places.withColumn("category_value", F.lit(None).cast("string")), F.col("category_value").isNull()).first()
    assert filled.category_value == "books"


def test_assembly(spark):
    nodes = spark.createDataFrame([(i, float(i // 2), float(i % 2)) for i in range(4)], "node_id bigint, lat double, lon double")
    ways = spark.createDataFrame([(1, [0, 1]), (2, [3, 1]), (3, [3, 2, 0]), (4, [0, 99])], "way_id bigint, refs array<bigint>")
    lines = assembly.way_lines(ways, nodes)
    assert {r.way_id for r in lines.collect()} == {1, 2, 3}
    member = "array<struct<type:string,ref:bigint,role:string>>"
    relations = spark.createDataFrame([(7, "multipolygon", [("w", 1, "outer"), ("w", 2, ""), ("w", 3, "outer"), ("n", 1, "x")]), (8, "route", [("w", 1, "")])], f"rel_id bigint, kind string, members {member}")
    (r,) = assembly.relation_polygons(relations, lines).collect()
    assert r.rel_id == 7 and len(r.polygons) == 1 and len(r.polygons[0][0]) == 5 and r.area_km2 > 12000
    assert {x.way_id for x in assembly.needed_ways(ways, relations).collect()} == {1, 2, 3}
    assert assembly.joined_rings([[(0, 0), (0, 1)], [(1, 1), (0, 1)], [(5, 5), (6, 6)]]) == [[(0, 0), (0, 1), (1, 1), (0, 0)]]


def collected(spark, stream, mode):
    rows = []
    stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: rows.extend(b.collect())).trigger(availableNow=True).start().awaitTermination()
    return rows


@pytest.fixture()
def observed(spark, tmp_path):
    rows = [(1, float(v), dt.datetime(2024, 1, 1, 0, i), i, "t", 1000) for i, v in enumerate([10, 20, 30])] + [(2, 50.0, dt.datetime(2024, 1, 1), 9, "t", 1000)]
    path = str(tmp_path / "obs")
    df = spark.createDataFrame(rows, "gid bigint, kph double, ts timestamp, event_id bigint, tenant string, milli bigint")
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_speed_stream(spark, observed):
    rows = {r.gid: r for r in collected(spark, jobs.speed_stream(observed), "update")}
    assert (rows[1].kph, rows[1].n, rows[2].kph) == (18.1, 3, 50.0)


def test_quota_stream(spark, observed):
    rows = {r.event_id: r.accepted for r in collected(spark, jobs.quota_stream(observed, 2500), "append")}
    assert sum(rows.values()) == 2


def test_window_streams(spark, observed):
    one_each = jobs.once_a_window_stream(observed.withColumn("cell", F.lit(1)), "1 hour", "2 hours")
    assert len(collected(spark, one_each, "append")) == 1
    assert sum(r.requests for r in collected(spark, jobs.burst_stream(observed), "update")) == 4


def test_upsert_stream(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "a.json").write_text('{"osm_id":"a","osm_type":"node","tags":{"name":"A"},"admin_level":0,"area_km2":0.0}\n')
    merge = lambda old, new: new if old is None else new.unionByName(old.join(new, "osm_id", "left_anti"))
    jobs.upsert_stream(jobs.element_stream(spark, str(folder)), table, merge, str(tmp_path / "c")).awaitTermination()
    (folder / "b.json").write_text('{"osm_id":"b","osm_type":"node","tags":{},"admin_level":0,"area_km2":0.0}\n{"osm_id":"a","osm_type":"way","tags":{},"admin_level":0,"area_km2":0.0}\n')
    jobs.upsert_stream(jobs.element_stream(spark, str(folder)), table, merge, str(tmp_path / "c")).awaitTermination()
    assert {(r.osm_id, r.osm_type) for r in jobs.latest_version(spark, table, 1).collect()} == {("a", "way"), ("b", "node")}
    (folder / "c.json").write_text('{"osm_id":"c","osm_type":"node","tags":{},"admin_level":0,"area_km2":0.0}\n')
    jobs.upsert_stream(jobs.element_stream(spark, str(folder)), table, merge, str(tmp_path / "c")).awaitTermination()
    assert jobs.current_version(spark, table).count() == 3 and not (tmp_path / "table" / "_versions" / "0").exists()


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    row = '{{"osm_id":"{}","osm_type":"{}","tags":{{}},"admin_level":0,"area_km2":0.0}}\n'
    seen = []

    def merge(old, new):
        seen.append(0 if old is None else old.count())
        return new if old is None else new.unionByName(old.join(new, "osm_id", "left_anti"))

    def batch(name, rows):
        (folder / name).write_text("".join(row.format(*r) for r in rows))
        jobs.upsert_stream(jobs.element_stream(spark, str(folder)), table, merge, str(tmp_path / "c"), buckets=16).awaitTermination()

    batch("a.json", [(f"n{i}", "node") for i in range(200)])
    first = jobs._buckets_of(spark, table, 0)
    batch("b.json", [("n7", "way"), ("m1", "node")])
    second = jobs._buckets_of(spark, table, 1)
    changed = [b for b in second if second[b] != first.get(b)]
    assert 1 <= len(changed) <= 2 and seen[1] < 60 and len(list((tmp_path / "table" / "v=1").glob("bucket=*"))) == len(changed)
    rows = {r.osm_id: r.osm_type for r in jobs.current_version(spark, table).collect()}
    assert len(rows) == 201 and rows["n7"] == "way"
    # a reader in the middle of the next batch finds the version before: its folder and its unnamed list are there already
    (tmp_path / "table" / "v=2" / "bucket=0").mkdir(parents=True)
    (tmp_path / "table" / "_versions" / "_2").mkdir()
    assert jobs.current_version(spark, table).count() == 201
    batch("c.json", [("n8", "way")])
    assert {r.osm_id: r.osm_type for r in jobs.current_version(spark, table).collect()} == rows | {"n8": "way"}
    assert jobs.latest_version(spark, table, 1).count() == 201


def batches_of(spark, tmp_path, frames):
    """A stream with one micro-batch for each frame, in order."""
    path = tmp_path / "parts"
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(str(path / f"{i}"))
        for f in (path / f"{i}").glob("*.parquet"):
            f.rename(path / f"{i}.parquet")
            os.utime(path / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "?.parquet").parquet(str(path))


def test_idle_edges_are_reported_and_forgotten(spark, tmp_path):
    shape = "gid bigint, kph double, ts timestamp, event_id bigint"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    frames = [spark.createDataFrame(r, shape) for r in ([(1, 10.0, at(0, 0), 1), (1, 20.0, at(0, 1), 2)], [(2, 50.0, at(1, 0), 3)], [(2, 50.0, at(1, 5), 4)], [(1, 30.0, at(1, 6), 5)])]
    rows = collected(spark, jobs.speed_stream(batches_of(spark, tmp_path, frames), late="0 seconds"), "update")
    assert [(r.kph, r.n) for r in rows if r.gid == 1] == [(13.0, 2), (None, 0), (30.0, 1)]


def test_updates_of_two_batches_give_one_row(spark, tmp_path):
    shape = "tenant string, key_id string, endpoint string, milli bigint, ts timestamp"
    frames = [spark.createDataFrame([("t", "k", "e", m, dt.datetime(2024, 1, 1))], shape) for m in (1, 2)]
    keys = ["tenant", "key_id", "period", "day", "endpoint"]
    (row,) = movement._streamed(spark, jobs.rollup_stream(batches_of(spark, tmp_path, frames)), "update", keys).collect()
    assert (row.milli, row.requests) == (3, 2)


def test_refunds(spark, tmp_path):
    rows = [("t", i, m, dt.datetime(2024, 1, 1, 0, i), ok) for i, (m, ok) in enumerate([(1000, True), (1000, False), (1000, True), (1000, True)], 1)]
    df = jobs.with_refunds(spark.createDataFrame(rows, "tenant string, event_id bigint, milli bigint, ts timestamp, ok boolean"))
    assert {r.event_id for r in metering.quota_replay(df, 2000).where("accepted and event_id > 0").collect()} == {1, 2, 3}
    got = collected(spark, jobs.quota_stream(batches_of(spark, tmp_path, [df]), 2000), "append")
    assert {r.event_id for r in got if r.accepted and r.event_id > 0} == {1, 2, 3}


def test_suppressed_requests(spark):
    t = dt.datetime(2024, 1, 1)
    asked = spark.createDataFrame([("a", t), ("b", t)], "window_id string, ts timestamp")
    empty = spark.createDataFrame([("a", t - dt.timedelta(seconds=100)), ("b", t - dt.timedelta(seconds=400))], "window_id string, ts timestamp")
    assert [r.window_id for r in traffic.suppressed(asked, empty).collect()] == ["b"]


def test_candidates_hold_the_best(spark):
    """Batch geocoding with common tokens gives what scoring every place gives."""
    rng = random.Random(8)
    kinds, words = ["cafe", "hotel", "bank"], [f"w{i}" for i in range(40)]
    places = [(f"n{i}", " ".join([rng.choice(kinds), *rng.sample(words, rng.randrange(1, 4))]), rng.choice(kinds), 30.0 + i / 1000, 31.0, float(i % 7), float(i % 3), str(i)) for i in range(700)]
    places = spark.createDataFrame(places, "osm_id string, name string, tags_text string, lat double, lon double, offline_rank double, popularity double, addr_housenumber string")
    queries = spark.createDataFrame([(str(i), t, 30.2, 31.0, None) for i, t in enumerate(["cafe", "cafe w3", "hotel bank w5 w6", "cafs w11", "w1", "nothing", "bank hotel"])], "query string, q string, bias_lat double, bias_lon double, asked_number string")
    index = search.postings(places, ["name", "tags_text"])
    statistics = search.corpus_statistics(index)
    got, want = ({(r["query"], r["doc"], r["rank"]) for r in search.forward_geocode(queries, places, index, statistics, max_df=m).collect()} for m in (20, 10_000))
    assert got == want and len(got) > 50


def test_street_requests_by_place_city_and_other_names(spark):
    a = spark.createDataFrame([("a1", "main", 1, 30.0, 31.0, "Cairo"), ("a2", "main", 5, 30.001, 31.0, "Cairo"), ("b1", "main", 1, 40.0, 31.0, "Giza"), ("b2", "main", 5, 40.001, 31.0, "Giza"), ("c1", "tahrir", 3, 30.0, 31.2, "Cairo")], "osm_id string, street_norm string, number bigint, lat double, lon double, city string")
    asked = spark.createDataFrame([("1", "main", 3, 40.0, 31.0, None), ("2", "main", 3, None, None, "cairo"), ("3", "main", 3, 50.0, 31.0, None), ("4", "midan", 3, 30.0, 31.2, None)], "req_id string, street_norm string, asked bigint, ref_lat double, ref_lon double, city string")
    found = interpolate.on_street(asked, a).collect()
    assert {(r.req_id, r.osm_id) for r in found} == {("1", "b1"), ("1", "b2"), ("2", "a1"), ("2", "a2")}
    streets = spark.createDataFrame([("w1", "Tahrir", "Midan", None)], "osm_id string, name string, name_en string, name_fr string")
    assert {(r.req_id, r.osm_id) for r in interpolate.on_street(interpolate.with_street_names(asked, streets), a).collect()} >= {("4", "c1")}
    empty = spark.createDataFrame([], "osm_id string, line array<struct<lat:double,lon:double>>")
    done = {r.req_id: r for r in interpolate.interpolate_address(asked, a, empty).collect()}
    assert set(done) == {"1", "2"} and abs(done["1"].lat - 40.0005) < 1e-6 and abs(done["2"].lat - 30.0005) < 1e-6


def test_nearest_over_all_distances(spark):
    places = spark.createDataFrame([("near", 30.0001, 31.0), ("town", 30.05, 31.0), ("far", 45.0, 100.0), ("pole", 89.9, -170.0), ("west", 0.0, -179.999)], "osm_id string, lat double, lon double")
    points = spark.createDataFrame([("p", 30.0, 31.0), ("q", 0.0, 179.999), ("s", -80.0, 10.0), ("n", 89.95, 10.0)], "p_id string, p_lat double, p_lon double")
    rows = cells.nearest(points, places, "p_id", "osm_id", 2).collect()
    every = points.crossJoin(places).withColumn("d", geo.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).collect()
    for p in "pqsn":
        want = [r.osm_id for r in sorted((r for r in every if r.p_id == p), key=lambda r: (r.d, r.osm_id))[:2]]
        assert [r.osm_id for r in sorted((r for r in rows if r.p_id == p), key=lambda r: r["rank"])] == want
    assert cells.nearest(points, places.limit(0), "p_id", "osm_id").count() == 0


def test_nearest_against_all_pairs_over_the_globe(spark):
    rng = random.Random(4)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), rng.gauss(30, 0.01), rng.gauss(30, 1), 89.99, -90.0]), rng.choice([rng.uniform(-180, 180), rng.gauss(31, 0.01), rng.gauss(31, 1), 180.0, -179.999]))
    spots = [spot() for _ in range(300)]
    places = spark.createDataFrame([(f"o{i}", *rng.choice(spots)) for i in range(400)] + [("null", None, 1.0)], "osm_id string, lat double, lon double")
    points = spark.createDataFrame([(i, *spot()) for i in range(250)] + [(999, None, 0.0)], "p_id int, p_lat double, p_lon double")
    every = points.crossJoin(places).withColumn("d", geo.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).where("lat IS NOT NULL AND p_lat IS NOT NULL").collect()
    of = {}
    for r in every:
        of.setdefault(r.p_id, []).append((r.d, r.osm_id))
    for k in (1, 4):
        got = {}
        for r in cells.nearest(points, places, "p_id", "osm_id", k).orderBy("rank").collect():
            got.setdefault(r.p_id, []).append((r.distance_m, r.osm_id))
        assert got == {p: sorted(rows)[:k] for p, rows in of.items()}


def test_nearest_isnt_misled_by_cells_of_another_size(spark):
    points = spark.createDataFrame([(1, -67.5003, -170.0)], "p_id int, p_lat double, p_lon double")
    places = spark.createDataFrame([("near", -60.0, -170.0), ("far", -0.02, -164.70)], "osm_id string, lat double, lon double")
    assert [r.osm_id for r in cells.nearest(points, places, "p_id", "osm_id").collect()] == ["near"]


def test_levels_follow_what_cells_hold(spark):
    sizes = cells._levels(30.0)
    spots = spark.createDataFrame([("a", 30.0, 31.0), ("b", 30.0001, 31.0), ("c", 30.01, 31.0), ("d", 40.0, 31.0)], "osm_id string, lat double, lon double")
    points = spark.createDataFrame([("at", 30.00005, 31.0), ("km", 30.02, 31.0), ("apart", 40.0, 31.0), ("empty", -50.0, -100.0)], "p_id string, p_lat double, p_lon double")
    homes = spots.select(cells._homes(F.col("lat"), F.col("lon"), dict(enumerate(sizes))).alias("at")).select("at.*")
    counts = homes.groupBy("level", "cell").agg(F.count("*").alias("n"))
    assert {r.level: r.n for r in counts.groupBy("level").agg(F.sum("n").alias("n")).collect()} == {i: 4 for i in range(len(sizes))}
    level = {r.p_id: sizes[r.level] for r in cells.point_levels(points, counts, "p_id", 2, sizes).collect()}
    assert level["at"] <= 120 and 480 <= level["km"] <= 7680 and level["apart"] > 300_000 and level["empty"] > 1_000_000


def test_address_search_and_interpolated_fallback(spark):
    rows = [("a1", None, "Tahrir Street", "10", "Cairo", "11511", "EG"), ("a2", None, "Tahrir Street", "20", "Cairo", "11511", "EG"), ("a3", None, "Nile Street", "15", "Cairo", "11512", "EG"), ("a4", None, "Tahrir Street", "15", "Giza", "12511", "EG"), ("p1", "Cairo Tower", None, None, "Cairo", None, "EG")]
    places = [(i, n, s, h, c, p, k, ", ".join(x for x in (f"{h} {s}" if s else None, c) if x) if s else "", 30.0 + (0.5 if c == "Giza" else 0.0), 31.0 + int(h or 0) / 10_000, 1.0, 0.0) for i, n, s, h, c, p, k in rows]
    places = spark.createDataFrame(places, "osm_id string, name string, addr_street string, addr_housenumber string, addr_city string, addr_postcode string, addr_country string, full_address string, lat double, lon double, offline_rank double, popularity double")
    wide = places.withColumns({"addr_suburb": F.lit(None).cast("string"), "name_en": F.col("name"), "name_fr": F.lit(None).cast("string"), "tags_text": F.lit(None).cast("string")})
    index = search.postings(wide, search.ADDRESS_FIELDS)
    asked = spark.createDataFrame([("1", "10 Tahrir Street, Cairo", None, None, None, None, None), ("2", "15 Tahrir Street", 30.0, 31.0, None, "cairo", None), ("3", "Cairo Tower", None, None, None, None, "eg"), ("4", "15 Nile Street", None, None, "11511", None, None), ("5", "Tahrir Street", None, None, None, None, "FR")], "query string, q string, bias_lat double, bias_lon double, want_postcode string, want_city string, want_country string")
    found = search.address_search(asked, places, index, search.corpus_statistics(index))
    best = {r["query"]: r.doc for r in found.where("rank = 1").collect()}
    assert best["1"] == "a1" and best["2"] in ("a1", "a2") and "5" not in best
    assert "p1" in {r.doc for r in found.where("query = '3'").collect()}
    assert {r.doc for r in found.where("query = '4'").collect()} <= {"a1", "a2"}
    known = places.where("addr_street IS NOT NULL").select("osm_id", text.street_form(F.col("addr_street")).alias("street_norm"), text.house_number(F.col("addr_housenumber")).alias("number"), "lat", "lon", F.col("addr_city").alias("city"))
    lines = spark.createDataFrame([], "osm_id string, line array<struct<lat:double,lon:double>>")
    out = search.with_interpolated(found, asked, known, lines).collect()
    (made,) = [r for r in out if r.kind == "interpolated"]
    assert (made["query"], made["rank"], made.name) == ("2", 0, "15 tahrir street") and abs(made.lon - 31.0015) < 1e-6


def test_closed_lines_are_areas_and_ids_get_details(spark):
    line = "array<struct<lat:double,lon:double>>"
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    zones = spark.createDataFrame([("z", "Z", 8, 5.0, [[square]])], f"osm_id string, name string, admin_level int, area_km2 double, polygons array<array<{line}>>")
    lines = spark.createDataFrame([("w1", "Park", square), ("w2", "Road", square[:4]), ("w3", "Loop", [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), ("z", "again", square)], f"osm_id string, name string, line {line}")
    every = reverse.areas(zones, lines)
    assert {(r.osm_id, r.name) for r in every.collect()} == {("z", "Z"), ("w1", "Park")}
    point = spark.createDataFrame([("p", 0.5, 0.5)], "p_id string, p_lat double, p_lon double")
    inside = cells.enclosing(point, every).select("p_id", F.col("osm_id").alias("zone_id"))
    assert {(r.zone_id, r.zone_name) for r in reverse.with_details(inside, every, "zone_id", ["name"]).collect()} == {("z", "Z"), ("w1", "Park")}


def test_chains_by_hand(spark):
    texts = ["O'Brien St., 3.14 e.g. a.1 shop_2", "شارع التحرير مدرسة أحمد", "مُحَمَّد ـ إلى", "12 Bd de l'Allée Élysées, AVE Foch", "Straße Łódź œuvre", "日本 x", "_ !", "", None, "b" * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {name: {r.i: [list(x) for x in r.s] for r in frame.select("i", analysis.stream(F.col("t"), chain).alias("s")).collect()} for name, chain in analysis.CHAINS.items()}
    a, n = got["address_standard"], got["arabic_name"]
    assert a[0] == [["obrien"], ["st", "street"], ["3.14"], ["e.g"], ["a"], ["1"], ["shop_2"]]
    assert a[1] == [["ش", "شارع"], ["التحرير"], ["مدرسه"], ["احمد"]] and n[1][0] == ["شارع"]
    assert a[2] == [["محمد"], ["الي"]] == n[2]
    assert a[3] == [["12"], ["bd", "blvd", "boulevard"], ["de"], ["lallee"], ["elysees"], ["av", "ave", "avenue"], ["foch"]]
    assert a[4] == [["strasse"], ["lodz"], ["oeuvre"]] and a[5] == [["日"], ["本"], ["x"]] and a[6] == a[7] == a[8] == []
    assert [len(x[0]) for x in a[9]] == [255, 45] and got["address_search"] == a
    assert got["address_autocomplete"][3][1] == ["bd", "bl", "blv", "blvd", "bo", "bou", "boul", "boule", "boulev", "bouleva", "boulevar", "boulevard"] and got["address_autocomplete"][5][2] == []
    pairs = frame.where("i = 3").select(F.explode(analysis.analyzed(F.col("t"), analysis.STANDARD)).alias("x")).select("x.*").collect()
    assert [(r.pos, r.token) for r in pairs][:4] == [(0, "12"), (1, "bd"), (1, "blvd"), (1, "boulevard")]


def test_alternatives_share_a_place(spark):
    docs = spark.createDataFrame([("a", "Main St"), ("b", "Main Street"), ("c", "Main Road"), ("d", "Street Main")], "osm_id string, name string")
    index = search.postings(docs, ["name"], chains={"name": analysis.STANDARD})
    asked = search.query_tokens(spark.createDataFrame([("q", "main str"), ("r", "main st")], "query string, q string"), chain=analysis.STANDARD)
    assert {r.field_length for r in index.collect()} == {2} and {r.n for r in asked.collect()} == {2}
    every = search.match_alternatives(asked, index, search.corpus_statistics(index), every=True)
    assert sorted((r.query, r.doc) for r in every.collect()) == [("r", "a"), ("r", "b"), ("r", "d")]
    assert sorted((r.query, r.doc) for r in search.phrases(asked, index).collect()) == [("r", "a"), ("r", "b")]
    assert {r.doc: r.distance for r in search.sloppy_phrases(asked.where("query = 'r'"), index, 2).collect()} == {"a": 0, "b": 0, "d": 2}


def test_swaps_are_one_edit(spark):
    words = ["street", "stret", "tsreet", "streets", "sterte", "strteer", "road", "raod", "rad", "orad", "ab", "ba", "x" * 30, "x" * 28 + "yx", "abcdef", "badcfe", "bacdfe"]
    frame = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")

    def distance(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for r in frame.withColumn("e", search.edits_within_two(F.col("a"), F.col("b"))).collect():
        assert r.e == min(distance(r.a, r.b), 3), (r.a, r.b)
    for prefix in (0, 1, 2):
        asked = spark.createDataFrame([(w, w, 0, 1) for w in words], "query string, token string, pos int, n int")
        got = {(r.asked, r.token, r.edits) for r in search.fuzzy_tokens(asked, spark.createDataFrame([(w,) for w in words], "token string"), prefix).collect()}
        allowed = lambda w: 0 if len(w) < 3 else 1 if len(w) < 6 else 2
        assert got == {(a, b, distance(a, b)) for a in words for b in words if a[:prefix] == b[:prefix] and distance(a, b) <= allowed(a)}


def test_sloppy_phrases_against_all_choices(spark):
    rng = random.Random(6)
    docs = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    queries = sorted({" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(40)})
    index = search.postings(spark.createDataFrame(docs, "osm_id string, name string"), ["name"]).persist()
    asked = search.query_tokens(spark.createDataFrame([(q, q) for q in queries], "query string, q string"))
    for slop in (0, 1, 3):
        want = {}
        for q in queries:
            for i, text in docs:
                w = q.split()
                choices = [c for c in itertools.permutations(range(len(text.split())), len(w)) if all(text.split()[p] == x for p, x in zip(c, w, strict=True))]
                moves = [max(p - k for k, p in enumerate(c)) - min(p - k for k, p in enumerate(c)) for c in choices]
                if moves and min(moves) <= slop:
                    want[q, i] = min(moves)
        assert {(r.query, r.doc): r.distance for r in search.sloppy_phrases(asked, index, slop).collect()} == want


def test_best_documents_equal_scoring_all(spark, monkeypatch):
    """Trees of every kind over skewed words: results are those of scoring every document, and common words are hardly read."""
    rng = random.Random(9)
    vocabulary = ["street"] * 40 + ["main"] * 10 + ["north"] * 5 + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))), rng.choice(["cairo", "giza", None]), i % 3) for i in range(900)]
    frame = spark.createDataFrame(docs, "osm_id int, name string, city string, kind int")
    index = search.postings(frame, ["name", "city"]).persist()
    index = index.unionByName(clauses.exact_postings(frame, ["kind"]))
    stats = search.corpus_statistics(index)
    texts = ["street", "main street", "north w3", "w1 w2 street", "w5", "street cairo", "nothing here", "street main north"]
    queries = spark.createDataFrame([(t, t, i % 4) for i, t in enumerate(texts)], "query string, q string, want int")
    asked, first = search.query_tokens(queries), search.query_tokens(queries.withColumn("q", F.split_part("q", F.lit(" "), F.lit(1))))
    barred = search.query_tokens(queries.withColumn("q", F.lit("w7")))
    every = clauses.Words(asked, {"name": 2.0, "city": 1.0})
    trees = [
        clauses.Tree([every]), clauses.Tree([every, clauses.Words(barred, {"name": 1.0}, excluded=True)], [clauses.Phrase(asked, ("name",), 5.0)]),
        clauses.Tree([clauses.Words(first, {"name": 1.0}, 3.0, required=True), every], condition=(F.col("want") == 3) | (F.col("kind") == F.col("want"))),
        clauses.Tree([every, clauses.Words(clauses.exact_word(queries.where("want < 3"), "want"), {"kind": 0.0}, required=True)]),
        clauses.Tree([every, clauses.Words(asked, {"name": 1.0}, every=True)], [clauses.Phrase(asked, ("name",), 2.0, 2)], minimum=2),
    ]
    more = queries.select("query", "want"), frame.select(F.col("osm_id").alias("doc"), "kind")
    for tree in trees:
        whole = clauses.impact_index(index, stats, 10_000)
        everything = clauses.scores(tree, clauses._terms(tree), queries.select("query").crossJoin(frame.select(F.col("osm_id").alias("doc"))), whole[0], *more)
        want = {}
        for r in sorted(everything.collect(), key=lambda r: (-r.score, r.doc)):
            want.setdefault(r.query, []).append((r.doc, r.score))
        for size, k in ((8, 7), (300, 20)):
            got = {}
            for r in clauses.best(tree, clauses.impact_index(index, stats, size), k, *more).orderBy("rank").collect():
                got.setdefault(r.query, []).append((r.doc, r.score))
            assert got == {q: rows[:k] for q, rows in want.items()}


def test_factors_and_ordered_words_equal_scoring_all(spark):
    """A factor that depends on query and document, with ceilings, and words in order: results are those of scoring every document."""
    rng = random.Random(4)
    vocabulary = ["street"] * 30 + ["main"] * 10 + ["north"] * 5 + [f"w{i}" for i in range(20)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))), rng.random() * 9, i % 4) for i in range(700)]
    frame = spark.createDataFrame(docs, "osm_id int, name string, worth double, kind int")
    index = search.postings(frame, ["name"])
    stats = search.corpus_statistics(index)
    texts = ["street", "main street", "north w3", "street main north"]
    queries = spark.createDataFrame([(t, t, i) for i, t in enumerate(texts)], "query string, q string, want int")
    asked = search.query_tokens(queries)
    factor = F.col("worth") + F.when(F.col("kind") == F.col("want"), 5.0).otherwise(0.0)
    ceilings = frame.select(F.col("osm_id").alias("doc"), (F.col("worth") + 5).alias("ceiling"))
    tree = clauses.Tree([clauses.Words(asked, {"name": 2.0}), clauses.Words(asked, {"name": 10.0}, ordered=True)], minimum=1, factor=factor)
    more = queries.select("query", "want"), frame.select(F.col("osm_id").alias("doc"), "worth", "kind")
    whole = clauses.impact_index(index, stats, 10_000, ceilings)
    everything = clauses.scores(tree, clauses._terms(tree), queries.select("query").crossJoin(frame.select(F.col("osm_id").alias("doc"))), whole[0], *more).collect()
    score = {(r.query, r.doc): r.score for r in everything}
    impact = {(r.doc, r.token): r.impact for r in whole[0].collect()}
    for q, want in zip(texts, range(4), strict=True):
        for i, text, worth, kind in docs:
            words = q.split()
            parts = sum(impact.get((i, w), 0.0) for w in words)
            value = 2 * parts + (10 * parts if f" {q} " in f" {text} " else 0.0)
            assert score.get((q, i), 0.0) == pytest.approx(value * (worth + 5 * (kind == want)), abs=2e-6)
    best = {}
    for r in sorted(everything, key=lambda r: (-r.score, r.doc)):
        best.setdefault(r.query, []).append((r.doc, r.score))
    got = {}
    for r in clauses.best(tree, clauses.impact_index(index, stats, 8, ceilings), 6, *more).orderBy("rank").collect():
        got.setdefault(r.query, []).append((r.doc, r.score))
    assert got == {q: rows[:6] for q, rows in best.items()}
    with pytest.raises(ValueError):
        clauses.Tree([], [clauses.Phrase(asked, ("name",), 1.0)], factor=factor)


def test_suggestions_from_the_corpus(spark):
    """Whole words before words that only begin so, near before far, types interleaved with names, villages not for types, edges."""
    places = spark.createDataFrame(
        [
            ("a", "Metro", None, "shop", "supermarket", "supermarket", 43.7, -79.4, 1.0, 0.0, "1 Main Street"), ("b", "Metrosport", None, "shop", "sports", "sports", 43.7, -79.4, 9.0, 0.0, None),
            ("c", "Metro", "Metro", "shop", "supermarket", "supermarket", 30.05, 31.25, 1.0, 0.0, None), ("d", "Black Bank", None, "place", "village", "village", 43.7, -79.4, 9.0, 9.0, None),
            ("e", "Creek Bank", None, "amenity", "cafe", "cafe", 43.7, -79.4, 1.0, 0.0, None), ("f", "Savings", None, "amenity", "bank", "bank", 43.7, -79.4, 1.0, 0.0, None),
            ("g", None, None, None, None, None, None, None, None, None, None), ("h", "A" * 40 + " B", None, "shop", "x", "x", 0.0, 0.0, 0.0, None, ""), ("i", "North Metro Hall", None, "shop", "x", "x", None, None, 2.0, 1.0, ""),
        ],
        "osm_id string, name string, name_en string, category_key string, category_value string, category_text string, lat double, lon double, offline_rank double, popularity double, full_address string",
    )
    asked = spark.createDataFrame(
        [("1", "metro", 43.7, -79.4), ("2", "METRO", 30.05, 31.25), ("3", "bank", 43.7, -79.4), ("4", "black ba", None, None), ("5", "a" * 40, None, None), ("6", "", None, None), ("7", None, 1.0, 1.0), ("8", "zzz", None, None), ("9", "metr", None, None), ("10", "a" * 40 + " b", None, None)],
        "query string, q string, bias_lat double, bias_lon double",
    )
    impacts = prefix.corpus_index(places, 2)
    got = {}
    for r in prefix.suggest_from_corpus(asked, impacts, places, 5).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.osm_id)
        assert 0 < r.confidence <= 1
    assert got["1"][0] == "a" and got["2"][0] == "c" and set(got["1"]) == {"a", "b", "c", "i"}
    assert got["3"] == ["e", "f"]  # by name, then by type; the village isn't meant
    assert got["4"][0] == "d" and got["5"] == ["h"] and got["10"] == ["h"] and got["9"][0] == "b"
    assert not {"6", "7", "8"} & set(got)
    index = prefix.build_prefix_index(places, None)
    both = prefix.suggest_with_fallback(asked.where("query IN ('1', '4')"), index, impacts, places, 2).collect()
    assert {r.query: r.source for r in both} == {"1": "index", "4": "corpus"}
    assert not prefix.suggest_from_corpus(asked.limit(0), impacts, places).collect()
    labels = places.select("osm_id", prefix.corpus_label(F.col("name"), F.col("name_en"), F.col("full_address")).alias("label")).collect()
    assert {r.osm_id: r.label for r in labels if r.osm_id in "acg"} == {"a": "Metro, 1 Main Street", "c": "Metro", "g": ""}


def test_kept_prefix_index_equals_a_rebuild(spark):
    """Random rounds of new, changed and removed places: what is served equals a new index, through lists that run out as well."""
    rng = random.Random(12)
    words = ["cafe", "cairo", "calm", "north", "nile", "new"]
    schema = "osm_id string, name string, lat double, lon double, offline_rank double, popularity double"

    def place(i):
        return f"n{i}", rng.choice([None, "", *[f"{rng.choice(words)} {rng.choice(words)}" for _ in range(9)]]), rng.choice([30.0, 30.5, None]), 31.0, float(rng.randrange(8)), float(rng.randrange(3))

    now = {f"n{i}": place(i) for i in range(60)}
    index = prefix.build_kept_index(spark.createDataFrame(list(now.values()), schema), 4, 2)
    for step in range(4):
        changed = rng.sample(sorted(now), 12 if step < 3 else len(now))
        for i in changed:
            if rng.random() < 0.5 or step == 3:
                now.pop(i)
            else:
                now[i] = place(int(i[1:]))
        fresh = [f"n{100 * (step + 1) + j}" for j in range(3)]
        now |= {i: place(int(i[1:])) for i in fresh}
        frame = spark.createDataFrame(list(now.values()), schema)
        ids = spark.createDataFrame([(i,) for i in [*changed, *fresh, *fresh, None, "nowhere"]], "osm_id string")
        index = written(prefix.refresh_index(index, frame, ids, 4, 2))
        want = {tuple(r) for r in prefix.build_prefix_index(frame, None, 4).select("scope", "prefix", "osm_id", "score", "rank").collect()}
        assert {tuple(r) for r in prefix.served(index, 4).select("scope", "prefix", "osm_id", "score", "rank").collect()} == want
    untouched = prefix.refresh_index(index, frame, ids.limit(0), 4, 2)
    assert untouched.exceptAll(index).isEmpty() and index.exceptAll(untouched).isEmpty()


def test_claims_by_two_workers_and_a_crash(spark, tmp_path):
    clock = [0.0]
    one, two = (claims.Claims(spark, f"{tmp_path}/claims", 3600, lambda: time.time() + clock[0]) for _ in range(2))
    files, ran = [f"/data/{i}.json" for i in range(6)], []

    def crash(file):
        if file.endswith("3.json"):
            raise RuntimeError("lost")
        ran.append(("one", file))

    with pytest.raises(RuntimeError):
        one.work(files, crash)
    assert two.work(files, lambda f: ran.append(("two", f))) == files[4:]
    assert two.work(files, lambda f: ran.append(("two", f))) == []
    clock[0] += 3601
    assert not two.claim(files[0]) and two.work(files, lambda f: ran.append(("two", f))) == [files[3]]
    assert sorted(f for _, f in ran) == files and one.work(files, crash) == []
    one.finish(files[0])
    assert one.is_done(files[0]) and not one.claim(files[0])


def test_one_of_many_claims_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    workers = [claims.Claims(spark, f"{tmp_path}/claims") for _ in range(8)]
    for file in ("a", "b", "c"):
        with ThreadPoolExecutor(8) as pool:
            assert sum(pool.map(lambda w, f=file: w.claim(f), workers)) == 1


def test_copies_are_scored_once(spark):
    draw = random.Random(5)
    docs = [(f"d{i:03}", " ".join(draw.choice("abcde") for _ in range(draw.randint(1, 3))), draw.choice(["x y", "z", None])) for i in range(120)]
    frame = spark.createDataFrame(docs, "osm_id string, name string, name_en string")
    kept, members = search.without_copies(frame, ["name", "name_en"])
    assert kept.count() == len({d[1:] for d in docs}) < len(docs) == members.count()
    index, own = search.postings(frame, ["name", "name_en"]), search.postings(kept, ["name", "name_en"], "doc")
    statistics = lambda *x: {(r.field, r.token): (r.df, r.docs, r.average) for r in search.corpus_statistics(*x).collect()}
    assert statistics(index) == statistics(own, kept)
    asked = search.query_tokens(spark.createDataFrame([(q, q) for q in ("a b x", "a q x y", "c z z e", "e", "q")], "query string, q string"))
    scored = lambda *x: search.cross_fields(asked, *x).withColumn("score", F.round("score", 9))
    every = scored(index, search.corpus_statistics(index))
    rows = lambda df: {(r["query"], r["doc"], r["score"], r["rank"]) for r in df.collect()}
    assert rows(search.top(every, 7)) == rows(search.top_members(search.top(scored(own, search.corpus_statistics(own, kept)), 7), members, 7))
    words = {i: {*n.split(), *(e or "").split()} for i, n, e in docs}
    want = {(q, i) for q in ("a b x", "a q x y", "c z z e", "e", "q") for i, w in words.items() if len(w & set(q.split())) >= max(len(q.split()) * 3 // 4, 1)}
    assert {(r["query"], r["doc"]) for r in every.collect()} == want


def test_common_tokens_alone_are_no_candidates(spark):
    docs = spark.createDataFrame([(f"d{i:04}", f"brand w{i}") for i in range(3000)], "osm_id string, name string")
    index = search.postings(docs, ["name"])
    asked = search.query_tokens(spark.createDataFrame([(f"w{i} brand", f"w{i} brand x") for i in range(2000)], "query string, q string"))
    start = time.time()
    assert search.cross_fields(asked, index, search.corpus_statistics(index)).count() == 2000
    assert time.time() - start < 20


def test_words_with_enough_near_ones_skip_two_edits(spark):
    words = [f"{i:06}" for i in range(4000)]
    asked = search.query_tokens(spark.createDataFrame([(w, w) for w in words[::7]], "query string, q string"))
    vocabulary = spark.createDataFrame([(w,) for w in words], "token string")
    start = time.time()
    got = {}
    for r in search.fuzzy_tokens(asked, vocabulary, 2).collect():
        got.setdefault(r.asked, []).append((r.edits, r.token))
    assert time.time() - start < 30
    for w in words[::700]:
        def edits(v):
            differ = [i for i in range(6) if v[i] != w[i]]
            swap = len(differ) == 2 and differ[1] == differ[0] + 1 and v[differ[0]] == w[differ[1]] and v[differ[1]] == w[differ[0]]
            return 1 if swap else len(differ)
        one = sorted((edits(v), v) for v in words if v[:2] == w[:2] and edits(v) <= 1)
        assert sorted(got[w])[: min(30, len(one))] == one[:30] and len(got[w]) == 30


def _street_rows(spark, seed, n, m):
    draw = random.Random(seed)
    addresses = [(f"a{i:04}", f"s{draw.randint(0, 2)}", draw.choice([None, *range(1, 40)]), 30.0 + draw.randint(0, 30) * 0.004, 31.0 + draw.randint(0, 30) * 0.004, draw.choice(["cairo", "giza"])) for i in range(n)]
    requests = [(f"r{i}", f"s{draw.randint(0, 3)}", draw.choice([None, *range(0, 45)]), *draw.choice([(None, None), (30.0 + draw.randint(0, 90) * 0.004, 31.0 + draw.randint(0, 90) * 0.004)]), draw.choice([None, "Cairo"])) for i in range(m)]
    requests += [(r[0], f"s{draw.randint(0, 2)}", *r[2:]) for r in requests[: m // 4]]
    return (spark.createDataFrame(list(dict.fromkeys(requests)), "req_id string, street_norm string, asked bigint, ref_lat double, ref_lon double, city string"),
        spark.createDataFrame(addresses, "osm_id string, street_norm string, number bigint, lat double, lon double, city string"))


def test_numbers_around_a_point_without_the_whole_street(spark):
    asked, known = _street_rows(spark, 3, 600, 300)
    rows = lambda df: sorted(map(str, df.select("req_id", "asked", "exact", "low", "high").distinct().collect()))
    want = rows(interpolate.bracketed(interpolate.nearest_cluster(interpolate.on_street(asked, known))))
    assert len(want) > 150 and rows(interpolate.brackets(asked, known)) == want
    many = asked.crossJoin(spark.range(40).select(F.col("id").alias("i"))).withColumn("req_id", F.concat_ws("-", "req_id", "i")).withColumns({"ref_lat": F.lit(30.01), "ref_lon": F.lit(31.01), "asked": F.coalesce("asked", F.lit(7))}).drop("i", "city")
    copies = known.drop("city").crossJoin(spark.range(300).select(F.col("id").alias("i"))).withColumn("osm_id", F.concat_ws("-", "osm_id", "i")).drop("i")
    start = time.time()
    assert interpolate.brackets(many, copies).count() > 9_000
    assert time.time() - start < 60


def test_numbers_of_a_street_in_one_order(spark):
    asked, known = _street_rows(spark, 4, 500, 200)
    rows = lambda df: sorted(map(str, df.select("req_id", "asked", "exact", "low", "high").collect()))
    assert rows(interpolate.street_brackets(asked, known)) == rows(interpolate.bracketed(asked.drop("city").join(known.drop("city"), "street_norm")))


def test_points_and_addresses_at_one_spot(spark):
    addresses = spark.range(60_000).select(F.concat(F.lit("a"), F.col("id")).alias("osm_id"), (F.col("id") % 40 + 1).alias("number"), F.lit("s").alias("street_norm"), F.lit(30.0).alias("lat"), (31.0 + (F.col("id") % 40) * 0.0002).alias("lon"))
    points = spark.range(20_000).select(F.col("id").alias("p_id"), F.lit(30.0001).alias("p_lat"), (31.0 + (F.col("id") % 20) * 0.0002 + 0.00005).alias("p_lon"))
    start = time.time()
    got = interpolate.reverse_interpolate(points, addresses).collect()
    assert time.time() - start < 60 and len(got) == 20_000
    assert all(r.number in (r.p_id % 20 + 1, r.p_id % 20 + 2) and r.street == "s" for r in got)


def test_rows_at_one_spot_meet_once(spark):
    draw = random.Random(8)
    spots = [(30.0 + draw.randint(0, 25) * 0.004, 31.0 + draw.randint(0, 25) * 0.004) for _ in range(60)]
    points = spark.createDataFrame([(i, *draw.choice(spots[:20])) for i in range(300)], "p_id int, p_lat double, p_lon double")
    places = spark.createDataFrame([(f"n{i}", *draw.choice(spots), draw.choice(["a", None])) for i in range(2000)], "osm_id string, lat double, lon double, kind string")
    pairs = cells.radius_pairs(points, places, 3000.0)
    away = geo.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    every = points.crossJoin(places).withColumn("distance_m", away).where("distance_m <= 3000")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(every)
    assert rows(cells.radius_join(points, places, 3000.0)) == want and pairs.count() * 50 < len(want)
    asked = points.withColumnsRenamed({"p_id": "req_id", "p_lat": "ref_lat", "p_lon": "ref_lon"})
    found = every.withColumnsRenamed({"p_id": "req_id", "p_lat": "ref_lat", "p_lon": "ref_lon"})
    assert rows(interpolate.clusters(asked, places, 3000.0)) == rows(interpolate.nearest_cluster(found).select("req_id", "osm_id"))


def test_pages_of_places_equal_sorting_all(spark):
    draw = random.Random(9)
    spots = [(30.0 + draw.randint(0, 20) * 0.002, 31.0 + draw.randint(0, 20) * 0.002) for _ in range(40)]
    places = spark.createDataFrame([(f"n{i}", *draw.choice(spots), None, 1.0, draw.choice(["food", "shop"]), draw.choice(["bank", "fuel"]), draw.choice([None, 1.0, 5.0, 5.0000001]), float(draw.randint(0, 4))) for i in range(1500)],
        "osm_id string, lat double, lon double, admin_level int, area_km2 double, category_group string, category_value string, offline_rank double, popularity double").persist()
    points = spark.createDataFrame([(i, *draw.choice(spots)) for i in range(30)], "p_id int, p_lat double, p_lon double").persist()
    every = points.crossJoin(places).withColumn("distance_m", geo.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).where("distance_m <= 2500").withColumn("score", F.round(nearby.best_score(2500.0), 6))
    rows = lambda df: sorted(map(str, df.select("p_id", "osm_id", "distance_m", "score", "total", "rank", "has_more", "category_value").collect()))
    for sort, offset, after in (("best", 0, None), ("best", 13, None), ("distance", 7, None), ("best", 0, (3.2, "n5")), ("distance", 0, (1200.0, "n5"))):
        key = "-score" if sort == "best" else "round(distance_m, 6)"
        want = every.withColumn("total", F.expr("count(*) over (partition by p_id)"))
        want = want.where(True if not after else F.expr(f"{key} > {-after[0] if sort == 'best' else after[0]} OR ({key} = {-after[0] if sort == 'best' else after[0]} AND osm_id > '{after[1]}')")) if after else want
        want = want.withColumn("rank", F.expr(f"row_number() over (partition by p_id order by {key}, osm_id)")).where(f"rank > {offset} AND rank <= {offset + 9}").withColumn("has_more", F.col("total") > offset + 9)
        assert rows(nearby.nearby(points, places, 2500.0, sort=sort, limit=9, offset=offset, after=after)) == rows(want)


def test_many_places_around_many_points(spark):
    places = spark.range(60_000).select(F.concat(F.lit("n"), F.col("id")).alias("osm_id"), (30.0 + F.col("id") % 10 * 0.001).alias("lat"), (31.0 + F.col("id") % 7 * 0.001).alias("lon"), F.lit(None).cast("int").alias("admin_level"),
        F.lit(1.0).alias("area_km2"), F.lit("food").alias("category_group"), F.lit("bank").alias("category_value"), (F.col("id") % 1000 / 100).alias("offline_rank"), (F.col("id") % 77 / 10).alias("popularity"))
    points = spark.range(1_500).select("id", (30.0 + F.col("id") % 30 * 0.0003).alias("p_lat"), (31.0 + F.col("id") % 50 * 0.0001).alias("p_lon")).withColumnRenamed("id", "p_id")
    start = time.time()
    found = nearby.nearby(points, places, 5000.0, limit=5).collect()
    assert time.time() - start < 45 and len(found) == 7_500 and all(r.total == 60_000 for r in found)


def test_vectors_against_all_pairs(spark):
    draw = random.Random(10)
    rows = [(i, [float(draw.randint(-3, 3)) + 0.5 for _ in range(4)]) for i in range(3000)]
    rows += [(3000 + i, v) for i, v in rows[:500]]
    vectors = spark.createDataFrame(rows, "doc int, vector array<float>")
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in rows[:2100]], "query string, q_vector array<float>")
    start = time.time()
    got = {}
    for r in search.vector_candidates(queries, vectors, 6).collect():
        got.setdefault(r["query"], []).append((r["rank"], -r.cosine, r.doc))
    assert time.time() - start < 25 and len(got) == 2100 and all(len(g) == 6 for g in got.values())
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for i in range(0, 2100, 300):
        q = rows[i][1]
        want = sorted((-round(sum(x * y for x, y in zip(q, v, strict=True)) / (norm(q) * norm(v)), 6), d) for d, v in rows)[:6]
        assert [x[1:] for x in sorted(got[f"q{i}"])] == want


def test_scan_equals_scoring_all(spark, monkeypatch):
    draw = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(draw.choice("abcdefgh") * draw.randint(1, 2) for _ in range(draw.randint(0, 12))) or None) for i in range(1500)], "osm_id int, text string")
    queries = spark.createDataFrame([(i, " ".join(draw.choice("abcdxyz") for _ in range(draw.randint(0, 9)))) for i in range(25)], "query int, q string")
    asked = search.query_tokens(queries)
    index = search.postings(docs, ["text"])
    every = search.match(asked, index, search.corpus_statistics(index)).groupBy("query", "doc").agg(F.round(F.sum("score") + 1e-12, 6).alias("score"))
    rows = lambda df: sorted(tuple(r) for r in df.select("query", "rank", "doc", "score").collect())
    want = rows(search.top(every, 7))
    monkeypatch.setattr(search, "SCAN_QUERIES", 10)
    monkeypatch.setattr(search, "SCAN_DOCS", 64)
    assert rows(search.best_by_scan(asked, docs, "text", 7)) == want
