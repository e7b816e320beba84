"""Place index: kinds, matching addresses to streets, and ranked search. Joins on words and cells, no scan of every entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.functions import text as tx
from wayglass.functions.geo import metres_between
from wayglass.operators.proximity import proximity_join, with_cells

#: Scores of a word's match, of a whole name, of an address, and the weight of distance.
EXACT, PREFIX, KIND, TOWN, WHOLE, ADDRESS, BETWEEN, DISTANCE = 3.0, 2.0, 1.5, 1.0, 3.0, 6.0, 4.0, 1.5
INTERPOLATE_MAX_M = 1000.0
#: Words of queries that are sent to all tasks.
FEW_WORDS = 10_000
TOWN_WEIGHT = {"city": 2.5, "town": 1.5, "village": 1.0}

#: Fixed values: (key, values or None for any, label or None for the value in words, rank); the first that matches decides.
KINDS = (
    ("place", ("city", "town"), None, 3), ("place", ("village", "suburb", "borough", "quarter", "neighbourhood", "hamlet", "locality"), None, 2), ("aeroway", ("aerodrome",), "Airport", 1),
    ("aeroway", ("terminal",), "Airport terminal", 2), ("railway", ("station", "halt", "stop"), "Station", 2), ("railway", ("tram_stop",), "Station", 1), ("public_transport", ("station",), "Station", 2),
    ("amenity", ("hospital",), None, 3), ("amenity", ("university", "college"), None, 2), ("leisure", ("stadium",), None, 3), ("shop", ("mall",), None, 2), ("amenity", None, None, 1), ("shop", None, None, 1),
    ("tourism", None, None, 1), ("leisure", None, None, 1), ("healthcare", None, None, 1), ("landuse", ("retail",), "Shopping center", 2), ("landuse", ("religious",), "Place of worship", 1),
    ("landuse", ("commercial",), "Business park", 0), ("landuse", ("cemetery",), "Cemetery", 0), ("natural", ("water",), "Lake", 1), ("office", None, None, 0), ("craft", None, None, 0), ("building", None, "Building", 0),
)
#: Tagged things that nobody looks up by name.
SKIPPED = {
    "amenity": (
        "bench", "waste_basket", "parking_space", "parking_entrance", "bicycle_parking", "vending_machine", "toilets", "drinking_water", "post_box", "shelter", "recycling", "waste_disposal", "telephone", "clock",
        "fountain", "grit_bin", "hunting_stand", "atm", "bbq", "letter_box", "lounger", "loading_dock", "watering_place", "water_point", "smoking_area", "dog_toilet", "give_box",
    ),
    "leisure": ("picnic_table", "swimming_pool", "pitch", "track", "garden", "playground", "firepit", "outdoor_seating", "slipway", "fitness_station", "bleachers", "dog_park"),
    "tourism": ("information", "artwork", "picnic_site", "viewpoint"),
}
#: Labels where the value says nothing, and labels that read better than the value.
GENERIC = {"place": "Place", "amenity": "Place", "shop": "Shop", "tourism": "Attraction", "leisure": "Leisure", "healthcare": "Health care", "office": "Office", "craft": "Business", "building": "Building"}
LABELS = {
    "fuel": "Gas station", "fast_food": "Fast food", "place_of_worship": "Place of worship", "townhall": "Town hall", "supermarket": "Grocery store", "car_wash": "Car wash", "car_repair": "Car repair",
    "doityourself": "Hardware store", "charging_station": "EV charging", "ice_cream": "Ice cream", "fire_station": "Fire station", "post_office": "Post office", "social_facility": "Social services",
    "community_centre": "Community center", "sports_centre": "Sports center", "fitness_centre": "Gym", "neighbourhood": "Neighborhood", "golf_course": "Golf course", "nature_reserve": "Nature reserve",
    "theme_park": "Theme park", "convenience": "Convenience store", "department_store": "Department store", "mall": "Mall", "cafe": "Café", "events_venue": "Event venue", "arts_centre": "Arts center",
    "car": "Car dealer", "hairdresser": "Hair salon", "veterinary": "Vet", "kindergarten": "Preschool", "childcare": "Child care", "locality": "Area", "quarter": "Neighborhood", "suburb": "Neighborhood",
    "hamlet": "Community", "chemist": "Drugstore",
}


def kind_of(tags: str = "tags") -> Column:
    """struct(label, rank) of a named object worth finding, or null. A skipped value ends the search for a kind."""
    named = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    get = lambda k: F.element_at(tags, k)
    none = F.lit(None).cast("struct<label:string,rank:int>")
    out = F.when(F.nullif(get("addr:housenumber"), F.lit("")).isNotNull(), F.struct(F.lit("Place").alias("label"), F.lit(0).alias("rank"))).otherwise(none)
    for key, values, label, rank in reversed(KINDS):
        v = get(key)
        hit = v.isNotNull() & (v != "no") & (v.isin(*values) if values else F.lit(True))
        plain = F.regexp_replace(v, "_", " ")
        says = F.lit(label) if label else F.coalesce(F.element_at(named, v), F.when((v == "yes") | ~v.rlike("^[a-z_]+$"), GENERIC.get(key)).otherwise(F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, F.lit(2), F.length(plain)))))
        level = F.when((v == "aerodrome") & F.nullif(get("iata"), F.lit("")).isNotNull(), 3).otherwise(rank) if key == "aeroway" else F.lit(rank)
        gone = v.isin(*SKIPPED[key]) if key in SKIPPED else F.lit(False)
        if key == "natural":
            gone = gone | ~F.coalesce(get("water"), F.lit("lake")).isin("lake", "reservoir", "pond", "lagoon")
        out = F.when(hit, F.when(gone, none).otherwise(F.struct(says.alias("label"), level.cast("int").alias("rank")))).otherwise(out)
    return out


def first_of(df: DataFrame, by: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each group: explicit order, so that ties don't depend on the plan."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_i = 1").drop("_i")


def thinned(df: DataFrame, owner: str, cell_m: float, order: list[str]) -> DataFrame:
    """The first of each owner's points in each cell."""
    return first_of(df, [owner, F.floor(F.col("x") / cell_m), F.floor(F.col("y") / cell_m)], order)


def street_pieces(streets: DataFrame, minor_m: float = 400.0, major_m: float = 2000.0) -> DataFrame:
    """street_id, piece: streets (street_id, name, town, x, y, major) of one name are one where they lie near each other: major roads within a longer reach."""
    from wayglass.plans.iterate import component_labels

    a = streets.select(F.col("street_id").alias("a"), "name", "x", "y", "major")
    b = streets.select(F.col("street_id").alias("b"), "name", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("major").alias("major2"))
    near = lambda rows, others, reach: proximity_join(rows, others.hint("merge"), reach, on=("name",)).filter("a < b").select("a", "b")
    links = near(a, b, minor_m).unionByName(near(a.filter("major"), b.filter("major2"), major_m)).distinct()
    return component_labels(streets.select(F.col("street_id").alias("node")), links).select(F.col("node").alias("street_id"), F.col("label").alias("piece"))


def dedupe_places(places: DataFrame, cell: int = 2000) -> DataFrame:
    """Places (name, lon_q, lat_q, ord) of one name in one cell are one; cells floor on negatives."""
    return first_of(places, [F.lower("name"), F.floor(F.col("lon_q") / cell), F.floor(F.col("lat_q") / cell)], ["ord"])


def commonest(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """by, value: the most frequent value, the first seen among equals."""
    n = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return first_of(n, [by], [F.desc("n"), "first"]).select(by, value)


def match_addresses(addresses: DataFrame, streets: DataFrame, within: float = 1500.0) -> DataFrame:
    """addr_id, street_id, level: by key, else without direction, else without type as well; the first level that has a street within reach, and the nearest street of it.

    addresses: addr_id, street, x, y. streets: street_id, name, x, y. Equal keys are equal without their directions and types too, so all levels are met at once, by the shortest form and by
    cells as wide as the reach: a name that is common all over the map doesn't meet itself everywhere.
    """
    keyed = lambda df, name: df.withColumn("key", tx.street_key(F.col(name))).withColumn("loose", tx.loose_keys(F.col("key")))
    left = keyed(addresses, "street").select("addr_id", "x", "y", "key", F.col("loose.bare").alias("bare"), F.col("loose.stem").alias("stem"))
    right = keyed(streets, "name").select("street_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("key").alias("skey"), F.col("loose.bare").alias("sbare"), F.col("loose.stem").alias("stem"))
    east, north = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    near = with_cells(left, "x", "y", within).join(with_cells(right, "sx", "sy", within, 1).hint("merge"), ["stem", "cx", "cy"]).withColumn("d", F.sqrt(east * east + north * north)).filter(F.col("d") <= within)
    level = F.when(F.col("key") == F.col("skey"), 0).when(F.col("bare") == F.col("sbare"), 1).otherwise(2)
    best = near.groupBy("addr_id").agg(F.min(F.struct(level.alias("level"), "d", "street_id")).alias("best"))
    return best.select("addr_id", "best.street_id", "best.level")


def orphan_streets(addresses: DataFrame, matched: DataFrame, join_m: float = 400.0) -> DataFrame:
    """addr_id, street_id, name of the addresses (addr_id, street, x, y) that no street took (matched: addr_id): those of one name are a street where they lie within join_m of each other.

    street_id is the smallest addr_id of the street. name: the commonest spelling that isn't in capitals, else the commonest in title case; the first seen among equals. A name whose
    first address doesn't read like a street has no street, nor have addresses without name or position. Addresses of one name in one cell, small enough that all are linked, are one
    node of the components; addresses meet within their name alone, and only across cells.
    """
    from wayglass.plans.iterate import component_labels, cut

    left = addresses.join(matched.select("addr_id"), "addr_id", "left_anti").filter("street is not null and x is not null and y is not null")
    left = left.select("addr_id", "street", "x", "y", tx.street_key(F.col("street")).alias("key"))
    good = left.groupBy("key").agg(F.min_by("street", "addr_id").alias("first")).filter(tx.plausible_street(F.col("first"))).select("key")
    size = 0.7 * join_m  # a cell's diagonal is below join_m
    cells = cut(with_cells(left.join(good, "key"), "x", "y", size))
    nodes = cells.groupBy("key", "cx", "cy").agg(F.min("addr_id").alias("node"))
    own = cells.join(nodes, ["key", "cx", "cy"])
    spots = own.select("key", "node", "x", "y").distinct()
    across = with_cells(spots, "x", "y", size).join(with_cells(spots.select("key", F.col("node").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2")), "x2", "y2", size, 2), ["key", "cx", "cy"])
    links = across.filter((F.col("node") < F.col("b")) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= join_m)).select(F.col("node").alias("a"), "b").distinct()
    labels = component_labels(nodes.select("node"), links)
    streets = cut(own.join(labels, "node").select("addr_id", F.col("label").alias("street_id"), "street"))
    spelt = streets.groupBy("street_id", "street").agg(F.count(F.lit(1)).alias("n"), F.min("addr_id").alias("first"))
    loud = (F.upper("street") == F.col("street")) & (F.lower("street") != F.col("street"))
    names = first_of(spelt.withColumn("loud", loud), ["street_id"], ["loud", F.desc("n"), "first"]).select("street_id", F.when(F.col("loud"), tx.tidy(F.col("street"), True)).otherwise(F.col("street")).alias("name"))
    return streets.drop("street").join(names, "street_id").select("addr_id", "street_id", "name")


def dedupe_addresses(addresses: DataFrame, within: float = 60.0) -> DataFrame:
    """Addresses (street_id, number, addr_id, x, y) of one number on one street, without those near the last one kept: a fold in order, since what is kept decides."""
    item = F.struct(tx.house_lead(F.col("number")).alias("lead"), F.lower("number").alias("number"), "x", "y", "addr_id")
    rows = addresses.groupBy("street_id", F.lower("number").alias("low")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    start = F.slice("rows", 1, 1)
    kept = F.aggregate(F.slice("rows", 2, 1_000_000_000), start, lambda acc, r: F.when(F.hypot(F.element_at(acc, -1)["x"] - r["x"], F.element_at(acc, -1)["y"] - r["y"]) < within, acc).otherwise(F.concat(acc, F.array(r))))
    return rows.select("street_id", F.explode(kept).alias("r")).select("street_id", "r.addr_id")


def entries(df: DataFrame, entry_id: str, name: Column, kind: Column | None = None, town: Column | None = None) -> DataFrame:
    """entry_id, whole (canonical name), tokens of (source, word, canonical word)."""

    def tokens(c: Column | None, source: str) -> Column:
        if c is None:
            return F.array().cast("array<struct<source:string,word:string,canon:string>>")
        return F.transform(tx.words(F.coalesce(c, F.lit(""))), lambda w: F.struct(F.lit(source).alias("source"), w.alias("word"), tx.canonical(w).alias("canon")))

    return df.select(F.col(entry_id).alias("entry_id"), F.array_join(F.transform(tx.words(name), lambda w: tx.canonical(w)), " ").alias("whole"), F.concat(tokens(name, "name"), tokens(kind, "kind"), tokens(town, "town")).alias("tokens"))


def query_words(queries: DataFrame) -> DataFrame:
    """qid, n, whole, i, word, canon of queries (qid, q); queries of no word, or of one letter, are dropped."""
    w = queries.select("qid", tx.words(F.col("q")).alias("w")).filter("size(w) > 1 or size(w) = 1 and (length(get(w, 0)) > 1 or get(w, 0) rlike '[0-9]')")
    return w.select("qid", F.size("w").alias("n"), F.array_join(F.transform("w", lambda w: tx.canonical(w)), " ").alias("whole"), F.posexplode("w").alias("i", "word")).withColumn("canon", tx.canonical(F.col("word")))


def score_entries(queries: DataFrame, table: DataFrame) -> DataFrame:
    """qid, entry_id, score. Words meet by their first letters, plain or abbreviated: an equi-join, not a scan of all entries for each query."""
    letters = lambda w, c: F.explode(F.array_distinct(F.array(F.substring(w, 1, 1), F.substring(c, 1, 1))))
    q = query_words(queries).withColumn("letter", letters(F.col("word"), F.col("canon")))
    t = table.select("entry_id", F.col("whole").alias("ewhole"), F.explode("tokens").alias("t")).withColumn("letter", letters(F.col("t.word"), F.col("t.canon")))
    exact = F.col("canon") == F.col("t.canon")
    starts = F.startswith("t.word", "word") | F.startswith("t.canon", "canon")
    name = F.col("t.source") == "name"
    # the index is never sent to all tasks, however small its files are; the words that are asked for are, if they are few
    few = q.limit(FEW_WORDS + 1).count() <= FEW_WORDS
    hits = (t.join(F.broadcast(q), "letter") if few else q.join(t.hint("merge"), "letter")).filter(exact | starts)
    level = F.when(name & exact, EXACT).when(name, PREFIX).when(F.col("t.source") == "kind", KIND).otherwise(TOWN)
    each = hits.groupBy("qid", "n", "whole", "entry_id", "ewhole", "i").agg(F.max(level).alias("level"), F.max(F.col("t.source") == "kind").alias("is_kind"))
    sums = each.groupBy("qid", "n", "whole", "entry_id", "ewhole").agg(F.count(F.lit(1)).alias("m"), F.sum("level").alias("score"), F.max(F.col("level") >= PREFIX).alias("named"), F.min(F.col("is_kind").cast("int")).alias("all_kind"), F.min("level").alias("low"))
    good = sums.filter((F.col("m") == F.col("n")) & (F.col("named") | (F.col("all_kind") == 1)))
    return good.select("qid", "entry_id", (F.col("score") + F.when((F.col("low") == EXACT) & (F.col("whole") == F.col("ewhole")), WHOLE).otherwise(0.0)).alias("score"))


def penalty(metres: Column, rank: Column) -> Column:
    return DISTANCE * (1 - rank / 4) * F.log2(1 + metres / 1000)


def between_numbers(wanted: DataFrame, addresses: DataFrame) -> DataFrame:
    """qid, street_id, lon, lat: the place of house number `lead` between the nearest lower and higher number of its side, if they lie close enough.

    wanted: qid, street_id, lead. addresses: street_id, lead, lon, lat. Two as-of joins in one aggregate.
    """
    side = wanted.join(addresses.withColumnRenamed("lead", "own"), "street_id").filter("own > 0 and own % 2 = lead % 2")
    item = F.struct("own", "lon", "lat")
    two = side.groupBy("qid", "street_id", "lead").agg(F.max(F.when(F.col("own") < F.col("lead"), item)).alias("a"), F.min(F.when(F.col("own") > F.col("lead"), item)).alias("b"))
    t = (F.col("lead") - F.col("a.own")) / (F.col("b.own") - F.col("a.own"))
    two = two.filter(metres_between("a.lon", "a.lat", "b.lon", "b.lat") <= INTERPOLATE_MAX_M)
    return two.select("qid", "street_id", (F.col("a.lon") + t * (F.col("b.lon") - F.col("a.lon"))).alias("lon"), (F.col("a.lat") + t * (F.col("b.lat") - F.col("a.lat"))).alias("lat"))


def address_search(asked: DataFrame, addresses: DataFrame, streets: DataFrame) -> DataFrame:
    """qid, street_id, how, addr_id, lon, lat, bonus: a house number on a street that a query names.

    asked: qid, street_id, number. addresses: street_id, lead, number, lon, lat, addr_id. streets: street_id, lon, lat. "exact": the number itself, or the
    first that begins with it; "approximate": between its neighbours on the same side; "street": the street, where neither is known.
    """
    q = asked.withColumn("low", F.lower("number")).withColumn("lead", tx.house_lead(F.col("number")))
    on = addresses.select("street_id", "lead", F.lower("number").alias("own"), F.struct("addr_id", "lon", "lat").alias("a"))
    order = F.struct((F.col("own") != F.col("low")).alias("o"), F.col("a.addr_id"))
    exact = q.join(on, ["street_id", "lead"]).filter(F.startswith("own", "low")).groupBy("qid", "street_id").agg(F.min_by("a", order).alias("a"))
    exact = exact.select("qid", "street_id", F.lit("exact").alias("how"), "a.addr_id", "a.lon", "a.lat", F.lit(ADDRESS).alias("bonus"))
    left = q.join(exact.select("qid", "street_id"), ["qid", "street_id"], "left_anti")
    one = addresses.groupBy("street_id", "lead").agg(F.min_by(F.struct("lon", "lat"), "addr_id").alias("p")).select("street_id", "lead", "p.lon", "p.lat")
    guess = between_numbers(left.select("qid", "street_id", "lead"), one).select("qid", "street_id", F.lit("approximate").alias("how"), F.lit(None).cast("long").alias("addr_id"), "lon", "lat", F.lit(BETWEEN).alias("bonus"))
    rest = left.join(guess.select("qid", "street_id"), ["qid", "street_id"], "left_anti").join(streets, "street_id")
    return exact.unionByName(guess).unionByName(rest.select("qid", "street_id", F.lit("street").alias("how"), F.lit(None).cast("long").alias("addr_id"), "lon", "lat", F.lit(1.0).alias("bonus")))


def display_name(tags: str = "tags") -> Column:
    """What a place goes by: its name, or the brand where it has none."""
    said = lambda key: tx.tidy(F.element_at(tags, key))
    return F.coalesce(said("name"), said("brand"))


def town_of(points: DataFrame, towns: DataFrame, within: float = 15_000.0, k: int = 8, own: str | None = None) -> DataFrame:
    """point_id, town: of the k nearest towns within reach the one with the least distance by weight. Points and towns meet in cells as wide as the reach."""
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    near = proximity_join(points, towns.select("town", F.col("x").alias("x2"), F.col("y").alias("y2"), "weight"), within * 2.5).withColumn("d", d)
    if own:  # a town isn't in itself
        near = near.filter(~F.col("town").eqNullSafe(F.col(own)))
    near = near.withColumn("i", F.row_number().over(Window.partitionBy("point_id").orderBy("d", "town"))).filter(F.col("i") <= k)
    return near.filter(F.col("d") / F.col("weight") <= within).groupBy("point_id").agg(F.min_by("town", F.struct(F.col("d") / F.col("weight"), "town")).alias("town"))


def distinct_results(results: DataFrame, limit: int = 8) -> DataFrame:
    """The best `limit` results of each query (qid, kind, name, detail, x, y, score, entry_id) without near repeats of what is kept: a fold in order of score."""
    item = F.struct((-F.col("score")).alias("s"), "entry_id", "kind", "name", "detail", "x", "y")
    ranked = results.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "entry_id"))).groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("rows"))

    def same(k: Column, r: Column) -> Column:
        d = F.hypot(k["x"] - r["x"], k["y"] - r["y"])
        label = lambda v: F.substring_index(v["detail"], " · ", 1)
        return (k["name"] == r["name"]) & F.when(r["kind"] == "place", (label(k) == label(r)) & (d < 500)).otherwise((k["detail"] == r["detail"]) & (d < 3000))

    empty = F.slice("rows", 1, 0)
    kept = F.aggregate("rows", empty, lambda acc, r: F.when((F.size(acc) >= limit) | F.exists(acc, lambda k: same(k, r)), acc).otherwise(F.concat(acc, F.array(r))))
    return ranked.select("qid", F.posexplode(kept).alias("rank", "r")).select("qid", "rank", "r.entry_id", "r.name", (-F.col("r.s")).alias("score"))
