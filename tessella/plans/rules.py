"""Profiles as ordered rules over tag maps, all Column expressions.

A Rule says when an object becomes a feature of a layer, with which attributes, from which zoom, in which order and by
which geometry. `apply` turns objects into features with one explode. A rule with `stop` ends the list for the objects
it matches, as an early return would.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import attributes as A
from tessella.functions import projection as P
from tessella.functions.tags import find, holds, number

POINT, LINE, AREA, CENTROID = "point", "line", "area", "centroid"


@dataclass
class Rule:
    when: Column
    layer: str | Column | None
    geometry: str | Column = POINT
    attributes: Sequence[Column] = ()
    minzoom: Column | int | None = None
    z_order: Column | int = 0
    feature_id: Column | None = None
    stop: Column | bool = False


@dataclass
class Profile:
    """Rules by kind of object, and which objects are looked at."""

    node_rules: Callable[[Column], list[Rule]] | None = None
    way_rules: Callable[[Column], list[Rule]] | None = None
    relation_rules: Callable[[Column], list[Rule]] | None = None
    node_keys: list[str] | None = None
    way_keys: list[str] | None = None
    accept_relation: Callable[[Column], Column] | None = None
    remap: Callable[[Column, Column], Column] | None = None
    settings: dict = field(default_factory=dict)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def apply(objects: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row per object and rule that matches: object columns, layer, geometry, attrs, fmin, z_order, feature_id."""
    made, open_ = [], F.lit(True)
    for r in rules:
        hit = open_ & F.coalesce(r.when, F.lit(False))
        if r.layer is not None:
            made.append(
                F.when(
                    hit,
                    F.struct(
                        _col(r.layer).alias("layer"), _col(r.geometry).alias("geometry"), A.attribute_set(*r.attributes).alias("attrs"),
                        (F.lit(None).cast("int") if r.minzoom is None else P.encode_min_zoom(_col(r.minzoom))).alias("fmin"),
                        P.encode_z_order(_col(r.z_order)).alias("z_order"),
                        (F.col("id") if r.feature_id is None else r.feature_id).cast("long").alias("feature_id"),
                    ),
                )
            )
        if r.stop is not False:
            ended = F.coalesce(r.when, F.lit(False)) if r.stop is True else F.coalesce(r.when & r.stop, F.lit(False))
            open_ = open_ & ~ended
    if not made:
        return objects.limit(0)
    found = F.filter(F.array(*made), lambda x: x.isNotNull())
    return objects.withColumn("_f", F.explode(found)).select(*objects.columns, "_f.*")


# Fixed values of the tile schema.
# Metres per pixel at zooms 5 to 13 for 256-pixel tiles.
ZOOM_METRES = {5: 4891.97, 6: 2445.98, 7: 1222.99, 8: 611.5, 9: 305.7, 10: 152.9, 11: 76.4, 12: 38.2, 13: 19.1}
# Height of one floor in metres, and feet to a metre.
FLOOR_HEIGHT = 3.66
FEET = 3.2808399
AERODROMES = ["international", "public", "regional", "military", "private"]
PAVED = ["paved", "asphalt", "cobblestone", "concrete", "concrete:lanes", "concrete:plates", "metal", "paving_stones", "sett", "unhewn_cobblestone", "wood"]
UNPAVED = ["unpaved", "compacted", "dirt", "earth", "fine_gravel", "grass", "grass_paver", "gravel", "gravel_turf", "ground", "ice", "mud", "pebblestone", "salt", "sand", "snow", "woodchips"]
ROAD_ORDER = {"motorway": 9, "trunk": 8, "primary": 6, "secondary": 5, "tertiary": 4}
PATHS = ["footway", "cycleway", "bridleway", "path", "steps", "pedestrian", "platform"]
MINOR_ROADS = ["unclassified", "residential", "road", "living_street"]
LINKS = ["motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link"]
ROAD_ZOOM = {
    "motorway": 4, "trunk": 4, "primary": 4, "secondary": 9, "motorway_link": 9, "trunk_link": 9, "primary_link": 10, "secondary_link": 10,
    "tertiary": 11, "tertiary_link": 11, "busway": 11, "bus_guideway": 11, "raceway": 12, "track": 13, "service": 13,
}
ROAD_NAME_ZOOM = {"motorway": 7, "trunk": 8, "primary": 10, "secondary": 11, "minor": 13, "track": 13, "tertiary": 13}
RAILWAYS = {"rail": "rail", "narrow_gauge": "rail", "preserved": "rail", "funicular": "rail", "subway": "transit", "light_rail": "transit", "monorail": "transit", "tram": "transit"}
AEROWAY_BUILDINGS = ["terminal", "gate", "tower"]
WATERWAYS = ["stream", "river", "canal", "drain", "ditch"]
WATER = ["river", "riverbank", "stream", "canal", "drain", "ditch", "dock"]
LANDUSE = ["school", "university", "kindergarten", "college", "library", "hospital", "railway", "cemetery", "military", "residential", "commercial", "industrial", "retail", "stadium", "pitch", "playground", "theme_park", "bus_station", "zoo"]
LANDCOVER = {
    "wood": "wood", "forest": "wood", "wetland": "wetland", "beach": "sand", "sand": "sand", "dune": "sand", "farmland": "farmland", "farm": "farmland",
    "orchard": "farmland", "vineyard": "farmland", "plant_nursery": "farmland", "glacier": "ice", "ice_shelf": "ice", "bare_rock": "rock", "scree": "rock",
    "fell": "grass", "grassland": "grass", "grass": "grass", "heath": "grass", "meadow": "grass", "allotments": "grass", "park": "grass", "village_green": "grass",
    "recreation_ground": "grass", "scrub": "grass", "shrubbery": "grass", "tundra": "grass", "garden": "grass", "golf_course": "grass",
}
# Fixed values of the tile schema: lowest zoom of a place.
PLACE_ZOOM = {
    "continent": 0, "state": 4, "province": 5, "city": 5, "borough": 10, "suburb": 11, "quarter": 12, "hamlet": 12, "neighbourhood": 13,
    "isolated_dwelling": 13, "locality": 13, "island": 12,
}
# Fixed values of the tile schema: rank by class, and class by value, of points of interest.
POI_RANK = {
    "hospital": 1, "railway": 2, "bus": 3, "attraction": 4, "harbor": 5, "college": 6, "school": 7, "stadium": 8, "zoo": 9, "town_hall": 10, "campsite": 11,
    "cemetery": 12, "park": 13, "library": 14, "police": 15, "post": 16, "golf": 17, "shop": 18, "grocery": 19, "fast_food": 20, "clothing_store": 21, "bar": 22,
}
POI_CLASS = {
    "townhall": "town_hall", "public_building": "town_hall", "courthouse": "town_hall", "community_centre": "town_hall", "golf": "golf", "golf_course": "golf",
    "miniature_golf": "golf", "fast_food": "fast_food", "food_court": "fast_food", "park": "park", "bbq": "park", "bus_stop": "bus", "bus_station": "bus",
    "subway_entrance": "entrance", "train_station_entrance": "entrance", "camp_site": "campsite", "caravan_site": "campsite", "laundry": "laundry",
    "dry_cleaning": "laundry", "supermarket": "grocery", "deli": "grocery", "delicatessen": "grocery", "department_store": "grocery", "greengrocer": "grocery",
    "marketplace": "grocery", "books": "library", "library": "library", "university": "college", "college": "college", "hotel": "lodging", "motel": "lodging",
    "bed_and_breakfast": "lodging", "guest_house": "lodging", "hostel": "lodging", "chalet": "lodging", "alpine_hut": "lodging", "dormitory": "lodging",
    "chocolate": "ice_cream", "confectionery": "ice_cream", "post_box": "post", "post_office": "post", "cafe": "cafe", "school": "school",
    "kindergarten": "school", "alcohol": "alcohol_shop", "beverages": "alcohol_shop", "wine": "alcohol_shop", "bar": "bar", "nightclub": "bar",
    "marina": "harbor", "dock": "harbor", "car": "car", "car_repair": "car", "taxi": "car", "hospital": "hospital", "nursing_home": "hospital",
    "clinic": "hospital", "grave_yard": "cemetery", "cemetery": "cemetery", "attraction": "attraction", "viewpoint": "attraction", "biergarten": "beer",
    "pub": "beer", "music": "music", "musical_instrument": "music", "american_football": "stadium", "stadium": "stadium", "soccer": "stadium",
    "art": "art_gallery", "artwork": "art_gallery", "gallery": "art_gallery", "arts_centre": "art_gallery", "bag": "clothing_store", "clothes": "clothing_store",
    "swimming_area": "swimming", "swimming": "swimming", "castle": "castle", "ruins": "castle",
}
POI_SUBCLASS_KEY = {"information": "information", "place_of_worship": "religion", "pitch": "sport"}
# Fixed values of the tile schema: keys that may make a point of interest, in the order in which they are tried.
POI_KEYS = ["aerialway", "amenity", "barrier", "building", "highway", "historic", "landuse", "leisure", "railway", "shop", "sport", "tourism", "waterway"]
# Fixed values of the tile schema: which values of a key make a point of interest. Of shops and sports there are so many that
# any value counts here (`None`); a caller gives a narrower table.
POI_VALUES: dict[str, list[str] | None] = {
    "aerialway": ["station"],
    "amenity": [
        "arts_centre", "bank", "bar", "bbq", "bicycle_parking", "bicycle_rental", "biergarten", "bus_station", "cafe", "cinema", "clinic", "college",
        "community_centre", "courthouse", "dentist", "doctors", "embassy", "fast_food", "ferry_terminal", "fire_station", "food_court", "fuel", "grave_yard",
        "hospital", "ice_cream", "kindergarten", "library", "marketplace", "motorcycle_parking", "nightclub", "nursing_home", "parking", "pharmacy",
        "place_of_worship", "police", "post_box", "post_office", "prison", "pub", "public_building", "recycling", "restaurant", "school", "shelter",
        "swimming_pool", "taxi", "telephone", "theatre", "toilets", "townhall", "university", "veterinary", "waste_basket",
    ],
    "barrier": ["bollard", "border_control", "cycle_barrier", "gate", "lift_gate", "sally_port", "stile", "toll_booth"],
    "building": ["dormitory"],
    "highway": ["bus_stop"],
    "historic": ["monument", "castle", "ruins"],
    "landuse": ["basin", "brownfield", "cemetery", "reservoir", "winter_sports"],
    "leisure": [
        "dog_park", "escape_game", "garden", "golf_course", "ice_rink", "hackerspace", "marina", "miniature_golf", "park", "pitch", "playground",
        "sports_centre", "stadium", "swimming_area", "swimming_pool", "water_park",
    ],
    "railway": ["halt", "station", "subway_entrance", "train_station_entrance", "tram_stop"],
    "shop": None,
    "sport": None,
    "tourism": [
        "alpine_hut", "aquarium", "artwork", "attraction", "bed_and_breakfast", "camp_site", "caravan_site", "chalet", "gallery", "guest_house", "hostel",
        "hotel", "information", "motel", "museum", "picnic_site", "theme_park", "viewpoint", "zoo",
    ],
    "waterway": ["dock"],
}


def lookup(value: Column, table: dict, default=None) -> Column:
    """A value's entry in a small fixed table."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[value], F.lit(default)) if default is not None else m[value]


def _bands(value: Column, bands: Sequence[tuple[float, int]], rest) -> Column:
    """The label of the first bound that the value exceeds."""
    out = None
    for bound, label in bands:
        out = F.when(value > bound, label) if out is None else out.when(value > bound, label)
    return out.otherwise(rest)


def place_attributes(t: Column) -> Column:
    """struct(capital, rank, minzoom) of a place."""
    place, pop, cap = find(t, "place"), number(find(t, "population"), 0), find(t, "capital")
    level = F.when(cap == "yes", F.lit(2.0)).otherwise(number(cap, 0))
    capital = F.when(level != 0, level).cast("int")
    town = place.isin("city", "town")
    seat = capital + _bands(pop, [(3e6, -2), (1e6, -1)], F.when(pop < 100000, 2).otherwise(0))
    seat = seat + F.when(place == "city", 0).when(place == "town", 3).otherwise(5)
    size = _bands(pop, [(3e6, 1), (1e6, 2), (5e5, 3), (2e5, 4), (1e5, 5), (75000, 6), (50000, 7), (25000, 8), (10000, 9)], 10)
    country = _bands(pop, [(5e7, 1), (2e7, 2)], 3)
    rank = F.when(place == "country", country).when(capital.between(2, 4), seat).when(town, size)
    zoom = (
        F.when(place == "country", country).when(place == "town", F.when(pop > 8000, 7).otherwise(8))
        .when(place == "village", F.when(pop > 2000, 9).otherwise(10)).otherwise(lookup(place, PLACE_ZOOM, 13))
    )
    return F.struct(capital.alias("capital"), rank.cast("int").alias("rank"), zoom.cast("int").alias("minzoom"))


def names(t: Column, preferred: str | None = None, main_key: str = "name:latin", default_key: str | None = "name_int", languages: Sequence[str] = ()) -> list[Column]:
    """Name attributes: the preferred language if there, the plain name, and other languages where they differ."""
    name = find(t, "name")
    out, written = [], name
    if preferred:
        own, has = find(t, f"name:{preferred}"), holds(t, f"name:{preferred}")
        out.append(A.attribute(main_key, F.when(has, own).otherwise(name)))
        written = F.when(has & (own == name), own).otherwise(name)
        if default_key:
            out.append(A.attribute(default_key, F.when(has & (own != name), name)))
    else:
        out.append(A.attribute(main_key, name))
    for lang in languages:
        own = find(t, f"name:{lang}")
        own = F.when(own == "", name).otherwise(own)
        out.append(A.attribute(f"name:{lang}", F.when(own != written, own)))
    return out


def has_names(t: Column, preferred: str | None = None, languages: Sequence[str] = ()) -> Column:
    out = holds(t, "name")
    for lang in [*([preferred] if preferred else []), *languages]:
        out = out | holds(t, f"name:{lang}")
    return out


def elevation(t: Column) -> tuple[Column, Column]:
    """Whole metres and feet, null without the tag."""
    metre = F.when(find(t, "ele") != "", F.floor(number(find(t, "ele"), 0)))
    return metre, F.floor(metre * FEET)


def brunnel(t: Column) -> Column:
    return (
        F.when((find(t, "bridge") == "yes") | (find(t, "man_made") == "bridge"), "bridge")
        .when(find(t, "tunnel") == "yes", "tunnel").when(find(t, "ford") == "yes", "ford")
    )


def zoom_by_area(area: Column, least: int = 0) -> Column:
    """The zoom from which an area of so many square metres shows: when it exceeds a pixel of the zoom before."""
    out = None
    for z in range(max(least, 6), 14):
        hit = area > ZOOM_METRES[z - 1] ** 2
        out = F.when(hit, z) if out is None else out.when(hit, z)
    return F.lit(14) if out is None else out.otherwise(14)


def building_heights(t: Column) -> tuple[Column, Column]:
    """Height and base in metres, from heights or else floors; an upside-down building stands on its base."""
    height = F.coalesce(number(find(t, "height")), number(find(t, "building:levels")) * FLOOR_HEIGHT, F.lit(FLOOR_HEIGHT))
    base = F.coalesce(number(find(t, "min_height")), number(find(t, "building:min_level")) * FLOOR_HEIGHT, F.lit(0.0))
    return F.when(height < base, height + base).otherwise(height), base


def road_order(t: Column) -> Column:
    """Drawing order: bridges up, tunnels down, then layer, then class."""
    raised = ~find(t, "bridge").isin("", "no")
    sunk = ~find(t, "tunnel").isin("", "no")
    layer = F.greatest(F.least(number(find(t, "layer"), 0), F.lit(7.0)), F.lit(-7.0))
    return F.when(raised, 10).when(sunk, -10).otherwise(0) + layer * 10 + lookup(find(t, "highway"), ROAD_ORDER, 3)


def poi(t: Column, values: dict[str, list[str] | None] | None = None) -> Column:
    """struct(rank, class, subclass) of a point of interest, or null: keys are tried in a fixed order."""
    table, out = values or POI_VALUES, F.lit(None)
    kind = "struct<rank:int,class:string,subclass:string>"
    for key in reversed(POI_KEYS):
        v = find(t, key)
        hit = (v != "") if table.get(key) is None else v.isin(*table[key])
        cls = lookup(v, POI_CLASS, key)
        special = v.isin(*POI_SUBCLASS_KEY)
        sub = F.lit("")
        for word, other in POI_SUBCLASS_KEY.items():
            sub = F.when(v == word, find(t, other)).otherwise(sub)
        made = F.struct(lookup(cls, POI_RANK, 25).cast("int").alias("rank"), F.when(special, v).otherwise(cls).alias("class"), F.when(special, sub).otherwise(v).alias("subclass"))
        out = F.when(hit, made).otherwise(out.cast(kind))
    return out


def remap_external(props: Column, layer: Column) -> Column:
    """Properties of external shapes by their feature class."""
    cla = F.coalesce(props["featurecla"], F.lit(""))
    one = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    return (
        F.when(cla == "Glaciated areas", one("subclass", "glacier")).when(cla == "Antarctic Ice Shelf", one("subclass", "ice_shelf"))
        .when(cla == "Urban area", one("class", "residential")).when(layer == "ocean", one("class", "ocean")).otherwise(props)
    )


def _poi_rule(t: Column, geometry: str, stop: bool) -> Rule:
    p = poi(t)
    level = number(find(t, "level"))
    return Rule(
        p.isNotNull(), F.when(p["rank"] > 4, "poi_detail").otherwise("poi"), geometry,
        [*names(t), A.attribute_integer("rank", p["rank"]), A.attribute("class", p["class"]), A.attribute("subclass", p["subclass"]),
         A.attribute_integer("layer", F.floor(number(find(t, "layer"), 0))), A.attribute_boolean("indoor", find(t, "indoor") == "yes"), A.attribute_integer("level", F.floor(level))],
        stop=stop,
    )


def _aerodrome(t: Column, kind: Column, geometry: str) -> Rule:
    metre, feet = elevation(t)
    cls = F.when(kind.isin(AERODROMES), kind).otherwise("other")
    attrs = [*names(t), A.attribute("iata", find(t, "iata")), A.attribute("icao", find(t, "icao")), A.attribute("class", cls), A.attribute_numeric("ele", metre), A.attribute_numeric("ele_ft", feet)]
    return Rule(find(t, "aeroway") == "aerodrome", "aerodrome_label", geometry, attrs)


def schema_nodes(t: Column) -> list[Rule]:
    """Node rules of the full profile."""
    place, natural, found = find(t, "place"), find(t, "natural"), place_attributes(t)
    metre, feet = elevation(t)
    house = find(t, "addr:housenumber")
    return [
        _aerodrome(t, find(t, "aerodrome"), POINT),
        Rule(house != "", "housenumber", POINT, [A.attribute("housenumber", house)]),
        Rule(
            place != "", "place", POINT,
            [A.attribute("class", place), A.attribute_integer("rank", found["rank"]), A.attribute_integer("capital", found["capital"]),
             A.attribute("iso_a2", F.when(place == "country", find(t, "ISO3166-1:alpha2"))), *names(t)],
            found["minzoom"], stop=True,
        ),
        _poi_rule(t, POINT, False),
        Rule(
            natural.isin("peak", "volcano"), "mountain_peak", POINT,
            [A.attribute_numeric("ele", metre), A.attribute_numeric("ele_ft", feet), A.attribute_integer("rank", F.lit(1)), A.attribute("class", natural), *names(t)],
            stop=True,
        ),
        Rule(natural == "bay", "water_name", POINT, names(t)),
    ]


def transportation(t: Column, when: Column, zoom: Column | int, cls, area: Column, subclass=None, ramp=None, service=None, road=None, square: Column | None = None) -> Rule:
    """A rule of the transportation layer; areas carry few attributes and show by size."""
    line, road = ~area, F.lit(False) if road is None else road
    on = lambda cond, v: F.when(line & cond, v)
    surface = find(t, "surface")
    attrs = [A.attribute("class", _col(cls)), A.attribute_integer("layer", F.floor(number(find(t, "layer"), 0))), A.attribute("brunnel", brunnel(t))]
    if subclass is not None:
        attrs.append(A.attribute("subclass", _col(subclass)))
    if ramp is not None:
        attrs.append(A.attribute_integer("ramp", on(ramp, F.lit(1))))
    if service is not None:
        attrs.append(A.attribute("service", on(F.lit(True), service)))
    attrs += [
        A.attribute_integer("oneway", on(road & find(t, "oneway").isin("yes", "1"), F.lit(1))),
        A.attribute("surface", on(road, F.when(surface.isin(PAVED), "paved").when(surface.isin(UNPAVED), "unpaved")), 12),
        *[A.attribute(k, on(road, find(t, k)), 9) for k in ("access", "bicycle", "foot", "horse")],
        A.attribute_boolean("toll", on(road, find(t, "toll") == "yes"), 9),
        A.attribute_boolean("expressway", on(road & (find(t, "expressway") == "yes"), F.lit(True)), 7),
        A.attribute("mtb_scale", on(road, find(t, "mtb:scale")), 10),
    ]
    shown = _col(zoom)
    if square is not None:
        shown = F.when(area, F.greatest(shown, zoom_by_area(square))).otherwise(shown)
    return Rule(when, "transportation", F.when(area, AREA).otherwise(LINE), attrs, shown, road_order(t))


def schema_ways(t: Column, closed: Column | None = None, square: Column | None = None, admin: Column | None = None) -> list[Rule]:
    """Way rules of the full profile. closed: whether the way is; square: its area; admin: least level of its parents (null: none)."""
    closed = F.col("closed") if closed is None else closed
    square = F.coalesce(F.col("area"), F.lit(0.0)) if square is None else square
    admin = F.col("admin_level") if admin is None else admin
    highway, railway, waterway, landuse = (find(t, k) for k in ("highway", "railway", "waterway", "landuse"))
    natural, leisure, route, transport = (find(t, k) for k in ("natural", "leisure", "route", "public_transport"))
    building, aeroway, man_made, boundary = (find(t, k) for k in ("building", "aeroway", "man_made", "boundary"))
    service, aerial, house = find(t, "service"), find(t, "aerialway"), find(t, "addr:housenumber")
    building = F.when(aeroway.isin(AEROWAY_BUILDINGS), "yes").otherwise(building)
    aeroway = F.when(aeroway.isin(AEROWAY_BUILDINGS), "").otherwise(aeroway)
    landuse = F.when((landuse == "field") | ((landuse == "meadow") & (find(t, "meadow") == "agricultural")), "farmland").otherwise(landuse)
    named = has_names(t)
    name = lambda when, cls, zoom, *more: Rule(when & named, "transportation_name", LINE, [*names(t), A.attribute("class", _col(cls)), *more], zoom)

    own = F.when(boundary == "administrative", number(find(t, "admin_level"), 11))
    level = F.least(F.coalesce(admin, F.lit(11.0)), F.coalesce(own, F.lit(11.0)))
    level_zoom = F.when((level >= 3) & (level < 5), 4).when((level >= 5) & (level < 7), 8).when(level == 7, 10).when(level >= 8, 12).otherwise(0)

    is_road = highway != ""
    raw = F.when(is_road, highway).otherwise(transport)
    building_site = (highway == "construction") & (find(t, "construction") != "")
    raw = F.when(building_site, find(t, "construction")).otherwise(raw)
    path, minor, link = raw.isin(PATHS), raw.isin(MINOR_ROADS), raw.isin(LINKS)
    cls = F.when(path, "path").when(minor, "minor").when(link, F.regexp_replace(raw, "_link$", "")).otherwise(raw)
    cls = F.when(building_site, F.concat(cls, F.lit("_construction"))).otherwise(cls)
    road_zoom = F.when(path, 14).when(minor, 12).otherwise(lookup(raw, ROAD_ZOOM))
    road_area = ((transport == "platform") | (find(t, "area") == "yes")) & closed
    sunk = ~is_road & F.coalesce(number(find(t, "layer")) < 0, F.lit(False))
    on_road = (is_road | (transport == "platform")) & road_zoom.isNotNull() & ~sunk & (~road_area | (cls == "path"))
    ref = find(t, "ref")
    named_road = on_road & ~closed & (named | holds(t, "ref"))
    road_attrs = [
        *names(t), A.attribute("class", cls), A.attribute("network", F.lit("road")), A.attribute("subclass", F.when(path | minor, highway)),
        A.attribute("ref", ref), A.attribute_integer("ref_length", F.when(ref != "", F.length(ref))),
    ]

    rail = lookup(railway, RAILWAYS)
    main = (railway == "rail") & (service == "") & (find(t, "usage") == "main")
    rail_zoom = F.when(main, 8).when(railway.isin("rail", "narrow_gauge") & (service == ""), 10).when((railway == "light_rail") & (service == ""), 11).otherwise(14)

    river = (waterway == "river") & holds(t, "name")
    stream = waterway.isin(WATERWAYS) & ~closed
    dry = A.attribute_integer("intermittent", F.when(find(t, "intermittent") == "yes", 1).otherwise(0))
    wet = (natural == "water") | (leisure == "swimming_pool") | landuse.isin("reservoir", "basin") | waterway.isin(WATER)
    lake = waterway == ""
    no_water = (find(t, "covered") == "yes") | ~closed | (lake & (find(t, "wikidata") == "Q192770"))
    water_class = F.when(lake, "lake").otherwise("river")
    height, base = building_heights(t)

    cover = F.when(landuse != "", landuse).when(natural != "", natural).otherwise(leisure)
    covered = lookup(cover, LANDCOVER)
    use = F.when(cover != "", cover).when(find(t, "amenity") != "", find(t, "amenity")).otherwise(find(t, "tourism"))
    used = covered.isNull() & use.isin(LANDUSE)
    use_zoom = F.when(use == "residential", F.when(square < ZOOM_METRES[8] ** 2, 8).otherwise(zoom_by_area(square))).otherwise(11)
    write_name = covered.isNotNull() | used | (aeroway != "")
    shape = F.when(closed, AREA).otherwise(LINE)
    skip = (
        (find(t, "disused") == "yes") | (highway == "proposed")
        | ((boundary != "") & (find(t, "protection_title") == "National Forest") & (find(t, "operator") == "United States Forest Service"))
    )
    found = place_attributes(t)
    return [
        Rule(skip, None, stop=True),
        Rule(find(t, "place") == "island", "place", CENTROID, [A.attribute("class", F.lit("island")), A.attribute_integer("rank", F.when(F.lit(False), found["rank"])), *names(t)], 10),
        Rule(
            (admin.isNotNull() | (boundary == "administrative")) & (find(t, "maritime") != "yes"), "boundary", LINE,
            [A.attribute_integer("admin_level", level), A.attribute_integer("disputed", F.when(find(t, "disputed") == "yes", 1).otherwise(0))], level_zoom,
        ),
        transportation(t, aerial != "", 12, "aerialway", closed, aerial),
        name(aerial != "", "aerialway", 12, A.attribute("subclass", aerial)),
        transportation(t, on_road, road_zoom, cls, road_area, F.when(path | minor, raw), link, F.when(raw == "service", service), is_road, square),
        Rule(named_road, "transportation_name", LINE, road_attrs, lookup(cls, ROAD_NAME_ZOOM, 14)),
        transportation(t, rail.isNotNull(), rail_zoom, rail, closed, railway, None, service, None, square),
        name(rail.isNotNull(), rail, 14),
        transportation(t, man_made.isin("pier", "bridge"), 13, man_made, closed, square=square),
        transportation(t, route == "ferry", 9, "ferry", closed, square=square),
        name(route == "ferry", "ferry", 12),
        Rule(aeroway != "", "aeroway", shape, [A.attribute("class", aeroway), A.attribute("ref", ref)]),
        _aerodrome(t, find(t, "aerodrome"), CENTROID),
        Rule(stream, F.when(river, "waterway").otherwise("waterway_detail"), LINE, [dry, A.attribute("class", waterway), *names(t), A.attribute("brunnel", brunnel(t))]),
        Rule(waterway.isin("boatyard", "fuel"), "landuse", shape, [A.attribute("class", F.lit("industrial"))], F.when(waterway == "fuel", 14).otherwise(12)),
        Rule(waterway == "dam", "building", shape),
        Rule(stream, F.when(river, "water_name").otherwise("water_name_detail"), LINE, [A.attribute("class", waterway), *names(t)], F.when(river, 0).otherwise(14)),
        Rule(building != "", "building", AREA, [A.attribute_numeric("render_height", height), A.attribute_numeric("render_min_height", base)], zoom_by_area(square)),
        Rule(house != "", "housenumber", CENTROID, [A.attribute("housenumber", house)]),
        Rule(wet & no_water, None, stop=True),
        Rule(wet, "water", AREA, [A.attribute("class", water_class), A.attribute_integer("intermittent", F.when(find(t, "intermittent") == "yes", 1))], zoom_by_area(square)),
        Rule(
            wet & holds(t, "name") & (natural == "water") & ~find(t, "water").isin("basin", "wastewater"), "water_name_detail", CENTROID,
            [*names(t), A.attribute("class", water_class)], zoom_by_area(square),
        ),
        Rule(wet, None, stop=True),
        Rule(
            covered.isNotNull(), "landcover", AREA,
            [A.attribute("class", covered), A.attribute("subclass", F.when(cover == "wetland", find(t, "wetland")).otherwise(cover))], zoom_by_area(square),
        ),
        Rule(used, "landuse", AREA, [A.attribute("class", use)], use_zoom),
        Rule(boundary == "national_park", "park", AREA, [A.attribute("class", boundary), *names(t)]),
        Rule((boundary != "national_park") & (leisure == "nature_reserve"), "park", AREA, [A.attribute("class", leisure), *names(t)]),
        _poi_rule(t, CENTROID, True),
        Rule(((building != "") | write_name) & holds(t, "name"), "poi_detail", CENTROID, [*names(t), A.attribute_integer("rank", F.when(write_name, 6).otherwise(25))]),
    ]


def accept_boundaries(t: Column) -> Column:
    return (find(t, "type") == "boundary") & (find(t, "boundary") == "administrative")


def simple_nodes(t: Column) -> list[Rule]:
    amenity, shop, place = find(t, "amenity"), find(t, "shop"), find(t, "place")
    latin = A.attribute("name:latin", find(t, "name"))
    rank, zoom = lookup(place, {"city": 4, "town": 6}, 9), lookup(place, {"city": 3, "town": 6}, 10)
    return [
        Rule((amenity != "") | (shop != ""), "poi", POINT, [A.attribute("class", F.when(amenity != "", amenity).otherwise(shop)), latin, A.attribute_integer("rank", F.lit(3))]),
        Rule(place != "", "place", POINT, [A.attribute("class", place), latin, A.attribute_integer("rank", rank)], zoom),
    ]


def simple_ways(t: Column) -> list[Rule]:
    highway, waterway, name = find(t, "highway"), find(t, "waterway"), find(t, "name")
    cls = A.attribute("class", F.when(highway.isin("unclassified", "residential"), "minor").otherwise(highway))
    return [
        Rule(highway != "", "transportation", LINE, [cls]),
        Rule((highway != "") & (name != ""), "transportation_name", LINE, [cls, A.attribute("name:latin", name)]),
        Rule(waterway.isin("stream", "river", "canal"), "waterway", LINE, [A.attribute("class", waterway), A.attribute_integer("intermittent", F.lit(0))]),
        Rule(find(t, "natural") == "water", "water", AREA, [A.attribute("class", F.when(find(t, "water") == "river", "river").otherwise("lake"))]),
        Rule(find(t, "building") != "", "building", AREA),
    ]


SIMPLE = Profile(simple_nodes, simple_ways, node_keys=["amenity", "historic", "leisure", "place", "shop", "tourism"])
SCHEMA = Profile(
    schema_nodes, schema_ways,
    node_keys=["addr:housenumber", "aerialway", "aeroway", "amenity", "barrier", "highway", "historic", "leisure", "natural", "office", "place", "railway", "shop", "sport", "tourism", "waterway"],
    accept_relation=accept_boundaries, remap=remap_external, settings={"label_tags": ["ISO3166-1:alpha2"]},
)
COASTLINE = Profile(node_keys=[], remap=remap_external)
PROFILES = {"simple": SIMPLE, "schema": SCHEMA, "coastline": COASTLINE}
