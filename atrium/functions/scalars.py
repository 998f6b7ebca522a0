"""Column builders: labels, identifiers, distances. No per-row Python but ``normalize_search_text``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

EARTH_M = 6_371_000.0
#: Length of one degree of latitude on that sphere.
DEGREE_M = EARTH_M * 3.141592653589793 / 180.0


def _digits(pattern: str, text: Column) -> Column:
    """The number that a pattern captures, or null; more than nine digits are no floor."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(F.length(found).between(1, 9), found.cast("int"))


def floor_to_ordinal(label: Column) -> Column:
    """``F<n>`` is n - 1, ``B<n>`` and ``<letters>B<n>`` are -n, ``M<n>`` is n; a trailing F is tolerated, else null."""
    text = F.upper(F.trim(label))
    up, down, mezzanine = (_digits(p, text) for p in ("^F([0-9]+)F?$", "^[A-Z]*B([0-9]+)F?$", "^M([0-9]+)F?$"))
    return F.coalesce(up - 1, -down, mezzanine).cast("double")


def ordinal_to_floor_label(ordinal: Column) -> Column:
    """0 is F1, n is F(n + 1), -n is B(n); a fractional ordinal has no label."""
    n = ordinal.cast("bigint")
    named = F.when(n >= 0, F.concat(F.lit("F"), (n + 1).cast("string"))).otherwise(F.concat(F.lit("B"), (-n).cast("string")))
    return F.when(ordinal == F.floor(ordinal), named)


def _floor_token(token: Column) -> Column:
    """Ordinal of one lower-case token by the spellings of storeys 0 to 60 and basements 1 to 10, or null."""
    storey = F.coalesce(_digits("^([0-9]+)(?:f|fl|floor|階)?$", token), _digits("^(?:f|floor)([0-9]+)$", token))
    # leading zeros are no spelling of a storey
    plain = token.rlike("^(?:f|floor)?(?:0|[1-9][0-9]*)(?:f|fl|floor|階)?$")
    zero = token.isin("0", "f0", "0f", "0fl", "0floor", "floor0")
    up = F.when(zero | token.isin("gf", "g階", "ground"), 0).when(plain & storey.between(1, 60), storey - 1)
    below = F.coalesce(
        _digits("^b([1-9][0-9]*)(?:f|fl|floor)?$", token),
        _digits("^([1-9][0-9]*)b$", token),
        _digits("^bf([1-9][0-9]*)$", token),
        _digits("^地下([1-9][0-9]*)(?:階|f|fl)$", token),
        _digits("^basement([1-9][0-9]*)$", token),
    )
    alias = F.coalesce(_digits("^m([0-9]+)$", token), -_digits("^[a-z]+b([0-9]+)f?$", token))
    return F.coalesce(up, F.when(below.between(1, 10), -below), alias)


def extract_floor_ordinal(value: Column) -> Column:
    """Ordinal named by a free text: its leading token first, then its tokens from the longest."""
    text = F.trim(value)
    leading = F.lower(F.element_at(F.split(text, "[_\\s（(　]+"), 1))
    tokens = F.filter(F.split(F.lower(text), "[_\\-\\s.]+"), lambda t: F.length(t) > 0)
    ranked = F.transform(tokens, lambda t, k: F.struct((-F.length(t)).alias("size"), k.alias("at"), _floor_token(t).alias("ordinal")))
    named = F.filter(F.array_sort(ranked), lambda t: t["ordinal"].isNotNull())
    return F.when(F.length(text) > 0, F.coalesce(F.when(F.length(leading) > 0, _floor_token(leading)), F.try_element_at(named, F.lit(1))["ordinal"])).cast("double")


def _half_width(text: Column) -> Column:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(text, wide, "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def _reduced(text: Column) -> Column:
    kept = F.regexp_replace(F.replace(F.lower(text), F.lit("地下"), F.lit("b")), "[^\\p{L}\\p{N}]", "")
    short = F.regexp_replace(kept, "(?<=[0-9])(?:階|floor|fl|f)$", "")
    bare = F.regexp_replace(short, "^(?:level|lvl|l)(?=[0-9])", "")
    return F.when(F.length(bare) > 0, bare)


def floor_label_candidates(label: Column) -> Column:
    """Sorted comparable forms of a floor label: of the whole and of its first token."""
    plain = _half_width(label)
    first = F.element_at(F.split(F.trim(plain), "\\s+"), 1)
    return F.array_sort(F.array_compact(F.array_distinct(F.array(_reduced(plain), _reduced(first)))))


def normalize_uuid(value: Column) -> Column:
    """Lower-case hyphenated form of a version-4 identifier with or without hyphens, else null."""
    text = F.lower(F.trim(value))
    hyphened = text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    bare = text.rlike("^[0-9a-f]{12}4[0-9a-f]{3}[89ab][0-9a-f]{15}$")
    return F.when(hyphened, text).when(bare, F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def icon_of(path: Column) -> Column:
    """Base name without its extension; a name that only starts with a dot is kept."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.regexp_replace(name, "^(.+)\\.[^.]*$", "$1")


def composite_level_id(document: Column, link: Column, key: Column, name: Column, elevation_m: Column) -> Column:
    """Five parts joined by bars, the elevation in decimetres."""
    parts = [F.coalesce(c, F.lit("")) for c in (document, link, key, name)]
    return F.concat_ws("|", *parts, F.coalesce(F.round(elevation_m * 10).cast("bigint").cast("string"), F.lit("")))


def due_class(due: Column, today: Column) -> Column:
    """``overdue`` before today, ``due_soon`` up to three days ahead, else null."""
    days = F.datediff(due, today)
    return F.when(days < 0, "overdue").when(days <= 3, "due_soon")


@F.pandas_udf(StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def slugify(name: Column) -> Column:
    """Lower-case ASCII letters and digits of the decomposed name, joined by dashes; ``venue`` where none is left.

    Whatever is no such letter parts words, so the mark of a decomposed letter does too (``Café`` is ``cafe``, ``Éa`` is ``e-a``). No built-in decomposes.
    """
    plain = F.regexp_replace(F.lower(_nfkd(name)), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(plain, "^-+|-+$", "")
    return F.when(F.length(trimmed) > 0, trimmed).otherwise("venue")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_search_text(text: Column) -> Column:
    """Compatibility form, lower case, single spaces, no space at the ends. (No built-in has the first.)"""
    return F.trim(F.regexp_replace(F.lower(_nfkc(text)), "\\s+", " "))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres on a sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # above one the root has no arc; a null stays one
    return 2 * EARTH_M * F.nanvl(F.asin(F.sqrt(h)), F.lit(3.141592653589793 / 2.0))


def segment_offset(lon: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Metres from a point to a segment and the clamped share along it, in a plane at the point's latitude."""
    scale = F.cos(F.radians(lat)) * DEGREE_M
    x1, y1, x2, y2 = (ax - lon) * scale, (ay - lat) * DEGREE_M, (bx - lon) * scale, (by - lat) * DEGREE_M
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    share = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / size))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(x1 + share * dx, 2) + F.pow(y1 + share * dy, 2)), share


def vertical_cost_m(kind: Column, floors: Column) -> Column:
    """Metres that a floor change costs: an elevator 15 and 1 a floor, an escalator 4, stairs 10 a floor."""
    return F.when(kind == "elevator", 15.0 + floors).when(kind == "escalator", 4.0 * floors).when(kind == "stairs", 10.0 * floors)


def meters_to_cost(metres: Column) -> Column:
    return metres * 1000.0


def reproject_3857_to_4326(x: Column, y: Column) -> tuple[Column, Column]:
    """Web Mercator metres to longitude and latitude in degrees."""
    radius = 6_378_137.0
    return F.degrees(x / radius), F.degrees(2 * F.atan(F.exp(y / radius)) - F.lit(3.141592653589793) / 2)


#: Fills of named colours.
COLOR_NAMES = {
    "橙": "#FFC090",
    "トイレ": "#E5E6E6",
    "薄紅": "#FFECE6",
    "緑": "#DDF5D9",
    "濃空": "#C2E5F2",
    "濃鼠": "#C8C9CA",
    "白": "#FFFFFF",
    "薄空": "#C0E0EA",
    "薄鼠": "#A0A1A2",
    "黄": "#F5F5C0",
    "濃紅": "#F2CFC2",
    "ラチ外白": "#FFFFFF",
    "進入制限あり": "#E5E6E6",
    "道白": "#FFFFFF",
}


def unit_color(value: Column) -> Column:
    """Fill of a unit: named colour, literal hex as it is, grey for other text, null for none."""
    named = F.create_map(*[F.lit(x) for pair in COLOR_NAMES.items() for x in pair])
    hexed = F.when(value.rlike("^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"), value)
    return F.when(F.length(value) > 0, F.coalesce(F.try_element_at(named, value), hexed, F.lit("#808080")))


#: Category substrings of building-model features, first match wins.
ROLE_RULES = (
    ("escalator", "escalator"), ("elevator", "elevator"), ("lift", "elevator"), ("stair", "stairs"), ("ramp", "ramp"), ("run", "stairs"),
    ("landing", "stairs"), ("support", "structure"), ("door", "opening"), ("opening", "opening"), ("window", "opening"), ("ceiling", "ceiling"),
    ("roof", "ceiling"), ("floor", "walkable"), ("slab", "walkable"), ("wall", "structure"), ("column", "structure"), ("structural", "structure"),
    ("stair rail", "structure"), ("railing", "structure"), ("room", "public"), ("retail", "public"), ("shop", "public"), ("office", "service"),
    ("mechanical", "service"), ("plumbing", "service"), ("electrical", "service"), ("restricted", "restricted"), ("staff", "restricted"),
)


def semantic_role(category: Column) -> Column:
    """Role of a building-model category; unknown ones are context."""
    low = F.lower(category)
    return F.coalesce(*[F.when(low.contains(needle), role) for needle, role in ROLE_RULES], F.lit("context"))


#: Unit categories of each role; matched whole, any other is public.
UNIT_ROLES = {
    "elevator": ("elevator",),
    "escalator": ("escalator",),
    "stairs": ("stairs", "steps"),
    "ramp": ("ramp", "movingwalkway"),
    "walkable": ("walkway", "pedestrian", "concourse", "corridor", "lobby", "plaza", "footbridge", "parkingcirculation", "platform", "walkwayisland"),
    "service": ("office", "mechanicalroom", "electricalroom", "serverroom", "storage", "structure", "utilityroom", "serviceyard", "loadingdock", "phoneroom", "smokingarea", "laboratory", "kitchen"),
    "restricted": ("nonpublic", "restricted", "unenclosedarea", "road", "parking", "driveway"),
}


def primitive_role(kind: Column, feature_type: Column, category: Column) -> Column:
    """Role of a scene primitive from its kind and the feature that it stands for (null: none).

    A conveyance has a transport role only if the unit's category names one; a surface of a level, or without a category, is context.
    An unknown or null kind gives null.
    """
    of = lambda *roles: F.coalesce(*[F.when(category.isin(*UNIT_ROLES[r]), r) for r in roles])
    surface = F.when(feature_type.isNull() | (feature_type == "level") | category.isNull(), "context").otherwise(F.coalesce(of(*UNIT_ROLES), F.lit("public")))
    moving = F.coalesce(F.when(feature_type.isNotNull(), of("elevator", "escalator", "stairs", "ramp")), F.lit("conveyance"))
    plain = F.when(kind == "wall", "structure").when(kind == "ceiling", "ceiling").when(kind == "portal", "opening")
    return F.coalesce(plain, F.when(kind == "conveyance", moving).when(kind == "surface", surface))


def occlusion_class(role: Column) -> Column:
    return F.when(role == "ceiling", "protected_corridor").when(role.isin("structure", "context"), "context").otherwise("never")


#: Unit categories that people walk on, and those that change floors.
WALKWAYS = ("walkway", "walkway.island", "movingwalkway", "footbridge", "ramp", "steps", "lobby", "platform", "corridor", "sidewalk")
TRANSIT = ("elevator", "escalator", "stairs")


def walkway_class(category: Column) -> Column:
    return F.when(category.isin(*WALKWAYS), "walkway").when(category.isin(*TRANSIT), "transit").otherwise("obstacle")


def wheelchair_access(accessibility: Column) -> Column:
    """An empty list says nothing against it; otherwise ``wheelchair`` must be named."""
    return (F.size(accessibility) == 0) | F.exists(accessibility, lambda x: F.lower(x) == "wheelchair")


def markdown_summary(body: Column) -> Column:
    """First line with text, images removed, spaces collapsed, at most 80 characters; empty where no line has text."""
    plain = F.regexp_replace(F.regexp_replace(body, "\\r\\n?", "\n"), "!\\[[^\\]]*\\]\\([^)\n]*\\)", "")
    first = F.try_element_at(F.filter(F.split(plain, "\n"), lambda x: x.rlike("[^\\s\\p{Zs}]")), F.lit(1))
    line = F.regexp_replace(F.regexp_replace(first, "^[\\s\\p{Zs}]+|[\\s\\p{Zs}]+$", ""), "\\s+", " ")
    # one expression without a branch, so that the body is searched once
    return F.coalesce(F.regexp_replace(line, "(?s)^(.{80}).+$", "$1…"), F.when(body.isNotNull(), ""))


def attachment_refs(body: Column) -> Column:
    """Distinct ids of ``![alt](attachment:<id>)`` in order of first use; an alt text over 300 characters is no reference."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit("!\\[[^\\]]{0,300}\\]\\(attachment:([0-9a-f-]{36})\\)"), F.lit(1)))


def request_hash(*fields: Column) -> Column:
    """SHA-256 of the fields as JSON; pass them in order of name."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


#: Categories of internal codes, by prefix letter and number, with each letter's default.
CATEGORY_CODES = {
    "A": {
        1: "transitstation", 2: "airport", 3: "stadium", 4: "shoppingcenter", 5: "conventioncenter", 6: "governmentfacility", 7: "medicalfacility", 8: "welfare", 9: "communitycenter", 10: "hotel",
        11: "parkingfacility", 12: "university", 13: "theater", 14: "aquarium", 15: "museum", 16: "other", 17: "retailstore", 18: "shoppingcenter", 19: "resort", 20: "themepark", 21: "casino", 22: "other",
        23: "businesscampus", 24: "publictoilet", 999: "other",
    },
    "B": {
        1: "retail", 2: "office", 3: "publicfacility", 4: "waitingroom", 5: "tickets", 6: "information", 7: "restroom.male", 8: "restroom.female", 9: "restroom.unisex", 10: "restroom", 11: "restroom",
        12: "restroom", 13: "restroom", 14: "restroom", 15: "smokingarea", 16: "mothersroom", 17: "firstaid", 18: "room", 19: "room", 20: "opentobelow", 21: "stairs", 22: "elevator", 23: "escalator",
        24: "walkway", 25: "walkway", 26: "nonpublic", 27: "parking", 28: "platform", 29: "walkway",
    },
    "C": {
        1: "column", 2: "bench", 3: "reception", 4: "cubicle", 5: "rubbishbin", 6: "furniture", 7: "kiosk", 8: "obstruction", 9: "vegetation", 10: "wall", 11: "water", 12: "locker", 13: "vendingmachine",
        14: "atm", 15: "stage", 16: "fence", 17: "twsi.hazard", 18: "twsi.guidance", 19: "twsi.crossing", 101: "platform.screen", 102: "platform.gate", 103: "ticket.vending", 104: "ticketgate",
        201: "baggage.carousel", 202: "checkin.kiosk", 999: "unspecified",
    },
}
CATEGORY_DEFAULTS = {"A": "other", "B": "unspecified", "C": "unspecified"}


def map_category_code(raw: Column) -> Column:
    """Category of an internal code (letter and number); a code without an entry gets its letter's default, other text stays."""
    known = F.create_map(*[F.lit(x) for p, rows in CATEGORY_CODES.items() for n, name in rows.items() for x in (f"{p}{n:03d}", name)])
    default = F.create_map(*[F.lit(x) for pair in CATEGORY_DEFAULTS.items() for x in pair])
    code = F.trim(raw)
    return F.when(code.rlike("^[ABC][0-9]+$"), F.coalesce(F.try_element_at(known, code), default[F.substring(code, 1, 1)])).otherwise(raw)
