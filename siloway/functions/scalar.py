"""Scalar expressions: clamps, clock parts of epoch microseconds, labels, classifications. All are JVM-side columns.

Instants are BIGINT microseconds since 1970-01-01 UTC, so no session time zone enters any result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_US, HOUR_US, DAY_US = 60_000_000, 3_600_000_000, 86_400_000_000

#: Bounds of a stay in minutes.
MIN_STAY, MAX_STAY = 30.0, 1440.0

#: Operating shifts: id, first hour, hour after the last (fixed values).
SHIFTS = [("manana", 6, 14), ("tarde", 14, 22), ("noche", 22, 6)]

#: Spanish weekday names, Sunday first (fixed values).
WEEKDAYS = ["domingo", "lunes", "martes", "miércoles", "jueves", "viernes", "sábado"]

#: Alert types to operational categories: ordered patterns, then the default (fixed values).
ALERT_CATEGORIES = [
    ("ESPERA|WAIT", "Espera"),
    ("RECAL|RECAD", "Recalado"),
    ("RECHAZ", "Rechazo"),
    ("CALIDAD|OBSERVAC", "Observación de calidad"),
    ("RECIRCUL", "Recirculación"),
    ("VUELTA|INGRESO", "Vuelta a ingreso"),
    ("DOBLE|DOBLE_PASO", "Doble paso"),
    ("DESVIO|DESVÍO|FUERA_CIRCUITO", "Desvío operativo"),
]
DEFAULT_CATEGORY = "Evento operativo"

#: Products a trip without one is given by hash of its id (fixed values, in this order).
PRODUCTS = ["Soja", "Maíz", "Girasol", "Trigo"]


def micros(ts: str) -> Column:
    """Epoch microseconds of a timestamp column without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def clamp_minutes(x: Column) -> Column:
    """A stay within bounds; null counts as 0 and so becomes the least stay."""
    return F.greatest(F.lit(MIN_STAY), F.least(F.lit(MAX_STAY), F.coalesce(x.cast("double"), F.lit(0.0))))


def hour_of(us: Column) -> Column:
    return F.pmod(F.floor(us / F.lit(HOUR_US)), F.lit(24)).cast("int")


def day_number(us: Column) -> Column:
    """Whole UTC days since 1970-01-01."""
    return F.floor(us / F.lit(DAY_US)).cast("int")


def decimal_hour(us: Column) -> Column:
    """Hour of day with minutes and whole seconds as a fraction."""
    return F.pmod(F.floor(us / F.lit(1_000_000)), F.lit(86_400)).cast("double") / F.lit(3600.0)


def date_of(us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_number(us))


def shift_of(hour: Column) -> Column:
    return F.when((hour >= 6) & (hour < 14), "manana").when((hour >= 14) & (hour < 22), "tarde").otherwise("noche")


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def outlier_class(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a <= 2, "normal").when(a <= 3, "alto_desvio").when(a <= 4, "outlier").otherwise("extremo")


def site_of(name: Column) -> Column:
    """Site id of a free-form plant name; an unknown or missing name is Ricardone."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), " +", "_")
    return F.when(s.contains("san_lorenzo"), "san_lorenzo").when(s.contains("avellaneda"), "avellaneda").otherwise("ricardone")


def severity_of(x: Column) -> Column:
    up = F.upper(x)
    return F.when(up.isin("LOW", "MEDIUM", "HIGH", "CRITICAL"), up).otherwise("LOW")


def status_of(x: Column) -> Column:
    up = F.upper(x)
    return F.when(up.isin("OPEN", "ACKNOWLEDGED", "RESOLVED"), up).otherwise("OPEN")


def alert_category(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for pattern, name in ALERT_CATEGORIES:
        out = out.when(kind.rlike(f"(?i){pattern}"), name)
    return out.otherwise(DEFAULT_CATEGORY)


def normal_code(code: Column) -> Column:
    """A circuit code in upper case with E0n and B0n as En and Bn."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(code, F.lit("")))), "^([EB])0", "$1")


def base_code(code: Column) -> Column:
    """Letter and number that a code starts with; a code of another shape is its own base."""
    base = F.regexp_extract(code, "^([A-Z][0-9]+)", 1)
    return F.when(base != "", base).otherwise(code)


def camera_sector(camera: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(camera, F.lit("")))), "^CAM_", "")


def text_hash(text: Column) -> Column:
    """h = 31 h + code, modulo 2^32, over the characters of a text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(2**32)))


def product_label(raw: Column, trip_id: Column) -> Column:
    """The product that a raw label names, the label capitalised, or one by hash of the trip id."""
    own = F.trim(F.coalesce(raw, F.lit("")))
    out = F.when(own == "", F.element_at(F.array(*[F.lit(p) for p in PRODUCTS]), (text_hash(trip_id) % 4 + 1).cast("int")))
    for p in PRODUCTS:
        out = out.when(F.lower(own).contains(p.lower()), p)
    return out.otherwise(F.concat(F.upper(F.substring(own, 1, 1)), F.substr(own, F.lit(2))))


def iso_week(us: Column) -> Column:
    d = date_of(us)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.weekofyear(d))


def bucket_status(status: Column) -> Column:
    return F.when(status == "VALID_IDEAL", "PERFECT").when(status.isin("VALID_ACCEPTABLE", "VALID_NO_DISCHARGE"), "VALID").otherwise("INVALID")


def path_key(path: Column) -> Column:
    """A path without spaces, dashes and text in parentheses; the path itself if nothing is left, a dash for null."""
    bare = F.regexp_replace(F.regexp_replace(path, "\\([^)]*\\)", ""), "[\\s-]", "")
    return F.coalesce(F.when(bare == "", path).otherwise(bare), F.lit("—"))


def codes_in(text: Column) -> Column:
    """Circuit, lap, and material codes in a text, in upper case and order of appearance."""
    return F.regexp_extract_all(F.upper(text), F.lit("(\\b(?:CIR|VUE|PTD|PTC|MIX)_[A-Z0-9]+(?:_V[0-9]+)?\\b)"), 1)


def sectors_in(text: Column) -> Column:
    """Distinct sector codes S0 to S10 in a text, then those of 'Sector n'."""
    up = F.upper(text)
    codes = F.regexp_extract_all(up, F.lit("(S(?:10|[0-9]))(?=[_\\s,]|$)"), 1)
    named = F.transform(F.regexp_extract_all(up, F.lit("SECTOR\\s*([0-9]{1,2})\\b"), 1), lambda n: n.cast("int"))
    return F.array_distinct(F.concat(codes, F.transform(F.filter(named, lambda n: n <= 10), lambda n: F.concat(F.lit("S"), n.cast("string")))))


def utilisation_band(u: Column) -> Column:
    """Band of occupancy over capacity; null (no capacity) is normal."""
    return F.when(u.isNull(), "normal").when(u >= 1.2, "severe").when(u > 1, "saturated").when(u >= 0.8, "high").otherwise("normal")


def sector_order(sector: Column) -> Column:
    """Number of a sector id S0, S1, ...; ids of another shape come last."""
    n = F.regexp_extract(sector, "^S([0-9]+)$", 1)
    return F.when(n != "", n.cast("int")).otherwise(10_000)


def seeded_random(seed: Column) -> Column:
    x = F.sin(seed * 9999) * 10000
    return x - F.floor(x)


def normal_deviate(u1: Column, u2: Column) -> Column:
    return F.sqrt(-2 * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def first_sector(text: Column) -> Column:
    return F.get(sectors_in(F.coalesce(text, F.lit(""))), F.lit(0))


def truck_sector_code(last_camera: Column, last_sector: Column, current_sector: Column, current_camera: Column) -> Column:
    """The sector code in the newest of a truck's places that names one; null if none does."""
    return F.coalesce(*map(first_sector, (last_camera, last_sector, current_sector, current_camera)))


def mix_tag(token: Column) -> Column:
    """The mix tag that belongs to a CIR_ or VUE_ token; null for other tokens."""
    number = F.regexp_extract(token, "(?i)^(?:CIR|VUE)_([0-9]+_V[0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("MIX_"), number))


def tag_matches(tag: Column, code: Column) -> Column:
    """Whether a tag is a code, or a PTD_ or PTC_ code with something after an underscore."""
    t, c = F.upper(F.trim(tag)), F.upper(F.trim(code))
    return (c != "") & ((t == c) | (c.rlike("^PT[DC]_") & t.startswith(F.concat(c, F.lit("_")))))


def deterministic_pick(values: list[str], key: Column) -> Column:
    """One of the values by the sum of the key's character codes."""
    codes = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), F.ascii)
    at = F.aggregate(codes, F.lit(0), lambda a, c: a + c) % len(values)
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def scatter_x(view: str, hours: Column, days_back: Column) -> Column:
    """The place of an entry on the axis of a day, week or month: hours, day 1 to 7, or week 1 to 5, with their fractions."""
    at = round_half_up(hours * 100) / 100
    if view == "day":
        return at
    if view == "week":
        return F.greatest(F.lit(1), F.least(F.lit(7), 7 - days_back)) + at / 24
    week = 5 - F.floor(days_back / 7)
    return F.greatest(F.lit(1), F.least(F.lit(5), week)) + (days_back % 7) / 7 + at / 24 / 7


def day_range(last_day: Column | int, period: str) -> tuple[Column, Column]:
    """[start, end) in microseconds of the day, the seven or the thirty days up to the end of a day (days since 1970)."""
    end = (F.lit(last_day) + 1).cast("long") * DAY_US
    return end - {"last_day": 1, "last_week": 7, "last_month": 30}[period] * DAY_US, end


def safe_file_name(prefix: Column, stamp: Column, extension: str) -> Column:
    """A file name of the letters, digits, - and _ of a prefix in lower case, with a time stamp."""
    return F.concat(F.lower(F.regexp_replace(prefix, "[^a-zA-Z0-9_-]", "_")), F.lit("_"), stamp, F.lit("." + extension))


def export_subtitle(plant: Column, period: Column, generated: Column) -> Column:
    """The parts of a subtitle that are there, with their names."""
    named = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in (("Planta", plant), ("Período", period), ("Generado", generated))]
    return F.concat_ws(" | ", *named)


def cargo_form(raw: Column) -> Column:
    up = F.upper(raw)
    return F.when(up.isin("SOLID", "LIQUID"), up).otherwise("UNKNOWN")
