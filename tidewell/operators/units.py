"""Quantities recorded in different units, converted to the common unit of a reference table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which a quantity is reported.
QUANTITY_NAMES = {
    "cases": ("cases", "jumlah_kasus"),
    "incidence_rate": ("incidence_rate", "angka_kesakitan"),
    "rainfall": ("rainfall", "curah_hujan"),
    "mean_temperature": ("mean_temperature", "suhu_rata_rata"),
    "area": ("area", "luas_wilayah"),
    "population": ("population", "jumlah_penduduk"),
    "larva_free_index": ("larva_free_index", "angka_bebas_jentik"),
    "larvicide_used": ("larvicide_used", "pemakaian_larvasida"),
    "response_delay": ("response_delay", "waktu_respons"),
}

# Spellings of each unit, after ``spelling``.
UNIT_NAMES = {
    ("cases", "cases"): ("cases", "case", "kasus", "orang", "case count", "n", "persons"),
    ("cases", "thousand_cases"): ("thousand cases", "ribu kasus", "x1000 cases", "kasus (ribuan)", "ribu", "thousand", "thousands", "'000", "000s"),
    ("incidence_rate", "per_100k"): ("per 100k", "/100k", "per 100000", "/100000", "per 100000 people", "per 100000 penduduk"),
    ("incidence_rate", "per_10k"): ("per 10k", "/10k", "per10000", "per 10000", "/10000", "per 10000 people", "per 10000 penduduk"),
    ("incidence_rate", "per_1k"): ("per 1k", "/1k", "per 1000", "/1000", "per 1000 people", "per 1000 penduduk", "per mille pop", "per mille"),
    ("incidence_rate", "per_million"): ("per million", "per 1m", "/1m", "per 1000000", "/1000000", "per 1000000 people", "per sejuta penduduk", "per juta"),
    ("rainfall", "mm"): ("mm", "millimetre", "millimetres", "millimeter", "millimeters", "milimeter"),
    ("rainfall", "cm"): ("cm", "centimetre", "centimetres", "centimeter", "centimeters", "sentimeter"),
    ("rainfall", "inch"): ("inch", "inches", "in", "inci", "''", '"', "″", "”"),
    ("mean_temperature", "celsius"): ("celsius", "c", "°c", "deg c", "degc", "derajat c", "derajat celsius"),
    ("mean_temperature", "fahrenheit"): ("fahrenheit", "f", "°f", "deg f", "degf", "derajat f", "derajat fahrenheit"),
    ("mean_temperature", "kelvin"): ("kelvin", "k"),
    ("area", "km2"): ("km2", "km²", "sq km", "kilometer persegi", "square kilometres"),
    ("area", "ha"): ("ha", "hectare", "hectares", "hektar", "hektare"),
    ("area", "m2"): ("m2", "m²", "sq m", "meter persegi", "square metres"),
    ("population", "people"): ("people", "persons", "jiwa", "orang", "penduduk"),
    ("population", "thousand_people"): ("thousand people", "thousand", "thousands", "ribu", "ribu jiwa", "'000", "000s people", "000s"),
    ("population", "million_people"): ("million people", "million", "millions", "juta", "juta jiwa", "mio"),
    ("larva_free_index", "percent"): ("percent", "per cent", "persen", "pct", "%"),
    ("larva_free_index", "proportion"): ("proportion", "proporsi", "prop", "fraction", "fraksi", "0-1"),
    ("larva_free_index", "per_mille"): ("per mille", "per mil", "permil", "permille", "promille", "promil", "‰"),
    ("larvicide_used", "kg"): ("kg", "kilogram", "kilograms"),
    ("larvicide_used", "gram"): ("gram", "grams", "g", "gr"),
    ("larvicide_used", "tonne"): ("tonne", "tonnes", "ton", "tons", "metric ton", "t"),
    ("response_delay", "day"): ("day", "days", "hari", "d"),
    ("response_delay", "hour"): ("hour", "hours", "hrs", "hr", "jam", "h"),
    ("response_delay", "week"): ("week", "weeks", "wk", "minggu", "pekan"),
}

# Fixed values: (least, most, typical) value of a quantity in its common unit, and whether it counts
# things. A value outside speaks for another unit. Quantities not listed never show their unit by size.
USUAL_SIZE = {
    "cases": (0.0, 1e7, 20.0, True),
    "mean_temperature": (-40.0, 50.0, 25.0, False),
    "area": (0.0, 2e6, 500.0, False),
    "population": (5e3, 1e9, 1e5, True),
    "larva_free_index": (1.0, 100.0, 60.0, False),
}

TEXT_UNIT = r"^[^0-9]*[0-9][0-9.,]*\s*(.*)$"
TEXT_NUMBER = r"(-?[0-9][0-9.,]*)"
NOTE_UNIT = r"(?i)^\s*(?:unit of measure|unit|satuan|angka dalam)\s*:\s*(.*)$"
METRIC = "^(" + "|".join(sorted((n for names in QUANTITY_NAMES.values() for n in names), key=len, reverse=True)) + ")(?:_(.+))?$"


def spelling(unit: Column) -> Column:
    """A unit in lower case with single spaces, without separators in numbers and a closing dot; null if blank."""
    u = F.regexp_replace(F.lower(unit), r"[\s_\u00a0]+", " ")
    u = F.regexp_replace(u, r"(?<=\d)[., ](?=\d{3})", "")
    u = F.rtrim(F.regexp_replace(F.trim(u), r"\.$", ""))
    return F.when(u != "", u)


def text_number(text: Column) -> Column:
    """The first number in ``text``. A single comma or dot is a decimal one; of several, those before the last separate thousands, and all do if they are alike."""
    n = F.rtrim(F.regexp_extract(text, TEXT_NUMBER, 1), F.lit(".,"))
    alike = n.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3}){2,}$") | n.rlike(r"^-?[0-9]{1,3}(,[0-9]{3}){2,}$")
    plain = F.when(alike, F.regexp_replace(n, "[.,]", "")).otherwise(F.regexp_replace(F.regexp_replace(n, r"[.,](?=.*[.,])", ""), ",", "."))
    return plain.try_cast("double")


def _lookup(pairs: dict) -> Column:
    """A literal map, built from fixed values (some 150 entries at most)."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


#: Rows of a unit reference (or of source defaults) up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def _spellings(reference: DataFrame) -> DataFrame:
    """(quantity, spelling, unit_code): the fixed spellings of units in ``reference``, and its own codes."""
    fixed = json.dumps([{"quantity": q, "unit_code": code, "spelling": name} for (q, code), several in UNIT_NAMES.items() for name in several])
    listed = F.from_json(F.lit(fixed), "array<struct<quantity:string,unit_code:string,spelling:string>>")
    spellings = reference.sparkSession.range(1).select(F.explode(listed).alias("a")).select("a.quantity", "a.spelling", "a.unit_code").union(reference.select("quantity", spelling(F.col("unit_code")), "unit_code"))
    return spellings.join(reference.select("quantity", "unit_code"), ["quantity", "unit_code"], "left_semi").groupBy("quantity", "spelling").agg(F.min("unit_code").alias("unit_code"))


def source_defaults(df: DataFrame, reference: DataFrame, key: str = "silver_observation_id") -> DataFrame:
    """(source_id, quantity, default_unit): the unit that most rows of a source name for a quantity; ties go to the smaller code."""
    named = harmonise(df, reference, key).where(F.col("unit_origin").isin("field", "text", "note", "metric")).join(df.select(key, "source_id"), key)
    counted = named.groupBy("source_id", "quantity", "unit_code").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("source_id", "quantity").agg(F.max_by("unit_code", F.struct("n", F.lit(0) - F.ascii("unit_code"))).alias("default_unit"))


def harmonise(df: DataFrame, reference: DataFrame, key: str = "silver_observation_id", defaults: DataFrame | None = None) -> DataFrame:
    """(key, quantity, unit_code, unit_origin, common_unit, value_common), one row per row of ``df``.

    ``reference`` has quantity, unit_code, common_unit, factor, shift: one row per unit. The value is value_numeric, or
    the number in value_text where that is null. The unit is the first that can be read
    as one of the quantity's units, from the unit field, after the number in value_text, in the
    note of the provenance, and at the end of the metric name; unit_origin tells which. Failing
    that, a value outside the usual size of its quantity is in the unit that brings it nearest to
    the typical size (origin size), then the unit of its source in ``defaults`` (see ``source_defaults``; none unless given; origin source),
    and any other in the common unit (origin default). Rows
    with an unknown or null metric have null quantity, unit and value; null, NaN and infinite
    values stay as they are. Other columns are ignored.
    """
    names = {name: q for q, several in QUANTITY_NAMES.items() for name in several}
    metric = F.lower(F.trim("metric"))
    parts = df.select(
        F.col(key).alias("key"),
        *([F.col("source_id")] if defaults is not None else []),
        F.coalesce(F.col("value_numeric").cast("double"), text_number(F.col("value_text"))).alias("value"),
        F.element_at(_lookup(names), F.regexp_extract(metric, METRIC, 1)).alias("quantity"),
        spelling(F.col("unit")).alias("by_field"),
        spelling(F.regexp_extract("value_text", TEXT_UNIT, 1)).alias("by_text"),
        spelling(F.regexp_extract(F.get_json_object("provenance", "$.source_record.note"), NOTE_UNIT, 1)).alias("by_note"),
        spelling(F.regexp_extract(metric, METRIC, 2)).alias("by_metric"),
    )
    origins = ("field", "text", "note", "metric")

    def small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    few = reference.count() + (defaults.count() if defaults is not None else 0) <= BROADCAST_ROWS
    coded = parts
    known = _spellings(reference)
    for o in origins:
        one = known.select(F.col("quantity").alias("q"), F.col("spelling").alias("s"), F.col("unit_code").alias("code"))
        coded = coded.join(small(one), (F.col("quantity") == F.col("q")) & (F.col(f"by_{o}") == F.col("s")), "left").withColumn(f"by_{o}", F.col("code")).drop("q", "s", "code")
    units = reference.groupBy(F.col("quantity").alias("q")).agg(F.first("common_unit").alias("common_unit"), F.array_sort(F.collect_list(F.struct("unit_code", "factor", "shift"))).alias("units"))
    coded = coded.join(small(units), F.col("quantity") == F.col("q"), "left").drop("q")
    if defaults is not None:
        usual = defaults.select(F.col("source_id").alias("of"), F.col("quantity").alias("q"), "default_unit")
        coded = coded.join(small(usual), F.col("source_id").eqNullSafe(F.col("of")) & (F.col("quantity") == F.col("q")), "left").drop("of", "q", "source_id")
    else:
        coded = coded.withColumn("default_unit", F.lit(None).cast("string"))
    low, high, typical = (F.element_at(_lookup({q: s[i] for q, s in USUAL_SIZE.items()}), F.col("quantity")) for i in range(3))
    whole = F.col("quantity").isin(*[q for q, s in USUAL_SIZE.items() if s[3]])

    def fits(x: Column) -> Column:
        return x.between(low, high) & (~whole | (F.abs(x - F.round(x)) < 1e-6 * F.greatest(F.lit(1.0), F.abs(x))))

    def converted(u: Column) -> Column:
        return F.col("value") * u["factor"] + u["shift"]

    ranked = F.array_min(
        F.transform(
            F.filter("units", lambda u: converted(u).between(low, high)),
            lambda u: F.struct(F.abs(F.log(F.greatest(F.abs(converted(u)), F.lit(1e-9)) / typical)).alias("far"), u["unit_code"].alias("unit_code")),
        )
    )["unit_code"]
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("value") != 0)
    sized = F.when(finite & low.isNotNull() & ~fits(F.col("value")), F.when(whole & F.col("value").between(low, high), F.lit(None)).otherwise(ranked))
    # a fraction of a thing that is counted is a count of thousands
    thousands = F.when(finite & whole & F.col("value").between(low, high) & ~fits(F.col("value")), F.get(F.filter("units", lambda u: u["factor"] == 1000), 0)["unit_code"])
    named = F.coalesce(*[f"by_{o}" for o in origins])
    chosen = coded.withColumn("sized", F.coalesce(sized, thousands)).select(
        "key",
        "value",
        "quantity",
        "common_unit",
        F.coalesce(named, "sized", "default_unit", "common_unit").alias("unit_code"),
        F.coalesce(*[F.when(F.col(f"by_{o}").isNotNull(), F.lit(o)) for o in origins], F.when(F.col("sized").isNotNull(), "size"), F.when(F.col("default_unit").isNotNull(), "source"), F.when(F.col("quantity").isNotNull(), "default")).alias("unit_origin"),
        F.col("units"),
    )
    used = F.get(F.filter("units", lambda u: u["unit_code"] == F.col("unit_code")), 0)
    return chosen.select(
        F.col("key").alias(key), "quantity", "unit_code", "unit_origin", "common_unit", (F.col("value") * used["factor"] + used["shift"]).alias("value_common")
    )


def recorded_otherwise(df: DataFrame, reference: DataFrame) -> DataFrame:
    """(silver_observation_id, unit_code) of the values recorded in another than the common unit."""
    rows = df.where(F.col("value_numeric").isNotNull())
    return harmonise(rows, reference).where(F.col("unit_code") != F.col("common_unit")).select("silver_observation_id", "unit_code")
