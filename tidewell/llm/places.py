"""Free-entered place names mapped to a reference list by a pigeonhole segment join, in SQL only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import clean

# Kinds of place by level, with the ways to write them.
KINDS = {
    "admin_1": {"kepulauan": ("kepulauan", "kepul", "kep")},
    "admin_2": {"kabupaten": ("kabupaten", "kabup", "kab"), "kota": ("kotamadya", "kota", "kt")},
    "facility": {
        "puskesmas": ("upt puskesmas", "puskesmas", "puskes", "pusk", "pkm"),
        "klinik": ("klinik pratama", "klinik", "kl"),
        "rumah sakit umum daerah": ("rumah sakit umum daerah", "rs umum daerah", "rumah sakit", "rsud", "rs"),
    },
}
# Short forms of directions at the end of names of admin_1.
DIRECTIONS = {"timur": "tmr|tim", "selatan": "sel|slt", "barat": "brt|bar", "utara": "ut|utr", "tengah": "tgh|teng|tng"}
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūýÿñçš"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuyyncs"
FIELDS = {"admin_1": "admin_1", "admin_2": "admin_2", "facility_name": "facility"}
EDITS = 2


def plain(value: Column) -> Column:
    """Lower case, no accents, brackets or marks; ``X, Kab.`` turned to ``kab x``; digits read as the letters they resemble."""
    v = F.translate(F.lower(value), ACCENTED, PLAIN)
    v = F.regexp_replace(v, r"\p{M}", "")
    v = F.regexp_replace(v, r"\([^)]*\)?", " ")
    v = F.regexp_replace(v, r"[^a-z0-9,]+", " ")
    v = F.regexp_replace(v, r"^[ ,]+|[ ,]+$", "")
    v = F.regexp_replace(v, r"^([^,]*),(.*)$", "$2 $1")
    v = F.trim(F.regexp_replace(v, r"[ ,]+", " "))
    v = F.regexp_replace(v, "^r s u d ", "rsud ")
    v = F.regexp_replace(v, "^(propinsi|provinsi|prov) ", "")
    return F.translate(v, "01345789", "oieastbg")


def _kind(word: Column, level: str) -> Column:
    out = F.lit("")
    for kind, words in KINDS[level].items():
        out = F.when(word.isin(*words, *[w.replace(" ", "") for w in words]), kind).otherwise(out)
    return out


def readings(value: Column, level: str) -> Column:
    """array<struct<kind, core>>: the kind of place and the name without it and without spaces.

    A kind written without a space before the name gives a second reading.
    """
    words = sorted((w for several in KINDS[level].values() for w in several), key=len, reverse=True)
    apart = "^(" + "|".join(words) + ") (.+)$"
    glued = "^(" + "|".join(w.replace(" ", "") for w in words if len(w) > 2) + ")(.{4,})$"
    v = plain(value)
    if level == "admin_1":
        for whole, short in DIRECTIONS.items():
            v = F.regexp_replace(v, f" ({short})$", f" {whole}")

    def read(v: Column, w: Column) -> Column:
        first = F.struct(_kind(F.regexp_extract(v, apart, 1), level).alias("kind"), F.regexp_replace(F.regexp_extract(v, apart, 2), " ", "").alias("core"))
        bare = F.struct(F.lit("").alias("kind"), w.alias("core"))
        second = F.struct(_kind(F.regexp_extract(w, glued, 1), level).alias("kind"), F.regexp_extract(w, glued, 2).alias("core"))
        return F.when(v.rlike(apart), F.array(first)).when(w.rlike(glued), F.array(bare, second)).otherwise(F.array(bare))

    # one element, so that the text is bound to a variable and prepared once
    bound = F.transform(F.array(v), lambda v: F.struct(v.alias("v"), F.regexp_replace(v, " ", "").alias("w")))
    return F.flatten(F.transform(bound, lambda x: read(x["v"], x["w"])))


def entries(reference: DataFrame) -> DataFrame:
    """(level, kind, core, place_id) of every name and former name of the reference list."""
    names = reference.select(
        F.col("place_level").alias("level"), "place_id", F.explode(F.concat(F.array("place_name"), F.split(F.coalesce("aliases", F.lit("")), r"\|"))).alias("name")
    ).where("trim(name) <> ''")
    return _by_level(names, "name").select("level", "r.kind", "r.core", "place_id").where("core <> ''").distinct()


def _by_level(df: DataFrame, name: str) -> DataFrame:
    r = None
    for level in KINDS:
        r = F.when(F.col("level") == level, readings(F.col(name), level)) if r is None else r.when(F.col("level") == level, readings(F.col(name), level))
    return df.withColumn("r", F.explode(r))


def allowed_edits(core: Column) -> Column:
    """Edits within which names count as the same: none up to three letters, one up to six, else EDITS."""
    n = F.length(core)
    return F.when(n <= 3, 0).when(n <= 6, 1).otherwise(EDITS)


# k = 2 edits leave one of three segments of the reference name untouched. Segment i of a name of
# length n begins at i * (n div 3); it can sit at most i places off, and no further off from the
# right than the edits that the segments after it can hold.
_SEGMENTS = """transform(case when n < 3 then array(0) else array(0, 1, 2) end, i -> named_struct('length', n, 'place', i,
  'part', substring(core, i * (n div 3) + 1, case when n < 3 or i = 2 then n else n div 3 end)))"""
_PROBES = """flatten(transform(sequence(greatest(1, n - 2), n + 2), m -> flatten(transform(case when m < 3 then array(0) else array(0, 1, 2) end, i ->
  transform(filter(sequence(-2, 2), s -> s between greatest(-i, n - m - (2 - i)) and least(i, n - m + (2 - i))
    and i * (m div 3) + s >= 0 and i * (m div 3) + s + case when m < 3 then m when i = 2 then m - 2 * (m div 3) else m div 3 end <= n),
  s -> named_struct('length', m, 'place', i, 'part', substring(core, i * (m div 3) + s + 1, case when m < 3 then m when i = 2 then m - 2 * (m div 3) else m div 3 end)))))))"""


def near_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(level, core, kind, place_id, edits): every known name within the allowed edits of each name.

    ``names`` has (level, core). Equality join on (level, length, place, part) of the segments,
    verified with levenshtein. No pair is lost for names of three letters or more: see _SEGMENTS.
    """
    parts = known.select("level", "kind", F.col("core").alias("known"), "place_id", F.length("core").alias("n"), "core").select("level", "kind", "known", "place_id", F.explode(F.expr(_SEGMENTS)).alias("s"))
    probes = names.select("level", "core").distinct().withColumn("n", F.length("core")).where("n > 0").select("level", "core", F.explode(F.array_distinct(F.expr(_PROBES))).alias("s"))
    met = probes.join(parts, ["level", "s"]).select("level", "core", "known", "kind", "place_id").distinct()
    return met.withColumn("edits", F.levenshtein("core", "known", EDITS)).where((F.col("edits") >= 0) & (F.col("edits") <= allowed_edits(F.col("known")))).drop("known")


def match_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(level, value, places): the places each distinct value can mean, several where a name is not unique.

    ``values`` has (level, value), repeated or not. Only names with the fewest edits count, of these
    the ones of the stated kind if there are any. Values without a place are absent: an anti-join
    with the input lists them. Null and blank values are left out.
    """
    distinct = values.where(clean("value") != "").distinct()
    read = _by_level(distinct, "value").select("level", "value", F.col("r.kind").alias("said"), "r.core")
    near = near_names(read, entries(reference))
    ranked = read.join(near, ["level", "core"]).select(
        "level", "value", F.struct("edits", F.when(F.col("said") == F.col("kind"), 0).when(F.col("said") == "", 0).otherwise(1).alias("other")).alias("rank"), "place_id"
    )
    # at most as many places in a list as share a name
    best = ranked.groupBy("level", "value").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["level", "value", "rank"]).groupBy("level", "value").agg(F.array_sort(F.collect_set("place_id")).alias("places"))


def map_places(df: DataFrame, reference: DataFrame, key: str = "silver_observation_id") -> DataFrame:
    """(key, field_name, value, place_id) for each value of admin_1, admin_2 and facility_name that is not blank.

    place_id is 0 where the reference list has no such place. Where a name fits several places, one
    whose parents or children agree with what the other fields of the row can mean is taken (the
    place above counts most), then the smallest id. Rows are told apart by key and values, so rows that share a
    key, null keys included, are each resolved by themselves and none is dropped.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(level).alias("level"), F.col(f).alias("value")) for f, level in FIELDS.items()])
    long = df.select(F.col(key).alias("key"), F.xxhash64(F.col(key), *FIELDS).alias("row"), F.explode(fields).alias("f")).select("key", "row", "f.*").where(clean("value") != "")
    found = match_values(long.select("level", "value"), reference)
    unmatched = long.join(found, ["level", "value"], "left_anti").select("key", "field_name", "value", F.lit(0).cast("long").alias("place_id"))
    # the list of places with the places above them: as long as the reference list
    up = reference.select(F.col("place_id").alias("id"), F.col("parent_id").alias("parent"))
    above = reference.select("place_id", "parent_id").join(up, F.col("parent_id") == F.col("id"), "left").select("place_id", F.coalesce("parent_id", F.lit(-1)).alias("up_1"), F.coalesce("parent", F.lit(-1)).alias("up_2"))
    options = found.select("level", "value", F.explode("places").alias("place_id")).join(above, "place_id").groupBy("level", "value").agg(F.array_sort(F.collect_list(F.struct("place_id", "up_1", "up_2"))).alias("options"))
    met = long.join(options, ["level", "value"])
    # equal rows are one group with a number, reduced map-side
    rows = met.groupBy("key", "row").agg(F.collect_set(F.struct("field_name", "value", "options")).alias("all"), F.count(F.lit(1)).alias("n"))
    pick = F.expr("""explode(flatten(array_repeat(transform(all, a -> named_struct('field_name', a.field_name, 'value', a.value, 'place_id', case when size(a.options) = 1 then a.options[0].place_id else
      array_min(transform(a.options, o -> named_struct('worse', -(
        4 * int(exists(all, b -> exists(b.options, p -> p.place_id = o.up_1)))
        + 2 * int(exists(all, b -> exists(b.options, p -> p.place_id = o.up_2)))
        + int(exists(all, b -> exists(b.options, p -> p.up_1 = o.place_id or p.up_2 = o.place_id)))), 'place_id', o.place_id))).place_id end)), cast(n / size(all) as int))))""")
    matched = rows.select("key", pick.alias("c")).select("key", "c.field_name", "c.value", "c.place_id")
    return matched.unionByName(unmatched).withColumnRenamed("key", key)


def free_entries(df: DataFrame, reference: DataFrame) -> DataFrame:
    """(silver_observation_id, field_name, place_id) of the values that are not letter for letter a name of their level."""
    mapped = map_places(df, reference)
    levels = F.element_at(F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair]), F.col("field_name"))
    names = reference.select(F.col("place_level").alias("level"), F.col("place_name").alias("value")).distinct()
    return mapped.withColumn("level", levels).join(names, ["level", "value"], "left_anti").select("silver_observation_id", "field_name", "place_id")
