"""Schemas that drift between the versions of a file: changes, and one consistent table of the raw rows."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import cut_lineage

# Type words by kind, without a length in brackets.
TYPE_WORDS = {
    "whole": ("int", "integer", "bigint", "smallint", "int2", "int4", "int8", "int16", "int32", "int64", "long", "short", "serial"),
    "decimal": ("double", "double precision", "float", "float4", "float8", "float32", "float64", "real", "numeric", "decimal", "number"),
    "text": ("text", "string", "str", "varchar", "char", "character varying", "object"),
    "date": ("date", "timestamp", "datetime", "timestamp without time zone"),
    "boolean": ("bool", "boolean", "logical"),
}
HASHES = 12
SHAPES = 6
#: Likeness from which a pair of columns is a rename.
LEAST = 0.55
#: Weights of the evidence for one content: shape of the values, the values themselves, kind, place among the columns that stay, letters of the name.
WEIGHTS = {"shape": 0.25, "values": 0.25, "kind": 0.1, "place": 0.3, "letters": 0.1}


def column_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")


def type_kind(word: Column) -> Column:
    """whole, decimal, text, date or boolean; null for unknown or missing words."""
    w = F.trim(F.regexp_replace(F.lower(word), r"\s*\([^)]*\)", ""))
    out = F.lit(None).cast("string")
    for kind, words in TYPE_WORDS.items():
        out = F.when(w.isin(*words), kind).otherwise(out)
    return out


def stated_columns(datasets: DataFrame) -> DataFrame:
    """(dataset_id, columns: array<struct<name, kind>>) from the shapes of schema_json; an empty array if it states none.

    Read shapes: {"columns": [{"name", "type"}]}, {"columns": [name]}, {"fields": {name: type}}, {"fields": [...]} and [...].
    """
    text = F.coalesce(F.get_json_object("schema_json", "$.columns"), F.get_json_object("schema_json", "$.fields"), F.col("schema_json"))
    shaped = datasets.select("dataset_id", F.trim(text).alias("t"))
    objects = F.from_json("t", "array<struct<name:string,type:string>>")
    names = F.from_json("t", "array<string>")
    pairs = F.map_entries(F.from_json("t", "map<string,string>"))
    none = F.lit(None).cast("string")
    columns = (
        F.when(F.col("t").rlike(r"^\[\s*\{"), F.transform(objects, lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"))))
        .when(F.col("t").rlike(r'^\[\s*"'), F.transform(names, lambda c: F.struct(c.alias("name"), none.alias("type"))))
        .when(F.col("t").rlike(r'^\{\s*"'), F.transform(pairs, lambda c: F.struct(c["key"].alias("name"), c["value"].alias("type"))))
    )
    none_of = F.array().cast("array<struct<name:string,kind:string>>")
    kinds = F.transform(F.filter(columns, lambda c: c["name"].isNotNull()), lambda c: F.struct(column_name(c["name"]).alias("name"), type_kind(c["type"]).alias("kind")))
    return shaped.select("dataset_id", F.coalesce(kinds, none_of).alias("columns"))


def profiles(records: DataFrame) -> DataFrame:
    """(dataset_id, seen, profile) of the payload columns.

    ``seen`` has the names in their order in the payloads; ``profile`` maps a name to the share of
    numbers and whole numbers among its values, their mean and spread, their mean length, a min-hash sketch of
    HASHES values and one of SHAPES shapes of values (runs of letters and of digits as one). One partial aggregation per (dataset_id, name), so no version is too long.
    """
    cells = records.select("dataset_id", F.posexplode_outer(F.from_json("payload", "map<string,string>")).alias("place", "key", "value")).where("key is not null")
    cells = cells.select("dataset_id", "place", column_name(F.col("key")).alias("name"), F.when(F.trim("value") != "", F.trim("value")).alias("value"))
    number = F.expr("try_cast(replace(value, ',', '.') as double)")
    shape = F.regexp_replace(F.regexp_replace("value", r"\p{L}+", "a"), r"\d+", "9")
    cells = cells.withColumn("number", number).withColumn("shape", shape)
    stats = cells.groupBy("dataset_id", "name").agg(
        F.min("place").alias("place"),
        F.count("value").alias("n"),
        F.count("number").alias("numbers"),
        F.sum(F.when(F.col("number") == F.floor("number"), 1).otherwise(0)).alias("wholes"),
        F.avg("number").alias("mean"),
        F.coalesce(F.stddev_pop("number"), F.lit(0.0)).alias("spread"),
        F.array(*[F.coalesce(F.min(F.xxhash64(F.lit(i), "value")), F.lit(0)) for i in range(HASHES)]).alias("sketch"),
        F.array(*[F.coalesce(F.min(F.xxhash64(F.lit(i), "shape")), F.lit(0)) for i in range(SHAPES)]).alias("shapes"),
        F.coalesce(F.avg(F.length("value")), F.lit(0.0)).alias("chars"),
    )
    entry = F.struct("place", "name", F.struct("n", "numbers", "wholes", "mean", "spread", "sketch", "shapes", "chars").alias("p"))
    # a list as long as the file has columns
    lists = stats.groupBy("dataset_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return lists.select("dataset_id", F.transform("e", lambda e: e["name"]).alias("seen"), F.map_from_entries(F.transform("e", lambda e: F.struct(e["name"], e["p"]))).alias("profile"))


def versions(datasets: DataFrame, records: DataFrame) -> DataFrame:
    """Each version with its columns (from the payloads where schema_json states none) and the version before it."""
    order = Window.partitionBy("dataset_name").orderBy("loaded_at", "dataset_id")
    chain = datasets.select("dataset_id", "dataset_name", "column_count", "loaded_at").withColumn("number", F.row_number().over(order)).withColumn("before", F.lag("dataset_id").over(order))
    chain = chain.withColumn("before", F.when(F.col("dataset_name").isNotNull(), F.col("before")))
    seen = F.transform(F.coalesce("seen", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("kind")))
    columns = F.when(F.size("columns") > 0, F.col("columns")).otherwise(seen)
    own = stated_columns(datasets).join(profiles(records), "dataset_id", "left").select("dataset_id", columns.alias("columns"), "profile")
    return chain.join(own, "dataset_id", "left")


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the bipartite matching with the largest total score (shortest augmenting paths)."""
    turned = score.shape[0] > score.shape[1]
    cost = -(score.T if turned else score)
    n, m = cost.shape
    u, v, of, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while of[j0]:
            used[j0] = True
            i0 = of[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            open_ = np.where(used, np.inf, least)
            open_[0] = np.inf
            j1 = int(open_.argmin())
            delta = open_[j1]
            u[of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            j1 = way[j0]
            of[j0] = of[j1]
            j0 = j1
    pairs = [(of[j] - 1, j - 1) for j in range(1, m + 1) if of[j]]
    return [(j, i) for i, j in pairs] if turned else pairs


def _numbers_like(a: dict, b: dict) -> float:
    """How well two samples of numbers can come from one distribution: their means against the sampling error, and their spreads."""
    error = np.sqrt(a["spread"] ** 2 / a["numbers"] + b["spread"] ** 2 / b["numbers"]) + 0.02 * max(abs(a["mean"]), abs(b["mean"])) + 1e-9
    spread = min(a["spread"], b["spread"]) / (max(a["spread"], b["spread"]) + 1e-9) if max(a["spread"], b["spread"]) > 0 else 1.0
    return float(np.exp(-0.125 * ((a["mean"] - b["mean"]) / error) ** 2)) * (0.5 + 0.5 * float(np.sqrt(spread)))


def _content(a: dict | None, b: dict | None) -> tuple[float, float, float]:
    """(likeness of the kind of values, of their shapes, of the values) of two profiles; undecided where one is missing."""
    if not a or not b or not a["n"] or not b["n"]:
        return 0.5, 0.4, 0.4
    kind = 1 - max(abs(a["numbers"] / a["n"] - b["numbers"] / b["n"]), 0.5 * abs(a["wholes"] / a["n"] - b["wholes"] / b["n"]))
    shape = float(np.mean(np.array(a["shapes"]) == np.array(b["shapes"])))
    if a["numbers"] > 0.5 * a["n"] and b["numbers"] > 0.5 * b["n"]:
        return kind, (shape + kind) / 2, _numbers_like(a, b)
    shared = float(np.mean(np.array(a["sketch"]) == np.array(b["sketch"])))
    length = min(a["chars"], b["chars"]) / max(a["chars"], b["chars"], 1e-9)
    return kind, shape, max(shared, 0.7 * length**2 * shape)


def likeness(old: dict, new: dict, places: int) -> float:
    """Score of a pair of columns: the evidence of WEIGHTS, 0 where both versions state types and these differ."""
    if old["kind"] and new["kind"] and old["kind"] != new["kind"]:
        return 0.0
    kind, shape, values = _content(old["profile"], new["profile"])
    if old["kind"] and new["kind"]:
        kind = 1.0
    place = float(np.exp(-abs(old["before"] - new["before"]) * 2 / max(places, 4) ** 0.5))
    letters = SequenceMatcher(None, old["name"], new["name"]).ratio()
    parts = {"shape": shape, "values": values, "kind": kind, "place": place, "letters": letters}
    return sum(w * parts[k] for k, w in WEIGHTS.items())


def _renames(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                olds, news = row["gone"], row["come"]
                for side in (olds, news):
                    for c in side:
                        c["profile"] = c["profile"] or None
                score = np.array([[likeness(o, n, row["places"]) for n in news] for o in olds])
                out += [(row["dataset_id"], olds[i]["name"], news[j]["name"], float(score[i, j])) for i, j in assign(score) if score[i, j] >= least]
            yield pa.RecordBatch.from_pylist([dict(zip(("dataset_id", "old_name", "new_name", "likeness"), x)) for x in out], schema=pa.schema([("dataset_id", pa.int64()), ("old_name", pa.string()), ("new_name", pa.string()), ("likeness", pa.float64())]))

    return run


def _compared(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all versions: each with the version before it and the names that went and came; those of them with both, described."""
    last = v.select(F.col("dataset_id").alias("before"), F.col("columns").alias("old_columns"), F.col("profile").alias("old_profile"))
    pairs = v.join(last, "before").where(F.size("columns") > 0).where(F.size("old_columns") > 0)

    def names(c: str) -> Column:
        return F.array_distinct(F.transform(c, lambda x: x["name"]))

    def described(names_: Column, columns: str, profile: str) -> Column:
        place = F.transform(columns, lambda x: x["name"])
        stay = F.array_intersect(names("old_columns"), names("columns"))
        return F.transform(
            names_,
            lambda n: F.struct(
                n.alias("name"),
                F.size(F.array_intersect(F.slice(place, 1, F.array_position(place, n).cast("int") - 1), stay)).alias("before"),
                F.filter(columns, lambda x: x["name"] == n)[0]["kind"].alias("kind"),
                F.element_at(profile, n).alias("profile"),
            ),
        )

    compared = pairs.select(
        "dataset_id", "columns", "old_columns", "profile", "old_profile",
        F.array_except(names("old_columns"), names("columns")).alias("gone"), F.array_except(names("columns"), names("old_columns")).alias("come"),
    )
    both = compared.where("size(gone) > 0 and size(come) > 0").select(
        "dataset_id", F.greatest(F.size("columns"), F.size("old_columns")).alias("places"),
        described(F.col("gone"), "old_columns", "old_profile").alias("gone"), described(F.col("come"), "columns", "profile").alias("come"),
    )
    return compared, both


def schema_changes(datasets: DataFrame, records: DataFrame, least: float = LEAST) -> DataFrame:
    """(dataset_id, change_kind, old_name, new_name) against the version before by loaded_at in the same dataset_name.

    added, removed, renamed, retyped and count_mismatch, as stated there. Removed and added columns
    of a version are matched for the largest total likeness (see ``likeness``); pairs of at least
    ``least`` are renames. Names are compared in lower case with underscores. Versions without any known column
    (no schema, no payload) take no part in comparisons, neither as the later nor as the earlier
    one; versions without a dataset_name have none before them; ties of loaded_at follow dataset_id;
    a null column_count is no mismatch.
    """
    return _changes(cut_lineage(versions(datasets, records)), least)


def _changes(v: DataFrame, least: float = LEAST) -> DataFrame:
    compared, both = _compared(v)
    renamed = both.mapInArrow(_renames(least), "dataset_id long, old_name string, new_name string, likeness double")
    empty = F.lit("")
    moved = renamed.groupBy("dataset_id").agg(F.collect_list("old_name").alias("olds"), F.collect_list("new_name").alias("news"), F.collect_list(F.struct(F.lit("renamed").alias("change_kind"), "old_name", "new_name")).alias("renames"))
    changes = F.array().cast("array<struct<change_kind:string,old_name:string,new_name:string>>")

    def change(kind: str, old: Column, new: Column) -> Column:
        return F.struct(F.lit(kind).alias("change_kind"), old.alias("old_name"), new.alias("new_name"))

    retyped = F.filter(
        "columns",
        lambda c: c["kind"].isNotNull() & F.exists("old_columns", lambda o: (o["name"] == c["name"]) & (o["kind"] != c["kind"])) & ~F.exists("old_columns", lambda o: (o["name"] == c["name"]) & (o["kind"] == c["kind"])),
    )
    no = F.array().cast("array<string>")
    listed = compared.join(moved, "dataset_id", "left").select(
        "dataset_id",
        F.explode(
            F.concat(
                F.coalesce("renames", changes),
                F.transform(F.array_except("gone", F.coalesce("olds", no)), lambda n: change("removed", n, empty)),
                F.transform(F.array_except("come", F.coalesce("news", no)), lambda n: change("added", empty, n)),
                F.transform(F.array_distinct(retyped), lambda c: change("retyped", c["name"], c["name"])),
            )
        ).alias("c"),
    )
    counted = v.where((F.col("column_count") != F.size("columns")) & (F.size("columns") > 0)).select("dataset_id", F.lit("count_mismatch").alias("change_kind"), empty.alias("old_name"), empty.alias("new_name"))
    return listed.select("dataset_id", "c.*").unionByName(counted)


def _final_names(v: DataFrame, least: float) -> DataFrame:
    """(dataset_id, dataset_name, columns, later) of every version, ``later`` being the renames of all later versions in order."""
    numbered = v.select("dataset_id", "dataset_name", "number", "columns")
    renames = _changes(v, least).where("change_kind = 'renamed'").join(numbered, "dataset_id").groupBy("dataset_name").agg(F.array_sort(F.collect_list(F.struct("number", "old_name", "new_name"))).alias("renames"))
    none = F.array().cast("array<struct<number:int,old_name:string,new_name:string>>")
    return numbered.join(renames, "dataset_name", "left").select("dataset_id", "dataset_name", "columns", F.filter(F.coalesce("renames", none), lambda r: r["number"] > F.col("number")).alias("later"))


def _followed(name: Column, later: Column) -> Column:
    return F.aggregate(later, name, lambda n, r: F.when(r["old_name"] == n, r["new_name"]).otherwise(n))


def unified_columns(datasets: DataFrame, records: DataFrame, least: float = LEAST) -> DataFrame:
    """(dataset_name, column_name, kind, versions): the columns of the consistent table of each file.

    A column is followed through its renames. kind is the one all versions state; whole and decimal numbers make decimal,
    any other mixture text, and text where none states it. versions counts the versions that have the column. Datasets without a name come out with none.
    """
    return _unified_columns(_final_names(cut_lineage(versions(datasets, records)), least))


def _unified_columns(final: DataFrame) -> DataFrame:
    cells = final.select("dataset_id", "dataset_name", "later", F.explode("columns").alias("c")).select("dataset_id", "dataset_name", _followed(F.col("c.name"), F.col("later")).alias("column_name"), "c.kind")
    kinds = cells.groupBy("dataset_name", "column_name").agg(F.collect_set("kind").alias("kinds"), F.count_distinct("dataset_id").alias("versions"))
    number = (F.size("kinds") > 0) & (F.size(F.array_except("kinds", F.array(F.lit("whole"), F.lit("decimal")))) == 0)
    kind = F.when(F.size("kinds") == 1, F.col("kinds")[0]).when(number, "decimal").otherwise("text")
    return kinds.select("dataset_name", "column_name", kind.alias("kind"), "versions")


def _as_kind(text: Column, kind: Column) -> Column:
    """``text`` in the one spelling of its kind; null where it can't be read as that."""
    number = F.regexp_replace(text, r"^(-?\d+),(\d+)$", "$1.$2").try_cast("double")
    low = F.lower(text)
    flag = F.when(low.isin("true", "t", "yes", "ya", "1"), "true").when(low.isin("false", "f", "no", "tidak", "0"), "false")
    day = F.coalesce(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[ T].*)?$", 1).try_cast("date"), *[F.try_to_date(text, f) for f in ("dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")])
    whole = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string"))
    return F.when(kind == "whole", whole).when(kind == "decimal", number.cast("string")).when(kind == "date", day.cast("string")).when(kind == "boolean", flag).otherwise(F.regexp_replace(text, r"^(-?\d+),(\d+)$", "$1.$2"))


def unified_rows(datasets: DataFrame, records: DataFrame, least: float = LEAST) -> DataFrame:
    """(bronze_record_id, dataset_id, dataset_name, row_number, values, unread, others): the raw rows under the latest name of each column.

    ``values`` maps column names to values in the one kind of the column (see ``unified_columns``): numbers with a decimal point,
    dates as yyyy-mm-dd, true and false; blanks are null. A value that can't be read as that kind is null there and stands as
    written in ``unread``. A column is followed through the renames of all later versions of its file; where several columns
    of a row come to one name, the first value that is not blank is taken and the further ones are kept in ``others``.
    Records without a known dataset keep their own names, as text. Unreadable payloads give null values.
    """
    final = cut_lineage(_final_names(cut_lineage(versions(datasets, records)), least))
    kinds = _unified_columns(final).groupBy(F.col("dataset_name").alias("file")).agg(F.map_from_entries(F.collect_list(F.struct("column_name", "kind"))).alias("kinds"))
    known = final.join(kinds, F.col("dataset_name").eqNullSafe(F.col("file")), "left").select("dataset_id", "dataset_name", "later", "kinds")
    named = records.select("bronze_record_id", "dataset_id", "row_number", F.map_entries(F.from_json("payload", "map<string,string>")).alias("cells")).join(known, "dataset_id", "left")
    later = F.coalesce("later", F.array().cast("array<struct<number:int,old_name:string,new_name:string>>"))
    cells = F.transform("cells", lambda c: F.struct(_followed(column_name(c["key"]), later).alias("name"), F.when(F.trim(c["value"]) != "", F.trim(c["value"])).alias("text")))
    listed = named.withColumn("cells", cells).withColumn("names", F.array_distinct(F.transform("cells", lambda c: c["name"])))

    def texts(n: Column) -> Column:
        return F.transform(F.filter("cells", lambda c: (c["name"] == n) & c["text"].isNotNull()), lambda c: c["text"])

    said = listed.withColumn("said", F.transform("names", lambda n: F.struct(n.alias("name"), texts(n).alias("texts"))))
    read = said.withColumn("read", F.transform("said", lambda x: F.struct(x["name"], F.get(x["texts"], F.lit(0)).alias("text"), _as_kind(F.get(x["texts"], F.lit(0)), F.coalesce(F.element_at("kinds", x["name"]), F.lit("text"))).alias("value"))))
    return read.select(
        "bronze_record_id", "dataset_id", "dataset_name", "row_number",
        F.map_from_entries(F.transform("read", lambda x: F.struct(x["name"], x["value"]))).alias("values"),
        F.map_from_entries(F.transform(F.filter("read", lambda x: x["text"].isNotNull() & x["value"].isNull()), lambda x: F.struct(x["name"], x["text"]))).alias("unread"),
        F.map_from_entries(F.transform(F.filter("said", lambda x: F.size(x["texts"]) > 1), lambda x: F.struct(x["name"], F.slice(x["texts"], 2, F.size(x["texts"]))))).alias("others"),
    )
