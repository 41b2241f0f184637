"""Text and cells to tables: bulletin sentences, dashboard payloads, pinned panels, and tables found by their headers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as t

# How a weekly bulletin reports cases, English and Indonesian: week, year, place, number, disease.
WEEKLY_EN = r"In week (\d{1,2}) of (\d{4}), ([^.,\n]+?) reported ([\d,]+) cases of ([a-z][a-z -]*[a-z])"
WEEKLY_ID = r"Pada minggu ke-(\d{1,2}) tahun (\d{4}), ([^.,\n]+?) melaporkan ([\d.]+) kasus ([a-z][a-z -]*[a-z])"


def weekly_reports(documents: DataFrame) -> DataFrame:
    """(doc_id, language, year, week, week_start, place, disease, cases): every weekly count stated in a text, repeats included.

    Weeks beyond 53 are left out; the week starts on the Monday of the ISO week.
    """
    out = None
    for language, pattern in (("en", WEEKLY_EN), ("id", WEEKLY_ID)):
        found = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("s"))
        part = found.select(
            "doc_id", F.lit(language).alias("language"), F.regexp_extract("s", pattern, 2).cast("int").alias("year"), F.regexp_extract("s", pattern, 1).cast("int").alias("week"),
            F.regexp_extract("s", pattern, 3).alias("place"), F.regexp_extract("s", pattern, 5).alias("disease"), t.digits(F.regexp_extract("s", pattern, 4)).alias("cases"),
        )
        out = part if out is None else out.unionByName(part)
    return out.where("week between 1 and 53").withColumn("week_start", t.iso_week_start(F.col("year"), F.col("week")))


def dashboard_series(df: DataFrame, key: str, labels: str, values: str) -> DataFrame:
    """(key, position, label, value) of parallel label and value arrays; rows whose arrays differ in length are left out whole."""
    zipped = df.where(F.size(labels) == F.size(values)).select(key, F.posexplode(F.arrays_zip(F.col(labels).alias("label"), F.col(values).alias("value"))).alias("position", "z"))
    return zipped.select(key, "position", F.col("z.label").alias("label"), F.col("z.value").alias("value"))


def panel_checks(panel: DataFrame, keys: list[str], metric: str, value: str) -> DataFrame:
    """Wide rows per key with the arithmetic checks between their metrics, and whether any fails.

    Checked where the parts are there: cases per 100,000 of population against incidence_rate (1), deaths per case against
    case_fatality_rate (0.1), and deaths not above cases. Of repeated metrics the largest counts.
    """
    names = ["cases", "deaths", "population", "incidence_rate", "case_fatality_rate"]
    wide = panel.groupBy(*keys).pivot(metric, names).agg(F.max(value))
    checks = {
        "incidence_off": F.abs(F.col("cases") / F.col("population") * 1e5 - F.col("incidence_rate")) > 1,
        "fatality_off": F.abs(F.col("deaths") / F.col("cases") * 100 - F.col("case_fatality_rate")) > 0.1,
        "more_deaths_than_cases": F.col("deaths") > F.col("cases"),
    }
    usable = (F.col("population") > 0) | F.col("population").isNull()
    safe = wide.withColumn("population", F.when(usable, F.col("population"))).withColumn("cases", F.when((F.col("cases") > 0) | F.col("cases").isNull(), F.col("cases")))
    flagged = safe.select(*keys, *names, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    return flagged.withColumn("quarantined", F.col("incidence_off") | F.col("fatality_off") | F.col("more_deaths_than_cases"))


_TIME = re.compile(r"(?i)(?:\b|_)(tahun|year|bulan|month|minggu|week|periode|tanggal|date)(?:\b|_)")
_PLACE = re.compile(r"(?i)(?:\b|_)(provinsi|province|kabupaten|kota|district|kecamatan|puskesmas|facility|wilayah)(?:\b|_)")
_MEASURE = re.compile(r"(?i)(?:\b|_)(kasus|cases?|jumlah|total|kematian|deaths?|angka|rate|persen|percent)(?:\b|_)")
PARSED = "table_key string, header_row int, row_number int, label string, measure string, value double, confidence double"


def _number(text: str) -> float | None:
    text = re.sub(r"[%\s]", "", text)
    if not re.fullmatch(r"[+-]?\d[\d.,]*", text):
        return None
    last = max(text.rfind(","), text.rfind("."))
    if last < 0 or re.fullmatch(r"[+-]?\d{1,3}([.,]\d{3})+", text):
        return float(re.sub(r"[.,]", "", text))
    return float(re.sub(r"[.,]", "", text[:last]) + "." + text[last + 1 :])


def parse_tables(cells: DataFrame, table_key: str) -> DataFrame:
    """Measurements of tables given as cells (table_key, row_number, column_number, value).

    Of the first 25 rows the one that looks most like a header is taken: words for time, place and measures and many
    distinct labels speak for it, numbers against. Columns under measure words give values; the other cells of the row
    make its label. Tables without a measure column give nothing. One table is one group; its cells fit in memory.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = {(int(r), int(c)): str(v) for r, c, v in zip(pdf["row_number"], pdf["column_number"], pdf["value"])}
        rows, columns = sorted({r for r, _ in grid}), sorted({c for _, c in grid})

        def score(r: int) -> float:
            labels = [grid[r, c] for c in columns if (r, c) in grid]
            text = " ".join(labels)
            return 2 * bool(_TIME.search(text)) + 2 * bool(_PLACE.search(text)) + 2 * bool(_MEASURE.search(text)) + min(len(set(labels)), 10) / 10 - 0.25 * sum(_number(x) is not None for x in labels)

        out: list[tuple] = []
        if rows:
            head = max(rows[:25], key=lambda r: (score(r), -r))
            names = {c: grid.get((head, c), "") for c in columns}
            measures = [c for c in columns if _MEASURE.search(names[c])]
            confidence = float(np.clip(0.65 + 0.05 * score(head), 0, 0.99))
            for r in rows:
                if r <= head:
                    continue
                label = " | ".join(grid[r, c] for c in columns if c not in measures and (r, c) in grid)
                for c in measures:
                    value = _number(grid[r, c]) if (r, c) in grid else None
                    if value is not None:
                        out.append((str(pdf[table_key].iloc[0]), head, r, label, names[c], value, confidence))
        return pd.DataFrame(out, columns=["table_key", "header_row", "row_number", "label", "measure", "value", "confidence"])

    return cells.groupBy(table_key).applyInPandas(run, PARSED)


def markdown_cells(documents: DataFrame) -> DataFrame:
    """(table_key, row_number, column_number, value) of the table rows written with bars in a text, rulers left out."""
    lines = documents.select(F.col("doc_id").cast("string").alias("table_key"), F.posexplode(F.split("text", "\n")).alias("row", "line")).where(F.col("line").rlike(r"^\|.*\|$") & ~F.col("line").rlike(r"^[|\s:-]+$"))
    parts = lines.select("table_key", (F.col("row") + 1).alias("row_number"), F.posexplode(F.split(F.expr("trim(both '|' from line)"), r"\|")).alias("place", "v"))
    return parts.select("table_key", "row_number", (F.col("place") + 1).alias("column_number"), F.trim("v").alias("value")).where("value <> ''")
