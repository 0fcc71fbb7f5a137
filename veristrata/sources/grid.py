"""Weekly schedule grids (people x days) as one record per person and day, from pages of cells or of text."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.functions import schedule
from veristrata.functions.normalize import simplify

PAGES = "file string, page int, text string, rows array<array<string>>"
# Headings of the columns that hold names and roles.
NAME_HEADS = ("staff", "name", "employee", "staff name", "employee name")
ROLE_HEADS = ("role", "title", "position", "job", "discipline")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, text, rows) of every page; needs pdfplumber on the executors.

    Rows are those of ruled tables, else of tables aligned by text; a file is the unit of parallelism.
    """

    def run(batches):
        import pdfplumber

        by_text = {"vertical_strategy": "text", "horizontal_strategy": "text"}
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with pdfplumber.open(io.BytesIO(data)) as pdf:
                    for k, page in enumerate(pdf.pages, 1):
                        tables = page.extract_tables() or page.extract_tables(by_text) or []
                        rows = [[c or "" for c in r] for t in tables for r in t]
                        yield pa.RecordBatch.from_pylist([{"file": name, "page": k, "text": page.extract_text() or "", "rows": rows}], pa.schema([("file", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PAGES)


def weekly_grid(pages: DataFrame, as_of: str, places: list[str] | None = None) -> DataFrame:
    """file, row_num, locator, staff_name, role, facility, date, shift, hours, start, leave, problem.

    Pages are (file, page, text, rows); where no row has three day headings the lines of the
    text are used. A heading holds for the rows below it up to the next one of its page, and
    a page without one gives no records. With places the facility is one of them, else the
    page's heading.
    """
    ruled = F.transform("rows", lambda r, i: F.named_struct(F.lit("at"), i, F.lit("cells"), F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))))
    ruled = F.coalesce(ruled, F.array().cast("array<struct<at:int,cells:array<string>>>"))
    days_in = lambda cells: F.size(F.filter(cells, lambda c: c.rlike(schedule.DAY)))
    usable = F.exists(ruled, lambda r: schedule.n_days(F.array_join(r["cells"], " ")) >= 3)
    facility = schedule.place(F.col("text"), places) if places else schedule.page_heading(F.col("text"))
    lines = pages.select("file", "page", F.coalesce(facility, F.lit("")).alias("facility"), schedule.legend(F.coalesce("text", F.lit(""))).alias("legend"), F.explode(F.when(usable, ruled).otherwise(schedule.text_rows(F.col("text")))).alias("r"))
    lines = lines.select("file", "page", "facility", "legend", F.col("r.at").alias("at"), F.col("r.cells").alias("cells"))
    head = days_in(F.col("cells")) >= 3
    where = lambda names: F.array_max(F.transform("cells", lambda c, i: F.when(simplify(c).isin(*names), i)))
    days = F.filter(F.transform("cells", lambda c, i: F.named_struct(F.lit("i"), i, F.lit("date"), schedule.heading_day(c, as_of), F.lit("label"), c)), lambda x: x["date"].isNotNull())
    second = F.when((F.size("cells") > 1) & ~F.coalesce(F.get("cells", F.lit(1)).rlike(schedule.DAY), F.lit(False)), F.lit(1))
    marked = lines.withColumns({"days": F.when(head, days), "name_at": F.when(head, where(NAME_HEADS)), "role_at": F.when(head, F.coalesce(where(ROLE_HEADS), second))})
    above = Window.partitionBy("file", "page").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = marked.select("file", "page", "facility", "legend", "at", "cells", head.alias("head"), *(F.last(c, ignorenulls=True).over(above).alias(c) for c in ("days", "name_at", "role_at")))
    name = F.get("cells", F.coalesce("name_at", F.lit(0)))
    body = held.filter(~F.col("head") & F.col("days").isNotNull()).withColumn("staff_name", name).filter("staff_name <> '' AND NOT (lower(staff_name) LIKE '%shift%' AND staff_name LIKE '%:%')")
    role = F.coalesce(F.get("cells", F.col("role_at")), F.lit(""))
    each = body.select("file", "page", "at", "facility", "legend", "staff_name", role.alias("role"), "cells", F.explode("days").alias("d"))
    out = each.select("file", (F.col("page") * 1000 + F.col("at")).alias("row_num"), F.concat(F.lit("page "), "page", F.lit(", row "), "at", F.lit(", "), "d.label").alias("locator"), "staff_name", "role", "facility", F.col("d.date").alias("date"), F.coalesce(F.get("cells", F.col("d.i")), F.lit("")).alias("shift"), "legend")
    return out.withColumn("_s", schedule.shift(F.col("shift"), F.col("legend"))).select("file", "row_num", "locator", "staff_name", "role", "facility", "date", "shift", "_s.*")
