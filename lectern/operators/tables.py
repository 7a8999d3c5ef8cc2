"""Tables to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(content: Column) -> Column:
    text = F.replace(F.coalesce(content, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.trim(F.regexp_replace(text, "\r\n|\n|\r", " "))


def markdown(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, markdown) of ``tables`` (table_id, n_rows, n_cols) and ``cells``.

    Cells (table_id, seq, row, col, row_span, col_span, content) repeat over their
    span, clipped to the table; the later cell wins. Row 0 is the header. A table
    without rows, columns, cells or content gives null.
    """
    covered = cells.join(tables, "table_id").where("n_rows > 0 AND n_cols > 0")
    rows = F.sequence(F.col("row"), F.least(F.col("row") + F.col("row_span"), F.col("n_rows")) - 1)
    cols = F.sequence(F.col("col"), F.least(F.col("col") + F.col("col_span"), F.col("n_cols")) - 1)
    fits = (F.col("row") < F.col("n_rows")) & (F.col("col") < F.col("n_cols")) & (F.col("row_span") > 0) & (F.col("col_span") > 0)
    covered = covered.where(fits).withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols))
    last = covered.groupBy("table_id", "r", "c").agg(F.max_by(escape(F.col("content")), "seq").alias("text"))
    grid = tables.where("n_rows > 0 AND n_cols > 0").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    grid = grid.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))).join(last, ["table_id", "r", "c"], "left")
    line = grid.groupBy("table_id", "n_cols", "r").agg(
        F.sort_array(F.collect_list(F.struct("c", F.coalesce("text", F.lit("")).alias("text")))).alias("cells"),
        F.max(F.coalesce(F.trim("text"), F.lit("")) != "").alias("filled"),
    )
    text = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda x: x["text"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.expr("repeat(' --- |', n_cols)"))
    text = F.when(F.col("r") == 0, F.concat(text, F.lit("\n"), rule)).otherwise(text)
    out = line.select("table_id", "r", "filled", text.alias("text")).groupBy("table_id").agg(
        F.sort_array(F.collect_list(F.struct("r", "text"))).alias("lines"), F.max("filled").alias("filled")
    )
    joined = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    made = out.select("table_id", F.when(F.col("filled"), joined).alias("markdown"))
    return tables.select("table_id").join(made, "table_id", "left")
