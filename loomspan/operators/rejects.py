"""Rows that fail to parse: every field is kept as text, rules give an array of reasons, empty arrays pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import small

#: The fixed fields of a variant line, in file order.
FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
TAGS = r"^GT(:[A-Z][A-Z0-9_]*)*\z"
BASE_COUNTS = r"^(\.|(\d+|\.)(,(\d+|\.)){1,3})\z"
POSITION = r"^0*[1-9][0-9]*\z"
REFERENCE = r"^[ACGTNacgtn]+\z"
QUALITY = r"^(\.|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\z"


def fields_of(line: Column) -> Column:
    """The tab-separated fields; tabs between double quotes don't separate."""
    marked = F.array_join(F.transform(F.split(line, '"', -1), lambda x, i: F.when(i % 2 == 1, F.translate(x, "\t", "\x01")).otherwise(x)), '"')
    return F.when(~line.contains('"'), F.split(line, "\t", -1)).otherwise(F.transform(F.split(marked, "\t", -1), lambda x: F.translate(x, "\x01", "\t")))


def check_lines(df: DataFrame, file: str = "file_id", line_no: str = "line_no", line: str = "raw_line") -> DataFrame:
    """Each data line of df with its fields as nullable text and `errors`, the reasons why it fails.

    Data lines aren't blank and don't start with `#`; null lines are none. A final carriage return is
    dropped. Reasons, in the order in which they are given: `quoting` (an odd number of double quotes;
    then nothing else is tested), `columns` (not as many fields as the file's first #CHROM line; in a file
    without one, fewer than 8), `tags`, `bsdp`, `fixed` (see the patterns above). Gives (file, line_no, fields, errors); repeated lines stay
    repeated, an empty table gives none, and other columns aren't read."""
    text = F.regexp_replace(F.col(line), "\r\\z", "")
    rows = df.select(F.col(file).alias("__file"), F.col(line_no).alias("__no"), text.alias("__line"))
    heads = rows.filter(F.col("__line").startswith("#CHROM")).groupBy("__file").agg(F.min_by(F.size(F.split("__line", "\t", -1)), "__no").alias("__width"))
    rows = rows.filter((F.trim(F.translate("__line", "\t\r\x0b\x0c", "    ")) != "") & ~F.col("__line").startswith("#"))
    rows = rows.join(small(heads), "__file", "left")
    odd = (F.length("__line") - F.length(F.translate("__line", '"', ""))) % 2 == 1
    rows = rows.select("*", odd.alias("__odd"), F.when(odd, F.split("__line", "\t", -1)).otherwise(fields_of(F.col("__line"))).alias("__f"))
    at = lambda i: F.get(F.col("__f"), F.lit(i))
    rows = rows.select("*", F.split(at(8), ":", -1).alias("__tags"), F.slice("__f", 10, F.greatest(F.size("__f") - 9, F.lit(0))).alias("__calls"))
    size = F.size("__f")
    columns = F.when(F.col("__width").isNotNull(), size != F.col("__width")).otherwise(size < 8)
    tags = at(8).isNotNull() & (~at(8).rlike(TAGS) | (F.size(F.array_distinct("__tags")) < F.size("__tags")) | F.exists("__calls", lambda c: F.size(F.split(c, ":", -1)) > F.size("__tags")))
    place = F.array_position("__tags", "BSDP").cast("int")
    counts = (place > 0) & F.exists("__calls", lambda c: F.coalesce(~F.get(F.split(c, ":", -1), place - 1).rlike(BASE_COUNTS), F.lit(False)))
    fixed = ~(at(1).rlike(POSITION) & at(3).rlike(REFERENCE) & at(5).rlike(QUALITY))
    why = lambda cond, name: F.when(F.coalesce(cond, F.lit(name == "fixed")), F.lit(name))
    # a line of odd quotes has no reliable fields, one of a wrong width no reliable places: later reasons are left out
    errors = F.when(F.col("__odd"), F.array(F.lit("quoting"))).when(F.coalesce(columns, F.lit(False)), F.array(F.lit("columns"))).otherwise(F.array_compact(F.array(why(tags, "tags"), why(counts, "bsdp"), why(fixed, "fixed"))))
    return rows.select(F.col("__file").alias(file), F.col("__no").alias(line_no), F.col("__f").alias("fields"), errors.alias("errors"))


def failed(checked: DataFrame, file: str = "file_id", line_no: str = "line_no") -> DataFrame:
    """(file, line_no, reason): the first reason of each failing line, once per line."""
    bad = checked.filter(F.size("errors") > 0).select(file, line_no, F.get("errors", F.lit(0)).alias("reason"))
    return bad.dropDuplicates([file, line_no])


def loaded(checked: DataFrame, file: str = "file_id", line_no: str = "line_no") -> DataFrame:
    """The valid lines as typed columns, once per line."""
    at = lambda i: F.get(F.col("fields"), F.lit(i))
    good = checked.filter(F.size("errors") == 0)
    cols = [at(i).alias(n) for i, n in enumerate(FIXED)]
    cols[1] = at(1).try_cast("long").alias("pos")
    cols[5] = at(5).try_cast("double").alias("qual")
    return good.select(file, line_no, *cols, F.slice("fields", 10, F.greatest(F.size("fields") - 9, F.lit(0))).alias("calls")).dropDuplicates([file, line_no])
