"""Row operations: finding, changing, sorting and aggregating rows; each gives a new DataFrame.

Values are compared as the row language compares them: numbers to within 1e-12, anything
else by its text, so that the text "1" equals the number 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StructType


def matches(column: Column, value) -> Column:
    """Loose equality of a column and a plain value."""
    if value is None:
        return column.isNull()
    text = F.coalesce(column.cast("string") == F.lit(str(value)), F.lit(False))
    try:
        number = float(value)
    except (TypeError, ValueError):
        return text
    near = F.abs(column.try_cast("double") - number) <= 1e-12
    return text | F.coalesce(near, F.lit(False))


def find_many(df: DataFrame, **conditions) -> DataFrame:
    for name, value in conditions.items():
        df = df.where(matches(df[name], value))
    return df


def find_rows(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(matches(df[key], value))


def add_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def delete_rows(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(~matches(df[key], value))


def update_rows(df: DataFrame, key: str, value, **patch) -> DataFrame:
    hit = matches(df[key], value)
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(df[c] if c in df.columns else F.lit(None)) for c, v in patch.items()})


def delete_cascade(parents: DataFrame, dependents: DataFrame, parent_key: str, dependent_key: str, value) -> tuple[DataFrame, DataFrame]:
    return delete_rows(parents, parent_key, value), delete_rows(dependents, dependent_key, value)


def sort_rows(df: DataFrame, key: str, direction: str = "asc", order: str | None = None) -> DataFrame:
    """Sorted by key: numbers as such, texts, among them those of a CSV file, by their bytes; ``order``, a column with the rows' input order, settles ties; a missing key raises."""
    if direction not in ("asc", "desc"):
        raise ValueError("a direction is asc or desc")
    there = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is missing")).cast(df.schema[key].dataType)).otherwise(F.col(key))
    by = there.desc() if direction == "desc" else there.asc()
    return df.orderBy(by, *([F.col(order)] if order else []))


def search_rows(df: DataFrame, key: str, query: str) -> DataFrame:
    return df.where(F.contains(F.lower(df[key].cast("string")), F.lit(query.lower())))


def distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values with the place where each comes first."""
    return df.where(df[key].isNotNull()).groupBy(key).agg(F.min(order).alias("first_seen"))


def paginate(df: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit can't be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def aggregates(df: DataFrame, asked: dict[str, tuple[str, str | None]]) -> DataFrame:
    """One row, from one pass: for each name count, sum, average, min or max of a field; a missing or non-numeric value, and (but for count) an empty table, raise."""
    out = []
    for name, (operation, key) in asked.items():
        if operation == "count":
            out.append(F.count(F.lit(1)).alias(name))
            continue
        number = df[key].try_cast("double")
        good = (F.count(number) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0)
        value = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}[operation](number)
        out.append(F.when(good, value).otherwise(F.raise_error(F.lit(f"{operation} needs numbers in every row, and a row")).cast("double")).alias(name))
    return df.agg(*out)


def aggregate(df: DataFrame, operation: str, key: str | None = None) -> DataFrame:
    return aggregates(df, {operation: (operation, key)})


def insert_unique(df: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """df with those of rows whose key isn't there yet; without a key, whole rows count."""
    on = list(key or rows.columns)
    known = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]).distinct()
    same = [rows[c].eqNullSafe(known[f"_k{i}"]) for i, c in enumerate(on)]
    return df.unionByName(rows.dropDuplicates(on).join(known, same, "left_anti"))


def change_one(df: DataFrame, conditions: dict, patch: dict | None = None) -> tuple[DataFrame, dict]:
    """Updates the one row that matches (deletes it without a patch); otherwise df as it was, and the problem."""
    hit = F.lit(True)
    for name, value in conditions.items():
        hit = hit & matches(df[name], value)
    n = df.where(hit).limit(2).count()
    if n != 1:
        return df, {"matched": n, "modified": 0, "deleted": 0, "problem": "NotFound" if not n else "MultipleMatches"}
    if patch is None:
        return df.where(~hit), {"matched": 1, "modified": 0, "deleted": 1, "problem": None}
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(df[c]) for c, v in patch.items()}), {"matched": 1, "modified": 1, "deleted": 0, "problem": None}


def value_text(c: Column, t) -> Column:
    """A value as facts have it: nil, numbers and flags plain, texts quoted, [members] and {name: value}."""
    if isinstance(t, StructType):
        parts = [F.concat(F.lit(f"{f.name}: "), value_text(c[f.name], f.dataType)) for f in t]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(t, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: value_text(x, t.elementType)), ", "), F.lit("]"))
    elif isinstance(t, NumericType | BooleanType):
        text = c.cast("string")
    else:
        text = c.cast("string")
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        text = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(c.isNull(), "nil").otherwise(text)


def fact_text(df: DataFrame, fact_type: str) -> DataFrame:
    """One line per row: Type(field: value, ...); nulls as nil, text quoted, records and arrays nested."""
    parts = [F.concat(F.lit(f"{f.name}: "), value_text(F.col(f.name), f.dataType)) for f in df.schema if f.name != "_type"]
    return df.select(F.concat(F.lit(f"{fact_type}("), F.concat_ws(", ", *parts), F.lit(")")).alias("value"))
