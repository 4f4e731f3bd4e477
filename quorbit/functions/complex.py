"""Complex numbers as structs of re and im."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TYPE = "struct<re:double,im:double>"


def is_complex(rows: DataFrame, name: str) -> bool:
    return isinstance(rows.schema[name].dataType, StructType)


def as_complex(x: Column, complex_already: bool) -> Column:
    return x if complex_already else make(x, F.lit(0.0))


def make(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def conjugate(x: Column) -> Column:
    return make(x["re"], -x["im"])


def square(x: Column) -> Column:
    """|x|^2."""
    return x["re"] * x["re"] + x["im"] * x["im"]


def times(x: Column, y: Column) -> Column:
    return make(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"])


def plus(x: Column, y: Column) -> Column:
    return make(x["re"] + y["re"], x["im"] + y["im"])


def scaled(x: Column, factor: Column, of_complex: bool) -> Column:
    """A number, complex or not, by a real one."""
    return make(x["re"] * factor, x["im"] * factor) if of_complex else x * factor


def total(x: Column | str, of_complex: bool) -> Column:
    """The sum of a column, complex or not."""
    x = F.col(x) if isinstance(x, str) else x
    return F.struct(F.sum(x["re"]).alias("re"), F.sum(x["im"]).alias("im")) if of_complex else F.sum(x)


def size(x: Column, of_complex: bool) -> Column:
    """The magnitude."""
    return F.sqrt(square(x)) if of_complex else F.abs(x)
