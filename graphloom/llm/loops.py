"""Loops over the elements of an array that Spark compiles with the rest of a stage.

``functions.transform`` means the same, but Spark 4 interprets its lambda, an object for each operation on each element.  Its typed
datasets loop by another expression, ``MapObjects``, which has generated code.  It has no name among the public functions, so it
is built through the JVM; a remote session (Spark Connect) has no JVM at hand and takes ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote

#: Spark numbers its own loops from 1 on.
_numbers = count(1 << 40)


def each(array: Column, element: str, f: Callable[[Column], Column]) -> Column:
    """``f`` of each element; ``element`` is their type, as DDL.  Elements have to be there: none may be null."""
    if is_remote():
        return F.transform(array, f)
    spark = SparkSession.active()
    jvm = spark._jvm
    made, columns = jvm.org.apache.spark.sql.catalyst.expressions.objects, jvm.org.apache.spark.sql.classic.ExpressionUtils
    number = next(_numbers)
    held = made.LambdaVariable(f"element{number}", jvm.org.apache.spark.sql.types.DataType.fromDDL(element), False, number)
    body = columns.expression(f(_column(columns.column(held)))._jc)
    return _column(columns.column(made.MapObjects(held, body, columns.expression(array._jc), getattr(getattr(jvm.scala, "None$"), "MODULE$"))))


def _column(made) -> Column:
    from pyspark.sql.classic.column import Column as Classic

    return Classic(made)
