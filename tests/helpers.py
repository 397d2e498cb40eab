"""Schemas from text without a session."""

import re

from pyspark.sql import types as T

SCALARS = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "float": T.FloatType(),
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "decimal(10,2)": T.DecimalType(10, 2), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _split(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def kind(text: str) -> T.DataType:
    if text in SCALARS:
        return SCALARS[text]
    name, inner = re.fullmatch(r"(\w+)<(.*)>", text).groups()
    if name == "struct":
        return schema(inner)
    parts = [kind(x) for x in _split(inner)]
    return T.ArrayType(*parts) if name == "array" else T.MapType(*parts)


def schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind(t)) for n, t in (re.split(r"[ :]", f, maxsplit=1) for f in _split(text))])
