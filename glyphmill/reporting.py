"""Number and table formatting of reports, on the driver, for results already small."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def number(x, digits: int = 2, missing: str = "---") -> str:
    if x is None or (isinstance(x, float) and not math.isfinite(x)):
        return missing
    return f"{x:,.{digits}f}" if isinstance(x, float) else str(x)


def escape(text: str) -> str:
    from .functions.text import LABEL_ESCAPES

    for a, b in LABEL_ESCAPES:
        text = text.replace(a, b)
    return text


def latex(columns: list[str], rows: list[tuple]) -> str:
    body = [" & ".join(escape(number(v) if not isinstance(v, str) else v) for v in r) + r" \\" for r in rows]
    head = " & ".join(map(escape, columns)) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}"])


#: Fields of results that hold examples; the second has prefixes too.
DETAILS = ("detailed_results", "examples", "generations")
COUNTED = ("generations", "examples")


def without_details(df: DataFrame) -> DataFrame:
    """A result without its example fields, at every depth of its structs; lists of examples leave num_<name>."""
    return df.select(*_kept(df.schema, F.col))


def _kept(schema: StructType, get: Callable[[str], Column]) -> list[Column]:
    out = [F.size(get(n)).cast("long").alias(f"num_{n}") for n in COUNTED if n in schema.names and isinstance(schema[n].dataType, ArrayType)]
    for f in schema.fields:
        if f.name in DETAILS or f.name.startswith("detailed_results_"):
            continue
        c = get(f.name)
        inner = _kept(f.dataType, c.getField) if isinstance(f.dataType, StructType) else []
        out.append((F.when(c.isNotNull(), F.struct(*inner)) if inner else c).alias(f.name))
    return out
