"""JSON and scores in model answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .geometry import clip

NUMBER = r"[-+]?\d*\.?\d+"


def unfenced(text: Column) -> Column:
    """A text without the code fence around it."""
    return F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", "")


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text that parses; braces inside strings don't count."""
    import json

    at = (text or "").find("{")
    while at >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if quoted:
                escaped, quoted = (not escaped and c == "\\"), not (c == '"' and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        json.loads(text[at : i + 1])
                        return text[at : i + 1]
                    except ValueError:
                        break
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def json_object(texts: pd.Series) -> pd.Series:
    """The first JSON object in each text, a batch at a time."""
    return texts.map(first_object)


def score(text: Column, field: str = "s2d_score") -> Column:
    """A score in [0.01, 0.99] from an answer: the field of its JSON, a number inside a string, or what is left of an
    answer that was cut off; null without one. No number is taken from free prose."""
    whole = F.get_json_object(unfenced(text), f"$.{field}")
    found = F.nullif(F.regexp_extract(F.coalesce(whole, F.lit("")), NUMBER, 0), F.lit(""))
    cut = F.nullif(F.regexp_extract(text, rf"[\"']{field}[\"']\s*:\s*[\"']?({NUMBER})", 1), F.lit(""))
    return clip(F.coalesce(found, cut).try_cast("double"), 0.01, 0.99)
