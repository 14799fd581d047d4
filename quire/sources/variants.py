"""Semi-structured JSON as VARIANT: bodies of requests whose fields may lack, nest or be of any type, and results read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text

FIELDS = ("document_id", "question")
OPTIONS = "options"


def parsed(json: Column) -> Column:
    """A VARIANT; null for what isn't JSON, or null, or repeats a key."""
    return F.try_parse_json(json)


def kind(v: Column, path: str = "$") -> Column:
    """The type of the value at a path, as OBJECT, ARRAY, STRING, BIGINT, VOID (JSON's null); null where there is none."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"^\w+", 0)


def keys(v: Column) -> Column:
    """The sorted keys of an object; none of anything else."""
    return F.when(kind(v) == "OBJECT", F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))).otherwise(F.expr("cast(array() as array<string>)"))


def requests(bodies: DataFrame, known: DataFrame, body: str = "body") -> DataFrame:
    """bodies with document_id, question, status as `documents.requests` gives them, and what is in them besides.

    problem: `no JSON`, `no object`, or the first field that is missing or no text, with the type that it has; null if there is none.
    language: the text at options.language; extra: the sorted keys that no request has. A broken body stays in its column.
    A number isn't taken for a text. Columns of bodies are kept.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # The value and its types are columns first, as several expressions read them.
    rows = bodies.withColumn("_v", parsed(quoted(body)))
    rows = rows.withColumn("_kind", kind(F.col("_v"))).withColumns({f"_k_{c}": F.when(F.col("_kind") == "OBJECT", kind(F.col("_v"), f"$.{c}")) for c in FIELDS})
    given = {c: F.when(F.col(f"_k_{c}") == "STRING", F.try_variant_get("_v", f"$.{c}", "string")) for c in FIELDS}
    language = F.when((F.col("_kind") == "OBJECT") & (kind(F.col("_v"), f"$.{OPTIONS}.language") == "STRING"), F.try_variant_get("_v", f"$.{OPTIONS}.language", "string"))
    problem = F.when(F.col("_v").isNull(), "no JSON").when(F.col("_kind") != "OBJECT", "no object")
    for c in FIELDS:
        problem = problem.when(F.col(f"_k_{c}").isNull(), f"{c}: missing").when(F.col(f"_k_{c}") != "STRING", F.concat(F.lit(f"{c}: "), F.lower(f"_k_{c}")))
    extra = F.array_except(keys(F.col("_v")), F.array(*map(F.lit, [*FIELDS, OPTIONS])))
    rows = rows.withColumns({"problem": problem, "language": language, "extra": F.coalesce(extra, F.expr("cast(array() as array<string>)")), "question": given["question"], "document_id": text.document_key(given["document_id"])})
    found = known.select(text.document_key(F.col("document_id")).alias("document_id")).distinct().withColumn("_known", F.lit(True))
    n = F.length("question")
    status = F.when(F.col("problem").isNotNull() | (n < 3) | (n > 500), 422).when(F.col("document_id").isNull(), 400).when(F.col("_known").isNull(), 404).when(text.strip(F.col("question")) == "", 400).otherwise(200)
    out = rows.join(found, "document_id", "left").withColumn("status", status)
    return out.select(*map(quoted, bodies.columns), "document_id", "question", "status", "problem", "language", "extra")


def read_back(rows: DataFrame, schema: T.StructType, json: str = "json") -> DataFrame:
    """The fields of schema from objects in the column json, in place of it; null where a field lacks or is of another type."""
    others = ["`" + c.replace("`", "``") + "`" for c in rows.columns if c != json]
    held = rows.withColumn("_v", parsed(F.col("`" + json.replace("`", "``") + "`")))
    return held.select(*others, *[F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields])
