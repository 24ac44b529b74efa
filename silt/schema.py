"""The fact table, the vocabulary of column meanings, and how columns may be aggregated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

FACT = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("rev", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("loc_added", T.LongType()),
        T.StructField("loc_deleted", T.LongType()),
        T.StructField("binary", T.BooleanType()),
        T.StructField("has_loc", T.BooleanType()),
        T.StructField("ord", T.LongType()),
    ]
)

# Every meaning, and the role it has in aggregation.
ROLES = {
    "commit_id": "identifier",
    "count": "additive",
    "date": "dimension",
    "duration_months": "intensive",
    "filepath": "dimension",
    "flag": "dimension",
    "label": "dimension",
    "loc": "additive",
    "percentage": "intensive",
    "person": "dimension",
    "ratio": "intensive",
    "text": "identifier",
}
SHAPES = ("table", "text")
TYPES = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}


@dataclass(frozen=True)
class Column:
    """One column of an analysis's result; ``gate`` names the flag without which it is absent."""

    name: str
    type: str
    semantic: str
    desc: str
    gate: str = ""

    def __post_init__(self):
        if self.type not in TYPES or self.semantic not in ROLES:
            raise ValueError(f"column {self.name}: unknown type or semantic")

    def field(self) -> T.StructField:
        return T.StructField(self.name, TYPES[self.type], True, {"semantic": self.semantic, "desc": self.desc} | ({"flag_gated": self.gate} if self.gate else {}))


def roles_of(schema: T.StructType) -> dict[str, str]:
    """Column -> role from the columns' metadata; a column of unknown meaning has none."""
    return {f.name: ROLES[s] for f in schema if (s := f.metadata.get("semantic")) in ROLES}
