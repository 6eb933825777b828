"""Record types: a schema with named orderings, partitioners and reducers.

Orderings are lists of sort columns, partitioners give a bucket expression, reducers an aggregation
that combines records of equal key into one of the same type. `registry()` holds the built-in types;
further ones join by `register`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.text import id_bucket, poly_bucket, poly_bucket_pair


@dataclass
class RecordType:
    name: str
    schema: T.StructType
    describe: str = ""
    orderings: dict[str, list[tuple[str, bool]]] = field(default_factory=dict)
    partitioners: dict[str, Callable[[int], Column]] = field(default_factory=dict)
    reducers: dict[str, dict[str, Callable[[str], Column]]] = field(default_factory=dict)

    def order(self, name: str) -> list[Column]:
        """Sort columns of a named ordering."""
        return [F.col(c).desc() if down else F.col(c).asc() for c, down in self._named(self.orderings, name)]

    def keys(self, name: str) -> list[str]:
        return [c for c, _ in self._named(self.orderings, name)]

    def bucket(self, name: str, buckets: int) -> Column:
        return self._named(self.partitioners, name)(buckets)

    def reduce(self, df: DataFrame, ordering: str, reducer: str) -> DataFrame:
        """One record for each key of the ordering; partial aggregation comes before the exchange."""
        keys, combine = self.keys(ordering), self._named(self.reducers, reducer)
        rest = [c for c in self.schema.names if c not in keys]
        out = df.groupBy(*keys).agg(*[combine.get(c, F.min)(c).alias(c) for c in rest]) if rest else df.select(*keys).distinct()
        return out.select(*self.schema.names)

    def render(self) -> Column:
        """Text of a record, as inspection prints it."""
        return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.schema.names])

    def accepts(self, schema: T.StructType) -> bool:
        """Equal names and types; nullability plays no part."""
        return [(f.name, f.dataType) for f in schema] == [(f.name, f.dataType) for f in self.schema]

    def conform(self, df: DataFrame) -> DataFrame:
        """The type's columns in order and cast; null strings become empty, as records hold no nulls."""
        return df.select(*[(F.coalesce(F.col(f.name).cast(f.dataType), F.lit("")) if isinstance(f.dataType, T.StringType) else F.col(f.name).cast(f.dataType)).alias(f.name) for f in self.schema])

    def _named(self, table: dict, name: str):
        if name not in table:
            raise KeyError(f"{self.name} has no {name}; it has {', '.join(sorted(table)) or 'none'}")
        return table[name]


class Registry:
    """Types by name. Registering a name again changes nothing and returns the first."""

    def __init__(self):
        self.types: dict[str, RecordType] = {}

    def register(self, kind: RecordType) -> RecordType:
        return self.types.setdefault(kind.name, kind)

    def __getitem__(self, name: str) -> RecordType:
        if name not in self.types:
            raise KeyError(f"unknown record type {name}")
        return self.types[name]

    def __contains__(self, name: str) -> bool:
        return name in self.types


def _sorts(*specs: str) -> dict[str, list[tuple[str, bool]]]:
    """'Sort_A_WDesc: a w- b' and the like."""
    out = {}
    for spec in specs:
        name, _, columns = spec.partition(":")
        out[name.strip()] = [(c.rstrip("-"), c.endswith("-")) for c in columns.split()]
    return out


def _built_in() -> list[RecordType]:
    struct = lambda **c: T.StructType([T.StructField(k, v) for k, v in c.items()])
    text, whole, real = T.StringType(), T.LongType(), T.DoubleType()
    by_text = lambda c: lambda n: poly_bucket(F.col(c), n)
    by_id = lambda c: lambda n: id_bucket(F.col(c), n)
    pair = {"Hash_A": by_text("a"), "Hash_B": by_text("b"), "Hash_A_B": lambda n: poly_bucket_pair(F.col("a"), F.col("b"), n), "Hash_B_A": lambda n: poly_bucket_pair(F.col("b"), F.col("a"), n)}
    ids = {"Hash_A": by_id("a"), "Hash_B": by_id("b")}
    plain = ("Sort_A: a", "Sort_B: b", "Sort_A_B: a b", "Sort_B_A: b a")
    total = {"Sum_W": {"w": F.sum}}
    return [
        RecordType("StringSingleton", struct(str=text), "one string", _sorts("Sort_Str: str"), {"Hash_Str": by_text("str")}),
        RecordType("StringPair", struct(a=text, b=text), "two strings", _sorts(*plain), pair),
        RecordType("StringWeight", struct(w=real, str=text), "weighted string", _sorts("Sort_Str: str", "Sort_W_Desc: w- str"), {"Hash_Str": by_text("str")}, total),
        RecordType("StringPairWeight", struct(w=real, a=text, b=text), "weighted pair", _sorts(*plain, "Sort_W_Desc: w- a b"), pair, total),
        RecordType("StringPairWeights", struct(w=real, aw=real, bw=real, a=text, b=text), "pair with side weights", _sorts(*plain, "Sort_W_Desc: w- a b"), pair),
        RecordType("UInt32", struct(val=whole), "one id"),
        RecordType("UInt32Pair", struct(a=whole, b=whole), "two ids", _sorts("Sort_A: a", "Sort_A_B: a b", "Sort_B_A: b a"), ids),
        RecordType("IdStringPair", struct(id=whole, str=text), "id and string", _sorts("Sort_Str: str"), {"Hash_Str": by_text("str")}),
        RecordType("IDPairWeight", struct(a=whole, b=whole, w=real), "weighted ids", _sorts(*plain, "Sort_A_W: a w b", "Sort_A_WDesc: a w- b", "Sort_B_W: b w a", "Sort_B_WDesc: b w- a"), ids, total),
        RecordType("IDPairWeights", struct(a=whole, b=whole, w=real, aw=real, bw=real), "ids with side weights", _sorts(*plain, "Sort_A_W: a w bw- b", "Sort_A_WDesc: a w- bw b", "Sort_B_W: b w aw- a", "Sort_B_WDesc: b w- aw a"), ids),
    ]


def registry() -> Registry:
    """A fresh registry with the built-in types."""
    out = Registry()
    for kind in _built_in():
        out.register(kind)
    return out
