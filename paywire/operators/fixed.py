"""Fixed-length frames: layouts, tiling, and which frame lengths a layout fits."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywire.operators.gates import Gate


@dataclass(frozen=True)
class Layout:
    """(name, length) in order; a last length of None takes the rest."""

    name: str
    fields: tuple[tuple[str, int | None], ...]

    def __post_init__(self) -> None:
        if not 1 <= len(self.fields) <= 65_535:
            raise ValueError("a layout has 1 to 65535 fields")
        for k, (name, size) in enumerate(self.fields):
            if size is None and k + 1 < len(self.fields):
                raise ValueError(f"{name}: only the last field may take the rest")
            if size is not None and size < 1:
                raise ValueError(f"{name}: no length")

    @classmethod
    def from_toml(cls, text: str) -> Layout:
        """name, [[field]] name and one of len, rest = true."""
        raw, fields = tomllib.loads(text), []
        for f in raw.get("field", []):
            if ("len" in f) == bool(f.get("rest")):
                raise ValueError(f"{f.get('name')}: needs one of len and rest")
            fields.append((f["name"], f.get("len")))
        return cls(raw.get("name", ""), tuple(fields))

    def fits(self, frame: Column) -> Column:
        known = sum(n for _, n in self.fields if n is not None)
        n = F.octet_length(frame)
        return n >= known if self.fields[-1][1] is None else n == known

    def tiles(self, frame: Column) -> Column:
        """array<struct<ordinal, name, value>>, NULL where the frame doesn't fit; offsets are known when the plan is made."""
        at, parts = 1, []
        for k, (name, size) in enumerate(self.fields):
            value = F.substring(frame, at, size if size is not None else 2**31 - 1 - at)
            parts.append(F.struct(F.lit(k).alias("ordinal"), F.lit(name).alias("name"), value.alias("value")))
            at += size or 0
        return F.when(self.fits(frame), F.array(*parts))


def long_view(df: DataFrame, frame: str, keys: list[str], layout: Layout) -> DataFrame:
    """keys, number (ordinal), name, occurrence, value: what conformance.diff_views takes."""
    return df.select(*keys, F.explode(layout.tiles(F.col(frame))).alias("_t")).select(*keys, F.col("_t.ordinal").alias("number"), F.col("_t.name").alias("name"), F.lit(0).alias("occurrence"), F.col("_t.value").alias("value"))


def by_length(df: DataFrame, frame: str, layout: Layout) -> DataFrame:
    """length, frames, matched, verdict: matched for all, - for none, else partial."""
    found = df.groupBy(F.octet_length(frame).alias("length")).agg(F.count("*").alias("frames"), F.count_if(layout.fits(F.col(frame))).alias("matched"))
    return found.withColumn("verdict", F.when(F.col("matched") == F.col("frames"), "matched").when(F.col("matched") == 0, "-").otherwise("partial"))


def layout_gate(df: DataFrame, frame: str, layout: Layout) -> DataFrame:
    """frames, matched, gate: 2 without frames, 0 if any fits, else 1."""
    found = df.agg(F.count(frame).alias("frames"), F.count_if(layout.fits(F.col(frame))).alias("matched"))
    return found.withColumn("gate", F.when(F.col("frames") == 0, 2).when(F.col("matched") > 0, 0).otherwise(1))


def watched(df: DataFrame, frame: str, layout: Layout, gate: Gate) -> DataFrame:
    """The frames as they are, counted on their way; gate.result() is what `layout_gate` finds."""
    return gate.watch(df, frames=F.count(frame), matched=F.count_if(layout.fits(F.col(frame))))


def gate_of(counts: dict[str, int]) -> int:
    return 2 if not counts["frames"] else 0 if counts["matched"] else 1
