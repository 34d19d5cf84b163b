"""Holdout families: typed templates, seeded slot values, gates and artifacts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesieve.functions import text as T

#: `of` holds the members as JSON text, so that numbers stay numbers.
SLOTS = "array<struct<name:string,kind:string,min:bigint,max:bigint,count:int,of:array<string>,sep:string>>"
KINDS = ("int", "int_list", "choice", "permutation")


class HashDraws:
    """Uniform integers from SHA-256 of "key:0", "key:1", ..., eight bytes each, little-endian, by rejection."""

    def __init__(self, key: str):
        self.words = self._words(key.encode())

    @staticmethod
    def _words(key: bytes) -> Iterator[int]:
        i = 0
        while True:
            block = hashlib.sha256(key + b":%d" % i).digest()
            yield from (int.from_bytes(block[a : a + 8], "little") for a in range(0, 32, 8))
            i += 1

    def below(self, n: int) -> int:
        if n < 1:
            raise ValueError("n must be 1 or more")
        whole = 2**64 - 2**64 % n
        return next(x for x in self.words if x < whole) % n

    def between(self, low: int, high: int) -> int:
        return low + self.below(high - low + 1)

    def shuffled(self, items: list) -> list:
        """Fisher-Yates from the end."""
        items = list(items)
        for last in reversed(range(1, len(items))):
            other = self.below(last + 1)
            items[last], items[other] = items[other], items[last]
        return items


def slot_values(slots: list[dict], key: str) -> dict:
    """Values of a family's slots from one stream, in the order of their names."""
    stream, values = HashDraws(key), {}
    for s in sorted(slots, key=lambda s: s["name"]):
        match s["kind"]:
            case "int":
                values[s["name"]] = stream.between(s["min"], s["max"])
            case "int_list":
                values[s["name"]] = [stream.between(s["min"], s["max"]) for _ in range(s["count"])]
            case "choice":
                values[s["name"]] = s["of"][stream.below(len(s["of"]))]
            case "permutation":
                values[s["name"]] = stream.shuffled(s["of"])
    return values


def canonical(values: dict) -> str:
    """JSON with sorted keys, no spaces, ASCII only."""
    return json.dumps(values, sort_keys=True, separators=(",", ":"))


def member(text: str):
    """A member of a choice or permutation: the value that its JSON text says; a text that is no JSON stands for itself."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


REFERENCE = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def references(template: str) -> list[str]:
    return REFERENCE.findall(template)


def filled(template: str, shown: dict[str, str]) -> str:
    """The template with its references replaced, in one pass."""
    return REFERENCE.sub(lambda m: shown[m[1]], template)


def shown(value, sep: str = " ") -> str:
    return sep.join(map(str, value)) if isinstance(value, list) else str(value)


def content_digest(texts: dict[str, str]) -> str:
    """SHA-256 over an instance's files by name."""
    return hashlib.sha256("".join(f"{name}\n{hashlib.sha256(texts[name].encode()).hexdigest()}\n" for name in sorted(texts)).encode()).hexdigest()


def derived(seeds: DataFrame, families: DataFrame) -> DataFrame:
    """(family, n) x (family, prompt, slots) -> family, n, seed, slots_json, slot_sha256, prompt; families are broadcast, being few."""

    @F.pandas_udf("slots_json string, shown map<string,string>")
    def values(family: pd.Series, seed: pd.Series, slots: pd.Series) -> pd.DataFrame:
        out = []
        for f, s, spec in zip(family, seed, slots, strict=True):
            specs = [x | {"of": [member(m) for m in x["of"]]} if x.get("of") else x for x in json.loads(spec)]
            got = slot_values(specs, f"{f}/{s}")
            sep = {x["name"]: x.get("sep", " ") for x in specs}
            out.append((canonical(got), {k: sep[k].join(map(str, v)) if isinstance(v, list) else str(v) for k, v in got.items()}))
        return pd.DataFrame(out, columns=["slots_json", "shown"])

    rows = seeds.join(F.broadcast(families), "family").withColumn("seed", F.concat_ws(":", "family", "n")).withColumn("v", values("family", "seed", F.to_json("slots")))
    return rows.select("family", "n", "seed", F.col("v.slots_json").alias("slots_json"), F.sha2("v.slots_json", 256).alias("slot_sha256"), T.rendered("prompt", "v.shown").alias("prompt"))


def cardinality(families: DataFrame) -> DataFrame:
    """(family, slots) -> family, cardinality as decimal(38,0); null where that overflows."""
    span = F.col("s.max").cast("decimal(38,0)") - F.col("s.min") + 1
    product = lambda c: F.aggregate(c, F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    space = (
        F.when(F.col("s.kind") == "int", span)
        .when(F.col("s.kind") == "int_list", product(F.array_repeat(span, F.col("s.count"))))
        .when(F.col("s.kind") == "choice", F.size("s.of").cast("decimal(38,0)"))
        .otherwise(product(F.transform(F.sequence(F.lit(1), F.size("s.of")), lambda x: x.cast("decimal(38,0)"))))
    )
    spaces = families.select("family", F.explode("slots").alias("s")).select("family", space.cast("decimal(38,0)").alias("space"))
    return spaces.groupBy("family").agg(product(F.collect_list("space")).alias("cardinality"))


def cardinality_display(c):
    return F.when(c.isNull() | (c >= 10**12), ">= 10^12").otherwise(c.cast("string"))


def problems(families: DataFrame) -> DataFrame:
    """(family, prompt, slots) -> one row for each broken rule: family, problem."""
    slots = families.select("family", F.explode_outer("slots").alias("s"))
    rules = [
        (families, ~F.coalesce(F.col("family").rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False)), F.lit("bad id")),
        (families, F.trim(F.coalesce("prompt", F.lit(""))) == "", F.lit("empty prompt")),
        (families, F.coalesce(F.size("slots"), F.lit(0)) < 1, F.lit("no slots")),
        (slots, ~F.col("s.kind").isin(*KINDS), F.concat(F.lit("unknown kind: "), "s.name")),
        (slots, F.col("s.kind").isin("int", "int_list") & ~F.coalesce(F.col("s.min") <= F.col("s.max"), F.lit(False)), F.concat(F.lit("needs min <= max: "), "s.name")),
        (slots, F.col("s.kind").isin("int", "int_list") & F.coalesce(F.col("s.max").cast("decimal(38,0)") - F.col("s.min") + 1 > F.lit(str(2**63)).cast("decimal(38,0)"), F.lit(False)), F.concat(F.lit("range above 2^63: "), "s.name")),
        (slots, (F.col("s.kind") == "int_list") & ~F.coalesce(F.col("s.count") >= 1, F.lit(False)), F.concat(F.lit("needs count >= 1: "), "s.name")),
        (slots, F.col("s.kind").isin("choice", "permutation") & (F.coalesce(F.size("s.of"), F.lit(0)) < 1), F.concat(F.lit("needs a non-empty list: "), "s.name")),
    ]
    out = None
    for rows, broken, what in rules:
        found = rows.where(broken).select("family", what.alias("problem"))
        out = found if out is None else out.unionByName(found)
    refs = families.select("family", F.explode(T.template_refs(F.col("prompt"))).alias("name"))
    dangling = refs.join(slots.select("family", F.col("s.name").alias("name")), ["family", "name"], "left_anti").distinct()
    return out.unionByName(dangling.select("family", F.concat(F.lit("unknown slot: "), "name").alias("problem")))


def accepted(candidates: DataFrame, used_digests: DataFrame, other_shingles: DataFrame, count: int) -> DataFrame:
    """The first `count` candidates of each family, by n, whose slot values are new and whose prompt shares fewer than two shingles with items of others.

    candidates: derived() rows; used_digests: slot_sha256; other_shingles: (family, h) of manifest rows.
    """
    fresh = candidates.join(used_digests.select("slot_sha256"), "slot_sha256", "left_anti")
    first = fresh.withColumn("i", F.row_number().over(Window.partitionBy("family", "slot_sha256").orderBy("n"))).where("i = 1").drop("i")
    cut = first.withColumn("w", T.words(T.normalized("prompt"))).select("family", "n", F.explode(F.array_distinct(T.windows("w"))).alias("window")).select("family", "n", T.sha("window").alias("h"))
    others = other_shingles.select(F.col("family").alias("of"), "h").distinct()
    near = cut.join(others, "h").where("family != of").groupBy("family", "n").agg(F.count_distinct("h").alias("c")).where("c >= 2")
    left = first.join(near.select("family", "n"), ["family", "n"], "left_anti")
    return left.withColumn("i", F.row_number().over(Window.partitionBy("family").orderBy("n"))).where(F.col("i") <= count).drop("i")
