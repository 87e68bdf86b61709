"""Operators put together: inputs, results, summaries and pipelines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from .staging import stage


def union_inputs(inputs: Sequence[DataFrame], key: str = "file", order: str = "pos") -> DataFrame:
    """(file, source, pos): all inputs one after the other, the first row of each file; null and empty ones go."""
    all_ = reduce(lambda a, b: a.unionByName(b), [df.select(key, F.lit(i).alias("source"), F.col(order).alias("pos")) for i, df in enumerate(inputs)])
    some = all_.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    first = some.groupBy(key).agg(F.min(F.struct("source", "pos")).alias("_f"))
    return first.select(key, "_f.source", "_f.pos")


def merge_metadata(inputs: Sequence[DataFrame], key: str = "file", text: str = "text") -> DataFrame:
    """(file, text): the last input that has a file wins."""
    all_ = reduce(lambda a, b: a.unionByName(b), [df.select(key, text, F.lit(i).alias("_e")) for i, df in enumerate(inputs)])
    return all_.groupBy(key).agg(F.max(F.struct("_e", text)).alias("_m")).select(key, F.col(f"_m.{text}").alias(text))


def collect_outputs(results: DataFrame, key: str = "file") -> DataFrame:
    """(file, output): all outputs, else the one output, else the input itself where it was skipped."""
    many = F.when(F.size(F.coalesce("outputs", F.array().cast("array<string>"))) > 0, F.col("outputs"))
    outs = F.coalesce(many, F.when(F.col("output").isNotNull(), F.array("output")), F.when(F.col("skipped"), F.array(F.col(key).cast("string"))))
    return results.select(key, F.explode(outs).alias("output"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: processed, failed, skipped, total. A result without ok counts as failed."""
    ok, skipped = F.coalesce("ok", F.lit(False)), F.coalesce("skipped", F.lit(False))
    return results.agg(F.count_if(ok & ~skipped).alias("processed"), F.count_if(~ok).alias("failed"), F.count_if(ok & skipped).alias("skipped"), F.count("*").alias("total"))


def observed(results: DataFrame, name: str = "batch") -> tuple[DataFrame, Observation]:
    """results, and the same counts filled in while they are first computed."""
    seen = Observation(name)
    ok = F.coalesce("ok", F.lit(False))
    return results.observe(seen, F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count(F.lit(1)).alias("total")), seen


@dataclass(frozen=True)
class Step:
    """A step of a pipeline: run takes the DataFrames of its inputs, each a step's or source's name. needs has for each
    input the columns and types that it must have, gives those of the result, both as "name type, ..", '' for any."""

    name: str
    run: Callable[..., DataFrame]
    inputs: Sequence[str] = ()
    needs: Sequence[str] = ()
    gives: str = ""


def _columns(ports: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in _parse_datatype_string(ports).fields} if ports else {}


def _unmet(need: str, has: dict[str, str]) -> list[str]:
    return [f"{c} {t}" + (f", not {has[c]}" if c in has else " is missing") for c, t in _columns(need).items() if has.get(c) != t]


class Pipeline:
    """Named steps, each a function of the DataFrames of its inputs; only steps that an output needs are run.

    Steps are Step objects or (name, function, inputs). sources has the columns of named inputs, as Step.gives. Edges whose
    two ends say what they have and need are checked here, the given sources and each result against them before a job
    runs. A result that several steps or outputs read is written once, under shared_dir().
    """

    def __init__(self, steps: Sequence[Step | tuple[str, Callable, Sequence[str]]], outputs: Sequence[str], sources: dict[str, str] | None = None):
        every = [s if isinstance(s, Step) else Step(*s) for s in steps]
        self.steps, self.outputs, self.sources = {s.name: s for s in every}, tuple(outputs), dict(sources or {})
        if len(self.steps) != len(every):
            raise ValueError("names of steps repeat")
        if both := self.steps.keys() & self.sources.keys():
            raise ValueError(f"{sorted(both)} are steps and sources")
        self.order = self._order()
        for n in self.order:
            s = self.steps[n]
            if s.needs and len(s.needs) != len(s.inputs):
                raise ValueError(f"{n} has {len(s.inputs)} inputs and {len(s.needs)} needs")
            for i, need in zip(s.inputs, s.needs):
                if self.sources and i not in self.steps and i not in self.sources:
                    raise ValueError(f"{n} reads {i}, which is no step and no source")
                gives = self.steps[i].gives if i in self.steps else self.sources.get(i, "")
                if gives and (bad := _unmet(need, _columns(gives))):
                    raise TypeError(f"{i} -> {n}: {'; '.join(bad)}")

    def _order(self) -> list[str]:
        out: list[str] = []
        open_: set[str] = set()

        def visit(n: str) -> None:
            if n in out or n not in self.steps:
                return
            if n in open_:
                raise ValueError(f"steps form a cycle at {n}")
            open_.add(n)
            for i in self.steps[n].inputs:
                visit(i)
            out.append(n)

        for n in self.outputs:
            if n not in self.steps:
                raise ValueError(f"no step {n}")
            visit(n)
        return out

    def run(self, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        made = dict(sources)
        readers = Counter([i for n in self.order for i in self.steps[n].inputs] + list(self.outputs))
        has = lambda df: {f.name: f.dataType.simpleString() for f in df.schema.fields}
        for n in self.order:
            if missing := [i for i in self.steps[n].inputs if i not in self.steps and i not in made]:
                raise ValueError(f"{n} needs {missing}")
        for i in made:
            if bad := _unmet(self.sources.get(i, ""), has(made[i])):
                raise TypeError(f"source {i}: {'; '.join(bad)}")
        for n in self.order:
            s = self.steps[n]
            for i, need in zip(s.inputs, s.needs):
                if bad := _unmet(need, has(made[i])):
                    raise TypeError(f"{i} -> {n}: {'; '.join(bad)}")
            got = s.run(*[made[i] for i in s.inputs])
            if bad := _unmet(s.gives, has(got)):
                raise TypeError(f"{n} gives {'; '.join(bad)}")
            made[n] = stage(got, f"step-{re.sub('[^A-Za-z0-9]', '_', n)}") if readers[n] > 1 else got
        return {n: made[n] for n in self.outputs}


def positions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds pos: the row's place in a global order that doesn't tie."""
    from easel.operators.tags import with_position

    return with_position(df, order, "pos")
