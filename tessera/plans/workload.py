"""The benchmark's code base: 20 components of 250 TypeScript files, from a linear congruential generator in double arithmetic."""

from __future__ import annotations

import math
import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..schemas import Component, Contract, Rule

COMPONENTS, FILES, FOLDERS = 20, 250, 10


def _numbers(seed: float = 42.0) -> Iterator[float]:
    while True:
        seed = math.fmod(seed * 1103515245.0 + 12345.0, 2147483648.0)  # the product is beyond 2^53 and rounds
        yield seed


def _module(c: int, f: int) -> str:
    return f"src/c{c:02}/f{f % FOLDERS}/m{f}"


def texts() -> Iterator[tuple[str, str]]:
    numbers = _numbers()
    pick = lambda n: int(math.fmod(next(numbers), n))
    for c in range(COMPONENTS):
        for f in range(FILES):
            here, head = _module(c, f), []
            for t in (pick(FILES) for _ in range(3)):
                if t != f:
                    to = posixpath.relpath(_module(c, t), posixpath.dirname(here))
                    head.append(f'import {{ fn{t} }} from "{to if to.startswith("..") else "./" + to}.js";')
            if c:
                low, t = pick(c), pick(FILES)
                head.append(f'import type {{ Shape{t} }} from "@/{_module(low, t)[4:]}";')
            if pick(4) == 0:
                head.append('import { useState } from "react";')
            if pick(10) == 0:
                head.append('import { readFile } from "node:fs/promises";')
            if pick(25) == 0:
                head.append(f'const lazy = () => import("./m{f}.js");')
            body = f"export interface Shape{f} {{ id: string; value: number }}\n\nexport function fn{f}(input: Shape{f}): number {{\n  return input.value;\n}}\n\nexport class Service{f} {{\n  run(shape: Shape{f}): number {{\n    return fn{f}(shape);\n  }}\n}}\n"
            yield here + ".ts", "\n".join([*head, "", body])


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(texts()), "path string, text string").repartition(spark.sparkContext.defaultParallelism)


def contract() -> Contract:
    ids = tuple(f"c{c:02}" for c in range(COMPONENTS))
    return Contract(tuple(Component(i, (f"src/{i}",)) for i in ids), (), (Rule("no-cycles", "acyclic", because=("0001",)), Rule("layering", "layers", layers=tuple((i,) for i in reversed(ids)), because=("0001",))))
