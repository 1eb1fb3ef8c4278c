"""Connectionist decoding: greedy as Column folds, beam search as a numeric kernel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The plate alphabet; the last symbol is the blank.
PLATE = (
    "京 沪 津 渝 冀 晋 蒙 辽 吉 黑 苏 浙 皖 闽 赣 鲁 豫 鄂 湘 粤 桂 琼 川 贵 云 藏 陕 甘 青 宁 新 "
    "0 1 2 3 4 5 6 7 8 9 A B C D E F G H J K L M N P Q R S T U V W X Y Z I O -"
).split()


def best_steps(tensor: Column, symbols: int, steps: int, symbol_major: bool) -> Column:
    """array<struct<s, p>>: symbol and value of the first greatest of each step. symbol_major: element k * steps + j."""
    def at(j: Column) -> Column:
        if symbol_major:
            row = F.transform(F.sequence(F.lit(0), F.lit(symbols - 1)), lambda k: F.element_at(tensor, (k * steps + j + 1).cast("int")))
        else:
            row = F.slice(tensor, (j * symbols + 1).cast("int"), symbols)
        best = F.array_max(row)
        return F.struct((F.array_position(row, best) - 1).cast("int").alias("s"), best.cast("double").alias("p"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), at)


def collapse(steps: Column, blank: int) -> Column:
    """The steps that start a new symbol: neither blank nor a repeat of the step before. One fold over the steps."""
    none = F.slice(F.array(F.struct(F.lit(0).alias("s"), F.lit(0.0).alias("p"))), 1, 0)

    def step(acc: Column, x: Column) -> Column:
        new = (x["s"] != blank) & (x["s"] != acc["before"])
        return F.struct(x["s"].alias("before"), F.when(new, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(steps, F.struct(F.lit(-1).alias("before"), none.alias("kept")), step, lambda acc: acc["kept"])


def greedy_text(steps: Column, alphabet: list[str], blank: int) -> Column:
    names = F.array(*[F.lit(a) for a in alphabet])
    return F.array_join(F.transform(collapse(steps, blank), lambda x: F.get(names, x["s"])), "")


def beam_search(probs: np.ndarray, beam: int, blank: int = 0) -> tuple[list[int], float]:
    """Best symbols and mean kept probability: at each step the `beam` likeliest symbols extend the `beam` best prefixes.

    Scores multiply, equal collapsed prefixes aren't merged; repeats and blanks go at the end.
    """
    beams = [([], [], 1.0)]
    for row in probs:
        top = np.argsort(-row, kind="stable")[:beam]
        grown = [([*s, int(k)], [*p, float(row[k])], v * float(row[k])) for s, p, v in beams for k in top]
        beams = sorted(grown, key=lambda b: -b[2])[:beam]
    symbols, ps, _ = beams[0]
    kept = [(s, p) for i, (s, p) in enumerate(zip(symbols, ps)) if s != blank and (i == 0 or symbols[i - 1] != s)]
    return [s for s, _ in kept], float(np.mean([p for _, p in kept])) if kept else 0.0
