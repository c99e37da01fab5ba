"""Results as text: the settings of a run, its ranked itemsets, and a line of progress."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from tallyrift.plans.mine import Mined


def configuration(transactions: int, items: int, k: int, min_pro: float, cores: int) -> str:
    return f"transactions {transactions}, items {items}, k {k}, least probability {min_pro}, cores {cores}"


def ranked(mined: Mined) -> Iterator[str]:
    for n, (items, eu, ep) in enumerate(mined.rows, 1):
        yield f"{n}. {{{', '.join(map(str, items))}}}: utility {eu:.2f}, probability {ep:.4f}"


def progress(level: dict) -> str:
    return f"level {level['level']}: {level['candidates']} candidates, {level['survivors']} go on, threshold {level['threshold']:.4f}"


def save(frame: DataFrame, path: str, kind: str = "parquet") -> None:
    """The ranked result as parquet, json, or csv with items joined by blanks."""
    if kind == "csv":
        frame.selectExpr("rank", "array_join(items, ' ') as items", "eu", "ep").write.mode("overwrite").option("header", True).csv(path)
    else:
        frame.write.mode("overwrite").format(kind).save(path)
