"""Updates of the library and its index, each as a table made from the old one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import folder_name


def replaced_rows(index: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The derived rows of ``changed`` ids (key) make room for ``new`` ones; all others stay."""
    return index.join(changed.select(key), key, "left_anti").unionByName(new.join(changed.select(key), key, "left_semi"))


def work_list(store: DataFrame, index: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """What isn't in the index with the fingerprint that it has in the store."""
    return store.join(index.select(key, fingerprint), [key, fingerprint], "left_anti")


def without(rows: DataFrame, ids: Sequence[object], active: Sequence[object], key: str) -> DataFrame:
    """``rows`` but for ``ids``, which one caller names; nothing is deleted if one of them is active."""
    if set(ids) & set(active):
        raise ValueError("an active meeting can't be deleted")
    return rows.filter(~F.col(key).isin(*ids))


def without_channel(rows: DataFrame, anchor: object, key: str, channel: Sequence[str]) -> DataFrame:
    """``rows`` but for those of the channel (its columns) that the row with id ``anchor`` is in."""
    return rows.join(rows.filter(F.col(key) == anchor).select(*channel), list(channel), "left_anti")


def folder_renamed(rows: DataFrame, old: str, new: str, folder: str = "folder") -> DataFrame:
    """Rows of the folder ``old``, whatever its case, move to ``new``, which is cleaned."""
    return rows.withColumn(folder, F.when(F.lower(folder) == old.strip().lower(), folder_name(F.lit(new))).otherwise(F.col(folder)))


def tasks_done(items: Column, which: Callable[[Column], Column], done: bool) -> Column:
    """The nested tasks with ``done`` set on those that ``which`` names."""
    return F.transform(items, lambda x: F.when(which(x), x.withField("done", F.lit(done))).otherwise(x))
