"""Row filters that many plans share, as columns, so that they reach the scan."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File endings of raw images.
RAW_ENDINGS = (".dng", ".cr2", ".cr3", ".nef", ".arw", ".orf", ".rw2", ".raf")


def visible() -> Column:
    """Shown to users: not the clip of a live photo, not deleted, on a mounted disk."""
    return ~F.col("is_live_photo_video") & F.col("deleted_at").isNull() & ~F.col("offline")


def alive() -> Column:
    return (F.col("status") == "indexed") & F.col("deleted_at").isNull() & ~F.col("offline")


def is_video(mime: str = "mime_type") -> Column:
    return F.coalesce(F.col(mime), F.lit("")).ilike("video/%")


def is_raw(path: str = "file_path") -> Column:
    return reduce(or_, [F.lower(F.col(path)).endswith(x) for x in RAW_ENDINGS])


def sort_time(taken: str = "taken_at", indexed: str = "indexed_at") -> Column:
    return F.coalesce(F.col(taken), F.col(indexed))


def document_text() -> Column:
    """Of a row of asset_ocr: enough text, evenly spread, and not judged to be no document."""
    return (F.col("text") != "") & (F.coalesce("coverage", F.lit(1.0)) >= 0.05) & (F.coalesce("line_count", F.lit(0)) >= 8) & F.coalesce("is_doc", F.lit(True))


def with_document_flag(assets: DataFrame, ocr: DataFrame, name: str = "has_ocr") -> DataFrame:
    """assets with a flag; the filter is applied to the text table before the join."""
    hits = ocr.filter(document_text()).select(F.col("asset_id").alias("__o")).distinct()
    return assets.join(hits, F.col("id") == F.col("__o"), "left").withColumn(name, F.col("__o").isNotNull()).drop("__o")


def candidate_pool(assets: DataFrame, ocr: DataFrame) -> DataFrame:
    """What moments are made of: dated photos and videos that are no documents."""
    return with_document_flag(assets.filter(alive() & ~F.col("is_live_photo_video") & F.col("taken_at").isNotNull()), ocr).filter(~F.col("has_ocr")).drop("has_ocr")


def person_anchored() -> Column:
    """Touched by a user in any way, so that clustering leaves the person alone."""
    return anchored_for_purge() | F.col("cover_locked") | (F.coalesce("hero_asset_id", F.lit("")) != "")


def anchored_for_purge() -> Column:
    """The narrower test that detaching and purging use."""
    return (F.coalesce("name", F.lit("")) != "") | F.col("favorite") | (F.coalesce("relation", F.lit("")) != "") | F.col("hidden")


def person_listable(floor: float) -> Column:
    return ~F.col("hidden") & ((F.coalesce("name", F.lit("")) != "") | F.col("favorite") | (F.coalesce("relation", F.lit("")) != "") | (F.col("confidence") >= floor))


def contains_any(text: Column, query: str) -> Column:
    """Case-insensitive substring; alternatives are parted by |. A blank query matches nothing."""
    parts = [p.strip().lower() for p in query.split("|") if p.strip()]
    return reduce(or_, [F.contains(F.lower(text), F.lit(p)) for p in parts], F.lit(False))


def has_word(text: Column, word: str) -> Column:
    """The word between ASCII word boundaries, in any case."""
    quoted = "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in word.lower())
    return F.contains(F.lower(text), F.lit(word.lower())) & F.lower(text).rlike(rf"(?<![0-9a-z_]){quoted}(?![0-9a-z_])")


def in_folder(path: Column, folder: str) -> Column:
    return F.array_contains(F.split(path, "/"), folder)


def not_cooling(rows: DataFrame, ledger: DataFrame, kind: str, now_ms: int, key: str = "id") -> DataFrame:
    """Rows without a failure of this kind that is to be retried after now."""
    waiting = ledger.filter((F.col("kind") == kind) & (F.col("next_retry_at") > now_ms)).select(F.col("asset_id").alias(key))
    return rows.join(waiting, key, "left_anti")


def clamp_limit(limit: int, default: int, most: int = 500) -> int:
    return limit if 0 < limit <= most else default


def clamp_threshold(value: int) -> int:
    return value if 50 <= value <= 99 else 70


def clamp_offset(value: int) -> int:
    return max(0, value)
