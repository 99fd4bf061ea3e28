"""Schemas of the library's tables. Text columns that hold JSON at the source are decoded once, as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOX = "struct<x1: double, y1: double, x2: double, y2: double>"
TABLES = {
    "assets": "id string, file_path string, file_size long, mime_type string, original_name string, taken_at timestamp, duration_ms long, live_photo_video_id string, is_live_photo_video boolean, indexed_at timestamp, status string, checksum string, offline boolean, aesthetic_score double, mtime long, caption_synced boolean, face_scanned boolean, deleted_at timestamp, original_path string",
    "asset_exif": "asset_id string, width int, height int, latitude double, longitude double, make string, model string, iso int, shutter_speed string, aperture double, focal_length double, orientation int, video_codec string, audio_codec string, frame_rate double, bit_rate long, rotation int",
    "clip_embeddings": "asset_id string, embedding array<float>",
    "face_detections": f"id string, asset_id string, bbox {BOX}, embedding array<float>, excluded boolean, score double, frontality double, sharpness double",
    "persons": "id string, name string, cover_asset_id string, cover_face_id string, favorite boolean, relation string, hidden boolean, confidence double, centroid array<float>, created_at timestamp, updated_at timestamp, cover_locked boolean, hero_asset_id string, purge_at timestamp",
    "face_person": "face_id string, person_id string",
    "albums": "id string, name string, created_at timestamp, cover_asset_id string",
    "album_assets": "album_id string, asset_id string, added_at timestamp, position int",
    "asset_favorites": "user_id string, asset_id string, favorited_at timestamp",
    "asset_views": "user_id string, asset_id string, view_count long, last_viewed_at timestamp",
    "merge_rejections": "person_a string, person_b string, rejected_at timestamp",
    "asset_geo": "asset_id string, city_id int, city string, country string, region string, admin1 string, lat double, lon double, geocoded_at timestamp",
    "place_cover_overrides": "user_id string, place_key int, asset_id string",
    "spot_name_overrides": "user_id string, spot_key string, name string",
    "smart_views": "id string, name string, description string, conds_raw array<string>, threshold int, live boolean, include_videos boolean, evaluated_at timestamp",
    "smart_view_matches": "smart_view_id string, asset_id string, match_score double, matched_at timestamp, origin int",
    "smart_view_activity": "id string, smart_view_id string, kind string, asset_ids array<string>, at timestamp",
    "asset_ocr": "asset_id string, text string, ocr_at timestamp, coverage double, line_count int, boxes_ver int, doc_sem double, doc_geo double, is_doc boolean, doc_ver int",
    "asset_ocr_lines": "asset_id string, line_no int, text string, box array<double>, score double",
    "asset_caption": "asset_id string, text string, mtime_ms long, fetched_at timestamp",
    "moment_recipes": "key string, kind string, title string, params map<string, string>, enabled boolean, updated_at long",
    "moments": "id string, recipe_key string, title string, subtitle string, cover_asset_id string, time_from timestamp, time_to timestamp, place string, asset_count int, named_by_llm boolean, sort_order int, hidden boolean, created_at long, updated_at long",
    "moment_assets": "moment_id string, asset_id string, featured boolean, score double, manual boolean, added_at long",
    "moment_edits": "moment_id string, asset_id string, op string, created_at long",
    "upload_tasks": "id string, owner string, path string, size long, offset long, status string, error string, created_at long, updated_at long, expires_at long",
    "profile_entities": "id string, kind string, key string, label string, evidence string, photo_count int, first_seen timestamp, last_seen timestamp, updated_at long",
    "backfill_failures": "kind string, asset_id string, fail_count int, last_fail_at long, next_retry_at long, last_error string",
    "photos_meta": "key string, value string",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
