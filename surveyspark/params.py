"""Tunable values of every operator, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class Params:
    night_start_hour: int = 7
    segment_length_m: float = 10.0
    match_radius_m: float = 35.0
    heading_penalty_m: float = 12.0
    continuity_penalty_m: float = 8.0
    event_match_m: float = 50.0
    weather_tolerance_s: int = 40 * 60
    outcome_window_s: int = 600
    bio_windows_min: tuple[int, ...] = (5, 10, 15, 30)
    bio_distances_m: tuple[float, ...] = (50.0, 100.0, 250.0, 500.0)
    baseline_cutoff: datetime = datetime(2026, 8, 28, 7, 0)
    holdout_start: datetime = datetime(2026, 8, 28, 7, 0)
    min_match_ratio: float = 0.80
    max_median_match_m: float = 25.0
    # projection plane: transverse Mercator on GRS80 (Japan plane rectangular zone 1)
    tm_lon0: float = 129.5
    tm_lat0: float = 33.0
    tm_k0: float = 0.9999


DEFAULTS = Params()

# Fixed vocabulary values of the field logs and tables.
TARGET_SPECIES = "ハブ"
CAPTURE_TYPES = ("捕獲", "capture")
ZERO_TYPES = ("no_capture", "捕獲なし", "探索ゼロ", "zero_capture")
SEQUENCE_TYPES = ("目撃", "sighting", "轢死", "roadkill_sighting", "気象", "weather")
MARKER_TYPES = (
    "探索開始",
    "探索終了",
    "exploration_start",
    "exploration_end",
    "search_start",
    "search_end",
)
TARGET_EVENT_TYPES = ("捕獲", "capture", "目撃", "sighting", "轢死", "roadkill_sighting")
QUARANTINE_STATUSES = (
    "SOURCE_CONFLICT",
    "DUPLICATE_SUSPECT",
    "LIKELY_DATE_DUPLICATE",
    "WEAK_EVENT_ONLY",
)
UNIQUE_ROUTE_CLASSES = ("確定一本道区間", "UNIQUE_ROUTE")
SNAKES = (
    "ハブ",
    "ヒメハブ",
    "アカマタ",
    "ガラスヒバァ",
    "ガラスヒヴァ",
    "リュウキュウアオヘビ",
    "ヒャン",
)
BIO_SPECIES = ("ネズミ", "オットンガエル", "カエル", "ヤマシギ", "クロウサギ")
NIGHT_CLASSES = (
    "ACTUAL_GPX",
    "RECONSTRUCTED_GPS_HIGH",
    "RECONSTRUCTED_PARTIAL",
    "SPATIAL_ONLY_RECONSTRUCTION",
    "UNRECONSTRUCTABLE",
)
