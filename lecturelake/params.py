"""Parameters of the lecture operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SamplingParams:
    every_sec: float = 0.25
    least_sec: float = 0.25
    default_fps: float = 25.0
    harvest_every_sec: float = 1.0
    harvest_least_sec: float = 0.2
    max_scans: int = 240
    max_pool: int = 220
    min_roi_area_ratio: float = 0.1


@dataclass(frozen=True)
class KeyframeParams:
    min_score: float = 45.0
    min_change: float = 0.02
    max_keyframes: int | None = 28
    signature_bits: int = 14_400


@dataclass(frozen=True)
class SpeechParams:
    threshold: float = 0.01
    window_sec: float = 0.1
    silence_sec: float = 0.9
    min_segment_sec: float = 2.0
    max_segment_sec: float = 20.0
    drop_silence_sec: float = 5.0
    skip_energy: float = 0.005


@dataclass(frozen=True)
class ClarityParams:
    sharp_from: float = 120.0
    blurred_to: float = 40.0
    uneven_from: float = 8.0


@dataclass(frozen=True)
class AlignmentParams:
    high_sim: float = 0.72
    partial_sim: float = 0.45
    keyword_high: float = 0.35
    keyword_partial: float = 0.2


@dataclass(frozen=True)
class LineParams:
    min_chars: int = 14
    min_letters: int = 5
    dedupe_min_len: int = 8
    filter_max_lines: int = 120
    ascii_only: bool = True
    drop_singletons: bool = True
