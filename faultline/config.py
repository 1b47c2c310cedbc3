"""Threshold objects, checked when the plan is built."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
STATUSES = ("OPEN", "INVESTIGATING", "IDENTIFIED", "RESOLVED", "CLOSED")
ACTIVE_STATUSES = ("OPEN", "INVESTIGATING", "IDENTIFIED")
HISTORICAL_STATUSES = ("IDENTIFIED", "RESOLVED", "CLOSED")
EVENT_TYPES = ("LOG", "METRIC", "ALERT", "DEPLOYMENT", "TRACE")


def _require(ok: bool, text: str) -> None:
    if not ok:
        raise ValueError(text)


@dataclass(frozen=True)
class AnomalyThresholds:
    window_size: int = 20
    min_points: int = 5
    z_score: float = 2.5
    percentage_change: float = 50.0
    percentile_low: float = 5.0
    percentile_high: float = 95.0
    min_stddev: float = 1e-9

    def __post_init__(self) -> None:
        _require(self.window_size >= 2, "window_size must be at least 2")
        _require(2 <= self.min_points <= self.window_size, "min_points must be in 2..window_size")
        _require(self.percentile_low < self.percentile_high, "percentile_low must be below percentile_high")


@dataclass(frozen=True)
class CorrelationThresholds:
    deployment_to_error_us: int = 2 * HOUR
    metric_to_error_us: int = 30 * MINUTE
    error_to_alert_us: int = 15 * MINUTE
    min_score: float = 0.1

    def __post_init__(self) -> None:
        lags = (self.deployment_to_error_us, self.metric_to_error_us, self.error_to_alert_us)
        _require(min(lags) > 0, "lags must be positive")
        _require(0 <= self.min_score <= 1, "min_score must be in 0..1")


@dataclass(frozen=True)
class DeploymentThresholds:
    lookback_us: int = 24 * HOUR
    max_lag_us: int = 2 * HOUR
    min_score: float = 0.4

    def __post_init__(self) -> None:
        _require(self.lookback_us > 0 and self.max_lag_us > 0, "lags must be positive")


@dataclass(frozen=True)
class ServiceThresholds:
    metric_to_error_us: int = 30 * MINUTE
    trace_to_error_us: int = 5 * MINUTE
    upstream_us: int = 15 * MINUTE
    min_score: float = 0.2
    same_service: float = 0.3
    temporal: float = 0.4
    dependency: float = 0.3
    trace: float = 0.3

    def __post_init__(self) -> None:
        lags = (self.metric_to_error_us, self.trace_to_error_us, self.upstream_us)
        _require(min(lags) > 0, "lags must be positive")


@dataclass(frozen=True)
class SimilarityThresholds:
    high: float = 0.92
    possible: float = 0.75

    def __post_init__(self) -> None:
        _require(0 < self.possible < self.high <= 1, "high must exceed possible, both in 0..1")


@dataclass(frozen=True)
class SimilarIncidentConfig:
    min_score: float = 0.55
    max_results: int = 5
    title: float = 0.30
    embedding: float = 0.25
    fingerprint: float = 0.15
    service: float = 0.10
    environment: float = 0.10
    error_group: float = 0.10

    def __post_init__(self) -> None:
        total = self.title + self.embedding + self.fingerprint + self.service + self.environment + self.error_group
        _require(abs(total - 1.0) <= 1e-6, "weights must sum to 1")
        _require(self.max_results >= 1, "max_results must be positive")


@dataclass(frozen=True)
class RootCauseConfig:
    min_confidence: float = 0.6
    confident: float = 0.75
    min_quality: int = 30
