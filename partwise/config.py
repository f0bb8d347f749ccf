"""Settings of a consumer, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, field


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class BreakerSettings:
    error_rate_threshold: float = 0.5
    latency_threshold_ms: float = 5000.0
    cooldown_ms: int = 30_000
    probe_batch_size: int = 10
    probe_timeout_ms: int = 30_000

    def __post_init__(self):
        _check(0.01 <= self.error_rate_threshold <= 1.0, "error_rate_threshold is from 0.01 to 1.0")
        for name in ("latency_threshold_ms", "cooldown_ms", "probe_batch_size", "probe_timeout_ms"):
            _check(getattr(self, name) > 0, f"{name} is positive")


@dataclass(frozen=True)
class HealthSettings:
    window_ms: int = 60_000
    evaluation_interval_ms: int = 1_000


@dataclass(frozen=True)
class ReorderSettings:
    max_buffer_size: int = 10_000
    resume_threshold: float = 0.8
    timeout_ms: int = 5_000

    def __post_init__(self):
        _check(self.max_buffer_size > 0, "max_buffer_size is positive")
        _check(0.0 <= self.resume_threshold <= 1.0, "resume_threshold is from 0 to 1")
        _check(self.timeout_ms > 0, "timeout_ms is positive")

    @property
    def resume_below(self) -> int:
        return int(self.max_buffer_size * self.resume_threshold)


@dataclass(frozen=True)
class DedupSettings:
    retention_ms: int = 72 * 3_600_000
    eviction_interval_ms: int = 3_600_000
    health_check_interval_ms: int = 5_000

    def __post_init__(self):
        for name in ("retention_ms", "eviction_interval_ms", "health_check_interval_ms"):
            _check(getattr(self, name) > 0, f"{name} is positive")


@dataclass(frozen=True)
class DeadLetterSettings:
    max_retry_count: int = 3
    initial_backoff_ms: int = 1_000
    max_backoff_ms: int = 60_000
    max_sleep_ms: int = 50
    max_buffer_size: int = 1_000
    max_route_attempts: int = 10
    topics: dict[str, str] = field(default_factory=dict)
    default_topic: str = "dlq.unclassified"

    def __post_init__(self):
        _check(1 <= self.max_retry_count <= 10, "max_retry_count is from 1 to 10")
        for name in ("initial_backoff_ms", "max_backoff_ms"):
            _check(getattr(self, name) >= 0, f"{name} is not negative")
        for name in ("max_buffer_size", "max_route_attempts"):
            _check(getattr(self, name) > 0, f"{name} is positive")


@dataclass(frozen=True)
class ConsumerSettings:
    poll_timeout_ms: int = 100
    max_poll_records: int = 500
    shutdown_timeout_ms: int = 30_000
    rebalance_commit_timeout_ms: int = 5_000
    breaker: BreakerSettings = BreakerSettings()
    health: HealthSettings = HealthSettings()
    reorder: ReorderSettings = ReorderSettings()
    dedup: DedupSettings = DedupSettings()
    dead_letters: DeadLetterSettings = DeadLetterSettings()

    def __post_init__(self):
        for name in ("poll_timeout_ms", "max_poll_records", "shutdown_timeout_ms", "rebalance_commit_timeout_ms"):
            _check(getattr(self, name) > 0, f"{name} is positive")
