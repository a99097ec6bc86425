"""Defaults of the store's parts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class RingConfig:
    vnodes: int = 150
    #: node id, host, port
    nodes: tuple[tuple[str, str, int], ...] = (("node-1", "localhost", 6379), ("node-2", "localhost", 6380), ("node-3", "localhost", 6381))

    def __post_init__(self):
        if self.vnodes < 1:
            raise ValueError("vnodes must be at least 1")


@dataclass(frozen=True)
class ReplicationConfig:
    factor: int = 2
    mode: str = "async"
    #: the operation log is cut to `keep` rows once it has more than `limit`
    limit: int = 1000
    keep: int = 500

    def __post_init__(self):
        if self.factor < 0 or self.mode not in ("sync", "async"):
            raise ValueError("factor must not be negative; mode is sync or async")

    def updated(self, **changes) -> ReplicationConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class FaultConfig:
    failure_threshold: int = 5
    success_threshold: int = 3
    recovery_ms: int = 30_000
    max_retries: int = 3
    retry_delay_ms: int = 100
    backoff: float = 2.0
    max_delay_ms: int = 5_000
    unhealthy_after: int = 3
    healthy_after: int = 2
    partition_ms: int = 10_000


@dataclass(frozen=True)
class CompactionConfig:
    threshold: int = 4


@dataclass(frozen=True)
class IvfConfig:
    nlist: int = 256
    nprobe: int = 8
    metric: str = "l2"
    max_iter: int = 25
    seed: int = 7
    normalize: bool = False

    def __post_init__(self):
        if self.nlist < 1 or self.nprobe < 0 or self.max_iter < 0:
            raise ValueError("nlist must be positive, nprobe and max_iter not negative")
        object.__setattr__(self, "nprobe", min(self.nprobe, self.nlist))


@dataclass(frozen=True)
class StoreConfig:
    """Cache, sharding, replication and fault tolerance can each be switched off."""

    cache_capacity: int = 1000
    cache: bool = True
    sharding: bool = True
    replication: bool = True
    fault_tolerance: bool = True
    ring: RingConfig = field(default_factory=RingConfig)
    replicas: ReplicationConfig = field(default_factory=ReplicationConfig)
    faults: FaultConfig = field(default_factory=FaultConfig)

    def __post_init__(self):
        if self.cache_capacity < 0:
            raise ValueError("cache capacity must not be negative")

    def updated(self, **changes) -> StoreConfig:
        return replace(self, **changes)
