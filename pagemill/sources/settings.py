"""Settings of a session, from its ``spark.pagemill.*`` configuration, with defaults and bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from pagemill.functions import fixed


@dataclass(frozen=True)
class Settings:
    receiver: str = ""
    token: str = ""
    most_failure_rate: float = fixed.ABORT_RATE
    least_sends_before_abort: int = fixed.ABORT_AFTER
    job_seconds: int = fixed.JOB_SECONDS
    most_active_jobs: int = fixed.MOST_ACTIVE
    rate_requests: int = fixed.RATE_REQUESTS
    rate_seconds: int = fixed.RATE_SECONDS

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """What the session says, the rest by default; a value of another type is an error that names its key."""
        told = {}
        for field in fields(cls):
            value = spark.conf.get(f"spark.pagemill.{field.name}", None)
            if value is not None:
                try:
                    told[field.name] = type(field.default)(value.strip())
                except ValueError:
                    raise ValueError(f"spark.pagemill.{field.name} is no {type(field.default).__name__}: {value}") from None
        return cls(**told)

    def ready_to_send(self) -> Settings:
        """Itself; an error if the receiver or its token is missing."""
        for name in ("receiver", "token"):
            if not getattr(self, name):
                raise ValueError(f"spark.pagemill.{name} is not set")
        return self
