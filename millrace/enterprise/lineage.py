"""Lineage run events in the OpenLineage shape, kept on the driver and written as JSON lines."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame

PRODUCER = "urn:millrace"


@dataclass(frozen=True)
class LineageConfig:
    namespace: str = "millrace"
    job_name: str = "millrace.clean"
    producer: str = PRODUCER
    actor: str | None = None
    emit: bool = True


def schema_of(df: DataFrame) -> list[dict[str, str]]:
    return [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]


@dataclass
class LineageTracker:
    config: LineageConfig = LineageConfig()
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    events: list[dict] = field(default_factory=list)

    def _event(self, kind: str, inputs: list[dict], outputs: list[dict], facets: dict | None = None) -> dict:
        event = {
            "eventType": kind,
            "eventTime": datetime.now(UTC).isoformat(),
            "producer": self.config.producer,
            "run": {"runId": self.run_id, "facets": (facets or {}) | ({"actor": {"name": self.config.actor}} if self.config.actor else {})},
            "job": {"namespace": self.config.namespace, "name": self.config.job_name},
            "inputs": inputs,
            "outputs": outputs,
        }
        if self.config.emit:
            self.events.append(event)
        return event

    def dataset(self, name: str, df: DataFrame) -> dict:
        return {"namespace": self.config.namespace, "name": name, "facets": {"schema": {"fields": schema_of(df)}}}

    def start(self, df: DataFrame, name: str = "input") -> dict:
        return self._event("START", [self.dataset(name, df)], [])

    def complete(self, before: DataFrame, after: DataFrame, facets: dict | None = None, names: tuple[str, str] = ("input", "output")) -> dict:
        out = self.dataset(names[1], after)
        out["facets"]["columnLineage"] = {"fields": {n: {"inputFields": [{"namespace": self.config.namespace, "name": names[0], "field": n}]} for n in after.columns if n in before.columns}}
        return self._event("COMPLETE", [self.dataset(names[0], before)], [out], facets)

    def fail(self, error: str) -> dict:
        return self._event("FAIL", [], [], {"errorMessage": {"message": error}})

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(e) + "\n" for e in self.events)
