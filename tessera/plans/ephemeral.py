"""Ephemeral sessions: a tenant's temporary tables, dropped at the end or after a time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class EphemeralSession:
    def __init__(self, spark: SparkSession, tenant: str | None, timeout_s: float | None = None, on_end: Callable[[str, str], None] | None = None):
        if not tenant:
            raise PermissionError("an ephemeral session has a tenant")
        self.spark, self.tenant, self.id, self.on_end = spark, tenant, uuid.uuid4().hex, on_end
        self.views: dict[str, str] = {}
        self.open = True
        self._timer = threading.Timer(timeout_s, self.close, ("timeout",)) if timeout_s else None
        if self._timer:
            self._timer.daemon = True
            self._timer.start()

    def put(self, name: str, df: DataFrame) -> str:
        if not self.open:
            raise RuntimeError("the session is closed")
        view = f"__eph_{self.id}_{name}"
        df.createOrReplaceTempView(view)
        self.views[name] = view
        return view

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.views[name])

    def close(self, reason: str = "closed") -> None:
        if self.open:
            self.open = False
            if self._timer:
                self._timer.cancel()
            for view in self.views.values():
                self.spark.catalog.dropTempView(view)
            self.views.clear()
            if self.on_end:
                self.on_end(self.id, reason)

    def __enter__(self) -> EphemeralSession:
        return self

    def __exit__(self, *_exc) -> None:
        self.close()
