"""Tenant scope: a context-local binding, and the predicate it puts on every relation."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADMIN = object()


class Tenancy:
    """A sticky default, overridden inside ``scope``; ``admin`` lifts the filters."""

    def __init__(self):
        self._sticky: str | None = None
        self._scoped: ContextVar = ContextVar("tenant", default=False)

    @staticmethod
    def checked(tenant: str) -> str:
        value = uuid.UUID(tenant)
        if value.int == 0:
            raise ValueError("the nil id is no tenant")
        return str(value)

    def bind(self, tenant: str) -> None:
        """Stick to a tenant; an empty string clears it."""
        self._sticky = self.checked(tenant) if tenant else None

    @property
    def current(self):
        scoped = self._scoped.get()
        return self._sticky if scoped is False else scoped

    @contextlib.contextmanager
    def scope(self, tenant: str | None) -> Iterator[None]:
        token = self._scoped.set(self.checked(tenant) if tenant else None)
        try:
            yield
        finally:
            self._scoped.reset(token)

    @contextlib.contextmanager
    def admin(self) -> Iterator[None]:
        token = self._scoped.set(ADMIN)
        try:
            yield
        finally:
            self._scoped.reset(token)

    def apply(self, df: DataFrame, column: str | None = None) -> DataFrame:
        """Rows of the tenant and rows of none; only rows of none where no tenant is bound."""
        column = column or ("tenant_id" if "tenant_id" in df.columns else None)
        now = self.current
        if now is ADMIN or column is None or column not in df.columns:
            return df
        own = F.col(column).isNull()
        return df.filter(own if now is None else (F.col(column).cast("string") == now) | own)

    def visible(self, owner: str | None) -> bool:
        return self.current is ADMIN or owner is None or owner == self.current
