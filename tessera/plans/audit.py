"""A signed audit log: canonical JSON under HMAC-SHA256 with a key derived for each tenant."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINEAGE_BYTES = 8192
FIELDS = ("query_id", "tenant_id", "model_id", "model_version", "query_lineage", "top_k_result_ids", "retrieval_scores", "executed_at")
SCHEMA = "query_id string, tenant_id string, model_id string, model_version string, query_lineage string, top_k_result_ids string, retrieval_scores string, executed_at long, signature string"


def derive_key(secret: bytes, tenant: str) -> bytes:
    """HKDF-SHA256 with the tenant as its info."""
    pseudo = hmac.new(b"tessera-audit", secret, hashlib.sha256).digest()
    return hmac.new(pseudo, tenant.encode() + b"\x01", hashlib.sha256).digest()


class AuditLog:
    def __init__(self, spark: SparkSession, path: str, secret: bytes):
        self.spark, self.path, self.secret = spark, path, secret

    def sign(self, record: dict) -> str:
        body = json.dumps({k: record[k] for k in FIELDS}, sort_keys=True, separators=(",", ":"))
        return hmac.new(derive_key(self.secret, record["tenant_id"]), body.encode(), hashlib.sha256).hexdigest()

    def append(self, tenant: str, model_id: str, model_version: str, lineage: dict, ids: list[str], scores: list[float]) -> str:
        if not tenant:
            raise ValueError("an audit record has a tenant")
        text = json.dumps(lineage, sort_keys=True)
        if len(text.encode()) > LINEAGE_BYTES:
            raise ValueError("the lineage is over 8 KiB")
        record = dict(zip(FIELDS, (str(uuid.uuid4()), tenant, model_id, model_version, text, json.dumps(ids), json.dumps(scores), int(time.time() * 1e6)), strict=True))
        record["signature"] = self.sign(record)
        self.spark.createDataFrame([tuple(record[x.split()[0]] for x in SCHEMA.split(", "))], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return record["query_id"]

    def records(self, tenant: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).filter(F.col("tenant_id") == tenant)

    def by_id(self, tenant: str, query_id: str) -> dict | None:
        found = self.records(tenant).filter(F.col("query_id") == query_id).limit(1).collect()
        return found[0].asDict() if found else None

    def recent(self, tenant: str, n: int) -> DataFrame:
        return self.records(tenant).orderBy(F.desc("executed_at"), "query_id").limit(n)

    def verify(self, record: dict) -> bool:
        return hmac.compare_digest(self.sign(record), record["signature"])
