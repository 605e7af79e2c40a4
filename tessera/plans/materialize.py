"""Result tables: manifests, verification, staleness, memoization, lineage, recompute.

A result is written to a new directory and becomes visible when its manifest and
catalog row are written last; a row that stays ``building`` is reaped.  Artifact
digests are taken over the rows, not the files: each row is hashed in the JVM and
the hashes are summed in two independent ways, so the digest is one distributed
aggregate and does not depend on partitioning or file layout.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.files import FileStore

VERSION = "1"


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def definition_hash(descriptor: dict, environment: dict) -> str:
    h = hashlib.sha256(b"tessera-definition-1")
    for part in (canonical(descriptor), canonical(environment)):
        data = part.encode()
        h.update(len(data).to_bytes(8, "little") + data)
    return h.hexdigest()


def rows_digest(df: DataFrame) -> str:
    """A digest of the multiset of rows."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    wide = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    got = df.select(F.xxhash64(row).cast("decimal(38,0)").alias("a"), wide.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    names = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))
    return hashlib.sha256(f"{names}|{got['n']}|{got['a']}|{got['b']}".encode()).hexdigest()


@dataclass
class Anchor:
    """What an input was when it was read: a result's digest, a table's version, or an instant (unpinned)."""

    kind: str  # result, mutable, source, unpinned
    name: str
    value: str

    @property
    def pinned(self) -> bool:
        return self.kind != "unpinned"


@dataclass
class Record:
    name: str
    kind: str
    path: str
    status: str
    owner: str | None
    created: float
    manifest: dict | None = None


@dataclass
class ResultStore:
    spark: SparkSession
    root: str
    environment: dict = field(default_factory=lambda: {"engine": VERSION})
    producers: dict[str, Callable[[dict], tuple[DataFrame, list[Anchor]]]] = field(default_factory=dict)
    versions: Callable[[Anchor], str | None] = lambda anchor: None

    def __post_init__(self):
        self.files = FileStore(self.spark)
        self.records: dict[str, Record] = {}
        for path in self.files.list(f"{self.root}/catalog"):
            row = json.loads(self.files.read(path))
            self.records[row["name"]] = Record(**row)
        self.recover()

    def recover(self) -> None:
        """Promote building rows whose manifest is there; reap the others."""
        for record in list(self.records.values()):
            if record.status == "building":
                if self.files.exists(f"{record.path}/_manifest.json"):
                    record.status, record.manifest = "ready", json.loads(self.files.read(f"{record.path}/_manifest.json"))
                    self._save(record)
                else:
                    self.drop(record.name)

    def _save(self, record: Record) -> None:
        self.files.write(f"{self.root}/catalog/{record.name}.json", json.dumps(record.__dict__))

    def create(self, kind: str, descriptor: dict, df: DataFrame, anchors: list[Anchor], owner: str | None = None, cache: str = "bypass") -> Record:
        """Write a result; with ``cache='use'`` an equal definition over equal pinned inputs is reused."""
        wanted = definition_hash(descriptor, self.environment)
        held = [a.__dict__ for a in anchors]
        if cache == "use" and all(a.pinned for a in anchors):
            hits = [r for r in self.records.values() if r.status == "ready" and r.manifest and r.manifest["definition"] == wanted and r.manifest["anchors"] == held and self.files.exists(r.path)]
            if hits:
                return max(hits, key=lambda r: r.created)
        name = f"{kind}_{uuid.uuid4().hex[:12]}"
        record = Record(name, kind, f"{self.root}/data/{name}", "building", owner, time.time())
        self.records[name] = record
        self._save(record)
        df.write.parquet(f"{record.path}/rows")
        record.manifest = {"descriptor": descriptor, "definition": wanted, "digest": rows_digest(self.read(name)), "anchors": held}
        self.files.write(f"{record.path}/_manifest.json", json.dumps(record.manifest))
        record.status = "ready"
        self._save(record)
        return record

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.records[name].path}/rows")

    def drop(self, name: str) -> None:
        record = self.records.pop(name, None)
        if record:
            self.files.delete(record.path)
            self.files.delete(f"{self.root}/catalog/{name}.json")

    def newest(self, kind: str, visible: Callable[[str | None], bool] = lambda owner: True) -> Record | None:
        ready = [r for r in self.records.values() if r.kind == kind and r.status == "ready" and visible(r.owner)]
        return max(ready, key=lambda r: (r.created, r.name), default=None)

    def verify(self, name: str) -> str:
        """match, mismatch, match_with_unpinned_inputs or missing_manifest."""
        record = self.records[name]
        if not record.manifest:
            return "missing_manifest"
        if rows_digest(self.read(name)) != record.manifest["digest"]:
            return "mismatch"
        return "match" if all(a["kind"] != "unpinned" for a in record.manifest["anchors"]) else "match_with_unpinned_inputs"

    def staleness(self, name: str) -> tuple[str, list[str]]:
        """fresh, stale (with reasons), undecidable or missing_manifest."""
        record = self.records[name]
        if not record.manifest:
            return "missing_manifest", []
        reasons, unsure = [], []
        if definition_hash(record.manifest["descriptor"], self.environment) != record.manifest["definition"]:
            reasons.append("the environment changed")
        for a in (Anchor(**x) for x in record.manifest["anchors"]):
            if not a.pinned:
                unsure.append(a.name)
                continue
            now = self._now(a)
            if now is None:
                reasons.append(f"{a.name} is gone")
            elif now != a.value:
                reasons.append(f"{a.name} changed")
        if reasons:
            return "stale", reasons
        return ("undecidable", unsure) if unsure else ("fresh", [])

    def _now(self, anchor: Anchor) -> str | None:
        if anchor.kind == "result":
            held = self.records.get(anchor.name)
            return held.manifest["digest"] if held and held.manifest else None
        return self.versions(anchor)

    def derives_from(self, name: str) -> list[str]:
        record = self.records.get(name)
        return [a["name"] for a in record.manifest["anchors"] if a["kind"] == "result"] if record and record.manifest else []

    def closure(self, name: str) -> list[str]:
        """All ancestors, each once, nearest first in depth-first order; a cycle raises."""
        out: list[str] = []

        def visit(at: str, trail: tuple[str, ...]) -> None:
            for parent in self.derives_from(at):
                if parent in trail:
                    raise ValueError(f"cycle through {parent}")
                if parent not in out:
                    out.append(parent)
                    visit(parent, (*trail, parent))

        visit(name, (name,))
        return out

    def recompute(self, name: str, downstream: bool = False) -> list[Record]:
        """Replay a result's descriptor, and with ``downstream`` those of all that derive from it, inputs first."""
        names = [name]
        if downstream:
            names += sorted((n for n in self.records if name in self.closure(n)), key=lambda n: (len(self.closure(n)), n))
        made = []
        for n in names:
            record = self.records[n]
            kind = (record.manifest or {}).get("descriptor", {}).get("verb")
            if kind not in self.producers:
                raise ValueError(f"{n} can't be recomputed")
            df, anchors = self.producers[kind](record.manifest["descriptor"])
            fresh = self.create(record.kind, record.manifest["descriptor"], df, anchors, record.owner)
            # the new rows take the old name's place, so what derives from it by name sees them
            self.records[n] = Record(n, record.kind, fresh.path, "ready", record.owner, fresh.created, fresh.manifest)
            self.records.pop(fresh.name)
            self.files.delete(f"{self.root}/catalog/{fresh.name}.json")
            self._save(self.records[n])
            made.append(self.records[n])
        return made
