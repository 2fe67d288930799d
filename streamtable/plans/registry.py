"""Catalogs, schemas and tables, kept as a log of JSON transactions with snapshots.

Each change is one new file, log/<number>.json, created only if it isn't there: of two processes that change the datastore at
once, one gets ConcurrentChange and looks again. State is the newest snapshot with the later transactions applied in order. A
handle that has fallen behind a snapshot starts from it again, no transaction takes a number that a snapshot covers, and a
transaction stays in the log for a grace time after its snapshot, so that its number isn't free while others may still be at it.
"""

from __future__ import annotations

import copy
import re
import threading
import time

from streamtable.errors import CatalogExists, CatalogNotFound, ConcurrentChange, SchemaExists, SchemaNotEmpty, SchemaNotFound, StreamtableError, TableExists, TableKindError, TableNotFound
from streamtable.sources.store import Store

DEFAULT_CATALOG, DEFAULT_SCHEMA = "main", "public"
#: How long what a snapshot covers is kept.
GRACE_MS = 3_600_000
_NAME = re.compile(r"[^\W\d]\w*\Z")
_lock, _last = threading.Lock(), [0]


def new_id() -> str:
    """Ids in the order of their making: microseconds, made unique."""
    with _lock:
        _last[0] = max(_last[0] + 1, time.time_ns() // 1000)
        return f"{_last[0]:016x}"


def check_name(name: str) -> str:
    if not _NAME.match(name):
        raise StreamtableError(f"{name!r} is not a name")
    return name


class Registry:
    """Names and definitions. A table is a dict with id, kind (topic or view) and what its kind needs."""

    def __init__(self, store: Store):
        self.store = store
        #: Open publishers of this process by table id; what they hold is read with the table.
        self.publishers: dict[str, list] = {}
        self.version = -1
        self.catalogs: dict = {}
        self.refresh()

    # Durability

    def refresh(self) -> None:
        """Take up what others have changed."""
        for attempt in range(5):
            newest = self._newest()
            try:
                if newest is not None and newest > self.version:
                    x = self.store.read_json(self.store.path("snapshots", f"{newest:020d}.json"))
                    self.version, self.catalogs = x["version"], x["catalogs"]
                for n in self._numbers("log"):
                    if n > self.version:
                        if n > self.version + 1 and self.version >= 0:
                            break  # removed under a snapshot that is newer than the one seen
                        self._apply(self.store.read_json(self.store.path("log", f"{n:020d}.json")))
                        self.version = n
                else:
                    return
            except Exception as e:
                if "FileNotFound" not in str(e) or attempt == 4:
                    raise
        raise ConcurrentChange("the registry changes faster than it can be read")

    def _numbers(self, folder: str) -> list[int]:
        return [int(n[:-5]) for n in self.store.names(self.store.path(folder)) if n.endswith(".json") and n[:-5].isdigit()]

    def _newest(self) -> int | None:
        return max(self._numbers("snapshots"), default=None)

    def commit(self, *changes: dict) -> None:
        """Write changes as one transaction, then apply them."""
        newest = self._newest()
        if newest is not None and newest > self.version:
            raise ConcurrentChange(f"a snapshot holds transaction {newest}, this handle is at {self.version}")
        entry = {"id": new_id(), "changes": list(changes)}
        self.store.write_json(self.store.path("log", f"{self.version + 1:020d}.json"), entry)
        self._apply(entry)
        self.version += 1

    def change(self, make, attempts: int = 20):
        """Commit make(self)'s changes, again after a refresh if another process was first. make returns (changes, result)."""
        for k in range(attempts):
            self.refresh()
            changes, result = make()
            try:
                if changes:
                    self.commit(*changes)
                return result
            except ConcurrentChange:
                if k == attempts - 1:
                    raise

    def snapshot(self, grace_ms: int = GRACE_MS) -> None:
        """Write the whole state, and remove older snapshots and the transactions it holds after the grace time."""
        self.refresh()
        if self.version < 0:
            return
        path = self.store.path("snapshots", f"{self.version:020d}.json")
        if not self.store.exists(path):
            try:
                self.store.write_json(path, {"version": self.version, "catalogs": self.catalogs})
            except ConcurrentChange:  # another handle at this version was first
                pass
        for folder, last in (("log", self.version), ("snapshots", self.version - 1)):
            for n in self._numbers(folder):
                old = self.store.path(folder, f"{n:020d}.json")
                if n <= last and self.store.age_ms(old) >= grace_ms:
                    self.store.delete(old)

    def _apply(self, entry: dict) -> None:
        for c in entry["changes"]:
            kind, catalog, schema, table = c["kind"], c.get("catalog"), c.get("schema"), c.get("table")
            if kind == "create_catalog":
                self.catalogs[catalog] = {}
            elif kind == "drop_catalog":
                self.catalogs.pop(catalog, None)
            elif kind == "create_schema":
                self.catalogs[catalog][schema] = {}
            elif kind == "drop_schema":
                self.catalogs[catalog].pop(schema, None)
            elif kind == "create_table":
                self.catalogs[catalog][schema][table] = copy.deepcopy(c["definition"])
            elif kind == "drop_table":
                self.catalogs[catalog][schema].pop(table, None)
            elif kind == "shards":
                t = self.catalogs.get(catalog, {}).get(schema, {}).get(table)
                if t and t["id"] == c["id"]:
                    t["shards"] = [s for s in t["shards"] if s["id"] not in c["remove"]] + c["add"]
                    t.setdefault("marks", {}).update(c.get("marks", {}))
            else:
                raise StreamtableError(f"an unknown change: {kind}")

    # Names

    def schema(self, catalog: str, schema: str) -> dict:
        if catalog not in self.catalogs:
            raise CatalogNotFound(catalog)
        if schema not in self.catalogs[catalog]:
            raise SchemaNotFound(f"{catalog}.{schema}")
        return self.catalogs[catalog][schema]

    def table(self, name: tuple[str, str, str]) -> dict:
        tables = self.schema(*name[:2])
        if name[2] not in tables:
            raise TableNotFound(".".join(name))
        return tables[name[2]]

    def has(self, name: tuple[str, str, str]) -> bool:
        return name[2] in self.catalogs.get(name[0], {}).get(name[1], {})

    # Changes

    def create_catalog(self, catalog: str, if_not_exists: bool = False) -> None:
        check_name(catalog)

        def make():
            if catalog in self.catalogs:
                if not if_not_exists:
                    raise CatalogExists(catalog)
                return [], None
            return [{"kind": "create_catalog", "catalog": catalog}, {"kind": "create_schema", "catalog": catalog, "schema": DEFAULT_SCHEMA}], None

        self.change(make)

    def drop_catalog(self, catalog: str, if_exists: bool = False, cascade: bool = False) -> list[dict]:
        def make():
            if catalog not in self.catalogs:
                if not if_exists:
                    raise CatalogNotFound(catalog)
                return [], []
            gone = [t for s in self.catalogs[catalog].values() for t in s.values()]
            if not cascade and (gone or set(self.catalogs[catalog]) - {DEFAULT_SCHEMA}):
                raise SchemaNotEmpty(f"catalog {catalog} is not empty")
            return [{"kind": "drop_catalog", "catalog": catalog}], gone

        return self.change(make)

    def create_schema(self, catalog: str, schema: str, if_not_exists: bool = False) -> None:
        check_name(schema)

        def make():
            if catalog not in self.catalogs:
                raise CatalogNotFound(catalog)
            if schema in self.catalogs[catalog] or schema == "information_schema":
                if not if_not_exists:
                    raise SchemaExists(f"{catalog}.{schema}")
                return [], None
            return [{"kind": "create_schema", "catalog": catalog, "schema": schema}], None

        self.change(make)

    def drop_schema(self, catalog: str, schema: str, if_exists: bool = False, cascade: bool = False) -> list[dict]:
        def make():
            if schema not in self.catalogs.get(catalog, {}):
                if not if_exists:
                    raise SchemaNotFound(f"{catalog}.{schema}")
                return [], []
            gone = list(self.catalogs[catalog][schema].values())
            if gone and not cascade:
                raise SchemaNotEmpty(f"{catalog}.{schema} is not empty")
            return [{"kind": "drop_schema", "catalog": catalog, "schema": schema}], gone

        return self.change(make)

    def create_table(self, name: tuple[str, str, str], definition: dict, if_not_exists: bool = False, or_replace: bool = False) -> tuple[dict, dict | None]:
        """(the table, the one it replaced). An existing table of the same kind is returned under if_not_exists."""
        check_name(name[2])

        def make():
            tables = self.schema(*name[:2])
            old = tables.get(name[2])
            place = dict(zip(("catalog", "schema", "table"), name))
            changes = []
            if old is not None:
                if if_not_exists and or_replace:
                    raise StreamtableError("a table is either kept or replaced if it exists, not both")
                if if_not_exists:
                    if old["kind"] != definition["kind"]:
                        raise TableKindError(f"{'.'.join(name)} is a {old['kind']}")
                    return [], (old, None)
                if not or_replace:
                    raise TableExists(".".join(name))
                changes.append({"kind": "drop_table", **place})
            new = {"id": new_id(), **definition}
            changes.append({"kind": "create_table", "definition": new, **place})
            return changes, (new, old)

        new, old = self.change(make)
        return self.table(name), old

    def drop_table(self, name: tuple[str, str, str], kind: str, if_exists: bool = False) -> dict | None:
        def make():
            if not self.has(name) or self.table(name)["kind"] != kind:
                if not if_exists:
                    raise TableNotFound(".".join(name))
                return [], None
            return [{"kind": "drop_table", **dict(zip(("catalog", "schema", "table"), name))}], self.table(name)

        return self.change(make)

    def swap_shards(self, name: tuple[str, str, str], table_id: str, add: list[dict], remove: list[str] = (), mark: tuple[str, int] | None = None) -> bool:
        """Add and remove shards of a table in one transaction. A mark is a stream's name and the number of its batch: if the
        table is at that batch already, nothing is done and the result is False.
        """

        def make():
            t = self.table(name)
            if t["id"] != table_id:
                raise TableNotFound(f"{'.'.join(name)} was replaced")
            if mark and t.get("marks", {}).get(mark[0], -1) >= mark[1]:
                return [], False
            if set(remove) - {s["id"] for s in t["shards"]}:
                raise ConcurrentChange("a shard to be replaced is gone")
            marks = dict([mark]) if mark else {}
            return [{"kind": "shards", "id": table_id, "add": add, "remove": list(remove), "marks": marks, **dict(zip(("catalog", "schema", "table"), name))}], True

        return self.change(make)
