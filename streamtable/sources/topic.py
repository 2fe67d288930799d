"""Topics: append-only tables of Parquet shards, a time column first.

A shard is a folder with the Parquet files of one append. It is written into `staged/`, counts once the registry's log lists it,
and is then renamed into `live/` in one step; whoever reads or writes the topic next finishes a rename that was left undone.
Streams read `live/` as a file source, so what is appended later reaches them, and nothing that wasn't committed. A batch read also
has the rows that open publishers of its process still hold.
Compaction writes into `compacted/`, which no running stream takes up, and swaps the list in one transaction; replaced shards stay
in `live/` until vacuum.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from streamtable.errors import ConcurrentChange, TableKindError
from streamtable.plans.registry import Registry, new_id
from streamtable.types import TopicInfo

if TYPE_CHECKING:
    from streamtable.rows import Publisher


class Topic:
    """A topic of a datastore."""

    kind = "topic"

    def __init__(self, session: SparkSession, registry: Registry, name: tuple[str, str, str], table: dict):
        self.session, self.registry, self.name, self.id = session, registry, name, table["id"]
        self.info = TopicInfo.from_json(table["topic"])
        self.root = registry.store.path("data", self.id)

    def __repr__(self) -> str:
        return f"Topic({'.'.join(self.name)})"

    @property
    def schema(self):
        return self.info.schema()

    def shards(self) -> list[dict]:
        """Committed shards: id, path and rows."""
        self.registry.refresh()
        shards = self.registry.table(self.name)["shards"]
        self._settle(shards)
        return shards

    def _settle(self, shards: list[dict]) -> None:
        """Rename committed shards that are still where they were written."""
        store, known = self.registry.store, {s["id"] for s in shards}
        for name in store.names(f"{self.root}/staged"):
            if name in known:
                try:
                    store.rename(f"{self.root}/staged/{name}", f"{self.root}/live/{name}")
                except Exception:
                    if not store.exists(f"{self.root}/live/{name}"):  # not by another handle either
                        raise

    def _folder(self, shard: dict) -> str:
        return f"{self.root}/{shard['path']}"

    # Reading

    def read(self) -> DataFrame:
        """All committed rows, and those that open publishers of this process hold. Filters, columns and limits reach the scan."""
        held = [df for p in list(self.registry.publishers.get(self.id, ())) if (df := p.held()) is not None]
        paths = [] if self.info.temporary else [self._folder(s) for s in self.shards()]
        # The reader takes stored columns as nullable; the schema's metadata is put back, as reading drops none of it.
        out = self.session.read.schema(self._stored()).parquet(*paths) if paths else self.session.createDataFrame([], self._stored())
        for df in held:
            out = out.unionByName(self.info.conform(df).to(self._stored()))
        return out

    def _stored(self):
        from pyspark.sql import types as T

        return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in self.schema.fields])

    def history(self, before=None) -> DataFrame:
        """Committed rows up to a time, by default now."""
        limit = F.lit(before) if before is not None else F.current_timestamp()
        return self.read().where(F.col(f"`{self.info.time_column}`") < limit)

    def version(self) -> int:
        self.registry.refresh()
        return self.registry.version

    def subscribe(self, history: bool = True, since=None, shards: list[dict] | None = None, max_files: int | None = None) -> DataFrame:
        """A stream of the topic: committed rows first and then what is appended, each once; or only rows after `since`.

        Compacted shards are read from their own folder as they are now. To go on from a checkpoint, pass the same list of
        `shards` as the first time (`topic.shards()` then), so that both times the same files are left out.
        """
        store = self.registry.store
        store.make_dir(f"{self.root}/live")
        store.make_dir(f"{self.root}/compacted")
        now = self.shards() if shards is None else shards

        def files(folder: str) -> DataFrame:
            reader = self.session.readStream.schema(self._stored()).option("recursiveFileLookup", "true")
            if max_files:
                reader = reader.option("maxFilesPerTrigger", max_files)
            return reader.parquet(f"{self.root}/{folder}").withColumn("_shard", F.regexp_extract(F.col("_metadata.file_path"), rf"/{folder}/([0-9a-f]+)/", 1))

        merged = {s["id"]: s.get("of", []) for s in now if s["path"].startswith("compacted/")}
        replaced = [x for of in merged.values() for x in of]
        out = files("live")
        if replaced:
            out = out.where(~F.col("_shard").isin(replaced))
        if merged:
            out = out.unionByName(files("compacted").where(F.col("_shard").isin(list(merged))))
        out = out.drop("_shard")
        if not history and since is None:
            since = self.session.range(1).select(F.current_timestamp()).first()[0]
        return out if since is None else out.where(F.col(f"`{self.info.time_column}`") > F.lit(since))

    # Writing

    def append(self, df: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """Append a DataFrame's rows as one shard; returns their number. Without rows there is no shard.

        With a mark, a stream's name and the number of its batch, nothing is appended if that batch is there already.
        """
        shard = new_id()
        store, staged = self.registry.store, f"{self.root}/staged/{shard}"
        seen = Observation()
        rows = self.info.conform(df).observe(seen, F.count(F.lit(1)).alias("n")).sortWithinPartitions(*self.info.order())
        writer = rows.write.option("maxRecordsPerFile", self.info.config.target_shard_rows).option("parquet.block.size", self.info.config.row_group_bytes)
        writer.parquet(staged)
        n = seen.get.get("n", 0)
        if not n:
            store.delete(staged)
            return 0
        if self.info.temporary:
            store.rename(staged, f"{self.root}/live/{shard}")
            return n
        try:
            new = self.registry.swap_shards(self.name, self.id, [{"id": shard, "path": f"live/{shard}", "rows": n}], mark=mark)
        except Exception:
            self.registry.refresh()  # the commit may have been written all the same
            t = self.registry.table(self.name) if self.registry.has(self.name) else {"shards": []}
            if shard not in {s["id"] for s in t["shards"]}:
                store.delete(staged)
            raise
        if not new:
            store.delete(staged)
            return 0
        self._settle([{"id": shard}])
        return n

    def publish(self, buffer_rows: int | None = None) -> "Publisher":
        """A publisher of single rows."""
        from streamtable.rows import Publisher

        return Publisher(self, buffer_rows or self.info.config.write_batch_rows)

    def append_stream(self, stream: DataFrame, checkpoint: str, **trigger):
        """Append a stream's micro-batches, each once: its number is committed together with its rows under the checkpoint's name."""
        name = checkpoint.rstrip("/")

        def batch(df: DataFrame, number: int) -> None:
            self.registry.refresh()
            if self.info.temporary or self.registry.table(self.name).get("marks", {}).get(name, -1) < number:
                self.append(df, (name, number))

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    # Maintenance

    def compact(self) -> int:
        """Merge shards below the target size, each time until they reach it; returns how many were replaced.

        Smallest first. A shard from the minimum on is left until smaller ones have half its rows together: so each writing makes
        the shard of a row larger by half at least, however often something small is appended.
        """
        config = self.info.config
        below = sorted((s for s in self.shards() if s["rows"] < config.target_shard_rows), key=lambda s: s["rows"])
        live = set(self.registry.store.names(f"{self.root}/live"))
        groups: list[list[dict]] = []
        size = 0
        for s in below:
            early = s["rows"] >= config.min_shard_rows and 2 * size < s["rows"]
            if not groups or size >= config.target_shard_rows or early:
                groups.append([])
                size = 0
            groups[-1].append(s)
            size += s["rows"]
        replaced = 0
        for group in groups:
            if len(group) < 2:
                continue
            shard = new_id()
            path = f"compacted/{shard}"
            df = self.session.read.schema(self._stored()).parquet(*map(self._folder, group))
            rows = sum(s["rows"] for s in group)
            # By time, so that files hold ranges of it and a filter on time skips the others.
            n_files = -(-rows // self.info.config.min_shard_rows)
            out = (df.coalesce(1) if n_files == 1 else df.repartitionByRange(n_files, F.col(f"`{self.info.time_column}`"))).sortWithinPartitions(*self.info.order())
            out.write.option("parquet.block.size", self.info.config.row_group_bytes).parquet(f"{self.root}/{path}")
            # What streams must leave out: merged shards whose files vacuum hasn't removed yet.
            of = [x for s in group for x in (s.get("of") or [s["id"]]) if x in live]
            try:
                self.registry.swap_shards(self.name, self.id, [{"id": shard, "path": path, "rows": rows, "of": of}], [s["id"] for s in group])
            except ConcurrentChange:
                self.registry.store.delete(f"{self.root}/{path}")
                raise
            replaced += len(group)
        return replaced

    def vacuum(self, older_than_s: float = 7 * 86400) -> list[str]:
        """Delete folders that no transaction lists and that are old enough for no reader or writer to need them."""
        store, shards, gone = self.registry.store, self.shards(), []
        kept = {s["path"] for s in shards} | {f"staged/{s['id']}" for s in shards}
        if self.info.temporary:
            return gone
        for folder in ("staged", "live", "compacted"):
            for name in store.names(f"{self.root}/{folder}"):
                path = f"{folder}/{name}"
                if path not in kept and store.age_ms(f"{self.root}/{path}") >= older_than_s * 1000:
                    store.delete(f"{self.root}/{path}")
                    gone.append(path)
        return gone

    def drop_data(self) -> None:
        self.registry.store.delete(self.root)


class View:
    """A stored query, planned anew for each read."""

    kind = "view"

    def __init__(self, datastore, name: tuple[str, str, str], table: dict):
        self._datastore, self.name, self.id = datastore, name, table["id"]
        self.query, self.materialized, self.indices = table["query"], table.get("materialized", False), [tuple(x) for x in table.get("indices", [])]
        self._catalog, self._schema = table["catalog"], table["schema"]

    def __repr__(self) -> str:
        return f"View({'.'.join(self.name)})"

    @property
    def schema(self):
        return self.read().schema

    def _folder(self) -> str:
        return self._datastore.registry.store.path("data", self.id)

    def read(self) -> DataFrame:
        if self.materialized:
            path = self._folder()
            store = self._datastore.registry.store
            versions = [n for n in store.names(path) if n.startswith("v")]
            return self._datastore.session.read.parquet(f"{path}/{versions[-1]}")
        return self._datastore._plan(self.query, self._catalog, self._schema)

    def refresh(self) -> None:
        """Compute a materialized view again; readers see the old rows until the new ones are complete."""
        if not self.materialized:
            return
        store, path, version = self._datastore.registry.store, self._folder(), f"v{new_id()}"
        df = self._datastore._plan(self.query, self._catalog, self._schema)
        if self.indices:
            df = df.sortWithinPartitions(*(F.col(f"`{n}`").asc_nulls_first() if up else F.col(f"`{n}`").desc_nulls_first() for n, up in self.indices))
        df.write.parquet(f"{path}/staged-{version}")
        store.rename(f"{path}/staged-{version}", f"{path}/{version}")
        # The version before stays for those who read it now.
        for name in [n for n in store.names(path) if n.startswith("v")][:-2]:
            store.delete(f"{path}/{name}")

    def append(self, df: DataFrame) -> int:
        raise TableKindError(f"{'.'.join(self.name)} is a view")

    def publish(self, buffer_rows: int | None = None):
        raise TableKindError(f"{'.'.join(self.name)} is a view")

    def subscribe(self, *_, **__):
        raise TableKindError(f"{'.'.join(self.name)} is a view; subscribe to its topic")

    def drop_data(self) -> None:
        self._datastore.registry.store.delete(self._folder())
