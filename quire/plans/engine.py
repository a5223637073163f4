"""Engine: collections under one root folder, committed by versioned manifests.

Data folders are never changed once written. A commit writes new folders and then one manifest, which names the folders of
every collection; it becomes visible by one rename that fails if another writer took the version. Readers look at one
manifest, so what they see does not change. All files go through Hadoop's file system; a store without an atomic rename
needs a committer that has one.

A change adds a layer to a collection: rows that come, and keys that go. Readers merge the layers: a row is hidden if a later
layer lists its key. So a commit writes as much as changes, not as much as is stored; when there are many layers, the newest
are written together, and all of them once they outweigh the first. The log of a storage has only rows that come, and its
layers know their lowest and highest id, by which predecessors are looked up.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.common import cut, scratch
from quire.errors import CommitConflict, DatabaseError
from quire.operators import index as ix
from quire.operators import storage as st
from quire.operators.aggregate_by import aggregate_by
from quire.operators.aggregates import Spec, revision
from quire.operators.view import View
from quire.plans.locks import KeyLocks

# Purposes of collections.
STORAGE, INDEX, UNIQUE_INDEX, MAP, AGGREGATE, UNDEFINED = "S", "I", "U", "M", "A", "?"
MAX_COLLECTIONS = 255
BIG_BATCH = 131_072
#: Layers of a collection from which on they are written together.
LAYERS = 8
#: Attempts of a background refresh against other writers.
ATTEMPTS = 5


class Files:
    """The few file operations a manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(self.root))

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.path(self.root))]

    def read(self, name: str) -> str:
        rows = self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()
        return rows[0][0]

    def write_once(self, name: str, text: str) -> bool:
        """Makes the file appear complete, unless it is there already."""
        staged = self.path(f"{self.root}/.staged-{uuid.uuid4().hex}")
        out = self.fs.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self.path(f"{self.root}/{name}")
        if self.fs.exists(target) or not self.fs.rename(staged, target):
            self.fs.delete(staged, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def size(self, folder: str) -> tuple[int, int]:
        """(files, bytes) of a folder."""
        s = self.fs.getContentSummary(self.path(folder))
        return int(s.getFileCount()), int(s.getLength())


@dataclass
class Layer:
    """Rows that come (`data`), keys that go (`gone`), and of a log its lowest and highest id; folders or None."""

    data: str | None = None
    gone: str | None = None
    low: int | None = None
    high: int | None = None

    def folders(self) -> list[str]:
        return [f for f in (self.data, self.gone) if f]


@dataclass
class Collection:
    """`keyed`: columns by which a later layer hides rows of earlier ones."""

    kid: int
    name: str
    purpose: str
    layers: list[Layer] = field(default_factory=list)
    keyed: list[str] = field(default_factory=list)
    schema: str = ""
    next_id: int = 1
    revision: str = ""
    last_seen: int = 0
    private: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.layers = [x if isinstance(x, Layer) else Layer(**x) for x in self.layers]

    def folders(self) -> list[str]:
        return [f for layer in self.layers for f in layer.folders()]


class BatchListener:
    """Told about every batch; an exception from `before_commit` rolls the batch back."""

    def before_commit(self, batch: Batch) -> None: ...

    def after_commit(self, version: int) -> None: ...

    def on_rollback(self, batch: Batch) -> None: ...


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


class Engine:
    """`Engine(spark, root)`; with `version` or `read_only` it reads one version and writes nothing. With `overlay` it can
    be written to, but data go to a folder of their own and are dropped on closing; the root stays as it is."""

    def __init__(self, spark: SparkSession, root: str, *, version: int | None = None, read_only: bool = False, overlay: bool = False):
        self.spark, self.files = spark, Files(spark, root)
        self.read_only = (read_only or version is not None) and not overlay
        self.overlay = Files(spark, scratch(spark, "overlay")) if overlay else None
        self.key_observers: dict[str, list[Callable[[DataFrame], None]]] = {}
        self.batch_listeners: list[BatchListener] = []
        self.locks = KeyLocks()
        self.auto_update: dict[str, bool] = {}
        self._worker: ThreadPoolExecutor | None = None
        self._jobs: list[Future] = []
        self._lock = threading.RLock()
        self.version = 0
        self.collections: dict[str, Collection] = {}
        self.variables: dict[str, str] = {}
        self.before_commit: list[Callable[[str, DataFrame], None]] = []
        self.after_commit: list[Callable[[str, DataFrame], bool | None]] = []
        self.on_close: list[Callable[[], None]] = []
        self.indexes: dict[str, tuple[str, ix.IndexFunction, str]] = {}
        self.aggregates: dict[str, tuple[str, list[str], list[Spec]]] = {}
        self._failure: Exception | None = None
        self.load(version)

    # --- catalog

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json"))

    def load(self, version: int | None = None) -> None:
        """Reads the catalog of a version (default: the last)."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if version and version not in found:
            raise DatabaseError(f"no version {version}")
        self.version, self.collections, self.variables = version, {}, {}
        if version:
            state = json.loads(self.files.read(f"manifest-{version}.json"))
            self.collections = {c["name"]: Collection(**c) for c in state["collections"]}
            self.variables = state["variables"]

    def snapshot(self, version: int | None = None) -> Engine:
        """The engine as of a version (default: now); later commits do not show."""
        return Engine(self.spark, self.files.root, version=self.version if version is None else version)

    def _writable(self) -> None:
        if self._failure is not None:
            failure, self._failure = self._failure, None
            raise failure
        if self.read_only:
            raise DatabaseError("opened for reading only")

    def _commit(self, collections: dict[str, Collection], variables: dict[str, str]) -> None:
        state = {"collections": [asdict(c) for c in collections.values()], "variables": variables}
        if self.overlay is None and not self.files.write_once(f"manifest-{self.version + 1}.json", json.dumps(state)):
            raise CommitConflict(f"version {self.version + 1} was committed by another writer")
        self.version, self.collections, self.variables = self.version + 1, collections, variables

    def _copy(self) -> dict[str, Collection]:
        return {n: Collection(**asdict(c)) for n, c in self.collections.items()}

    def open_table(self, name: str, purpose: str = UNDEFINED) -> Collection:
        """The collection of this name, made if there is none; freed numbers are used again."""
        if name in self.collections:
            c = self.collections[name]
            if purpose not in (UNDEFINED, c.purpose):
                raise DatabaseError(f"{name} is a collection of purpose {c.purpose}")
            return c
        self._writable()
        used = {c.kid for c in self.collections.values()}
        kid = next((k for k in range(MAX_COLLECTIONS) if k not in used), None)
        if kid is None:
            raise DatabaseError("too many collections")
        made = self._copy()
        made[name] = Collection(kid, name, purpose)
        self._commit(made, dict(self.variables))
        return self.collections[name]

    def find_table(self, name: str) -> Collection | None:
        return self.collections.get(name)

    def name_from_id(self, kid: int) -> str | None:
        return next((c.name for c in self.collections.values() if c.kid == kid), None)

    def list(self) -> DataFrame:
        rows = [(c.kid, c.name, c.purpose) for c in sorted(self.collections.values(), key=lambda c: c.kid)]
        return self.spark.createDataFrame(rows, "kid int, name string, purpose string")

    def delete_table(self, name: str) -> None:
        self._writable()
        left = self._copy()
        left.pop(name, None)
        self._commit(left, dict(self.variables))

    def clear_table(self, name: str, *, private: bool = False) -> None:
        """Drops the rows, or with `private` the collection's own notes."""
        self._writable()
        made = self._copy()
        if private:
            made[name].private, made[name].revision, made[name].last_seen = {}, "", 0
        else:
            made[name].layers = []
        self._commit(made, dict(self.variables))

    def set_variable(self, name: str, value: str) -> None:
        """An empty value unsets the variable."""
        self._writable()
        v = dict(self.variables)
        v.pop(name, None)
        if value:
            v[name] = value
        self._commit(self._copy(), v)

    def get_variable(self, name: str) -> str:
        return self.variables.get(name, "")

    # --- reading

    def read(self, name: str) -> DataFrame:
        c = self.collections[name]
        return self._merged(c, c.layers)

    def _merged(self, c: Collection, layers: list[Layer]) -> DataFrame:
        """Rows of `layers` that none of the later ones hides."""
        schema = c.schema or (st.SCHEMA if c.purpose == STORAGE else "doc_id long")
        folder = lambda f: self.spark.read.schema(schema).parquet(self.folder(f))
        data = [(i, x.data) for i, x in enumerate(layers) if x.data]
        gone = [(i, x.gone) for i, x in enumerate(layers) if x.gone and any(j < i for j, _ in data)]
        if not data:
            return self.spark.createDataFrame([], schema)
        if not gone:
            return self.spark.read.schema(schema).parquet(*[self.folder(f) for _, f in data])
        types = dict(self.spark.createDataFrame([], schema).dtypes)
        keys = ", ".join(f"`{k}` {types[k]}" for k in c.keyed)
        hidden = reduce(DataFrame.unionByName, [self.spark.read.schema(keys).parquet(self.folder(f)).withColumn("_until", F.lit(i)) for i, f in gone])
        hidden = hidden.groupBy(*c.keyed).agg(F.max("_until").alias("_until"))
        # what came after the last keys that went needs no look
        last = gone[-1][0]
        old = reduce(DataFrame.unionByName, [folder(f).withColumn("_layer", F.lit(i)) for i, f in data if i < last])
        seen = old.alias("a").join(hidden.alias("b"), _same(c.keyed, "a", "b") & (F.col("a._layer") < F.col("b._until")), "left_anti").drop("_layer")
        return reduce(DataFrame.unionByName, [seen, *[folder(f) for i, f in data if i >= last]])

    def records(self, name: str, low: int | None, high: int | None) -> DataFrame:
        """Records of a storage with ids from `low` to `high`, out of the layers that can have any; None: no record."""
        c = self.collections[name]
        layers = [x for x in c.layers if low is not None and (x.low is None or (x.low <= high and x.high >= low))]
        rows = self._merged(c, layers)
        return rows.where(F.col("id").between(low, high)) if layers else rows

    def folder(self, name: str) -> str:
        return name if "/" in name else f"{self.files.root}/{name}"

    def view(self, name: str) -> View:
        """The view of an index, map, aggregate or storage."""
        c = self.collections[name]
        if name in self.indexes:
            source, fn, kind = self.indexes[name]
            return ix.view(self.read(name), fn, kind, self.read(source))
        if c.purpose == STORAGE:
            return View(self.read(name), ["id"], None)
        return View(self.read(name), json.loads(c.private.get("keys", "[]")), None)

    def approx_rows(self, name: str) -> int:
        """From the footers of the files: no column is read."""
        return self.read(name).count()

    def stats(self) -> DataFrame:
        """Files and bytes of every collection."""
        rows = []
        for c in self.collections.values():
            sizes = [self.files.size(self.folder(f)) for f in c.folders()]
            rows.append((c.name, len(c.folders()), sum(a for a, _ in sizes), sum(b for _, b in sizes)))
        return self.spark.createDataFrame(rows, "name string, folders int, files int, bytes long")

    def file_changes(self, old: int, new: int) -> DataFrame:
        """(`folder`, `change`): folders that version `new` has and `old` lacks (added), or the other way (removed)."""
        a, b = (({f for c in self.snapshot(v).collections.values() for f in c.folders()} if v else set()) for v in (old, new))
        rows = [(f, "added") for f in sorted(b - a)] + [(f, "removed") for f in sorted(a - b)]
        return self.spark.createDataFrame(rows, "folder string, change string")

    def find_everywhere(self, doc_id: int) -> DataFrame | None:
        """The record of this id in every storage, with the collection's name."""
        out = None
        for c in self.collections.values():
            if c.purpose == STORAGE:
                part = st.find(self.read(c.name), doc_id).withColumn("collection", F.lit(c.name))
                out = part if out is None else out.unionByName(part)
        return out

    # --- writing

    @contextmanager
    def batch(self) -> Iterator[Batch]:
        """Changes of any number of collections, committed at once on leaving; an exception leaves nothing."""
        self._writable()
        with self._lock:
            b = Batch(self)
        try:
            yield b
        except BaseException:
            b.rollback()
            raise
        b.commit()

    def put(self, name: str, documents: DataFrame) -> DataFrame:
        with self.batch() as b:
            return b.put(name, documents)

    def erase(self, name: str, ids: DataFrame) -> DataFrame:
        with self.batch() as b:
            return b.erase(name, ids)

    def purge(self, name: str, ids: DataFrame) -> None:
        """Removes records (`id`) for good; indexes, aggregates and observers see each as a change of the record by itself."""
        with self.batch() as b:
            b.purge(name, ids)

    def compact(self, name: str, n: int = 0, *, deleted: bool = False) -> None:
        with self.batch() as b:
            b.replace(name, st.compact(b.read(name), n, deleted=deleted))

    def compact_files(self, name: str, *, target_bytes: int = 128 << 20) -> None:
        """Rewrites a collection as few files, sorted by its first column for row-group skipping."""
        c = self.collections[name]
        size = sum(self.files.size(self.folder(f))[1] for f in c.folders())
        with self.batch() as b:
            rows = b.read(name)
            b.replace(name, rows.repartitionByRange(max(1, -(-size // target_bytes)), rows.columns[0]).sortWithinPartitions(rows.columns[0]))

    def import_documents(self, name: str, backup: DataFrame) -> None:
        """Records with their ids; predecessors must be known, and the next id rises above all."""
        with self.batch() as b:
            b.append_revisions(name, backup)

    def restore_backup(self, name: str, backup: DataFrame) -> None:
        """The records of the backup that are not in the storage."""
        with self.batch() as b:
            b.append_revisions(name, st.restore(b.read(name), backup), check=False)

    def export(self, name: str, path: str) -> str:
        return st.export(self.read(name), path, self.collections[name].next_id)

    def put_map(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Upserts rows under `keys`; of equal keys in one call the last in the order of the frame stays."""
        with self.batch() as b:
            b.put_map(name, rows, keys)

    def erase_map(self, name: str, keys: DataFrame) -> None:
        with self.batch() as b:
            b.erase_map(name, keys)

    def create_index(self, name: str, storage: str, fn: ix.IndexFunction, kind: str = ix.MULTI) -> None:
        """Opens an index and brings it up to date: built anew if the function's revision changed, else from the last id it has
        seen on."""
        self.open_table(name, UNIQUE_INDEX if kind in (ix.UNIQUE, ix.UNIQUE_NO_CHECK) else INDEX)
        self.indexes[name] = (storage, fn, kind)
        c, s = self.collections[name], self.collections[storage]
        mark = str(fn.revision)
        if c.revision != mark:
            with self.batch() as b:
                b.collections[name].keyed = list(fn.keys) if kind == ix.UNIQUE_NO_CHECK else ["doc_id"]
                b.replace(name, ix.build(st.current(b.read(storage)), fn, kind))
                b.collections[name].revision, b.collections[name].last_seen = mark, s.next_id - 1
        elif c.last_seen < s.next_id - 1:
            with self.batch() as b:
                rows = b.read(storage)
                b.feed_index(name, st.change_feed(rows, rows.where(F.col("id") > c.last_seen)))
                b.collections[name].last_seen = s.next_id - 1

    def create_aggregate(self, name: str, index: str, group: list[str], specs: list[Spec], *, auto_update: bool = False, background: bool = False) -> None:
        """Opens a materialized aggregate over an index; another definition than last time builds it anew. Commits note the groups
        they touch; `update` computes those again, with `auto_update` after every commit, with `background` on another thread
        while the writer goes on (`wait` waits for it)."""
        self.open_table(name, AGGREGATE)
        self.aggregates[name] = (index, group, specs)
        if auto_update:
            self.auto_update[name] = background
        mark = revision(specs, group)
        if self.collections[name].revision != mark:
            with self.batch() as b:
                b.collections[name].keyed = list(group)
                b.replace(name, aggregate_by(b.read(index), group, specs))
                c = b.collections[name]
                c.revision, c.private = mark, {"keys": json.dumps(group), "version": str(self.version + 1)}

    def refresh(self, name: str, dirty: DataFrame) -> None:
        """Computes the groups `dirty` of a materialized aggregate again."""
        with self.batch() as b:
            b.refresh(name, dirty)

    def dirty(self, name: str) -> DataFrame | None:
        """Groups of a materialized aggregate that changes touched since its last update; None if there are none."""
        return self._dirty(self.collections[name])

    def _dirty(self, c: Collection) -> DataFrame | None:
        folders = json.loads(c.private.get("dirty", "[]"))
        if not folders:
            return None
        index, group, _ = self.aggregates[c.name]
        types = dict(self.read(index).dtypes)
        schema = ", ".join(f"`{g}` {types[g]}" for g in group) or "_all int"
        return self.spark.read.schema(schema).parquet(*[self.folder(f) for f in folders]).distinct()

    def update(self, name: str) -> bool:
        """Brings a materialized aggregate up to date; False if nothing was to do."""
        with self.batch() as b:
            groups = self._dirty(b.collections[name])
            if groups is None:
                return False
            b.refresh(name, groups)
            b.collections[name].private.pop("dirty", None)
        return True

    def try_update(self, name: str) -> bool:
        """As `update`, but gives way to another writer: False then, and the groups stay noted."""
        try:
            return self.update(name)
        except CommitConflict:
            self.load()
            return False

    def _in_background(self, name: str) -> None:
        """Refresh on the worker's thread; what fails shows up at the next write."""

        def work() -> None:
            for _ in range(ATTEMPTS):
                try:
                    self.update(name)
                    return
                except CommitConflict:
                    self.load()
                except Exception as e:  # noqa: BLE001
                    self._failure = e
                    return

        if self._worker is None:
            self._worker = ThreadPoolExecutor(1)
        self._jobs = [j for j in self._jobs if not j.done()] + [self._worker.submit(work)]

    def wait(self) -> None:
        """Until all background work is done."""
        for job in self._jobs:
            job.result()
        self._jobs = []

    def observe_keys(self, name: str, observer: Callable[[DataFrame], None]) -> None:
        """The observer gets the rows (keys, `op`: put or delete) that a change writes to an index, map or aggregate, before the
        commit."""
        self.key_observers.setdefault(name, []).append(observer)

    def check_storage(self, name: str) -> DataFrame:
        """Records that break the log's rules: repeated or non-positive ids, later predecessors, values of tombstones."""
        rows = self.read(name)
        twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
        bad = rows.select("id", F.when(F.col("id") <= 0, "id not positive").when(F.col("previous_id") >= F.col("id"), "predecessor is later").when(F.col("has_value") & F.col("document").isNull(), "value is missing").alias("problem"))
        return twice.unionByName(bad.where("problem is not null"))

    def check_references(self, index: str, *, repair: bool = False) -> DataFrame:
        """Index rows whose document is not stored; with `repair` they are removed."""
        source = self.indexes[index][0]
        found = st.dangling(self.read(index), self.read(source))
        if repair:
            found = cut(found)
            with self.batch() as b:
                gone = found.select(F.col("doc_id").alias("old_doc_id")).distinct()
                none = F.lit(None).cast("string")
                b.feed_index(index, gone.select(F.col("old_doc_id").alias("new_doc_id"), "old_doc_id", F.lit(0).cast("long").alias("old_old_doc_id"), F.lit(True).alias("deleted"), none.alias("new_doc"), none.alias("old_doc")))
        return found

    def replay(self, name: str, observer: Callable[[DataFrame], None], start: int = 1) -> None:
        """Gives the observer all changes from an id on."""
        rows = self.read(name)
        observer(st.change_feed(rows, rows.where(F.col("id") >= start)))

    def close(self) -> None:
        self.wait()
        if self._worker is not None:
            self._worker.shutdown()
        for f in self.on_close:
            f()
        if self.overlay is not None:
            self.overlay.delete("")

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def vacuum(self) -> int:
        """Deletes folders that no manifest names, and returns their number. Not while another writer is at work."""
        named = set()
        for v in self.versions():
            for c in json.loads(self.files.read(f"manifest-{v}.json"))["collections"]:
                named.update([*Collection(**c).folders(), *json.loads(c["private"].get("dirty", "[]"))])
        left = [n for n in self.files.names() if n.startswith("data-") and n not in named]
        for n in left:
            self.files.delete(n)
        return len(left)


class Batch:
    """Staged changes; readers of the batch see them, others do not until it commits.

    Other writers may commit meanwhile: the batch fails with CommitConflict only if one of them changed a collection that
    the batch changed as well, or a variable."""

    def __init__(self, engine: Engine):
        self.engine, self.collections, self.variables = engine, engine._copy(), dict(engine.variables)
        self.base, self.base_collections = engine.version, engine._copy()
        self.base_variables = dict(engine.variables)
        self._written: list[str] = []
        self.feeds: list[tuple[str, DataFrame]] = []
        self.revision = engine.version + 1

    def read(self, name: str) -> DataFrame:
        c = self.collections[name]
        return self.engine._merged(c, c.layers)

    def lock(self, name: str, key: object) -> None:
        """Holds a key until the batch ends; DeadlockError if the batch that holds it waits for this one."""
        self.engine.locks.lock(self, (name, key))

    def _schema(self, name: str, rows: DataFrame) -> None:
        self.collections[name].schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def _write_folder(self, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        if self.engine.overlay is not None:
            folder = f"{self.engine.overlay.root}/{folder}"
        rows.write.parquet(self.engine.folder(folder))
        self._written.append(folder)
        return folder

    def replace(self, name: str, rows: DataFrame) -> None:
        """All rows of the collection."""
        self._schema(name, rows)
        layer = Layer(self._write_folder(rows))
        c = self.collections[name]
        if c.purpose == STORAGE:
            layer.low, layer.high = self.engine._merged(c, [layer]).agg(F.min("id"), F.max("id")).first()
        c.layers = [layer]

    def append(self, name: str, rows: DataFrame) -> None:
        self.change(name, rows, None)

    def change(self, name: str, come: DataFrame | None, gone: DataFrame | None) -> None:
        """A layer of rows that come and keys that go (of the collection's `keyed` columns)."""
        c = self.collections[name]
        if come is not None:
            self._schema(name, come)
        c.layers.append(Layer(None if come is None else self._write_folder(come), None if gone is None else self._write_folder(gone.select(*c.keyed).distinct())))
        self._together(name)

    def _together(self, name: str) -> None:
        """Writes layers together when there are many: the newest ones, or all when these are no longer small."""
        c = self.collections[name]
        if len(c.layers) <= LAYERS:
            return
        size = lambda x: sum(self.engine.files.size(self.engine.folder(f))[1] for f in x.folders())
        first, rest = size(c.layers[0]), sum(map(size, c.layers[1:]))
        start = 0 if 2 * rest >= first or not c.layers[0].data else 1
        part = c.layers[start:]
        data = self._write_folder(self.engine._merged(c, part))
        gone = None
        if start and (folders := [x.gone for x in part if x.gone]):
            types = dict(self.read(name).dtypes)
            keys = self.engine.spark.read.schema(", ".join(f"`{k}` {types[k]}" for k in c.keyed)).parquet(*[self.engine.folder(f) for f in folders])
            gone = self._write_folder(keys.distinct())
        known = [x for x in part if x.low is not None]
        whole = bool(known) and len(known) == len(part)
        c.layers[start:] = [Layer(data, gone, min(x.low for x in known) if whole else None, max(x.high for x in known) if whole else None)]

    def append_revisions(self, name: str, new: DataFrame, *, check: bool = True) -> DataFrame:
        """Appends revisions, and brings the indexes of the storage up to date. Predecessors are looked up in the layers whose
        ids reach so far."""
        folder = self._write_folder(new.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in st.SCHEMA.split(", ")]))
        new = self.engine.spark.read.schema(st.SCHEMA).parquet(self.engine.folder(folder))
        bottom, top, low, high = new.agg(F.min("id"), F.max("id"), F.min(F.when(F.col("previous_id") != 0, F.col("previous_id"))), F.max(F.when(F.col("previous_id") != 0, F.col("previous_id")))).first()
        if top is None:
            return new
        now, self.engine.collections = self.engine.collections, self.collections
        try:
            before = self.engine.records(name, low, high)
        finally:
            self.engine.collections = now
        if check and low is not None:
            st.check_known(before, new)
        feed = st.change_feed(before.unionByName(new.where(F.col("id").between(low, high)) if low is not None else new.limit(0)), new)
        for observer in self.engine.before_commit:
            observer(name, feed)
        c = self.collections[name]
        c.schema = st.SCHEMA
        c.layers.append(Layer(folder, None, bottom, top))
        self._together(name)
        c.next_id = max(c.next_id, top + 1)
        self._feed_indexes(name, feed)
        self.feeds.append((name, feed))
        return new

    def _feed_indexes(self, name: str, feed: DataFrame) -> None:
        for index, (source, _, _) in self.engine.indexes.items():
            if source == name:
                self.feed_index(index, feed)
                self.collections[index].last_seen = self.collections[name].next_id - 1

    def feed_index(self, index: str, feed: DataFrame) -> None:
        """The changes that a feed makes to an index, as a layer; tells observers the keys that come and go, and notes the groups
        of the aggregates over the index."""
        _, fn, kind = self.engine.indexes[index]
        come, gone, dead = ix.delta(self.read(index), feed, fn, kind)
        come = cut(come)
        over = [(n, group) for n, (source, group, _) in self.engine.aggregates.items() if source == index]
        observers = self.engine.key_observers.get(index, [])
        if over or observers:
            keys = cut(dead.select(*fn.keys, F.lit("delete").alias("op")).unionByName(come.select(*fn.keys, F.lit("put").alias("op"))))
            for observer in observers:
                observer(keys)
            for n, group in over:
                folder = self._write_folder(keys.select(*group).distinct() if group else keys.select(F.lit(1).alias("_all")).limit(1))
                c = self.collections[n]
                c.private["dirty"] = json.dumps([*json.loads(c.private.get("dirty", "[]")), folder])
        gone = cut(gone)
        self.collections[index].keyed = gone.columns
        self.change(index, come, gone)

    def refresh(self, name: str, dirty: DataFrame) -> None:
        """The groups `dirty` of a materialized aggregate, computed again, as a layer."""
        index, group, specs = self.engine.aggregates[name]
        rows = self.read(index)
        if not group:
            self.replace(name, aggregate_by(rows, group, specs))
            return
        dirty = cut(dirty.select(*group).distinct())
        hit = rows.alias("r").join(dirty.alias("d"), _same(group, "r", "d"), "left_semi")
        new = cut(aggregate_by(hit, group, specs))
        self._tell(name, new, dirty, group)
        self.change(name, new, dirty)

    def _tell(self, name: str, come: DataFrame | None, gone: DataFrame, keys: list[str]) -> None:
        observers = self.engine.key_observers.get(name, [])
        if observers:
            went = gone if come is None else gone.select(*keys).alias("g").join(come.alias("c"), _same(keys, "g", "c"), "left_anti")
            rows = went.select(*keys, F.lit("delete").alias("op"))
            if come is not None:
                rows = rows.unionByName(come.select(*keys, F.lit("put").alias("op")))
            rows = cut(rows)
            for observer in observers:
                observer(rows)

    def put(self, name: str, documents: DataFrame) -> DataFrame:
        """Stores `documents` (document, optionally previous_id); returns the new revisions."""
        if "previous_id" not in documents.columns:
            documents = documents.withColumn("previous_id", F.lit(0).cast("long"))
        return self.append_revisions(name, st.new_revisions(documents, self.collections[name].next_id))

    def erase(self, name: str, ids: DataFrame) -> DataFrame:
        return self.append_revisions(name, st.new_tombstones(ids, self.collections[name].next_id))

    def purge(self, name: str, ids: DataFrame) -> None:
        """Removes records; only the layers that have one of them are written again."""
        c = self.collections[name]
        ids = cut(ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct())
        low, high = ids.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return
        gone = cut(self.read(name).where(F.col("id").between(low, high)).join(ids, "id", "left_semi"))
        feed = gone.select(F.col("id").alias("new_doc_id"), F.col("id").alias("old_doc_id"), F.col("previous_id").alias("old_old_doc_id"), F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("new_doc"), F.col("document").alias("old_doc"))
        for observer in self.engine.before_commit:
            observer(name, feed)
        layers = []
        for x in c.layers:
            if x.low is None or (x.low <= high and x.high >= low):
                rows = self.engine._merged(c, [x])
                hit = gone if x.low is None else gone.where(F.col("id").between(x.low, x.high))
                if not hit.isEmpty():
                    x = Layer(self._write_folder(st.purge(rows, hit.select("id"))), None, x.low, x.high)
            layers.append(x)
        c.layers = layers
        self._feed_indexes(name, feed)
        self.feeds.append((name, feed))

    def put_map(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        c = self.collections[name]
        rest = [x for x in rows.columns if x not in keys]
        at = F.monotonically_increasing_id()
        # an aggregate keeps one row per key where the rows are read
        last = rows.withColumn("_at", at).groupBy(*keys).agg(F.max_by(F.struct("_at", *rest), "_at").alias("_r"))
        one = cut(last.select(*[F.col(x) if x in keys else F.col(f"_r.{x}").alias(x) for x in rows.columns]))
        c.keyed, c.private["keys"] = list(keys), json.dumps(keys)
        self._tell(name, one, one.select(*keys), keys)
        self.change(name, one, one.select(*keys))
        self.feeds.append((name, one.select(*keys, F.lit("put").alias("op"))))

    def erase_map(self, name: str, keys: DataFrame) -> None:
        c = self.collections[name]
        if not c.keyed:
            return
        gone = cut(keys.select(*c.keyed).distinct())
        self._tell(name, None, gone, c.keyed)
        self.change(name, None, gone)
        self.feeds.append((name, gone.select("*", F.lit("delete").alias("op"))))

    def is_big(self) -> bool:
        return sum(self.engine.files.size(self.engine.folder(f))[1] for f in self._written) > BIG_BATCH

    def _rebase(self) -> None:
        """The batch on top of what others committed since it began."""
        engine = self.engine
        newest = engine.version if engine.overlay is not None else max([engine.version, *engine.versions()])
        if newest > engine.version:
            engine.load(newest)
        if engine.version == self.base:
            return
        changed = self._changed()
        others = {n for n in {*engine.collections, *self.base_collections} if engine.collections.get(n) != self.base_collections.get(n)}
        made = engine._copy()
        for n in sorted(changed):
            mine = self.collections.get(n)
            if n in others:
                mine = self._reconciled(self.base_collections.get(n), mine, engine.collections.get(n))
                if mine is None:
                    raise CommitConflict(f"{n} was changed by another writer")
            if mine is None:
                made.pop(n, None)
            else:
                made[n] = mine
        if self.variables == self.base_variables:
            self.variables = dict(engine.variables)
        elif engine.variables != self.base_variables:
            raise CommitConflict("variables were changed by another writer")
        self.collections = made

    def _changed(self) -> set[str]:
        return {n for n in {*self.collections, *self.base_collections} if self.collections.get(n) != self.base_collections.get(n)}

    @staticmethod
    def _reconciled(base: Collection | None, mine: Collection | None, theirs: Collection | None) -> Collection | None:
        """An aggregate that one writer refreshed while another noted groups for it: refreshed, with the new notes. None: conflict."""
        if base is None or mine is None or theirs is None or base.purpose != AGGREGATE:
            return None
        notes = lambda c: json.loads(c.private.get("dirty", "[]"))
        whole = lambda c: {**asdict(c), "private": {k: v for k, v in c.private.items() if k != "dirty"}}
        if whole(mine) == whole(base):
            out, late = theirs, [f for f in notes(mine) if f not in notes(base)]
        elif whole(theirs) == whole(base):
            out, late = mine, [f for f in notes(theirs) if f not in notes(base)]
        else:
            return None
        out = Collection(**asdict(out))
        if late:
            out.private["dirty"] = json.dumps([*notes(out), *[f for f in late if f not in notes(out)]])
        return out

    def commit(self) -> None:
        engine = self.engine
        try:
            for listener in engine.batch_listeners:
                listener.before_commit(self)
            with engine._lock:
                self._rebase()
                if self.collections != engine.collections or self.variables != engine.variables:
                    engine._commit(self.collections, self.variables)
        except BaseException:
            self.rollback()
            raise
        engine.locks.release(self)
        for listener in engine.batch_listeners:
            listener.after_commit(engine.version)
        for name, feed in self.feeds:
            for observer in list(engine.after_commit):
                try:
                    if observer(name, feed) is False:
                        engine.after_commit.remove(observer)
                except Exception as e:  # noqa: BLE001 - shows up at the next write
                    engine._failure = e
        self._written = []
        if self.feeds:
            for name in sorted(engine.auto_update):
                if engine.auto_update[name]:
                    engine._in_background(name)
                else:
                    engine.update(name)

    def rollback(self) -> None:
        for folder in self._written:
            self.engine.files.fs.delete(self.engine.files.path(self.engine.folder(folder)), True)
        self._written = []
        self.engine.locks.release(self)
        for listener in self.engine.batch_listeners:
            listener.on_rollback(self)
