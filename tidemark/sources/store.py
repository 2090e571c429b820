"""Engine-owned tables: an append-only log of row versions with system time."""

from __future__ import annotations

import json
import time
import uuid
import weakref
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.types import ColumnSpec, Lineage, SqlType, TableSpec

#: Operations of a row version.
ORIGINAL, CORRECTION, REPLACEMENT, TOMBSTONE = "original", "correction", "replacement", "tombstone"


class StoreError(Exception):
    """code: conflict duplicate invalid not_found null_violation closed."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Commit:
    position: int
    time_ns: int
    path: str
    client: str
    batch: str
    digest: str
    rows: int
    version: int
    corrected: bool = False  # holds versions other than originals


def _spec_json(spec: TableSpec) -> dict:
    return asdict(spec)


def _spec_of(d: dict) -> TableSpec:
    columns = tuple(ColumnSpec(c["name"], SqlType(**c["type"]), c["nullable"]) for c in d["columns"])
    return TableSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()} | {"columns": columns})


class VersionLog:
    """One table's commits.

    A commit writes a Parquet folder, then its entry as a numbered file that must not exist yet: a second writer of the same
    position fails and what no entry names was never committed.  Rows carry _pos (commit position), _ord (ordinal in the
    commit) and _op.  Reads resolve the entries once, so a DataFrame is a stable snapshot.  Files are dealt by event-time
    bucket, sorted by the order key, so time predicates skip folders and row groups.

    Compaction writes one folder for all commits up to a position, and a numbered layout that names it and repeats their entries.  Rows
    keep their _pos, so reads as of any position in it, changes of one commit and retries are answered as before.
    Versions dropped by compact_history() lie at or before `folded`.
    """

    def __init__(self, spark: SparkSession, root: str, spec: TableSpec):
        self.spark, self.root, self.lineage = spark, f"{root}/{spec.name}", Lineage(spec)
        self.commits: list[Commit] = []
        self.through, self.merged, self.generation = 0, "", 0  # the layout: commits up to `through` lie in `merged`
        self.retained, self.folded = 0, 0
        self.retained_ns: int | None = None
        self.failed: str | None = None
        self.readers: weakref.WeakSet = weakref.WeakSet()  # subscriptions: objects with safe_position() and closed
        self.refresh()
        if not self._numbers("schema"):
            self._publish("schema", spec.version, _spec_json(spec))

    @property
    def spec(self) -> TableSpec:
        return self.lineage.versions[-1]

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        fs, at = self._fs(), self._path(kind)
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def _entry(self, kind: str, number: int) -> dict:
        stream = self._fs().open(self._path(f"{kind}/{number:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, kind: str, number: int, entry: dict) -> None:
        """Writes a whole file aside and renames it to its number; fails if the number is taken."""
        fs, tmp, to = self._fs(), self._path(f"{kind}/{uuid.uuid4().hex}.tmp"), self._path(f"{kind}/{number:020d}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(tmp, to, never)  # without OVERWRITE
        except Py4JJavaError as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                self.failed = f"{kind} {number} could not be published"
                raise StoreError("closed", self.failed) from None
            raise StoreError("conflict", f"another writer has published {kind} {number}; refresh and try again") from None

    def refresh(self) -> None:
        """Takes in what is published, and verifies it: positions without gaps, advancing times, known schemas, folders that exist."""
        versions = [_spec_of(self._entry("schema", n)) for n in self._numbers("schema")]
        if versions:
            self.lineage.versions[:] = versions
        layouts = self._numbers("layouts")
        commits: list[Commit] = []
        if layouts:
            state = self._entry("layouts", layouts[-1])
            commits = [Commit(**c) for c in state["commits"]]
            self.generation, self.through, self.merged = layouts[-1], state["through"], state["merged"]
            self.retained, self.retained_ns, self.folded = state["retained"], state["retained_ns"], state["folded"]
        commits += [Commit(**self._entry("commits", n)) for n in self._numbers("commits") if n > len(commits)]
        fs, known = self._fs(), {v.version for v in self.lineage.versions}
        if self.merged and not fs.exists(self._path(self.merged)):
            raise StoreError("invalid", "the merged folder is missing")
        for i, c in enumerate(commits):
            if c.position != i + 1 or i and c.time_ns <= commits[i - 1].time_ns or c.version not in known:
                raise StoreError("invalid", f"commit {c.position} doesn't follow its predecessor")
            if c.position > self.through and c.rows and not fs.exists(self._path(c.path)):
                raise StoreError("invalid", f"the rows of commit {c.position} are missing")
        self.commits = commits

    # reads

    def log(self, commits: list[Commit] | None = None, hidden: bool = False) -> DataFrame:
        """All versions of the commits (one or a run of them), in the current schema; with _bucket if hidden."""
        commits = self.commits if commits is None else commits
        fields = ", ".join(f"`{c.name}` {c.type.spark().simpleString()}" for c in self.spec.columns)
        schema = f"{fields}, _pos bigint, _ord bigint, _op string, _bucket bigint, _commit string"
        read = lambda paths: self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths)
        old, own = [c.position for c in commits if c.position <= self.through], [f"{self.root}/{c.path}" for c in commits if c.position > self.through and c.rows]
        parts = []
        if old and self.merged:
            parts.append(read([f"{self.root}/{self.merged}"]))
            if (old[0], old[-1]) != (1, self.through):
                parts[0] = parts[0].where(F.col("_pos").between(old[0], old[-1]))
        if own:
            parts.append(read(own))
        df = reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], schema)
        return df.drop("_commit") if hidden else df.drop("_bucket", "_commit")

    def boundary(self, as_of: int | None) -> int:
        """The greatest position committed at or before a system time; 0 if none."""
        if as_of is None:
            return self.commits[-1].position if self.commits else 0
        if self.retained_ns is not None and as_of < self.retained_ns:
            raise StoreError("not_found", "the system time was compacted away")
        return max((c.position for c in self.commits if c.time_ns <= as_of), default=0)

    def identity(self) -> list[str]:
        return list(self.spec.dedup_key)

    @staticmethod
    def visible(log: DataFrame, identity: list[str]) -> DataFrame:
        """The last version of each identity, if it isn't a tombstone.  Rows without an identity are all visible."""
        if not identity:
            return log.where(F.col("_op") != TOMBSTONE)
        w = Window.partitionBy(*identity).orderBy(F.col("_pos").desc(), F.col("_ord").desc())
        return log.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col("_op") != TOMBSTONE)).drop("_n")

    def snapshot(self, as_of: int | None = None, position: int | None = None, hidden: bool = False) -> DataFrame:
        """Visible rows now, at a system time, or at a commit position; with the hidden columns."""
        at = self.boundary(as_of) if position is None else position
        if at < self.folded:
            raise StoreError("not_found", "versions at that position were compacted away")
        commits = [c for c in self.commits if c.position <= at]
        log = self.log(commits, hidden)
        return (self.visible(log, self.identity()) if self._corrected(commits) else log).drop("_op")

    def _corrected(self, commits: list[Commit]) -> bool:
        """Append-only histories need no window: every version is visible."""
        return any(c.corrected for c in commits)

    # writes

    def _check(self) -> None:
        if self.failed:
            raise StoreError("closed", self.failed)

    def _time(self, time_ns: int | None) -> int:
        now = time.time_ns() if time_ns is None else time_ns
        last = self.commits[-1].time_ns if self.commits else None
        if last is not None and now <= last:
            if time_ns is not None:
                raise StoreError("invalid", "system time must advance")
            now = last + 1
        return now

    def _inspect(self, df: DataFrame) -> tuple[str, int, dict[str, int], int, int]:
        """In one job: an order-free digest, rows, nulls of NOT NULL columns, most rows of one identity, unknown operations."""
        cols, op = [F.col(f"`{c}`") for c in sorted(df.columns)], F.col("_op") if "_op" in df.columns else F.lit(ORIGINAL)
        need = [c.name for c in self.spec.columns if not c.nullable]
        sums = {"h": F.xxhash64(*cols).cast("decimal(38,0)"), "g": F.hash(*cols).cast("long"), "n": F.lit(1).cast("long")}
        sums["odd"] = (~F.coalesce(op, F.lit("")).isin(ORIGINAL, CORRECTION, REPLACEMENT, TOMBSTONE)).cast("long")
        for i, c in enumerate(need):
            sums[f"null{i}"] = (F.col(f"`{c}`").isNull() & (op != TOMBSTONE)).cast("long")
        each = df.groupBy(*[F.col(f"`{c}`") for c in self.identity()]).agg(*[F.sum(x).alias(f"_{k}") for k, x in sums.items()])
        r = each.agg(F.max("_n").alias("most"), *[F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(k) for k in sums]).first()
        most = (r["most"] or 0) if self.identity() else min(1, r["n"])
        return f"{r['h']}:{r['g']}:{r['n']}", r["n"], {c: r[f"null{i}"] for i, c in enumerate(need)}, most, r["odd"]

    def _shape(self, df: DataFrame) -> DataFrame:
        spec = self.spec
        extra = [c for c in df.columns if c not in [x.name for x in spec.columns] and c != "_op"]
        if extra:
            raise StoreError("invalid", f"no columns {extra}")
        for c in spec.columns:
            if c.name not in df.columns and not c.nullable:
                raise StoreError("null_violation", f"{c.name} is NOT NULL")
        return df.select(*[(F.col(f"`{c.name}`") if c.name in df.columns else F.lit(None)).cast(c.type.spark()).alias(c.name) for c in spec.columns], *["_op"] * ("_op" in df.columns))

    def _dealt(self, df: DataFrame) -> DataFrame:
        """By event-time bucket in as many tasks as the rows need, sorted by the order key."""
        spec = self.spec
        order = list(dict.fromkeys([*spec.order_key, spec.event_time]))
        out = df.withColumn("_bucket", F.floor(F.col(spec.event_time) / F.lit(spec.bucket_ns)).cast("long"))
        return out.hint("rebalance", F.col("_bucket")).sortWithinPartitions("_bucket", *order)

    def _write(self, df: DataFrame, time_ns: int | None, client: str, batch: str, digest: str, rows: int, corrected: bool) -> Commit:
        spec, position = self.spec, (self.commits[-1].position if self.commits else 0) + 1
        path = f"_commit=p{position}-{uuid.uuid4().hex}"
        # ordinals: order of the rows in the table's key order within each file part
        out = self._dealt(df.withColumn("_pos", F.lit(position).cast("long"))).withColumn("_ord", F.monotonically_increasing_id())
        if "_op" not in out.columns:
            out = out.withColumn("_op", F.lit(ORIGINAL))
        if rows:
            out.select(*[c.name for c in spec.columns], "_pos", "_ord", "_op", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{path}")
        c = Commit(position, self._time(time_ns), path, client, batch, digest, rows, spec.version, corrected)
        self._publish("commits", position, asdict(c))
        self.commits = [*self.commits, c]
        return c

    def append(self, df: DataFrame, client: str, batch: str, time_ns: int | None = None) -> Commit:
        """Original rows.  The same client and batch with the same content gives the first commit back; with other content it is an error."""
        self._check()
        if not client or not batch:
            raise StoreError("invalid", "client and batch must be named")
        df = self._shape(df)
        digest, rows, nulls, most, _ = self._inspect(df)
        for c in self.commits:
            if (c.client, c.batch) == (client, batch):
                if c.digest == digest:
                    return c
                raise StoreError("conflict", "the batch was sent before with other content")
        self._admit(nulls, most)
        if self.identity() and self.commits:
            key = [F.col(f"`{c}`") for c in self.identity()]
            if not df.select(*key).join(self.snapshot().select(*key), self.identity(), "left_semi").isEmpty():
                raise StoreError("duplicate", "a key is in the table already")
        return self._write(df, time_ns, client, batch, digest, rows, False)

    def _admit(self, nulls: dict[str, int], most: int) -> None:
        for c, n in nulls.items():
            if n:
                raise StoreError("null_violation", f"{c} is NOT NULL")
        if most > 1:
            raise StoreError("duplicate", "an identity occurs twice in the commit")

    def apply(self, mutations: DataFrame, time_ns: int | None = None) -> Commit:
        """Rows with _op.  Each identity once at most; originals must be new, and the others must exist.  All or nothing."""
        self._check()
        key = self.identity()
        if not key:
            raise StoreError("invalid", "corrections need a DEDUP KEY")
        df = self._shape(mutations)
        digest, rows, nulls, most, odd = self._inspect(df)
        if odd:
            raise StoreError("invalid", "unknown operation")
        self._admit(nulls, most)
        # the log is narrowed to the commit's identities before it is shuffled
        had = self.log().select(*key).join(df.select(*key), key, "left_semi").distinct().withColumn("_had", F.lit(True))
        wrong = df.select(*key, "_op").join(had, key, "left").where((F.col("_op") == ORIGINAL) == F.coalesce("_had", F.lit(False)))
        if not wrong.isEmpty():
            raise StoreError("conflict", "originals must be new and other operations must name an identity of the table")
        return self._write(df, time_ns, "", uuid.uuid4().hex, digest, rows, True)

    def evolve(self, *added: ColumnSpec) -> TableSpec:
        """A new schema version, kept with the table."""
        spec = self.lineage.evolve(*added)
        try:
            self._publish("schema", spec.version, _spec_json(spec))
        except StoreError:
            self.lineage.versions.pop()
            raise
        return spec

    # compaction

    def _layout(self, through: int, merged: str, retained: int, retained_ns: int | None, folded: int) -> None:
        entry = {"through": through, "merged": merged, "retained": retained, "retained_ns": retained_ns, "folded": folded}
        self._publish("layouts", self.generation + 1, entry | {"commits": [asdict(c) for c in self.commits if c.position <= through]})
        self.generation, self.through, self.merged = self.generation + 1, through, merged
        self.retained, self.retained_ns, self.folded = retained, retained_ns, folded

    def _merge(self, rows: DataFrame, edge: int) -> str:
        path = f"_commit=m{edge}-{uuid.uuid4().hex}"
        self._dealt(rows).write.partitionBy("_bucket").parquet(f"{self.root}/{path}")
        return path if rows.columns and self._fs().exists(self._path(path)) else ""

    def compact_history(self, position: int, retained_ns: int) -> int:
        """Versions that no read at or after the boundary needs go; how many.  Boundaries don't go back, and commits
        that a live subscription still has to see stay."""
        self._check()
        if position < self.retained or self.retained_ns is not None and retained_ns < self.retained_ns:
            raise StoreError("invalid", "the retained boundary can't go back")
        if position > self.boundary(None):
            raise StoreError("invalid", "no such position")
        keep_at = max((c.position for c in self.commits if c.time_ns <= retained_ns), default=0)
        needed = min((r.safe_position() for r in self.readers if not r.closed), default=position)
        edge = max(min(position, keep_at, needed), self.folded)
        old = [c for c in self.commits if c.position <= edge]
        if edge <= self.folded or not self._corrected(old):
            # nothing was ever superseded up to here, so nothing is dropped and no change is lost
            self._layout(self.through, self.merged, position, retained_ns, self.folded)
            return 0
        log = self.log(old)
        # the last version of each identity stays even as a tombstone, since a later original of it must be refused
        w = Window.partitionBy(*self.identity()).orderBy(F.col("_pos").desc(), F.col("_ord").desc())
        last = log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        before, through = log.count(), max(edge, self.through)
        rest = self.log([c for c in self.commits if edge < c.position <= through])
        merged = self._merge(last.unionByName(rest), through)
        after = self.spark.read.parquet(f"{self.root}/{merged}").where(F.col("_pos") <= edge).count() if merged else 0
        self._layout(through, merged, position, retained_ns, edge)
        return before - after

    def compact_files(self, check: bool = True) -> None:
        """All commits' files in one folder; equal rows before and after, or nothing changes."""
        self._check()
        if not self.commits:
            return
        through, log = self.commits[-1].position, self.log()
        merged = self._merge(log, through)
        if check and merged:
            cols = [F.col(f"`{c}`") for c in log.columns]
            sums = [F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.sum(F.hash(*cols).cast("long"))]
            new = self.spark.read.schema(log.schema).parquet(f"{self.root}/{merged}")
            if log.agg(*sums).first() != new.select(*cols).agg(*sums).first():
                raise StoreError("invalid", "compaction changed rows")
        self._layout(through, merged, self.retained, self.retained_ns, self.folded)

    def vacuum(self) -> int:
        """Deletes folders that no entry names any more; how many.  DataFrames made before a compaction may read them, so it is never called for you."""
        named = {self.merged} | {c.path for c in self.commits if c.position > self.through}
        fs, gone = self._fs(), 0
        for x in fs.listStatus(self._path("")):
            if x.getPath().getName().startswith("_commit=") and x.getPath().getName() not in named:
                gone += bool(fs.delete(x.getPath(), True))
        return gone

    def changes(self, after: int) -> list[tuple[Commit, DataFrame]]:
        """Commits past a position, each with its rows."""
        if after < self.folded:
            raise StoreError("not_found", "commits past that position were compacted away")
        return [(c, self.log([c])) for c in self.commits if c.position > after]
