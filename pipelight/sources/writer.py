"""Index, update, delete and bulk, as new versions of a Parquet index.

An index is a folder of versions, of which a small file names the current one; a write makes the next
version beside it and switches the name, so readers never see half a write and a failed write leaves
the index as it was.  All paths go through Spark's file systems.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ACTIONS = ("index", "create", "update", "delete")


@dataclass(frozen=True)
class Action:
    action: str
    index: str
    id: str
    source: dict | None = None


def parse_bulk(text: str, index: str | None = None) -> list[Action]:
    """Actions of newline-delimited JSON; anything malformed raises ValueError with its line."""
    lines = [(i, x) for i, x in enumerate(text.splitlines(), 1) if x.strip()]
    out, at = [], 0
    while at < len(lines):
        number, line = lines[at]
        try:
            head = json.loads(line)
            (action, meta), = head.items()
        except (ValueError, AttributeError) as e:
            raise ValueError(f"line {number} is no action") from e
        if action not in ACTIONS:
            raise ValueError(f"line {number}: unknown action {action!r}")
        name = meta.get("_index", index)
        if not name or "_id" not in meta:
            raise ValueError(f"line {number} needs _index and _id")
        source = None
        at += 1
        if action != "delete":
            if at == len(lines):
                raise ValueError(f"line {number} has no document")
            source = json.loads(lines[at][1])
            source = source.get("doc", source) if action == "update" else source
            at += 1
        out.append(Action(action, name, str(meta["_id"]), source))
    return out


class IndexWriter:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- versions -------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        folder, fs = self._fs(self.path)
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done") and n[1:-5].isdigit()), default=0)

    def exists(self) -> bool:
        return self.version() > 0

    def read(self) -> DataFrame:
        if not self.exists():
            raise ValueError(f"no index at {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{self.version()}")

    def _commit(self, df: DataFrame) -> None:
        new = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        marker, fs = self._fs(f"{self.path}/v{new}.done")
        fs.create(marker, True).close()

    def vacuum(self) -> None:
        """Removes all versions but the current one."""
        keep = self.version()
        folder, fs = self._fs(self.path)
        for s in fs.listStatus(folder):
            name = s.getPath().getName()
            digits = name[1:].removesuffix(".done")
            if digits.isdigit() and int(digits) != keep:
                fs.delete(s.getPath(), True)

    def drop(self) -> None:
        folder, fs = self._fs(self.path)
        fs.delete(folder, True)

    # -- writes ---------------------------------------------------------------------------------

    def index(self, docs: DataFrame) -> None:
        """Documents (with _id) are added; those whose id is there already take its place."""
        if not self.exists():
            return self._commit(docs)
        kept = self.read().join(docs.select("_id"), "_id", "left_anti")
        self._commit(kept.unionByName(docs, allowMissingColumns=True))

    def update(self, docs: DataFrame) -> None:
        """Columns of docs that are not null replace those of the documents with their id."""
        old = self.read()
        new = docs.select("_id", *(F.col(c).alias(f"__{c}") for c in docs.columns if c != "_id"))
        joined = old.join(new, "_id", "left")
        names = [c for c in docs.columns if c != "_id"]
        out = joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in old.columns else F.col(f"__{c}") for c in names})
        self._commit(out.drop(*(f"__{c}" for c in names)))

    def delete(self, ids: DataFrame) -> None:
        self._commit(self.read().join(ids.select("_id"), "_id", "left_anti"))

    def bulk(self, actions: list[Action]) -> dict[str, int]:
        """The last index, create or delete of an id holds; updates after it are merged into it first."""
        known: dict[str, Action] = {}
        counts = dict.fromkeys(ACTIONS, 0)
        for a in actions:
            counts[a.action] += 1
            before = known.get(a.id)
            if a.action == "update" and before is not None and before.action != "delete":
                known[a.id] = Action(before.action, a.index, a.id, (before.source or {}) | (a.source or {}))
            else:
                known[a.id] = a
        updates = [a for a in known.values() if a.action == "update"]
        puts = [a for a in known.values() if a.action in ("index", "create")]
        gone = [a for a in known.values() if a.action == "delete"]
        if puts:
            self.index(self._frame(puts))
        if updates:
            self.update(self._frame(updates))
        if gone and self.exists():
            self.delete(self.spark.createDataFrame([(a.id,) for a in gone], "_id string"))
        return counts

    def _frame(self, actions: list[Action]) -> DataFrame:
        """Typed by the index, and by inference over the documents where it has no such field."""
        known = self.read().schema if self.exists() else StructType()
        names = {f.name for f in known}
        docs = [{"_id": a.id} | (a.source or {}) for a in actions]
        new = [{k: v for k, v in d.items() if k not in names} for d in docs]
        inferred = self.spark.range(1).select(F.schema_of_json(F.lit(json.dumps(new))).alias("s")).first()["s"]  # of an array
        for f in self.spark.createDataFrame([], f"d {inferred}").schema["d"].dataType.elementType:
            known = known.add(f)
        lines = self.spark.createDataFrame([(json.dumps(d),) for d in docs], "line string")
        return lines.select(F.from_json("line", known).alias("d")).select(*(F.col("d")[f.name].alias(f.name) for f in known if any(f.name in d for d in docs)))


def latest(docs: DataFrame, id_col: str, order: str) -> DataFrame:
    """The last row of each id."""
    w = Window.partitionBy(id_col).orderBy(F.desc(order))
    return docs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
