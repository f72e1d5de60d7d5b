"""Several writers on one registry: a commit log whose next number only one writer can take, and aliases that can be rolled back.

A commit is a small file named by its sequence number and created only if it isn't there, which file systems with an atomic exclusive
create (HDFS, local disks) do for one writer only. Who comes second reads what is new and decides again. The log is a table
of JSON lines; champions are a fold over it in its order.

``set`` puts a version on top of a name's history and forgets what was rolled back; ``rollback`` goes back to the version before, as often
as there is one; ``restore`` takes the last rollback back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from featureline.operators.registry import CHAMPION

LOG = T.StructType([
    T.StructField("sequence", T.LongType()), T.StructField("action", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("alias", T.StringType()), T.StructField("version", T.LongType()), T.StructField("run_id", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("at", T.StringType())])
_LIST = "array<bigint>"


class Conflict(RuntimeError):
    """Another writer has taken the sequence number."""


def alias_history(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the version that the alias stands for after all events (action set, rollback or restore, and version), the versions below
    it and those that a restore would bring back. Null where nothing was set yet; what can't be undone changes nothing.

    A key's events are one row while they are folded; they are one per promotion.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, "action", F.col("version").cast("bigint").alias("version"))))
    empty = F.array().cast(_LIST)

    def step(state, event):
        stack, undone = state["stack"], state["undone"]
        back = (event["action"] == "rollback") & (F.size(stack) > 1)
        again = (event["action"] == "restore") & (F.size(undone) > 0)
        top = lambda items: F.slice(items, -1, 1)
        rest = lambda items: F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))
        return F.struct(
            F.when(event["action"] == "set", F.concat(stack, F.array(event["version"]))).when(back, rest(stack))
            .when(again, F.concat(stack, top(undone))).otherwise(stack).alias("stack"),
            F.when(event["action"] == "set", empty).when(back, F.concat(undone, top(stack))).when(again, rest(undone))
            .otherwise(undone).alias("undone"))

    folded = events.groupBy(*keys).agg(F.aggregate(ordered, F.struct(empty.alias("stack"), empty.alias("undone")), step).alias("h"))
    return folded.select(*keys, F.try_element_at("h.stack", F.lit(-1)).alias("version"),
                         F.when(F.size("h.stack") > 0, F.slice("h.stack", 1, F.size("h.stack") - 1)).otherwise(empty).alias("below"),
                         F.col("h.undone").alias("undone"))


class CommitLog:
    """The log below one base folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.path = spark, f"{base.rstrip('/')}/log"
        jvm = spark.sparkContext._jvm
        self._target = jvm.org.apache.hadoop.fs.Path
        self._files = self._target(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        if not self._files.exists(self._target(self.path)):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(self.path)

    def last(self) -> int:
        """The highest sequence number taken, 0 without any."""
        if not self._files.exists(self._target(self.path)):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(self._target(self.path))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def append(self, expected: int, **values) -> int:
        """Takes the number after ``expected``, or raises Conflict if somebody has it."""
        sequence = expected + 1
        line = json.dumps({"sequence": sequence, **values}) + "\n"
        try:
            out = self._files.create(self._target(f"{self.path}/{sequence:012d}.json"), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"{sequence} is taken") from None
            raise
        try:
            out.write(bytearray(line.encode()))
        finally:
            out.close()
        return sequence

    def commit(self, decide: Callable[[DataFrame], dict], attempts: int = 20) -> dict:
        """Decides on the log as it is and commits; after a conflict the same once more on the longer log."""
        for _ in range(attempts):
            expected = self.last()
            values = decide(self.read().filter(F.col("sequence") <= expected))
            try:
                return values | {"sequence": self.append(expected, **values)}
            except Conflict:
                continue
        raise Conflict(f"no number was free in {attempts} attempts")

    def register(self, name: str, run_id: str, source: str, now: datetime) -> int:
        """A new version of a model: one above the highest, whoever else registers."""
        def decide(log: DataFrame) -> dict:
            top = log.filter((F.col("action") == "register") & (F.col("name") == name)).agg(F.max("version")).first()[0]
            return {"action": "register", "name": name, "version": (top or 0) + 1, "run_id": run_id, "source": source, "at": now.isoformat()}

        return self.commit(decide)["version"]

    def set_alias(self, name: str, version: int, now: datetime, alias: str = CHAMPION) -> int:
        return self.commit(lambda _: {"action": "set", "name": name, "alias": alias, "version": version, "at": now.isoformat()})["sequence"]

    def _move(self, action: str, kept: str, name: str, now: datetime, alias: str) -> int:
        """Commits a rollback or a restore if there is something to go to; returns the version that the alias stands for then."""
        def decide(log: DataFrame) -> dict:
            row = alias_history(log.filter((F.col("name") == name) & (F.col("alias") == alias)), ["name", "alias"], "sequence").first()
            if row is None or not row[kept]:
                raise ValueError(f"{name}: nothing to {action}")
            return {"action": action, "name": name, "alias": alias, "version": row[kept][-1], "at": now.isoformat()}

        return self.commit(decide)["version"]

    def rollback(self, name: str, now: datetime, alias: str = CHAMPION) -> int:
        return self._move("rollback", "below", name, now, alias)

    def restore(self, name: str, now: datetime, alias: str = CHAMPION) -> int:
        return self._move("restore", "undone", name, now, alias)

    def aliases(self) -> DataFrame:
        """Where each alias of a name points now."""
        moved = self.read().filter(F.col("action").isin("set", "rollback", "restore"))
        return alias_history(moved, ["name", "alias"], "sequence").filter("version IS NOT NULL").select("name", "alias", "version")

    def champions(self, alias: str = CHAMPION) -> DataFrame:
        versions = self.read().filter("action = 'register'").select("name", "version", "run_id", "source")
        return self.aliases().filter(F.col("alias") == alias).join(versions, ["name", "version"])
