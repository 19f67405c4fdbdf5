"""Overlays kept as Parquet: batches of deltas, and a log whose newest row tells which of them count."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factloom.operators import overlay

_LOG = "seq long, overlay_id string, overlay_type string, repository string, base_commit string, base_generation long, status string, epoch long, batch long"
_DELTAS = "entity_type string, entity_id string, operation string, base_version string, new_value string, generation long"
TYPES = ("BRANCH", "SESSION")
OPERATIONS = ("ADD", "UPDATE", "DELETE")
#: What a delta may be of; fixed values.
ENTITIES = ("Node", "Edge", "RawReference", "RawEvidenceLink", "Shard", "BoundaryEdge")


class OverlayStore:
    """A folder with one overlay over a base.

    A batch counts once its number is in the log, and a batch that is written again under the same number replaces what
    a lost job left, so readers never see half of one. Discarding starts a new epoch; nothing is rewritten. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, overlay_type: str, repository: str, base_commit: str, base_generation: int, overlay_id: str | None = None) -> OverlayStore:
        if overlay_type.upper() not in TYPES:
            raise ValueError(f"an overlay is one of {TYPES}, not {overlay_type}")
        if not base_commit:
            raise ValueError("an overlay needs the commit of its base")
        made = cls(spark, root)
        made._log(Row(seq=0, overlay_id=overlay_id or f"overlay:{uuid.uuid4().hex}", overlay_type=overlay_type.upper(), repository=repository, base_commit=base_commit, base_generation=base_generation, status="ACTIVE", epoch=0, batch=0))
        return made

    def _log(self, row: Row) -> None:
        self.spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _change(self, **values: object) -> None:
        now = self.metadata().asDict()
        self._log(Row(**{**now, **values, "seq": now["seq"] + 1}))

    def metadata(self) -> Row:
        """The newest row of the log."""
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/log").orderBy(F.desc("seq")).limit(1).collect()[0]

    def put(self, deltas: DataFrame) -> None:
        """Add ``deltas(entity_type, entity_id, operation, base_version, new_value, generation)``, which replace earlier
        ones of their entities. The job fails on an unknown operation or entity type, a null key or a tombstone with a value, and then
        nothing counts."""
        now = self.metadata()
        within = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
        wrong = ~within("operation", OPERATIONS) | ~within("entity_type", ENTITIES) | F.col("entity_id").isNull()
        wrong = wrong | ((F.col("operation") == "DELETE") & F.col("new_value").isNotNull())
        sound = F.when(wrong, F.raise_error(F.lit("not a sound delta")).cast("boolean")).otherwise(F.lit(True))
        columns = [c.split()[0] for c in _DELTAS.split(", ")]
        deltas.where(sound).select(*columns).write.mode("overwrite").parquet(self._place(now.epoch, now.batch + 1))
        self._change(batch=now.batch + 1, status="ACTIVE")

    def _place(self, epoch: int, batch: int) -> str:
        return f"{self.root}/deltas/epoch={epoch}/batch={batch}"

    def deltas(self, entity_type: str | None = None) -> DataFrame:
        """The delta that counts for each entity: of the last batch that holds it; of equal ones, one of the greatest
        generation and then value."""
        now = self.metadata()
        if now.batch == 0:
            return self.spark.createDataFrame([], _DELTAS)
        places = [self._place(now.epoch, k + 1) for k in range(now.batch)]
        rows = self.spark.read.schema(_DELTAS + ", batch long").option("basePath", f"{self.root}/deltas/epoch={now.epoch}").parquet(*places)
        if entity_type is not None:
            rows = rows.where(F.col("entity_type") == entity_type)
        # a greatest value combines before the shuffle, so an entity that changes often is no large group
        last = F.max_by(F.struct("operation", "base_version", "new_value", "generation"), F.struct("batch", "generation", "operation", "new_value"))
        return rows.groupBy("entity_type", "entity_id").agg(last.alias("d")).select("entity_type", "entity_id", "d.*")

    def discard(self) -> None:
        """Drop all deltas and close the overlay."""
        self._change(status="DISCARDED", epoch=self.metadata().epoch + 1, batch=0)

    def clear(self) -> None:
        """Drop all deltas; the overlay stays in use."""
        self._change(status="ACTIVE", epoch=self.metadata().epoch + 1, batch=0)

    def mark_base(self, commit: str, generation: int) -> str:
        """ACTIVE if the base is still the one that the overlay was made over, else REBASE_REQUIRED."""
        now = self.metadata()
        status = "ACTIVE" if (now.base_commit, now.base_generation) == (commit, generation) else "REBASE_REQUIRED"
        self._change(status=status)
        return status

    def set_status(self, status: str) -> None:
        self._change(status=status)

    def counts(self, types: list[str]) -> DataFrame:
        return overlay.counts(self.deltas(), types)

    def touched_shards(self) -> DataFrame:
        """shard, each once: of the new values, of the ends of boundary edges, and the shards that are entities."""
        value = lambda k: F.get_json_object("new_value", f"$.{k}")
        ends = F.when(F.col("entity_type") == "BoundaryEdge", F.array(value("src_shard_id"), value("dst_shard_id"))).otherwise(F.array())
        own = F.array(value("shard_id"), F.when(F.col("entity_type") == "Shard", F.col("entity_id")))
        return self.deltas().select(F.explode(F.concat(own, ends)).alias("shard")).where("shard <> ''").distinct()


def commit_to_branch(session: OverlayStore, branch: OverlayStore) -> int:
    """Put the deltas of a session into a branch, discard the session, and give back how many there were. A session
    that is lost before it is discarded may be committed again with the same result."""
    if (session.metadata().overlay_type, branch.metadata().overlay_type) != ("SESSION", "BRANCH"):
        raise ValueError("a session is committed to a branch")
    rows = session.deltas()
    n = rows.count()
    branch.put(rows)
    session.discard()
    return n


def merge_overlays(left: OverlayStore, right: OverlayStore, target: OverlayStore) -> DataFrame:
    """Put the deltas of both into ``target`` and give back their conflicts (entity_type, entity_id, conflict). If there
    are any, nothing is put and the target's status is CONFLICT."""
    keyed = lambda s: s.deltas().withColumn("entity_id", F.struct("entity_type", "entity_id"))
    found = overlay.conflicts(keyed(left), keyed(right), "new_value").select("entity_id.*", "conflict")
    if not found.isEmpty():
        target.set_status("CONFLICT")
        return found
    target.put(left.deltas())
    target.put(right.deltas())
    return found
