"""MERGE: a source's rows update, delete or add to a table's rows in one commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklake.session import discard, materialise
from sparklake.table.pruning import matching_files


class AmbiguousMatchError(ValueError):
    """More than one source row would change the same target row."""


@dataclass(frozen=True)
class Clause:
    action: str  # update, delete or insert
    condition: str | None = None
    values: dict[str, str] | None = None  # column to SQL over t and s; None: all columns from s


class Merge:
    """Built up clause by clause. SQL sees the target as ``t`` and the source as ``s``; of each kind, the first clause that applies wins."""

    def __init__(self, table, source: DataFrame, condition: str, merge_schema: bool = False):
        self.table, self.source, self.condition, self.merge_schema = table, source, condition, merge_schema
        self.matched: list[Clause] = []
        self.unmatched: list[Clause] = []
        self.by_source: list[Clause] = []

    def when_matched_update(self, values: dict[str, str] | None = None, condition: str | None = None) -> Merge:
        self.matched.append(Clause("update", condition, values))
        return self

    def when_matched_delete(self, condition: str | None = None) -> Merge:
        self.matched.append(Clause("delete", condition))
        return self

    def when_not_matched_insert(self, values: dict[str, str] | None = None, condition: str | None = None) -> Merge:
        self.unmatched.append(Clause("insert", condition, values))
        return self

    def when_not_matched_by_source_update(self, values: dict[str, str], condition: str | None = None) -> Merge:
        self.by_source.append(Clause("update", condition, values))
        return self

    def when_not_matched_by_source_delete(self, condition: str | None = None) -> Merge:
        self.by_source.append(Clause("delete", condition))
        return self

    def _pick(self, clauses: list[Clause], first: int) -> Column:
        out = F.lit(None).cast("int")
        for k in reversed(range(len(clauses))):
            test = F.lit(True) if clauses[k].condition is None else F.coalesce(F.expr(clauses[k].condition), F.lit(False))
            out = F.when(test, first + k).otherwise(out)
        return out

    def execute(self) -> int:
        """Commit the merge and return the version. Files without any matched row are left alone, unless unmatched target rows may change;
        files whose minima and maxima rule out the source's keys aren't read."""
        table = self.table
        base = table.snapshot()
        snapshot, meta = table._evolved(base, self.source, self.merge_schema, False)
        held = materialise(self.source, "merge-source")
        source = held.withColumn("_in_s", F.lit(True))
        everything = list(snapshot.files)
        candidates = matching_files(table, snapshot, held, self.condition)
        target = table._load(snapshot, candidates, ("_file", "_row")).withColumn("_in_t", F.lit(True))
        on = F.expr(self.condition)
        pairs = target.alias("t").join(source.alias("s"), on).withColumn("_act", self._pick(self.matched, 0))
        per_row = pairs.groupBy("t._file", "t._row").agg(F.count("_act").alias("n"), F.count("*").alias("m"))
        per_file = per_row.groupBy("_file").agg(F.max("n").alias("n"), F.max("m").alias("m")).collect()  # a row for each file
        if any(r.n > 1 for r in per_file):
            raise AmbiguousMatchError("several source rows match and change one target row")
        touched = everything if self.by_source else [table._of_metadata(r["_file"]) for r in per_file]
        clauses = [*self.matched, *self.unmatched, *self.by_source]
        rows = table._load(snapshot, touched, ("_file", "_row")).withColumn("_in_t", F.lit(True))
        joined = rows.alias("t").join(source.alias("s"), on, "full_outer")
        in_t, in_s = F.col("t._in_t").isNotNull(), F.col("s._in_s").isNotNull()
        act = (
            F.when(in_t & in_s, self._pick(self.matched, 0))
            .when(in_s, self._pick(self.unmatched, len(self.matched)))
            .otherwise(self._pick(self.by_source, len(self.matched) + len(self.unmatched)))
        )
        fields = table.schema_of(snapshot)
        columns = set(self.source.columns)

        def value(clause: Clause, name: str) -> Column:
            if clause.values is None:
                return F.col(f"s.`{name}`") if name in columns else F.col(f"t.`{name}`")
            return F.expr(clause.values[name]) if name in clause.values else F.col(f"t.`{name}`")

        new = []
        for f in fields:
            out = F.col(f"t.`{f.name}`")
            for k, clause in enumerate(clauses):
                if clause.action != "delete":
                    out = F.when(F.col("_act") == k, value(clause, f.name).cast(f.dataType)).otherwise(out)
            new.append(out.alias(f.name))
        kinds = F.lit("keep")
        for k, clause in enumerate(clauses):
            kinds = F.when(F.col("_act") == k, clause.action).otherwise(kinds)
        # several matched source rows without effect on a target row must not repeat it
        decided = joined.withColumn("_act", act).where(in_t | F.col("_act").isNotNull())
        old = F.struct(*[F.col(f"t.`{f.name}`").alias(f.name) for f in fields])
        out = decided.select(F.col("t._file").alias("_file"), F.col("t._row").alias("_row"), kinds.alias("_kind"), F.struct(*new).alias("_new"), old.alias("_old"))
        out = materialise(self._once(out) if any(r.m > 1 for r in per_file) else out, "merge-result")
        counts = {r["_kind"]: r["count"] for r in out.groupBy("_kind").count().collect()}
        metrics = {"rowsInserted": counts.get("insert", 0), "rowsUpdated": counts.get("update", 0), "rowsDeleted": counts.get("delete", 0), "filesRead": len(candidates), "filesSkipped": len(everything) - len(candidates)}
        if not counts.keys() - {"keep"}:
            discard(held, out)
            return base.version
        adds = table.stage(snapshot, out.where("_kind <> 'delete'").select("_new.*"))
        cdc = table._changes_file(snapshot, self._images(out))
        discard(held, out)
        return table.log.commit(base, [*meta, *table.removes(touched), *adds, *cdc], "MERGE", {"condition": self.condition}, metrics)

    @staticmethod
    def _once(out: DataFrame) -> DataFrame:
        """One row for each target row: the change if there is one, else the row itself."""
        changed = out.where("_kind <> 'keep'")
        kept = out.where("_kind = 'keep'").dropDuplicates(["_file", "_row"]).join(changed.where("_file IS NOT NULL").select("_file", "_row"), ["_file", "_row"], "left_anti")
        return changed.unionByName(kept)

    @staticmethod
    def _images(out: DataFrame) -> DataFrame:
        image = lambda kind, column, name: out.where(F.col("_kind") == kind).select(f"{column}.*", F.lit(name).alias("_change_type"))
        return image("insert", "_new", "insert").union(image("update", "_old", "update_preimage")).union(image("update", "_new", "update_postimage")).union(image("delete", "_old", "delete"))
