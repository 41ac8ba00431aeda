"""A store of units in a folder of Parquet tables, with everything the command line offers.

Each table is written whole into a new version folder, and a pointer file then names it, so a reader sees the old or
the new one. One writer at a time.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.functions import fixed
from evigrain.functions.text import digest, token_estimate
from evigrain.operators import audit, evaluate
from evigrain.plans import pipeline
from evigrain.sources import ingest
from evigrain.sources.corpus import Corpus, temporal_state

SCHEMAS = {
    "sources": "source_id string, path string, content_hash string, version int, created_at timestamp, active boolean",
    "units": "unit_id string, subject_id string, label string, kind string, content string, summary string, source_id string, source_location string, community string, confidence double, valid_from string, valid_to string, "
    "metadata_json string, content_hash string, active boolean, created_at timestamp, ingest_seq bigint",
    "relations": "relation_id string, source_id string, target_id string, relation string, confidence double, evidence array<string>, ingest_seq bigint",
    "events": "seq bigint, event_id string, event_type string, unit_id string, run_id string, value double, reason string, payload string, created_at timestamp, prev_hash string, event_hash string",
    "runs": "run_id string, query string, task string, budget int, created_at timestamp, transcript string, metrics string",
}


class Store:
    """Units, sources, relations, runs and the log below one folder."""

    def __init__(self, spark: SparkSession, root: str, state: str = ".evigrain"):
        self.spark, self.root, self.home = spark, root.rstrip("/"), f"{root.rstrip('/')}/{state}"
        self._files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- tables ---

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")

    def initialize(self) -> str:
        """Make the store; one that is there stays as it is."""
        self._files.mkdirs(self._path("."))
        for name in SCHEMAS:
            if not self._versions(name):
                self._write(name, self.spark.createDataFrame([], SCHEMAS[name]))
        return self.home

    def _versions(self, name: str) -> list[int]:
        if not self._files.exists(self._path(name)):
            return []
        found = (s.getPath().getName() for s in self._files.listStatus(self._path(name)))
        return sorted(int(f[1:]) for f in found if f.startswith("v") and self._files.exists(self._path(f"{name}/{f}/_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        """The last whole version of a table."""
        v = self._versions(name)
        if not v:
            raise FileNotFoundError(f"no store at {self.home}; initialize it first")
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.home}/{name}/v{v[-1]}")

    def _write(self, name: str, df: DataFrame) -> None:
        v = self._versions(name)
        df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).write.mode("overwrite").parquet(f"{self.home}/{name}/v{(v[-1] if v else 0) + 1}")
        for old in v[:-1]:  # the version before the last stays for those who still read it
            self._files.delete(self._path(f"{name}/v{old}"), True)

    # --- ingestion ---

    def ingest_documents(self, path: str = ".") -> dict[str, int]:
        """Documents below a folder of the root: changed ones become new versions, each with a unit per section."""
        docs = ingest.read_documents(self.spark, self.root, path)
        versions, changed = self._arrive(docs.select("path", digest("text").alias("content_hash")))
        new = versions.select("path", "source_id", "version", F.lit(True).alias("active"))
        units = ingest.document_units(docs, new).withColumns({"valid_from": F.lit(None).cast("string"), "valid_to": F.lit(None).cast("string"), "metadata_json": F.lit('{"adapter":"docs"}')})
        return {"sources": changed, "units": self._add_units(units, "docs adapter")}

    def ingest_records(self, path: str) -> dict[str, int]:
        """Units and relations of a file of JSON lines; the file, and each other source its records name, is a source."""
        full = ingest.inside(self.root, path)
        name = full[len(ingest.inside(self.root, ".")) + 1 :]
        units, edges = ingest.read_records(self.spark, full, name)
        whole = self.spark.read.text(full, wholetext=True).select(F.lit(name).alias("path"), digest("value").alias("content_hash"), F.lit(0).alias("at"))
        # records of one source are arrivals of it, one after the other
        each = units.where(F.col("source") != name).select(F.col("source").alias("path"), digest("content").alias("content_hash"), F.monotonically_increasing_id().alias("at"))
        versions, changed = self._arrive(whole.unionByName(each), "at")
        named = versions.groupBy("path").agg(F.max_by("source_id", "version").alias("source_id"))
        known = self.table("sources").groupBy("path").agg(F.max_by("source_id", "version").alias("known"))
        u = units.join(named, units.source == named.path, "left").drop("path").join(known, units.source == known.path, "left").withColumn("source_id", F.coalesce("source_id", "known"))
        return {"sources": changed, "units": self._add_units(u, "jsonl adapter"), "relations": self._add_relations(edges)}

    def ingest_graph(self, path: str) -> dict[str, int]:
        """Nodes, links and hyperedges of a graph export."""
        full = ingest.inside(self.root, path)
        name = full[len(ingest.inside(self.root, ".")) + 1 :]
        whole = self.spark.read.text(full, wholetext=True).select(F.lit(name).alias("path"), digest("value").alias("content_hash"))
        self._arrive(whole)
        now = self.table("sources").where((F.col("path") == name) & F.col("active")).select("source_id").first().source_id
        units, edges = ingest.read_graph(self.spark, full)
        u = units.withColumns({"source_id": F.lit(now), "source_location": F.coalesce("source_location", F.lit(name)), "valid_from": F.lit(None).cast("string"), "valid_to": F.lit(None).cast("string"), "metadata_json": F.lit('{"adapter":"graph"}')})
        return {"units": self._add_units(u, "graph adapter", False), "relations": self._add_relations(edges.withColumn("evidence", F.array().cast("array<string>")))}

    def _arrive(self, arrivals: DataFrame, *order: str) -> tuple[DataFrame, int]:
        """New source versions of arrivals (path, content_hash); what equals the last version is none."""
        old = self.table("sources")
        last = old.groupBy("path").agg(F.max("version").alias("last"), F.max_by("content_hash", "version").alias("held"))
        # the version that is held stands first among the arrivals of its path
        a = arrivals.withColumn("_o", F.struct(*(order or ("content_hash",)))).select("path", "content_hash", F.lit(1).alias("_k"), "_o")
        first = last.join(a.select("path").distinct(), "path").select("path", F.col("held").alias("content_hash"), F.lit(0).alias("_k"), F.lit(None).cast(a.schema["_o"].dataType).alias("_o"))
        v = ingest.source_versions(first.unionByName(a), "_k", "_o").where("_k = 1").join(last, "path", "left")
        number = F.col("version") + F.coalesce("last", F.lit(0)) - F.when(F.col("last").isNull(), 0).otherwise(1)
        v = v.withColumn("version", number.cast("int")).withColumn("source_id", F.concat(F.lit("src:"), F.substring(digest("path"), 1, 16), F.lit(":v"), F.col("version")))
        v = v.select("source_id", "path", "content_hash", "version", F.lit(datetime.now(timezone.utc)).alias("created_at"), "active")
        count = v.count()
        if count:
            kept = old.join(v.select("path").distinct().withColumn("_new", F.lit(True)), "path", "left").withColumn("active", F.col("active") & F.col("_new").isNull())
            self._write("sources", kept.select(*old.columns).unionByName(v))
            v = self.table("sources").join(v.select("source_id"), "source_id", "left_semi")
        return v, count

    def _add_units(self, units: DataFrame, reason: str, log: bool = True) -> int:
        """Insert units, or replace those of other content; equal content changes nothing."""
        old = self.table("units")
        start = old.agg(F.max("ingest_seq")).first()[0] or 0
        u = units.withColumn("content_hash", digest("content")).dropDuplicates(["unit_id"])
        new = u.join(old.select("unit_id", F.col("content_hash").alias("_held")), "unit_id", "left").where("_held is null or _held != content_hash")
        new = new.join(evaluate.ranks(new, "unit_id"), "unit_id").withColumns({"ingest_seq": F.col("rank").cast("bigint") + start, "active": F.lit(True), "created_at": F.lit(datetime.now(timezone.utc))}).select(*old.columns)
        count = new.count()
        if count:
            self._write("units", old.join(new.select("unit_id"), "unit_id", "left_anti").unionByName(new))
            if log:
                fresh = self.table("units").where(F.col("ingest_seq") > start)
                self._log(fresh.select("unit_id", F.lit("gene.ingested").alias("event_type"), F.lit(reason).alias("reason"), F.to_json(F.struct("source_id")).alias("payload"), F.col("ingest_seq").alias("_o")))
        return count

    def _add_relations(self, edges: DataFrame) -> int:
        """Insert edges whose ends, name and evidence are new."""
        old = self.table("relations")
        e = edges.withColumn("_e", F.to_json("evidence")).withColumn("relation_id", ingest.relation_id(evidence="_e")).dropDuplicates(["relation_id"]).join(old.select("relation_id"), "relation_id", "left_anti")
        start = old.agg(F.max("ingest_seq")).first()[0] or 0
        new = e.join(evaluate.ranks(e, "relation_id"), "relation_id").withColumn("ingest_seq", F.col("rank").cast("bigint") + start).select(*old.columns)
        count = new.count()
        if count:
            self._write("relations", old.unionByName(new))
        return count

    # --- log ---

    def _log(self, events: DataFrame) -> None:
        """Link events behind the log, in the order of ``_o``."""
        old = self.table("events")
        last = old.agg(F.max("seq").alias("n"), F.max_by("event_hash", "seq").alias("h")).first()
        name = F.concat(F.lit("evt:"), F.substring(F.sha2(F.concat_ws("|", F.lit(uuid.uuid4().hex), "unit_id", "run_id", F.col("_o").cast("string")), 256), 1, 32))
        e = audit.complete(events)
        if "value" not in e.columns:
            e = e.withColumn("value", F.lit(None).cast("double"))
        e = e.withColumn("event_id", name).withColumn("created_at", F.lit(datetime.now(timezone.utc))).withColumn("_key", F.concat(F.lpad(F.col("_o").cast("string"), 20, "0"), "event_id"))
        n = e.join(evaluate.ranks(e, "_key"), "_key").withColumn("seq", F.col("rank").cast("bigint") + F.lit(last.n or 0))
        self._write("events", old.unionByName(audit.link(n.drop("rank", "_o", "_key"), last.h or fixed.GENESIS).select(*old.columns)))

    def feedback(self, run_id: str, accepted: bool, reason: str = "explicit user feedback") -> int:
        """One event per unit the run selected."""
        run = self.explain(run_id)
        picked = self.spark.createDataFrame([run], SCHEMAS["runs"]).select("run_id", F.posexplode(F.from_json(F.get_json_object("transcript", "$.selected"), "array<struct<unit_id:string>>")).alias("rank", "s")).select("run_id", "s.unit_id", "rank")
        e = audit.feedback(picked, accepted, reason)
        self._log(e.select("event_type", "unit_id", "run_id", "value", "reason", F.col("rank").alias("_o")))
        return picked.count()

    def suppress(self, unit_id: str, suppressed: bool, reason: str) -> None:
        one = self.spark.createDataFrame([(unit_id,)], "unit_id string")
        self._log(audit.suppress(one, suppressed, reason).select("event_type", "unit_id", "value", "reason", F.lit(0).alias("_o")))

    def replay(self, to: str | int | None = None) -> DataFrame:
        """Marks after all events, or up to one, named by number or id. Marks are always a view of the log."""
        e = self.table("events")
        return audit.marks_as_of(e, to) if isinstance(to, str) else audit.marks(e, to)

    def verify(self) -> DataFrame:
        return audit.verify(self.table("events"), self.table("units"), self.table("runs"))

    def status(self) -> dict:
        counts = {n: self.table(n).count() for n in SCHEMAS}
        prints = {n: audit.fingerprint(self.table(n).select(*[c for c, t in self.table(n).dtypes if not t.startswith("array")])).first().fingerprint for n in ("sources", "units", "relations", "events")}
        return counts | {"state": prints, "valid": self.verify().isEmpty()}

    # --- queries ---

    def corpus(self, now: datetime | None = None) -> Corpus:
        status = F.get_json_object("metadata_json", "$.status")
        u = self.table("units").withColumns({"status": status, "state": temporal_state(F.lit(now or datetime.now(timezone.utc)), status)})
        return Corpus(u, self.table("relations"), self.table("sources"), self.replay())

    def query(self, queries: DataFrame, **options) -> DataFrame:
        """Answer queries (question_id, query, budget) and keep the runs: (run_id, context, context_tokens, transcript, metrics)."""
        named = queries.select(F.concat(F.lit("run:"), F.lit(uuid.uuid4().hex[:12]), F.lit(":"), "question_id").alias("question_id"), "query", "budget")
        r = pipeline.retrieve(named, self.corpus(options.pop("now", None)), **options)
        # a run's candidates are one row of the result, as its transcript is one value
        sel = r.selected().groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("rank", "unit_id", "subject_id", "label", "score", "estimated_tokens", "facet_ids", "matched_terms", "citation", "reasons"))).alias("selected"))
        exc = r.excluded().groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("unit_id", "reason"))).alias("excluded"))
        met = r.metrics().select("run_id", F.to_json(F.struct("*")).alias("metrics"))
        t = r.runs.select("run_id", "query", "task", "budget", "temporal_mode", "positives", "negatives").join(sel, "run_id", "left").join(exc, "run_id", "left").join(r.contexts().select("run_id", "context", "context_tokens"), "run_id", "left").join(met, "run_id")
        t = t.withColumn("transcript", F.to_json(F.struct("query", "temporal_mode", F.col("positives").alias("positive_terms"), F.col("negatives").alias("negative_terms"), "selected", "excluded", "context")))
        runs = t.withColumn("created_at", F.lit(datetime.now(timezone.utc)))
        self._write("runs", self.table("runs").unionByName(runs.select(*self.table("runs").columns)))
        kept = self.table("runs").join(named.select(F.col("question_id").alias("run_id")), "run_id", "left_semi")
        payload = F.to_json(F.struct(digest("transcript").alias("transcript_hash"), digest("metrics").alias("metrics_hash"), "budget"))
        self._log(kept.select("run_id", F.lit("query.transcribed").alias("event_type"), F.lit(None).cast("string").alias("unit_id"), F.lit("deterministic retrieval").alias("reason"), payload.alias("payload"), F.lit(0).alias("_o")))
        text = F.coalesce(F.get_json_object("transcript", "$.context"), F.lit(""))
        return kept.select("run_id", "query", "budget", text.alias("context"), token_estimate(text).alias("context_tokens"), "transcript", "metrics")

    def explain(self, run_id: str) -> dict:
        """A kept run; an unknown one is an error."""
        row = self.table("runs").where(F.col("run_id") == run_id).first()
        if row is None:
            raise KeyError(f"unknown run: {run_id}")
        return row.asDict()
