"""Safe re-ingest: a new extraction replaces stored chunks only after every check, and all at once.

A collection is a folder: ``runs/<run>`` holds what a run staged (chunks, report,
mapping), ``pointer/<generation>`` names the run whose mapping is current.  The
mapping has a row ``(version_id, run)`` for each version: the run whose chunks
are its own.  Readers follow the highest pointer, so they see the old chunks of
all versions, or the new ones of all that were applied, and never a mixture.

A run (1) stages its chunks under a new path; (2) decides for each version from
gates and comparison: a failed gate blocks it, and so does a verified version
whose fingerprint would change, unless revoking is allowed; (3) reads back what
it has staged and takes the counts and fingerprints again: a version for which
they differ is rolled back, that is, it keeps its old chunks; (4) writes the new
mapping; (5) moves the pointer by one rename, which fails if another run was
faster.  Each step's table is complete or absent, so a run that was stopped
anywhere is started again under its name: it takes up what is complete and
writes the rest anew.

Nothing is collected but the pointer's number; versions of any number are
compared by joins on ``version_id``, chunks are hashed before they are grouped.

Defined cases: a version that is new to the collection has no old chunks and
isn't blocked for a change; one without staged chunks is blocked (``no_chunks``);
a version that isn't listed in ``versions`` counts as not verified; repeated
gate rows count once; an empty staging applies nothing and leaves the pointer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.relational import fingerprint

CHUNKS = "version_id long, chunk_no long, text string"


def digests(chunks: DataFrame) -> DataFrame:
    """``(version_id, n_chunks, n_chars, fingerprint)``: order and text of the chunks."""
    hashed = chunks.select("version_id", "chunk_no", F.sha2("text", 256).alias("h"), F.length("text").cast("long").alias("n"))
    parts = hashed.groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "h"))).alias("p"), F.count("*").alias("n_chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chars"))
    return parts.select("version_id", "n_chunks", "n_chars", fingerprint(F.transform("p", lambda x: F.coalesce(x["h"], F.lit("")))).alias("fingerprint"))


def decisions(staged: DataFrame, stored: DataFrame, gates: DataFrame, versions: DataFrame, dry_run: bool = False, allow_revoke: bool = False) -> DataFrame:
    """One row a version of ``versions(version_id, corpus_status)`` or of the staging: old and new counts, fingerprints, failed gates and the decision.

    ``staged`` and ``stored`` are ``digests``; ``gates(version_id, gate, status)``.
    Decisions: ``blocked_gates``, ``blocked_verified``, ``unchanged``, ``dry_run``, ``apply``.
    """
    failed = gates.filter("status = 'fail'").groupBy("version_id").agg(F.array_sort(F.collect_set("gate")).alias("failed_gates"))
    new = staged.select("version_id", F.col("n_chunks").alias("new_chunks"), F.col("n_chars").alias("new_chars"), F.col("fingerprint").alias("new_fingerprint"))
    old = stored.select("version_id", F.col("n_chunks").alias("old_chunks"), F.col("n_chars").alias("old_chars"), F.col("fingerprint").alias("old_fingerprint"))
    every = versions.select("version_id", "corpus_status").join(new, "version_id", "full").join(old, "version_id", "left").join(failed, "version_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("old_chunks", "new_chunks", "old_chars", "new_chars")]
    none = F.array().cast("array<string>")
    gone = F.array_union(F.coalesce("failed_gates", none), F.when(F.col("new_fingerprint").isNull(), F.array(F.lit("no_chunks"))).otherwise(none))
    changed = F.col("old_fingerprint").isNotNull() & (F.col("old_fingerprint") != F.col("new_fingerprint"))
    verified = F.coalesce(F.col("corpus_status") == "verified", F.lit(False))
    decision = F.when(F.size("blocking") > 0, "blocked_gates").when(verified & changed & F.lit(not allow_revoke), "blocked_verified")
    decision = decision.when(F.col("old_fingerprint") == F.col("new_fingerprint"), "unchanged").when(F.lit(dry_run), "dry_run").otherwise("apply")
    told = every.select("version_id", "corpus_status", *zero, "old_fingerprint", "new_fingerprint", gone.alias("blocking")).withColumn("decision", decision)
    return told.withColumn("revokes", (F.col("decision") == "apply") & verified & changed)


class Collection:
    """Chunks of versions below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, path: str) -> bool:
        return self._fs().exists(self._path(path, "_SUCCESS"))

    def _once(self, path: str, df: DataFrame) -> DataFrame:
        """The table at ``path``, written now unless it is complete."""
        if not self._complete(path):
            df.write.mode("overwrite").parquet(f"{self.root}/{path}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}")

    def _pointers(self) -> list[tuple[int, str]]:
        """(generation, run), oldest first; names are ``<generation>.<run>``."""
        if not self._fs().exists(self._path("pointer")):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path("pointer"))]
        return sorted((int(n.split(".", 1)[0]), n.split(".", 1)[1]) for n in names if n[:1].isdigit())

    def _move(self, generation: int, run: str) -> None:
        """One rename of a marked folder to the next generation's; only one run can have it.

        A run that is stopped between the rename and the pointer keeps others
        out until it is started again.
        """
        fs, claim = self._fs(), self._path("claims", str(generation))
        fs.mkdirs(self._path("claims"))
        fs.mkdirs(self._path("pointer"))
        own = self._path("runs", run, "claim")
        fs.mkdirs(own)
        if not (fs.exists(claim) and fs.exists(self._path("claims", str(generation), run))):
            fs.mkdirs(self._path("runs", run, "claim", run))
            if fs.exists(claim) or not fs.rename(own, claim):
                raise RuntimeError(f"generation {generation} was taken by another run")
        if not fs.exists(self._path("claims", str(generation), run)):
            raise RuntimeError(f"generation {generation} was taken by another run")
        if not fs.mkdirs(self._path("pointer", f"{generation}.{run}")):
            raise RuntimeError("the pointer can't be moved")

    # ------------------------------------------------------------ readers

    @property
    def generation(self) -> int:
        return max((g for g, _ in self._pointers()), default=0)

    def mapping(self) -> DataFrame:
        """``(version_id, run)`` of the current generation."""
        held = self._pointers()
        if not held:
            return self.spark.createDataFrame([], "version_id long, run string")
        return self.spark.read.schema("version_id long, run string").parquet(f"{self.root}/runs/{held[-1][1]}/mapping")

    def chunks(self) -> DataFrame:
        """``(version_id, chunk_no, text)`` of the current generation: one scan of the runs, joined with the mapping."""
        runs = [run for _, run in self._pointers()]
        out = self.spark.createDataFrame([], CHUNKS)
        if not runs:
            return out
        every = [self.spark.read.schema(CHUNKS).parquet(f"{self.root}/runs/{r}/chunks").withColumn("run", F.lit(r)) for r in runs]
        for part in every[1:]:
            every[0] = every[0].unionByName(part)
        return every[0].join(self.mapping(), ["version_id", "run"], "left_semi").select("version_id", "chunk_no", "text")

    # ------------------------------------------------------------ a run

    def reingest(self, run: str, chunks: DataFrame, gates: DataFrame, versions: DataFrame, dry_run: bool = False, allow_revoke: bool = False, step=lambda name: None) -> DataFrame:
        """The report of a run: ``decisions`` and ``outcome`` (``applied``, ``rolled_back`` or the decision).

        ``step`` is called before each step with its name.
        """
        at = f"runs/{run}"
        if any(r == run for _, r in self._pointers()):
            return self.spark.read.parquet(f"{self.root}/{at}/report")
        fresh = chunks.select(F.col("version_id").cast("long").alias("version_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "text")
        step("decide")
        decided = self._once(f"{at}/decided", decisions(digests(fresh), digests(self.chunks()), gates, versions, dry_run, allow_revoke))
        if dry_run:
            return decided.withColumn("outcome", F.col("decision"))
        step("stage")
        wanted = decided.filter("decision = 'apply'").select("version_id")
        self._once(f"{at}/chunks", fresh.join(wanted, "version_id", "left_semi"))
        step("verify")
        again = digests(self.spark.read.schema(CHUNKS).parquet(f"{self.root}/{at}/chunks")).select("version_id", F.col("n_chunks").alias("_n"), F.col("fingerprint").alias("_f"))
        alike = (F.col("_n") == F.col("new_chunks")) & (F.col("_f") == F.col("new_fingerprint"))
        outcome = F.when(F.col("decision") != "apply", F.col("decision")).when(alike, "applied").otherwise("rolled_back")
        report = self._once(f"{at}/report", decided.join(again, "version_id", "left").withColumn("outcome", outcome).drop("_n", "_f"))
        applied = report.filter("outcome = 'applied'").select("version_id", F.lit(run).alias("run"))
        if applied.isEmpty():
            return report
        step("map")
        generation, before = self.generation + 1, self.mapping()
        mapped = before.join(applied.select("version_id"), "version_id", "left_anti").unionByName(applied)
        mapped.write.mode("overwrite").parquet(f"{self.root}/{at}/mapping")
        step("move")
        self._move(generation, run)
        return report
