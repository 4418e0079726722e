"""The services around documents: versions, scopes, audit, links, memory, three-way reconciliation, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import let, squash
from folioforge.plans.lineage import broadcast_if_small

# ------------------------------------------------------------------ versions and lifecycle


def changed_versions(log: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Numbers the entries of a log whose content differs from the one before as versions; the last of a key is active."""
    w = Window.partitionBy(key).orderBy(*order)
    new = log.withColumn("_before", F.lag(content).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(content))).drop("_before")
    return new.withColumn("version", F.row_number().over(w).cast("long")).withColumn("active", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])) == 1)


def latest(log: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """Newest entry of each key by one aggregation, without a sort."""
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_v"), F.count("*").alias("n_entries")).select(key, "n_entries", "_v.*")


#: Allowed moves of a version's corpus status: (from, action) -> to.
TRANSITIONS = {("extracted", "approve"): "verified", ("needs_review", "approve"): "verified", ("verified", "revoke"): "revoked", ("revoked", "approve"): "verified", ("extracted", "reject"): "failed", ("needs_review", "reject"): "failed", ("candidate", "reject"): "failed"}


def transition(status: Column, action: Column, note: Column) -> Column:
    """The status after an action; null if it isn't allowed (approving what needs review takes a note)."""
    out = F.lit(None).cast("string")
    for (was, what), to in TRANSITIONS.items():
        ok = (status == was) & (action == what)
        if (was, what) == ("needs_review", "approve"):
            ok = ok & (F.coalesce(F.trim(note), F.lit("")) != "")
        out = F.when(ok, F.lit(to)).otherwise(out)
    return out


def keep_verified(outcome: Column, indexed: Column, fingerprint: Column, before: Column) -> Column:
    """Whether a verified version stays so after a new run."""
    return (outcome != "failed") & indexed & F.coalesce(fingerprint == before, F.lit(False))


def eligible(area_verified: Column, active: Column, ingestion: Column, corpus: Column) -> Column:
    """The predicate of all readers of evidence."""
    return area_verified & active & (ingestion == "indexed") & (corpus == "verified")


# ------------------------------------------------------------------ gates and hashes


def gate(value: Column, passes: float, reviews: float) -> Column:
    """pass / review / fail of a share."""
    return F.when(value >= passes, "pass").when(value >= reviews, "review").otherwise("fail")


def outcome(gates: DataFrame, by: list[str], can_fail: list[str]) -> DataFrame:
    """failed if a gate that can fail does, needs_review if any gate isn't passed, else extracted."""
    failed = F.bool_or((F.col("status") == "fail") & F.col("gate").isin(can_fail))
    return gates.groupBy(*by).agg(F.when(failed, "failed").when(F.bool_or(F.col("status") != "pass"), "needs_review").otherwise("extracted").alias("outcome"), F.count("*").alias("n_gates"))


def fingerprint(parts: Column, *header: Column) -> Column:
    """SHA-256 over header and ordered part hashes, each ended by a zero character."""
    nul = F.lit("\u0000")
    head = F.concat(*[F.concat(h.cast("string"), nul) for h in header])
    return F.sha2(F.concat(head, F.array_join(F.transform(parts, lambda p: F.concat(p, nul)), "")), 256)


def traced_share(chunk: Column, pages: Column, least: int = 8) -> Column:
    """Share of a chunk's lines (without white space, of at least ``least`` characters) that stand in its pages."""
    lines = F.filter(F.transform(F.split(chunk, "\n"), squash), lambda x: F.length(x) >= least)
    both = F.struct(lines.alias("lines"), squash(pages).alias("pages"))
    return let(both, lambda b: F.when(F.size(b["lines"]) == 0, F.lit(1.0)).otherwise(F.size(F.filter(b["lines"], lambda x: F.contains(b["pages"], x))) / F.size(b["lines"])))


# ------------------------------------------------------------------ scopes, audit, lists


def in_scope(rows: DataFrame, scopes: DataFrame, users: DataFrame, area: str, document: str, owner_role: str = "owner_admin", block: int = 10_000) -> DataFrame:
    """Rows each user may see: all for the owner, else those of a granted area or document, once each.

    Owners see every row by one rule, without a join: their ids stand in the
    plan, ``block`` at a time.  Grants are joined by equality on each kind.
    """
    live = scopes.filter(~F.col("revoked"))
    owners = [r.user_id for r in users.filter(F.col("role") == owner_role).select("user_id").distinct().orderBy("user_id").toLocalIterator()]  # a row for each owner
    others = live.join(users.filter(F.col("role") != owner_role).select("user_id"), "user_id", "left_semi")
    by_area = rows.join(others.filter("scope_type = 'area'").select("user_id", F.col("scope_id").alias(area)), area)
    by_doc = rows.join(others.filter("scope_type = 'document'").select("user_id", F.col("scope_id").alias(document)), document)
    out = by_area.select("user_id", *rows.columns).unionByName(by_doc.select("user_id", *rows.columns)).distinct()
    for i in range(0, len(owners), block):
        out = out.unionByName(rows.select(F.explode(F.array(*map(F.lit, owners[i : i + block]))).alias("user_id"), *rows.columns))
    return out


def audit_page(events: DataFrame, prefix: str | None = None, contains: str | None = None, user: int | None = None, since: str | None = None, until: str | None = None, limit: int = 50, offset: int = 0, text: str = "props") -> DataFrame:
    """A page of the log, newest first; filters reach the scan."""
    e = events
    if prefix:
        e = e.filter(F.col("event_type").ilike(prefix.replace("%", "\\%") + "%"))
    if contains:
        e = e.filter(F.col(text).ilike(f"%{contains}%"))
    if user is not None:
        e = e.filter(F.col("user_id") == user)
    if since:
        e = e.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        e = e.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(limit)


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """``(user_id, session, n_events, seconds)``: a session ends when nothing happens for the gap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    far = micros - F.lag(micros).over(w) > gap_seconds * 1_000_000
    s = events.withColumn("_m", micros).withColumn("_new", F.coalesce(far, F.lit(True)).cast("long")).withColumn("session", F.sum("_new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), ((F.max("_m") - F.min("_m")) / 1_000_000).cast("double").alias("seconds"))


def natural_key(code: Column) -> Column:
    """Sort key of codes: nulls last, reports after standards, numbers by value."""
    return F.struct(code.isNull().alias("n"), F.contains(F.upper(code), F.lit("/TR")).alias("t"), F.transform(F.regexp_extract_all(code, F.lit("([0-9]+)")), lambda x: x.cast("long")).alias("k"), code.alias("c"))


def missing_codes(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested codes that aren't there; a code without a part number is there if any part is, one with a part must match."""
    parts = available.select(F.col("code").alias("held")).unionByName(available.select(F.regexp_extract("code", "^([0-9]+)", 1).alias("held"))).distinct()
    return requested.join(parts, requested["code"] == parts["held"], "left_anti")


def reference_links(docs: DataFrame, owners: DataFrame, pattern: str, existing: DataFrame | None = None) -> DataFrame:
    """``(doc_id, target)``: edges from documents to the owners of codes they mention, without themselves and known edges."""
    said = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern)))).alias("code"))
    edges = said.join(owners, "code").filter(~F.col("doc_id").eqNullSafe(F.col("target"))).select("doc_id", "target").distinct()
    return edges if existing is None else edges.join(existing, ["doc_id", "target"], "left_anti")


def memory_relevance(notes: DataFrame, questions: DataFrame, newest: int = 50, top: int = 6) -> DataFrame:
    """``(qid, item_id, place)``: of the newest notes, preferences first, then shared words, then recency.

    The ``newest`` notes stand beside each question as one array (a scalar
    subquery), scored within a projection: nothing is joined or ranked across rows.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}]{3,})")))
    recent = notes.orderBy(F.desc("ts"), F.desc("item_id")).limit(newest)
    each = F.struct("ts", "item_id", F.coalesce(F.col("kind") == "preference", F.lit(False)).alias("preferred"), words(F.col("note")).alias("words"))
    held = recent.agg(F.sort_array(F.collect_list(each), asc=False).alias("notes")).scalar()
    asked = questions.select("qid", words(F.col("question")).alias("asked"), held.alias("notes"))

    def score(x: Column, age: Column) -> Column:
        shared = F.size(F.array_intersect(F.coalesce(x["words"], F.array().cast("array<string>")), F.coalesce("asked", F.array().cast("array<string>"))))
        return F.struct((~x["preferred"]).alias("other"), (-shared).alias("less"), age.alias("age"), x["item_id"].alias("item_id"))

    best = F.slice(F.array_sort(F.filter(F.transform("notes", score), lambda s: ~s["other"] | (s["less"] < 0))), 1, top)
    return asked.select("qid", F.posexplode(best).alias("place", "s")).select("qid", F.col("s.item_id").alias("item_id"), (F.col("place") + 1).cast("long").alias("place"))


def chains(items: DataFrame, rounds: int = 40) -> DataFrame:
    """``(item_id, root, depth)`` of a supersede chain ``items(item_id, replaces)`` by pointer doubling.

    Each round doubles the distance a pointer spans, so a chain of n takes log2(n) joins.
    An item that points to a finished one, or to one that isn't there, is finished:
    it is written once and later rounds only look it up.
    """
    from folioforge.plans.lineage import cut

    now = cut(items.select("item_id", F.coalesce("replaces", "item_id").alias("root"), F.when(F.col("replaces").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("replaces").isNull().alias("done")), "chain")
    finished, going = now.filter("done"), now.filter("not done")
    for _ in range(rounds):
        if not going.limit(1).count():
            return finished.drop("done")
        up = finished.unionByName(going).toDF("_i", "_r", "_d", "_done")
        after = cut(going.join(up, going["root"] == up["_i"], "left").select("item_id", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.coalesce("_done", F.lit(True)).alias("done")), "chain")
        finished, going = finished.unionByName(after.filter("done")), after.filter("not done")
    raise ValueError("the chain has a cycle, or is longer than 2 ** rounds")


# ------------------------------------------------------------------ three-way reconciliation


def digest(*columns: str) -> Column:
    """SHA-256 of a row in canonical form."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)


def reconcile(local: DataFrame, remote: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(row_key, action, winner)`` of three tables ``(row_key, digest)``.

    Equal sides keep; one side changed against the baseline is followed, its
    absence being a deletion; both changed to different values is a conflict.
    """
    j = local.withColumnRenamed("digest", "l").join(remote.withColumnRenamed("digest", "r"), "row_key", "full_outer").join(baseline.withColumnRenamed("digest", "b"), "row_key", "full_outer")
    same = F.col("l").eqNullSafe(F.col("r"))
    local_moved, remote_moved = ~F.col("l").eqNullSafe(F.col("b")), ~F.col("r").eqNullSafe(F.col("b"))
    action = (
        F.when(same, "keep").when(local_moved & remote_moved, "conflict").when(local_moved & F.col("l").isNull(), "delete_remote").when(local_moved, "push")
        .when(F.col("r").isNull(), "delete_local").otherwise("pull")
    )
    return j.withColumn("action", action).withColumn("winner", F.when(F.col("action") == "conflict", F.lit(None)).when(F.col("action").isin("push", "keep"), F.col("l")).when(F.col("action") == "pull", F.col("r"))).select("row_key", "action", "winner")


def apply_reconciled(plan: DataFrame) -> DataFrame:
    """The rows both sides should have; raises if any conflict stands, so that nothing is written."""
    if not plan.filter("action = 'conflict'").isEmpty():
        raise ValueError("conflicting changes: nothing is written")
    return plan.filter("winner is not null").select("row_key", F.col("winner").alias("digest"))


# ------------------------------------------------------------------ change detection


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, change)`` between two listings ``(path, sha)``: new, changed, unchanged or missing."""
    j = before.select("path", F.col("sha").alias("was")).join(now.select("path", "sha"), "path", "full_outer")
    return j.select("path", F.when(F.col("was").isNull(), "new").when(F.col("sha").isNull(), "missing").when(F.col("was") == F.col("sha"), "unchanged").otherwise("changed").alias("change"))


def job_order(jobs: DataFrame) -> DataFrame:
    """Uploads first, then small, then old."""
    return jobs.orderBy(~F.col("is_upload"), "size", "created_at", "job_id")


def summaries_due(messages: DataFrame, every: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``(key, n_messages, first_turn, last_turn, n_chars)``: one row whenever a conversation's messages reach a multiple of ``every``.

    The row tells the stretch to summarise, the last ``every`` messages in the
    order of ``order`` (null first), role and text; null texts count no
    characters.  What is left behind the last multiple is not due yet.
    """
    before = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    stretch = before.rowsBetween(1 - every, 0)
    n = messages.select(
        key, F.row_number().over(before).cast("long").alias("n_messages"), F.first(order).over(stretch).cast("long").alias("first_turn"),
        F.col(order).cast("long").alias("last_turn"), F.coalesce(F.sum(F.length("text")).over(stretch), F.lit(0)).cast("long").alias("n_chars"),
    )
    return n.filter(F.col("n_messages") % every == 0)
