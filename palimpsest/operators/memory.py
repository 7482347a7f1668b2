"""Memory and governance: versioned state, sessions, audit, events, history, erasure, policy.

All are relations: versions are rows with a generation, chains are checked by the row before in the
partition of their log, reachability is a recursive query or a join loop over an edges table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import digest, key_level, prefix_end
from palimpsest.plans.sequences import numbered
from palimpsest.storage import removed, ship, written


def state_at(ops: DataFrame, upto: int | None = None) -> DataFrame:
    """(key, value, ordinal): the last op of each key wins, a null value deletes. Combined before the shuffle."""
    if upto is not None:
        ops = ops.where(F.col("ordinal") <= upto)
    last = ops.groupBy("key").agg(F.max("ordinal").alias("ordinal"), F.max_by("value", "ordinal").alias("value"))
    return last.where("value is not null").select("key", "value", "ordinal")


def write_many(base: DataFrame, ops: DataFrame) -> DataFrame:
    """(key, value) after a batch of (key, value, ordinal) on a base of (key, value)."""
    change = ops.groupBy("key").agg(F.max_by("value", "ordinal").alias("new")).withColumn("touched", F.lit(True))
    out = base.join(change, "key", "full_outer")
    value = F.when(F.col("touched").isNotNull(), F.col("new")).otherwise(F.col("value"))
    return out.select("key", value.alias("value")).where("value is not null")


def prefix_scan(state: DataFrame, prefix: str) -> DataFrame:
    """Keys that begin with the prefix, as a range, which parquet statistics can use."""
    end = prefix_end(prefix)
    found = state.where(F.col("key") >= prefix)
    return (found.where(F.col("key") < end) if end is not None else found).orderBy("key")


def boundaries(state: DataFrame) -> DataFrame:
    """(key, level): keys of level 1 or more end a leaf, of level 2 or more a node above, and so on."""
    return state.select("key", key_level("key").alias("level"))


def live_turns(turns: DataFrame, now: int | None) -> DataFrame:
    """Turns that haven't expired; all of them for a replay, which gives no time."""
    return turns if now is None else turns.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def collected_turns(turns: DataFrame, now: int, retention: int) -> DataFrame:
    """What is left after expired turns older than the retention are removed."""
    gone = F.col("expires_at").isNotNull() & (F.col("expires_at") <= now) & (F.col("created_at") + retention <= now)
    return turns.where(~gone)


def next_seq(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session").agg((F.max("seq") + 1).alias("next_seq"))


def event_hash(prev: str, seq: int, at: int | None, kind: str | None, data: str | None) -> str:
    """What an event's hash covers: the hash before it, its number, time, kind and data."""
    named = hashlib.sha256((kind or "").encode()).hexdigest()
    return hashlib.sha256(f"{prev}|{seq}|{'' if at is None else at}|{named}|{data or ''}".encode()).hexdigest()


def event_hash_of() -> Column:
    """The same of the columns prev, seq, at, kind and data."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", text("prev"), text("seq"), text("at"), F.sha2(text("kind").cast("binary"), 256), text("data")).cast("binary"), 256)


def chain(events: DataFrame) -> DataFrame:
    """(log, seq, kind, at, data, prev, hash) of events (log, order, kind, at, data): numbered from 0, each hash covers the row and the hash before it.

    A log is one sequence by definition; logs are spread over partitions, and rows stream through in order.
    """
    ship(events.sparkSession)
    rows = events.select(F.col("log").cast("long").alias("log"), F.col("order").cast("long").alias("order"), F.col("kind").cast("string").alias("kind"), F.col("at").cast("long").alias("at"), F.col("data").cast("string").alias("data"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, seq = None, "", 0
        for b in batches:
            prevs, hashes, numbers = [], [], []
            for r in b.to_pylist():
                if r["log"] != now:
                    now, last, seq = r["log"], "", 0
                prevs.append(last)
                numbers.append(seq)
                last = event_hash(last, seq, r["at"], r["kind"], r["data"])
                hashes.append(last)
                seq += 1
            yield pa.RecordBatch.from_arrays([b.column("log"), pa.array(numbers, pa.int64()), b.column("kind"), b.column("at"), b.column("data"), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], ["log", "seq", "kind", "at", "data", "prev", "hash"])

    ordered = rows.repartition("log").sortWithinPartitions("log", "order")
    return ordered.mapInArrow(link, "log long, seq long, kind string, at long, data string, prev string, hash string")


def chain_faults(chained: DataFrame) -> DataFrame:
    """(log, seq, fault): rows that aren't at the place their number says, hashes that don't cover their row, links that don't fit the row before."""
    w = Window.partitionBy("log").orderBy("seq")
    seen = chained.withColumns({"before": F.coalesce(F.lag("hash").over(w), F.lit("")), "place": F.row_number().over(w) - 1})
    fault = F.when(event_hash_of() != F.col("hash"), "rewritten").when(F.col("prev") != F.col("before"), "unlinked").when(F.col("seq") != F.col("place"), "misplaced")
    return seen.select("log", "seq", fault.alias("fault")).where("fault is not null")


def gaps(records: DataFrame, log: str, seq: str) -> DataFrame:
    """(log, seq, missing): where numbers are missing (above 0) or repeated (-1) before a record."""
    seen = numbered(records.select(F.col(log).alias("log"), F.col(seq).alias("seq")), "log", ["seq"], "place", {"last": "seq"})
    return seen.select("log", "seq", (F.col("seq") - F.col("last") - 1).alias("missing")).where("missing <> 0")


#: Edges that are followed on the driver; of more, each step is a join.
FEW_EDGES = 1_000_000


def _few(edges: DataFrame) -> dict | None:
    """Targets by source, if there are few edges."""
    rows = edges.select("src", "dst").limit(FEW_EDGES + 1).collect()
    if len(rows) > FEW_EDGES:
        return None
    out: dict = {}
    for r in rows:
        out.setdefault(r.src, []).append(r.dst)
    return out


def _followed(targets: dict, roots: Iterable) -> set:
    seen, todo = set(roots), list(roots)
    while todo:
        for t in targets.get(todo.pop(), ()):
            if t is not None and t not in seen:
                seen.add(t)
                todo.append(t)
    return seen


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): what the roots lead to over edges (src, dst).

    Up to ``FEW_EDGES`` are followed on the driver, from as few roots. Beyond, it is a join for each step with what
    was new in the one before; a step writes only that, and what is reached is the union of the steps.
    Where steps are many, they are put together from time to time. Both ways give the same.
    """
    begin = roots.select("node").where("node is not null").distinct()
    first = begin.limit(FEW_EDGES + 1).collect()
    if len(first) <= FEW_EDGES and (targets := _few(edges)) is not None:
        found = _followed(targets, [r.node for r in first])
        return edges.sparkSession.createDataFrame([(n,) for n in sorted(found)], begin.schema)
    edges = written(edges.select("src", "dst"), "edges")
    steps = [written(roots.select("node").where("node is not null").distinct(), "reached")]
    while True:
        seen = steps[0]
        for s in steps[1:]:
            seen = seen.union(s)
        step = steps[-1].join(edges, steps[-1]["node"] == edges["src"]).select(F.col("dst").alias("node")).where("node is not null").distinct()
        new = written(step.join(seen, "node", "left_anti"), "frontier")
        if new.isEmpty():
            removed(new)
            out = written(seen, "reachable") if len(steps) > 1 else steps[0]
            for s in steps if len(steps) > 1 else ():
                removed(s)
            removed(edges)
            return out
        steps.append(new)
        if len(steps) > 16:  # the last stays as it is: the next step goes on from there
            old, last = steps[:-1], steps[-1]
            first = old[0]
            for s in old[1:]:
                first = first.union(s)
            steps = [written(first, "reached"), last]
            for s in old:
                removed(s)


def ancestors(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, node): every commit that each head (head, node) descends from, itself too, over edges (src, dst) of few commits a head."""
    begin = heads.select("head", "node").distinct()
    first = begin.limit(FEW_EDGES // 100 + 1).collect()
    if len(first) <= FEW_EDGES // 100 and (targets := _few(edges)) is not None:
        rows = ((r.head, n) for r in first for n in _followed(targets, [r.node]))
        return edges.sparkSession.createDataFrame(list(rows), begin.schema)
    edges = written(edges.select("src", "dst"), "edges")
    seen = new = written(begin, "heads")
    steps = [seen]
    while True:
        step = new.join(edges, new["node"] == edges["src"]).select("head", F.col("dst").alias("node")).distinct()
        new = written(step.join(seen, ["head", "node"], "left_anti"), "heads")
        if new.isEmpty():
            removed(new)
            out = written(seen, "ancestors")
            for s in [*steps, edges]:
                removed(s)
            return out
        steps.append(new)
        seen = seen.union(new)


def fast_forward(edges: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """(name, local, remote, verdict) of refs (name, node) on either side: new, same, forward, behind or diverged, by ancestry over all parents."""
    both = local.select("name", F.col("node").alias("l")).join(remote.select("name", F.col("node").alias("r")), "name", "full_outer")
    above = ancestors(edges, both.where("l is not null and r is not null").select(F.col("r").alias("head"), F.col("r").alias("node")).union(both.where("l is not null and r is not null").select("l", "l")))
    up = above.select(F.col("head").alias("r"), F.col("node").alias("l"), F.lit(True).alias("forward"))
    down = above.select(F.col("head").alias("l"), F.col("node").alias("r"), F.lit(True).alias("behind"))
    verdict = F.when(F.col("r").isNull(), "local").when(F.col("l").isNull(), "new").when(F.col("l") == F.col("r"), "same").when(F.col("forward"), "forward").when(F.col("behind"), "behind").otherwise("diverged")
    return both.join(up, ["l", "r"], "left").join(down, ["l", "r"], "left").select("name", F.col("l").alias("local"), F.col("r").alias("remote"), verdict.alias("verdict"))


def erasable(refs: DataFrame, subject: str) -> DataFrame:
    """(hash) of blobs that only the subject's rows (hash, subject) refer to."""
    mine = refs.where(F.col("subject") == subject).select("hash").distinct()
    foreign = refs.where(F.coalesce(F.col("subject") != subject, F.lit(True))).select("hash")
    return mine.join(foreign, "hash", "left_anti")


def selector_matches(head, selector):
    """Whether a head's name is what a selector asks for: ``*``, ``prefix*`` or the name."""
    return F.when(F.substring(selector, -1, 1) == "*", F.startswith(head, F.left(selector, F.length(selector) - 1))).otherwise(head == selector)


def head_matches(head: str, selectors: str):
    """Whether any of a list of selectors asks for the head; none or an empty list asks for all."""
    s = F.col(selectors)
    return s.isNull() | (F.size(s) == 0) | F.exists(s, lambda x: selector_matches(F.col(head), x))


#: Rules of a policy; those of the whole database are evaluated once, whatever the head.
GLOBAL_RULES = ("require-encryption-at-rest", "retention-floor")
HEAD_RULES = ("require-tamper-evident-chain", "require-signed-checkpoints", "require-principal", "require-signed-commits", "require-provenance")


def policy_status(policies: DataFrame, heads: DataFrame, *, encrypted: bool, retention: int | None) -> DataFrame:
    """(policy, rule, head, mode, status) of enabled policies (id, rule, min_secs, heads, mode, enabled) on each head.

    heads: (head, chain_length, chain_signed, chain_ok, retrievals, unnamed, tip, tip_signed), counts null where there
    are none. Policies are a list that an administrator wrote, and are broadcast only where Spark finds them small.
    """
    p = policies.where(F.coalesce("enabled", F.lit(True)))
    whole = F.when(F.col("rule") == "require-encryption-at-rest", F.lit(encrypted)).otherwise(F.coalesce(F.lit(retention).cast("long") >= F.col("min_secs"), F.lit(False)))
    one = p.where(F.col("rule").isin(*GLOBAL_RULES)).select(F.col("id").alias("policy"), "rule", F.lit("(database)").alias("head"), "mode", whole.alias("ok"))
    length, signed = F.coalesce("chain_length", F.lit(0)), F.coalesce("chain_signed", F.lit(0))
    intact = F.coalesce("chain_ok", F.lit(False)) & (length > 0)
    ok = (
        F.when(F.col("rule") == "require-tamper-evident-chain", intact)
        .when(F.col("rule") == "require-signed-checkpoints", intact & (signed == length))
        .when(F.col("rule") == "require-principal", F.coalesce("unnamed", F.lit(0)) == 0)
        .when(F.col("rule") == "require-signed-commits", F.col("tip").isNull() | F.coalesce("tip_signed", F.lit(False)))
        .otherwise(F.lit(True))  # provenance is enforced when it is written
    )
    each = p.where(F.col("rule").isin(*HEAD_RULES)).join(heads, head_matches("head", "heads")).select(F.col("id").alias("policy"), "rule", "head", "mode", ok.alias("ok"))
    return one.union(each).select("policy", "rule", "head", "mode", F.when(F.col("ok"), "pass").otherwise("fail").alias("status"))


def checkpoint_faults(chain: DataFrame) -> DataFrame:
    """(head, sequence, fault) of checkpoints (head, sequence, hash, prev, leaves, prev_leaves): gaps, wrong links, a genesis that isn't first, logs that shrink."""
    w = Window.partitionBy("head").orderBy("sequence")
    seen = chain.withColumns({"before": F.lag("hash").over(w), "had": F.lag("leaves").over(w), "place": F.row_number().over(w) - 1})
    fault = (
        F.when(F.col("prev").isNull() != (F.col("sequence") == 0), "genesis")
        .when(F.col("sequence") != F.col("place"), "gap")
        .when(~F.col("prev").eqNullSafe(F.col("before")), "unlinked")
        .when(F.col("leaves") <= F.col("had"), "shrunk")
    )
    return seen.select("head", "sequence", fault.alias("fault")).where("fault is not null")


def audit_faults(records: DataFrame, manifests: DataFrame, carriers: DataFrame, frm: int, to: int) -> DataFrame:
    """(manifest, fault): what is wrong with a bundle of audit records, empty if nothing is.

    records: (manifest, head, commit, seq, prev, executed_at, principal, body), ``body`` what the record says of itself;
    manifests: (manifest, body) as the objects are, by the hash of which they are named; carriers: (commit, manifest)
    of commits that lead to the tip. Each rule is one query. A head's records may be very many: they are put in order by ranges.
    """
    r, m = records, manifests.select("manifest", F.col("body").alias("carried"))
    out = [r.where(~F.col("executed_at").between(frm, to)).select("manifest", F.lit("outside the period").alias("fault"))]
    joined = r.join(m, "manifest", "left")
    out.append(joined.where("carried is null").select("manifest", F.lit("manifest missing")))
    out.append(m.where(F.col("manifest") != digest("manifest", "carried")).select("manifest", F.lit("not what its hash says")))
    out.append(joined.where("carried is not null and not body <=> carried").select("manifest", F.lit("record differs")))
    out.append(r.join(carriers, ["commit", "manifest"], "left_anti").select("manifest", F.lit("not carried by its commit")))
    out.append(m.join(r, "manifest", "left_anti").select("manifest", F.lit("record withheld")))
    seen = numbered(r.select("head", "seq", "manifest", "prev"), "head", ["seq", "manifest"], "place", {"last": "seq", "before": "manifest"}).where("last is not null")
    out.append(seen.select("manifest", F.when(F.col("seq") == F.col("last"), "repeated").when(F.col("seq") != F.col("last") + 1, "gap").when(F.col("prev") != F.col("before"), "unlinked").alias("fault")).where("fault is not null"))
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every


def blob_hash(column: str):
    return digest("blob", column)
