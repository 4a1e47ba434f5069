"""Chat formatting with linked tool calls: one canonical JSON line per event, in an order in which calls come before what
depends on them.

Messages are parsed where they lie. An assistant's text may be a JSON object with ``tool_calls`` (id, name, arguments,
depends_on), a tool's text one with ``tool_call_id``, and a system's text one with ``tools`` (name, parameters). Calls and
results are hash-joined by conversation and identifier, so a conversation of any length is never gathered.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.llm.common import match_rows
from cardlens.session import cut_lineage

KINDS = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict, "null": type(None)}
EVENT = "kind string, seq int, call_id string, name string, body string, needs array<string>"


def canonical(value) -> str:
    """Sorted keys, no blanks, text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _object(text: str | None) -> dict:
    if not text or not text.lstrip().startswith("{"):
        return {}
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def events(role: str | None, text: str | None) -> list[tuple]:
    """What a message says: (kind, seq, call id, name, canonical body, needed call ids)."""
    said = _object(text) if role in ("assistant", "tool", "system") else {}
    text_of = lambda x: x if isinstance(x, str) or x is None else canonical(x)
    if role == "tool" and isinstance(said.get("tool_call_id"), str):
        return [("result", 0, said["tool_call_id"], None, canonical(said.get("content")), [])]
    if role == "assistant" and isinstance(said.get("tool_calls"), list):
        out = [("message", 0, None, None, canonical({"content": text_of(said.get("content")), "role": role}), [])] if said.get("content") is not None else []
        for seq, call in enumerate(c for c in said["tool_calls"] if isinstance(c, dict)):
            arguments = call.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = json.loads(arguments)
                except (ValueError, RecursionError):
                    pass
            needs = call.get("depends_on")
            out.append(("call", seq, text_of(call.get("id")), text_of(call.get("name")), canonical(arguments),
                        sorted({n for n in needs if isinstance(n, str)}) if isinstance(needs, list) else []))
        return out
    if role == "system" and isinstance(said.get("tools"), list):
        tools = [("tool", seq, None, t.get("name"), canonical(t.get("parameters")), []) for seq, t in enumerate(said["tools"])
                 if isinstance(t, dict) and isinstance(t.get("name"), str)]
        return [("message", 0, None, None, canonical({"content": text, "role": role}), []), *tools]
    return [("message", 0, None, None, canonical({"content": text, "role": role}), [])]


def faults(arguments: str | None, schema: str | None) -> str:
    """Why arguments don't fit a schema (object properties with types and enums, required, additionalProperties): comma-joined."""
    if schema is None:
        return "unknown tool"
    given, wanted = json.loads(arguments or "null"), json.loads(schema)
    if not isinstance(given, dict):
        return "not an object"
    wanted = wanted if isinstance(wanted, dict) else {}
    properties = wanted.get("properties") if isinstance(wanted.get("properties"), dict) else {}
    required = wanted.get("required") if isinstance(wanted.get("required"), list) else []
    found = [f"missing {k}" for k in required if k not in given]
    for key, value in given.items():
        rule = properties.get(key)
        if not isinstance(rule, dict):
            if wanted.get("additionalProperties") is False:
                found.append(f"unexpected {key}")
            continue
        kind = KINDS.get(rule.get("type")) if isinstance(rule.get("type"), str) else None
        if kind and (not isinstance(value, kind) or isinstance(value, bool) and rule["type"] in ("number", "integer")):
            found.append(f"type of {key}")
        if isinstance(rule.get("enum"), list) and value not in rule["enum"]:
            found.append(f"value of {key}")
    return ",".join(sorted(found))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level, at): calls by depth of what they need, and the first turn at which all of it is there.

    Each round settles the calls all of whose needs are settled; calls in a circle, or behind one, keep no level. Needs
    that name no call of the conversation don't count. Rounds are as many as the longest chain.
    """
    key = ["conv", "call_id"]
    known = calls.select(*key)
    needs = calls.select(*key, F.explode("needs").alias("need")).distinct()
    edges = match_rows(needs, known.select("conv", F.col("call_id").alias("need"), F.lit(True).alias("_there")), ["conv", "need"]).where(
        "_there").drop("_there")
    edges = cut_lineage(edges)
    done = calls.select(*key, F.lit(0).alias("level"), F.col("turn").alias("at"))
    waiting = edges.select(*key).distinct().withColumn("_wait", F.lit(True))
    if not edges.limit(1).count():
        return done
    own = calls.select(*key, "turn")
    done = cut_lineage(match_rows(done, waiting, key).where("_wait is null").drop("_wait"))
    while True:
        settled = done.select("conv", F.col("call_id").alias("need"), "level", "at")
        open_ = match_rows(edges, done.select(*key, F.lit(True).alias("_done")), key).where("_done is null").drop("_done")
        ready = match_rows(open_, settled, ["conv", "need"]).groupBy(*key).agg(
            F.count_if(F.col("level").isNull()).alias("_left"), F.max("level").alias("level"), F.max("at").alias("at")).where("_left = 0")
        new = cut_lineage(match_rows(ready, own, key).select(*key, (F.col("level") + 1).alias("level"), F.greatest("at", "turn").alias("at")))
        if not new.limit(1).count():
            return done
        done = cut_lineage(done.unionByName(new))


def link(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per event: conv_id, at, level, seq, part, turn, kind, call_id, status, line.

    Ordered by (at, level, seq, part, turn) a conversation reads with each call after all it depends on and each result
    after its call. ``kind`` is message, call or result. ``line`` is canonical JSON. Status of a call: ok, the faults of its
    arguments, ``repeated`` (a later call with a used identifier), ``no id``, or ``circular``; ``unanswered`` is added where
    no result came. Status of a result: ok, ``repeated`` (not the first for its call) or ``orphan`` (no call, or an earlier
    turn than it). Tools are those that system messages of the conversation name, the first of a name. A NULL conversation
    is one of its own; NULL turns come first; NULL texts are messages with null content; texts that are no JSON objects
    are plain messages; repeated rows are messages of their own; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "turn", "kind", "seq", "call_id", "name", "body", "needs"]
        for batch in batches:
            rows, owner = [], []
            for i, (role, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for event in events(role, text):
                    owner.append(i)
                    rows.append(event)
            at = pa.array(owner, pa.int32())
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            columns = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=names)

    kind = dict(conversations.dtypes)[conv_col]
    said = cut_lineage(conversations.select(F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"),
                                            F.col(role_col).alias("r"), F.col(text_col).alias("x")).mapInArrow(
        run, f"conv {kind}, turn long, {EVENT}").withColumn("uid", F.monotonically_increasing_id()))  # fixed by the checkpoint
    calls, results = said.where("kind = 'call'"), said.where("kind = 'result'")
    key = ["conv", "call_id"]
    first = calls.where("call_id is not null").groupBy(*key).agg(
        F.min_by(F.struct("turn", "seq", "name", "body", "needs", "uid"), F.struct("turn", "seq", "body", "uid")).alias("c")).select(*key, "c.*")
    first = cut_lineage(first)
    levels = _levels(first)
    schemas = said.where("kind = 'tool'").groupBy("conv", "name").agg(F.min_by("body", F.struct("turn", "seq", "body")).alias("schema"))
    replies = results.groupBy(*key).agg(F.min(F.struct("turn", "body", "uid")).alias("reply"))

    @F.pandas_udf("string")
    def check(arguments, schema):
        return arguments.combine(schema, lambda a, s: faults(a, s))

    @F.pandas_udf("string")
    def write(part, call_id, name, body):
        import pandas as pd

        def one(p, i, n, b):
            if p == 0:
                return canonical({"arguments": json.loads(b), "id": i, "name": n, "role": "call"})
            return canonical({"content": json.loads(b), "id": i, "role": "result"})

        return pd.Series([one(*x) for x in zip(part, call_id, name, body)], dtype=object)

    used = match_rows(match_rows(first, levels.select(*key, "level", "at"), key), schemas, ["conv", "name"])
    used = match_rows(used, replies.select(*key, (F.col("reply.turn")).alias("_answered")), key)
    fault = check(F.col("body"), F.col("schema"))
    good = F.when(F.col("level").isNull(), "circular").when(F.col("_fault") != "", F.col("_fault")).otherwise("ok")
    silent = F.col("_answered").isNull() | (F.col("_answered") < F.col("turn"))
    linked = used.withColumn("_fault", fault).select(
        *key, F.col("turn").alias("_turn"), F.col("seq").alias("_seq"), F.col("uid").alias("_uid"), F.col("level").alias("_level"), F.coalesce("at", "turn").alias("_at"),
        F.concat(good, F.when(silent, ",unanswered").otherwise("")).alias("_status"))
    placed = match_rows(calls, linked, key)
    own = F.col("uid") == F.col("_uid")
    call_rows = placed.select(
        "conv", F.when(own, F.col("_at")).otherwise(F.col("turn")).alias("at"), F.when(own, F.coalesce("_level", F.lit(0))).otherwise(0).alias("level"),
        "seq", F.lit(0).alias("part"), "turn", "kind", "call_id",
        F.when(F.col("call_id").isNull(), "no id").when(own, F.col("_status")).otherwise("repeated").alias("status"),
        write(F.lit(0), F.col("call_id"), F.col("name"), F.col("body")).alias("line"))
    answered = match_rows(match_rows(results, linked, key), replies, key)
    orphan = F.col("_turn").isNull() | (F.col("_turn") > F.col("turn"))
    best = F.col("reply.uid") == F.col("uid")
    result_rows = answered.select(
        "conv", F.when(orphan, F.col("turn")).otherwise(F.greatest("_at", "_turn")).alias("at"), F.when(orphan, 0).otherwise(F.coalesce("_level", F.lit(0))).alias("level"),
        F.when(orphan, F.col("seq")).otherwise(F.col("_seq")).alias("seq"), F.lit(1).alias("part"), "turn", "kind", "call_id",
        F.when(orphan, "orphan").when(best, "ok").otherwise("repeated").alias("status"),
        write(F.lit(1), F.col("call_id"), F.lit(None).cast("string"), F.col("body")).alias("line"))
    messages = said.where("kind = 'message'").select(
        "conv", F.col("turn").alias("at"), F.lit(-1).alias("level"), "seq", F.lit(0).alias("part"), "turn", "kind",
        F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), F.col("body").alias("line"))
    return messages.unionByName(call_rows).unionByName(result_rows).withColumnRenamed("conv", conv_col)

