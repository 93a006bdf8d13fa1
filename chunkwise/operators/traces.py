"""Agent traces: pairing tool calls with tool returns, usage, and retrieved context.

Rules, in the order of a run's parts: a return whose call id names an earlier
call of its run fills that call (the latest one with that id); any other return
fills the most recent call of its tool that has no result at that moment; the
last return that reaches a call gives its result.

Named returns are an equi-join.  The other rule depends on the order of all
events of a run and tool: calls open, returns close the latest open call, named
returns close (or, without a result, open again) a call of their own.  The
events are walked in stretches of ``STRETCH`` places, many of one run in
parallel: inside a stretch its own open calls are the latest ones whatever came
before, so only returns that find none of them open, and named returns to earlier
calls, are left over, together with the calls still open at its end.  What is left
over is walked again in ``FAN`` times longer stretches, until one covers a run.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwise.operators.render import CALL_SEPARATOR
from chunkwise.session import cut_lineage

STRETCH, FAN = 1 << 16, 16
OPEN, LOOSE, NAMED, FILL = range(4)
EVENT_SCHEMA = "run_id long, tool_name string, time long, what int, call long, empty boolean, content string"


def args_columns(args: Column) -> tuple[Column, Column]:
    """(args_json, args_kind): JSON text in canonical form, other text as ``{"raw": text}``, null as ``{}``."""
    parsed = F.try_parse_json(args)
    as_json = F.when(args.isNull(), F.lit("{}")).when(parsed.isNotNull(), F.to_json(parsed)).otherwise(
        F.to_json(F.struct(args.alias("raw")))
    )
    kind = F.when(args.isNull(), F.lit("empty")).when(parsed.isNotNull(), F.lit("json")).otherwise(F.lit("raw"))
    return as_json, kind


def _walker(size: int, last: bool):
    """Walks events that come grouped by (run, tool, stretch) and in order of time.

    Returns FILL events (a return at ``time`` that reaches ``call``) and, unless
    ``last``, what is left over.  Holds the calls of one stretch.
    """

    def walk(batches):
        group, waiting, opened = None, [], {}  # opened: call -> when it was opened last; None once closed

        def left_over(of) -> list[tuple]:
            return [] if last or of is None else [(of[0], of[1], at, OPEN, call, False, None) for call, at in opened.items() if at is not None]

        for pdf in batches:
            out = []
            for run, tool, stretch, time, what, call, empty, content in zip(*(pdf[c] for c in ("run_id", "tool_name", "stretch", "time", "what", "call", "empty", "content"))):
                if (run, tool, stretch) != group:
                    out += left_over(group)
                    group, waiting, opened = (run, tool, stretch), [], {}
                if what == LOOSE:
                    while waiting and opened[-waiting[0]] is None:
                        heapq.heappop(waiting)
                    if waiting:
                        out.append((run, tool, time, FILL, -waiting[0], empty, content))
                        if not empty:
                            opened[-waiting[0]] = None
                    elif not last:
                        out.append((run, tool, time, LOOSE, None, empty, content))
                    continue
                call = int(call)
                if what == NAMED and not last and call < stretch * size:  # of a call before this stretch
                    out.append((run, tool, time, NAMED, call, empty, None))
                elif what == OPEN or empty:
                    if opened.get(call) is None:
                        opened[call] = time
                        heapq.heappush(waiting, -call)
                else:
                    opened[call] = None
            if out:  # an empty frame has untyped columns
                yield pd.DataFrame(out, columns=["run_id", "tool_name", "time", "what", "call", "empty", "content"]).astype({"call": "Int64"})
        rest = left_over(group)
        if rest:
            yield pd.DataFrame(rest, columns=["run_id", "tool_name", "time", "what", "call", "empty", "content"])

    return walk


def _walked(events: DataFrame, stretch: int, last: bool) -> DataFrame:
    dealt = events.withColumn("stretch", F.lit(0).cast("long") if last else F.floor(F.col("time") / stretch).cast("long"))
    # at one time, an event that was left over keeps its place: there is one event a place
    ordered = dealt.repartition("run_id", "tool_name", "stretch").sortWithinPartitions("run_id", "tool_name", "stretch", "time")
    return ordered.mapInPandas(_walker(stretch, last), EVENT_SCHEMA)


def loose_fills(events: DataFrame) -> DataFrame:
    """(run_id, call_seq, return_seq, content) of all loose returns; ``events`` as in EVENT_SCHEMA, one per run and time."""
    span = events.agg(F.max("time").alias("high"), F.min("time").alias("low")).first()
    size, fills = STRETCH, []
    whole = span.high is None or (span.low >= 0 and span.high < size)
    while not whole:
        events = cut_lineage(_walked(events, size, False))
        fills.append(events.where(F.col("what") == FILL))
        events = events.where(F.col("what") != FILL)
        whole, size = span.high - span.low < size, size * FAN
    fills.append(_walked(events, size, True))
    every = fills[0]
    for f in fills[1:]:
        every = every.unionByName(f)
    return every.select("run_id", F.col("call").alias("call_seq"), F.col("time").alias("return_seq"), "content")


def pair_tool_calls(parts: DataFrame) -> DataFrame:
    """One row per tool call with its result (NULL when no return reached it).

    ``parts``: (run_id, seq, part_kind 'tool-call'|'tool-return', tool_name,
    tool_call_id, args, content).
    """
    cols = parts.select("run_id", "seq", "part_kind", "tool_name", "tool_call_id", "args", "content")
    calls = cols.where("part_kind = 'tool-call'")
    rets = cols.where("part_kind = 'tool-return'").select("run_id", "seq", "tool_name", "tool_call_id", "content")
    names = calls.where("tool_call_id <> ''").select(
        "run_id", "tool_call_id", F.col("seq").alias("call_seq"), F.col("tool_name").alias("call_tool")
    )
    aimed = rets.where("tool_call_id <> ''").join(names, ["run_id", "tool_call_id"]).where("call_seq < seq")
    named = aimed.groupBy("run_id", "seq").agg(
        F.max(F.struct("call_seq", "call_tool")).alias("to"), F.first("content").alias("content")
    ).select("run_id", "seq", F.col("to.call_seq").alias("target"), F.col("to.call_tool").alias("tool_name"), "content")
    named = cut_lineage(named)
    loose = rets.join(named.select("run_id", "seq"), ["run_id", "seq"], "left_anti")

    def events(rows: DataFrame, what: int, call: str, content: str) -> DataFrame:
        return rows.select(
            "run_id", "tool_name", F.col("seq").cast("long").alias("time"), F.lit(what).alias("what"), F.expr(call).cast("long").alias("call"),
            F.col("content").isNull().alias("empty"), F.expr(content).cast("string").alias("content"),
        )

    stream = events(calls, OPEN, "seq", "NULL").unionByName(events(loose, LOOSE, "NULL", "content")).unionByName(events(named, NAMED, "target", "NULL"))
    direct = named.select("run_id", F.col("target").alias("call_seq"), F.col("seq").alias("return_seq"), "content")
    fills = direct.unionByName(loose_fills(stream))
    last = fills.groupBy("run_id", "call_seq").agg(F.max(F.struct("return_seq", "content")).alias("r"))
    args_json, args_kind = args_columns(F.col("args"))
    return calls.withColumnRenamed("seq", "call_seq").join(last, ["run_id", "call_seq"], "left").select(
        "run_id", "call_seq", "tool_name", "tool_call_id", args_json.alias("args_json"), args_kind.alias("args_kind"),
        F.col("r.content").alias("result"), F.col("r.return_seq").alias("return_seq"),
    )


def retrieved_context(pairs: DataFrame, tool: str = "retrieve_contracts") -> DataFrame:
    """Per run: results of ``tool`` calls that returned something, in call order, joined by ``\\n\\n---\\n\\n``."""
    kept = pairs.filter((F.col("tool_name") == tool) & F.col("result").isNotNull() & (F.col("result") != ""))
    return kept.groupBy("run_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("call_seq", "result"))), lambda s: s["result"]),
            CALL_SEPARATOR,
        ).alias("retrieved_context"),
        F.count("*").alias("n_results"),
    )


def usage(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per run: input/output/total tokens, requests (at least 1) and number of tool calls.

    ``messages``: (run_id, role, input_tokens, output_tokens) per model message.
    """
    tok = messages.groupBy("run_id").agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.count_if(F.col("role") == "assistant").alias("requests"),
    )
    calls = pairs.groupBy("run_id").agg(F.count("*").alias("tool_calls_count"))
    out = tok.join(calls, "run_id", "left")
    return out.select(
        "run_id", "input_tokens", "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.when(F.col("requests") > 0, F.col("requests")).otherwise(F.lit(1)).cast("long").alias("requests"),
        F.coalesce(F.col("tool_calls_count"), F.lit(0)).cast("long").alias("tool_calls_count"),
    )
