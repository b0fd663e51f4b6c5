"""Event streams of agents: line-delimited JSON to the tool calls that can be observed.

Each agent names its fields in its own way; a call's fields are looked up at every place they may have. Reasoning and
echoes of prompts are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which events of an agent are tool calls.
ITEMS = ("command_execution", "mcp_tool_call", "web_search", "file_change")
KINDS = {
    "codex": ("item.started", "item.completed"), "pi": ("tool_execution_start", "tool_execution_update", "tool_execution_end"), "omp": ("tool_execution_start", "tool_execution_update", "tool_execution_end"),
    "cursor": ("tool_call",), "gemini": ("tool_use", "tool_result"), "opencode": ("tool_use",),
}
BLOCKS, UPDATES = ("tool_use", "tool_result"), ("tool_call", "tool_call_update")
ID_AT = ("item.id", "id", "tool_use_id", "toolCallId", "tool_id", "call_id", "part.callID")
COMMAND_AT = ("part.state.input.command", "rawInput.command", "parameters.command", "args.command", "input.command", "item.command")


def _at(event: Column | str, path: str) -> Column:
    return F.get_json_object(event, f"$.{path}")


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events: rows (ord, value) that are JSON objects; banners: those that aren't JSON). Empty lines go."""
    own = lines.filter(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))
    events = own.filter(F.schema_of_variant("_v").startswith("OBJECT")).drop("_v")
    return events, own.filter(F.col("_v").isNull()).drop("_v")


def observable(events: DataFrame, agent: str) -> DataFrame:
    """ord, value of the tool calls and results of an agent's events."""
    kind = _at("value", "type")
    if agent == "claude":
        parts = F.from_json(_at("value", "message.content"), "array<string>")
        blocks = events.select("ord", F.posexplode(parts).alias("_i", "value")).filter(_at("value", "type").isin(*BLOCKS) & ~F.coalesce(_at("value", "name") == "StructuredOutput", F.lit(False)))
        return blocks.select((F.col("ord") * 1000 + F.col("_i")).alias("ord"), "value")
    if agent == "codex":
        return events.filter(kind.isin(*KINDS[agent]) & _at("value", "item.type").isin(*ITEMS))
    if agent in KINDS:
        return events.filter(kind.isin(*KINDS[agent]))
    update = events.select("ord", _at("value", "params.update").alias("value"))
    return update.filter(_at("value", "sessionUpdate").isin(*UPDATES))


def commands(events: DataFrame) -> DataFrame:
    """call, command, output of the calls that ran a command; of several events the last that says something counts."""
    # a call under a name of its own: {"tool_call": {"shell": {"args": {"command": ...}, "result": ...}}}
    inner = F.filter(F.map_values(F.from_json(_at("value", "tool_call"), "map<string,string>")), lambda v: _at(v, "args.command").isNotNull())
    last = F.get(inner, F.size(inner) - 1)
    kind = _at("value", "type")
    output = (
        F.when(_at("value", "item.aggregated_output").isNotNull(), _at("value", "item.aggregated_output"))
        .when(kind == "tool_result", F.coalesce(_at("value", "content"), _at("value", "output")))
        .when(kind == "tool_execution_end", _at("value", "result"))
        .otherwise(F.coalesce(_at("value", "part.state.output"), _at("value", "rawOutput"), _at(last, "result")))
    )
    e = events.select(
        "ord", F.coalesce(*[_at("value", p) for p in ID_AT], F.concat(F.lit("#"), F.col("ord").cast("string"))).alias("call"),
        F.coalesce(_at(last, "args.command"), *[_at("value", p) for p in COMMAND_AT]).alias("command"), output.alias("output"),
    )
    said = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    return e.groupBy("call").agg(said("command"), said("output")).filter("command is not null")


def command_checks(required: DataFrame, ran: DataFrame) -> DataFrame:
    """required (id, fragments) with passed: some command that ran (command) has all fragments. Commands of one run are few."""
    every = ran.agg(F.collect_list("command").alias("_c"))
    has = F.exists("_c", lambda c: F.forall("fragments", lambda f: c.contains(f)))
    return required.crossJoin(F.broadcast(every)).withColumn("passed", has).drop("_c")  # one row
