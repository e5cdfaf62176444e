"""Tool calls and their results, linked, ordered and in canonical form.

* A call meets its result by the call's id. Of several calls with one id the first (by turn,
  then arguments) is the call, the others are ``duplicate``; likewise the first result counts and the
  others are counted. A call without a result is ``unanswered``, a result without a call ``orphan``.
* ``level`` orders calls topologically: 0 for a call that depends on none, else one more than the
  highest level of those it depends on. Chains are followed by doubling, calls that depend on several
  are solved in rounds; what is left is a ``cycle`` or depends on one, and has no level. An id that no call has counts as unknown, not as an edge.
* Arguments are parsed to a variant, checked against the tool's fields (present, type, smallest
  and largest value or length, no other fields), and written as canonical JSON: keys sorted, no blanks.

DataFrame operations only. Hot tools and hot calls are the larger side of joins with one row per key
on the other, which adaptive execution splits; nothing is gathered per conversation.

Edge cases: calls without an id are never linked and report ``no id``; null or broken arguments
report ``not JSON`` and have no canonical form; null results are results; a null or unlisted tool
reports ``unknown tool``; equal rows are duplicates of one call; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, measured_cut, release

#: Columns of the inputs. ``depends_on`` is an array of call ids.
CALLS = ["conv_id", "turn", "call_id", "tool", "arguments", "depends_on"]
RESULTS = ["conv_id", "turn", "call_id", "content"]
SCHEMAS = ["tool", "field", "type", "required", "least", "most"]


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and without blanks; null where the text is not JSON."""
    return F.to_json(F.try_parse_json(text))


def _content(text: Column) -> Column:
    """A result as canonical JSON; what is not JSON becomes an object with the field ``text``."""
    return F.coalesce(canonical_json(text), F.to_json(F.to_variant_object(F.struct(text.alias("text")))))


def fields_by_tool(schemas: DataFrame) -> DataFrame:
    """One row per tool with its fields; of a field listed twice the smallest row counts."""
    rows = schemas.filter("tool IS NOT NULL AND field IS NOT NULL").groupBy("tool", "field").agg(
        F.min(F.struct("type", "required", "least", "most")).alias("rule")
    )
    return rows.groupBy("tool").agg(F.sort_array(F.collect_list(F.struct("field", "rule"))).alias("fields"))


def errors(arguments: str, fields: str) -> Column:
    """What is wrong with a variant of arguments, as sorted texts: ``field: fault``."""
    return F.expr(f"""
        CASE WHEN {arguments} IS NULL THEN array('not JSON')
             WHEN schema_of_variant({arguments}) NOT LIKE 'OBJECT%' THEN array('not an object')
             WHEN {fields} IS NULL THEN array('unknown tool')
        ELSE array_sort(concat(
            filter(transform({fields}, f -> CASE
                WHEN NOT map_contains_key(CAST({arguments} AS MAP<STRING, VARIANT>), f.field)
                    THEN CASE WHEN f.rule.required THEN f.field || ': missing' END
                WHEN is_variant_null(CAST({arguments} AS MAP<STRING, VARIANT>)[f.field])
                    THEN CASE WHEN f.rule.required THEN f.field || ': null' END
                WHEN f.rule.type <> CASE
                        WHEN schema_of_variant(CAST({arguments} AS MAP<STRING, VARIANT>)[f.field]) = 'BIGINT' THEN 'integer'
                        WHEN schema_of_variant(CAST({arguments} AS MAP<STRING, VARIANT>)[f.field]) = 'STRING' THEN 'string'
                        WHEN schema_of_variant(CAST({arguments} AS MAP<STRING, VARIANT>)[f.field]) = 'BOOLEAN' THEN 'boolean'
                        WHEN schema_of_variant(CAST({arguments} AS MAP<STRING, VARIANT>)[f.field]) LIKE 'ARRAY%' THEN 'array'
                        WHEN schema_of_variant(CAST({arguments} AS MAP<STRING, VARIANT>)[f.field]) LIKE 'OBJECT%' THEN 'object'
                        ELSE 'number' END
                    AND NOT (f.rule.type = 'number' AND schema_of_variant(CAST({arguments} AS MAP<STRING, VARIANT>)[f.field]) = 'BIGINT')
                    THEN f.field || ': not ' || f.rule.type
                WHEN f.rule.type = 'string' AND NOT length(CAST(CAST({arguments} AS MAP<STRING, VARIANT>)[f.field] AS STRING))
                        BETWEEN coalesce(f.rule.least, 0) AND coalesce(f.rule.most, double('Infinity'))
                    THEN f.field || ': length'
                WHEN f.rule.type IN ('integer', 'number') AND NOT CAST(CAST({arguments} AS MAP<STRING, VARIANT>)[f.field] AS DOUBLE)
                        BETWEEN coalesce(f.rule.least, double('-Infinity')) AND coalesce(f.rule.most, double('Infinity'))
                    THEN f.field || ': range' END), e -> e IS NOT NULL),
            transform(filter(map_keys(CAST({arguments} AS MAP<STRING, VARIANT>)),
                k -> NOT exists({fields}, f -> f.field = k)), k -> k || ': not a field'))) END""")


def levels(calls: DataFrame) -> DataFrame:
    """``(call_id, level)`` of linked calls ``(call_id, depends_on)``; calls in a cycle, or behind
    one, are missing.

    Chains are followed by doubling: a call that depends on one other points to it, and in every
    round each pointer takes over the one it points to, until it ends at a call that depends on
    none or on several. Rounds grow with the logarithm of a chain's length. Calls that depend on
    several are then solved in rounds among themselves, each after those it leads to.
    """
    edges = cut(
        calls.select("call_id", F.explode("depends_on").alias("parent"))
        .distinct()
        .join(calls.select(F.col("call_id").alias("parent")), "parent", "left_semi"),
        "edges",
    )
    degree = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"))
    one = F.coalesce("n", F.lit(0)) == 1
    start = calls.select("call_id").join(degree, "call_id", "left").select(
        "call_id", F.when(one, F.col("parent")).otherwise(F.col("call_id")).alias("end"),
        one.cast("long").alias("steps"), (~one).alias("done"), F.coalesce("n", F.lit(0)).alias("n"),
    )
    paths, facts = measured_cut(start, "paths", all=F.count(F.lit(1)), open=F.count_if(~F.col("done")), several=F.count_if(F.col("n") > 1))
    several = facts["several"] or 0
    # a chain has fewer calls than there are; what is open after so many rounds is a cycle
    for _ in range((facts["all"] or 0).bit_length()):
        if not facts["open"]:
            break
        after = paths.select(F.col("call_id").alias("end"), F.col("end").alias("far"), F.col("steps").alias("more"), F.col("done").alias("far_done"))
        moved = paths.filter("NOT done").join(after, "end").select(
            "call_id", F.col("far").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), F.col("far_done").alias("done"), "n"
        )
        before = paths
        paths, facts = measured_cut(paths.filter("done").unionByName(moved), "paths", open=F.count_if(~F.col("done")))
        release(before)
    solved = paths.filter("n = 0").select(F.col("call_id").alias("end"), F.lit(0).cast("long").alias("level"))
    if several:
        ways = paths.filter("done").select(F.col("call_id").alias("parent"), "end", "steps")
        waiting = cut(
            edges.join(paths.filter("n > 1").select("call_id"), "call_id", "left_semi").join(ways, "parent", "left")
            .select("call_id", "end", (F.col("steps") + 1).alias("steps")),
            "waiting",
        )
        solved = cut(solved, "solved")
        while True:
            ready = (
                waiting.join(solved, "end", "left").groupBy("call_id")
                .agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("unknown"))
                .filter("unknown = 0")
            )
            ready, size = measured_cut(ready.select(F.col("call_id").alias("end"), "level"), "ready", n=F.count(F.lit(1)))
            if not size["n"]:
                break
            solved = solved.unionByName(ready)
            waiting = cut(waiting.join(ready.select(F.col("end").alias("call_id")), "call_id", "left_anti"), "waiting")
    return paths.filter("done").join(solved, "end").select("call_id", (F.col("level") + F.col("steps")).cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``(conv_id, call_id, turn, tool, level, status, n_results, errors, arguments, result)``: one row
    per call and one per result without a call. ``status`` is linked, unanswered, duplicate, cycle,
    no id or orphan; ``arguments`` and ``result`` are canonical JSON."""
    calls = calls.select(*CALLS)
    results = results.select(*RESULTS)
    place = F.struct("turn", "conv_id", "arguments", "tool", "depends_on")
    # one row per id: equal ids meet in an aggregate, with a count for the duplicates
    groups = calls.filter("call_id IS NOT NULL").groupBy("call_id")
    first = groups.agg(F.min(place).alias("c")).select("call_id", "c.*")
    first = cut(first.select(*CALLS), "calls")
    answers = (
        results.filter("call_id IS NOT NULL").groupBy("call_id")
        .agg(F.min(F.struct("turn", "conv_id", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    )
    parsed = F.try_parse_json("arguments")
    tools = fields_by_tool(schemas)
    linked = (
        first.join(answers, "call_id", "left")
        .join(levels(first.select("call_id", "depends_on")), "call_id", "left")
        .withColumn("status", F.when(F.col("level").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("linked"))
    )
    # calls that are not the first of their id
    again = (
        calls.filter("call_id IS NOT NULL")
        .groupBy(*CALLS).agg(F.count(F.lit(1)).alias("copies"))
        .join(first.select("call_id", F.struct(*[F.col(c) for c in ("turn", "conv_id", "arguments", "tool", "depends_on")]).alias("c")), "call_id")
        .withColumn("copies", F.col("copies") - place.eqNullSafe(F.col("c")).cast("int"))
        .filter("copies > 0")
        .select(*CALLS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_"))
        .select(*CALLS, F.lit("duplicate").alias("status"))
    )
    nameless = calls.filter("call_id IS NULL").withColumn("status", F.lit("no id"))
    every = linked.unionByName(again.unionByName(nameless), allowMissingColumns=True)
    checked = every.withColumn("parsed", parsed).join(tools, "tool", "left").select(
        "conv_id", "call_id", "turn", "tool", "level", "status", F.coalesce("n_results", F.lit(0)).alias("n_results"),
        errors("parsed", "fields").alias("errors"), F.to_json("parsed").alias("arguments"),
        F.when(F.col("r").isNotNull(), _content(F.col("r.content"))).alias("result"),
    )
    orphans = results.join(first.select("call_id"), "call_id", "left_anti").select(
        "conv_id", "call_id", "turn", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("int").alias("level"),
        F.lit("orphan").alias("status"), F.lit(1).cast("long").alias("n_results"), F.array().cast("array<string>").alias("errors"),
        F.lit(None).cast("string").alias("arguments"),
        _content(F.col("content")).alias("result"),
    )
    return checked.unionByName(orphans)
