"""Operator 6: chat formatting by tool-call linking, DataFrame operations only.

An assistant turn may hold calls as ``{"tool_calls": [{"id", "name", "arguments", "after"}]}`` and a tool
turn a result as ``{"tool_call_id", "content"}``. Calls and results are joined by conversation and
identifier; a result follows its call, and a call follows the calls named in its ``after``; arguments are
held against the tools' schemas; every turn, call and result becomes one line of canonical JSON (keys sorted, no
white space). The order is a key of numbers in each row, so a conversation, however long, is never
gathered: joins and counts are by (conversation, identifier).

Levels of ``after``: calls that follow one call form chains, which are followed by doubling jumps, so their rounds are the
logarithm of the longest chain; calls that follow several wait for the last of them, a round a level of such calls. Each
round writes only what it found. Calls in a cycle, or after one, get level -1 and the status ``cycle``.

Numbers in a line are written in full, without exponent or needless zeros; beyond a double's range they are the text "Infinity".

Defined results: a null text is the content null; null roles stay null; a text that is no JSON object, with or without blanks around it, is an
ordinary message, and so is a turn whose ``tool_calls`` is empty; content beside calls is a message before them, unless it is
null or missing, and stays the JSON value it is; a null or missing identifier links to nothing; of calls that repeat an identifier the first (by
turn and place) is linked and later ones have the status ``duplicate``; several results of a call are all
linked; a result without a call is an ``orphan``; repeated rows are kept, so a repeated row's calls are at the place of the first; an empty table gives an empty
result; arguments, results and contents of any length stay whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evokit.session import cut

#: Tools with their parameters: (type, required). Types: string, integer, number, boolean, array, object.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "read_file": {"path": ("string", True), "lines": ("array", False)},
    "weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
}
#: How Spark names a variant's type, by the type of a schema; integers are numbers without a fraction.
_TYPES = {"string": "^STRING$", "integer": "^(BIGINT|DOUBLE|DECIMAL.*)$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}
#: Strings, numbers and what is between them. Possessive and unrolled, so the matcher neither recurses nor steps back, however long a string is.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'


def _plain_number(t: Column) -> Column:
    """A JSON number as Spark writes it, in full: 1.0E-7 is 0.0000001 and 100.0 is 100."""
    mantissa = F.regexp_extract(t, r"^-?([0-9.]+)", 1)
    whole = F.substring_index(mantissa, ".", 1)
    part = F.rtrim(F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise(F.lit("")), F.lit("0"))
    power = F.coalesce(F.regexp_extract(t, r"E\+?(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits, point = F.concat(whole, part), F.length(whole) + power
    big = F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    between = F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))
    plain = F.when(digits.rlike("^0*$"), "0").when(point >= F.length(digits), big).when(point <= 0, small).otherwise(between)
    return F.concat(F.when((plain != "0") & t.startswith("-"), "-").otherwise(""), plain)


def _plain_numbers(json: Column) -> Column:
    """JSON with all its numbers in full; strings stay as they are."""
    tokens = F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9].*[.E]"), _plain_number(t)).otherwise(t)), "")


def _argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """The faults of a call's arguments, in order of the parameters' names, then those not in the schema."""
    out = None
    for tool, parameters in schemas.items():
        checks = []
        for p, (kind, required) in sorted(parameters.items()):
            value = F.try_variant_get(arguments, f"$.{p}", "variant")
            missing = F.lit(f"missing {p}") if required else F.lit(None).cast("string")
            fits = F.schema_of_variant(value).rlike(_TYPES[kind])
            if kind == "integer":
                fits = fits & ~_plain_numbers(F.to_json(value)).contains(".")
            checks.append(F.when(value.isNull(), missing).when(~fits, F.lit(f"{p} is no {kind}")))
        keys = F.map_keys(F.try_variant_get(arguments, "$", "map<string,variant>"))
        known = F.array(*(F.lit(p) for p in parameters)) if parameters else F.array().cast("array<string>")
        extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unknown "), k))
        found = F.array_compact(F.concat(F.array(*checks) if checks else F.array().cast("array<string>"), F.coalesce(extra, F.array().cast("array<string>"))))
        shape = F.when(~F.coalesce(F.schema_of_variant(arguments), F.lit("")).startswith("OBJECT"), F.array(F.lit("arguments are no object"))).otherwise(found)
        out = F.when(name == tool, shape) if out is None else out.when(name == tool, shape)
    unknown = F.array(F.lit("unknown tool"))
    return F.array_join(out.otherwise(unknown) if out is not None else unknown, "; ")


def _canonical(**fields: Column) -> Column:
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def _chains(single: DataFrame) -> DataFrame:
    """(conv, id, at, far): where the chain that a call ends begins, and how many calls before.

    ``single`` has (conv, id, need), a call and the one it follows. Each round doubles the jumps; after as many rounds as the
    number of calls has binary digits, only calls in or after a cycle still stand on a call that follows another.
    """
    jumps = cut(single.select("conv", "id", F.col("need").alias("at"), F.lit(1).cast("long").alias("far")))
    for _ in range(single.count().bit_length()):
        there = jumps.select("conv", F.col("id").alias("at"), F.col("at").alias("to"), F.col("far").alias("more"))
        if not jumps.join(there, ["conv", "at"], "left_semi").limit(1).count():
            break
        both = jumps.join(there, ["conv", "at"], "left")
        jumps = cut(both.select("conv", "id", F.coalesce("to", "at").alias("at"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
    return jumps


def _levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level) of linked calls: 0 without predecessors, else one more than the greatest of them, -1 in cycles."""
    needs = calls.select("conv", "id", F.explode("after").alias("need")).where("need is not null").distinct()
    needs = cut(needs.join(calls.select("conv", F.col("id").alias("need")), ["conv", "need"], "left_semi"))
    counts = needs.groupBy("conv", "id").agg(F.count("*").alias("k"), F.min("need").alias("need"))
    roots = calls.join(counts, ["conv", "id"], "left_anti").select("conv", "id", F.lit(0).cast("long").alias("level"))
    if not needs.limit(1).count():
        return roots
    chains = _chains(counts.where("k = 1"))
    # What a call with several predecessors waits for: roots and other such calls, at a distance.
    to = chains.select("conv", F.col("id").alias("need"), "at", "far")
    waits = needs.join(counts.where("k > 1").select("conv", "id"), ["conv", "id"], "left_semi").join(to, ["conv", "need"], "left")
    waits = cut(waits.groupBy("conv", "id", F.coalesce("at", "need").alias("at")).agg((F.max(F.coalesce("far", F.lit(0))) + 1).alias("far")))
    known = cut(roots)
    while True:
        left = waits.join(known, ["conv", "id"], "left_anti").join(known.select("conv", F.col("id").alias("at"), "level"), ["conv", "at"], "left")
        ready = left.groupBy("conv", "id").agg(F.count("*").alias("n"), F.count("level").alias("k"), F.max(F.col("level") + F.col("far")).alias("level")).where("n = k")
        new = cut(ready.select("conv", "id", "level"))
        if not new.limit(1).count():
            break
        known = known.unionByName(new)
    starts = known.select("conv", F.col("id").alias("at"), "level")
    ends = chains.join(starts, ["conv", "at"], "left").select("conv", "id", F.coalesce(F.col("level") + F.col("far"), F.lit(-1)).alias("level"))
    stuck = waits.select("conv", "id").distinct().join(known, ["conv", "id"], "left_anti").select("conv", "id", F.lit(-1).cast("long").alias("level"))
    return cut(known.unionByName(ends).unionByName(stuck).withColumn("level", F.col("level").cast("int")))


def format_chats(turns: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, pos_turn, pos_level, pos_call, pos_kind, status, errors, line).

    Sorting a conversation by the pos columns (then turn) puts calls in topological order, each with its results.
    """
    schemas = SCHEMAS if schemas is None else schemas
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    parsed = F.when(F.col("text").rlike(r"^[ \t\r\n]*\{"), F.try_parse_json("text"))
    is_call = F.coalesce((F.col("role") == "assistant") & (F.size(F.try_variant_get(parsed, "$.tool_calls", "array<variant>")) > 0), F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & F.try_variant_get(parsed, "$.tool_call_id", "string").isNotNull(), F.lit(False))

    def messages(of: DataFrame, line: Column) -> DataFrame:
        return of.select("conv", "turn", F.col("turn").alias("pos_turn"), F.lit(0).alias("pos_level"), F.lit(0).alias("pos_call"), F.lit(0).alias("pos_kind"), F.lit("message").alias("status"), F.lit("").alias("errors"), line.alias("line"))

    line = _canonical(content=F.col("text"), conv_id=F.col("conv"), role=F.col("role"), turn=F.col("turn"))
    plain = messages(rows.where(~is_call & ~is_result), line)
    beside = rows.where(is_call).withColumn("content", F.try_variant_get(F.try_parse_json("text"), "$.content", "variant")).where(F.col("content").isNotNull() & ~F.is_variant_null("content"))
    line = _canonical(content=F.col("content"), conv_id=F.col("conv"), role=F.col("role"), turn=F.col("turn"))
    beside = messages(beside, _plain_numbers(line))

    spread = rows.where(is_call).select("conv", "turn", F.posexplode(F.try_variant_get(F.try_parse_json("text"), "$.tool_calls", "array<variant>")).alias("place", "c"))
    calls = spread.select(
        "conv", "turn", "place", F.try_variant_get("c", "$.id", "string").alias("id"), F.try_variant_get("c", "$.name", "string").alias("name"),
        F.try_variant_get("c", "$.arguments", "variant").alias("arguments"), F.coalesce(F.try_variant_get("c", "$.after", "array<string>"), F.array().cast("array<string>")).alias("after"),
    )
    first = cut(calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "place")).alias("at"), F.min_by("after", F.struct("turn", "place")).alias("after")))
    level = _levels(first)
    answers = rows.where(is_result).select("conv", "turn", F.try_variant_get(F.try_parse_json("text"), "$.tool_call_id", "string").alias("id"), F.try_variant_get(F.try_parse_json("text"), "$.content", "variant").alias("content"))
    answered = answers.select("conv", "id").distinct().withColumn("answered", F.lit(True))

    # A call's line and errors are made before the joins, which then carry no values to be parsed.
    line = _canonical(arguments=F.col("arguments"), conv_id=F.col("conv"), id=F.col("id"), name=F.col("name"), role=F.lit("call"), turn=F.col("turn"))
    calls = calls.select("conv", "turn", "place", "id", _argument_errors(F.col("name"), F.col("arguments"), schemas).alias("errors"), _plain_numbers(line).alias("line"))
    linked = calls.join(first.select("conv", "id", "at"), ["conv", "id"], "left").join(level, ["conv", "id"], "left").join(answered, ["conv", "id"], "left")
    original = F.coalesce((F.col("at.turn") == F.col("turn")) & (F.col("at.place") == F.col("place")), F.lit(False))
    status = F.when(F.col("id").isNull(), "unlinked").when(~original, "duplicate").when(F.col("level") < 0, "cycle").when(F.coalesce("answered", F.lit(False)), "linked").otherwise("unanswered")
    call_rows = linked.select("conv", "turn", F.col("turn").alias("pos_turn"), F.coalesce("level", F.lit(0)).alias("pos_level"), F.col("place").alias("pos_call"), F.lit(1).alias("pos_kind"), status.alias("status"), "errors", "line")
    line = _canonical(content=F.col("content"), conv_id=F.col("conv"), id=F.col("id"), role=F.lit("tool"), turn=F.col("turn"))
    answers = answers.select("conv", "turn", "id", _plain_numbers(line).alias("line"))
    back = answers.join(first.select("conv", "id", "at"), ["conv", "id"], "left").join(level, ["conv", "id"], "left")
    result_rows = back.select(
        "conv", "turn", F.coalesce("at.turn", "turn").alias("pos_turn"), F.coalesce("level", F.lit(0)).alias("pos_level"), F.coalesce("at.place", F.lit(0)).alias("pos_call"), F.lit(2).alias("pos_kind"),
        F.when(F.col("at").isNull(), "orphan").otherwise("result").alias("status"), F.lit("").alias("errors"), "line",
    )
    out = plain.unionByName(beside).unionByName(call_rows).unionByName(result_rows)
    return out.withColumnsRenamed({"conv": conv_col, "turn": turn_col})
