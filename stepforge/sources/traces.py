"""Trace documents, OTLP exports, session logs, journals and envelopes as runs and steps.

A document is a row of (path, text). Each reader gives drafts of steps, which assemble() orders, rows of runs, and the
documents that it refuses, whole and with the reason: a record with a part left out would look like evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.analyze import assemble
from ..schema import STEP_TYPES, Wire

#: Fixed values of cached tokens: what they cost beside the price of input.
READ, WRITE_5M, WRITE_1H = 0.1, 1.25, 2.0


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Rows (file, modified, line, raw) of all lines under a folder; line numbers count from 1, blank lines too.

    Files are read in splits of any size. Lines are numbered within their split, and from how many the splits before it have, so that one
    large file is spread over as many tasks as it has splits.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    placed = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    sizes = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = placed.withColumn("own", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    return own.join(before, ["file", "block"]).select("file", "modified", (F.col("before") + F.col("own")).cast("int").alias("line"), "raw")


def member(json: Column, path: str) -> Column:
    """JSON text of a member: null where it is absent, `null` where it is a present null."""
    return F.to_json(F.variant_get(F.try_parse_json(json), path, "variant"))


def with_format(docs: DataFrame) -> DataFrame:
    """`format`: otlp with a list of resourceSpans, else native with a list of steps and an id, else null."""
    array = lambda m: F.schema_of_variant(F.variant_get(F.try_parse_json("text"), f"$.{m}", "variant")).startswith("ARRAY")
    return docs.withColumn("format", F.when(array("resourceSpans"), "otlp").when(array("steps") & member(F.col("text"), "$.id").isNotNull(), "native"))


NATIVE = "struct<id:string,name:string,currency:string,status:string,steps:array<string>>"
NATIVE_STEP = "struct<type:string,label:string,startedAt:string,durationMs:double,tokens:double,cost:double,toolName:string,input:string,output:string,dataPayload:string,spanId:string,parentSpanId:string>"


def raw_member(raw: Column, name: str) -> Column:
    """The JSON text of a top-level payload; strings keep their quotes."""
    return member(raw, f"$.{name}")


def kind_of(value: Column, name: str) -> Column:
    """The kind of a variant's member: null where it is absent, VOID where it is a present null."""
    return F.schema_of_variant(F.variant_get(value, f"$.{name}", "variant"))


def first_fault(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that doesn't hold, or null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])


def native_fault(text: Column) -> Column:
    """Where a native document breaks its schema, as `steps[2].type`; null for a sound one."""
    doc = F.try_parse_json(text)
    text_ = lambda v, n: kind_of(v, n) == "STRING"
    maybe = lambda v, n: kind_of(v, n).isNull() | text_(v, n)
    number = lambda v, n: kind_of(v, n).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)") & (F.try_variant_get(v, f"$.{n}", "double") >= 0)
    get = lambda v, n: F.try_variant_get(v, f"$.{n}", "string")

    def step(v: Column, i: Column) -> Column:
        checks = [("type", text_(v, "type") & get(v, "type").isin(*STEP_TYPES)), ("label", text_(v, "label")), ("startedAt", text_(v, "startedAt")), ("durationMs", number(v, "durationMs"))]
        checks += [(n, kind_of(v, n).isNull() | number(v, n)) for n in ("tokens", "cost")] + [(n, maybe(v, n)) for n in ("toolName", "spanId", "parentSpanId")]
        return F.concat(F.lit("steps["), i.cast("string"), F.lit("]."), first_fault(checks))

    head = first_fault([("id", text_(doc, "id") & (F.length(get(doc, "id")) > 0)), ("name", text_(doc, "name")), ("currency", maybe(doc, "currency")), ("status", kind_of(doc, "status").isNull() | text_(doc, "status") & get(doc, "status").isin("completed", "failed")), ("steps", kind_of(doc, "steps").startswith("ARRAY"))])
    steps = F.coalesce(F.try_variant_get(doc, "$.steps", "array<variant>"), F.array().cast("array<variant>"))
    return F.coalesce(head, F.try_element_at(F.filter(F.transform(steps, step), lambda x: x.isNotNull()), F.lit(1)))


def one_each(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, refused): of documents (path, run_id, ...) that name the same run, the first by path stays."""
    again = docs.groupBy("run_id").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("run_id").alias("again"), "first")
    found = docs.join(again, F.col("run_id") == F.col("again"), "left")
    late = F.col("first").isNotNull() & (F.col("path") != F.col("first"))
    return found.where(~late).drop("again", "first"), found.where(late).select("path", "run_id", F.concat(F.lit("the run is in "), "first").alias("reason"))


def native(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, steps, refused) of native documents. A document that breaks the schema anywhere is refused as a whole."""
    doc = docs.withColumn("fault", native_fault(F.col("text"))).withColumn("d", F.from_json("text", NATIVE)).withColumn("run_id", F.col("d.id"))
    wrong = doc.where("fault is not null").select("path", "run_id", F.col("fault").alias("reason"))
    doc, late = one_each(doc.where("fault is null").select("path", "run_id", "d"))
    runs = doc.select("run_id", F.col("d.name").alias("name"), F.coalesce("d.currency", F.lit("USD")).alias("currency"), F.col("d.status").alias("declared"))
    one = doc.select("run_id", F.posexplode("d.steps").alias("ord", "raw")).withColumn("s", F.from_json("raw", NATIVE_STEP))
    zero = F.lit(0.0)
    drafts = one.select(
        "run_id", "ord", F.col("s.type").alias("type"), F.col("s.label").alias("label"), F.col("s.startedAt").alias("started_at"), F.col("s.durationMs").alias("duration_ms"),
        F.coalesce("s.tokens", zero).alias("tokens"), F.coalesce("s.cost", zero).alias("cost"), F.col("s.toolName").alias("tool_name"), raw_member(F.col("raw"), "input").alias("input"), raw_member(F.col("raw"), "output").alias("output"),
        raw_member(F.col("raw"), "dataPayload").alias("data_payload"), F.coalesce("s.spanId", F.concat("run_id", F.lit("-span-"), F.col("ord").cast("string"))).alias("span_id"), F.col("s.parentSpanId").alias("parent_span_id"),
    )
    return runs, assemble(drafts).withColumn("pos", F.col("index")), wrong.unionByName(late)


VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
OTLP = f"struct<resourceSpans:array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeSpans:array<struct<spans:array<struct<spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRIBUTES},status:struct<code:int>>>>>>>>"


def said(attrs: Column) -> Column:
    """Attributes as (key, text): a string before an integer, a double and a boolean."""
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return F.transform(attrs, lambda a: F.struct(a["key"].alias("key"), text(a["value"]).alias("text")))


def last_said(pairs: Column, key: str) -> Column:
    """The text of the last attribute with a key, of said()."""
    return F.try_element_at(F.filter(pairs, lambda a: a["key"] == key), F.lit(-1))["text"]


def attribute(attrs: Column, key: str) -> Column:
    """The text of the last attribute with a key."""
    return last_said(said(attrs), key)


def maybe_json(x: Column) -> Column:
    """JSON text as it is if it reads as an object or array; any other text as a JSON string."""
    quoted = F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)\A\{"x":(.*)\}\z', 1)
    return F.when(x.isNull(), None).when(x.rlike(rf"\A{tx.SPACE}*[\[{{]") & F.try_parse_json(x).isNotNull(), tx.trimmed(x)).otherwise(quoted)


def step_type(explicit: Column, tool: Column, name: Column) -> Column:
    """The explicit type if there is such a type; else what the tool attribute and the span's name hint at, in this order."""
    like = lambda words: name.rlike(f"(?i){words}")
    hints = F.when(tool.isNotNull() | like("tool|db|query|api"), "tool_call").when(like("reason|think|llm|completion"), "llm_reasoning").when(like("plan"), "plan").when(like("input|prompt|user"), "user_input").when(like("output|final|answer|decision"), "final_output").otherwise("llm_reasoning")
    return F.when(explicit.isin(*STEP_TYPES), explicit).otherwise(hints)


def run_attribute(resource_spans: Column, name: str, wire: Wire, default: str | None = None) -> Column:
    """An attribute of an export's run, as the first resource alone gives it: the one in the producer's namespace, `<namespace>.run.<name>`."""
    return F.coalesce(attribute(F.try_element_at(resource_spans, F.lit(1))["resource"]["attributes"], wire.attribute(f"run.{name}")), F.lit(default))


#: The run of an export that names none.
UNNAMED = "otel-run"


def otlp(docs: DataFrame, wire: Wire = Wire(), live: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, steps, refused) of OTLP/JSON exports. Run attributes come from the first resource alone.

    An export without a run id is the run `otel-run`; of exports that name the same run, one stays and others are refused.
    live: as a span processor sees spans, where a span with ERROR status is an error step; an offline export's isn't.
    """
    root = docs.withColumn("r", F.from_json("text", OTLP)["resourceSpans"])
    of_run = lambda n, d=None: run_attribute(F.col("r"), n, wire, d)
    status = of_run("status")
    root, late = one_each(root.select("path", of_run("id", UNNAMED).alias("run_id"), "r"))
    runs = root.select("path", "run_id", of_run("name", "OpenTelemetry run").alias("name"), of_run("currency", "USD").alias("currency"), F.when(status.isin("completed", "failed"), status).alias("declared"))
    spans = root.select("run_id", F.posexplode("r").alias("i", "rs")).select("run_id", "i", F.posexplode("rs.scopeSpans").alias("j", "ss")).select("run_id", "i", "j", F.posexplode("ss.spans").alias("k", "s"))
    spans = spans.withColumn("ord", F.row_number().over(Window.partitionBy("run_id").orderBy("i", "j", "k")) - 1)
    # Each attribute is looked up once, into a column of its own.
    own = ["step.type", "step.label", "cost", "tool.name", "input", "output", "data_payload"]
    keys = [*map(wire.attribute, own), "gen_ai.tool.name", "gen_ai.usage.total_tokens", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.prompt", "gen_ai.completion"]
    spans = spans.withColumn("said", said(F.col("s.attributes"))).withColumns({f"at_{i}": last_said(F.col("said"), k) for i, k in enumerate(keys)}).drop("said")
    at = lambda *names: F.coalesce(*[F.col(f"at_{keys.index(k)}") for k in names])
    name = F.coalesce("s.name", F.lit("span"))
    start, end = tx.number(F.col("s.startTimeUnixNano")) / 1e6, tx.number(F.col("s.endTimeUnixNano")) / 1e6
    total = tx.number(at("gen_ai.usage.total_tokens"))
    tool = at("gen_ai.tool.name")
    kind = step_type(at(wire.attribute("step.type")), tool, name)
    if live:
        kind = F.when(~F.coalesce(at(wire.attribute("step.type")).isin(*STEP_TYPES), F.lit(False)) & (F.col("s.status.code") == 2), "error").otherwise(kind)
    drafts = spans.select(
        "run_id", "ord", kind.alias("type"), F.coalesce(at(wire.attribute("step.label")), name).alias("label"), F.date_format(F.timestamp_millis(F.round(start).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("started_at"),
        F.greatest(F.lit(0.0), F.floor(end - start + 0.5).cast("double")).alias("duration_ms"), F.when(total > 0, total).otherwise(tx.number(at("gen_ai.usage.input_tokens")) + tx.number(at("gen_ai.usage.output_tokens"))).alias("tokens"),
        tx.number(at(wire.attribute("cost"))).alias("cost"), at("gen_ai.tool.name", wire.attribute("tool.name")).alias("tool_name"), maybe_json(at("gen_ai.prompt", wire.attribute("input"))).alias("input"),
        maybe_json(at("gen_ai.completion", wire.attribute("output"))).alias("output"), maybe_json(at(wire.attribute("data_payload"))).alias("data_payload"),
        F.coalesce("s.spanId", F.concat("run_id", F.lit("-span-"), F.col("ord").cast("string"))).alias("span_id"), F.when(F.length("s.parentSpanId") > 0, F.col("s.parentSpanId")).alias("parent_span_id"),
    )
    return runs, assemble(drafts).withColumn("pos", F.col("index")), late


# ---- session logs -----------------------------------------------------------------------------------------------

USAGE = "struct<input_tokens:double,output_tokens:double,cache_read_input_tokens:double,cache_creation_input_tokens:double,cache_creation:struct<ephemeral_5m_input_tokens:double,ephemeral_1h_input_tokens:double>>"
ENTRY = f"struct<type:string,uuid:string,parentUuid:string,timestamp:string,sessionId:string,cwd:string,message:struct<role:string,model:string,usage:{USAGE}>>"
BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string>"


def session_entries(raw: DataFrame) -> DataFrame:
    """Entries (file, line, e, content, result) of session logs, without lines that can't be read. raw: (file, line, raw)."""
    out = raw.where(F.length(F.trim("raw")) > 0).withColumn("v", F.try_parse_json("raw")).where("v is not null")
    return out.select("file", "line", F.from_json("raw", ENTRY).alias("e"), member(F.col("raw"), "$.message.content").alias("content"), member(F.col("raw"), "$.toolUseResult").alias("result"))


def is_session(entries: DataFrame) -> DataFrame:
    """Rows (file, session): whether a file has an entry of a user or assistant with a message and a uuid."""
    good = F.col("e.type").isin("user", "assistant") & F.col("e.message").isNotNull() & F.col("e.uuid").isNotNull()
    return entries.groupBy("file").agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("session"))


def usage_tokens(u: Column) -> Column:
    z = lambda n: F.coalesce(u[n], F.lit(0.0))
    return z("input_tokens") + z("output_tokens") + z("cache_read_input_tokens") + z("cache_creation_input_tokens")


def usage_cost(u: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million. Of cached tokens, a breakdown by lifetime goes before their sum, which is read as short-lived."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    short, long = u["cache_creation"]["ephemeral_5m_input_tokens"], u["cache_creation"]["ephemeral_1h_input_tokens"]
    split = short.isNotNull() | long.isNotNull()
    each = price_in / 1_000_000
    return z(u["input_tokens"]) * price_in / 1_000_000 + z(u["output_tokens"]) * price_out / 1_000_000 + z(u["cache_read_input_tokens"]) * each * READ + F.when(split, z(short)).otherwise(z(u["cache_creation_input_tokens"])) * each * WRITE_5M + F.when(split, z(long)).otherwise(0.0) * each * WRITE_1H


def with_price(df: DataFrame, model: str, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """price_in and price_out: the table's row for a model, else its first row (by ord) that begins the model, else the default.

    prices: (model, price_in, price_out, ord), a dimension of tens of rows; only distinct models meet it.
    """
    models = df.select(F.col(model).alias("_m")).where("_m is not null").distinct()
    best = models.join(F.broadcast(prices), F.col("_m").startswith(F.col("model"))).groupBy("_m").agg(F.min_by(F.struct("price_in", "price_out"), F.struct(F.col("_m") != F.col("model"), "ord")).alias("p"))
    return df.join(best, F.col(model) == F.col("_m"), "left").withColumns({"price_in": F.coalesce("p.price_in", F.lit(default[0])), "price_out": F.coalesce("p.price_out", F.lit(default[1]))}).drop("_m", "p")


def user_text(content: Column) -> Column:
    """Text of a user's turn: a string, or the texts of its text blocks, by lines."""
    blocks = F.from_json(content, f"array<{BLOCK}>")
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: tx.trimmed(b["text"])), lambda t: F.length(t) > 0)
    return F.when(content.startswith('"'), tx.trimmed(F.get_json_object(F.concat(F.lit('{"x":'), content, F.lit("}")), "$.x"))).otherwise(F.array_join(texts, "\n"))


def tool_output(content: Column) -> Column:
    """JSON text of a tool result: a string as it is, the texts of a list by lines, else the content."""
    parts = F.filter(F.transform(F.from_json(content, "array<struct<text:string>>"), lambda b: b["text"]), lambda t: t.isNotNull())
    return F.when(content.startswith("[") & (F.size(parts) > 0), maybe_string(F.array_join(parts, "\n"))).otherwise(content)


def maybe_string(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)\A\{"x":(.*)\}\z', 1)


def sessions(raw: DataFrame, prices: DataFrame, default: tuple[float, float], prefix: str = "cc-", unnamed: str = "session") -> tuple[DataFrame, DataFrame]:
    """(runs, steps) of session logs, one run for each file.

    A turn's tokens, cost and the time to the next turn go to its first step; tool results go to their calls, the last
    one winning; the last text of an assistant is the final output.
    """
    entries = session_entries(raw)
    by_file = Window.partitionBy("file").orderBy("line")
    ids = entries.groupBy("file").agg(F.concat(F.lit(prefix), F.coalesce(F.min_by("e.sessionId", F.when(F.col("e.sessionId").isNotNull(), F.col("line"))), F.lit(unnamed))).alias("run_id"), F.min_by(tx.one_line(user_text(F.col("content"))), F.when((F.col("e.type") == "user") & tx.label_worthy(user_text(F.col("content"))), F.col("line"))).alias("name"))
    turns = entries.where(F.col("e.type").isin("user", "assistant"))
    time = F.try_to_timestamp("e.timestamp")
    gap = F.greatest(F.lit(0), F.coalesce(F.unix_millis(F.lead(time).over(by_file)) - F.unix_millis(time), F.lit(0))).cast("double")
    turns = with_price(turns.withColumn("gap", gap).withColumn("model", F.col("e.message.model")), "model", prices, default)
    as_list = F.when(F.col("content").startswith("["), F.from_json("content", "array<string>")).otherwise(F.array(F.to_json(F.struct(F.lit("text").alias("type"), F.get_json_object(F.concat(F.lit('{"x":'), F.col("content"), F.lit("}")), "$.x").alias("text")))))
    blocks = turns.select("*", F.posexplode(as_list).alias("k", "block")).withColumn("b", F.from_json("block", BLOCK))
    results = blocks.where((F.col("e.type") == "user") & (F.col("b.type") == "tool_result") & F.col("b.tool_use_id").isNotNull()).groupBy(F.col("file").alias("result_file"), F.col("b.tool_use_id").alias("call")).agg(F.max_by(F.struct(tool_output(member(F.col("block"), "$.content")).alias("output"), F.col("result").alias("data")), F.struct("line", "k")).alias("res"))
    text = user_text(F.col("content"))
    said = turns.where((F.col("e.type") == "user") & (F.length(text) > 0) & ~tx.is_plumbing(text)).select("file", "line", F.lit(0).alias("k"), "e", "gap", "price_in", "price_out", F.lit("user_input").alias("type"), tx.shortened(tx.one_line(text)).alias("label"), F.lit(None).cast("string").alias("tool_name"), maybe_string(text).alias("input"), F.lit(None).cast("string").alias("output"), F.lit(None).cast("string").alias("data_payload"), F.col("e.uuid").alias("span"))
    mine = blocks.where(F.col("e.type") == "assistant").join(results, (F.col("file") == F.col("result_file")) & (F.col("b.id") == F.col("call")), "left")
    thinks, talks, calls = (F.col("b.type") == "thinking") & (F.length("b.thinking") > 0), (F.col("b.type") == "text") & (F.length(tx.trimmed(F.col("b.text"))) > 0), F.col("b.type") == "tool_use"
    told = mine.where(thinks | talks | calls).select("file", "line", "k", "e", "gap", "price_in", "price_out", F.when(calls, "tool_call").otherwise("llm_reasoning").alias("type"), F.when(thinks, "Reasoning").when(talks, "Assistant").when(F.col("b.name").isNotNull(), F.concat(F.lit("Tool: "), "b.name")).otherwise("Tool call").alias("label"), F.when(calls, F.col("b.name")).alias("tool_name"), F.when(calls, member(F.col("block"), "$.input")).alias("input"), F.when(thinks, maybe_string(F.col("b.thinking"))).when(talks, maybe_string(F.col("b.text"))).otherwise(F.col("res.output")).alias("output"), F.when(calls, F.col("res.data")).alias("data_payload"), F.concat(F.coalesce("e.uuid", F.lit("")), F.lit(":"), F.coalesce("b.id", "b.type")).alias("span"))
    steps = said.unionByName(told)
    first = F.row_number().over(Window.partitionBy("file", "line").orderBy("k")) == 1
    final = F.max(F.when(F.col("label") == "Assistant", F.struct("line", "k"))).over(Window.partitionBy("file"))
    usage = F.col("e.message.usage")
    paid = (F.col("e.type") == "assistant") & usage.isNotNull()
    steps = steps.withColumns({"first": first, "final": final.eqNullSafe(F.struct("line", "k"))})
    steps = steps.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("line", "k")) - 1).join(ids, "file")
    zero = F.lit(0.0)
    drafts = steps.select(
        "run_id", "ord", F.when(F.col("final"), "final_output").otherwise(F.col("type")).alias("type"), F.when(F.col("final"), "Final output").otherwise(F.col("label")).alias("label"), F.coalesce("e.timestamp", F.lit("1970-01-01T00:00:00.000Z")).alias("started_at"),
        F.when(F.col("first"), F.col("gap")).otherwise(zero).alias("duration_ms"), F.when(F.col("first") & paid, usage_tokens(usage)).otherwise(zero).alias("tokens"), F.when(F.col("first") & paid, usage_cost(usage, F.col("price_in"), F.col("price_out"))).otherwise(zero).alias("cost"),
        "tool_name", "input", "output", "data_payload", F.coalesce("span", F.concat("run_id", F.lit("-span-"), F.col("ord").cast("string"))).alias("span_id"), F.col("e.parentUuid").alias("parent_span_id"),
    )
    runs = ids.select("run_id", F.coalesce("name", F.lit("Session")).alias("name"), F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("declared"))
    return runs, assemble(drafts).withColumn("pos", F.col("index"))


def session_summaries(raw: DataFrame) -> DataFrame:
    """Rows (file, session_id, cwd, prompt, started_at, ended_at, messages), newest end first; files without a message are left out."""
    entries = session_entries(raw)
    text = user_text(F.col("content"))
    first = lambda value, where: F.min_by(value, F.when(where, F.col("line")))
    stamp = F.col("e.timestamp")
    talk = F.col("e.type").isin("user", "assistant")
    out = entries.groupBy("file").agg(first(F.col("e.sessionId"), F.col("e.sessionId").isNotNull()).alias("session_id"), first(F.col("e.cwd"), F.col("e.cwd").isNotNull()).alias("cwd"), first(tx.shortened(tx.one_line(text), 100), (F.col("e.type") == "user") & tx.label_worthy(text)).alias("prompt"), first(stamp, stamp.isNotNull()).alias("started_at"), F.max_by(stamp, F.when(stamp.isNotNull(), F.col("line"))).alias("ended_at"), F.count_if(talk).alias("messages"))
    return out.where("messages > 0").orderBy(F.desc("ended_at"))


def session_run_ids(raw: DataFrame, prefix: str = "cc-", unnamed: str = "session") -> DataFrame:
    """Rows (file, run_id): the id that sessions() will give a file's run, from its first session id alone."""
    some = raw.select("file", "line", F.get_json_object("raw", "$.sessionId").alias("s")).where("s is not null")
    first = some.groupBy("file").agg(F.min_by("s", "line").alias("s"))
    return raw.select("file").distinct().join(first, "file", "left").select("file", F.concat(F.lit(prefix), F.coalesce("s", F.lit(unnamed))).alias("run_id"))


def find_session(summaries: DataFrame, session_id: str) -> DataFrame:
    return summaries.where(F.col("session_id") == session_id)


# ---- journals and envelopes -------------------------------------------------------------------------------------

JOURNAL = "struct<kind:string,formatVersion:int,id:string,name:string,currency:string,startedAt:string,hashVersion:int,status:string>"
RECORD_STEP = "struct<id:string,index:long,type:string,label:string,startedAt:string,durationMs:double,tokens:double,cost:double,toolName:string,spanId:string,parentSpanId:string,hash:string,prevHash:string,commitments:map<string,string>,salts:map<string,string>,redactions:array<struct<path:string,at:string,reason:string,by:string>>>"


def recorded_steps(raw_steps: DataFrame) -> DataFrame:
    """Steps as records hold them. raw_steps: (run_id, pos, raw)."""
    s = raw_steps.withColumn("s", F.from_json("raw", RECORD_STEP))
    zero = F.lit(0.0)
    return s.select("run_id", F.col("pos").cast("long").alias("pos"), "s.id", "s.index", "s.type", "s.label", F.col("s.toolName").alias("tool_name"), F.col("s.startedAt").alias("started_at"), F.coalesce("s.durationMs", zero).alias("duration_ms"), F.coalesce("s.tokens", zero).alias("tokens"), F.coalesce("s.cost", zero).alias("cost"), member(F.col("raw"), "$.input").alias("input"), member(F.col("raw"), "$.output").alias("output"), member(F.col("raw"), "$.dataPayload").alias("data_payload"), F.col("s.spanId").alias("span_id"), F.col("s.parentSpanId").alias("parent_span_id"), "s.hash", F.col("s.prevHash").alias("prev_hash"), "s.commitments", "s.salts", "s.redactions")


def journals(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recordings, steps) of journals (file, modified, line, raw). The last meta and end lines count.

    recordings: (file, run_id, name, currency, started_at, hash_version, ended, steps, modified). A file with a line that
    can't be read yet, or without a meta line, is left out until it settles.
    """
    some = raw.where(F.length(F.trim("raw")) > 0).withColumn("j", F.from_json("raw", JOURNAL)).withColumn("ok", F.try_parse_json("raw").isNotNull() & F.coalesce(F.col("j.kind").isin("meta", "step", "end"), F.lit(False)))
    last = lambda kind: F.max_by("j", F.when(F.col("j.kind") == kind, F.col("line")))
    files = some.groupBy("file").agg(F.bool_and("ok").alias("ok"), last("meta").alias("meta"), last("end").alias("end"), F.count_if(F.col("j.kind") == "step").alias("steps"), F.max("modified").alias("modified")).where("ok and meta is not null")
    recordings = files.select("file", F.col("meta.id").alias("run_id"), F.col("meta.name").alias("name"), F.col("meta.currency").alias("currency"), F.col("meta.startedAt").alias("started_at"), F.col("meta.hashVersion").alias("hash_version"), F.col("end.status").alias("ended"), "steps", "modified").orderBy(F.desc("modified"))
    lines_ = some.where(F.col("j.kind") == "step").join(files.select("file", F.col("meta.id").alias("run_id")), "file")
    place = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return recordings, recorded_steps(lines_.select("run_id", place.alias("pos"), member(F.col("raw"), "$.step").alias("raw")))


RUN = "struct<id:string,name:string,startedAt:string,endedAt:string,status:string,currency:string,totals:struct<tokens:double,cost:double,durationMs:double,steps:long>,runHash:string,hashVersion:int,signature:struct<algorithm:string,keyId:string,publicKey:string,signature:string,signedAt:string>,redactionSeal:struct<algorithm:string,keyId:string,publicKey:string,signature:string,sealedAt:string,redactionsHash:string>,warnings:array<struct<kind:string,message:string,stepIds:array<string>>>,steps:array<string>>"


def envelopes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, steps, refused) of evidence envelopes, or of bare runs. Envelopes of another format version are refused."""
    out = docs.withColumn("version", member(F.col("text"), "$.formatVersion")).withColumn("body", F.when(F.col("version").isNotNull(), member(F.col("text"), "$.run")).otherwise(F.col("text"))).withColumn("r", F.from_json("body", RUN))
    fine = (F.col("version").isNull() | (F.col("version") == "1")) & F.col("r.id").isNotNull()
    good = out.where(F.coalesce(fine, F.lit(False)))
    runs = good.select(F.col("r.id").alias("run_id"), F.col("r.name").alias("name"), F.col("r.startedAt").alias("started_at"), F.col("r.endedAt").alias("ended_at"), F.col("r.status").alias("status"), F.col("r.currency").alias("currency"), F.col("r.totals").alias("totals"), F.col("r.runHash").alias("run_hash"), F.col("r.hashVersion").alias("hash_version"), F.col("r.signature").alias("signature"), F.col("r.redactionSeal").alias("redaction_seal"), F.col("r.warnings").alias("warnings"))
    steps = recorded_steps(good.select(F.col("r.id").alias("run_id"), F.posexplode("r.steps").alias("pos", "raw")))
    return runs, steps, out.where(~F.coalesce(fine, F.lit(False))).select("path", "version")
