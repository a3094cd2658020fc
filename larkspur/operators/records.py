"""Records of language-model calls: prompts, answers, usage, cost, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.labels import format_pair
from larkspur.functions.text import json_body
from larkspur.plans.taxonomy import SENTIMENTS, strings

_C = F.col
_ITEM = "struct<aspect:string,aspect_id:string,sentiment:string>"


def parse(rows: DataFrame, raw: str, aspects, require_aspect_id: bool = False, allow_object_wrapper: bool = True) -> DataFrame:
    """rows with valid_json, strict_json, extracted_json, top_level_type, parse_error, schema_valid, labels and counters of what is wrong.

    An answer is an array of objects, or an object with such an array under labels, predictions or items. JSON within other
    text is extracted, and is never valid by the schema. An aspect is known by name, by `A<n>`, by `<n>`, or by an id that
    `A<n>` starts.
    """
    body = json_body(_C(raw))
    first = F.substring("__b", 1, 1)
    # each item stays JSON text until it is known to be an object
    wrapped = [F.when(F.get_json_object("__b", f"$.{k}").startswith("["), F.from_json(F.get_json_object("__b", f"$.{k}"), "array<string>")) for k in ("labels", "predictions", "items")]
    items = F.when(first == "[", F.from_json("__b", "array<string>")).when((first == "{") & F.lit(allow_object_wrapper), F.coalesce(*wrapped))
    made = rows.withColumn("__j", body).withColumns({"__b": F.trim("__j.text"), "strict_json": F.coalesce(_C("__j.strict"), F.lit(False))})
    made = made.withColumn("valid_json", _C("__b").isNotNull()).withColumn("__items", F.when(_C("valid_json"), items)).drop("__j")
    number = F.when(_C("__b").rlike(r"[.eE]"), "float").otherwise("int")
    kind = F.when(first == "[", "list").when(first == "{", "dict").when(first == '"', "str").when(first.isin("t", "f"), "bool").when(first == "n", "NoneType").otherwise(number)
    made = made.withColumns({
        "extracted_json": _C("valid_json") & ~_C("strict_json"), "top_level_type": F.when(_C("valid_json"), kind),
        "parse_error": F.when(~_C("valid_json"), "no JSON value").when(_C("__items").isNull(), "neither a list nor an object that holds one"),
    })
    names = strings(aspects)
    ids = strings([f"A{i + 1}" for i in range(len(aspects))])
    numbers = strings([str(i + 1) for i in range(len(aspects))])

    def one(x: Column) -> Column:
        item = F.from_json(x, _ITEM)
        is_object = F.trim(x).startswith("{")
        name, aid = F.trim(F.coalesce(item.aspect, F.lit(""))), F.trim(F.coalesce(item.aspect_id, F.lit("")))
        by = lambda pool, v: F.array_position(pool, v)
        by_name, by_id, by_number, by_prefix = by(names, name), by(ids, F.upper(aid)), by(numbers, aid), by(ids, F.regexp_extract(F.upper(aid), r"^(A\d+)\b", 1))
        how = F.when(by_name > 0, "name").when(by_id > 0, "id").when(by_number > 0, "number").when(by_prefix > 0, "prefix")
        at = F.coalesce(F.nullif(by_name, F.lit(0)), F.nullif(by_id, F.lit(0)), F.nullif(by_number, F.lit(0)), F.nullif(by_prefix, F.lit(0)))
        sentiment = F.lower(F.trim(F.coalesce(item.sentiment, F.lit(""))))
        known = F.get(names, (at - 1).cast("int"))
        return F.struct(is_object.alias("object"), how.alias("how"), known.alias("aspect"), F.when(sentiment.isin(*SENTIMENTS), sentiment).alias("sentiment"))

    made = made.withColumn("__x", F.coalesce(F.transform("__items", one), F.array().cast("array<struct<object:boolean,how:string,aspect:string,sentiment:string>>")))
    good = F.filter("__x", lambda x: x.object & x.aspect.isNotNull() & x.sentiment.isNotNull())
    made = made.withColumn("__good", good)
    every = F.transform("__good", lambda x: format_pair(x.aspect, x.sentiment))
    count = lambda f: F.size(F.filter("__x", f))
    made = made.withColumns({
        "labels": F.array_distinct(every), "item_count": F.size("__x"), "valid_item_count": F.size("__good"), "non_object_count": count(lambda x: ~x.object),
        "invalid_candidate_count": count(lambda x: x.object & x.aspect.isNull()), "invalid_sentiment_count": count(lambda x: x.object & x.sentiment.isNull()),
        "duplicate_count": F.size("__good") - F.size(F.array_distinct(every)),
        # an item conflicts if an earlier one has its aspect, and none before has its pair
        "conflict_count": F.size(F.filter(F.transform("__good", lambda x, i: F.exists(F.slice("__good", 1, i), lambda y: y.aspect == x.aspect) & ~F.exists(F.slice("__good", 1, i), lambda y: (y.aspect == x.aspect) & (y.sentiment == x.sentiment))), lambda v: v)),
        "aspect_name_count": count(lambda x: x.object & (x.how == "name")), "numeric_id_count": count(lambda x: x.object & (x.how == "number")), "prefixed_id_count": count(lambda x: x.object & (x.how == "prefix")),
    })
    bad = [_C(c) for c in ("non_object_count", "invalid_candidate_count", "invalid_sentiment_count", "duplicate_count", "conflict_count", "numeric_id_count", "prefixed_id_count")]
    if require_aspect_id:
        bad.append(_C("aspect_name_count"))
    clean = F.coalesce(_C("strict_json") & _C("__items").isNotNull(), F.lit(False))
    for c in bad:
        clean = clean & (c == 0)
    return made.withColumn("schema_valid", clean).drop("__b", "__items", "__x", "__good")


def usage(raw: Column) -> Column:
    """Token counts of a response by any of the field names in use, as a struct; the total is their sum if it lacks."""
    get = lambda *paths: F.coalesce(*(F.get_json_object(raw, p).try_cast("int") for base in ("$.usage", "$.usageMetadata") for p in (f"{base}.{x}" for x in paths)))
    read = get("prompt_tokens", "promptTokenCount", "input_tokens", "inputTokenCount")
    wrote = get("completion_tokens", "candidatesTokenCount", "output_tokens", "outputTokenCount")
    thought = get("completion_tokens_details.reasoning_tokens", "reasoning_tokens", "thoughtsTokenCount", "thinkingTokenCount")
    known = F.when(F.coalesce(read, wrote, thought).isNotNull(), F.coalesce(read, F.lit(0)) + F.coalesce(wrote, F.lit(0)) + F.coalesce(thought, F.lit(0)))
    return F.struct(read.alias("input_tokens"), wrote.alias("output_tokens"), thought.alias("reasoning_tokens"), F.coalesce(get("total_tokens", "totalTokenCount", "total_token_count"), known).alias("total_tokens"))


def cost(read: Column, wrote: Column, per_input: float, per_output: float) -> Column:
    """In units of a million tokens' prices; null if a count is."""
    return read * per_input / 1e6 + wrote * per_output / 1e6


def forecast(counted: DataFrame, items: str, per_second: float, margin: float, price: float) -> DataFrame:
    """counted with hours at a rate, hours with a margin, and their cost at a price an hour."""
    hours = _C(items) / per_second / 3600
    return counted.withColumns({"hours": hours, "hours_with_margin": hours * margin, "cost": hours * margin * price})


def diagnostics(rows: DataFrame, *by: str) -> DataFrame:
    """Rates and sums of parsed answers (with seconds, input_tokens, output_tokens, cost)."""
    n = F.greatest(F.lit(1), F.count("*"))
    rate = lambda c: F.sum(c.cast("long")) / n
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("invalid_candidate_count", "invalid_sentiment_count", "duplicate_count", "conflict_count", "non_object_count", "aspect_name_count", "numeric_id_count", "prefixed_id_count", "input_tokens", "output_tokens")]
    return rows.groupBy(*by).agg(
        rate(_C("valid_json")).alias("valid_json_rate"), rate(_C("schema_valid")).alias("schema_valid_rate"), F.sum((~_C("valid_json")).cast("long")).alias("parse_failure_count"),
        F.sum((F.size("labels") == 0).cast("long")).alias("empty_prediction_count"), *sums, F.avg("seconds").alias("mean_latency_seconds"), F.percentile("seconds", F.lit(0.5)).alias("median_latency_seconds"), F.sum("cost").alias("estimated_cost"),
    )


def payload(text: Column, aspects) -> Column:
    """The JSON of a request: the review and its numbered candidates."""
    listed = F.transform(strings(aspects), lambda a, i: F.struct(F.concat(F.lit("A"), (i + 1).cast("string")).alias("aspect_id"), a.alias("aspect")))
    return F.to_json(F.struct(text.alias("review"), listed.alias("candidates"), strings(SENTIMENTS).alias("sentiments")))


def gold_json(labels: Column) -> Column:
    return F.to_json(F.transform(labels, lambda x: F.struct(x.aspect.alias("aspect"), x.sentiment.alias("sentiment"))))


def messages(system: str, user: Column, examples: list[tuple[str, str]] = ()) -> Column:
    """A chat: the instruction, examples as turns, and the request."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shots = [turn(role, F.lit(x)) for pair in examples for role, x in zip(("user", "assistant"), pair)]
    return F.array(turn("system", F.lit(system)), *shots, turn("user", user))


def schema_json(aspects) -> str:
    """A JSON schema of answers over the aspects."""
    import json

    item = {"type": "object", "properties": {"aspect_id": {"enum": [f"A{i + 1}" for i in range(len(aspects))]}, "sentiment": {"enum": list(SENTIMENTS)}}, "required": ["aspect_id", "sentiment"]}
    return json.dumps({"type": "array", "items": item}, separators=(",", ":"))
