"""Requests to models as columns: endpoints and JSON bodies by provider, translation prompts and profiles."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Translation profiles as (key, name, source, target, keeps honorifics).
PROFILES = (("zh_en_webnovel", "Chinese Web Novel → English", "zh", "en", True), ("ko_en_webnovel", "Korean Web Novel → English", "ko", "en", True), ("ja_en_lightnovel", "Japanese Light Novel → English", "ja", "en", True))
CONTEXT_CAP = 8192
JSON_ONLY = "Respond ONLY with valid JSON. No commentary, no markdown."


def endpoint(base: Column, provider: Column) -> Column:
    """(url, style) of a request: chat messages or one prompt; a bare local host gets the chat path."""
    url = F.regexp_replace(base, "/+$", "")
    style = F.when(F.lower(F.trim(provider)).isin("external_cloud", "openai", "openai_cloud"), "cloud").when(url.endswith("/api/chat") | url.endswith("11434"), "chat").otherwise("prompt")
    return F.struct(F.when((style == "chat") & url.endswith("11434"), F.concat(url, F.lit("/api/chat"))).otherwise(url).alias("url"), style.alias("style"))


def body(style: Column, model: Column, system: Column, user: Column, context: Column) -> Column:
    """The JSON body for a style of endpoint."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(message("system", system), message("user", user)).alias("messages")
    options = F.struct(F.lit(0.0).alias("temperature"), F.least(context, F.lit(CONTEXT_CAP)).alias("num_ctx")).alias("options")
    local = (F.lit(False).alias("stream"), F.lit("json").alias("format"), options)
    whole = F.concat_ws("\n\n", F.trim(system), F.trim(user), F.lit(JSON_ONLY)).alias("prompt")
    return F.when(style == "cloud", F.to_json(F.struct(model.alias("model"), messages, F.lit(0).alias("temperature")))).when(style == "chat", F.to_json(F.struct(model.alias("model"), messages, *local))).otherwise(F.to_json(F.struct(model.alias("model"), whole, *local)))


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), "profile string, name string, source string, target string, keep_honorifics boolean")


def translation_prompt(text: Column, source: Column, target: Column, glossary: Column) -> Column:
    """A translation task as one text; glossary is a map, listed by term."""
    terms = F.array_join(F.transform(F.array_sort(F.map_entries(glossary)), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), "\n")
    head = F.concat(F.lit("Translate from "), source, F.lit(" to "), target, F.lit("."))
    return F.concat_ws("\n\n", head, F.when(F.size(glossary) > 0, F.concat(F.lit("Use this glossary:\n"), terms)), F.concat(F.lit("Text:\n"), text), F.lit('Reply with JSON: {"translation": "..."}'))
