"""Answers as ordered events, their frames, and whether the service is ready to give any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.functions.answer import FALLBACK, by_language, disclaimer, has_disclaimer
from lexgrid.functions.text import let

#: Said where an answer ran out of tokens, by language, and where it failed.
CUT_SHORT = {
    "en": "\n\n**This answer was cut short** before all the relevant bylaw text could be summarised. Ask about a narrower part of the question to see the rest, and do not treat the list above as complete.",
    "fr": "\n\n**Cette réponse a été interrompue** avant que tout le texte pertinent de l'arrêté ait pu être résumé. Posez une question plus précise pour voir la suite, et ne considérez pas la liste ci-dessus comme complète.",
}
FAILURE = "The assistant could not complete this answer. Please try again."


def spoken(tokens: Column, found: Column, language: Column, verified_on: Column, finish: Column) -> Column:
    """The tokens of an answer as they go out, from those of a model.

    Without passages the fallback and the disclaimer, whatever the model said. An answer that ran out of
    tokens says so. A disclaimer follows unless the answer has one.
    """
    note = disclaimer(language, verified_on)
    nothing = F.array().cast("array<string>")
    whole = F.concat(F.filter(F.coalesce(tokens, nothing), lambda t: t != ""), F.when(F.coalesce(finish, F.lit("")) == "length", F.array(by_language(CUT_SHORT, language))).otherwise(nothing))
    closed = let(whole, lambda w: F.when(has_disclaimer(F.array_join(w, "")), w).otherwise(F.array_append(w, note)))
    return F.when(F.coalesce(found, F.lit(0)) == 0, F.array(by_language(FALLBACK, language), note)).otherwise(closed)


def events(requests: DataFrame) -> DataFrame:
    """request, seq, type, data of every answer: citations, tokens, done; or what came before a failure, and an error.

    requests: request, language, verified_on, citations (array of string, null where retrieval failed),
    tokens (array of string), finish, failed. Data is JSON. A row is one request, so order needs no shuffle.
    """
    event = lambda kind, data: F.struct(F.lit(kind).alias("type"), data.cast("string").alias("data"))
    failed = F.coalesce("failed", F.lit(False)) | F.col("citations").isNull()
    none = F.array().cast("array<struct<type:string,data:string>>")
    said = F.when(failed, F.coalesce("tokens", F.array().cast("array<string>"))).otherwise(spoken(F.col("tokens"), F.size("citations"), F.col("language"), F.col("verified_on"), F.col("finish")))
    head = F.when(F.col("citations").isNotNull(), F.array(event("citations", F.to_json("citations")))).otherwise(none)
    body = F.when(F.col("citations").isNotNull(), F.transform(said, lambda t: event("token", t))).otherwise(none)
    tail = F.when(failed, F.array(event("error", F.lit(FAILURE)))).otherwise(F.array(event("done", F.lit(None))))
    return requests.select("request", F.posexplode(F.concat(head, body, tail)).alias("seq", "e")).select("request", "seq", "e.type", "e.data")


def frame(kind: Column, data: Column) -> Column:
    """An event on the wire: its name, and type and data as JSON on one line."""
    value = F.when(kind == "citations", data).otherwise(F.regexp_extract(F.to_json(F.struct(data.alias("d"))), r'^\{"d":(.*)\}$', 1))
    return F.concat(F.lit("event: "), kind, F.lit("\r\ndata: {\"type\":\""), kind, F.lit('","data":'), F.coalesce(F.nullif(value, F.lit("")), F.lit("null")), F.lit("}\r\n\r\n"))


def bodies(answers: DataFrame) -> DataFrame:
    """request, body: the frames of each answer in order, as they would be written to its client."""
    each = answers.select("request", F.struct("seq", frame(F.col("type"), F.col("data")).alias("f")).alias("x"))
    return each.groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]), "").alias("body"))


def readiness(dependencies: DataFrame, deep: bool = False, store: str = "store") -> DataFrame:
    """probe, status, http_status from (probe, name, ok): a deep probe needs everything, a shallow one the store alone.

    A dependency whose state is null is down; a shallow probe without a store is not ready.
    """
    ok = F.coalesce("ok", F.lit(False))
    all_ok = F.bool_and(ok)
    ready = all_ok if deep else F.coalesce(F.bool_and(F.when(F.col("name") == store, ok)), F.lit(False))
    return dependencies.groupBy("probe").agg(F.when(all_ok, "ok").otherwise("degraded").alias("status"), F.when(ready, 200).otherwise(503).alias("http_status"))
