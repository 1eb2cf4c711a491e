"""Strict reading of model answers: JSON out of chatter, and the close of a passed gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gateledger.functions.text import SPACE, clip, let

# Fixed value: how a code fence around an answer is recognised.
FENCE = rf"```(?:json)?{SPACE}*((?s:.*?))```"

# A token of JSON text.
TOKEN = r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+'

# The verdicts a topic may carry and the length bound of each text field.
VERDICTS = ["strong", "solid", "thin"]
CONCEPT_CHARS, NOTE_CHARS = 120, 240
STRONGEST_CHARS, EDGE_CHARS, ONE_LINE_CHARS = 400, 400, 300


def json_text(raw: Column) -> Column:
    """The span from the first ``{`` to the last ``}``, inside the first code fence if there is one."""

    def span(body: Column) -> Column:
        start = F.locate("{", body)
        end = F.length(body) - F.locate("}", F.reverse(body)) + 1
        found = (start > 0) & (F.locate("}", body) > 0) & (end >= start)
        return F.when(found, F.substring(body, start, end - start + 1))

    body = F.when(raw.rlike(FENCE), F.regexp_extract(raw, FENCE, 1)).otherwise(raw)
    return let(body, span)


def extract_json(raw: Column) -> Column:
    """The answer's JSON object as a Variant; null when absent or not strict JSON.

    Of a repeated key the last value stays where the session sets ``spark.sql.variant.allowDuplicateKeys``, as in
    JavaScript; without it such an answer is null.
    """
    return F.try_parse_json(json_text(raw))


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def js_text(value: Column) -> Column:
    """``String(x || '')`` of a Variant: falsy values give an empty string."""
    return let(_parts(value), _js_text)


def _number(text: Column) -> Column:
    """A double as JavaScript writes it, from how it is written here."""
    n = text.cast("double")
    whole = n.cast("decimal(38,0)").cast("string")
    part = F.regexp_replace(text.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    power = F.regexp_replace(F.regexp_replace(text, r"(?:\.0)?E(?=\d)", "e+"), r"(?:\.0)?E-", "e-")
    plain = (F.abs(n) < 1e21) & (F.abs(n) >= 1e-6)
    return F.when(~plain, power).when(n == F.floor(n).cast("double"), whole).otherwise(part)


def _listed(value: Column) -> Column:
    """``String(x)`` of a Variant list: what its lists hold at any depth, comma after comma.

    A fold over the tokens of its JSON text. The state is the text so far and how many objects are open:
    an object is named where it opens, and what it holds is passed over.
    """

    def step(state: Column, token: Column) -> Column:
        inside = state["open"] > 0
        opened = F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        plain = F.when(token.rlike(r"[.eE]"), _number(token)).otherwise(token)
        text = (
            F.when(token.startswith('"'), F.try_variant_get(F.try_parse_json(token), "$", "string"))
            .when(inside | token.isin("[", "]", "}", ":", "null"), F.lit(""))
            .when(token == "{", F.lit("[object Object]"))
            .when(token.isin(",", "true", "false"), token)
            .otherwise(plain)
        )
        told = F.when(inside, F.lit("")).otherwise(text)
        return F.struct(F.concat(state["text"], told).alias("text"), (state["open"] + opened).alias("open"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("open"))
    return F.aggregate(F.regexp_extract_all(F.to_json(value), F.lit(TOKEN), F.lit(0)), start, step, lambda s: s["text"])


def _item(v: Column) -> Column:
    """``String(x)`` of the parts of a value that is not falsy."""
    return (
        F.when(v["value"].isNull() | (v["kind"] == "VOID"), F.lit(""))
        .when(v["kind"] == "OBJECT", F.lit("[object Object]"))
        .when(v["kind"] == "ARRAY", _listed(v["value"]))
        .when(v["kind"] == "DOUBLE", _number(v["text"]))
        .otherwise(F.coalesce(v["text"], F.lit("")))
    )


def _parts(value: Column) -> Column:
    return F.struct(
        value.alias("value"), _kind(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("text")
    )


def _js_text(v: Column) -> Column:
    kind, text = v["kind"], v["text"]
    number = F.try_variant_get(v["value"], "$", "double")
    return (
        F.when(kind == "STRING", text)
        .when(kind == "BOOLEAN", F.when(text == "true", text).otherwise(F.lit("")))
        .when(number == 0, F.lit(""))
        .otherwise(_item(v))
    )


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _clipped(value: Column, name: str, n: int) -> Column:
    return let(js_text(_field(value, name)), lambda text: clip(text, n)).alias(name)


def _topic(t: Column) -> Column:
    verdict = let(
        _field(t, "verdict"),
        lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )
    return F.struct(
        _clipped(t, "concept", CONCEPT_CHARS),
        let(verdict, lambda v: F.when(v.isin(VERDICTS), v).otherwise(F.lit("solid"))).alias("verdict"),
        _clipped(t, "note", NOTE_CHARS),
    )


def _topics(parsed: Column) -> Column:
    def listed(v: Column) -> Column:
        return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))

    named = F.transform(let(_field(parsed, "topics"), listed), _topic)
    return F.filter(named, lambda t: t["concept"] != "")


def normalise_closeout(raw: Column) -> Column:
    """A close of fixed shape out of a raw answer; null unless it names at least one topic."""

    def close(v: Column) -> Column:
        return F.when(
            F.size(v["topics"]) > 0,
            F.struct(
                v["topics"].alias("topics"),
                _clipped(v["parsed"], "strongest", STRONGEST_CHARS),
                _clipped(v["parsed"], "growth_edge", EDGE_CHARS),
                _clipped(v["parsed"], "one_line", ONE_LINE_CHARS),
            ),
        )

    def with_topics(parsed: Column) -> Column:
        return let(F.struct(parsed.alias("parsed"), _topics(parsed).alias("topics")), close)

    return let(extract_json(raw), with_topics)
