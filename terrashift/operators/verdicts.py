"""Answers of the verifying model as checked columns: semi-structured values against a declared schema, anything broken is uncertain.

An answer is a message (JSON text with stop_reason, content blocks and usage).
It is parsed once into a VARIANT, its text blocks are joined and parsed again,
and every declared field is checked in order; the first thing that is wrong
becomes the cause of an ``uncertain`` verdict, so no answer can stop a job.
Numbers and flags may be given as text, as lenient JSON validation accepts it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a verdict may say.
VERDICTS = ("real_change", "likely_artifact", "uncertain")
CHANGE_TYPES = (
    "construction", "demolition", "vegetation_clearing", "vegetation_regrowth", "flooding",
    "no_meaningful_change", "weather_artifact", "alignment_artifact", "uncertain",
)
RISKS = ("cloud_shadow", "snow", "seasonality", "registration")
LEVELS = ("low", "medium", "high")
EVIDENCE = (1, 8)
FIELDS = ("vlm_verdict", "change_type", "visual_evidence", "artifact_risk", "confidence", "requires_human_review")
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")

REFUSED, TRUNCATED, EMPTY, NO_JSON = "model declined the request", "response truncated at max_tokens", "empty response body", "not a JSON object"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _at(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _keys(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def _text_of(v: Column) -> Column:
    """The value if it is text."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _one_of(v: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(_text_of(v).isin(*allowed), F.lit(False))


def number(v: Column) -> Column:
    """A number, or a text that is one; else NULL."""
    kind = _kind(v)
    plain = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(plain, F.try_variant_get(v, "$", "double")).when(kind == "STRING", F.trim(_text_of(v)).try_cast("double"))


def flag(v: Column) -> Column:
    """A flag, 0 or 1, or a word that means one; else NULL."""
    word = F.lower(_text_of(v))
    said = F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)
    whole = F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(whole.isin(0, 1), whole == 1).otherwise(said)


def _problem(body: Column) -> Column:
    """The first field that is wrong, in the order of FIELDS; NULL if all are right."""

    def bad(name: str, what: str) -> Column:
        return F.lit(f"schema validation failed: {name} {what}")

    def risk_problem(v: Column) -> Column:
        unlisted = F.size(F.array_except(_keys(v), F.array(*map(F.lit, RISKS)))) > 0
        wrong = reduce(Column.__or__, (~_one_of(_at(v, r), LEVELS) for r in RISKS))
        return ~_kind(v).startswith("OBJECT") | unlisted | wrong

    evidence = _at(body, "visual_evidence")
    texts = F.try_variant_get(evidence, "$", "array<variant>")
    listed = _kind(evidence).startswith("ARRAY") & F.size(texts).between(*EVIDENCE) & F.forall(texts, lambda v: _kind(v) == "STRING")
    confidence = number(_at(body, "confidence"))
    rules: list[tuple[Column, Column]] = [(F.coalesce(F.size(F.array_except(_keys(body), F.array(*map(F.lit, FIELDS)))), F.lit(0)) > 0, F.lit("schema validation failed: unknown field"))]
    rules += [(_at(body, name).isNull(), bad(name, "is missing")) for name in FIELDS]
    rules += [
        (~_one_of(_at(body, "vlm_verdict"), VERDICTS), bad("vlm_verdict", "is not allowed")),
        (~_one_of(_at(body, "change_type"), CHANGE_TYPES), bad("change_type", "is not allowed")),
        (~F.coalesce(listed, F.lit(False)), bad("visual_evidence", "is not 1 to 8 texts")),
        (F.coalesce(risk_problem(_at(body, "artifact_risk")), F.lit(True)), bad("artifact_risk", "is not allowed")),
        (~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)), bad("confidence", "is not between 0 and 1")),
        (flag(_at(body, "requires_human_review")).isNull(), bad("requires_human_review", "is no flag")),
    ]
    return F.coalesce(*(F.when(wrong, said) for wrong, said in rules))


def parsed(answers: DataFrame, message: str = "message") -> DataFrame:
    """``answers`` with vlm_verdict, vlm_change_type, vlm_evidence, vlm_confidence, human_review and cause (NULL for a usable answer).

    An uncertain verdict and one below half confidence always go to a person.
    A NULL message is an empty one.
    """
    whole = F.try_parse_json(F.col(message))
    staged = answers.withColumn("_m", whole)
    blocks = F.coalesce(F.try_variant_get(F.col("_m"), "$.content", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(F.filter(blocks, lambda b: _at(b, "type", "string") == "text"), lambda b: F.coalesce(_at(b, "text", "string"), F.lit("")))
    staged = staged.withColumns({"_stop": _at(F.col("_m"), "stop_reason", "string"), "_text": F.array_join(texts, "")})
    staged = staged.withColumn("_body", F.try_parse_json("_text"))
    body = F.col("_body")
    no_object = body.isNull() | ~_kind(body).startswith("OBJECT")
    cause = (
        F.when(F.col("_stop") == "refusal", REFUSED)
        .when(F.col("_stop") == "max_tokens", TRUNCATED)
        .when(F.trim(F.regexp_replace("_text", r"\s+", " ")) == "", EMPTY)
        .when(no_object, f"schema validation failed: {NO_JSON}")
        .otherwise(_problem(body))
    )
    staged = staged.withColumn("cause", cause)
    usable = F.col("cause").isNull()
    verdict = F.when(usable, _at(body, "vlm_verdict", "string")).otherwise("uncertain")
    confidence = F.when(usable, number(_at(body, "confidence"))).otherwise(0.0)
    review = (verdict == "uncertain") | (confidence < 0.5) | F.when(usable, flag(_at(body, "requires_human_review"))).otherwise(True)
    evidence = F.when(usable, _at(body, "visual_evidence", "array<string>")).otherwise(F.array(F.concat(F.lit("No usable model response: "), F.col("cause"))))
    out = staged.withColumns(
        {
            "vlm_verdict": verdict,
            "vlm_change_type": F.when(usable, _at(body, "change_type", "string")).otherwise("uncertain"),
            "vlm_evidence": evidence,
            "vlm_confidence": confidence,
            "human_review": review,
        }
    )
    return out.drop("_m", "_stop", "_text", "_body")


USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def with_usage(answers: DataFrame, message: str = "message") -> DataFrame:
    """``answers`` with the token counts of their message; what is absent is 0."""
    whole = F.try_parse_json(F.col(message))
    counts = {c: F.coalesce(F.try_variant_get(whole, f"$.usage.{c}", "bigint"), F.lit(0).cast("bigint")) for c in USAGE}
    return answers.withColumns(counts)


# What a verifier may see of a tile's quality; everything that a detector concluded stays behind.
ALLOWED_QUALITY = (
    "masks_assessed", "cloud_fraction_max", "snow_fraction_max", "shadow_fraction_max",
    "water_fraction_max", "registration_error_px", "season_delta_days",
)


def redacted(tiles: DataFrame, allowed: tuple[str, ...] = ALLOWED_QUALITY) -> DataFrame:
    """tile_id and metadata (JSON): acquisition context by an allow-list, no gate verdict and no gate feature.

    Columns that the list doesn't name can't get in, whatever is added to
    ``tiles`` later; listed ones that it lacks are left out.
    """
    quality = F.struct(*(F.col(c) for c in allowed if c in tiles.columns))
    context = [F.col(c) for c in ("aoi_id", "tile_id", "date_t1", "date_t2") if c in tiles.columns]
    return tiles.select("tile_id", F.to_json(F.struct(*context, quality.alias("observation_quality")), {"ignoreNullFields": "false"}).alias("metadata"))
