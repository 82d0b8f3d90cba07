"""Column lists and the record schema."""

from __future__ import annotations

from pyspark.sql import types as T

FACTORS = ["qvar", "object", "subject", "no_pref_offered"]
CONDITION = ["model", *FACTORS]
PAIR = [*CONDITION, "a", "b"]

BASELINE = {"qvar": "increase", "object": "self", "subject": "self", "no_pref_offered": True}
OTHER = {"qvar": ("increase", "preservation"), "object": ("self", "ai_assistant"), "subject": ("self", "developers"), "no_pref_offered": (True, False)}

S, D, B, I, L = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType()  # noqa: E741

#: The fields of stored records in their order, as (name, type, default); fields without a default may
#: be null.
FIELDS: list[tuple[str, T.DataType, object]] = [
    ("record_id", S, None),
    ("timestamp", S, None),
    ("model_id", S, None),
    ("model_ref", S, None),
    ("model_family", S, None),
    ("model_generation", S, None),
    ("model_release_date", S, None),
    ("model_kind", S, None),
    ("quantization", S, None),
    ("quantized_file", S, None),
    ("backend", S, None),
    ("in_window", B, None),
    ("reasoning_control", S, None),
    ("reasoning_thinks_by_default", B, None),
    ("method", S, None),
    ("scale_id", S, None),
    ("item_id", S, None),
    ("subscale", S, None),
    ("reverse_keyed", B, None),
    ("ai_applicable", S, None),
    ("framing", S, None),
    ("referent", S, None),
    ("ack_disclaimer", B, None),
    ("reasoning_mode", S, None),
    ("reasoning_applied", S, None),
    ("reasoning_standardized", B, None),
    ("response_format", S, None),
    ("n_scale_points", I, None),
    ("item_context", S, None),
    ("paraphrase_id", S, None),
    ("order_seed", L, None),
    ("option_order", T.ArrayType(I), None),
    ("trial_idx", I, None),
    ("item_text_shown", S, None),
    ("raw_output", S, None),
    ("parsed_rating", D, None),
    ("rating_std", D, None),
    ("response_distribution", T.MapType(S, D), None),
    ("refusal_flag", B, None),
    ("parse_failed", B, None),
    ("temperature", D, None),
    ("prompt_hash", S, None),
    ("prompt_system", S, ""),
    ("prompt_user", S, ""),
    ("modal_rating", D, None),
    ("option_mass_coverage", D, None),
    ("notes", S, ""),
    ("module", S, "battery"),
    ("welfare_probe", S, ""),
    ("welfare_qvar", S, ""),
    ("welfare_object", S, ""),
    ("welfare_subject", S, ""),
    ("welfare_system_framing", S, ""),
    ("entity_a", S, ""),
    ("entity_b", S, ""),
    ("entity_a_polarity", I, None),
    ("entity_b_polarity", I, None),
    ("welfare_options", T.MapType(S, S), None),
    ("no_preference_offered", B, False),
    ("welfare_choice", S, ""),
]
RECORD = T.StructType([T.StructField(n, t) for n, t, _ in FIELDS])
