"""One explicit schema per table. Ids are BIGINT everywhere; files that store them as strings are cast on read."""

from __future__ import annotations

GIGS = ("hire_id BIGINT, hire_title STRING, hire_description STRING, hire_description_additional_notes STRING, "
        "budget_lo DOUBLE, budget_hi DOUBLE, seniority_needed STRING, start_by STRING, commitment INT, "
        "duration_weeks DOUBLE, industry STRING, secondary_industry STRING")
PROVIDERS = ("provider_id BIGINT, about_title STRING, about_description STRING, services_offered_title STRING, "
             "services_offered_description STRING, relevant_experience STRING, rate_per_hour DOUBLE, seniority STRING, "
             "available_from STRING, capacity INT, availability STRING, industry STRING, secondary_industry STRING")
JUDGMENTS = ("hire_id STRING, provider_id STRING, model STRING, prompt_version STRING, timestamp STRING, status STRING, "
             "grade INT, expected_grade DOUBLE, probs ARRAY<DOUBLE>, score DOUBLE, generated STRING, scoring STRING, "
             "usage STRUCT<prompt_tokens: INT, completion_tokens: INT>, elapsed DOUBLE")
MANIFEST = ("file STRING, entity_type STRING, status STRING, timestamp STRING, repaired BOOLEAN, "
            "review STRUCT<decision: STRING>")
LABEL_MAP = "MAP<STRING, MAP<STRING, INT>>"
LIST_MAP = "MAP<STRING, ARRAY<BIGINT>>"
SOURCE_MAP = "MAP<STRING, MAP<STRING, ARRAY<STRING>>>"
TAG_FILE_MAP = "STRUCT<model: STRING, top_m: INT, score: STRING, tags: MAP<STRING, ARRAY<ARRAY<DOUBLE>>>, tag_ids: ARRAY<BIGINT>, mean: ARRAY<DOUBLE>, sd: ARRAY<DOUBLE>>"
GIG_TEXT = ("hire_title", "hire_description", "hire_description_additional_notes")
PROVIDER_TEXT = ("about_title", "about_description", "services_offered_title", "services_offered_description",
                 "relevant_experience")
