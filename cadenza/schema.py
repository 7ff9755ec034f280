"""Schemas of the nested inputs. Data files are never read by inference."""

from __future__ import annotations

TURN = "`from` STRING, value STRING, timestamp DOUBLE"
ANNOTATION = f"session_id BIGINT, video_id STRING, type STRING, videos ARRAY<STRING>, conversations ARRAY<STRUCT<{TURN}>>, meta STRING"
SAMPLE = f"{ANNOTATION}, endpoint_timestamp INT, sample_type INT"
GEN_ARGS = "STRUCT<model STRING, input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT, api_calls BIGINT>"
PREDICTION = (f"prediction_id BIGINT, session_id BIGINT, video_id STRING, type STRING, "
              f"conversations ARRAY<STRUCT<{TURN}, pred STRING, sample_type INT>>, gen_args {GEN_ARGS}")
FRAME = "gen STRING, ref STRING, frame_idx_in_stream DOUBLE, timestamp_in_stream DOUBLE"
MATCH_INFO = (f"matched ARRAY<ARRAY<STRUCT<{FRAME}>>>, missed ARRAY<STRUCT<{FRAME}>>, redundant ARRAY<STRUCT<{FRAME}>>, "
              "match_costs ARRAY<DOUBLE>, semantic_scores ARRAY<DOUBLE>")
JUDGE_REPLY = "explanation STRING, score STRING"
EVENT = "sample_id STRING, scene_type STRING, timestamp DOUBLE, answer STRING, response STRING, score DOUBLE, category STRING, explanation STRING"
