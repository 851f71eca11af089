"""Explicit schemas of the JSON files; nothing is inferred."""

SAMPLE = """STRUCT<assignment MAP<STRING, INT>, score DOUBLE, label INT, instance_text STRING,
 instance_label_text STRUCT<label STRING, properties MAP<STRING, STRING>>, instance_type STRING,
 numerical_values MAP<STRING, DOUBLE>, property_labels MAP<STRING, INT>, property_scores MAP<STRING, DOUBLE>>"""

VARIABLE = """STRUCT<name STRING, categories INT, num_output_labels INT, weights MAP<STRING, MAP<STRING, DOUBLE>>,
 scores MAP<STRING, MAP<STRING, DOUBLE>>, variable_type STRING, spans ARRAY<ARRAY<DOUBLE>>, min_weight MAP<STRING, DOUBLE>,
 max_weight MAP<STRING, DOUBLE>, direction MAP<STRING, BOOLEAN>, variable_score MAP<STRING, DOUBLE>>"""

RULE = "STRUCT<name STRING, var_a STRING, val_a INT, var_b STRING, val_b INT, weight DOUBLE, score DOUBLE>"

MODEL = f"STRUCT<num_output_labels INT, variables MAP<STRING, {VARIABLE}>, rules ARRAY<{RULE}>>"

DOCUMENT = "STRUCT<path STRING, absolute_path STRING, created_at STRING, mode STRING>"

INSTANCE = f"""STRUCT<version INT, name STRING, metadata STRING, udd STRING, dataset ARRAY<{SAMPLE}>, text_mapping STRING,
 instance_hint_used STRING, representation_level STRING, textualization_level STRING, rendered_documents ARRAY<{DOCUMENT}>>"""

ANALYSIS = """STRUCT<total_combinations BIGINT, label_counts MAP<STRING, BIGINT>, label_fractions MAP<STRING, DOUBLE>, avg_decisiveness DOUBLE,
 avg_top_score DOUBLE, max_fraction_gap_from_uniform DOUBLE, min_decisiveness_overall DOUBLE, property_imbalance_avg DOUBLE,
 property_imbalances MAP<STRING, DOUBLE>>"""

METADATA = f"""STRUCT<analysis {ANALYSIS}, save_path STRING, main_name STRING, num_output_labels INT,
 rendered_instances MAP<STRING, MAP<STRING, ARRAY<{DOCUMENT}>>>, output_properties MAP<STRING, STRING>>"""

STATISTICS = f"""STRUCT<udd_search_iterations INT, samples_per_label MAP<STRING, INT>, total_samples_per_label MAP<STRING, INT>,
 total_number_of_assignments BIGINT, analysis_results {ANALYSIS}>"""

THEORY = """STRUCT<accuracy DOUBLE, target_accuracy DOUBLE, llm STRING, textual_llm_theory STRING, textual_dt_theory STRING,
 textualized_versions MAP<STRING, STRING>>"""

PROPERTY = """STRUCT<type STRING, num_output_labels INT, num_categories INT, min_value DOUBLE, max_value DOUBLE, unit STRING, description STRING,
 available_for_labels ARRAY<INT>, udd STRING>"""

RUN = """STRUCT<run_id STRING, created_at STRING, model_name STRING, instance_name STRING, representation_level STRING, interactive_mode STRING,
 results STRING, full_evaluation_config STRING, session_data STRING>"""

CONFIG = """STRUCT<udd_complexity STRING, num_samples STRING, representation_level STRING, textualization_level STRING, dynamic STRING,
 llm_model STRING, file_rendering STRING, max_genetic_search_configurations STRING, genetic_search_max_iterations STRING>"""
