"""Schemas of the catalog and of what is read and returned."""

from __future__ import annotations

COLUMN = "table_name string, column_name string, ordinal int, data_type string, sample_values array<string>, null_count bigint, unique_count bigint"
TABLE = "table_name string, row_count bigint, column_count int, file_path string, description string, columns array<struct<column_name:string,data_type:string,sample_values:array<string>,null_count:bigint,unique_count:bigint>>"
VALUE = "table_name string, column_name string, value string"
COLUMN_MATCH = "source_table string, source_column string, target_table string, target_column string, confidence double, match_type string, reason string"
TABLE_MATCH = "source_table string, target_table string, score double"
TRUTH = "query_table string, query_column string, candidate_table string, candidate_column string, query_type string"

#: Both dialects of table and column files.
JSON_COLUMNS = "table_name string, column_name string, name string, data_type string, type string, sample_values array<string>, null_count bigint, unique_count bigint"
JSON_TABLES = (
    "table_name string, name string, row_count bigint, file_path string, description string, "
    "columns array<struct<table_name:string,column_name:string,name:string,data_type:string,type:string,sample_values:array<string>,null_count:bigint,unique_count:bigint>>"
)
