"""Reading the logical tables."""

from .readers import read_csv, read_id_list, read_json_lines, read_nested_csvs, read_tables

__all__ = ["read_csv", "read_id_list", "read_json_lines", "read_nested_csvs", "read_tables"]
