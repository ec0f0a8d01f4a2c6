"""The few expressions that Spark SQL and DuckDB spell differently."""

from __future__ import annotations


class Spark:
    def us(self, x: str) -> str:
        return f"unix_micros(CAST({x} AS TIMESTAMP))"

    def text(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def joined(self, x: str) -> str:
        return f"array_join(array_sort(collect_set({x})), ',')"

    def week(self, x: str) -> str:
        return f"CAST(CAST(date_trunc('week', CAST({x} AS TIMESTAMP)) AS DATE) AS STRING)"

    def hour(self, x: str) -> str:
        return f"CAST(floor(unix_micros(CAST({x} AS TIMESTAMP)) / 3600000000) AS BIGINT)"

    def all(self, text: str, pattern: str) -> str:
        escaped = pattern.replace("\\", "\\\\")
        return f"size(regexp_extract_all({text}, '{escaped}', 0))"

    def replace(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}')"

    group = "$1"

    def first(self, x: str, n: int) -> str:
        return f"array_join(slice(array_sort(collect_list({x})), 1, {n}), ',')"

    def overlap(self, x: str, values: str) -> str:
        return f"arrays_overlap(collect_set({x}), array({values}))"

    def without(self, x: str, values: str) -> str:
        return f"array_join(array_sort(array_except(collect_set({x}), array({values}))), ',')"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def json(self, **fields: str) -> str:
        inner = ", ".join(f"'{k}', {v}" for k, v in fields.items())
        return f"to_json(named_struct({inner}))"

    def pad(self, x: str, n: str) -> str:
        return f"lpad(CAST({x} AS STRING), {n}, '0')"

    def best(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE '{pattern}')"

    def position(self, x: str, y: str) -> str:
        return f"CAST(instr({x}, {y}) AS BIGINT)"

    double = "\\\\"


class Duck:
    def us(self, x: str) -> str:
        return f"epoch_us({x})"

    def text(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def joined(self, x: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list({x}))), ',')"

    def week(self, x: str) -> str:
        return f"CAST(CAST(date_trunc('week', {x}) AS DATE) AS VARCHAR)"

    def hour(self, x: str) -> str:
        return f"CAST(floor(epoch_us({x}) / 3600000000) AS BIGINT)"

    def all(self, text: str, pattern: str) -> str:
        return f"len(regexp_extract_all({text}, '{pattern}'))"

    def replace(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    group = "\\1"

    def first(self, x: str, n: int) -> str:
        return f"array_to_string(list_slice(list_sort(list({x})), 1, {n}), ',')"

    def overlap(self, x: str, values: str) -> str:
        return f"list_has_any(list(DISTINCT {x}), [{values}])"

    def without(self, x: str, values: str) -> str:
        return f"array_to_string(list_sort(list_filter(list(DISTINCT {x}), lambda y: NOT list_contains([{values}], y))), ',')"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def json(self, **fields: str) -> str:
        inner = ", ".join(f"'{k}': {v}" for k, v in fields.items())
        return f"CAST(to_json({{{inner}}}) AS VARCHAR)"

    def pad(self, x: str, n: str) -> str:
        return f"lpad(CAST({x} AS VARCHAR), CAST({n} AS INTEGER), '0')"

    def best(self, x: str, by: str) -> str:
        return f"arg_max({x}, {by})"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def position(self, x: str, y: str) -> str:
        return f"CAST(instr({x}, {y}) AS BIGINT)"

    double = "\\\\"


def cents(x: str) -> str:
    """Money as whole hundredths: sums of doubles depend on their order."""
    return f"CAST(floor({x} * 100 + 0.5) AS BIGINT)"


def four(x: str) -> str:
    """Four decimals, rounded the same way everywhere."""
    return f"CAST(floor(CAST({x} AS DOUBLE) * 10000 + 0.5) AS DOUBLE) / CAST(10000 AS DOUBLE)"


def key_of_props(x: str = "props") -> str:
    return f"CAST(regexp_extract({x}, '([0-9]+)', 1) AS INT)"
