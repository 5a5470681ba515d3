"""SQL templates that run on Spark, and in the oracle's dialect for checks.

A template names tables and common table expressions in braces, and the few functions that differ through macros.
"""

from __future__ import annotations

import re

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Macro name -> (Spark, oracle); $1, $2 are arguments.
MACROS = {
    "PCT": ("percentile($1, $2)", "quantile_cont($1, cast($2 as double))"),
    "BROUND": ("bround($1)", "round_even($1, 0)"),
    "AT": ("element_at($1, $2)", "$1[$2]"),
    "SEED": ("cast(cast(conv(substr(sha1($1), 1, 16), 16, 10) as decimal(20, 0)) % $2 as bigint)", "cast(('0x' || substr(sha1($1), 1, 16))::ubigint % $2 as bigint)"),
    "GSUB": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
    "SORTED": ("array_join(sort_array(collect_list($1)), ',')", "array_to_string(list_sort(list($1)), ',')"),
    "STAMP": ("date_format($1, 'yyyyMMdd_HHmmss')", "strftime($1, '%Y%m%d_%H%M%S')"),
    "SPACE": ("'(?U)\\\\s+'", "'[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+'"),
}
_CALL = re.compile(r"@([A-Z]+)(?:\[((?:[^\[\]]|\[[^\[\]]*\])*)\])?")


def render(template: str, spark: bool) -> str:
    def call(m: re.Match) -> str:
        out = MACROS[m[1]][0 if spark else 1]
        for k, arg in enumerate((m[2] or "").split(";"), 1):
            out = out.replace(f"${k}", arg.strip())
        return out

    while _CALL.search(template):
        template = _CALL.sub(call, template)
    return template


def used_tables(template: str) -> list[str]:
    return [t for t in TABLES if f"{{{t}}}" in template]


def spark_query(template: str, made: dict | None = None):
    """A query (spark, sf_dir) -> DataFrame that reads only the tables it names. made: what is made of a table's rows before the SQL sees them, by table."""

    def run(spark, sf_dir):
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used_tables(template)}
        return spark.sql(render(template, True), **{t: (made or {}).get(t, lambda d: d)(d) for t, d in tables.items()})

    return run


def oracle(template: str) -> str:
    out = render(template, False)
    for t in used_tables(template):
        out = out.replace(f"{{{t}}}", t)
    return out.replace("left semi join", "semi join").replace("left anti join", "anti join")
