"""Reference-style column names for the version pivots.

Operators name the two SDK versions generically (``n_base``, ``br_cand``)
so any version pair works. ``reference_names`` renames them the way the
reference's result sets do, after the version numbers (``n_v81``,
``br_v82``), for users comparing against those outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def version_tag(version: str) -> str:
    """'8.1.0' -> 'v81': major and minor digits."""
    parts = version.split(".")
    return "v" + "".join(parts[:2])


def reference_names(df: DataFrame, base: str, cand: str) -> DataFrame:
    """Rename ``*_base`` / ``*_cand`` columns to ``*_<tag>`` of each version."""
    tags = {"_base": version_tag(base), "_cand": version_tag(cand)}
    renames = {}
    for c in df.columns:
        for suffix, tag in tags.items():
            if c.endswith(suffix):
                renames[c] = c[: -len(suffix)] + "_" + tag
    return df.withColumnsRenamed(renames) if renames else df
