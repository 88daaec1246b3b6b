"""Text form of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame


def format_table(df: DataFrame, max_rows: int = 50) -> str:
    """Aligned columns. One row beyond ``max_rows`` is fetched, and only when it exists are the rest counted."""
    rows = df.limit(max_rows + 1).collect()
    cells = [["NULL" if v is None else str(v) for v in r] for r in rows[:max_rows]]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(df.columns)]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
    out = [line(df.columns), "-+-".join("-" * w for w in widths), *map(line, cells)]
    if len(rows) > max_rows:
        out.append(f"... ({df.count() - max_rows} more rows)")
    return "\n".join(out)


def to_dicts(df: DataFrame, max_rows: int = 1000) -> list[dict]:
    return [r.asDict() for r in df.limit(max_rows).collect()]
