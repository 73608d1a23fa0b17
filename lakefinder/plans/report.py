"""Results as JSON, Markdown and text; for the few rows that a search returns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from lakefinder.plans.discover import Found

SHOWN = 5


def rows(found: Found, k: int = 10) -> list[dict]:
    """The best k tables of each query with their column matches."""
    best = found.tables
    best = best.where(best["rank"] <= k) if "rank" in best.columns else best.limit(k)
    out = [r.asDict() for r in best.orderBy("query_table", "rank" if "rank" in best.columns else "table_name").collect()]
    by_table: dict[tuple[str, str], list[dict]] = {}
    if found.matches is not None:
        own = found.matches.join(best.select("query_table", "table_name"), ["query_table", "table_name"], "left_semi")
        for m in own.orderBy(own["confidence"].desc(), "query_column", "column_name").collect():
            by_table.setdefault((m.query_table, m.table_name), []).append({"source": m.query_column, "target": m.column_name, "confidence": m.confidence, "match_type": m.match_type})
    return [{"source_table": r["query_table"], "target_table": r["table_name"], "score": r["score"], "matched_columns": by_table.get((r["query_table"], r["table_name"]), [])} for r in out]


def as_json(found: Found, k: int = 10) -> str:
    listed = rows(found, k)
    return json.dumps({"strategy": found.strategy, "results_count": len(listed), "results": listed, "final_report": as_text(found, k, listed), "errors": found.errors[-3:]}, indent=2, ensure_ascii=False)


def as_markdown(found: Found, k: int = 10) -> str:
    """A heading for each table, with its ``SHOWN`` best column matches."""
    out = [f"# Tables found ({found.strategy})", ""]
    for i, r in enumerate(rows(found, k), 1):
        out += [f"## {i}. {r['target_table']}", "", f"Score {r['score']:.2f} for {r['source_table']}", ""]
        out += [f"- {m['source']} = {m['target']} ({m['confidence']:.2f}, {m['match_type']})" for m in r["matched_columns"][:SHOWN]]
        out += [""] * bool(r["matched_columns"])
    return "\n".join(out)


def as_text(found: Found, k: int = 10, listed: list[dict] | None = None) -> str:
    """A table of plain text: at most ten tables, three columns of each."""
    listed = rows(found, k) if listed is None else listed
    if not listed:
        return "\n".join(["No tables found.", *found.errors[-3:]])
    out = [f"{'query':<24} {'table':<24} {'score':>8}  columns"]
    for r in listed[:10]:
        cols = ", ".join(f"{m['source']}={m['target']}" for m in r["matched_columns"][:3])
        out.append(f"{r['source_table']:<24} {r['target_table']:<24} {r['score']:>8.2f}  {cols}")
    return "\n".join(out)


FORMATS = {"json": as_json, "markdown": as_markdown, "table": as_text}


def write(found: DataFrame, path: str) -> None:
    """Result rows as JSON lines, for results that no driver should hold."""
    found.write.mode("overwrite").json(path)
