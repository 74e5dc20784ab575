"""What a change touches, for a reader: sections of text or XML, within a budget of characters."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tokenize_top_level
from ..graph import CodeGraph
from ..operators import changes, lookup, reach

# Limits of what is shown (fixed values).
MAX_FUNCTIONS, MAX_FUNCTIONS_XML, MAX_CALLERS, MAX_CALLEES, MAX_FLOWS, MAX_BLAST, MAX_FOCUS = 30, 15, 5, 8, 3, 6, 5
BUDGET = 20_000


def change_context(new: CodeGraph, changed: DataFrame, old: CodeGraph | None = None, hunks: DataFrame | None = None, max_depth: int = 3, min_confidence: float = 0.5, flow_depth: int = 10, risk: tuple[dict, dict] | None = None) -> dict:
    """All parts of a change's context as DataFrames, by name; ``risk``: weights and caps of the score."""
    out: dict = {}
    contracts = None
    if old is not None:
        out["nodes"], contracts, out["edges"] = changes.diff_nodes(old, new, changed), changes.diff_contracts(old, new, changed), changes.diff_edges(old, new, changed)
        out["contracts"] = contracts
        seeds = out["nodes"].filter("status <> 'removed'").select("qualified_name")
    else:
        seeds = lookup.in_files(new, changed).select("qualified_name").distinct()
    if hunks is not None:
        seeds = seeds.join(changes.hunk_symbols(new, hunks).select("qualified_name"), "qualified_name", "left_semi")
    blast = reach.blast_radius(new, seeds, max_depth, min_confidence, contracts.select("qualified_name").distinct() if contracts is not None else None)
    members = reach.flow_members(new, reach.entry_points(new), flow_depth)
    flows = reach.flows(new, members)
    total = reach.blast_summary(new, seeds, blast)
    out |= {"seeds": seeds, "flows": flows, "blast": reach.score_blast(blast, members, flows), "summary": total, "affected": reach.affected_flows(new, members, seeds), "gaps": lookup.test_gaps(new, changed)}
    out |= {"risk": changes.risk_score(new, changed, total.first()["total_functions"], *(risk or ())), "siblings": changes.siblings(new).join(seeds, "qualified_name", "left_semi"), "inheritance": lookup.inheritance(new, changed), "functions": changes.enriched_functions(new, changed, min_confidence), "imports": lookup.changed_imports(new, changed, old)}
    return out


def params_diff(old: str, new: str) -> str:
    """Short signatures side by side, long ones as the parameters that went and came."""
    if len(old) + len(new) <= 120 and "\n" not in old + new:
        return f"{old} -> {new}"
    a, b = tokenize_top_level(old), tokenize_top_level(new)
    return ", ".join([*(f"-{x}" for x in a if x not in b), *(f"+{x}" for x in b if x not in a)]) or "order changed"


def text(parts: dict, budget: int = BUDGET) -> str:
    """CHANGED, IMPORTS, HIERARCHY and BLAST RADIUS; over budget the last go first, then the rest is cut."""
    risk = parts["risk"].first()
    head = f"RISK {risk['level']} ({risk['score']:.2f})\n"
    rows = parts["functions"].orderBy(F.desc(changes.function_risk(parts["functions"], F.lit(False), F.lit(True))), "qualified_name").limit(MAX_FUNCTIONS).collect()
    sections = {"CHANGED": [f"{r.qualified_name}:{r.line_start} callers={r.callers} callees={r.callees}{'' if r.tested else ' UNTESTED'}" for r in rows]}
    if "contracts" in parts:
        sections["CONTRACTS"] = [f"{r.qualified_name} {r.field}: {params_diff(r.old_value, r.new_value)}" for r in parts["contracts"].orderBy("qualified_name", "field").limit(MAX_FUNCTIONS).collect()]
    sections["IMPORTS"] = [f"{r.file_path} <- {r.target_qualified}{' NEW' if 'is_new' in r and r['is_new'] else ''}{' UNRESOLVED' if r.unresolved else ''}" for r in parts["imports"].orderBy("file_path", "target_qualified").limit(50).collect()]
    sections["HIERARCHY"] = [f"{r.qualified_name} extends {r.extends or '-'} children {len(r.children or [])}" for r in parts["inheritance"].orderBy("qualified_name").limit(50).collect()]
    sections["BLAST RADIUS"] = [f"[{r.depth}] {r.qualified_name} {r.confidence:.2f} {r.category} impact={r.impact_score:.2f}" for r in parts["blast"].orderBy("depth", F.desc("impact_score"), "qualified_name").limit(MAX_BLAST * 3).collect()]
    for drop in (None, "BLAST RADIUS", "IMPORTS"):
        sections.pop(drop, None)
        out = head + "".join(f"\n## {k}\n" + "\n".join(v) + "\n" for k, v in sections.items() if v)
        if len(out) <= budget:
            return out
    return out[:budget]


def xml(parts: dict) -> str:
    """The same as a CallGraph element with what to look at first."""
    risk = parts["risk"].first()
    out = [f"<CallGraph risk={quoteattr(risk['level'])} score={quoteattr(str(risk['score']))}>", "  <ReviewFocus>"]
    out += [f"    <Untested name={quoteattr(r.qualified_name)}/>" for r in parts["gaps"].orderBy("qualified_name").limit(MAX_FOCUS).collect()]
    out.append("  </ReviewFocus>\n  <CriticalPaths>")
    out += [f"    <Path entry={quoteattr(r.entry)} type={quoteattr(r.type)} criticality={quoteattr(str(r.criticality))}/>" for r in parts["flows"].join(parts["affected"], ["entry", "type"], "left_semi").orderBy(F.desc("criticality"), "entry").limit(5).collect()]
    out.append("  </CriticalPaths>")
    out += [f"  <ChangedFunction name={quoteattr(r.qualified_name)} callers=\"{r.callers}\" callees=\"{r.callees}\" tested=\"{str(r.tested).lower()}\"/>" for r in parts["functions"].orderBy(F.desc("callers"), "qualified_name").limit(MAX_FUNCTIONS_XML).collect()]
    out += [f"  <Import file={quoteattr(r.file_path)} target={quoteattr(r.target_qualified)}/>" for r in parts["imports"].orderBy("file_path", "target_qualified").limit(50).collect()]
    out += [f"  <Class name={quoteattr(r.qualified_name)} extends={quoteattr(r.extends or '')}/>" for r in parts["inheritance"].orderBy("qualified_name").limit(50).collect()]
    return "\n".join([*out, "</CallGraph>"]) + "\n"
