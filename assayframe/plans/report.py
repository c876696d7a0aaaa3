"""The report: summaries of a run as markdown, from collected tables of a few rows each. There is no overall score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Row, SparkSession

SMALL_CELL = 5
EPSILON = 0.001
#: A difference between graders from which on it counts, and a divergence of standards below which they are hardly two.
MATERIAL, LOW_DIVERGENCE = 0.15, 0.35
#: The sections in their fixed order, what each says first, and the queries whose rows it shows.
SECTIONS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("How to read this", "Every rate has its count beside it; a null is no zero; there is no overall score.", ()),
    ("Diagnostic scores", "Scores by dimension and group, each with its histogram.", ("dimension_stats", "group_stats", "dimension_coverage")),
    ("Family-level behaviour", "Rates of right change verdicts against each arm's noise floor.", ("behaviour_rates", "behaviour_floor", "behaviour_examples")),
    ("Overapplication rate", "Rules broken by cases, over all and by kind; negative controls are always there.", ("flag_families", "flag_scopes")),
    ("Change from baseline", "Paired changes, regressions first.", ("change_by_group", "regression_headline", "worst_slice")),
    ("Worst examples", "Results with zeros, the commonest pattern first, each arm having its share.", ("worst_cases", "zero_patterns")),
    ("Grading reliability and unresolved counts", "Repeats against the grading of record, and what could not be graded.", ("reliability", "flag_agreement", "verdict_flips", "integrity_details", "top_reasons")),
    ("Format premium", "What a change of form alone does to scores.", ("form_premium", "form_premium_by_dimension", "premium_rejections")),
    ("Judge disagreement", "Whether one grader sees a gain that the other doesn't.", ("judge_divergence", "judge_coverage")),
    ("Author effect", "The same answers under a standard written independently.", ("author_shrinkage", "divergence_summary")),
    ("Judge bias audits", "Verbosity and order of presentation.", ("verbosity_pearson", "verbosity_spearman", "verbosity_terciles", "position_balance", "fisher_position")),
    ("Sample counts by scenario family", "Cases by family and kind.", ("family_counts", "kind_rollup")),
    ("Capability results", "Objective checks by family and tag.", ("capability_rates", "capability_by_tag", "capability_failures")),
    ("Run record", "Settings in which arms differ.", ("settings_differences", "settings_disagreement")),
)


def number(value: float | None, places: int = 2) -> str:
    return "n/a" if value is None else f"{value:.{places}f}"


def signed(value: float | None, places: int = 2) -> str:
    return "n/a" if value is None else f"{value:+.{places}f}"


def percent(value: float | None) -> str:
    return "n/a" if value is None else f"{100 * value:.0f} %"


def rate(part: int, whole: int) -> str:
    """A rate with its count, marked where the count is small."""
    return "n/a (0)" if not whole else f"{percent(part / whole)} ({part}/{whole}){'†' if whole < SMALL_CELL else ''}"


def p_value(value: float | None) -> str:
    return "n/a" if value is None else "<0.001" if value < 0.001 else f"{value:.3f}"


def direction(delta: float | None) -> str:
    return "unknown" if delta is None else "level" if abs(delta) <= EPSILON else "better" if delta > 0 else "worse"


def cell(value: object, limit: int = 80) -> str:
    """A value for a table: one line, bars escaped, cut with an ellipsis."""
    text = " ".join(str("" if value is None else value).split()).replace("|", "\\|")
    return text if len(text) <= limit else text[: limit - 1] + "…"


def share_of(part: float | None, whole: float | None) -> str:
    """Which part of a gap another explains: none, all, most, some, little or reversed."""
    if part is None or whole is None or abs(whole) <= EPSILON:
        return "none"
    s = part / whole
    return "reversed" if s < 0 else "all" if s >= 1 else "most" if s >= 0.5 else "some" if s >= 0.2 else "little"


def table(rows: Sequence[Row], columns: Sequence[str]) -> list[str]:
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return head + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]


def changes_section(rows: Sequence[Row]) -> list[str]:
    """Changes from the baseline, regressions first."""
    out = ["## Change from the baseline", ""]
    ordered = sorted(rows, key=lambda r: (r["delta"] or 0, str(r["arm"])))
    for r in ordered:
        mark = "†" if r["small"] else ""
        out.append(f"- {cell(r['arm'])}: {number(r['mean_before'])} to {number(r['mean_after'])} ({signed(r['delta'])}, {direction(r['delta'])}), {r['n']} pairs{mark}, {r['better']} better, {r['worse']} worse, p = {p_value(r['sign_p'])}")
    return out + ["", "† few pairs", ""]


def render(title: str, sections: Sequence[tuple[str, Sequence[Row]]]) -> str:
    """Sections in the order given, each a table or a line that says it is empty."""
    out = [f"# {title}", ""]
    for name, rows in sections:
        out += [f"## {name}", ""] + (table(rows, rows[0].__fields__) if rows else ["No rows."]) + [""]
    return "\n".join(out)


def judge_verdict(differences: Mapping[str, float | None]) -> str:
    """How a grader differs from an independent one on an arm's gain, by groups: flattering on those that matter, harder, or neither."""
    known = {g: v for g, v in differences.items() if v is not None}
    material = {g: v for g, v in known.items() if v >= MATERIAL}
    if material:
        return "flattering on " + ", ".join(f"{g} by {signed(v)}" for g, v in material.items())
    if known and min(known.values()) <= -MATERIAL:
        group = min(known, key=lambda g: known[g])
        return f"harder on {group} by {signed(known[group])}"
    return "no material flattery" if known else "not measured"


def divergence_note(summary: Mapping[str, float | None] | None, rival_cases: int) -> str:
    """What the distance between two standards says of a comparison by them."""
    if summary is None:
        return "no divergence was measured" if rival_cases else ""
    told = f"median {number(summary['upper_median'])}, {number(summary['min'])} to {number(summary['max'])}"
    if summary["upper_median"] is not None and summary["upper_median"] < LOW_DIVERGENCE:
        return f"{told}: a failed measurement, as the standards are hardly two"
    if summary["identical"] or summary["low"]:
        return f"{told}: {summary['low']} near, {summary['identical']} identical"
    return told


def full_report(title: str, tables: Mapping[str, Sequence[Row]], limit: int = 60, totals: Mapping[str, int] | None = None) -> str:
    """All sections in their order, whatever tables there are; a table of more rows than the limit says how many it leaves out. totals: rows of the tables that aren't given whole."""
    out = [f"# {title}", ""]
    for heading, first, names in SECTIONS:
        out += [f"## {heading}", "", first, ""]
        for name in names:
            rows = tables.get(name) or []
            out += [f"### {name.replace('_', ' ')}", ""]
            out += table(rows[:limit], rows[0].__fields__) if rows else ["No rows."]
            n = max(len(rows), (totals or {}).get(name, 0))
            out += ([f"{n - limit} more rows."] if n > limit else []) + [""]
    return "\n".join(out).rstrip() + "\n"


def run_report(spark: SparkSession, sf_dir: str, title: str = "Run", limit: int = 60) -> str:
    """The report over the tables of a run, with the first rows of each query up to the limit, and how many there are beyond."""
    from assayframe.plans import catalogue

    known, tables, totals = catalogue.queries(), {}, {}
    for _, _, names in SECTIONS:
        for name in names:
            df = known[name](spark, sf_dir)
            tables[name] = df.orderBy(*(c for c, kind in df.dtypes if kind != "map")).limit(limit + 1).collect()
            if len(tables[name]) > limit:
                totals[name] = df.count()
    return full_report(title, tables, limit, totals)


def save_report(spark: SparkSession, text: str, path: str) -> None:
    """Writes a report as one text file below path, wherever Spark writes to."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
