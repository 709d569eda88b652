"""Rule tables of the record classifiers, as data: study types with evidence levels, question domains, intents, themes, tags, places and hospitals.

Each table is read twice: by the column expressions in `operators/classifiers.py`, and by `sql()` below, which writes the same rules for DuckDB.
"""

from __future__ import annotations

from marlstone.operators.classifiers import Step
from marlstone.operators.rules import Rule

W = "word"
#: Study types in the order in which they are tried, and the evidence level of each.
STUDY_STEPS = [
    Step("retraction", ("retracted", "retraction of publication"), kind=W), Step("correction", ("erratum", "corrigendum"), kind=W),
    Step("protocol", ("study protocol", "trial protocol", "will be randomized"), kind=W), Step("guideline", ("practice guideline", "clinical guideline"), kind=W),
    Step("consensus", ("consensus statement", "expert consensus", "delphi panel"), kind=W), Step("network_meta_analysis", ("network meta", "indirect comparison"), kind=W),
    Step("meta_analysis", ("meta-analysis", "meta analysis", "pooled analysis"), no_terms=("narrative",), kind=W), Step("systematic_review", ("systematic review",), no_terms=("narrative",), kind=W),
    Step("umbrella_review", ("umbrella review",), kind=W), Step("scoping_review", ("scoping review",), kind=W), Step("post_hoc", ("post hoc", "secondary analysis"), ("trial",), kind=W),
    Step("cluster_rct", ("cluster randomized",), kind=W), Step("crossover_rct", ("crossover",), ("randomized",), kind=W), Step("open_label_rct", ("open-label",), ("randomized",), ("single arm",), W),
    Step("rct", ("double-blind", "placebo-controlled", "randomly assigned"), no_terms=("animal", "mice"), kind=W), Step("non_randomized_trial", ("nonrandomized", "quasi-experimental"), kind=W),
    Step("single_arm", ("single arm", "one-arm"), kind=W), Step("extension", ("extension study", "long-term extension"), kind=W), Step("dose_finding", ("dose escalation", "dose-finding"), kind=W),
    Step("prospective_cohort", ("cohort",), ("prospective",), kind=W), Step("retrospective_cohort", ("cohort", "chart review"), ("retrospective",), kind=W), Step("registry_study", ("registry",), ("patients",), kind=W),
    Step("case_control", ("case-control", "matched controls"), kind=W), Step("cross_sectional", ("cross-sectional", "point prevalence"), kind=W), Step("before_after", ("before-and-after", "interrupted time series"), kind=W),
    Step("case_series", ("case series", "consecutive cases"), kind=W), Step("case_report", ("case report", "we present a case"), kind=W), Step("prediction_model", ("nomogram", "prediction model"), kind=W),
    Step("diagnostic_accuracy", ("sensitivity and specificity", "diagnostic accuracy"), kind=W), Step("cost_effectiveness", ("cost-effectiveness", "budget impact"), kind=W), Step("survey", ("questionnaire", "survey of"), kind=W),
    Step("qualitative", ("focus group", "semi-structured interviews"), kind=W), Step("pharmacovigilance", ("adverse event reports", "disproportionality"), kind=W), Step("mendelian", ("mendelian",), kind=W),
    Step("in_vitro", ("in vitro", "cell line"), no_terms=("patients",), kind=W), Step("animal", ("mice", "rat model", "murine"), kind=W), Step("genetic_association", ("polymorphism", "genome-wide"), kind=W),
    Step("narrative_review", ("narrative review", "review of the literature"), kind=W), Step("editorial", ("editorial", "commentary", "letter to the editor"), kind=W),
]
LEVELS = {
    **dict.fromkeys(("guideline", "meta_analysis", "network_meta_analysis", "systematic_review", "umbrella_review"), "I"),
    **dict.fromkeys(("rct", "cluster_rct", "crossover_rct", "open_label_rct", "consensus"), "II"),
    **dict.fromkeys(("prospective_cohort", "retrospective_cohort", "registry_study", "case_control", "non_randomized_trial", "post_hoc", "extension", "single_arm", "diagnostic_accuracy"), "III"),
    **dict.fromkeys(("cross_sectional", "before_after", "case_series", "case_report", "survey", "pharmacovigilance", "prediction_model", "dose_finding", "mendelian", "cost_effectiveness", "qualitative"), "IV"),
    **dict.fromkeys(("in_vitro", "animal", "genetic_association", "narrative_review", "editorial", "scoping_review", "protocol"), "V"),
}
#: Texts that state a design of their own, and words beside them that show it is somebody else's.
RANDOM, DERIVED = r"randomi[sz]ed|randomly assigned", r"meta-analysis|previous trials|published trials|were pooled"
BEFORE, AFTER = 90, 180
NUMBERS = [r"\bn\s*=\s*(\d{2,6})\b", r"\b(\d{2,6})\s+(?:patients|participants|subjects)\b", r"\benrolled\s+(\d{2,6})\b"]
DOMAINS = [
    Step("prognosis", ("overall survival", "mortality", "prognostic"), kind=W), Step("prediction", ("nomogram", "prediction model"), kind=W), Step("diagnosis", ("diagnostic accuracy", "sensitivity and specificity"), kind=W),
    Step("prevalence", ("point prevalence", "incidence of"), kind=W), Step("safety", ("adverse event reports", "disproportionality", "tolerability"), kind=W), Step("mechanism", ("polymorphism", "cell line", "pathway"), kind=W),
    Step("scale", ("questionnaire", "reliability of the scale"), kind=W), Step("therapy", ("randomized", "placebo-controlled", "single arm"), kind=W),
]
INTENTS = [
    Step("subtype", ("subgroup", "phenotype"), kind=W), Step("access", ("cost-effectiveness", "budget impact", "reimbursement"), kind=W), Step("burden", ("point prevalence", "incidence of"), kind=W),
    Step("experience", ("questionnaire", "focus group"), kind=W), Step("device", ("diagnostic accuracy",), no_terms=("drug",), kind=W), Step("safety", ("adverse event reports", "tolerability"), kind=W),
    Step("biology", ("in vitro", "murine", "pathway"), no_terms=("patients",), kind=W), Step("outcome", ("overall survival", "mortality"), kind=W), Step("evidence", ("systematic review", "meta-analysis"), kind=W),
    Step("practice", ("practice guideline", "expert consensus"), kind=W),
]
#: Cluster keys: agents come before themes.
CLUSTERS = [
    Step("agent:veltoran", ("veltoran",), kind=W), Step("agent:mirapexin", ("mirapexin", "mira-101"), kind=W), Step("agent:dorsuvimab", ("dorsuvimab",), kind=W), Step("agent:combined", ("add-on",), ("standard care",), kind=W),
    Step("guidance", ("practice guideline", "expert consensus"), kind=W), Step("access", ("cost-effectiveness", "budget impact"), kind=W), Step("safety", ("adverse event reports", "tolerability"), kind=W), Step("trial", ("randomized", "placebo-controlled", "single arm"), kind=W),
    Step("cohort", ("cohort", "registry"), kind=W), Step("diagnosis", ("diagnostic accuracy", "nomogram"), kind=W), Step("burden", ("point prevalence", "mortality"), kind=W), Step("biology", ("polymorphism", "cell line", "murine"), kind=W),
    Step("synthesis", ("systematic review", "meta-analysis"), kind=W), Step("patient", ("questionnaire", "focus group"), kind=W), Step("case", ("case series", "case report"), kind=W), Step("opinion", ("editorial", "narrative review"), kind=W),
]
TAGS = [Rule("veltoran", "veltoran", kind=W), Rule("mirapexin", "mirapexin", kind=W), Rule("mirapexin", "mira-101", kind=W), Rule("dorsuvimab", "dorsuvimab", kind=W), Rule("standard", "standard care", kind=W), Rule("placebo", "placebo", kind="substring")]
ALIASES = {"veltoran": "Veltoran", "vlt-7": "Veltoran", "mirapexin": "Mirapexin", "mira-101": "Mirapexin", "dorsuvimab": "Dorsuvimab", "placebo": "", "standard care": "", "saline": ""}
#: Places by terms of a label; a region's towns come before the region, later rules are coarser.
PLACES = [("riverton", "North/Riverton"), ("oakham", "North/Oakham"), ("saltby", "South/Saltby"), ("millford", "South/Millford"), ("northern region", "North"), ("southern region", "South")]
COUNTRIES = [("freedonia", "Freedonia"), ("ruritania", "Ruritania"), ("sylvania", "Sylvania")]
#: Hospital names that stand for another one.
OVERRIDES = {"riverton first hospital": "Riverton General Hospital", "people's hospital of oakham": "Oakham People's Hospital"}

#: What the fixture's records say: a design phrase and a context phrase are dealt to each document by its id.
DESIGNS = [t for s in STUDY_STEPS for t in (" ".join([s.any_terms[0], *s.all_terms]), " ".join([s.any_terms[-1], *s.all_terms, *s.no_terms]))]
CONTEXTS = [
    "We enrolled 240 patients and report overall survival.", "Data were drawn from published trials and were pooled.", "A sample (n = 88) answered a questionnaire; tolerability was good.", "Mortality among 1500 participants fell under veltoran.",
    "The pathway was studied in a cell line; mira-101 was added.", "Add-on dorsuvimab was compared with standard care.", "Budget impact and incidence of relapse are given.", "No further detail.",
]
AFFILIATIONS = [
    "Department of Medicine, Riverton First Hospital, Riverton, Freedonia", "School of Nursing, University of Saltby, Southern Region", "People's Hospital of Oakham; Oakham", "Institute of Data, Ruritania", "Northern Region Health Board, Millford General Hospital",
    "Sylvania Cancer Centre", "Unit 7",
]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit_sql(column: str, terms: tuple[str, ...], kind: str) -> str:
    """Whether a column has one of the terms."""
    import re

    one = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in terms)
    return f"regexp_matches({column}, {quoted(rf'(^|[^\p{{L}}\p{{N}}])({one})($|[^\p{{L}}\p{{N}}])' if kind == W else one)})"


def step_sql(column: str, s: Step) -> str:
    parts = [hit_sql(column, s.any_terms, s.kind)] if s.any_terms else []
    parts += [hit_sql(column, (t,), s.kind) for t in s.all_terms]
    parts += [f"NOT {hit_sql(column, s.no_terms, s.kind)}"] if s.no_terms else []
    return "(" + " AND ".join(parts) + ")"


def cascade_sql(column: str, steps: list[Step], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {step_sql(column, s)} THEN {quoted(s.label)}" for s in steps) + f" ELSE {quoted(default)} END"


def flags_sql(column: str, steps: list[Step]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {step_sql(column, s)} THEN {quoted(s.label)} END" for s in steps) + "], lambda x: x IS NOT NULL), ',')"


def map_sql(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {quoted(default)} END"


def choice_sql(values: list[str], index: str) -> str:
    return "[" + ", ".join(map(quoted, values)) + f"][1 + {index} % {len(values)}]"
