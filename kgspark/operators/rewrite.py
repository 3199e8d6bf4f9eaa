"""Edge rewriting passes: each takes and gives edges (seq, src, rel, dst, evidence_text, status, condition, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import MONTHS, any_phrase, name_key, trim
from kgspark.ontology import DEFAULT, Ontology

# Phrases that deny, and the relations that have a negative.
NEGATIONS = ("does not handle", "doesn't handle", "do not handle", "not responsible for", "does not process", "doesn't process", "does not offer", "doesn't offer", "not available", "no contract with")
NEGATIVES = {
    "HANDLES_BILLING_FOR": "DOES_NOT_HANDLE_BILLING_FOR",
    "HANDLES_REIMBURSEMENT_FOR": "DOES_NOT_HANDLE_REIMBURSEMENT_FOR",
    "OFFERS": "DOES_NOT_OFFER",
    "PROCESSES_TESTS_FOR": "DOES_NOT_PROCESS_TESTS_FOR",
    "CONTRACTED_WITH": "NO_CONTRACT_WITH",
}
# Negative relations and the positive ones they override between the same ends.
OVERRIDES = {
    "DOES_NOT_OFFER": "OFFERS",
    "DOES_NOT_WORK_AT": "BASED_AT",
    "NO_CONTRACT_WITH": "CONTRACTED_WITH",
    "DOES_NOT_HANDLE_BILLING_FOR": "HANDLES_BILLING_FOR",
    "DOES_NOT_HANDLE_CLAIMS_FOR": "HANDLES_BILLING_FOR",
    "DOES_NOT_HANDLE_REIMBURSEMENT_FOR": "HANDLES_REIMBURSEMENT_FOR",
    "DOES_NOT_PROCESS_TESTS_FOR": "PROCESSES_TESTS_FOR",
}
# Openings of a condition, in the order they are tried, and signs of a stopgap.
CONDITIONS = ("if ", "when ", "during ", "unless ", "in case ")
STOPGAPS = ("downtime", "redirected", "backup", "fallback", "urgent samples", "unavailable", "emergency")
STOPGAP_RELATIONS = (
    "PROCESSES_TESTS_FOR", "TRANSPORTS_SAMPLES_FOR", "FULFILLS_PRESCRIPTIONS_FOR", "HANDLES_BILLING_FOR", "HANDLES_REIMBURSEMENT_FOR", "PROVIDES_SERVICE_FOR", "PROVIDES_REMOTE_SERVICE_FOR",
)
# Phrases that say what a date is of, in the order of the keys.
TEMPORAL_CUES = {
    "expected_opening": ("expected to open", "scheduled to open", "planned to open", "opening in", "will open", "set to open", "due to open", "to open in"),
    "opened_on": ("opened on", "opened in", "opened its", "launched on", "launched in", "operational since", "open since", "in operation since", "began operations", "started operations"),
    "valid_through": ("valid through", "valid until", "expires on", "expires", "expiration", "valid to", "in effect until", "through "),
    "start_date": ("effective from", "effective on", "effective ", "starting", "commenced on", "commencing", "began on", "start date", "in effect since", "signed on", "entered into on"),
    "end_date": ("ends on", "ending on", "terminates on", "terminated on", "termination date", "expired on"),
    "occurred_on": ("occurred on", "occurred at", "happened on", "took place on", "reported on", "was reported on", "detected on", "resolved on", "incident on"),
}
DATES = (r"\b(\d{4}-\d{2}-\d{2})\b", rf"(?i)\b((?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\b", rf"(?i)\b((?:{MONTHS})\s+\d{{4}})\b", r"(?i)\b(q[1-4]\s+\d{4})\b", r"\b((?:19|20)\d{2})\b")
SCHEDULE = r"(?i)\b(every\s+\w+|daily|weekly|biweekly|monthly|quarterly|annually|twice\s+per\s+\w+|once\s+per\s+\w+)\b"


def _swap(df: DataFrame, flip: Column) -> DataFrame:
    return df.withColumns({"src": F.when(flip, F.col("dst")).otherwise(F.col("src")), "dst": F.when(flip, F.col("src")).otherwise(F.col("dst"))})


def to_canonical(edges: DataFrame, alias_map: DataFrame) -> DataFrame:
    """Both ends lower-cased, trimmed and replaced by the alias's canonical name, one hop each."""
    a = alias_map.select(F.col("alias"), F.col("canonical"))
    x = edges.withColumns({"src": name_key(F.col("src")), "dst": name_key(F.col("dst"))})
    for end in ("src", "dst"):
        b = a.select(F.col("alias").alias(end), F.col("canonical").alias("_to"))
        x = x.join(b, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return x.select(*edges.columns)


def resolve_relations(edges: DataFrame, raw: str = "relation_raw", ontology: Ontology = DEFAULT) -> DataFrame:
    """Edges without a relation get the one their raw relation means: rejected ones and self-loops go, inverses exchange the ends."""
    x = edges.withColumn("_r", F.when(F.coalesce(F.col("rel"), F.lit("")) == "", ontology.resolve(F.col(raw))))
    x = x.where(F.col("_r").isNull() | (F.col("_r.relation") != ""))
    flip = F.coalesce(F.col("_r.flip"), F.lit(False))
    x = _swap(x.withColumn("_f", flip).withColumn("rel", F.coalesce("_r.relation", "rel")), F.col("_f"))
    return x.drop("_r", "_f").where("src != dst")


def negate(rel: Column, evidence: Column) -> Column:
    """The relation, or its negative if the evidence denies it."""
    out = rel
    for pos, neg in NEGATIVES.items():
        out = F.when((rel == pos) & any_phrase(evidence, NEGATIONS), neg).otherwise(out)
    return out


def condition_phrase(evidence: Column) -> Column:
    """The first clause of more than ten bytes that states a condition, or ''."""
    found = []
    for p in CONDITIONS:
        text = F.regexp_extract(evidence, rf"(?is)({p}.*?)(?:,|\.|;| – | — |$)", 1)
        found.append(F.when(F.octet_length(trim(text)) > 10, trim(text)))
    return F.coalesce(*found, F.lit(""))


def annotate_conditions(edges: DataFrame, evidence: str = "evidence_text") -> DataFrame:
    """Status conditional or backup, and the condition, from the evidence."""
    ev = F.col(evidence)
    stopgap, cond = any_phrase(ev, STOPGAPS), any_phrase(ev, ("if ", "when ", "during ", "unless ", "in case"))
    status = F.coalesce("status", F.lit(""))
    eligible = F.col("rel").isin(*STOPGAP_RELATIONS)
    new = (
        F.when(stopgap & eligible & status.isin("", "active", "conditional", "unknown"), "backup").when(stopgap & eligible, status).when((stopgap | cond) & status.isin("", "active"), "conditional").otherwise(status)
    )
    old = F.coalesce("condition", F.lit(""))
    return edges.withColumns({"status": new, "condition": F.when((stopgap | cond) & (old == ""), condition_phrase(ev)).otherwise(old)})


def by_planned_ends(edges: DataFrame, planned: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Relations that have a planned form take it if the planned end is theirs; blank statuses become planned.

    ``planned`` has a column name. ``names``: relation -> 'source' or 'target', the end that decides.
    """
    p = planned.select("name").distinct()
    x = edges.join(p.select(F.col("name").alias("src"), F.lit(True).alias("_s")), "src", "left").join(p.select(F.col("name").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    s, d = F.coalesce("_s", F.lit(False)), F.coalesce("_d", F.lit(False))
    rel = F.when((F.col("rel") == "OFFERS") & s, "PLANNED_SERVICE").when((F.col("rel") == "HAS_BRANCH") & d, "HAS_PLANNED_BRANCH").otherwise(F.col("rel"))
    status = F.when((s | d) & (F.coalesce("status", F.lit("")) == ""), "planned").otherwise(F.col("status"))
    return x.withColumns({"rel": rel, "status": status}).select(*edges.columns)


def repair_planned(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """PLANNED_SERVICE from an entity that is known and not planned becomes OFFERS. ``entities``: (name, planned BOOLEAN)."""
    e = entities.select(F.col("name").alias("src"), F.col("planned").alias("_p"))
    wrong = (F.col("rel") == "PLANNED_SERVICE") & F.coalesce(~F.col("_p"), F.lit(False))
    x = edges.join(e, "src", "left")
    x = x.withColumn("_w", wrong).withColumns({"rel": F.when(F.col("_w"), "OFFERS").otherwise(F.col("rel")), "status": F.when(F.col("_w") & (F.col("status") == "planned"), "active").otherwise(F.col("status"))})
    return x.select(*edges.columns)


#: Statuses of entities that are no branch any more.
GONE = ("historical", "former", "inactive")


def _grams(name: Column, n: int) -> Column:
    """The different stretches of ``n`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(n))))


def is_branch(name: Column, base_types: Column, domain_types: Column, roles: Column, hints: tuple[str, ...]) -> Column:
    """An organisation that its domain type, role or name shows to be a branch."""
    none = F.array().cast("array<string>")
    return F.array_contains(F.coalesce(base_types, none), "organization") & (
        F.exists(F.coalesce(domain_types, none), lambda t: any_phrase(t, hints)) | F.arrays_overlap(F.coalesce(roles, none), F.array(F.lit("branch"), F.lit("operated_unit"))) | any_phrase(name, hints)
    )


def complete_branches(edges: DataFrame, entities: DataFrame, relations: tuple[str, str] = ("HAS_BRANCH", "HAS_PLANNED_BRANCH"), hints: tuple[str, ...] = DEFAULT.branch_hints) -> DataFrame:
    """(src, rel, dst, evidence_text, status) missing between networks and their branches.

    A network is a source of one of ``relations`` (of active, of planned branches). Its branches are the
    entities (name, base_types, domain_types, functional_roles, status) that look like one, are not gone, and
    whose name contains the network's first word, of four bytes or more.

    The theta join "contains" becomes an equi-join on stretches of four characters of the names (two for shorter
    words) with the word's first ones, and a check; only branches take part, and nothing is broadcast.
    """
    linked = edges.where(F.col("rel").isin(*relations)).select("src", "dst").distinct()
    hubs = linked.select("src").distinct().withColumn("word", F.element_at(F.split(trim(F.lower("src")), r"\s+"), 1)).where(F.octet_length("word") >= 4)
    hubs = hubs.withColumn("n", F.when(F.length("word") >= 4, 4).otherwise(2)).withColumn("g", F.substr("word", F.lit(1), F.col("n")))
    none = F.array().cast("array<string>")
    planned = (F.coalesce("status", F.lit("")) == "planned") | F.array_contains(F.coalesce("functional_roles", none), "planned_unit")
    e = entities.where(is_branch(F.col("name"), F.col("base_types"), F.col("domain_types"), F.col("functional_roles"), hints) & ~F.coalesce("status", F.lit("")).isin(*GONE))
    e = e.select(F.col("name").alias("dst"), planned.alias("planned"), F.lower("name").alias("l"))
    e = e.select("dst", "planned", "l", F.explode(F.array(F.lit(4), F.lit(2))).alias("n")).withColumn("g", F.explode(F.when(F.col("n") == 4, _grams(F.col("l"), 4)).otherwise(_grams(F.col("l"), 2))))
    pairs = hubs.join(e, ["n", "g"]).where(F.contains("l", F.col("word")) & (F.col("src") != F.col("dst"))).select("src", "dst", "planned").distinct()
    pairs = pairs.join(linked, ["src", "dst"], "left_anti")
    said = F.concat("src", F.lit(" operates "), "dst", F.lit(" as a branch."))
    return pairs.select("src", F.when(F.col("planned"), relations[1]).otherwise(relations[0]).alias("rel"), "dst", said.alias("evidence_text"), F.when(F.col("planned"), "planned").otherwise("active").alias("status"))


def complete_by_name(edges: DataFrame, names: DataFrame, relations: tuple[str, ...], new: str) -> DataFrame:
    """Missing (src, new, dst) where every name is a branch: see ``complete_branches``."""
    e = names.select("name", F.array(F.lit("organization")).alias("base_types"), F.array().cast("array<string>").alias("domain_types"), F.array(F.lit("branch")).alias("functional_roles"), F.lit("").alias("status"))
    known = edges.where(F.col("rel").isin(*relations)).select("src", F.lit(new).alias("rel"), "dst")
    return complete_branches(known, e, (new, new)).select("src", "rel", "dst")


def dated(edges: DataFrame) -> DataFrame:
    """Edges with what their evidence dates added to ``temporal``; dates that are there already stay."""
    found = temporal_facts(F.col("evidence_text"), F.col("status"), F.col("rel"))
    return edges.withColumn("_t", found).withColumn("temporal", F.map_concat("temporal", F.map_filter("_t", lambda k, v: ~F.map_contains_key(F.col("temporal"), k)))).drop("_t")


def dates_of_targets(edges: DataFrame) -> DataFrame:
    """(name, temporal): the dates of the edges that end at an entity, the first edge (by seq) deciding for each kind."""
    x = edges.select(F.col("dst").alias("name"), "seq", F.explode("temporal").alias("k", "v"))
    x = x.groupBy("name", "k").agg(F.min_by("v", "seq").alias("v"))
    return x.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("temporal"))


def drop_contradicted(edges: DataFrame) -> DataFrame:
    """Without positive edges that a negative one between the same ends overrides."""
    pairs = [F.lit(x) for kv in OVERRIDES.items() for x in kv]
    neg = edges.select("src", "dst", F.try_element_at(F.create_map(*pairs), F.col("rel")).alias("rel")).where("rel is not null").distinct()
    return edges.join(neg, ["src", "rel", "dst"], "left_anti").select(*edges.columns)


def add_inverses(edges: DataFrame) -> DataFrame:
    """The edges, and of those of structure the inverse if it is absent; the first edge (by seq) gives an inverse's other columns."""
    rel = F.when((F.col("rel") == "PART_OF") & (F.col("status") == "planned"), "HAS_PLANNED_BRANCH").when(F.col("rel") == "PART_OF", "HAS_BRANCH").when(F.col("rel").isin("HAS_BRANCH", "HAS_PLANNED_BRANCH"), "PART_OF")
    x = edges.withColumn("_r", rel).where("_r is not null")
    x = x.withColumns({"rel": F.col("_r"), "_s": F.col("dst"), "dst": F.col("src")}).withColumn("src", F.col("_s")).drop("_r", "_s")
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("src", "rel", "dst").orderBy("seq"))).where("_n = 1").drop("_n")
    return edges.unionByName(x.join(edges.select("src", "rel", "dst").distinct(), ["src", "rel", "dst"], "left_anti").select(*edges.columns))


def spread_status(edges: DataFrame, addresses: DataFrame, relation: str = "LOCATED_AT") -> DataFrame:
    """(name, status) of addresses from the edges that end there: active wins over planned."""
    x = edges.where(F.col("rel") == relation).join(addresses.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi")
    x = x.groupBy(F.col("dst").alias("name")).agg(F.max(F.when(F.col("status") == "active", 2).when(F.col("status") == "planned", 1).otherwise(0)).alias("_k"))
    return x.where("_k > 0").select("name", F.when(F.col("_k") == 2, "active").otherwise("planned").alias("status"))


def first_date(text: Column) -> Column:
    """The first date of the most exact form there is: day, written day, month, quarter, year; '' for none."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in DATES]
    return F.coalesce(*found, F.lit(""))


def temporal_facts(text: Column, status: Column, rel: Column) -> Column:
    """MAP of what the text dates: its first date under every cue that occurs, and a schedule."""
    date, low = first_date(text), F.lower(text)
    planned = (F.coalesce(status, F.lit("")) == "planned") | (rel == "HAS_PLANNED_BRANCH")
    items = []
    for key, phrases in TEMPORAL_CUES.items():
        ok = (date != "") & any_phrase(text, phrases)
        if key == "opened_on":
            ok &= ~planned
        if key == "expected_opening":
            ok &= planned | any_phrase(text, ("expected", "scheduled", "planned", "will open"))
        items.append(F.when(ok, F.struct(F.lit(key).alias("k"), date.alias("v"))))
    sched = F.regexp_extract(low, SCHEDULE, 1)
    items.append(F.when((low.contains("schedule") | low.contains("every ")) & (sched != ""), F.struct(F.lit("schedule").alias("k"), sched.alias("v"))))
    return F.map_from_entries(F.array_compact(F.array(*items)))
