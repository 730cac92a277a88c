"""A paragraph on a case in a fixed order of sentences, and the words on what could not be read.

No model writes any of it, and the last sentence of each memo says so. What could not be judged is named rule by rule with
its reason: a rule that was skipped says nothing for or against a work. A repeated description asks for a review and is
never called wrong.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import NOT_APPLICABLE, NOT_PUBLISHED, PUBLISHED, PUBLISHED_ZERO, joined_list, long_date, rupees
from .rulebook import SCORE_CAP, Rule, Rulebook
from .scoring import total

NOTICE = "These sentences come from a fixed template; no language model wrote them."
CONTROL = "SYNTHETIC CONTROL: this row was put in to exercise the certification of funds; it is no published work and no total counts it."
#: Rules whose figures stand in the sentences on the sanction, the money and the description, and aren't listed again.
TOLD = ("sanction_delay", "utilisation_shortfall", "stalled_work", "duplicate_work", "split_sanction")
#: What is said of the other rules where they fired: the words, and the decimals of the value in them.
CLAUSES = {
    "execution_delay": ("carrying it out took {value} days, where the limit is {limit}", 0),
    "vendor_concentration": ("one vendor has {value} % of what the agency paid, where the limit is {limit} %", 2),
    "status_payment_mismatch": ("it is reported as completed and no payment for it is published", 0),
    "asset_evidence_missing": ("no picture of the asset was filed", 0),
    "account_underutilisation": ("sanctions stand at {value} % of the member's allocation, where the least is {limit} %", 2),
}
#: Why a rule was not judged, where nothing closer is known of it.
REASONS = {
    NOT_PUBLISHED: "the figure is not published for this work",
    PUBLISHED_ZERO: "the published figure is zero, so nothing can be set against it",
    NOT_APPLICABLE: "the work has not come to the stage that the rule looks at",
}
#: The same by rule and reason, where the general words would say too much.
RULE_REASONS = {
    ("execution_delay", NOT_APPLICABLE): "the work is not reported as completed",
    ("asset_evidence_missing", NOT_PUBLISHED): "only the export of completed works tells of pictures, and it tells nothing on this one",
    ("duplicate_work", NOT_APPLICABLE): "no other work of the agency has a readable description",
    ("duplicate_work", NOT_PUBLISHED): "the work has no readable description",
    ("split_sanction", NOT_PUBLISHED): "the work has no readable description",
    ("vendor_concentration", NOT_APPLICABLE): "the agency paid too little in all for one vendor's share to mean anything",
    ("vendor_concentration", NOT_PUBLISHED): "no payment ties the work to a vendor",
    ("utilisation_shortfall", NOT_PUBLISHED): "no payment for the work is published",
    ("stalled_work", NOT_PUBLISHED): "there is no last payment to count days from",
    ("account_underutilisation", NOT_PUBLISHED): "the member's allocation is not published",
}
#: By feature and reason: what an officer reads where a figure is blank.
DETAILS = {
    ("variance_sanction_to_disbursement", NOT_PUBLISHED): "No published payment belongs to this work.",
    ("variance_disbursement_to_certification", NOT_PUBLISHED): "It takes an amount certified as spent, and none is published.",
    ("execution_days", NOT_APPLICABLE): "The work is not reported as completed, so its days have no end.",
    ("sanction_to_first_payment_days", NOT_APPLICABLE): "No payment is recorded for the work yet.",
    ("first_payment_to_completion_days", NOT_APPLICABLE): "A payment or the completion is still to come, so this lag has one end only.",
    ("days_since_last_payment", NOT_PUBLISHED): "There is no last payment to count days from.",
    ("asset_image_absent", NOT_PUBLISHED): "Only the export of completed works tells of pictures; that it tells nothing does not mean that none was filed.",
    ("duplicate_similarity", NOT_PUBLISHED): "The work has no readable description.",
    ("duplicate_similarity", NOT_APPLICABLE): "No other work of the agency has a readable description.",
    ("same_desc_same_agency_count", NOT_PUBLISHED): "The work has no readable description, or no agency.",
    ("vendor_share_in_agency_pct", NOT_PUBLISHED): "No payment ties the work to a vendor.",
    ("vendor_share_in_agency_pct", NOT_APPLICABLE): "The agency paid no more in all than the floor, below which one vendor's share means nothing.",
    ("mp_utilisation_pct", NOT_PUBLISHED): "The member's allocation is not published.",
    ("completed_without_payment", NOT_PUBLISHED): "The work's status is not published.",
}
#: The same for features without words of their own.
DETAIL_REASONS = {NOT_PUBLISHED: "The figure is not published.", PUBLISHED_ZERO: "The published figure is zero, so no share of it can be formed.", NOT_APPLICABLE: "The work has not come to this stage."}


def name_of(r: Rule) -> str:
    return (r.label or r.id.replace("_", " ")).lower()


def limit_of(r: Rule) -> str:
    return str(r.threshold).lower() if isinstance(r.threshold, bool) else f"{r.threshold:,}"


def _filled(words: str, value: Column, limit: str) -> Column:
    before, *after = words.replace("{limit}", limit).split("{value}")
    return F.concat(F.lit(before), value, F.lit(after[0])) if after else F.lit(before)


def _whole(c: str) -> Column:
    return F.format_number(F.col(c).cast("long"), 0)


def clause(r: Rule) -> Column:
    """What is said of a rule that fired; a rule without words of its own is quoted as its trace has it."""
    words, places = CLAUSES.get(r.id, (f"{name_of(r)} ({{value}} against {{limit}})", 2))
    value = F.col(r.field).cast("string") if isinstance(r.threshold, bool) else F.format_number(F.col(r.field).cast("double"), places)
    return _filled(words, value, limit_of(r))


def unread(r: Rule, why: Column) -> Column:
    """What is said of a rule that was skipped, with the reason; a reason that isn't known is named as such."""
    said = F.coalesce(*[F.when(why == reason, RULE_REASONS.get((r.id, reason), words)) for reason, words in REASONS.items()], F.lit("the reading was not to be had"))
    return F.concat(F.lit(f"{name_of(r)} - "), said)


def _work(c=F.col) -> Column:
    described = F.coalesce(F.concat(F.lit("'"), c("description"), F.lit("'")), F.lit("no published description"))
    on = F.coalesce(long_date("sanction_date"), F.lit("an unpublished date"))
    lag = F.concat(F.lit(", "), _whole("sanction_lag_days"), F.lit(" days after its recommendation of "), F.coalesce(long_date("recommended_date"), F.lit("an unpublished date")))
    by = F.coalesce(F.concat(F.lit(" by "), c("agency")), F.lit(""))
    return F.concat(F.lit("Work "), c("work_id"), F.lit(" ("), described, F.lit(") was sanctioned "), rupees("sanctioned_amt"), F.lit(" on "), on, by, F.coalesce(lag, F.lit("")), F.lit("."))


def _money(c=F.col) -> Column:
    hop = c("variance_sanction_to_disbursement")
    times = F.concat(_whole("payment_count"), F.when(c("payment_count") == 1, " payment").otherwise(" payments"))
    gap = F.concat(F.format_number(F.abs(hop), 2), F.lit(" % "), F.when(hop > 0, "above").otherwise("below"), F.lit(" the sanction"))
    since = F.concat(F.lit("; the last was on "), long_date("last_payment"), F.lit(", "), _whole("days_since_last_payment"), F.lit(" days ago"))
    paid = F.concat(rupees("paid_amt"), F.lit(" was paid in "), times, F.lit(", "), gap, F.coalesce(since, F.lit("")), F.lit("."))
    return F.when(hop.isNotNull(), paid).when(c("payment_count") == 0, "No payment for it is published, so how much of the sanction was drawn is not known.")


def _repeated(status: Column, cited: Column) -> Column:
    count = F.col("same_desc_same_agency_count")
    opening = F.when(count > 1, F.concat(F.lit("The same description stands on "), _whole("same_desc_same_agency_count"), F.lit(" works of the agency"))).otherwise("The description is close to that of other work of the agency")
    named = F.concat(F.lit("; compare "), joined_list(cited), F.lit(" before anything is concluded, as such works are often repeated for good reason."))
    closing = F.when(F.coalesce(F.size(cited), F.lit(0)) > 0, named).otherwise(F.lit(", which asks for a review and is no finding."))
    return F.when(F.coalesce(status["duplicate_work"] == "fired", F.lit(False)) | F.coalesce(status["split_sanction"] == "fired", F.lit(False)), F.concat(opening, closing))


def _pattern(book: Rulebook) -> Column:
    n = F.concat(F.lit("The agency has "), _whole("peer_count"), F.lit(" other HIGH cases in "), F.coalesce("fy", F.lit("an unpublished year")))
    return F.when(F.col("bonus") > 0, F.concat(n, F.lit(", a pattern that adds "), _whole("bonus"), F.lit(" points."))).otherwise(F.concat(n, F.lit(f" of the {book.bonus_least} that a pattern takes; nothing is added for it.")))


def memo(book: Rulebook) -> Column:
    """The memo of a case of this rulebook; sentences with nothing to say are left out.

    Null amounts, dates, descriptions and agencies are said to be unpublished or left out; no null makes a memo null. What
    is read from the trace is read once for a row, as the only element of an array, and not for each of the sentences.
    """
    entry = lambda f: F.map_from_entries(F.transform("trace", lambda t: F.struct(t["rule_id"], t[f])))
    cited = F.get(F.filter("trace", lambda t: t["rule_id"] == "duplicate_work"), F.lit(0))["citation"]["matched"]
    read = F.struct(entry("status").alias("status"), entry("skip_reason").alias("why"), cited.alias("cited"))
    return F.element_at(F.transform(F.array(read), lambda r: _memo(book, r["status"], r["why"], r["cited"])), 1)


def _memo(book: Rulebook, status: Column, why: Column, cited: Column) -> Column:
    pick = lambda wanted, words, rules: F.array_compact(F.array(*[F.when(status[r.id] == wanted, words(r)) for r in rules]))
    others = pick("fired", clause, [r for r in book.rules if r.id not in TOLD])
    skipped = pick("skipped", lambda r: unread(r, why[r.id]), book.rules)
    weight = total(F.col("trace"), "weight", "skipped").cast("string")
    return F.concat_ws(
        " ",
        F.when(F.col("is_synthetic"), CONTROL),
        _work(), _money(), _repeated(status, cited),
        F.when(F.size(others) > 0, F.concat(F.lit("The case also shows that "), joined_list(others), F.lit("."))),
        _pattern(book),
        F.when(F.size(skipped) > 0, F.concat(F.lit("Not evaluated: "), joined_list(skipped), F.lit(". That is "), weight, F.lit(f" of {book.weight_total} points of the rulebook, so the score rests on "), F.col("coverage_pct").cast("string"), F.lit(" % of it; no other rule gets their weight."))),
        F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit(f" of {SCORE_CAP}, "), F.col("severity"), F.lit(", under rulebook "), F.col("rulebook_version"), F.lit(".")),
        F.lit(NOTICE),
    )


def detail(feature: str) -> Column:
    """The words on why a feature has no value; null where it has one."""
    why = F.col(f"{feature}__why")
    return F.coalesce(*[F.when(why == reason, DETAILS.get((feature, reason), words)) for reason, words in DETAIL_REASONS.items()])


def unavailable(features: list[str]) -> Column:
    """array<struct<field, why, detail>> of the features without a value."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}__why").alias("why"), detail(f).alias("detail")) for f in features])
    return F.filter(rows, lambda r: r["why"] != PUBLISHED)
