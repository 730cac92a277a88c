"""Scalar functions that parse and normalise published text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of an absent value, honorifics before names, and the id's form.
NULL_TOKENS = ("", "N/A", "NA", "-", "NULL", "NONE", "NAN")
HONORIFICS = (
    "shri", "shrimati", "smt", "sh", "dr", "mr", "mrs", "ms", "miss", "prof", "professor", "adv", "advocate", "km", "kumari",
    "kum", "maulana", "sardar", "col", "capt", "gen", "justice",
)
WORK_ID = r"^(WS/MP(\d+)/(\d{4}-\d{4})/(\d+))"
CASE_PREFIX = "NG-"

PUBLISHED, NOT_PUBLISHED, PUBLISHED_ZERO, NOT_APPLICABLE = "published", "not_published", "published_zero", "not_applicable"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapsed(c: str | Column) -> Column:
    """Every run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def canonical_work_id(c: str | Column) -> Column:
    return F.upper(F.regexp_replace(_c(c), r"(?U)\s+", ""))


def work_id_parts(c: str | Column) -> dict[str, Column]:
    """canon, mp_code, fy and serial of a published id; all null where it has another form."""
    whole = canonical_work_id(c)
    return {name: _or_null(F.regexp_extract(whole, WORK_ID, i)) for i, name in enumerate(("canon", "mp_code", "fy", "serial"), 1)}


def raw_work_id(c: str | Column) -> Column:
    """The id as it was published, white space inside it kept."""
    gap = r"(?U)\s*"
    spelled = gap.join(("^\\s*(W", "S", "/", "M", r"P(?:\s*\d)+", "/", r"(?:\d\s*){4}-(?:\s*\d){4}", "/", r"(?:\d\s*)*\d)"))
    return _or_null(F.regexp_extract(_c(c), "(?iU)" + spelled.replace("(?U)", ""), 1))


def is_null_token(c: str | Column) -> Column:
    return _c(c).isNull() | F.upper(collapsed(c)).isin(*NULL_TOKENS)


def parsed_amount(c: str | Column) -> Column:
    """struct<value, why>: whole rupees, rounded half to even; a zero is a published value that says so."""
    number = F.expr("null").cast("double") if c is None else F.regexp_replace(_c(c), "[,\\s]", "").try_cast("double")
    value = F.when(~is_null_token(c), F.bround(number, 0).cast("long"))
    why = F.when(value.isNull(), NOT_PUBLISHED).when(value == 0, PUBLISHED_ZERO).otherwise(PUBLISHED)
    return F.struct(value.alias("value"), why.alias("why"))


def malformed_amount(c: str | Column) -> Column:
    return ~is_null_token(c) & F.regexp_replace(_c(c), "[,\\s]", "").try_cast("double").isNull()


def parsed_date(c: str | Column) -> Column:
    """A date in the form 05-Mar-2024, or null."""
    return F.when(~is_null_token(c), F.try_to_date(collapsed(c), "dd-MMM-yyyy"))


def malformed_date(c: str | Column) -> Column:
    return ~is_null_token(c) & parsed_date(c).isNull()


def parsed_text(c: str | Column) -> Column:
    value = F.when(~is_null_token(c), collapsed(c))
    return F.struct(value.alias("value"), F.when(value.isNull(), NOT_PUBLISHED).otherwise(PUBLISHED).alias("why"))


def fy_start_year(c: str | Column) -> Column:
    return F.regexp_extract(_c(c), r"^(\d{4})", 1).try_cast("int")


def member_name(c: str | Column) -> Column:
    """struct<name, term_start, term_end>: the key of a member without honorifics and terms, and the term they state.

    Of several stated terms the last with a four-digit end counts, else the first; a two-digit end is in the start's century.
    """
    terms = F.regexp_extract_all(_c(c), F.lit(r"\((\s*\d{4}\s*-\s*\d{2,4}\s*)\)"), F.lit(1))
    pairs = F.transform(terms, lambda t: F.split(F.regexp_replace(t, r"\s", ""), "-"))
    four = F.filter(pairs, lambda p: F.length(p[1]) == 4)
    pick = F.when(F.size(four) > 0, F.element_at(four, -1)).when(F.size(pairs) > 0, pairs[0])
    start = pick[0].cast("int")
    end = F.when(F.length(pick[1]) == 4, pick[1].cast("int")).otherwise(start - start % 100 + pick[1].cast("int"))
    bare = F.trim(F.regexp_replace(_c(c), r"(?i)\s*\(\s*(?:\d{4}\s*-\s*\d{2,4}|NaN\s*-\s*NaN)\s*\)", ""))
    bare = F.regexp_replace(bare, r"(?i)^(?:(?:" + "|".join(HONORIFICS) + r")\.?\s+)+", "")
    name = F.upper(F.trim(F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z ]+", " "), " +", " ")))
    return F.struct(name.alias("name"), start.alias("term_start"), end.alias("term_end"))


def state_name(c: str | Column) -> Column:
    return collapsed(c)


def upper_name(c: str | Column) -> Column:
    """Districts, constituencies and vendors."""
    return F.upper(collapsed(c))


def description_key(c: str | Column) -> Column:
    """Lower-case letters and digits with single spaces; null if nothing readable is left."""
    return _or_null(F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " ")))


def district_and_agency(c: str | Column) -> Column:
    """struct<district, agency> of DISTRICT(AGENCY_IDA); without brackets all of it is the agency."""
    form = r"(?s)^\s*(.*?)\s*\((.*)\)\s*$"
    bracketed = _c(c).rlike(form)
    agency = F.when(bracketed, F.regexp_extract(_c(c), form, 2)).otherwise(_c(c))
    agency = F.trim(F.regexp_replace(agency, r"(?i)_(?:IDA|\d+)\s*$", ""))
    return F.struct(F.when(bracketed, _or_null(upper_name(F.regexp_extract(_c(c), form, 1)))).alias("district"), agency.alias("agency"))


def agency_key(c: str | Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(_c(c), "[^A-Za-z0-9]+", " ")))


def case_id(canonical: str | Column) -> Column:
    return F.concat(F.lit(CASE_PREFIX), F.upper(F.substring(F.sha2(_c(canonical), 256), 1, 10)))


def cluster_id(agency: str | Column, text: str | Column) -> Column:
    return F.concat(F.lit("DC-"), F.upper(F.substring(F.sha2(F.concat_ws("\u001f", _c(agency), _c(text)), 256), 1, 8)))


def rupees(c: str | Column) -> Column:
    """Digits grouped as 12,34,567, or words where nothing was published."""
    digits = F.abs(_c(c)).cast("long").cast("string")
    head = F.regexp_replace(F.expr("''") if c is None else F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0))), r"(\d)(?=(\d\d)+$)", "$1,")
    grouped = F.when(F.length(digits) > 3, F.concat(head, F.lit(","), F.right(digits, F.lit(3)))).otherwise(digits)
    return F.when(_c(c).isNull(), "an unpublished amount").otherwise(F.concat(F.when(_c(c) < 0, "-").otherwise(""), F.lit("Rs "), grouped))


def crore(c: str | Column) -> Column:
    return F.format_number(_c(c) / 1e7, 2)


def long_date(c: str | Column) -> Column:
    return F.date_format(_c(c), "d MMMM yyyy")


def joined_list(c: str | Column) -> Column:
    """a, b and c."""
    n = F.size(_c(c))
    return F.when(n <= 1, F.array_join(_c(c), "")).otherwise(F.concat(F.array_join(F.slice(_c(c), F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(_c(c), -1)))


def typed(c: str | Column) -> Column:
    """struct<as_bool, as_int, as_float, as_text>: the narrowest reading of a stored text is set."""
    flag = F.when(F.lower(_c(c)).isin("true", "false"), F.lower(_c(c)) == "true")
    whole = F.when(flag.isNull(), _c(c).try_cast("long"))
    number = F.when(flag.isNull() & whole.isNull(), _c(c).try_cast("double"))
    return F.struct(flag.alias("as_bool"), whole.alias("as_int"), number.alias("as_float"), F.when(flag.isNull() & whole.isNull() & number.isNull(), _c(c)).alias("as_text"))
