"""Checks as Column predicates, true where a row violates the rule.

``f`` maps the rule's fields to columns (only those that exist), ``p`` are the
rule's options, ``today`` a date literal so that rules about now can be fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import codes
from .packs import Rule

Fields = dict[str, Column]
CHECKS: dict[str, Callable[[Rule, Fields, dict], Column]] = {}
#: Checks that need all their fields; the others need the first.
NEEDS_ALL = {"balanced", "not_both_sided", "content_uom", "departure_after_arrival", "rising", "deceased_after_birth", "not_before", "not_future_when_finished", "under_a_year_when_finished", "in_school_year", "both_present", "year_matches"}


def check(name: str):
    """Registers ``fn(rule, fields, context) -> Column`` under ``name``; also for own rules."""

    def put(fn):
        CHECKS[name] = fn
        return fn

    return put


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for x in parts:
        out |= F.coalesce(x, F.lit(False))
    return out


def blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x.cast("string")) == "")


def code_list(rule: Rule) -> tuple[str, ...]:
    kind = rule.params.get("set")
    if kind == "countries":
        return codes.countries()
    if kind == "territories":
        return (*codes.countries(False), "Worldwide")
    return tuple(rule.params["codes"])


@check("not_null")
def _(rule, f, ctx):
    return _any([x.isNull() for x in f.values()])


@check("required")
def _(rule, f, ctx):
    return F.lit(False)


@check("regex")
def _(rule, f, ctx):
    x = next(iter(f.values()))
    return x.isNotNull() & ~x.cast("string").rlike(rf"\A(?:{rule.params['pattern']})\z")


@check("codes")
def _(rule, f, ctx):
    x = next(iter(f.values()))
    known = code_list(rule)
    if rule.params.get("fold"):
        return x.isNotNull() & ~F.lower(F.trim(x.cast("string"))).isin(*(k.lower() for k in known))
    return x.isNotNull() & ~x.cast("string").isin(*known)


@check("range")
def _(rule, f, ctx):
    x = next(iter(f.values()))
    n = X.number(x)
    bad = n.isNull()
    if "min" in rule.params:
        bad |= n < rule.params["min"]
    if "max" in rule.params:
        bad |= n > rule.params["max"]
    return x.isNotNull() & bad


@check("unique")
def _(rule, f, ctx):
    return ctx["flagged"].isNotNull()


@check("iso_date")
def _(rule, f, ctx):
    return _any([x.isNotNull() & X.iso_date(x).isNull() for x in f.values()])


@check("iso_datetime")
def _(rule, f, ctx):
    return _any([x.isNotNull() & X.iso_timestamp(x).isNull() for x in f.values()])


@check("fhir_date")
def _(rule, f, ctx):
    x = next(iter(f.values()))
    return x.isNotNull() & X.iso_date(x).isNull() & ~X.partial_date(x)


@check("iso_or_partial")
def _(rule, f, ctx):
    return CHECKS["fhir_date"](rule, f, ctx)


@check("partial_date")
def _(rule, f, ctx):
    return X.partial_date(next(iter(f.values())))


@check("not_future")
def _(rule, f, ctx):
    return X.iso_timestamp(next(iter(f.values()))).cast("date") > ctx["today"]


@check("nonneg_2dp")
def _(rule, f, ctx):
    def bad(x):
        n = X.number(x)
        return x.isNotNull() & (n.isNull() | (n < 0) | (F.abs(n * 100 - F.bround(n * 100)) > 1e-6))

    return _any([bad(x) for x in f.values()])


@check("balanced")
def _(rule, f, ctx):
    return ctx["flagged"].isNotNull()


@check("not_both_sided")
def _(rule, f, ctx):
    a, b = (X.number(f[k]) for k in rule.fields)
    return (a != 0) & (b != 0)


@check("gtin_length")
def _(rule, f, ctx):
    x = next(iter(f.values())).cast("string")
    return x.isNotNull() & ~x.rlike(r"^(\d{8}|\d{12,14})$")


@check("gtin_check")
def _(rule, f, ctx):
    x = next(iter(f.values())).cast("string")
    return F.when(x.rlike(r"^(\d{8}|\d{12,14})$"), ~X.gs1_valid(x))


@check("gln_check")
def _(rule, f, ctx):
    x = next(iter(f.values())).cast("string")
    return x.isNotNull() & ~F.when(x.rlike(r"^\d{13}$"), X.gs1_valid(x)).otherwise(False)


@check("icpn")
def _(rule, f, ctx):
    raw = next(iter(f.values()))
    x = F.regexp_replace(raw.cast("string"), r"\D", "")
    return raw.isNotNull() & ~F.when(x.rlike(r"^\d{12,13}$"), X.gs1_valid(x)).otherwise(False)


@check("nonnull_maxlen")
def _(rule, f, ctx):
    x = next(iter(f.values()))
    return x.isNull() | (F.length(x.cast("string")) > rule.params["max"])


@check("content_uom")
def _(rule, f, ctx):
    content, uom = (f[k] for k in rule.fields)
    return ~blank(uom) != F.coalesce(X.number(content) > 0, F.lit(False))


@check("number_in")
def _(rule, f, ctx):
    x = next(iter(f.values()))
    return x.isNotNull() & ~F.coalesce(X.number(x).isin(*(float(v) for v in rule.params["values"])), F.lit(False))


@check("gtfs_time")
def _(rule, f, ctx):
    return _any([x.isNotNull() & ~F.trim(x.cast("string")).rlike(r"^\d{1,3}:[0-5]\d:[0-5]\d$") for x in f.values()])


def seconds(x: Column) -> Column:
    """Seconds of a HH:MM:SS text, hours beyond 24 included; else null."""
    s = F.trim(x.cast("string"))
    part = lambda i: F.split(s, ":").getItem(i).cast("int")
    return F.when(s.rlike(r"^\d{1,3}:[0-5]\d:[0-5]\d$"), part(0) * 3600 + part(1) * 60 + part(2))


@check("departure_after_arrival")
def _(rule, f, ctx):
    arrival, departure = (seconds(f[k]) for k in rule.fields)
    return departure < arrival


@check("rising")
def _(rule, f, ctx):
    trip, seq = f[rule.fields[0]], X.number(f[rule.fields[1]])
    w = Window.partitionBy(trip, F.when(trip.isNull(), ctx["rid"])).orderBy(ctx["rid"]).rowsBetween(Window.unboundedPreceding, -1)
    return trip.isNotNull() & (seq <= F.last(seq, True).over(w))


@check("deceased_after_birth")
def _(rule, f, ctx):
    deceased, birth = (X.iso_timestamp(f[k]) for k in rule.fields)
    return deceased < birth


@check("age")
def _(rule, f, ctx):
    years = F.datediff(ctx["today"], X.iso_timestamp(next(iter(f.values()))).cast("date")) / 365.25
    return (years < 0) | (years > 150)


@check("loinc")
def _(rule, f, ctx):
    code, system = f[rule.fields[0]], ctx["all"].get("code_system")
    if system is None:
        return F.lit(False)
    return (F.trim(system.cast("string")) == "http://loinc.org") & code.isNotNull() & ~F.trim(code.cast("string")).isin(*codes.LOINC)


@check("nonneg_number")
def _(rule, f, ctx):
    x = next(iter(f.values()))
    n = X.number(x)
    return x.isNotNull() & (n.isNull() | (n < 0))


@check("at_least_one")
def _(rule, f, ctx):
    out = next(iter(f.values())).isNull()
    other = ctx["all"].get(rule.params["others"])
    return out if other is None else out & other.isNull()


@check("requires")
def _(rule, f, ctx):
    other = ctx["all"].get(rule.params["other"])
    return next(iter(f.values())).isNotNull() & (F.lit(True) if other is None else other.isNull())


@check("requires_when")
def _(rule, f, ctx):
    other = ctx["all"].get(rule.params["other"])
    hit = F.lower(F.trim(next(iter(f.values())).cast("string"))) == rule.params["equals"].lower()
    return hit & (F.lit(True) if other is None else other.isNull())


@check("not_before")
def _(rule, f, ctx):
    a, b = (X.iso_timestamp(f[k]) for k in rule.fields)
    return a < b


def _finished(ctx) -> Column:
    status = ctx["all"].get("status")
    return F.lit(False) if status is None else F.lower(F.trim(status.cast("string"))) == "finished"


@check("not_future_when_finished")
def _(rule, f, ctx):
    return _finished(ctx) & _any([X.iso_timestamp(x).cast("date") > ctx["today"] for x in f.values()])


@check("under_a_year_when_finished")
def _(rule, f, ctx):
    start, end = (X.iso_timestamp(f[k]) for k in rule.fields)
    return _finished(ctx) & (F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400) >= 365)


@check("year_to")
def _(rule, f, ctx):
    x = next(iter(f.values()))
    n = X.number(x)
    return x.isNotNull() & (n.isNull() | (n != F.floor(n)) | (n < 1900) | (n > F.year(ctx["today"]) + int(rule.params["ahead"])))


@check("in_school_year")
def _(rule, f, ctx):
    day, year = X.iso_date(f[rule.fields[0]]), X.number(f[rule.fields[1]]).cast("int")
    inside = day.between(F.make_date(year - 1, F.lit(7), F.lit(1)), F.make_date(year, F.lit(6), F.lit(30)))
    return F.when(year.between(1900, 2100), ~inside)


@check("both_present")
def _(rule, f, ctx):
    a, b = (f[k] for k in rule.fields)
    return a.isNull() != b.isNull()


@check("numeric")
def _(rule, f, ctx):
    x = next(iter(f.values()))
    return x.isNotNull() & X.number(x).isNull()


@check("not_negative")
def _(rule, f, ctx):
    return X.number(next(iter(f.values()))) < 0


@check("positive")
def _(rule, f, ctx):
    x = next(iter(f.values()))
    n = X.number(x)
    return x.isNotNull() & (n.isNull() | (n <= 0))


@check("only_when_harvest")
def _(rule, f, ctx):
    op = ctx["all"].get("operation_type")
    harvest = F.lit(False) if op is None else F.coalesce(F.lower(F.trim(op.cast("string"))) == "harvesting", F.lit(False))
    return next(iter(f.values())).isNotNull() & ~harvest


@check("year_matches")
def _(rule, f, ctx):
    day, season = X.iso_timestamp(f[rule.fields[0]]), X.number(f[rule.fields[1]])
    return F.year(day) != season


@check("eidr")
def _(rule, f, ctx):
    x = next(iter(f.values())).cast("string")
    return x.isNotNull() & ~F.coalesce(X.eidr_valid(F.trim(x)), F.lit(False))


@check("positive_integer")
def _(rule, f, ctx):
    def bad(x):
        n = X.number(x)
        return x.isNotNull() & (n.isNull() | (n <= 0) | (n != F.bround(n)))

    return _any([bad(x) for x in f.values()])


@check("no_episode_of_movie")
def _(rule, f, ctx):
    kind = F.lower(F.trim(next(iter(f.values())).cast("string")))
    parts = [ctx["all"][k].isNotNull() for k in ("season_number", "episode_number") if k in ctx["all"]]
    return kind.isin("movie", "short") & _any(parts)


@check("single_tracks")
def _(rule, f, ctx):
    kind = ctx["all"].get("release_type")
    n = X.number(next(iter(f.values())))
    return F.lit(False) if kind is None else (F.lower(F.trim(kind.cast("string"))) == "single") & ((n < 1) | (n > 3))


# -- rules over groups: the keys that violate them, from one grouped aggregate

GROUPS: dict[str, Callable[[Rule, Fields], Column]] = {
    "unique": lambda rule, f: F.count(F.lit(1)) > 1,
    "balanced": lambda rule, f: F.abs(F.sum(F.coalesce(X.number(f[rule.fields[1]]), F.lit(0.0))) - F.sum(F.coalesce(X.number(f[rule.fields[2]]), F.lit(0.0)))) > rule.params["tolerance"],
}


# -- repairs: the new value of the rule's first field, null to leave it -------

REPAIRS: dict[str, Callable[[Rule, Column], Column]] = {}


def repair(name: str):
    def put(fn):
        REPAIRS[name] = fn
        return fn

    return put


@repair("loose_date")
def _(rule, x):
    s = F.trim(x.cast("string"))
    a, b = (F.regexp_extract(s, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}$", i).try_cast("int") for i in (1, 2))
    unclear = F.coalesce((a <= 12) & (b <= 12) & (a != b), F.lit(False))
    forms = ("M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d", "yyyy.M.d", "yyyy-M-d", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    day = F.coalesce(*(F.try_to_timestamp(s, F.lit(k)) for k in forms))
    return F.when(~unclear, F.date_format(day, "yyyy-MM-dd"))


@repair("digits")
def _(rule, x):
    s = F.regexp_replace(x.cast("string"), r"\D", "")
    return F.when(s.rlike(r"^(\d{8}|\d{12,14})$"), F.when(X.gs1_valid(s), s))


@repair("code_case")
def _(rule, x):
    key = F.lower(F.trim(x.cast("string")))
    return F.element_at(F.create_map(*(F.lit(v) for k in code_list(rule) for v in (k.lower(), k))), key)


@repair("unit")
def _(rule, x):
    table = {k.lower(): v for k, v in rule.params["spellings"].items()} | {k.lower(): k for k in code_list(rule)}
    return F.element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), F.lower(F.trim(x.cast("string"))))
