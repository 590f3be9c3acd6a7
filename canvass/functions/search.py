"""Catalog search: topics of dockets, hints, expansions and match scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canvass.functions import text as X

#: Topic of an agency's dockets (fixed values); others are "the-economy".
AGENCY_TOPICS = {
    "FCC": "tech-regulation", "FTC": "tech-regulation", "NHTSA": "tech-regulation", "EPA": "climate", "CMS": "health-care", "HHS": "health-care",
    "HHS-OCR": "health-care", "FDA": "health-care", "DEA": "health-care", "CFPB": "banking-and-lending", "DOL": "labor", "OSHA": "labor",
}
#: Words that are no search terms (fixed values), and the score from which the best row of a search is taken.
QUERY_STOPWORDS = "and are for how into non our regulation regulations rule rules that the this want what with".split()
ACCEPTED_SCORE = 10
#: Patterns of a query that name an agency, in order (fixed values).
AGENCY_HINTS = (
    ("FCC", r"\bfcc\b|internet|broadband|neutrality"), ("EPA", r"\bepa\b|climate|methane|emission|water|pollution"),
    ("CMS", r"\bcms\b|health|medicare|medicaid|drug|hospital"), ("CFPB", r"\bcfpb\b|payday|overdraft|credit|lending|bank"),
    ("DOL", r"\bdol\b|overtime|wage|worker|labor"), ("ED", r"\bed\b|education|student|school|college|loan"),
    ("FTC", r"\bftc\b|non compete|competition|consumer protection"),
)
#: Patterns of a query and the searches they add (fixed values).
EXPANSIONS = (
    (r"drug|prescription|medicine|pharma|pricing|price", ("drug pricing", "prescription drug prices", "cms price transparency")),
    (r"student|loan|college|borrower", ("student loans", "borrower defense", "education student loans")),
    (r"methane|carbon|emission|climate", ("methane emissions", "greenhouse gas emissions", "epa methane")),
    (r"overtime|wage|worker|labor|salary", ("overtime wages", "fair labor standards", "dol overtime")),
    (r"non\s*compete|compete|competition|workplace freedom", ("non compete ban", "non-compete clause", "workplace freedom")),
    (r"net\s*neutral|broadband|internet", ("net neutrality", "open internet", "broadband internet")),
    (r"payday|overdraft|credit|lending|bank", ("payday lending", "consumer finance", "banking lending")),
)


def topic_of_agency(agency: Column, docket: Column, manual: dict[str, str] | None = None) -> Column:
    """A docket's own topic if it is given, else its agency's."""
    out = F.lit("the-economy")
    for name, topic in AGENCY_TOPICS.items():
        out = F.when(F.upper(agency) == name, topic).otherwise(out)
    for name, topic in (manual or {}).items():
        out = F.when(docket == name, topic).otherwise(out)
    return out


def plain_text(text: Column) -> Column:
    """Lower case with every run of other characters than a to z and 0 to 9 as one space, trimmed; null is empty."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def query_terms(query: Column) -> Column:
    """Words of the plain query of over two letters that are not stopwords, in order, repeats included."""
    return F.filter(F.split(plain_text(query), " "), lambda w: (F.length(w) > 2) & ~w.isin(*QUERY_STOPWORDS))


def agency_hint(query: Column) -> Column:
    """The agency that a query names, by the first pattern that its plain text has; null without one."""
    low = plain_text(query)
    return F.coalesce(*[F.when(low.rlike(pattern), name) for name, pattern in AGENCY_HINTS])


def expansions(query: Column) -> Column:
    """The query itself, its terms as one search, and what its plain text adds, each once."""
    low, out = plain_text(query), [F.array(F.coalesce(query, F.lit("")), F.array_join(query_terms(query), " "))]
    for pattern, more in EXPANSIONS:
        out.append(F.when(low.rlike(pattern), F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(F.concat(*out), X.strip), lambda q: q != ""))


def accepted(score: Column) -> Column:
    """Whether the best row of a search is good enough."""
    return score >= ACCEPTED_SCORE


def match_score(title: Column, tags: Column, summary: Column, docket: Column, comments: Column, agency: Column, query: Column, terms: Column, phrases: Column) -> Column:
    """Score of a catalog row for a query: exact phrases, term hits, size, and the agency that the query names.

    Titles, tags, summaries and ids are compared as plain text; ``terms`` and ``phrases`` are taken to be plain already.
    """
    t, g, s, k = map(plain_text, (title, tags, summary, docket))
    hits = lambda c: F.size(F.filter(terms, lambda w: F.contains(c, w)))
    points = lambda c, n: n * F.size(F.filter(phrases, lambda p: (p != "") & F.contains(c, p)))
    enough = F.least(F.lit(2), F.size(terms))
    some = F.size(terms) > 0
    score = points(t, 80) + points(g, 55) + points(s, 30) + hits(t) * 18 + hits(g) * 12 + hits(s) * 5 + hits(k) * 4
    score = score + F.when(some & (hits(t) >= enough), 35).otherwise(0) + F.when(some & (hits(t) + hits(g) >= enough), 20).otherwise(0)
    size = F.least(F.lit(8.0), F.log10(F.greatest(F.lit(1.0), F.coalesce(comments, F.lit(0)).cast("double"))) * 2)
    return score + size + F.when(F.upper(agency) == agency_hint(query), 25).otherwise(0)
