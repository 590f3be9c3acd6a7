"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four information separators: broader than Java's ``\s``.
WS = r"[\s\x1c-\x1f\x85\p{IsWhite_Space}]"
SENTENCE_END = r"(?<=[.!?])" + WS + "+"
PREVIEW_CHARS = 500
COVER_NOTE_CHARS = 100
#: Phrases of a cover note (fixed values).
COVER_PHRASES = (
    "see attached", "see attachment", "attached please find", "please find attached", "attached file",
    "submission attached", "find attached", "attached is my comment", "see file", "attached pdf",
    "comments are attached", "attached hereto", "letter attached", "document attached",
)
#: Words that a search leaves out (fixed values).
STOPWORDS = (
    "and", "are", "for", "how", "into", "non", "our", "regulation", "regulations", "rule", "rules", "that", "the",
    "this", "want", "what", "with",
)
#: First rule whose words occur decides the topic: words, topic, tags (fixed values).
TOPIC_RULES = (
    (("methane", "climate", "emissions", "greenhouse"), "oil_and_gas", ("Climate", "Environment", "Methane")),
    (("neutrality", "broadband", "common carrier", "telecom"), "telecom", ("Telecom", "Net Neutrality", "Open Internet")),
    (("payday", "installment", "loans", "custody", "asset"), "finance", ("Finance", "Loans", "Consumer Protection")),
    (("algorithmic", "transparency", "software", "cybersecurity", "automated decision"), "ai_regulation", ("AI", "Software", "Transparency")),
    (("robocall", "spoofing", "caller id", "privacy"), "privacy", ("Privacy", "Robocalls", "Telemarketing")),
    (("non-compete", "workplace", "employment"), "labor", ("Labor", "FTC", "Workplace")),
    (("clinical", "device", "medical", "fda"), "healthcare", ("Healthcare", "FDA", "Devices")),
)


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


def collapse(c: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normalize(c: Column) -> Column:
    return F.lower(collapse(c))


def text_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(c.cast("binary"), 256)


def blank(c: Column) -> Column:
    return c.isNull() | (collapse(c) == "")


def char_count(c: Column) -> Column:
    return F.coalesce(F.char_length(c), F.lit(0)).cast("long")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, one at least; 0 for null."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(c) / 4))).cast("long")


def truncate(c: Column, limit: int = PREVIEW_CHARS) -> Column:
    """Collapsed text of ``limit`` characters at most, the last three dots if it was longer; null if blank."""
    x = collapse(c)
    return F.when(F.char_length(x) == 0, F.lit(None)).when(F.char_length(x) <= limit, x).otherwise(
        F.concat(F.substring(x, 1, limit - 3), F.lit("..."))
    )


def cut(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 3), F.lit("...")))


def preview(raw: Column, normalized: Column, limit: int = PREVIEW_CHARS) -> Column:
    """Review preview: the first characters, neither trimmed nor marked; empty, not null."""
    return F.substring(F.regexp_replace(F.coalesce(raw, normalized, F.lit("")), f"{WS}+", " "), 1, limit)


def short_preview(c: Column, limit: int = 300) -> Column:
    return F.coalesce(truncate(c, limit), F.lit(""))


def markdown_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_END)


def words(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def phrase_candidates(c: Column, min_words: int, max_words: int) -> Column:
    """Sentences of ``min_words`` words or more, each followed by its first ``max_words`` if it is longer; repeats included."""
    each = F.transform(sentences(c), lambda s: F.struct(strip(s).alias("s"), words(s).alias("w")))
    long_enough = F.filter(each, lambda x: (x["s"] != "") & (F.size(x["w"]) >= min_words))
    return F.flatten(F.transform(long_enough, lambda x: F.when(
        F.size(x["w"]) > max_words, F.array(x["s"], F.array_join(F.slice(x["w"], 1, max_words), " "))
    ).otherwise(F.array(x["s"]))))


def sections(c: Column) -> Column:
    """Array of (name, body) of a rule text cut at ``## `` headers.

    Lines of a single ``#`` are comments; text before the first header is ``__preamble__``; sections
    without a body are left out. Without headers the whole text is the preamble.
    """
    lines = F.filter(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: ~strip(x).startswith("# ") & (strip(x) != "#"))
    kept = F.array_join(lines, "\n")
    parts = F.split(F.concat(F.lit("\n"), kept), r"\n##[ \t]+(?=\S)")
    head = F.array(F.struct(F.lit("__preamble__").alias("name"), strip(parts[0]).alias("body")))
    rest = F.transform(F.slice(parts, 2, 1_000_000), lambda p: F.struct(
        strip(F.substring_index(p, "\n", 1)).alias("name"),
        strip(F.when(F.instr(p, "\n") > 0, F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise("")).alias("body"),
    ))
    return F.when(F.size(parts) == 1, head).otherwise(F.filter(F.concat(head, rest), lambda s: s["body"] != ""))


def excerpt(text: Column, needle: Column, radius: int = 120) -> Column:
    """Text around a phrase with dots where it is cut; null if the phrase doesn't occur.

    The place is that in the normalized text, though the excerpt is cut from the raw one.
    """
    at = F.instr(normalize(text), normalize(needle)) - 1
    start = F.greatest(F.lit(0), at - radius)
    end = F.least(F.char_length(text), at + F.char_length(needle) + radius)
    body = strip(F.substring(text, start + 1, end - start))
    return F.when(at >= 0, F.concat(
        F.when(start > 0, "...").otherwise(""), body, F.when(end < F.char_length(text), "...").otherwise("")
    ))


def is_cover_note(text: Column, has_attachments: Column, min_chars: int = COVER_NOTE_CHARS) -> Column:
    x = F.lower(strip(text))
    phrase = F.exists(F.array(*map(F.lit, COVER_PHRASES)), lambda p: F.contains(x, p))
    return F.coalesce(has_attachments & (F.char_length(x) < min_chars) & phrase, F.lit(False))


def is_substantive(text: Column, has_attachments: Column, min_chars: int = COVER_NOTE_CHARS) -> Column:
    return ~blank(text) & ~is_cover_note(text, has_attachments, min_chars)


def slug(headline: Column, cluster_id: Column) -> Column:
    base = F.regexp_replace(F.lower(headline), "[^a-z0-9]+", "-")
    base = F.regexp_replace(F.substring(F.regexp_replace(base, "^-+|-+$", ""), 1, 60), "-+$", "")
    suffix = F.substring(text_hash(cluster_id), 1, 6)
    return F.when(base != "", F.concat_ws("-", base, suffix)).otherwise(F.concat(F.lit("finding-"), suffix))


def date_range(start: Column, end: Column) -> Column:
    s, e = F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd")
    return F.when(s == e, s).when(s.isNotNull() & e.isNotNull(), F.concat_ws(" to ", s, e)).otherwise(F.coalesce(s, e))


def search_tokens(c: Column, min_chars: int = 2, stopwords: tuple[str, ...] = ()) -> Column:
    found = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.char_length(w) >= min_chars)
    return F.filter(found, lambda w: ~w.isin(*stopwords)) if stopwords else found


def matches_any(tokens: Column, *columns: Column) -> Column:
    """Whether any token occurs in any column, without regard to case."""
    return F.exists(tokens, lambda t: F.greatest(*[F.coalesce(F.contains(F.lower(c), t), F.lit(False)) for c in columns]))


def topic(text: Column, default: Column) -> Column:
    low, out = F.lower(text), default
    for found, name, _ in reversed(TOPIC_RULES):
        out = F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in found]), F.lit(name)).otherwise(out)
    return out


def topic_tags(text: Column, tags: Column, agency: Column) -> Column:
    """Comma-joined tags: given ones, the topic's, the agency; the first spelling of each stays."""
    low, more = F.lower(text), F.array().cast("array<string>")
    for found, _, names in reversed(TOPIC_RULES):
        more = F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in found]), F.array(*map(F.lit, names))).otherwise(more)
    every = F.concat(F.split(F.coalesce(tags, F.lit("")), ","), more, F.array(F.coalesce(agency, F.lit(""))))
    clean = F.filter(F.transform(every, strip), lambda t: t != "")
    lowered = F.transform(clean, F.lower)
    return F.array_join(F.filter(clean, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1), ", ")


def safe_path(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def agency_of_docket(docket_id: Column) -> Column:
    first = F.upper(F.substring_index(docket_id, "-", 1))
    return F.when(first != "", first).otherwise("FTC")


def redact(c: Column) -> Column:
    """Long hexadecimal ids and addresses of hosts in messages give way to a mark."""
    return F.regexp_replace(F.regexp_replace(c, r"\b[0-9a-fA-F]{16,}\b", "[id]"), r"\b[a-z]+://[^\s/@]+(?::[^\s/@]*)?@?[^\s/]*", "[host]")


def cluster_class(size: Column, unique: Column, largest: Column) -> Column:
    return F.when(size <= 1, "mixed").when(unique >= 0.8 * size, "paraphrase").when(largest >= 0.6 * size, "exact_duplicate").otherwise("mixed")
