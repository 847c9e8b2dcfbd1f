"""Scalar functions of the sequence operators: text, time, numbers and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Python's round(): ties go to the even neighbour."""
    return F.bround(x, digits)


def words(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)


def token_set(text: Column) -> Column:
    """Distinct word tokens of more than two characters."""
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def count_in(text: Column, markers: list[str]) -> Column:
    """How many of the markers occur in a text."""
    return bound(text, lambda t: sum((F.contains(t, F.lit(m)).cast("int") for m in markers), F.lit(0)))


def starts_with_any(text: Column, markers: list[str]) -> Column:
    return bound(text, lambda t: F.exists(F.array(*map(F.lit, markers)), lambda m: F.startswith(t, m)))


def seconds_of(stamp: Column) -> Column:
    """Seconds of HH:MM:SS, MM:SS or SS, with a fraction after a point or comma."""
    parts = F.reverse(F.split(F.regexp_replace(stamp, ",", "."), ":"))
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).cast("double"), F.lit(0.0))
    return part(1) + part(2) * 60 + part(3) * 3600


def stamp_of(seconds: Column) -> Column:
    """HH:MM:SS from an hour on, MM:SS before."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def video_id(url: Column) -> Column:
    """The eleven characters that name a video in its usual urls; null without."""
    got = F.regexp_extract(url, r"(?:v=|youtu\.be/|/embed/|/shorts/|/live/)([A-Za-z0-9_-]{11})", 1)
    return F.when(got != "", got)


def with_param(url: Column, name: str, value: Column) -> Column:
    """A url with a query parameter added, or set if it is there."""
    there = F.regexp_like(url, F.lit(f"[?&]{name}="))
    joined = F.concat(url, F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit(f"{name}="), value)
    return F.when(there, F.regexp_replace(url, F.lit(f"([?&]){name}=[^&#]*"), F.concat(F.lit(f"$1{name}="), value))).otherwise(joined)


def inferred_title(text: Column, most: int = 9) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+)"), 1), 1, most), " ")


def latex(text: Column) -> Column:
    """Characters special to LaTeX, escaped."""
    text = F.replace(text, F.lit("\\"), F.lit("\\textbackslash{}"))
    for c in "&%$#_":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def yes_no(answer: Column) -> Column:
    """1 for an answer that opens with yes, 0 with no, null otherwise."""
    low = F.lower(F.trim(answer))
    return F.when(F.rlike(low, F.lit(r"^\W*yes\b")), 1.0).when(F.rlike(low, F.lit(r"^\W*no\b")), 0.0)


def first_in_range(answer: Column, low: Column, high: Column) -> Column:
    """The first integer in a text that lies in a range."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"(\d{1,9})"), 1), lambda x: x.cast("long"))
    return F.try_element_at(F.filter(numbers, lambda x: (x >= low) & (x <= high)), F.lit(1))


def clean_boundaries(b: Column, n: Column) -> Column:
    """Integer boundaries strictly inside a sequence, distinct and rising."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(b, lambda x: x.cast("int")), lambda x: (x > 0) & (x < n))))


def masses(b: Column, n: Column) -> Column:
    """Lengths of the segments between clean boundaries."""
    edges = F.concat(F.array(F.lit(0)), b, F.array(n.cast("int")))
    return F.zip_with(F.slice(edges, 2, F.size(edges) - 1), F.slice(edges, 1, F.size(edges) - 1), lambda x, y: x - y)


def spans(b: Column, n: Column) -> Column:
    """(start, end) of the segments between clean boundaries."""
    edges = F.concat(F.array(F.lit(0)), b, F.array(n.cast("int")))
    return F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda x, y: F.struct(x.alias("start"), y.alias("end")))


def indicator(b: Column, n: Column) -> Column:
    """0/1 for each gap of a sequence of n units."""
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n.cast("int") - 1), lambda i: F.array_contains(b, i).cast("int"))).otherwise(F.array().cast("array<int>"))


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over hull."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2)) / hull).otherwise(F.lit(0.0))


def normal_cdf(z: Column) -> Column:
    """Five-term polynomial of the standard normal distribution function."""
    # Fixed values of the approximation.
    a = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = F.lit(1.0) / (1 + 0.2316419 * F.abs(z))
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    upper = 1 - F.exp(-0.5 * z * z) / (2 * 3.141592653589793) ** 0.5 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def softmax(score: Column, by: list[str], temperature: float = 1.0) -> Column:
    """Shares that sum to one over the rows of equal `by`."""
    w = Window.partitionBy(*by)
    x = F.exp((score - F.max(score).over(w)) / temperature)
    return x / F.sum(x).over(w)


# Seconds and units that a segment is meant to have, by length asked for; bounds and weights of the estimate.
LENGTHS = {"short": (270, 55), "medium": (390, 80), "long": (540, 115)}
# Words that a title leaves out.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can "
    "so yet both either neither each few more most other some such no not only same than too very just it its this "
    "that these those of in to for with on at from by about as into through during before after above below between out "
    "off over under again then once i we you he she they but and or if because while although though"
).split()
# What speaks for a domain, in order of domains.
DOMAIN_WORDS = {
    "Mathematics": ["math", "calculus", "algebra", "equation", "proof", "integral", "derivative", "topology", "number theory"],
    "Physics": ["physics", "quantum", "mechanics", "thermodynamics", "electromagnetism", "relativity", "optics", "wave"],
    "Biology": ["bio", "cell", "protein", "gene", "dna", "neural", "evolution", "organism", "biochem", "genetics"],
    "Computer Science": ["algorithm", "programming", "compute", "machine learning", "data structure", "deep learning", "software", "compiler", "network"],
    "Philosophy": ["philos", "ethics", "logic", "argument", "socrates", "epistemology", "metaphysics", "kant", "plato"],
}


def chapters_for(n: Column) -> Column:
    """Chapters of a sequence of n units without a reference."""
    return F.greatest(F.lit(2), F.floor(n / 40)).cast("int")


def subtopics_for(n: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(n / 20)).cast("int")


def estimated_segments(n: Column, seconds: Column, length: str = "medium") -> Column:
    """Segments of n units in so many seconds: 0.65 of the estimate by time and 0.35 of that by units, half-even, from 2 to 25."""
    per_time, per_unit = LENGTHS[length]
    by = lambda x, per: F.greatest(F.lit(2), F.bround(F.greatest(x, F.lit(1)) / per).cast("int") + 1)
    return F.least(F.lit(25), F.greatest(F.lit(2), F.bround(F.round(0.65 * by(seconds, per_time) + 0.35 * by(n, per_unit), 9)).cast("int")))


def simple_lower(text: Column) -> Column:
    """Lower case character by character, without regard to a word's end or to characters that become two."""
    return F.lower(F.translate(text, "\u03a3\u0130", "\u03c3i"))


def simple_upper(character: Column) -> Column:
    """The one upper-case character of one character: itself where upper case has two, but for the sharp s, which has a capital of its own."""
    whole, title = F.upper(character), F.initcap(character)
    return F.when(character == "\u00df", F.lit("\u1e9e")).when(F.length(whole) == 1, whole).when(F.length(title) == 1, title).otherwise(character)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is named."""
    return F.transform(F.array(value), then)[0]


def section_title(texts: Column, number: Column, most: int = 6) -> Column:
    """A title from the first `most` texts of a segment: of each text of four words or more the first clause's words but stop words and those of up to two letters; six of them, if they are three
    or more and make 15 characters. The longest counts (up to 50 characters, the first on a tie), cut at 52; without one, the section's number. Case changes character by character."""
    words = lambda t: F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")

    def title(t: Column) -> Column:
        kept = F.filter(words(F.split(F.trim(t), "[,;.!?]")[0]), lambda w: ~simple_lower(w).isin(STOP_WORDS) & (F.length(w) > 2))
        whole = lambda j: F.concat(simple_upper(F.substring(j, 1, 1)), simple_lower(F.substring(j, 2, 1 << 20)))
        long_enough = lambda k: F.when(F.size(k) >= 3, bound(whole(F.array_join(F.slice(k, 1, 6), " ")), lambda x: F.when(F.length(x) >= 15, x)))
        return F.when(F.size(words(t)) >= 4, bound(kept, long_enough))

    found = F.filter(F.transform(F.slice(texts, 1, most), title), lambda t: t.isNotNull())
    shown = lambda t: F.least(F.length(t), F.lit(50))
    best = bound(found, lambda f: bound(F.array_max(F.transform(f, shown)), lambda longest: F.try_element_at(F.filter(f, lambda t: shown(t) == longest), F.lit(1))))
    cut = lambda t: F.concat(F.substring(t, 1, 52), F.when(F.length(t) > 52, "\u2026").otherwise(""))
    return F.coalesce(bound(best, cut), F.concat(F.lit("Section "), number.cast("string")))


def domain_votes(text: Column) -> Column:
    """How many of each domain's words a text holds, as an array in order of domains."""
    return bound(simple_lower(text), lambda low: F.array(*(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for words in DOMAIN_WORDS.values())))


def voted_domain(text: Column) -> Column:
    """The domain of most votes, the first on a tie; General without any."""
    names = F.array(*map(F.lit, DOMAIN_WORDS))
    return bound(domain_votes(text), lambda votes: F.when(F.array_max(votes) > 0, F.element_at(names, F.array_position(votes, F.array_max(votes)).cast("int"))).otherwise(F.lit("General")))
