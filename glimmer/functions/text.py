"""Terms out of text as native column expressions: normalising, chunking, n-grams, keys, name rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glimmer.functions import lexicon as L


def one_of(x: Column, words: Iterable[str]) -> Column:
    return x.isin(*sorted(words))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def normalized(text: Column, boundary: Iterable[str] = L.BOUNDARY) -> Column:
    """Lower case; `_` becomes a space; a hyphen chain with a boundary word inside is glued by `_`, others split."""
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("_"), F.lit(" "))
    split = F.regexp_replace(plain, "(?<=[a-z0-9])-(?=[a-z0-9])", " ")

    def glue(x: Column) -> Column:
        parts = F.split(x, "-")
        inner = F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: one_of(p, boundary))
        return F.when(x.rlike("^[a-z0-9]+-"), F.when(inner, F.replace(x, F.lit("-"), F.lit("_"))).otherwise(F.replace(x, F.lit("-"), F.lit(" ")))).otherwise(x)

    # Only a chain of three words or more can have one inside; few texts have such a chain.
    long = F.array_join(F.transform(F.regexp_extract_all(plain, F.lit("[a-z0-9]+(?:-[a-z0-9]+)*|[^a-z0-9]+"), 0), glue), "")
    return F.when(plain.rlike("[a-z0-9]-[a-z0-9]+-[a-z0-9]"), long).otherwise(split)


def chunks(text: Column, boundary: Iterable[str] = L.BOUNDARY) -> Column:
    """array<array<string>>: runs of tokens between punctuation, boundary words and numbers out of place.

    A number stays only right after a word of its chunk, and never if it is a year. Cuts are marks in one string, so that
    the work is in proportion to the text.
    """
    pieces = F.regexp_replace(normalized(text, boundary), L.PIECE_BREAK, "|")
    tokens = F.transform(F.regexp_extract_all(pieces, F.lit(rf"{L.TOKEN}|\|"), 0), lambda t: F.when(one_of(t, boundary), "|").otherwise(t))
    line = F.concat(F.lit("| "), F.array_join(tokens, " "), F.lit(" |"))
    line = F.regexp_replace(line, r"(?<= )(?:19|20)[0-9]{2}(?= )", "|")  # years
    line = F.regexp_replace(line, r"(?<=\|) (?:[0-9]+(?:\.[0-9]+)? )+", " ")  # numbers that no word goes before
    line = F.regexp_replace(line, r"(?<= )([0-9]+) (?:[0-9]+(?:\.[0-9]+)? )+", "$1 | ")  # and those after a number
    return F.transform(F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != ""), lambda c: F.split(c, " "))


def ngrams(chunk: Column, low: int = 2, high: int = 4, start_bad: Iterable[str] = L.START_BAD, end_bad: Iterable[str] = L.END_BAD) -> Column:
    """array<string>: n-grams of a chunk whose edges can be a name's edges."""
    none = F.expr("cast(array() as array<string>)")
    long = lambda w: F.length(w) >= 2
    starts = F.transform(chunk, lambda w: long(w) & ~one_of(w, start_bad) & ~w.rlike("^[0-9]+$"))
    ends = F.transform(chunk, lambda w: long(w) & ~one_of(w, end_bad))

    def of(n: int, s: Column, e: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(chunk) - n + 1), lambda i: F.get(s, i - 1) & F.get(e, i + (n - 2)))
        return F.when(F.size(chunk) >= n, F.transform(places, lambda i: F.array_join(F.slice(chunk, i, n), " "))).otherwise(none)

    return F.when(F.size(chunk) >= low, bound(F.struct(starts.alias("s"), ends.alias("e")), lambda b: F.concat(*[of(n, b["s"], b["e"]) for n in range(low, high + 1)]))).otherwise(none)


def acronyms(raw: Column) -> Column:
    """array<string>: lower-cased acronyms of 2 to 6 characters by their case in the raw text."""
    runs = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.array_distinct(F.transform(F.filter(runs, lambda r: r.rlike(L.ACRONYM)), lambda r: F.lower(r)))


def is_name_token(tok: Column) -> Column:
    """A single word that is a name by its form: letters and digits mixed, or a glued compound."""
    return (tok.rlike("^[a-z0-9]{2,12}$") & tok.rlike("[a-z]") & tok.rlike("[0-9]")) | tok.contains("_")


def candidates(raw: Column, boundary: Iterable[str] = L.BOUNDARY) -> Column:
    """array<string>: the distinct candidate phrases of a document."""
    short = F.filter(acronyms(raw), lambda a: (F.length(a) >= 3) & ~one_of(a, boundary))
    long = bound(chunks(raw, boundary), lambda parts: F.concat(F.flatten(F.transform(parts, lambda c: ngrams(c))), F.filter(F.flatten(parts), is_name_token)))
    return F.array_distinct(F.concat(long, short))


def stem(w: Column) -> Column:
    """A rough singular; glued compounds stay."""
    n = F.length(w)
    return (
        F.when(w.contains("_"), w)
        .when((n > 4) & w.endswith("ies"), F.concat(F.substring_index(F.concat(w, F.lit("\0")), "ies\0", 1), F.lit("y")))
        .when((n > 4) & w.endswith("sses"), F.concat(F.substring_index(F.concat(w, F.lit("\0")), "sses\0", 1), F.lit("ss")))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us") & ~w.endswith("is") & ~w.endswith("ics"), F.substring_index(F.concat(w, F.lit("\0")), "s\0", 1))
        .otherwise(w)
    )


def entity_key(phrase: Column) -> Column:
    """Sorted distinct stems: folds number and word order."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.array_remove(F.split(phrase, r"\s+"), ""), lambda w: stem(w)))), " ")


def is_fragment(phrase: Column, start: Iterable[str] = L.FRAGMENT_START, end: Iterable[str] = L.FRAGMENT_END) -> Column:
    """A piece of a longer term by its first or last word; a list of fixed terms is exempt."""
    p = F.replace(phrase, F.lit("_"), F.lit(" "))
    w = F.split(p, " ")
    fine = F.lit(False)
    for t in L.FRAGMENT_FINE:
        fine = fine | p.startswith(t)
    last = one_of(F.element_at(w, -1), end)
    return ~fine & F.when(w[0].isin("multi", "hardware") & (F.size(w) >= 3), last).otherwise(one_of(w[0], {*start, "multi", "hardware"}) | last)


def is_umbrella(phrase: Column, heads: Iterable[str] = L.UMBRELLA_HEADS, words: Iterable[str] = L.UMBRELLA_WORDS) -> Column:
    w = F.split(F.replace(phrase, F.lit("_"), F.lit(" ")), " ")
    return F.size(w).between(2, 4) & F.exists(w, lambda x: one_of(x, heads)) & F.forall(w, lambda x: one_of(x, {*heads, *words}))


def is_generic(phrase: Column, words: Iterable[str] = L.GENERIC) -> Column:
    return F.forall(F.split(phrase, " "), lambda x: one_of(x, words))


def has_standard(phrase: Column) -> Column:
    """A standard's name anywhere in the phrase."""
    return F.replace(phrase, F.lit("_"), F.lit(" ")).rlike(f"(?i){L.STANDARD}")


def is_standard(phrase: Column, kind: Column) -> Column:
    """A standard: its name is the phrase's head, or the kind is "protocol" and a name is anywhere."""
    p = F.trim(F.replace(phrase, F.lit("_"), F.lit(" ")))
    return p.rlike(rf"(?i)(?:{L.EXCLUDED_STANDARD})\s*$") | (F.coalesce(kind == "protocol", F.lit(False)) & p.rlike(f"(?i){L.EXCLUDED_STANDARD}"))


def simple_tokens(text: Column, stop: Iterable[str] = L.BOUNDARY) -> Column:
    """Lower-case words of three letters or more that may hold digits and hyphens, without stop words."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\-]+"), 0)
    return F.filter(runs, lambda w: w.rlike(r"^[a-z][a-z0-9\-]{2,}$") & ~one_of(w, stop))


def adjective_head(phrase: Column, nouns: Iterable[str] = L.ADJECTIVE_NOUNS) -> Column:
    """The phrase ends in a word formed like an adjective or participle that isn't a known noun."""
    last = F.element_at(F.split(phrase, " "), -1)
    return last.rlike(L.ADJECTIVE_HEAD) & ~one_of(last, nouns)


def variant_stem(w: Column) -> Column:
    """A rough singular, for merging variants only: -ies, -ses, -xes, -zes, -ches, -shes, -s."""
    n = F.length(w)
    cut = lambda k: F.substr(w, F.lit(1), n - k)
    return F.when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 4) & w.rlike("(ses|xes|zes|ches|shes)$"), cut(2)).when((n > 3) & w.endswith("s") & ~w.rlike("(ss|us|is)$"), cut(1)).otherwise(w)


def merge_key(phrase: Column, plain: Iterable[str] = L.GENERIC_MODIFIERS | L.PARTICIPLE_MODIFIERS | L.FUNCTION_WORDS) -> Column:
    """Sorted distinct stems of the words longer than a letter that tell one phrase from another."""
    w = F.filter(F.regexp_extract_all(F.lower(phrase), F.lit("[a-z0-9]+"), 0), lambda x: (F.length(x) > 1) & ~one_of(x, plain))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(w, variant_stem))), " ")


def title_words(title: Column, stop: Iterable[str] = L.TITLE_STOP) -> Column:
    """array<string>: a title's words (Latin, Cyrillic, digits) without stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-zа-яё0-9]+"), 0), lambda w: ~one_of(w, stop))


def normalized_title(title: Column, words: int = 10, stop: Iterable[str] = L.TITLE_STOP) -> Column:
    """The first words of a title that aren't stop words."""
    return F.array_join(F.slice(title_words(title, stop), 1, words), " ")


def work_tokens(title: Column) -> Column:
    """array<string>: the sorted set of a title's words."""
    return F.array_sort(F.array_distinct(title_words(title)))


def title_core(title: Column) -> Column:
    """The sorted set of the words before a subtitle (after a colon or a dash); empty where there is none."""
    parts = F.split(F.coalesce(title, F.lit("")), "[:\u2014\u2013]", 2)
    return F.when((F.size(parts) > 1) & (F.trim(F.get(parts, F.lit(1))) != ""), work_tokens(parts[0])).otherwise(F.expr("cast(array() as array<string>)"))


def content_hash(title: Column, url: Column, snippet: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", title, url, F.substring(snippet, 1, 500)).cast("binary"), 256), 1, 32)


def company_name(name: Column) -> Column:
    """Lower case, legal forms and punctuation removed, single spaces."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), L.LEGAL_FORMS, " ")
    return F.array_join(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), 0), " ")


def sparkline(counts: Column) -> Column:
    """Eight glyphs scaled to the largest count."""
    top = F.array_max(counts)
    glyphs = F.array(*[F.lit(g) for g in "▁▂▃▄▅▆▇█"])
    return F.array_join(F.transform(counts, lambda c: glyphs[F.least(F.lit(7), F.floor(F.coalesce(F.try_divide(c, top), F.lit(0.0)) * 7.999).cast("int"))]), "")


def rebuilt_abstract(index: Column) -> Column:
    """A text out of map<word, array<place>>."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " ")


def stage_ordinal(text: Column, levels: tuple[str, ...]) -> Column:
    """A stage as a number: the mean of the distinct levels named ("a → b" is their midpoint)."""
    number = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(float(i)))])
    found = F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s*(?:→|->|/)\s*"), lambda p: F.try_element_at(number, F.trim(p))), lambda v: v.isNotNull()))
    return F.try_divide(F.aggregate(found, F.lit(0.0), lambda a, v: a + v), F.nullif(F.size(found), F.lit(0)))
