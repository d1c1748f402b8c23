"""Rules on candidate names: language, verbs, morphology, phrases of a query, a first assessment, areas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glimmer.functions import lexicon as L
from glimmer.functions.text import bound, one_of

#: Verbs by which a headline's predicate is known, and suffixes of words without a subject of their own.
VERBS = r"^(stabiliz|regulat|enabl|boost|unlock|reveal|driv|govern|promot|improv|enhanc|achiev|induc|suppress|mediat|facilitat|accelerat|dictat|determin|modulat|activat|inhibit|empower|redefin|outperform|decoupl|steer)(es|s)$"
SUFFIXES = r"(able|ible|ent|ant|ive|ous|ed|ing|ly|ity|ness)$"
#: Words of other languages; one of the strong ones is enough.
FOREIGN = frozenset(
    """en la el los las del para con por una que mediante tiempos desaf vac investigaci educaci do da das dos em com ao na
    comportamento gest une des les du et pour avec dans sur strat und mit von zur eine dan yang pada dalam di untuk terhadap
    pengaruh sebagai berbasis menggunakan dengan ke dari meningkatkan sistem penerimaan murid baru magang hijau solusi energi
    terbarukan efisiensi operasional ekstrak""".split()
)
FOREIGN_STRONG = frozenset("berbasis untuk pengaruh terhadap meningkatkan sebagai dengan mediante para".split())
#: Plain adjectives: a parameter with a short default.
PLAIN = frozenset("strategic direct efficient scalable robust integrated optimal advanced smart intelligent emerging sustainable hybrid potential future current recent global local promising".split())
#: Words that can't stand at a query phrase's edge, heads that say nothing, words that can't be inside.
STOP = frozenset(
    """more most less before after they them your my our their you we us i me his her its false true zero a an the of for and or
    in on to with by from at as is are was were be been being this that these those it into via using based towards toward over
    under between within without new novel approach approaches study analysis method methods framework frameworks model models
    system systems paper review survey results case use role impact large language data learning deep machine artificial
    intelligence ai llm llms through can application applications challenges opportunities future perspective perspectives
    comprehensive how what why""".split()
)
HEADS = frozenset("security technology technologies solution solutions research development issues performance evaluation management detection network networks algorithm algorithms".split())
INNER = frozenset(
    """integrates integrating integrated leveraging leverages actionable insights contains repository capabilities systematic
    mapping meta analysis literature review reviews including includes enables enabling provides providing using uses based
    significant potential various several key novel proposed existing current recent state art paper study studies findings
    results with and or for built across by from in on of the to via official implementation open source real time complex tasks
    dynamic environments professionals track anonymously curated awesome collection list simple easy""".split()
)

#: Names of products without and with another meaning, furniture of repositories, plumbing.
BRANDS = frozenset("openai anthropic claude chatgpt gpt copilot codex llama mistral deepseek qwen grok midjourney gigachat yandexgpt huggingface langchain llamaindex ollama vllm pytorch tensorflow kubernetes nvidia perplexity cursor prnewswire businesswire".split())
AMBIGUOUS_BRANDS = frozenset("meta swift visa apple amazon oracle spark go rust azure gemini docker github gitlab stripe revolut binance coinbase mastercard google microsoft sber yandex".split())
FURNITURE = frozenset("awesome boilerplate cheatsheet tutorial handbook roadmap curated starter clone playground cookbook snippets template templates examples example demo docs documentation list lists collection".split())
PLUMBING = frozenset("server servers client clients api sdk cli app apps ui gui dashboard plugin plugins extension extensions wrapper wrappers toolkit bot chatbot repo repository port".split())
#: Heads of talk about a subject, of documents, of categories, of classes of models; words of research.
DISCOURSE = frozenset(
    """market markets industry industries company companies ecosystem ecosystems landscape trend trends future era space domain
    field area sector opportunity opportunities challenge challenges issue issues perspective perspectives overview insight
    insights strategy strategies initiative initiatives practice practices adoption usage study studies survey review research
    briefing briefings""".split()
)
ARTIFACTS = frozenset("report reports forecast forecasts outlook inequality awareness readiness maturity hype".split())
RESEARCH_WORDS = frozenset(
    """horizon scanning foresight direction directions section sections work works related literature agenda gap gaps state art
    background introduction conclusion conclusions discussion abstract references appendix outlook prospects prospect""".split()
)
CATEGORIES = frozenset(
    """technology technologies solution solutions system systems platform platforms framework frameworks approach approaches method
    methods tool tools service services product products application applications capability capabilities feature features factor
    factors aspect aspects management integration analysis development evaluation performance architecture infrastructure
    dependency dependencies""".split()
)
MODEL_CLASSES = frozenset("ai ml llm llms dl nlp genai agi".split())
INTENT = frozenset("emerging promising future trend trends weak signal signals early novel upcoming next слабые слабых сигналы сигналов сигналах зарождающиеся зарождающихся перспективные перспективных будущие новые новых тренд тренды трендов ранние ранних".split())
#: Nouns that look like gerunds, nouns that look like adjectives, endings of adjectives.
GERUND_NOUNS = frozenset(
    """learning computing engineering networking sensing imaging printing monitoring routing caching training tuning poisoning
    watermarking fingerprinting mapping clustering embedding streaming scaling cooling charging manufacturing housing sharding
    pruning quantizing hedging onboarding provisioning sandboxing logging tracing profiling meshing planning reasoning
    understanding processing modeling modelling sequencing forecasting screening welding coating recycling harvesting breeding
    shielding grounding signing hashing encoding decoding banking accounting marketing advertising consulting trading lending
    borrowing underwriting leasing licensing staking mining farming drilling refining casting milling sintering doping etching
    bonding packaging testing dosing mixing blending reporting indexing ranking matching filtering sampling batching scheduling
    balancing partitioning compounding settling clearing""".split()
)
NOUN_EXCEPTIONS = frozenset(
    """signal signals material materials terminal terminals portal portals crystal crystals metal metals capital journal canal goal
    total manual arsenal protocol protocols interval channel channels panel panels cell cells model models vehicle vehicles module
    modules credential credentials professional professionals individual individuals chemical chemicals mineral minerals pedal
    spiral neural local global central digital""".split()
)
ADJECTIVE_ENDS = r"(ive|ous|able|ible|ful|less|ish|ary|ential|ical|istic|driven|powered|based|enabled|aware|ready|centric|friendly|oriented)$"


def _words(phrase: Column) -> Column:
    return F.split(F.replace(phrase, F.lit("_"), F.lit(" ")), " ")


def is_foreign(phrase: Column, words: Iterable[str] = FOREIGN, strong: Iterable[str] = FOREIGN_STRONG) -> Column:
    """Two words of the list, or one of the strong ones."""
    w = _words(phrase)
    return (F.size(F.filter(w, lambda x: one_of(x, words))) >= 2) | F.exists(w, lambda x: one_of(x, strong))


def has_verb(phrase: Column) -> Column:
    return F.exists(_words(phrase), lambda x: x.rlike(VERBS))


def is_plain(term: Column, plain: Iterable[str] = PLAIN) -> Column:
    """Words without a subject: a single one by list or suffix (hyphenated ones by list only), several if all are."""
    w = F.split(term, " ")
    single = F.when(term.contains("-"), one_of(term, plain)).otherwise(one_of(term, plain) | term.rlike(SUFFIXES))
    return F.when(F.size(w) == 1, single).otherwise(F.forall(w, lambda x: one_of(x, plain) | x.endswith("ly")))


def query_phrases(text: Column, low: int = 2, high: int = 4) -> Column:
    """array<string>: distinct n-grams with edges that aren't stop words, a head that isn't generic, no inner stop word, and
    two words of content."""

    def of(toks: Column, n: int) -> Column:
        inner, edge, content = (lambda w: one_of(w, INNER)), (lambda w: one_of(w, STOP)), (lambda w: ~one_of(w, STOP))
        grams = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.slice(toks, i, n))
        fine = lambda g: ~edge(g[0]) & ~edge(F.element_at(g, -1)) & ~one_of(F.element_at(g, -1), HEADS) & ~F.exists(g, inner) & (F.size(F.filter(g, content)) >= 2)
        return F.when(F.size(toks) >= n, F.transform(F.filter(grams, fine), lambda g: F.array_join(g, " "))).otherwise(F.expr("cast(array() as array<string>)"))

    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9\-]+"), 0)
    return F.array_distinct(bound(tokens, lambda t: F.concat(*[of(t, n) for n in range(low, high + 1)])))


def domain_relevance(shares_seed: Column, channels: Column, lit: Column) -> Column:
    """Half, plus literature, several channels and a seed word, minus a lot where there is none of them."""
    x = 0.5 + F.when(lit >= 1, 0.2).otherwise(0.0) + F.when(channels >= 2, 0.2).otherwise(0.0) + F.when(shares_seed, 0.1).otherwise(0.0) - F.when((channels <= 1) & ~shares_seed & (lit == 0), 0.4).otherwise(0.0)
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) + 1e-9, 3)


def assessed(phrase: Column, relevance: Column, seeds: Column | None = None, exclusions: Column | None = None) -> Column:
    """struct<reason, specificity>: the first hard reason, else specificity after penalties, weak if that and relevance are low.

    seeds: the words of the query, which aren't specific; exclusions: words that the query's plan rules out.
    """
    none = F.expr("cast(array() as array<string>)")
    seeds, exclusions = (none if x is None else x for x in (seeds, exclusions))
    w = F.regexp_extract_all(F.lower(F.coalesce(phrase, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    last = F.element_at(F.regexp_extract_all(F.lower(phrase), F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), 0), -1)
    head = F.element_at(w, -1)
    weak = L.GENERIC_MODIFIERS | L.PARTICIPLE_MODIFIERS | L.FUNCTION_WORDS | CATEGORIES | DISCOURSE | ARTIFACTS | MODEL_CLASSES | PLUMBING | BRANDS | AMBIGUOUS_BRANDS
    meta = RESEARCH_WORDS | DISCOURSE | ARTIFACTS | CATEGORIES | MODEL_CLASSES | L.FUNCTION_WORDS | INTENT
    specific = F.filter(w, lambda x: ~one_of(x, weak) & ~F.array_contains(seeds, x) & (F.length(x) > 2))
    has = lambda words: F.exists(w, lambda x: one_of(x, words))
    gerund = w[0].endswith("ing") & ~one_of(w[0], GERUND_NOUNS) & ~one_of(w[0], L.GENERIC_MODIFIERS) & (F.length(w[0]) > 5)
    glued = F.replace(last, F.lit("-"), F.lit(""))
    adjective = ~one_of(last, NOUN_EXCEPTIONS) & ~one_of(glued, NOUN_EXCEPTIONS) & (last.rlike(ADJECTIVE_ENDS) | (last.endswith("al") & (F.length(last) > 5)))
    minus = lambda when, x: F.when(when, x).otherwise(0.0)
    spec = F.lit(1.0) - minus(one_of(head, CATEGORIES), 0.35) - minus(one_of(head, MODEL_CLASSES), 0.35) - minus(has(PLUMBING), 0.25) - minus(has(AMBIGUOUS_BRANDS), 0.25) + minus(F.size(specific) >= 2, 0.1)
    spec = F.round(F.least(F.greatest(spec, F.lit(0.0)), F.lit(1.0)) + 1e-9, 3)
    reason = (
        F.when(~F.size(w).between(2, 4), "length")
        .when(F.forall(w, lambda x: F.length(x) <= 2), "short_tokens")
        .when(has(BRANDS), "brand")
        .when(has(FURNITURE), "furniture")
        .when(gerund, "gerund")
        .when(adjective, "adjective")
        .when(one_of(head, DISCOURSE), "discourse")
        .when(has(AMBIGUOUS_BRANDS) & (F.size(specific) == 0), "ambiguous_brand")
        .when(F.size(specific) == 0, "nothing_specific")
        .when(F.forall(w, lambda x: one_of(x, meta)), "meta_concept")
        .when(F.arrays_overlap(w, exclusions), "excluded")
        .when((spec < 0.7) & (relevance < 0.4), "weak")
    )
    return F.struct(reason.alias("reason"), spec.alias("specificity"))


def first_match(group: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern found in a group's code."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(group.rlike(pattern), name).otherwise(out)
    return out


def areas(text: Column, lexicon: dict[str, str], shares: dict[str, Column], labels: Column, strict: Iterable[str] = (), least: float = 0.30, never: dict[str, str] | None = None, own_text: dict[str, Column] | None = None) -> Column:
    """array<string>: areas by a subject word, a share of a rubric, or a label.

    Strict ones need a label beside the share. never: words that rule an area out; own_text: areas whose subject words are
    looked for in another text, such as the name alone. Underscores are spaces.
    """
    plain = lambda x: F.lower(F.replace(F.coalesce(x, F.lit("")), F.lit("_"), F.lit(" ")))
    labels, made = F.coalesce(labels, F.expr("cast(array() as array<string>)")), []
    for a, pattern in lexicon.items():
        lex, rub, own = plain((own_text or {}).get(a, text)).rlike(pattern), F.coalesce(shares.get(a, F.lit(0.0)), F.lit(0.0)) >= least, F.array_contains(labels, a)
        fine = lex | ((rub & own) if a in strict else (rub | own))
        made.append(F.when(fine & ~plain(text).rlike(never[a]) if a in (never or {}) else fine, a))
    return F.array_compact(F.array(*made))


def main_area(found: Column, order: list[str], default: str = "other") -> Column:
    """The first area of an order that was found."""
    out = F.lit(default)
    for a in reversed(order):
        out = F.when(F.array_contains(found, a), a).otherwise(out)
    return out
