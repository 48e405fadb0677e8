"""Text functions over columns: tokens, counts, citations, labels, language mix. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata import config as C

CJK = "\\u4e00-\\u9fff"
LEXICAL = f"[A-Za-z0-9_./:+-]+|[{CJK}]+"


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the text holds any of the words as a substring."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


def count_contained(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lexical_tokens(text: Column) -> Column:
    """Distinct tokens in order of first use: ASCII words with ``_ . / : + -`` and bigrams of CJK runs."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(LEXICAL), F.lit(0)))

    def cut(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when((run >= F.lit("\u4e00")) & (F.length(run) > 1), pairs).otherwise(F.array(run))

    # most texts have no CJK runs to cut
    return F.when(text.rlike(f"[{CJK}]"), F.array_distinct(F.flatten(F.transform(runs, cut)))).otherwise(runs)


def lexical_text(text: Column) -> Column:
    return F.array_join(lexical_tokens(text), " ")


def index_terms(tokens: Column) -> Column:
    """What the index holds of lexical tokens: their parts between ``_ . / : + -``, in order, repeats kept."""
    return F.filter(F.split(F.array_join(tokens, " "), "[ _./:+-]+"), lambda x: x != "")


def sub_terms(token: Column) -> Column:
    return F.filter(F.split(token, "[_./:+-]+"), lambda x: x != "")


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their diacritics."""
    return F.translate(F.lower(text), C.ACCENTED, C.PLAIN)


def raw_terms(text: Column) -> Column:
    """Letter and digit runs of a text, in order, repeats kept."""
    return F.filter(F.split(folded(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def query_terms(text: Column, limit: int = C.FTS_TERMS) -> Column:
    return F.slice(lexical_tokens(text), 1, limit)


def squeeze(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?U)^\\s+", ""), "(?U)\\s+$", "")


def short_text(text: Column, limit: int = C.SHORT_TEXT) -> Column:
    value = squeeze(text)
    return F.concat(F.rtrim(F.substring(value, 1, limit)), F.when(F.length(value) > limit, "...").otherwise(""))


def estimate_tokens(text: Column) -> Column:
    """CJK characters count one each, four other visible characters count one."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, "[\\u3400-\\u9fff]", ""))
    rest = F.length(F.regexp_replace(text, "(?U)[\\s\\u3400-\\u9fff]", ""))
    return (cjk + F.ceil(rest / 4)).cast("int")


def sentences(text: Column) -> Column:
    parts = F.split(strip(text), "(?U)(?<=[。！？!?；;])\\s*|\\n{2,}|(?<=[.!?])\\s+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def citations(text: Column) -> Column:
    """Distinct cited ids in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("\\[E:(\\d+)\\]"), F.lit(1)), lambda x: x.cast("long")))


def normalize_citations(text: Column) -> Column:
    once = F.regexp_replace(text, "\\[\\[\\s*E\\s*:\\s*(\\d+)\\s*\\]\\]", "[E:$1]")
    return F.regexp_replace(once, "\\[\\s*E\\s*:\\s*(\\d+)\\s*\\]", "[E:$1]")


def wiki_links(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit("\\[\\[([^\\]]+)\\]\\]"), F.lit(1)), strip)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.rlike("(?i)^E\\s*:\\s*\\d+$"))))


def evidence_refs(text: Column) -> Column:
    """Ids in a JSON list of references or in a bare string; what doesn't parse gives none."""
    listed = F.coalesce(F.from_json(text, "array<string>"), F.array(text))
    ids = F.transform(listed, lambda x: F.regexp_extract(F.coalesce(x, F.lit("")), "E\\s*:\\s*(\\d+)", 1))
    return F.array_distinct(F.transform(F.filter(ids, lambda x: x != ""), lambda x: x.cast("long")))


def mojibake(text: Column) -> Column:
    counts = (F.floor((F.length(text) - F.length(F.replace(text, F.lit(m)))) / len(m)) for m in C.MOJIBAKE)
    return F.coalesce(reduce(lambda a, b: a + b, counts) >= 2, F.lit(False))


def chinese_ratio(text: Column) -> Column:
    cjk = F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]", ""))
    latin = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]", ""))
    return F.when(cjk + latin == 0, 0.0).otherwise(cjk / (cjk + latin))


def slug(text: Column, limit: int = 280) -> Column:
    """ASCII words joined by hyphens, Latin letters without their diacritics; a text without any becomes ``entity-`` and its
    bytes in hex."""
    base = F.regexp_replace(F.regexp_replace(folded(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(base != "", F.substring(base, 1, limit)).otherwise(F.concat(F.lit("entity-"), F.substring(F.lower(F.hex(F.encode(text, "UTF-8"))), 1, 240)))


def clean_label(text: Column) -> Column:
    value = F.regexp_replace(F.regexp_replace(text, "\\[E:\\d+\\]", ""), "[#*_`>]+", "")
    value = F.regexp_replace(value, "(?U)\\s+", " ")
    return F.substring(F.regexp_replace(value, "^[ :：,，.。;；]+|[ :：,，.。;；]+$", ""), 1, 160)


def canonical_label(text: Column) -> Column:
    def named(value: Column) -> Column:
        low = F.lower(value)
        known = F.create_map(*[F.lit(x) for pair in C.SYNONYMS.items() for x in pair])
        prefixed = reduce(lambda rest, p: F.when(low.startswith(p[0]), p[1]).otherwise(rest), reversed(C.LABEL_PREFIXES), F.lit(None).cast("string"))
        return F.coalesce(F.try_element_at(known, low), prefixed, value)

    return let(strip(clean_label(text)), named)


def valid_label(label: Column) -> Column:
    """Whether a canonical label can name an entity."""
    low = F.lower(strip(label))
    words = F.size(F.split(squeeze(label), " "))
    generic = reduce(lambda a, b: a | b, (label.rlike(p) for p in C.GENERIC_LABELS))
    broken = label.rlike(C.BROKEN_LABEL)
    slashed = F.contains(label, F.lit("/")) & ~contains_any(low, ("autosar", "simulink", "stateflow"))
    tiny = (words == 1) & ~low.isin(*C.SINGLE_WORDS) & (F.length(label) < 4)
    number = reduce(lambda a, b: a | b, (label.rlike(p) for p in C.NUMBER_LABELS))
    return F.coalesce((F.length(label) >= 2) & ~low.isin(*C.STOP_LABELS) & ~contains_any(label, C.LABEL_FRAGMENTS) & ~broken & ~generic & ~slashed & ~tiny & ~number, F.lit(False))


def entity_type(label: Column) -> Column:
    low = F.lower(label)
    return reduce(lambda rest, kind: F.when(contains_any(low, kind[1]), kind[0]).otherwise(rest), reversed(C.TYPE_KEYWORDS), F.lit("concept"))


def domains(text: Column, kind: str = "question", registry: dict | None = None) -> Column:
    """Sorted domains whose keywords the text holds; titles have lists of their own."""
    low, at = F.lower(F.coalesce(text, F.lit(""))), 0 if kind == "question" else 1
    found = [F.when(contains_any(low, words[at]), name) for name, words in sorted((registry or C.DOMAINS).items())]
    return F.array_compact(F.array(*found))


def simple_relation(question: Column) -> Column:
    low = F.lower(question)
    return contains_any(low, C.SIMPLE_CUES) & ~contains_any(low, C.COMPLEX_CUES)


def question_role(question: Column, found: Column | None = None) -> Column:
    low = F.lower(question)
    many = F.size(found if found is not None else domains(question)) >= 2
    return (
        F.when(many & contains_any(low, C.RELATION_CUES), "relationship")
        .when(contains_any(low, C.COMPARISON_CUES), "comparison")
        .when(contains_any(low, C.PROCEDURE_CUES), "procedure")
        .when(contains_any(low, C.DEFINITION_CUES), "definition")
        .otherwise("general")
    )


def by_role(role: Column, values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), role)


def chat_normalized(text: Column) -> Column:
    value = F.regexp_replace(F.lower(strip(text)), "(?U)\\s+", "")
    value = F.regexp_replace(value, "[。！？?.,，；;：:、（）()\\[\\]《》\"'“”‘’·…—\\\\-]+", "")
    return F.regexp_replace(value, "(.)\\1{2,}", "$1$1")


def intent(text: Column) -> Column:
    """The product, help or small-talk intent of a turn; ``rag`` for all others."""
    value = chat_normalized(text)
    compact = F.regexp_replace(value, f"(?<=.)[{C.PARTICLES}]+$", "")
    domain = contains_any(value, C.DOMAIN_TERMS)
    greeting = ~domain & (compact.isin(*C.GREETINGS) | ((F.length(compact) <= 8) & contains_any(compact, C.GREETINGS)))
    rest = F.when(contains_any(value, C.SMALLTALK) & ~domain, "out_of_scope_chat").otherwise("rag")
    for name, words in reversed(C.INTENTS):
        rest = F.when(contains_any(value, words), name).otherwise(rest)
    return F.when(greeting, "greeting").otherwise(rest)


def required_terms(question: Column) -> Column:
    """Terms that evidence must cover: specific tokens of three characters or more."""
    import re

    only = {w for words, _ in C.DOMAINS.values() for w in words if len(w) >= 3 and re.fullmatch(r"[a-z0-9_.:+-]+", w)}
    drop = F.array(*[F.lit(w) for w in sorted({*C.GENERIC_TERMS, *C.ACTION_TERMS, *only})])
    tokens = F.transform(lexical_tokens(question), lambda x: F.when(x.isin("ros_2", "ros-2"), "ros2").otherwise(x))
    return F.array_distinct(F.filter(tokens, lambda x: (F.length(x) >= 3) & ~F.array_contains(drop, x) & ~x.rlike("^\\d+$")))


def covered(term: Column, text: Column, tokens: Column) -> Column:
    """Whether evidence holds a term or one of its spellings: spaced ones as substrings, others as tokens."""
    out = F.array_contains(tokens, term) | ((F.contains(term, F.lit("-")) | F.contains(term, F.lit("_"))) & F.contains(text, term))
    for name, spellings in C.ALIASES.items():
        found = reduce(lambda a, b: a | b, (F.contains(text, F.lit(s)) if any(c in s for c in " -_") else F.array_contains(tokens, s) for s in spellings))
        out = F.when(term == name, found).otherwise(out)
    return out


def snippet_units(text: Column) -> Column:
    """Sentences of a squeezed text; one long sentence becomes windows of fixed length."""
    value = squeeze(text)
    units = F.filter(F.transform(F.split(value, "(?<=[.!?。！？；;])\\s+|(?<=[。！？；])"), strip), lambda x: x != "")
    n = F.lit(C.SNIPPET_WINDOW)
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.length(value) - 1) / n).cast("int")), lambda i: strip(F.substring(value, (i * n + 1).cast("int"), n)))
    return F.when(F.length(value) == 0, F.array().cast("array<string>")).when((F.size(units) <= 1) & (F.length(value) > C.SNIPPET_WINDOW), windows).otherwise(units)


def uuid5(name: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The version-5 UUID of a name (URL namespace by default)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
