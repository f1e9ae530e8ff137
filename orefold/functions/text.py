"""Text, ranking and identity expressions (B21-B76): built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (B54): how strongly a fact is reconciled, from weakest.
LATTICE = ("unresolved", "repository-confirmed", "cross-map-confirmed", "native-supplemented", "native-confirmed", "native-conflict")
# Fixed values (B23, B27): words that are no search terms, in plans, contract maps, traces, regions and decompositions.
PLAN_STOP = ("the", "and", "for", "from", "into", "with", "that", "this", "make", "change", "implement", "ensure", "using", "through", "only", "existing", "current", "behavior")
TRACE_STOP = tuple("the and for from into with that this when where why does doesnt isnt not work working figure trace find locate runtime path event flow problem issue bug".split())
REGION_STOP = tuple("the and for from with this that into repo repository look take".split())
DOMAIN_STOP = tuple("the and for from with into feature handler service state create update resolve build apply current value".split())
# Fixed values (B33, B34): guards, the first match counts, and fields whose absence is suspected.
GUARDS = (
    (r"(?i)(if\s*\([^)]*(?:msg|message|payload|event)[^)]*\)\s*return\b)", "early-return"),
    (r"(?i)(if\s*\([^)]*\b(?:==\s*null|===\s*null|==\s*undefined)\b[^)]*\)\s*return\b)", "null-check"),
    (r"(?i)(if\s*\([^)]*\bseen\b[^)]*\)\s*return\b)", "dedupe"),
    (r"(?i)(if\s*\([^)]*\b(?:has|includes|contains)\b[^)]*\)\s*return\b)", "suppression"),
)
SUSPECTS = ((r"(?i)(?:message|msg|payload)\.id\b", "message.id"), (r"""(?i)(?:message|msg|payload)\[['"]id['"]\]""", "message['id']"), (r"(?i)\btargetUuid\b", "targetUuid"), (r"(?i)\btarget_uuid\b", "target_uuid"), (r"(?i)\btargetId\b", "targetId"))
# Fixed values (B45): exported declarations; of several kinds of one name the last counts.
EXPORTS = (
    ("function", r"\bexport\s+(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"),
    ("class", r"\bexport\s+(?:default\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("variable", r"\bexport\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)"),
    ("interface", r"\bexport\s+interface\s+([A-Za-z_$][\w$]*)"),
    ("type", r"\bexport\s+type\s+([A-Za-z_$][\w$]*)"),
)


def line_number(text: Column, offset: Column) -> Column:
    """The line of a 0-based offset."""
    return F.lit(1) + F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), "[^\n]", ""))


def normalize(text: Column) -> Column:
    """Camel case and punctuation become spaces, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_.\\/:-]+", " "))


def terms(text: Column, stop: Sequence[str] = (), least: int = 3) -> Column:
    """Distinct search terms, in order."""
    found = F.filter(F.split(normalize(text), "[^a-z0-9$]+"), lambda w: (F.length(w) >= least) & (~w.isin(*stop) if stop else F.lit(True)))
    return F.array_distinct(found)


# Fixed values (B25): where an objective is cut, in turn; the last is "and" before one of these verbs.
CUTS = (
    r"\s*;\s*|\s*\.\s+(?=[A-Z0-9])|\s*,\s*",
    r"(?i)\s+(?:then|while|but|so that)\s+",
    r"(?i)\s+and\s+(?=(?:the\s+)?(?:add|allow|apply|bind|call|clear|create|display|emit|execute|persist|prevent|prompt|record|render|reset|return|roll|route|run|select|show|spend|update|use|validate)\b)",
)


def clauses(text: Column) -> Column:
    """The clauses of an objective, without a leading "and" and empty ones; the whole text where none is left. White space is collapsed first."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    parts = F.array(flat)
    for cut in CUTS:
        parts = F.flatten(F.transform(parts, lambda p: F.split(p, cut)))  # noqa: B023
    kept = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"(?i)^and\s+", "")), lambda c: c != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.filter(F.array(flat), lambda c: c != ""))


def family(name: Column) -> Column:
    """The kebab-case family of a symbol name, without its role suffix."""
    kebab = F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1-$2"), r"[_\s]+", "-"))
    return F.regexp_replace(kebab, r"-(feature|service|adapter|controller|manager)$", "")


def catalog_terms(values: Column) -> Column:
    """Distinct terms of an array of texts; "_", "$", "." and "-" belong to terms."""
    return F.array_distinct(F.filter(F.flatten(F.transform(values, lambda v: F.split(F.lower(v), r"[^a-z0-9_$.-]+"))), lambda w: F.length(w) >= 3))


def group_key(name: Column, stop: Sequence[str] = DOMAIN_STOP) -> Column:
    """The first two domain words of a name, else "misc"."""
    flat = F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_./\\-]+", " "))
    words = F.filter(F.split(F.regexp_replace(flat, r"[^a-z0-9\s]+", ""), r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop))
    # named once: the optimizer would find all words again for each use of the key
    return F.transform(F.array(F.array_join(F.slice(words, 1, 2), "-")), lambda key: F.when(key == "", "misc").otherwise(key))[0]


def slug(text: Column, size: int = 64) -> Column:
    """B29"""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)
    return F.when(s == "", "probe").otherwise(s)


def bounded(text: Column, size: int = 240, collapse: bool = True) -> Column:
    """A text cut after ``size`` characters, with an ellipsis; white space is collapsed first where ``collapse``."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " ")) if collapse else text
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, size), F.lit("…")))


def snippet(name: Column, text: Column) -> Column:
    """The text from 120 characters before a name to 280 after its start; the first 400 where it doesn't occur."""
    at = F.instr(text, name) - 1
    start = F.greatest(at - 120, F.lit(0))
    return F.when(at < 0, F.substring(text, 1, 400)).otherwise(F.substr(text, start + 1, at + 280 - start))


def is_json(text: Column) -> Column:
    """Whether a whole text is one JSON value (repeated keys are none of its faults); null is none.

    Spark's readers stop after the first value. So the text must be the only element of an array and the only member of an object: what
    follows a value can't close both.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    element = F.from_json(F.concat(F.lit('{"v":['), text, F.lit("]}")), "v array<string>", strict)["v"]
    member = F.from_json(F.concat(F.lit('{"v":{"a":'), text, F.lit("}}")), "v map<string,string>", strict)["v"]
    return F.coalesce((F.size(element) == 1) & (F.size(member) == 1), F.lit(False))


def block(text: Column, first: Column, next_line: Column, size: int = 2000) -> Column:
    """The lines from ``first`` up to the one before ``next_line`` (null: all), cut after ``size`` characters."""
    lines = F.split(text, "\n")
    end = F.coalesce(next_line, F.size(lines) + 1)
    return F.substring(F.array_join(F.slice(lines, first, F.greatest(end - first, F.lit(0))), "\n"), 1, size)


def guard(code: Column) -> Column:
    """(condition, kind) of the first of GUARDS that a block holds, else null."""
    found = [F.when(code.rlike(p), F.struct(F.trim(F.regexp_replace(F.regexp_extract(code, p, 1), r"\s+", " ")).alias("condition"), F.lit(k).alias("kind"))) for p, k in GUARDS]
    return F.coalesce(*found)


def suspects(code: Column) -> Column:
    """The suspected fields that a block mentions."""
    return F.array_compact(F.array(*[F.when(code.rlike(p), F.lit(label)) for p, label in SUSPECTS]))


def needle(text: Column, specifier: Column) -> Column:
    """A specifier in the quotes it has in a text, double ones first; null where it has none."""
    double, single = F.concat(F.lit('"'), specifier, F.lit('"')), F.concat(F.lit("'"), specifier, F.lit("'"))
    return F.when(F.contains(text, double), double).when(F.contains(text, single), single)


def lifecycle_event(name: Column) -> Column:
    """B39"""
    return name.rlike(r"(?i)^(?:init|ready|setup)$") | name.rlike(r"^(?:render|pre|create|update|delete)[A-Z_-]")


def call_root(target: Column) -> Column:
    """A call's first name."""
    return F.regexp_extract(target, r"^[^.\[]*", 0)


def simple_name(target: Column) -> Column:
    """A call's last name."""
    return F.substring_index(target, ".", -1)


def state_operation(target: Column) -> Column:
    """Read, write or null."""
    return F.when(target.rlike(r"\.(?:getFlag|getItem|get)$"), "read").when(target.rlike(r"\.(?:setFlag|unsetFlag|setItem|removeItem|set)$"), "write")


def effect_sink(target: Column) -> Column:
    """B41"""
    return target.rlike(r"(?:\.update|\.delete|createEmbeddedDocuments|updateEmbeddedDocuments|deleteEmbeddedDocuments|ChatMessage\.create|ui\.notifications\.(?:info|warn|error)|Hooks\.(?:call|callAll)|\.emit)$")


def takes_callbacks(target: Column) -> Column:
    """B42"""
    return target.rlike(r"(?:^|\.)(?:map|filter|reduce|forEach|then|catch|finally|on|once|addEventListener|register)$")


def first_bytes(text: Column, size: int) -> Column:
    """The first ``size`` bytes of a text in UTF-8; a code point that is cut becomes a replacement character."""
    return F.when(F.octet_length(text) <= size, text).otherwise(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, size).cast("string")))


def exports(code: Column) -> Column:
    """(kind, name) of each exported name, as an array; of several kinds the last counts."""
    found = F.concat(*[F.transform(F.regexp_extract_all(code, F.lit(p), F.lit(1)), (lambda kind: lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))(k)) for k, p in EXPORTS])
    return F.aggregate(found, F.array().cast("array<struct<kind:string,name:string>>"), lambda s, x: F.array_append(F.filter(s, lambda y: y["name"] != x["name"]), x))


def cross_map(label: Column) -> Column:
    """B55"""
    return F.when(label == "repository-only", "cross-map-confirmed").otherwise(label)


def claim_confidence(kinds: Column, references: Column, disowns: Column) -> Column:
    """Of a claim with so many kinds of evidence and references; claims of what a region does not own count less."""
    base, top = F.when(disowns, 0.52).otherwise(0.58), F.when(disowns, 0.78).otherwise(0.95)
    return F.round(F.least(top, base + kinds * 0.07 + F.least(references, F.lit(4)) * 0.035), 2)


def argument_index(value: Column) -> Column:
    """I of "name#i"."""
    return F.regexp_extract(value, r"#(\d+)$", 1).try_cast("int")


def seam_confidence(effects: Column) -> Column:
    """B61"""
    return F.when(effects <= 1, "high").when(effects <= 3, "medium").otherwise("low")


def information_gain(score: Column) -> Column:
    """B61"""
    return F.when(score >= 50, "high").when(score >= 24, "medium").otherwise("low")


def compact_values(values: Column) -> Column:
    """B62: "name?:type" of (name, optional, type) structs."""
    return F.transform(values, lambda v: F.concat(v["name"], F.when(v["optional"], "?").otherwise(""), F.when(F.coalesce(v["type"], F.lit("")) != "", F.concat(F.lit(":"), v["type"])).otherwise("")))


def sha(text: Column, size: int = 64) -> Column:
    """The first digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, size)


def contract_id(kind: Column, key: Column) -> Column:
    """B71"""
    return F.concat(F.lit("contract:"), kind, F.lit(":"), sha(F.concat_ws(":", kind, key), 16))


def region_id(repository: Column, prefix: Column) -> Column:
    """B72"""
    slug_ = F.when(prefix == "", "repository").otherwise(prefix)
    return F.concat(F.lit("semantic:"), F.regexp_replace(slug_, "[^a-zA-Z0-9/_-]+", "-"), F.lit(":"), sha(F.concat_ws(":", repository, slug_), 10))


def evidence_id(region: Column, kind: Column, key: Column) -> Column:
    """B72"""
    return F.concat(F.lit("evidence:"), sha(F.concat_ws(":", region, kind, key), 14))


def continuation_id(segment: Column, symbol: Column, chunk: Column) -> Column:
    """B74"""
    return F.concat(F.lit("ctx-"), sha(F.concat_ws("\n", segment, symbol, chunk.cast("string")), 20))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences."""
    return F.when(F.length(needle) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int"))


def strength(label: Column) -> Column:
    """A label's place in the lattice, from 1."""
    return F.coalesce(F.create_map(*[F.lit(x) for i, n in enumerate(LATTICE) for x in (n, i + 1)])[label], F.lit(1))


def strongest(label: Column) -> Column:
    """B54 as an aggregate."""
    return F.element_at(F.array(*[F.lit(n) for n in LATTICE]), F.max(strength(label)).cast("int"))


def confidence(score: Column) -> Column:
    """B56"""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.2), score / 24))


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; nothing out of nothing is all of it."""
    return F.when(whole == 0, 100).otherwise(F.floor(100 * part / whole + 0.5)).cast("int")


def pressure(lines: Column, ideal: int = 500, moderate: int = 800, high: int = 1200) -> Column:
    """How hard a file's size presses."""
    return F.when(lines <= ideal, "minimal").when(lines <= moderate, "moderate").when(lines <= high, "high").otherwise("very-high")


def stable_id(prefix: str, *parts: Column, size: int = 20) -> Column:
    """Prefix and the first digits of the SHA-256 of the parts joined by NUL."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, size))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16-free (ASCII) characters, in hexadecimal."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step)), 8, "0"))
