"""Secret scans by a trigram inverted index, with DataFrame functions only.

For each rule's regular expression a Boolean trigram query is derived: what every match must contain. Documents are indexed by the trigrams
that any query names (postings: trigram -> places of rows whose texts hold it, lower case); a rule's query is answered by intersecting and uniting
postings, and only candidates are verified by the rule itself. Rules without a mandatory trigram (runs of hexadecimal digits) scan all texts.

Base rules are assign, access and hex: leftmost, not overlapping within a rule, failing matches dropped without a retry. The others are added
(github, slack, google, jwt, pem). Offsets are code points, ends exclusive.

Nulls and empty texts have no spans; very long texts are taken whole, repeated rows each by themselves, and an empty table gives an empty result.
Rows are known by their place (file and number in it), so that equal texts do not meet. Postings are reduced to a row a text before they are
shuffled, so no trigram's list is gathered in one place. Texts stay where they are but for candidates: a bit table of fixed size leaves out most
others first, an exact join decides. Positions are summed in blocks, so that many matches in one text stay cheap. Columns of any names go through
(`found` gives way).
"""

from __future__ import annotations

import re._constants as c
import re._parser as sre
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import bit_table, documents, maybe, placed, whole_row, written


@dataclass(frozen=True)
class Rule:
    """A rule: what matches, which group must have `least` characters, and whether it belongs to the base."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


#: Case-insensitive letters are ASCII only in Java. A run of at least n is a maximal run that is then found long enough.
RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
)
#: Strings of a set that a query keeps apart; a larger set is cut to what its strings must contain.
SPELLED = 16
BLOCK = 256

#: A query is True (no demand), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _all(queries: list[Query]) -> Query:
    parts = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(queries: list[Query]) -> Query:
    parts = list(dict.fromkeys(queries))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _holds(strings: set[str]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _spell(tree) -> tuple[set[str] | None, Query]:
    """Of a parsed sequence: all strings it may match, lower case (None: too many), and what any match must hold."""
    spelled, whole = {""}, True
    demands: list[Query] = []
    for op, arg in tree:
        more, demand = _spell_one(op, arg)
        demands.append(demand)
        if more is not None and len(spelled) * len(more) <= SPELLED:
            spelled = {a + b for a, b in product(spelled, more)}
            continue
        # The run of known strings ends here; a new one begins with what this piece matches, if that is known.
        demands.append(_holds(spelled))
        spelled, whole = more or {""}, False
    demands.append(_holds(spelled))
    return (spelled if whole else None), _all(demands)


def _spell_one(op, arg) -> tuple[set[str] | None, Query]:
    if op is c.LITERAL:
        return {chr(arg).lower()}, True
    if op is c.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is c.LITERAL:
                chars.add(chr(value).lower())
            elif kind is c.RANGE and value[1] - value[0] < SPELLED:
                chars.update(chr(x).lower() for x in range(value[0], value[1] + 1))
            else:
                return None, True
        return (chars, True) if len(chars) <= SPELLED else (None, True)
    if op is c.SUBPATTERN:
        return _spell(arg[-1])
    if op is c.BRANCH:
        ways = [_spell(x) for x in arg[1]]
        strings = None if any(s is None for s, _ in ways) else set().union(*(s for s, _ in ways))
        return (strings if strings is not None and len(strings) <= SPELLED else None), _any([q for _, q in ways])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        least, most, body = arg
        strings, demand = _spell(body)
        if strings is not None and most == 1:
            return strings | {""} if least == 0 else strings, True
        if strings is not None and least == most and len(strings) ** least <= SPELLED:
            return {"".join(x) for x in product(strings, repeat=least)}, True
        return None, demand if least else True
    return None, True


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern, over lower-case text."""
    return _spell(sre.parse(pattern))[1]


def trigrams(query: Query) -> list[str]:
    """The trigrams that a query names."""
    if query is True:
        return []
    return [query] if isinstance(query, str) else sorted({t for q in query[1:] for t in trigrams(q)})


def postings(texts: DataFrame, names: list[str]) -> DataFrame:
    """The inverted index over the named trigrams: (trigram's number in names, file and at of a text that holds it). texts: __text, file, at."""
    lowered = texts.select("file", "at", F.lower("__text").alias("__text"))
    none = F.lit(len(names))
    held = F.array_remove(F.array(*(F.when(F.contains("__text", F.lit(t)), F.lit(i)).otherwise(none) for i, t in enumerate(names))), none)
    return lowered.select("file", "at", F.explode(held).alias("trigram"))


def answered(query: Query, place: dict[str, int]) -> Column:
    """The query over a text's postings, whose trigrams are bits of the words m0, m1, ..."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        word, bit = divmod(place[query], 62)
        return F.col(f"m{word}").bitwiseAND(F.lit(1 << bit)) != 0
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [answered(q, place) for q in query[1:]])


def candidates(index: DataFrame, rules: tuple[Rule, ...], names: list[str]) -> DataFrame:
    """__file, __at and a flag __<rule> for each rule with a trigram query, of rows with any: postings intersected and united by place."""
    words = range(-(-len(names) // 62))
    bit = lambda w: F.when(F.floor(F.col("trigram") / 62) == w, F.expr("shiftleft(1L, cast(trigram % 62 AS INT))")).otherwise(F.lit(0).cast("long"))
    masks = index.groupBy("file", "at").agg(*(F.bit_or(bit(w)).alias(f"m{w}") for w in words))
    place = {t: i for i, t in enumerate(names)}
    flags = {r.name: answered(q, place) for r in rules if (q := trigram_query(r.pattern)) is not True}
    flagged = masks.select(F.col("file").alias("__file"), F.col("at").alias("__at"), *(f.alias(f"__{n}") for n, f in flags.items()))
    return flagged.where(reduce(lambda a, b: a | b, [F.col(f"__{n}") for n in flags]))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind, end, name>> of a rule in a text: gaps and matches alternate, and running sums of their lengths are positions."""
    rx = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x))
    size = F.transform(F.regexp_extract_all(text, rx, F.lit(0)), lambda x: F.char_length(x))
    kept = F.transform(F.regexp_extract_all(text, rx, F.lit(rule.group)), lambda x: F.char_length(x) >= rule.least)
    pieces = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(size)).alias("g"), size.alias("m"), kept.alias("k"))
    span = "array<struct<s:int,e:int>>"
    start = lambda: F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

    def step(acc: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    def of(p: Column) -> Column:
        def one(b: Column) -> Column:
            def inner(acc: Column, x: Column) -> Column:
                s = acc["at"] + x["g"]
                e = s + x["m"]
                return F.struct(e.alias("at"), F.when(x["k"], F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(acc["out"]).alias("out"))

            return F.aggregate(F.slice(p, b * BLOCK + 1, F.lit(BLOCK)), start(), inner)

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), one)
        return F.aggregate(blocks, start(), step)["out"]

    found = F.when(F.size(size) > 0, of(pieces)).otherwise(F.array().cast(span))
    return F.transform(found, lambda x: F.struct(x["s"].alias("start"), F.lit(order).alias("kind"), x["e"].alias("end"), F.lit(rule.name).alias("name")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with `found`: all spans of the rules, by start, then rule. docs is read from files, or written first."""
    asked = {r.name: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    names = sorted({t for q in asked.values() for t in trigrams(q)})
    marked = placed(docs, whole_row(docs, "doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    if names:
        hits = written(candidates(postings(marked.select("__text", "file", "at"), names), rules, names), "secrets-hits")
        flagged = maybe(marked, bit_table(hits, "__file", "__at"), "file", "at")
        flags = [f"__{n}" for n in asked]
        here = (F.col("file") == F.col("__file")) & (F.col("at") == F.col("__at"))
        rest = flagged.where("NOT held").select("doc", "__text", *(F.lit(False).alias(f) for f in flags))
        marked = rest.union(flagged.where("held").join(hits, here, "left").select("doc", "__text", *(F.coalesce(f, F.lit(False)) for f in flags)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")
    body = F.col("__text")
    each = []
    for order, r in enumerate(rules):
        possible = F.col(f"__{r.name}") if r.name in asked else F.lit(True)
        each.append(F.when(possible & body.rlike(r.pattern), spans(body, r, order)).otherwise(none))
    others = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != "found"]
    # In two steps: beside a field of doc with its name, the text's name would mean that field.
    return marked.select("doc", F.array_sort(F.concat(*each)).alias("found")).select(*others, "found")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    base = [r.name for r in RULES if r.base]
    df = scan(documents(spark, sf_dir, "doc_id", "text"))

    def count(name: str) -> Column:
        return F.size(F.filter(found, lambda x: x["name"] == name)).cast("long").alias(f"n_{name}")

    return df.select("doc_id", *map(count, base), F.sha2(_joined(F.filter(found, lambda x: x["name"].isin(base))), 256).alias("base_sha256"), _joined(found).alias("spans"))
